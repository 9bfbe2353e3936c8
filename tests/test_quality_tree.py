"""Every copy of duplicate rows, interval trees, values in order of appearance, null keys of dimension joins."""

import random

from conftest import municipalities

from pyspark.sql import functions as F

from maternis.operators import dims, quality, rollup


def brute_copies(rows, at):
    n = {}
    for r in rows:
        k = tuple(r[i] for i in at)
        n[k] = n.get(k, 0) + 1
    return [(*[r[i] for i in at], n[tuple(r[i] for i in at)], *[r[i] for i in range(len(r)) if i not in at])
            for r in rows if n[tuple(r[i] for i in at)] > 1]


def test_every_copy_with_its_count(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", None, ""]), rng.choice([1, 2, 3, None])) for k in range(60)] + [(99, "alone", 1)]
    df = spark.createDataFrame(rows, "id int, `dupe count` string, n int")
    for hot in (1, 2, 4, 10 ** 6):
        got = quality.duplicate_rows(df, ["dupe count", "n"], hot_copies=hot)
        assert got.columns == ["dupe count", "n", "dupe_count", "id"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_copies(rows, (1, 2)), key=str)
    assert quality.duplicate_rows(df).collect() == []  # ids differ
    doubled = df.unionAll(df)
    assert quality.duplicate_rows(doubled).where("dupe_count = 2").count() == 2 * len(rows)
    assert quality.duplicate_rows(df.limit(0)).collect() == []


def test_a_million_copies_stay_spread(spark):
    df = spark.range(0, 1_200_000, 1, 8).select(F.when(F.col("id") % 6 != 0, F.lit("same")).otherwise(
        F.concat(F.lit("x"), (F.col("id") % 90_000).cast("string"))).alias("text"))
    got = quality.duplicate_rows(df)
    parts = got.where("text = 'same'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 1_000_000 and max(r["count"] for r in parts) < 200_000
    assert got.count() == 1_200_000


def nested():
    return [("A00", "B99", "I"), ("A00", "A99", "A"), ("A00", "A09", "a0"), ("A10", "A19", "a1"), ("A15", "A19", "tb"),
            ("B00", "B99", "B"), ("C00", "D48", "II"), ("C00", "C97", "mal"), ("A00", "A09", "a0 again"), ("B95", "C05", "crosses"),
            ("Z99", "Z00", "reversed")]


def ordinal(c):
    return (ord(c[0]) - 65) * 100 + int(c[1:3])


def test_tree_against_brute_force(spark):
    tree = {r.no: r for r in dims.interval_tree(spark.createDataFrame(nested(), "CATINIC string, CATFIM string, DESCRICAO string")).collect()}
    spans = {(lo, hi) for lo, hi, _ in nested() if ordinal(lo) <= ordinal(hi)}
    assert set(tree) == {f"{a}-{b}" for a, b in spans}
    for a, b in spans:
        over = [(c, d) for c, d in spans if (c, d) != (a, b) and ordinal(c) <= ordinal(a) and ordinal(b) <= ordinal(d)]
        up = min(over, key=lambda s: ordinal(s[1]) - ordinal(s[0]), default=None)
        node = tree[f"{a}-{b}"]
        assert (node.pai, node.profundidade) == (up and "-".join(up), len(over))
    order = [(r.CATINIC, r.CATFIM) for r in sorted(tree.values(), key=lambda r: r.ordem)]
    assert order == sorted(spans, key=lambda s: (ordinal(s[0]), -ordinal(s[1])))
    assert tree["A00-A09"].DESCRICAO == "a0"


def test_deaths_of_children_sum_to_their_parent(spark):
    rows = nested()[:9]
    tree = dims.interval_tree(spark.createDataFrame(rows, "CATINIC string, CATFIM string, DESCRICAO string"))
    rng = random.Random(1)
    leaves = [(rng.choice(["A00", "A05", "A12", "A16", "A30", "B01", "C50", "D01", "D49", None]), rng.randint(1, 9)) for _ in range(300)]
    got = {r.no: r for r in rollup.tree_rollup(spark.createDataFrame(leaves, "causabas_categoria string, obitos int"), tree).collect()}
    assert set(got) == {r.no for r in tree.collect()}
    for r in got.values():
        assert r.obitos == sum(n for c, n in leaves if c and ordinal(r.CATINIC) <= ordinal(c) <= ordinal(r.CATFIM))
        assert r.obitos == r.obitos_proprios + sum(c.obitos for c in got.values() if c.pai == r.no)


def test_values_in_order_of_appearance_on_shuffled_partitions(spark):
    rng = random.Random(8)
    rows = [(rng.choice("xy"), rng.choice(["Direta", "Indireta", "Não especificada", None]), k) for k in range(200)] + [("z", None, 999)]
    want = {}
    for by, value, _ in rows:
        if value is not None and value not in want.setdefault(by, []):
            want[by].append(value)
    for parts in (1, 5, 9):
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, tipo string, pos int").repartition(parts)
        got = {r.g: r.tipo for r in rollup.values_in_order(df, ["g"], "tipo", ["pos"]).collect()}
        assert got == {k: ", ".join(v) for k, v in want.items() if v}


def test_null_keys_are_dealt_above_the_broadcast_bound(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 != 0, F.lit(None)).otherwise((F.col("id") % 4).cast("string")).alias("codmunres"), "id")
    small = dims.enrich_municipality(df, municipalities(spark))
    large = dims.enrich_municipality(df, municipalities(spark), max_rows=1)
    assert large.columns == small.columns and sorted(map(str, large.collect())) == sorted(map(str, small.collect()))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spread = dims.enrich_municipality(df, municipalities(spark), max_rows=1).where("codmunres is null").groupBy(
            F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(spread) > 4 and max(r["count"] for r in spread) < 1500
