"""Versions: all marts change at once or not at all; merged marts follow by signed deltas."""

import random
import re
import tempfile

import pytest

from pyspark.sql import functions as F

from maternis.plans import pipeline as P
from maternis.sources import publication as PUB
from maternis.sources.sinks import read_mart, write_mart

OM = "codigo string, ano int, causabas string, obitos long, ano_arquivo int"
AC = "codigo string, ano int, ano_arquivo int"


def root():
    return tempfile.mkdtemp(prefix="maternis-pub-")


def marts(spark, rows):
    """An official and a per-death mart of (codigo, ano, causabas, obitos, ano_arquivo) rows."""
    om = spark.createDataFrame(rows, OM)
    return {"om": om, "ac": om.select("codigo", "ano", "ano_arquivo", F.explode(F.sequence(F.lit(1), F.col("obitos").cast("int"))))
            .select("codigo", "ano", "ano_arquivo")}


def table(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ten_random_refreshes_equal_a_rebuild(spark):
    rng, out = random.Random(7), root()
    held = {}
    for turn in range(10):
        years = rng.sample(range(2018, 2024), rng.randint(1, 3))
        for y in years:
            keys = {(rng.choice("123"), rng.choice([y, y - 1, y - 2, None]), rng.choice(["O95", "O00", None]))
                    for _ in range(rng.choice([0, 3, 9]))}
            held[y] = [(*k, rng.randint(1, 5), y) for k in sorted(keys, key=str)]
        snap = PUB.publish(spark, out, marts(spark, [r for y in years for r in held[y]]), years)
        assert snap.version == turn + 1
        rows = spark.createDataFrame([r for v in held.values() for r in v], OM)
        want = rows.groupBy("codigo", "ano", "causabas").agg(F.sum("obitos").alias("obitos"))
        assert table(snap.mart("om").select(want.columns)) == table(want)
        assert table(snap.by_file_year("om")) == table(rows)
        values = rows.unpivot([], [F.col(c).cast("string").alias(c) for c in ("codigo", "ano", "causabas")], "coluna", "valor")
        assert table(snap.values("om")) == table(values.groupBy("coluna", "valor").count())
        assert snap.mart("ac").count() == sum(r[3] for v in held.values() for r in v)
    # a report reads the merged mart without aggregation, and prunes folders
    plan = read_mart(spark, f"{out}/om").where("ano = 2020")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Exchange" not in plan and "PartitionFilters: [isnotnull(ano" in plan
    # old versions go, what the kept ones name stays
    before = {v: table(PUB.snapshot(spark, out, v).mart("om")) for v in (9, 10)}
    assert PUB.collect_old(spark, out, keep=2) and PUB.versions(spark, out) == [9, 10]
    assert {v: table(PUB.snapshot(spark, out, v).mart("om")) for v in (9, 10)} == before
    assert PUB.collect_old(spark, out, keep=2) == []
    with pytest.raises(FileNotFoundError):
        PUB.snapshot(spark, out, 3)


def test_a_run_killed_between_any_two_writes_changes_nothing(spark, monkeypatch):
    out = root()
    first = marts(spark, [("1", 2022, "O95", 2, 2022), ("2", 2023, "O00", 1, 2023)])
    second = marts(spark, [("1", 2023, "O95", 7, 2023), ("3", 2022, "O95", 4, 2023)])
    PUB.publish(spark, out, first, [2022, 2023])
    before = {n: table(read_mart(spark, f"{out}/{n}")) for n in first}

    class Killed(BaseException):
        pass
    steps = {"n": 0, "stop": 0}

    def may_stop(f):
        def run(*a, **k):
            steps["n"] += 1
            if steps["n"] > steps["stop"]:
                raise Killed
            return f(*a, **k)
        return run
    for name in ("_write", "_merge", "_write_new"):
        monkeypatch.setattr(PUB, name, may_stop(getattr(PUB, name)))
    killed = 0
    while True:
        steps["n"] = 0
        try:
            PUB.publish(spark, out, second, [2023], parallel=1)
            break
        except Killed:
            killed += 1
            steps["stop"] += 1
            assert PUB.versions(spark, out) == [1]
            assert {n: table(read_mart(spark, f"{out}/{n}")) for n in first} == before
    assert killed == 7  # files and values of two marts, a merge and its write, the manifest
    assert table(read_mart(spark, f"{out}/om")) == [("1", "O95", 2, 2022), ("1", "O95", 7, 2023), ("3", "O95", 4, 2022)] or \
        sorted(r.obitos for r in read_mart(spark, f"{out}/om").collect()) == [2, 4, 7]


def test_readers_keep_their_version_and_conflicts_are_seen(spark):
    out = root()
    PUB.publish(spark, out, marts(spark, [("1", 2022, "O95", 2, 2022)]), [2022])
    pinned = PUB.snapshot(spark, out)
    plan = pinned.mart("om")
    PUB.publish(spark, out, marts(spark, [("1", 2022, "O95", 9, 2022)]), [2022], batch="b")
    assert [r.obitos for r in plan.collect()] == [2] and [r.obitos for r in pinned.mart("om").collect()] == [2]
    # the same input again publishes nothing
    again = PUB.publish(spark, out, marts(spark, [("1", 2022, "O95", 9, 2022)]), [2022], batch="b")
    assert again.version == 2 and PUB.versions(spark, out) == [1, 2]
    with pytest.raises(PUB.VersionTaken):
        PUB._write_new(spark, f"{out}/{PUB.MANIFESTS}/v00000002.json", "{}")
    with pytest.raises(PUB.CheckFailed):  # other columns than the published mart
        write_mart(spark.createDataFrame([("1", 2022, 2022)], "codigo string, ano int, ano_arquivo int"), f"{out}/om", [2022])
    with pytest.raises(FileNotFoundError):
        read_mart(spark, f"{out}/nothing")


def test_all_rows_withdrawn_is_an_empty_mart(spark):
    out = root()
    full = marts(spark, [("1", 2022, "O95", 2, 2022)])
    PUB.publish(spark, out, full, [2022])
    PUB.publish(spark, out, {n: d.limit(0) for n, d in full.items()}, [2022])
    for name in full:
        df = read_mart(spark, f"{out}/{name}")
        assert df.collect() == [] and "ano" in df.columns


def test_domains_and_searches_from_the_stored_values(spark):
    from maternis.operators import domains, search
    out = root()
    rows = [("1", 2020, "O95", 2, 2022), ("12", 2022, "o94", 1, 2022), (None, 2021, "O9%", 3, 2022), ("3", None, None, 1, 2023)]
    snap = PUB.publish(spark, out, marts(spark, rows), [2022, 2023])
    om, values = snap.mart("om"), snap.values("om")
    assert table(domains.facet_of_values(values, "causabas")) == table(domains.facet_domain(om, "causabas"))
    assert table(domains.year_bounds_of_values(values)) == table(domains.year_bounds(om)) == [(2020, 2022)]
    assert table(domains.series_count_of_values(values, "codigo")) == table(domains.series_count(om, "codigo"))
    for term in ("o9", "O9", "%", "2", "202", "nothing", "3", ""):
        for most in (0, 1, 1000):
            assert table(search.search_values(om, values, term, max_values=most)) == table(search.search_any(om, term)), term
        assert table(search.search_values(om, values, term, ["causabas"])) == table(search.filter_column(om, "causabas", term))
        assert table(search.search_values(om, values, term, ["causabas"], case_sensitive=True)) == table(
            search.filter_contains(om, "causabas", term))
    plan = search.search_values(om, values, "o95", ["causabas"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "O95" in plan.split("PushedFilters")[1]
    # a withdrawn year leaves the domains
    PUB.publish(spark, out, {n: d.limit(0) for n, d in marts(spark, rows).items()}, [2022])
    assert table(domains.facet_of_values(PUB.snapshot(spark, out).values("om"), "codigo")) == [("3",)]


def test_failed_checks_publish_nothing(spark):
    om = marts(spark, [("1", 2022, "O95", 2, 2022)])
    other = marts(spark, [("1", 2022, "O95", 3, 2022)])
    with pytest.raises(PUB.CheckFailed, match="control totals"):
        PUB.publish(spark, out := root(), {"om": om["om"], "ac": other["ac"], "gc": om["om"], "onm": om["om"]}, [2022],
                    check=P.run_checks)
    assert PUB.versions(spark, out) == []
    snap = PUB.publish(spark, out, {"om": om["om"], "ac": om["ac"], "gc": om["om"].limit(0), "onm": om["om"]}, [2022],
                       check=P.run_checks)
    assert snap.checks == {"years": 1, "deaths": 2, "rows_with_nulls": {"om": 0, "ac": 0, "onm": 0}}


def test_no_step_of_the_classification_is_too_long_for_the_jvm(spark):
    """Methods of more than 8,000 bytes are interpreted; the certificates' own columns and the recodes are apart."""
    from maternis.functions import classify as C
    from maternis.plans.classify import recode_stage
    from maternis.sources import fixtures as FX
    folder = root()
    spark.range(40).select(F.col("id").alias("l_orderkey"), F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"),
                           F.col("id").cast("int").alias("l_linenumber"), F.col("id").cast("double").alias("l_quantity")
                           ).write.parquet(f"{folder}/lineitem.parquet")
    raw = FX.sim_raw(spark, folder)
    rows = recode_stage(raw.where(C.raw_candidate())).where(F.col("materno") | F.col("desconsiderado"))
    text = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) <= 8_000, sizes
    # a filter on the file year comes before the generator of the other columns
    assert raw.columns[-1] == "ano_arquivo"
    plan = raw.where(F.col("ano_arquivo") == 2022)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Filter (")


def test_conditional_causes_by_code_and_period(spark):
    from maternis.functions import classify as C
    early = lambda g, p: g == "1" or p == "1"

    def want(c, g, p):
        if c is None:
            return None
        late = p == "2"
        return ("O000" <= c <= "O959" or "O980" <= c <= "O999" or (c in ("A34", "M830") or "F530" <= c <= "F539") and not late
                or ("B200" <= c <= "B249" or c in ("D392", "E230")) and early(g, p))
    codes = ["A34", "A340", "B20", "B200", "B24", "B249", "B250", "D392", "E230", "F53", "F530", "F539", "F54", "M830", "M83",
             "O000", "O95", "O96", "O980", "O999", "", "Z", None]
    rows = [(c, g, p) for c in codes for g in ("1", "2", None) for p in ("1", "2", "3", None)]
    df = spark.createDataFrame(rows, "causabas string, obitograv string, obitopuerp string")
    got = df.select("*", C.maternal_cause().alias("m")).collect()
    assert [r["m"] for r in got] == [want(*r[:3]) for r in got] and len(got) == len(rows)


def test_garbage_deaths_that_are_not_official_are_found(spark):
    om = marts(spark, [("1", 2022, "O95", 2, 2022), ("2", 2022, "O00", 1, 2022), ("3", 2022, None, 1, 2022)])
    for stranger in (("1", 2022, "O94", 2, 2022), ("1", 2022, "O95", 3, 2022), ("2", 2022, None, 1, 2022)):
        gc = spark.createDataFrame([("1", 2022, "O95", 2, 2022), stranger], OM)
        with pytest.raises(PUB.CheckFailed, match="garbage-code"):
            P.run_checks({"om": om["om"], "ac": om["ac"], "gc": gc, "onm": om["om"]})
    for same in (om["om"], om["om"].where("causabas is null"), om["om"].limit(0)):
        assert P.run_checks({"om": om["om"], "ac": om["ac"], "gc": same, "onm": om["om"]})["deaths"] == 4
    twice = om["om"].unionByName(om["om"])  # copies count
    with pytest.raises(PUB.CheckFailed, match="garbage-code"):
        P.run_checks({"om": om["om"], "ac": om["ac"], "gc": twice, "onm": om["om"]})
