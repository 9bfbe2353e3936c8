import math

import pytest
from pyspark.sql import functions as F

from maternis.llm import mixing as M


def brute(rows, draws, target):
    """rows: (key, source, text); draws: {(pass, key, text): draw}."""
    n = lambda t: len((t or "").split())
    tok, cnt = {}, {}
    for _, s, t in rows:
        tok[s] = tok.get(s, 0) + n(t)
        cnt[s] = cnt.get(s, 0) + 1
    total = sum(tok.values())
    p = {s: v / total for s, v in tok.items() if v}

    def state(x):
        u = {s: q ** x for s, q in p.items()}
        z = sum(u.values())
        w = {s: v / z for s, v in u.items()}
        h = -sum(v * math.log(v) for v in w.values()) / (math.log(len(w)) if len(w) > 1 else 1)
        b = target.budget if target.budget is not None else max(tok[s] / w[s] for s in w)
        return (h if len(w) > 1 else 1.0), max(b * w[s] / tok[s] for s in w), b, w
    lo, hi = 0.0, 1.0
    if target.entropy is None or state(1.0)[0] >= target.entropy:
        lo = 1.0
    else:
        for _ in range(60):
            m = (lo + hi) / 2
            lo, hi = (m, hi) if state(m)[0] >= target.entropy else (lo, m)
    if target.repetition is not None and state(lo)[1] > target.repetition * (1 + 1e-12):
        hi = 1.0
        for _ in range(60):
            m = (lo + hi) / 2
            lo, hi = (m, hi) if state(m)[1] > target.repetition * (1 + 1e-12) else (lo, m)
        lo = hi
    _, _, b, w = state(lo)
    out = []
    for s in tok:
        budget = math.floor(b * w[s] + 1e-6 * max(1, b * w[s] / 1e6)) if s in w else 0
        cells = max(1, math.ceil(cnt[s] / M.CELL_ROWS))
        for e in range(max(1, math.ceil(budget / tok[s]) if tok[s] else 1)):
            mine = sorted((draws[e, k, t] % cells, draws[e, k, t], k, t) for k, q, t in rows if q == s)
            at = e * tok[s]
            for _, d, k, t in mine:
                if at < budget or n(t) == 0 and e == 0:
                    out.append((k, s or "", n(t), e, at))
                at += n(t)
    return sorted(out), lo, w


def draws_of(spark, df):
    every = df.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn(
        "_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    draw = F.xxhash64(F.lit(M.SEED), "pass", F.col("doc_id").cast("string"), "_text").alias("draw")
    return {(r["pass"], r.doc_id, r.text): r.draw for r in every.select("pass", "doc_id", "text", draw).collect()}


@pytest.mark.parametrize("target", [M.Target(), M.Target(entropy=None, repetition=None, budget=500),
                                    M.Target(entropy=0.99, repetition=None, budget=300.0),
                                    M.Target(entropy=0.999, repetition=3.0)])
def test_against_brute_force(spark, monkeypatch, target):
    monkeypatch.setattr(M, "CELL_ROWS", 7)
    rows = [(i, ["a", "a", "a", "a", "b", "b", "c", None][i % 8], "w " * (i % 11)) for i in range(160)]
    rows += [(200, "z", None), (201, "z", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = sorted((r.doc_id, r.source or "", r.n_tokens, r["pass"], r.start) for r in M.mix(df, target).collect())
    want, x, w = brute(rows, draws_of(spark, df), target)
    assert got == want
    if target.budget is None:
        share, total = {}, sum(r[2] for r in got)
        for r in got:
            share[r[1]] = share.get(r[1], 0) + r[2] / total
        assert all(abs(share[s or ""] - v) < 0.02 for s, v in w.items())
        assert {r[0] for r in got} == {r[0] for r in rows}


def test_blocks_hold_the_sources_by_weight(spark):
    from maternis.llm.queries import op3_mixing
    sf = "/root/testdata/sf0.01"
    rows = op3_mixing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len({r.doc_id for r in rows}) == docs and max(r["pass"] for r in rows) <= 1
    total = {}
    for r in rows:
        total.setdefault(r.source, {}).setdefault(r.block // 250, 0)
        total[r.source][r.block // 250] += r.n_tokens
    for parts in total.values():
        assert max(parts.values()) < 1.7 * sum(parts.values()) / 4


def test_repeats_clashes_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a", "x y", 1, 2), (1, "a", "x y", 1, 2), (None, None, "x", 3, 4)],
                               "doc_id bigint, source string, text string, budget int, block int")
    out = M.mix(df, payload=("budget", "text"))
    assert sorted((r.doc_id or 0, r.row_budget, r.row_text) for r in out.where("pass = 0").collect()) == [
        (0, 3, "x"), (1, 1, "x y"), (1, 1, "x y")]
    assert M.mix(df.limit(0)).collect() == []
    assert M.mix(df.withColumn("text", F.lit(None).cast("string"))).count() == 3


def test_budget_beyond_the_repetition_limit_is_an_error(spark):
    df = spark.createDataFrame([(k, "s", "w " * 100) for k in range(4)] + [(9, "t", "w " * 200)], "doc_id bigint, source string, text string")
    with pytest.raises(ValueError, match="repeats"):
        M.mix(df, M.Target(repetition=2.0, budget=3000))
    got = M.mix(df, M.Target(entropy=0.0, repetition=2.0, budget=1200)).collect()
    assert sum(r.n_tokens for r in got) == 1200
