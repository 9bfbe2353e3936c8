import zlib

import numpy as np

from maternis.llm import nbsvm as N

SF = "/root/testdata/sf0.01"


def test_indicators_of_edge_texts():
    assert len(N.indicators("")) == 0
    for t in ("a", " ", "é", "ab", "\n\n", "a b c", "x" * 100_000, "日本 語"):
        row = N.indicators(t)
        assert len(row) and (np.diff(row) > 0).all() and row.max() < N.BUCKETS
    assert set(N.indicators("ab")) <= set(N.indicators("abab"))
    assert len(N.indicators("aa aa aa")) > len(N.indicators("aa"))
    assert not N._seen.any()


def test_dual_descent_reaches_the_primal_minimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    y = np.where(x @ [1.0, -2.0, 0.5] + 0.3 > 0, 1.0, -1.0)
    rows = [np.arange(3)] * 60
    w = N.dual_descent(rows, list(x), y, np.full(60, 1.0), epochs=2000)
    value = lambda v: 0.5 * (v @ v) + np.maximum(0, 1 - y * (x @ v[:3] + v[3])).sum()
    best = np.r_[w[:3], w[-1]]
    assert all(value(best) <= value(best + d) + 1e-2 for d in rng.normal(scale=0.05, size=(200, 4)))


def test_one_class_and_nothing():
    assert N.fit([], np.empty(0, np.int64)).score("x") == 0.5
    assert N.fit([N.indicators("a")], np.array([1])).score("b") > 0.99


def test_query_on_held_out_rows(spark):
    from maternis.llm.queries import op8_quality
    rows = op8_quality(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) == docs
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.97


def test_nulls_repeats_clashes_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, 1.0, "x"), (1, "a b", 2.0, "y"), (None, "", 3.0, None), (2, "*** !!", 4.0, ""),
                                (2, "*** !!", 4.0, "")], "doc_id bigint, text string, score double, _label string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id bigint, quality int")
    model = N.fit_quality(df, labels)
    out = N.score_quality(df, model).select("doc_id", "score", N.held_out().alias("held_out")).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 2}) == 1
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert N.score_quality(df.limit(0), model).collect() == []
    assert N.fit_quality(df, labels.limit(0)).score("x") == 0.5
