from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from maternis.llm import mixing as M
from maternis.llm import nbsvm as N

from .test_mixing import brute as brute_mix
from .test_order_minhash import truth
from .test_secret_scan import brute_all

SF = "/root/testdata/sf0.001"
TOK = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def mask(text):
    out, at = "", 0
    for a, _, b in brute_all(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = N.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(r.text or "") >= N.THRESHOLD]
    classes = truth([(r.doc_id, r.text) for r in rows])
    rows = [(r.doc_id, r.source, mask(r.text or "")) for r in rows if classes[r.doc_id] == r.doc_id]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    every = df.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("t", F.xxhash64("text"))
    draws = {(r["pass"], r.doc_id, r.text): r.draw for r in every.select(
        "pass", "doc_id", "text", F.xxhash64(F.lit(M.SEED), "pass", F.col("doc_id").cast("string"), "t").alias("draw")).collect()}
    mixed, _, _ = brute_mix(rows, draws, P.TARGET)
    want = Counter(r[0] for r in mixed)
    got = P.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == want
    texts = {k: t for k, _, t in rows}
    for r in got:
        assert r.n_tokens == len(TOK.encode(texts[r.doc_id], add_special_tokens=False).ids)
    assert set(want) == set(texts) and max(want.values()) <= 2


def test_stages_keep_the_columns_and_survive_edges(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "w " * 30_000, "en", "s", 60_000),
                                  (4, "a b c d e f g", "en", "t", 13), (4, "a b c d e f g", "en", "t", 13),
                                  (None, "token=abcdef123", None, "t", 15)], schema)
    for data in (docs, docs.limit(0)):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, data, SF)
            assert out.columns == docs.columns
            out.collect()
        assert P.bpe_stage(spark, data, SF).count() == data.count()
