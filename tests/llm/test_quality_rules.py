import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maternis.llm import quality_rules as Q

SF = "/root/testdata/sf0.01"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é#|\n\t\x1c　A!1"), max_size=80))
def test_counts_against_brute_force(text):
    assert Q.count_text(text)[:5] == brute(text)


def test_long_text_counts():
    text = "one two three four\n" * 3000 + "x"
    assert Q.count_text(text)[:5] == brute(text)


def test_query_against_brute_force_and_labels(spark):
    from maternis.llm.queries import op10_quality_rules
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op10_quality_rules(spark, SF).collect()
    assert len(rows) == len(docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = wrong = 0
    for r in rows:
        want = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
        if r.doc_id in labels and not r.base_failed:
            right += r.kept == bool(labels[r.doc_id])
            wrong += r.kept != bool(labels[r.doc_id])
    assert right / (right + wrong) > 0.97


def test_learned_list_and_spark_expression_agree(spark):
    rng = np.random.default_rng(5)
    stats = spark.createDataFrame(
        [(i, *[int(v) for v in rng.integers(0, 60, len(Q.COUNTS))]) for i in range(3000)],
        "doc_id bigint, " + ", ".join(f"{c} bigint" for c in Q.COUNTS))
    rows = stats.select("doc_id", *[Q.ratio(r).alias(r) for r in Q.RATIOS]).toPandas()
    bad = (rows["upper_share"] > 0.6) | ((rows["mean_word"] > 2) & (rows["digit_share"] < 0.3))
    labels = spark.createDataFrame([(int(i), int(not b)) for i, b in zip(rows["doc_id"], bad)] + [(7, None)],
                                   "doc_id bigint, quality int")
    rules = Q.fit_rules(stats, labels)
    assert 2 <= len(rules) <= 20
    got = {r.doc_id: r for r in Q.judge(stats, rules).collect()}
    x = {r: rows[r].to_numpy(float) for r in Q.RATIOS}
    any_rule = np.logical_or.reduce([Q.covers(r, x) for r in rules])
    for i, hit in zip(rows["doc_id"], any_rule):
        assert got[i].kept == (not hit and not got[i].base_failed)
    agree = np.mean(any_rule == bad.to_numpy())
    assert agree > 0.93


@pytest.mark.parametrize("n", [0, 1])
def test_nulls_repeats_clashes_and_no_labels(spark, n):
    df = spark.createDataFrame([(1, None, 1, True), (1, "a " * 60, 2, None), (None, "", 3, True), (2, "b", 4, True),
                                (2, "b", 4, True)], "doc_id bigint, text string, n_words int, kept boolean")
    stats = Q.text_statistics(df)
    labels = spark.createDataFrame([(1, 1)][:n], "doc_id bigint, quality int")
    out = Q.judge(stats, Q.fit_rules(stats, labels)).collect()
    assert sorted(r.n_words for r in out) == [0, 0, 1, 1, 60]
    assert all(r.base_failed and not r.kept for r in out)
    assert Q.judge(Q.text_statistics(df.limit(0)), []).collect() == []
