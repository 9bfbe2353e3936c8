import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from maternis.llm import order_minhash as O
from maternis.llm.components import components


def indel(a, b):
    d = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(d[j - 1] if x == y else 1 + min(d[j], row[j - 1]))
        d = np.array(row)
    return int(d[-1])


def alike(a, b):
    d, sa, sb = indel(a, b), set(a.tolist()), set(b.tolist())
    n = len(a) + len(b)
    return (n - d) / (n + d) >= 0.8 - 1e-12 and len(sa & sb) / len(sa | sb) >= 0.8 - 1e-12


seqs = st.lists(st.integers(0, 5), min_size=1, max_size=30)


@settings(max_examples=300, deadline=None)
@given(seqs, st.lists(st.tuples(st.integers(0, 29), st.integers(0, 5)), max_size=4), st.integers(0, 12))
def test_alignment_against_the_full_table(a, edits, limit):
    b = list(a)
    for at, v in edits:
        b[at % len(b)] = v
    a, b = np.array(a, np.uint64), np.array(b[edits[0][0] % 3:] if edits else b, np.uint64)
    if len(b):
        assert O.banded_distance(a, b, limit) == min(indel(a, b), limit + 1)
        assert O.aligned(a, b) == alike(a, b)


def truth(rows):
    """Classes of all pairs by brute force."""
    parent = {k: k for k, _ in rows if k is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    seq = [(k, t.split(), O.shingles(O.word_hashes(t))) for k, t in rows if k is not None and t and t.split()]
    for i, (k, w, x) in enumerate(seq):
        for q, v, y in seq[:i]:
            if w == v or (abs(len(x) - len(y)) <= (len(x) + len(y)) / 9 and len(set(x.tolist()) & set(y.tolist())) and alike(x, y)):
                r, s = sorted((find(k), find(q)))
                parent[s] = r
    return {k: find(k) for k in parent}


def near_copy(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.integers(len(words))] = f"x{rng.integers(10_000)}"
    return " ".join(words)


def test_planted_copies_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK", 8)
    rng = np.random.default_rng(1)
    vocab = np.array([f"w{i}" for i in range(500)])
    rows = []
    for g in range(12):
        base = rng.choice(vocab, int(rng.integers(40, 300)))
        for _ in range(int(rng.integers(1, 30))):
            rows.append(near_copy(rng, base, int(rng.integers(0, 5))))
    passage = " ".join(rng.choice(vocab, 60))
    rows += [passage + " " + " ".join(rng.choice(vocab, 30)) for _ in range(40)]
    rows += ["a b", "a b", "c", "", None, "  \n", "is on. " * 300 + "p q r s t", "is on. " * 300 + "u v w x y"]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(rows)), rows)]
    df = spark.createDataFrame(rows + [(None, "a b")], "doc_id bigint, text string")
    got = {r.doc_id: (r.class_id, r.kept) for r in O.near_duplicates(df).collect()}
    want = truth(rows)
    assert len(got) == len(rows) + 1 and got.pop(None) == (None, True)
    assert {k: c for k, (c, _) in got.items()} == want
    assert all(kept == (k == c) for k, (c, kept) in got.items())


def test_short_texts_with_a_word_appended_or_changed(spark):
    rng = np.random.default_rng(3)
    edits = [lambda w: w + ["one"], lambda w: ["one"] + w, lambda w: w[1:], lambda w: w[:-1] + ["two"],
             lambda w: w[:len(w) // 2] + ["six"] + w[len(w) // 2 + 1:]]
    texts = []
    for n in [*range(8, 21), 22, 30, 44, 60]:
        for edit in edits * 12:
            words = [f"v{x}" for x in rng.integers(1 << 40, size=n)]  # so that only the two of a pair are alike
            texts += [" ".join(words), " ".join(edit(words))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in O.near_duplicates(df).collect()}
    same = [alike(*(O.shingles(O.word_hashes(t)) for t in texts[k:k + 2])) for k in range(0, len(texts), 2)]
    assert got == {k: k - k % 2 if same[k // 2] else k for k in range(len(texts))} and sum(same) > 500


def test_short_texts_share_keys_by_the_stated_probability():
    from math import comb
    lengths = [(m, n, k) for m, n, k in ((10 ** 9, O.SKETCHES, O.LENGTH), *O.SHORT)]
    for union in range(5, 1000):
        common = -(-4 * union // 5)
        miss = 1.0
        for most, sketches, take in lengths:
            if take <= union <= most:
                miss *= (1 - comb(common, take) / comb(union, take)) ** sketches
        assert miss < 1e-3, union


def test_query_against_brute_force(spark):
    from maternis.llm.queries import op5_order_minhash
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in op5_order_minhash(spark, sf).collect()} == truth(rows)


def test_repeats_clashes_empty_table_and_kept_rows(spark):
    df = spark.createDataFrame([(1, "a b c", 5, "k"), (1, "a b c", 5, "k"), (2, "a  b c", 6, "l"), (3, None, 7, None),
                                (None, "a b c", 8, "m")], "doc_id bigint, text string, id int, words string")
    got = sorted((r.doc_id or 0, r.class_id, r.kept) for r in O.near_duplicates(df).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    left = O.one_of_each(df)
    assert left.columns == df.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3]
    assert O.near_duplicates(df.limit(0)).collect() == []


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven", "uno dos tres cuatro cinco seis",
             "one  two three four five six seven", "x", "x y"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[3]), (1, texts[4]), (1, texts[5]), (1, texts[4]), (3, texts[2])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = sorted((r.doc_id, r.text) for r in O.one_of_each(df).collect())
    # the two spellings of the second text are one class, as are both rows of the third
    assert left == sorted([(1, texts[0]), (1, texts[1]), (2, texts[2]), (1, texts[4]), (1, texts[5])])
    got = sorted(tuple(r) for r in O.near_duplicates(df).collect())
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 2, True), (2, 1, False), (1, 1, True), (1, 1, True), (1, 1, True), (3, 2, False)])
    # many texts under one id, a copy of each under another
    many = [(k % 2, " ".join(f"w{i}_{j}" for j in range(8))) for i in range(60) for k in (0, 1)]
    df = spark.createDataFrame(many, "doc_id bigint, text string")
    assert sorted(r.text for r in O.one_of_each(df).collect()) == sorted({t for _, t in many})


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)]
    links += [(7, None), (None, None), (500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "x bigint, y bigint"), "x", "y").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        if a is not None and b is not None and a != b:
            r, s = sorted((find(a), find(b)))
            parent[s] = r
    assert got == {k: find(k) for k in parent}


def test_blocks_emit_only_similar_pairs_of_different_components():
    words = [np.arange(k, 60 + k, dtype=np.uint32).tobytes() for k in (0, 1, 30)]
    g = pd.DataFrame({"id": [1, 2, 3], "c": [1, 2, 3], "words": words, "block": 0, "lo": 0, "hi": 0, "k": 0})
    assert O.similar_sets(g).values.tolist() == [[1, 2]]
    assert O.similar_sets(g.assign(c=1)).empty
