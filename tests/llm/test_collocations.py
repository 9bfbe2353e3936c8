import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from maternis.llm import collocations as C
from maternis.llm.pieces import text_bytes


def lower(t):
    return "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in t)


def counts(rows, most=3):
    f, n = Counter(), Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, least=10, most=3, top=2000):
    f, n = counts(rows, most)
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    dropped = {(lang, w[i:i + k]) for (lang, w), a in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1)
               if 100 * a >= 50 * f[lang, w[i:i + k]]}
    out = {}
    for (lang, w), a in found.items():
        if (lang, w) in dropped:
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                                    for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, rows_ in out.items()
                  for rank, (score, a, p, left, right) in enumerate(sorted(rows_)[:top], 1))


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, rows, words, langs=("en", "de", None)):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["", "é", "A", "中"]) + w for w in words]
    out = []
    for _ in range(rows):
        parts = [rng.choice(vocabulary) if rng.random() < 0.7 else "New  York\tCity" for _ in range(rng.randint(0, 30))]
        out.append(("".join(p + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", " \r\n"]) for p in parts), rng.choice(langs)))
    return out


@pytest.mark.parametrize("text", ["", " ", "a", " a\tb ", "A.b c", "a\nb\x0bc d\x0e\x0f e", "é É,中 中", "a  b;;c"])
def test_slices_cut_words_and_pieces(text):
    offsets, data, _ = text_bytes(pa.array(["z", "x y", text, text])[1:])
    part = C.Slice(offsets, data)
    f, n = counts([("x y", None), (text, None), (text, None)])
    assert len(part.word) == n["und"]
    for size in (1, 2, 3):
        at, count = part.distinct(part.places(size), size)
        assert dict(zip(part.strings(at, size).to_pylist(), count.tolist())) == {
            " ".join(w): c for (_, w), c in f.items() if len(w) == size}


def test_long_texts_are_cut_at_pieces(monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 50)
    rows = [("one two three four. " * 40, "en"), ("nocut " * 100, "en"), ("a b, c d", "de"), ("", "en"), ("x" * 400, "en")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([r[0] for r in rows])], ["lang", "t"])
    total, n_slices = Counter(), 0
    for lang, part in C.slices(iter([batch, batch])):
        n_slices += 1
        for size in (1, 2, 3):
            at, count = part.distinct(part.places(size), size)
            for p, c in zip(part.strings(at, size).to_pylist(), count.tolist()):
                total[lang, tuple(p.split(" "))] += c
    assert total == counts(rows + rows)[0] and n_slices > 10


@pytest.mark.parametrize("shards,most", [(1, 3), (3, 3), (5, 4)])
def test_random_texts_against_brute_force(spark, monkeypatch, shards, most):
    monkeypatch.setattr(C, "SLICE_BYTES", 2000)
    rows = texts(shards, 400, ["of", "the", "a", "b", "c", "York", "New", "x" * 50])
    df = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    want = brute(rows, most=most)
    assert got(C.collocations(df, max_words=most, shards=shards)) == want and len(want) > 30
    assert got(C.collocations(df, max_words=most, shards=shards, top=5)) == [r for r in want if r[1] <= 5]


def test_full_bit_map_changes_nothing(spark, monkeypatch):
    rows = texts(9, 200, ["of", "the", "a", "b", "c"])
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    monkeypatch.setattr(C, "bit_map", lambda candidates: np.full(1 << (C.FILTER_BITS - 6), -1, np.int64).tobytes())
    assert got(C.collocations(df)) == brute(rows)


def test_edges(spark):
    rows = [(None, "en", 1), ("", "en", 2), ("Big Apple. " * 12, None, 3), ("big apple pie " * 12, "en", 4),
            ("tie one tie two " * 20, "de", 5), ("Ünder ünder", "", 6)] + [("same row here", "fr", 7)] * 10
    df = spark.createDataFrame(rows, "text string, lang string, phrase int")
    assert got(C.collocations(df)) == brute([r[:2] for r in rows])
    assert C.collocations(df.limit(0)).collect() == []


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", 0, "", 10 * big), ("en", 1, "a", 2 * big), ("en", 1, "b", 3 * big), ("en", 2, "a b", big)]
    df = spark.createDataFrame(rows, "lang string, size int, phrase string, f bigint")
    (r,) = C.scored(df).collect()
    assert (r.score, r.l, r.r) == (1_000_000 * big * big // (6 * big * big), 2 * big, 3 * big)


def test_query_against_brute_force(spark):
    from maternis.llm.queries import op13_collocations
    sf = "/root/testdata/sf0.01"
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op13_collocations(spark, sf)) == brute(rows)
