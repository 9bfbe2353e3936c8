import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from maternis.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def library_ids(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_grammar_round_trip_and_random_access(ids, a, b):
    ids = np.array(ids, T.U4)
    rules, lens, symbols = T.repair(ids, 4, min_pairs=2)
    g = T.Grammar(rules.tobytes(), lens.tobytes(), symbols.tobytes(), 4)
    assert g.expand(g.symbols).tolist() == ids.tolist()
    a, b = sorted((min(a, len(ids)), min(b, len(ids))))
    assert g.decode_range(a, b).tolist() == ids[a:b].tolist()


def test_grammar_compresses_repeats():
    ids = np.tile(np.arange(50, dtype=T.U4), 200)
    rules, lens, symbols = T.repair(ids, 100)
    assert len(symbols) + 2 * len(rules) < len(ids) / 20
    same = np.zeros(1000, T.U4)
    rules, lens, symbols = T.repair(same, 1)
    g = T.Grammar(rules.tobytes(), lens.tobytes(), symbols.tobytes(), 1)
    assert g.expand(g.symbols).tolist() == same.tolist() and len(symbols) < 100


def expected(rows):
    start, out = 0, []
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(library_ids(t) + [0], T.U4)
        out.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_whole_table_round_trip(spark):
    from maternis.llm.queries import op1_token_files
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in op1_token_files(spark, sf).collect())
    assert got == expected(rows)


def test_edges_small_shards_and_random_access(spark, tmp_path):
    df = spark.createDataFrame([(2, "b b b", 9), (1, None, 1), (1, "", 2), (None, "x\ty", 3), (3, "word " * 3000, 4),
                                (2, "b b b", 9)], "doc_id bigint, text string, part int")
    out = str(tmp_path / "f")
    T.write_token_files(df, PATH, out, shard_ids=4)
    got = T.read_token_files(spark, out, with_ids=True).collect()
    want = expected([(r.doc_id, r.text) for r in df.collect()])
    assert sorted((tuple(r)[:4] for r in got), key=lambda r: r[1]) == want
    assert all(r.ids[-1] == 0 for r in got)
    shards = T.read_shards(spark, out)
    s = shards.orderBy("n_ids", ascending=False).first()
    whole = [r.id for r in T.read_range(shards, s.part, s.shard, 0, s.n_ids).orderBy("pos").collect()]
    part = [r.id for r in T.read_range(shards, s.part, s.shard, 100, 120).orderBy("pos").collect()]
    assert part == whole[100:120] and len(whole) == s.n_ids
    T.write_token_files(df.limit(0), PATH, str(tmp_path / "e"))
    assert T.read_token_files(spark, str(tmp_path / "e")).collect() == []
