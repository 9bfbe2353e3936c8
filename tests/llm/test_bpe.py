import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from maternis.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
OURS = bpe.word_bpe(PATH)
EDGE = ["", "Hello  it's wörld 123 ΑΣ Σ İx <|endoftext|> a'sb\x1cq !'s é́", "a" * 5000, "\n\t  ",
        "<|startoftext|><|endoftext|>", "'S'T'RE don't 'll!!'d", "日本語 ½ ⅷ 𝟘", "J\u030c I\u0307 A\u030a <|ENDOFTEXT|>", "x\x85y\xa0z\u2003w\x1fv"]


def expected(text):
    ids = TOK.encode(text, add_special_tokens=False).ids
    return ids, TOK.decode(ids, skip_special_tokens=False)


def check(text):
    ids, decoded = expected(text)
    assert OURS.encode(text) == ids
    assert OURS.decode(ids) == decoded
    import hashlib
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert OURS.digest(text) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


def test_edge_texts():
    for t in EDGE:
        check(t)


def test_every_code_point():
    """Alone, in a word, before a capital and after a combining mark, as the library's Unicode version has it."""
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or c > 0x3400 and c % 11 and not 0xA000 <= c < 0x12000:
            continue
        text = f"a{chr(c)}B {chr(c)} x\u0301{chr(c)}"
        ids = TOK.encode(text, add_special_tokens=False).ids
        assert OURS.encode(text) == ids, hex(c)
    for c in (0x558, 0x58B, 0xC5C, 0x1C89, 0x208F, 0xA7CB, 0x10940):
        check(f"a{chr(c)}B")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeTHs'tre !#.1²éÉß́\n\t\x1cΣı<|>"), max_size=60))
def test_random_texts(text):
    check(text)


def test_whole_table_against_the_library(spark):
    from maternis.llm.queries import op4_bpe
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op4_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    import hashlib
    for r in rows:
        ids, decoded = expected(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())


def test_nulls_repeats_empty_table_and_clashing_columns(spark):
    schema = "doc_id bigint, text string, n_tokens string, ids_sha256 int"
    df = spark.createDataFrame([(1, None, "x", 1), (1, "", None, 2), (None, "a a", "x", 3), (2, "b", "", 4),
                                (2, "b", "", 4)], schema)
    rows = bpe.bpe_digests(df, PATH).collect()
    assert sorted((r.n_tokens) for r in rows) == [0, 0, 1, 1, 2]
    assert bpe.bpe_digests(df.limit(0), PATH).collect() == []
    enc = bpe.encode_documents(df, PATH)
    assert {tuple(r.ids) for r in enc.collect()} == {(), (320, 320), (321,)}
    assert sorted(r.text for r in bpe.decode_documents(enc, PATH).collect()) == ["", "", "a</w> a</w>", "b</w>", "b</w>"]
