import re

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from maternis.llm import edit_counts as E

PATH = public_tokenizers.path("byte_bpe_50k.json")
V = E.counter(PATH)
TOK = Tokenizer.from_file(PATH)
TOK.encode_special_tokens = True
LETTERS = st.text(alphabet=st.sampled_from("abré 's're12.!\n\t "), max_size=40)


def count(text):
    return len(TOK.encode(text, add_special_tokens=False).ids)


def plain(text, edits):
    """The edits without a tree."""
    out, at = "", 0
    for a, b, new in sorted((max(0, a), b, new) for a, b, new in edits):
        a = min(max(a, at), len(text))
        b = min(max(b, a), len(text))
        out += text[at:a] + new
        at = b
    return out + text[at:]


@settings(max_examples=1500, deadline=None)
@given(LETTERS, st.lists(st.tuples(st.integers(0, 40), st.integers(0, 8), LETTERS.map(lambda s: s[:6])), max_size=4))
def test_trees_against_counting_anew(text, edits):
    E.LEAF, saved = 2, E.LEAF
    try:
        edits = [(a, a + n, new) for a, n, new in edits]
        tree = E.build(text, V)
        assert tree.total == count(text)
        got, _, _ = E.apply_edits(tree, text, [dict(start=a, end=b, replacement=new) for a, b, new in edits], V)
        assert got == plain(text, edits)
        assert tree.total == count(got)
        want = V.pattern.findall(got)
        assert [x for n, _ in tree.leaves for x in n] == list(map(len, want))
        assert tree.chars[1] == len(got)
    finally:
        E.LEAF = saved


def test_long_text_encodes_only_the_region():
    text = "The quick brown fox, it's 42.\n" * 4000
    tree = E.build(text, V)
    got, made, encoded = E.apply_edits(tree, text, [dict(start=50_000, end=50_004, replacement="x y"),
                                                    dict(start=90_000, end=90_000, replacement=" new")], V)
    assert made == 2 and encoded < 30 and tree.total == count(got)


def test_query_against_counting_anew(spark):
    from maternis.llm.queries import op7_edit_counts
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_edit_counts(spark, sf).collect()
    assert len(rows) == len(docs) and sum(r.n_edits for r in rows) > 50
    kinds = ((r"[0-9]{9,}", "[NUMBER]"), (r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", "[ADDRESS]"),
             (r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "[MAIL]"), (r"(?m)^Licensed under [^\n]*\n?", ""))
    for r in rows:
        t = docs[r.doc_id]
        edits = [(m.start(), m.end(), new) for p, new in kinds for m in re.finditer(p, t, re.ASCII)]
        assert (r.tokens_before, r.n_tokens) == (count(t), count(plain(t, edits)))


def test_nulls_repeats_clashes_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "call 123456789 now", 2), (2, "call 123456789 now", 2), (None, "", 3)],
                               "doc_id bigint, text string, edits int")
    got = sorted((r.doc_id or 0, r.tokens_before, r.n_edits, r.n_tokens) for r in E.count_after_masking(df, PATH).collect())
    two = (2, count("call 123456789 now"), 1, count("call [NUMBER] now"))
    assert got == [(0, 0, 0, 0), (1, 0, 0, 0), two, two]
    assert E.count_after_masking(df.limit(0), PATH).collect() == []
    trees = E.build_trees(df, PATH).selectExpr("*", "cast(null as array<struct<start:int,end:int,replacement:string>>) edits")
    assert sum(r.n_edits for r in E.edit_trees(trees, PATH).collect()) == 0
    # the new state is the tree of the new text, and can be edited again
    change = "array(named_struct('start', 5, 'end', 14, 'replacement', '9'))"
    once = E.edit_trees(trees.selectExpr("doc_id", "text", "lengths", "counts", f"{change} edits").where("doc_id = 2"), PATH)
    for r in once.collect():
        assert r.text == "call 9 now" and E.unpacked(r.lengths) == [4, 2, 4] and sum(E.unpacked(r.counts)) == r.n_tokens
    again = E.edit_trees(once.selectExpr("doc_id", "text", "lengths", "counts", "array(named_struct('start', 0, 'end', 4, 'replacement', 'ring')) edits"), PATH)
    assert {(r.text, r.n_tokens) for r in again.collect()} == {("ring 9 now", count("ring 9 now"))}
