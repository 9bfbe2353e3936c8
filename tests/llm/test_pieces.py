import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from maternis.llm import pieces as P

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
CODERS = {BYTE: P.PieceCoder(P.ByteVocabulary(BYTE), 200), WORD: P.PieceCoder(P.WordVocabulary(WORD), 200)}
PARTS = [*"abthe 's\n\t\r.,é1<|>Σİß中", " ", "　", " ", "\x01", "\x1c", "\x85", "́", "é", "  ", "\n\n",
         "<|endoftext|>", "<|startoftext|>", "Hello", "I'll", "՘", "\U00010940"]


def check(path, texts):
    ids, ends = CODERS[path].encode(pa.array(["x", *texts])[1:])
    got = [part.tolist() for part in np.split(ids, ends[:-1])] if texts else []
    assert got == [LIBRARY[path].encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), max_size=6))
def test_ids_equal_the_library(path, texts):
    check(path, texts)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_every_code_point(path):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    step = [c for k, c in enumerate(points) if c < 0x3000 or k % 23 == 0]
    for at in range(0, len(step), 400):
        check(path, [f"a{chr(c)}B {chr(c)} x{chr(c)}" for c in step[at:at + 400]])


def test_slices_hold_every_row_and_long_texts_alone():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5, "", "b" * 50, "c", "d"])], ["t"])
    parts = list(P.text_slices(batch, 0, limit=6))
    assert [p.column(0).to_pylist() for p in parts] == [["aaaaa", ""], ["b" * 50], ["c", "d"]]
    assert list(P.text_slices(batch.slice(0, 0), 0)) == []
