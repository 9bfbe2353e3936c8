"""Columnar encoding of whole texts: each distinct piece of text is encoded once.

The bytes of an Arrow column are cut before runs of blanks and line feeds, and
between letters and stops, where the pre-tokens of both vocabularies end whatever
stands around. The pieces of a
slice are one Arrow array over the same bytes; it is dictionary-encoded, only its
distinct pieces are looked up in a bounded cache, and their ids are gathered by
offsets. No Python object is made for an occurrence of a piece.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CACHE_ENTRIES = 1_000_000
#: Bytes of text that are encoded at a time (a longer text is a slice of its own).
SLICE_BYTES = 8 << 20
#: Pieces that the library encodes as one text.
JOINED = 1000
U4 = np.dtype("<u4")
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?)"]] = True


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer]:
    """(offsets, bytes, buffer) of a string column without nulls."""
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2] or pa.py_buffer(b"")
    return offsets, np.frombuffer(data, np.uint8), data


def text_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text, or one row."""
    offsets = text_bytes(batch.column(column))[0]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def byte_strings(strings: pa.Array) -> list[bytes]:
    """The values of a binary array (much faster than ``to_pylist``)."""
    at = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset:strings.offset + len(strings) + 1].tolist()
    raw = (strings.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def cuts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where pieces start: at each text, at a blank or line feed after what is surely no white space, and at
    a full stop or the like after a plain letter.

    Characters of the blocks that hold the other white space (U+0080, U+1680, U+2000-207F, U+3000) are
    taken for white space; a piece is only longer for it."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    d = data[lo:hi]
    start = np.zeros(len(d), bool)
    if len(d) > 1:
        white = _ASCII_SPACE[d]
        odd = np.flatnonzero((d == 0xC2) | (d == 0xE1) | (d == 0xE2) | (d == 0xE3))
        for lead, size in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
            at = odd[d[odd] == lead]
            if lead != 0xC2:
                at = at[at + 1 < len(d)]
                at = at[np.isin(d[at + 1], (0x80, 0x81, 0x9A))]
            last = at + size - 1
            white[last[last < len(d)]] = True
        start[1:] = ((d[1:] == 32) | (d[1:] == 10)) & ~white[:-1] | _STOP[d[1:]] & _LETTER[d[:-1]]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]] - lo
    start[begins] = True
    return np.flatnonzero(start) + lo


class PieceCoder:
    """Ids of whole texts by way of their distinct pieces."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], cache_entries: int = CACHE_ENTRIES):
        self.encode_pieces, self.limit = encode, cache_entries
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, U4)
        self.start = np.empty(1 << 14, np.int64)
        self.size = np.empty(1 << 14, np.int64)
        self.used = 0

    def add(self, new: list[bytes]) -> None:
        if self.place and len(self.place) + len(new) > self.limit:
            raise KeyError  # the caller starts again with an empty cache
        ids = self.encode_pieces([p.decode("utf-8") for p in new])
        n, sizes = len(self.place), np.fromiter(map(len, ids), np.int64, len(ids))
        total = self.used + int(sizes.sum())
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.empty(2 * total - self.used, U4)])
        while n + len(new) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.empty(len(x), np.int64)]) for x in (self.start, self.size))
        self.flat[self.used:total] = np.concatenate(ids)
        self.size[n:n + len(new)] = sizes
        self.start[n:n + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.used = total
        self.place.update(zip(new, range(n, n + len(new))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, end of each text in them)."""
        offsets, data, buffer = text_bytes(texts)
        at = cuts(offsets, data)
        if not len(at):
            return np.empty(0, U4), np.zeros(len(texts), np.int64)
        bounds = np.append(at, offsets[-1]).astype(np.int32)
        # the last piece of a text ends where the text does, as the texts follow one another
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), buffer]).dictionary_encode()
        kinds = byte_strings(pieces.dictionary)
        place = list(map(self.place.get, kinds))
        if None in place:
            new = [k for k, p in zip(kinds, place) if p is None]
            try:
                self.add(new)
            except KeyError:
                self.clear()
                self.add(kinds)
            place = list(map(self.place.get, kinds))
        place = np.array(place, np.int64)[pieces.indices.to_numpy(zero_copy_only=False)]
        size = self.size[place]
        ends = np.cumsum(size)
        shift = np.repeat(self.start[place] - (ends - size), size)
        ids = self.flat[shift + np.arange(len(shift))]
        last = np.searchsorted(at, offsets[1:])  # pieces up to the end of each text
        return ids, np.concatenate([[0], ends])[last]


# ---------------------------------------------------------------------------
# the two vocabularies
# ---------------------------------------------------------------------------
class ByteVocabulary:
    """Byte-level vocabulary: the bytes that an id stands for tell where a piece ends in a joined text."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        vocab = self.tokenizer.get_vocab()
        # a vocabulary string has one character for each byte that it stands for
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for string, i in vocab.items():
            self.bytes_of[i] = len(string)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, U4)

    def __call__(self, pieces: list[str]) -> list[np.ndarray]:
        joins = lambda p: p[0] in " \n" and len(p) > 1 and not p[-1].isspace()
        out = [None if joins(p) else self.ids(p) for p in pieces]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for at in range(0, len(rest), JOINED):
            group = [pieces[k] for k in rest[at:at + JOINED]]
            ids = self.ids("".join(group))
            ends = np.cumsum(self.bytes_of[ids])
            to = np.searchsorted(ends, np.cumsum([len(p.encode("utf-8")) for p in group])) + 1
            for k, a, b in zip(rest[at:at + JOINED], [0, *to.tolist()], to.tolist()):
                out[k] = ids[a:b]
        return out


class WordVocabulary:
    """Word-end vocabulary without white space. Of a piece of plain letters and signs it is known how many
    pre-tokens it has, each of which ends in a word-end id; other pieces are joined by a mark that is one id of its own."""

    MARK = "\x01"
    #: The vocabulary's pre-token pattern, for lower-case ASCII without white space.
    ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        (self.mark,) = self.ids(self.MARK).tolist()
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for s, i in vocab.items() if s.endswith("</w>")]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, U4)

    def pre_tokens(self, piece: str) -> int | None:
        """How many pre-tokens a piece has (0: unknown, None: encode it alone)."""
        word = piece.strip(" \n")
        if word.isascii():
            if word.isalpha():
                return 1
            if not word.isprintable() or " " in word or "<|" in word or not word:
                return None  # white space inside, or a special string
            return len(self.ASCII_WORDS.findall(word.lower()))
        if word.isalpha() and max(word) <= "\u00ff":
            return 1
        return None if self.MARK in word or "<|" in word else 0

    def __call__(self, pieces: list[str]) -> list[np.ndarray]:
        counts = list(map(self.pre_tokens, pieces))
        out = [self.ids(p) if c is None else None for p, c in zip(pieces, counts)]
        known = [k for k, c in enumerate(counts) if c]
        for at in range(0, len(known), JOINED):
            group = known[at:at + JOINED]
            ids = self.ids(" ".join([pieces[k] for k in group]))
            to = (np.flatnonzero(self.ends_word[ids])[np.cumsum([counts[k] for k in group]) - 1] + 1).tolist()
            for k, a, b in zip(group, [0, *to], to):
                out[k] = ids[a:b]
        rest = [k for k, c in enumerate(counts) if c == 0]
        for at in range(0, len(rest), JOINED):
            group = rest[at:at + JOINED]
            ids = self.ids(f" {self.MARK} ".join([pieces[k] for k in group] + [""]))
            to = np.flatnonzero(ids == self.mark).tolist()
            for k, a, b in zip(group, [0, *(t + 1 for t in to)], to):
                out[k] = ids[a:b]
        return out


@lru_cache(maxsize=2)
def byte_coder(path: str) -> PieceCoder:
    """One coder for each worker process and file."""
    return PieceCoder(ByteVocabulary(path))


@lru_cache(maxsize=2)
def word_coder(path: str) -> PieceCoder:
    return PieceCoder(WordVocabulary(path))
