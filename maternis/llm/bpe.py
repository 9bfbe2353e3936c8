"""Operator 4: BPE encoding and decoding.

A pre-token is encoded by a priority queue of (merge rank, position) over a
doubly linked list of symbols; entries that an earlier merge made stale are
skipped when they are popped. Decoding concatenates vocabulary strings.

The word vocabulary normalises (NFC, white space to one blank, lower case per
character), drops white space between pre-tokens and ends each word in
``</w>``. White space separates pre-tokens, so a text is the concatenation of
its chunks without ASCII white space, and each task encodes a distinct chunk once
(the cache is bounded, and is emptied when full). Chunks of Latin-1 are normalised
and cut here; others by the library's normaliser and pre-tokenizer, so that every
character has the class that its Unicode version gives it. The merges are applied
here to all.

Defined results: a null or empty text has no ids, and decodes to ''. Rows are
mapped one by one: repeated rows give repeated results, an empty table an
empty result. Only the key and the text column are read, so that other columns
may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_rows, text_or_empty
from .pieces import load_tokenizer

#: Entries of a worker's cache of encoded chunks.
CACHE_ENTRIES = 200_000
#: Letters and digits of Latin-1, whose classes no Unicode version changes.
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: The word vocabulary's pre-token pattern, for chunks of Latin-1 without white space.
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}]+"
#: What is left to the library's own normaliser and pre-tokenizer: characters beyond Latin-1, and separators
#: that are white space to one side only.
UNSURE = re.compile("[^\\x00-\\x1b\\x21-\\x84\\x86-\\x9f\\xa1-\\xff]")


def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes are themselves, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in shown)
    names = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of a word-end BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.end = model["end_of_word_suffix"]
        ids = self.vocab
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.last = [ids[s + self.end] for s in symbols]
        self.pattern = re.compile(WORD_PATTERN)
        self.marks = re.compile("|".join(map(re.escape, self.special)))
        library = load_tokenizer(path)  # for the Unicode classes only; the merges are applied here
        self.normalise, self.pre_tokens = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.by_symbol = {s: (ids[s], ids[s + self.end]) for s in symbols}
        self.words: dict[str, list[int]] = {}
        self.chunks: dict[bytes, tuple[str, str]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to a symbol list, lowest rank first, leftmost first."""
        n = len(symbols)
        if n < 2:
            return symbols
        merges, before, after = self.merges, list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(m[0], i, symbols[i], symbols[i + 1], m[1]) for i in range(n - 1)
                 if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale: one of the two was merged meanwhile
            symbols[i], symbols[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, symbols[k])):
                    heapq.heappush(queue, (m[0], i, new, symbols[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((symbols[h], new))):
                heapq.heappush(queue, (m[0], h, symbols[h], new, m[1]))
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> list[int]:
        if (ids := self.words.get(word)) is None:
            raw = word.encode("utf-8")
            ids = self.merge([self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]])
            if len(self.words) >= CACHE_ENTRIES:
                self.words.clear()
            if len(word) <= 64:
                self.words[word] = ids
        return ids

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a text without ASCII white space and special strings."""
        if not UNSURE.search(chunk):
            return [i for w in self.pattern.findall(chunk.lower()) for i in self.word(w)]
        out = []
        for symbols, _ in self.pre_tokens(self.normalise(chunk)):
            pairs = [self.by_symbol[s] for s in symbols]
            out += self.merge([p[0] for p in pairs[:-1]] + [pairs[-1][1]])
        return out

    def plain(self, text: str) -> list[int]:
        return [i for c in text.encode("utf-8").split() for i in self.chunk(c.decode("utf-8"))]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; special strings in it become their ids."""
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self.plain(text[at:m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self.plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, one blank between them (the file names no decoder)."""
        return " ".join([self.strings[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, sha-256 of the ids, sha-256 of the decoded text)."""
        if self.marks.search(text):
            ids = self.encode(text)
            coded, decoded = " ".join(map(str, ids)), self.decode(ids)
        else:
            # lower case before the look-up where it is safe: all of ASCII
            cache, raw = self.chunks, text.encode("utf-8")
            parts = (raw.lower() if text.isascii() else raw).split()
            for p in parts:
                if p not in cache:
                    ids = self.chunk(p.decode("utf-8"))
                    cache[p] = " ".join(map(str, ids)), self.decode(ids)
            # a chunk of characters that the normaliser drops has no ids
            found = [cache[p] for p in parts]
            coded = " ".join([c for c, _ in found if c])
            decoded = " ".join([d for c, d in found if c])
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        return coded.count(" ") + 1 if coded else 0, sha(coded), sha(decoded)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder for each worker process and file."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids array<int>`` of every whole text."""
    return map_rows(docs.select(key, text_or_empty(text).alias(text)),
                    lambda c: ((k, word_bpe(path).encode(t)) for k, t in zip(*c)),
                    f"{key} {dict(docs.dtypes)[key]}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key, text`` of every id list (null: empty)."""
    return map_rows(encoded.select(key, "ids"),
                    lambda c: ((k, word_bpe(path).decode(i or [])) for k, i in zip(*c)),
                    f"{key} {dict(encoded.dtypes)[key]}, text string")


def bpe_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``: every text encoded, decoded and
    digested in the task that reads it, so that neither ids nor texts are shuffled."""
    return map_rows(docs.select(key, text_or_empty(text).alias(text)),
                    lambda c: ((k, *word_bpe(path).digest(t)) for k, t in zip(*c)),
                    f"{key} {dict(docs.dtypes)[key]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
