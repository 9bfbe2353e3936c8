"""Operator 7: token counts that follow edits.

A document is kept as a segment tree over its pre-tokens: leaves hold
``LEAF`` consecutive pre-tokens (their lengths and numbers of tokens), inner
nodes the sums of characters and tokens of their two children. An edit finds
its leaves by the character sums, encodes again only the pre-tokens that it
touches with the context before them, stops where a new pre-token boundary
meets an old one behind the edit, and updates the sums on the paths of the
changed leaves. The total is the root.

Pre-tokens follow the byte-level vocabulary's pattern, which matches from left
to right and looks at most three characters (or a run of white space) past a
boundary; that is the context before an edit. A pre-token is encoded once per
task by the tokenizers library (bounded cache).

An edit replaces characters [start, end) of the original text; the edits of a
document are applied together, by ascending start. Edits that reach past the
text are cut there; an edit that overlaps an earlier one is moved behind it.
Defined results: null and empty texts have an empty tree and count 0; a null
list of edits is empty, a null replacement too; rows are edited one by one, so
repeated rows give repeated results; special strings are ordinary text.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_or_empty
from .secret_scan import match_spans

LEAF = 32
CACHE_ENTRIES = 300_000
#: The byte-level vocabulary's pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters before an edit whose pre-tokens may change with it.
CONTEXT = 3


class Counter:
    """Tokens of pre-tokens, by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        new = [p for p in set(pieces) if p not in self.known]
        if new:
            if len(self.known) + len(new) > CACHE_ENTRIES:
                self.known.clear()
                new = list(set(pieces))
            self.known.update(zip(new, (len(e.ids) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))
        return list(map(self.known.__getitem__, pieces))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class Tree:
    """Segment tree of one document: ``leaves`` of (lengths, counts), ``chars`` and ``tokens`` of the nodes.

    Node 1 is the root, node i has the children 2i and 2i + 1, leaf k is node ``width`` + k."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self.leaves = [(lengths[i:i + LEAF], counts[i:i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])]
        self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (n, c) in enumerate(self.leaves):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(n), sum(c)
        for i in range(self.width - 1, 0, -1):
            self._add_up(i)

    def _add_up(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds the character at ``place``."""
        i, at = 1, 0
        while i < self.width:
            i *= 2
            if place - at >= self.chars[i] and self.chars[i + 1]:
                at += self.chars[i]
                i += 1
        return i - self.width, at

    def replace(self, first: int, last: int, lengths: list[int], counts: list[int]) -> None:
        """Put new pre-tokens in the place of the leaves first..last, spread over them, and update the paths."""
        n, size = last - first + 1, len(lengths)
        touched = set()
        for k in range(n):
            a, b = size * k // n, size * (k + 1) // n
            self.leaves[first + k] = lengths[a:b], counts[a:b]
            i = self.width + first + k
            self.chars[i], self.tokens[i] = sum(lengths[a:b]), sum(counts[a:b])
            touched.add(i // 2)
        while touched and max(touched) > 0:
            for i in touched:
                if i:
                    self._add_up(i)
            touched = {i // 2 for i in touched if i > 1}


def build(text: str, vocabulary: Counter) -> Tree:
    pieces = vocabulary.pattern.findall(text)
    return Tree(list(map(len, pieces)), vocabulary.counts(pieces))


def apply_edit(tree: Tree, text: str, start: int, end: int, new: str, vocabulary: Counter) -> tuple[str, int]:
    """(edited text, pre-tokens encoded); ``tree`` is updated."""
    edited = text[:start] + new + text[end:]
    shift = len(new) - (end - start)
    if not text:
        vars(tree).update(vars(build(edited, vocabulary)))
        return edited, sum(len(n) for n, _ in tree.leaves)
    # back to a boundary whose pre-tokens before it never looked at the edit
    look = max(0, start - CONTEXT)
    while look and text[look - 1].isspace():
        look -= 1
    first, at = tree.find(max(0, look - 1))
    lengths, counts = tree.leaves[first]
    kept = 0
    while kept < len(lengths) and at + lengths[kept] < look:
        at += lengths[kept]
        kept += 1
    head = lengths[:kept], counts[:kept]
    # forward until a new boundary meets an old one behind the edit
    last, old, queue, used = first, at, lengths[kept:], 0
    pieces, place = [], at
    met = False
    for m in vocabulary.pattern.finditer(edited, at):
        pieces.append(m.group())
        place = m.end()
        target = place - shift
        while old < target or (old < end):
            if used == len(queue):
                if last + 1 >= len(tree.leaves):
                    break
                last += 1
                queue, used = tree.leaves[last][0], 0
                continue
            old += queue[used]
            used += 1
        if old == target and old >= end:
            met = True
            break
    if not met:  # the end of the text: every later pre-token is gone
        last, used = len(tree.leaves) - 1, len(tree.leaves[-1][0])
        tail_lengths, tail_counts = [], []
    else:
        skip = kept + used if last == first else used
        tail_lengths, tail_counts = tree.leaves[last][0][skip:], tree.leaves[last][1][skip:]
    tree.replace(first, last, head[0] + list(map(len, pieces)) + tail_lengths,
                 head[1] + vocabulary.counts(pieces) + tail_counts)
    return edited, len(pieces)


def apply_edits(tree: Tree, text: str, edits: list, vocabulary: Counter) -> tuple[str, int, int]:
    """(edited text, edits made, pre-tokens encoded) for edits of the original text."""
    made = encoded = moved = behind = 0
    for start, end, new in sorted((max(0, e["start"]), e["end"], e["replacement"] or "") for e in edits):
        size = len(text) - moved
        start = min(max(start, behind), size)
        end = min(max(end, start), size)
        if start == end and not new:
            continue
        text, n = apply_edit(tree, text, start + moved, end + moved, new, vocabulary)
        moved += len(new) - (end - start)
        behind, made, encoded = end, made + 1, encoded + n
    return text, made, encoded


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------
# Little-endian 32-bit integers: a list of millions of Python integers would cost more than the counting.
STATE = "lengths binary, counts binary"


def packed(numbers: list[int]) -> bytes:
    return array("i", numbers).tobytes()


def unpacked(raw: bytes) -> list[int]:
    out = array("i")
    out.frombytes(raw)
    return out.tolist()


def build_trees(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, text, lengths, counts`` of every row: the leaves, from which the sums follow, to be stored."""
    def rows(columns: list[list]) -> Iterator[tuple]:
        v = counter(vocabulary)
        for k, t, *other in zip(*columns):
            pieces = v.pattern.findall(t)
            yield (k, t, *other, packed(list(map(len, pieces))), packed(v.counts(pieces)))
    types = dict(docs.dtypes)
    return map_rows(docs.select(key, text_or_empty(text).alias(text), *keep), rows,
                    f"{key} {types[key]}, {text} string, " + "".join(f"{c} {types[c]}, " for c in keep) + STATE)


def edit_trees(trees: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
               edits: str = "edits", state: bool = True) -> DataFrame:
    """Apply each row's ``edits`` (array<struct<start, end, replacement>>) to its tree: ``key, tokens_before,
    n_edits, n_encoded, n_tokens`` and, with ``state``, the new ``text, lengths, counts`` to be stored."""
    def rows(columns: list[list]) -> Iterator[tuple]:
        v = counter(vocabulary)
        for k, t, lengths, counts, changes in zip(*columns):
            tree = Tree(unpacked(lengths), unpacked(counts))
            before = tree.total
            t, made, encoded = apply_edits(tree, t, changes or [], v)
            out = k, before, made, encoded, tree.total
            if state and made:
                lengths = packed([x for n, _ in tree.leaves for x in n])
                counts = packed([x for _, c in tree.leaves for x in c])
            yield (*out, t, lengths, counts) if state else out
    return map_rows(trees.select(key, text, "lengths", "counts", edits), rows,
                    f"{key} {dict(trees.dtypes)[key]}, tokens_before bigint, n_edits bigint, n_encoded bigint, n_tokens bigint"
                    + f", {text} string, {STATE}" * state)


def masking_edits(text: Column) -> Column:
    """Edits that mask numbers of nine and more digits, IPv4 addresses and e-mail addresses, and
    delete licence lines: array<struct<start, end, replacement>>."""
    kinds = ((r"[0-9]{9,}", "[NUMBER]"), (r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", "[ADDRESS]"),
             (r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "[MAIL]"), (r"(?m)^Licensed under [^\n]*\n?", ""))

    def edits(pattern: str, new: str) -> Column:
        return F.transform(match_spans(text, pattern), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(new).alias("replacement")))
    return F.concat(*[edits(p, new) for p, new in kinds])


def count_after_masking(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, tokens_before, n_edits, n_encoded, n_tokens``: trees of all documents, edited by ``masking_edits``."""
    slim = docs.select(key, text_or_empty(text).alias(text))
    edited = edit_trees(build_trees(slim.withColumn("edits", masking_edits(F.col(text))), vocabulary, key, text, ("edits",)),
                        vocabulary, key, text, state=False)
    return edited.select(key, "tokens_before", "n_edits", "n_encoded", "n_tokens")
