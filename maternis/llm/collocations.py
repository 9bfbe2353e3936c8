"""Operator 13: phrase collocations by SON partitioning.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\n-\\r]`` and pieces into
words. A phrase is up to ``MAX_WORDS`` words in a row within a piece. Everything is
counted per language.

First pass (mining): documents are dealt to ``SHARDS`` shards. Each shard is mined
completely, level by level, at the support lowered in proportion to its share of
the language's words: a phrase with ``MIN_COUNT`` occurrences in all has at least that
share of them in some shard. Words and pairs of words come first; a longer phrase
is counted only where both phrases that it extends may be locally frequent. Phrases
are named by 64-bit hashes here, and what is locally frequent is the union over
shards, so two phrases of one name can only add candidates, never lose one.

Second pass (counting): all occurrences of candidates are counted over the whole
data by their words, exactly, and those below ``MIN_COUNT`` fall away. Candidates are
held in the tasks as a bit map of ``FILTER_BITS`` bits whatever the data's size; where it
lets other phrases through they are counted and fall away too.

Occurrences are counted in Arrow columns a slice of texts at a time, so a phrase
costs a shuffled row a slice and no task gathers a phrase, a language or a shard.
Two languages of one hash share a support in the first pass; that too only adds candidates.

Defined results: a null or empty text has no words; a null language is ``und``;
repeated rows count again; phrases of equal score and count are ordered by their
bytes; equal cuts go to the first; texts of any length are counted whole; an empty
table gives an empty result. Only text and language are read; other columns may have any
name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .pieces import byte_strings, text_bytes

MIN_COUNT, MAX_WORDS, TOP, CONTAINED_PERCENT, SCALE = 10, 3, 2000, 50, 1_000_000
#: Shards: the local support of equal shards is MIN_COUNT / SHARDS, rounded up.
SHARDS = 3
#: Size of the candidates' bit map in every task (16 MB).
FILTER_BITS = 27
SLICE_BYTES = 8 << 20
#: Rows that a language's ranking takes from each of its parts are TOP; this many parts.
RANK_PARTS = 64
#: Parts of a word's counts, which many candidates ask for.
WORD_SALTS = 16
U8 = np.uint64
#: Key of a mined row: hash of the language, then the shard, then the phrase's size.
SHARD_BIT, LANG_BIT = 6, 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_GAP = _CUT.copy()
_GAP[[0x20, 0x09]] = True


# ---------------------------------------------------------------------------
# phrases of a slice
# ---------------------------------------------------------------------------
class Slice:
    """The words of texts: their kinds, the kind of each occurrence, and which start a piece."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        lo, hi = int(offsets[0]), int(offsets[-1])
        d = _LOWER[data[lo:hi]]
        gap = _GAP[d]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]] - lo  # of texts that are not empty
        edge = np.empty(len(d), bool)
        edge[:1], edge[1:] = ~gap[:1], gap[:-1] & ~gap[1:]
        edge[begins] = ~gap[begins]
        start = np.flatnonzero(edge)
        # a word ends at the next gap or the next text
        stop_at = gap.copy()
        stop_at[begins] = True
        stops = np.append(np.flatnonzero(stop_at), len(d))
        stop = stops[np.searchsorted(stops, start, "right")]
        bounds = np.empty(2 * len(start) + 1, np.int32)
        bounds[0:-1:2], bounds[1::2] = start, stop
        bounds[-1] = len(d)
        both = pa.Array.from_buffers(pa.binary(), 2 * len(start), [None, pa.py_buffer(bounds), pa.py_buffer(d)])
        words = both.take(pa.array(np.arange(0, 2 * len(start), 2))).dictionary_encode()
        self.kinds = words.dictionary
        self.word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # pieces: words with a cut or a text's border between them are in different ones
        cut = np.cumsum(_CUT[d])
        piece = cut[start] if len(start) else start
        text = np.searchsorted(begins, start, "right")
        self.names: np.ndarray | None = None
        self.first = np.ones(len(start), bool)
        if len(start):
            self.first[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])

    def places(self, size: int) -> np.ndarray:
        """Where a phrase of ``size`` words starts."""
        n = len(self.word)
        inside = np.ones(max(n - size + 1, 0), bool)
        for k in range(1, size):
            inside &= ~self.first[k:n - size + 1 + k]
        return np.flatnonzero(inside)

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        """64-bit names of the phrases of ``size`` words at ``at``."""
        if self.names is None:
            kinds = np.fromiter(map(xxhash.xxh3_64_intdigest, byte_strings(self.kinds)), U8, len(self.kinds))
            self.names = kinds[self.word]
        out = np.full(len(at), size, U8)
        for k in range(size):
            out = (out ^ self.names[at + k]) * U8(0x9E3779B97F4A7C15)
            out ^= out >> U8(29)
        return out

    def distinct(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(a place of each distinct phrase of ``size`` words, its count) among the phrases at ``at``, by the words."""
        name = self.word[at]
        for k in range(1, size):  # numbered anew, so that names stay small and exact
            if k > 1:
                name = np.unique(name, return_inverse=True)[1]
            name = name * len(self.kinds) + self.word[at + k]
        _, first, count = np.unique(name, return_index=True, return_counts=True)
        return at[first], count

    def strings(self, at: np.ndarray, size: int) -> pa.Array:
        """The phrases of ``size`` words at ``at``, joined by one blank."""
        words = [pc.take(self.kinds, pa.array(self.word[at + k])) for k in range(size)]
        joined = words[0] if size == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary()))
        return joined.cast(pa.string())


def bit_at(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U8(64 - FILTER_BITS)).astype(np.int64)


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = bit_at(hashes)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Slice]]:
    """Slices of ``lang, t``: texts of one language, SLICE_BYTES together, a longer text in parts that end at a cut."""
    waiting: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}

    def cut(lang: str) -> Iterator[tuple[str, Slice]]:
        texts = pa.concat_arrays(waiting.pop(lang))
        size.pop(lang)
        offsets, data, _ = text_bytes(texts)
        at, end = 0, len(texts)
        while at < end:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            part = offsets[at:to + 1]
            if to == at + 1 and part[1] - part[0] > 2 * SLICE_BYTES:
                places = part[0] + np.flatnonzero(_CUT[data[part[0]:part[1]]])
                ends = [part[0]]
                for place in places[np.searchsorted(places, np.arange(part[0] + SLICE_BYTES, part[1], SLICE_BYTES))
                                    .clip(max=len(places) - 1)] if len(places) else []:
                    if place > ends[-1]:
                        ends.append(place)
                for a, b in zip(ends, [*ends[1:], part[1]]):
                    yield lang, Slice(np.array([a, b]), data)
            else:
                yield lang, Slice(part, data)
            at = to

    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(1).filter(pc.equal(langs.indices, k)).cast(pa.string())
            waiting.setdefault(lang, []).append(texts)
            size[lang] = size.get(lang, 0) + pc.sum(pc.binary_length(texts)).as_py()
            if size[lang] >= SLICE_BYTES or sum(size.values()) >= 2 * SLICE_BYTES:
                for full in [lang] if size[lang] >= SLICE_BYTES else list(waiting):
                    yield from cut(full)
    for lang in list(waiting):
        yield from cut(lang)


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------
def dealt(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang, t`` of every row."""
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("t"))


def _mine(sizes: tuple[int, ...], shards: int, bits):
    """Counts of the phrases of a shard by hash (size 0: of its words); of longer phrases only those whose
    two shorter ones may be frequent (``bits``, a broadcast map)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        for lang, part in slices(batches):
            group = (xxhash.xxh3_64_intdigest(lang) >> 20 << LANG_BIT) + (shard << SHARD_BIT)
            yield _mined(group, 0, np.zeros(1, U8), np.array([len(part.word)]))
            for size in sizes:
                at = part.places(size)
                if bits is not None:
                    held = np.frombuffer(bits.value, np.uint8)
                    at = at[may_hold(held, part.hashes(at, size - 1))]
                    at = at[may_hold(held, part.hashes(at + 1, size - 1))]
                names = np.sort(part.hashes(at, size))
                start = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.empty(0, np.int64)
                yield _mined(group, size, names[start], np.diff(start, append=len(names)))
            del part  # before the next slice is made
    return run


def _mined(group: int, size: int, names: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), group + size, np.int64)), pa.array(names.view(np.int64)),
                                       pa.array(n.astype(np.int64))], names=["g", "h", "n"])


def locally_frequent(texts: DataFrame, sizes: tuple[int, ...], bits, min_count: int, shards: int) -> DataFrame:
    """``h`` of the phrases that reach their shard's share of ``min_count`` in some shard."""
    mined = written(texts.mapInArrow(_mine(sizes, shards, bits), "g bigint, h bigint, n bigint")
                    .groupBy("g", "h").agg(F.sum("n").alias("n")), "mined")
    size = F.col("g").bitwiseAND((1 << SHARD_BIT) - 1)
    words = mined.where(size == 0).select(F.shiftrightunsigned("g", SHARD_BIT).alias("_shard"), F.col("n").alias("of_shard"))
    share = F.shiftrightunsigned("_shard", LANG_BIT - SHARD_BIT)
    total = words.groupBy(share.alias("_lang")).agg(F.sum("of_shard").alias("of_all"))
    support = written(words.join(total, share == F.col("_lang")).select("_shard", "of_shard", "of_all"), "support")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    return mined.where(size > 0).join(support, F.shiftrightunsigned("g", SHARD_BIT) == F.col("_shard")).where(
        exact("n") * exact("of_all") >= F.lit(min_count) * exact("of_shard")).select("h")


def bit_map(candidates: DataFrame) -> bytes:
    """The map of ``h``: 2 ** FILTER_BITS bits whatever the number of rows."""
    at = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    rows = candidates.select(F.shiftright(at, 6).alias("at"), F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int")).alias("bit")) \
        .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.tobytes()


def _count(bits, max_words: int):
    """Counts by words of the phrases that the map holds (size 0: of all words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits.value, np.uint8)
        for lang, part in slices(batches):
            yield _counted(lang, 0, pa.array([""]), np.array([len(part.word)]))
            for size in range(1, max_words + 1):
                at = part.places(size)
                at, n = part.distinct(at[may_hold(held, part.hashes(at, size))], size)
                yield _counted(lang, size, part.strings(at, size), n)
            del part
    return run


def _counted(lang: str, size: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang]).take(pa.array(np.zeros(len(n), np.int64))), pa.array(np.full(len(n), size, np.int32)), phrases,
         pa.array(n.astype(np.int64))], names=["lang", "size", "phrase", "n"])


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                     max_words: int = MAX_WORDS, shards: int = SHARDS) -> DataFrame:
    """``lang, size, phrase, f`` of all phrases of up to ``max_words`` words with ``min_count`` occurrences
    in their language, exactly; size 0 is the number of words of the language."""
    texts, context = dealt(docs, text, lang), docs.sparkSession.sparkContext
    candidates = written(locally_frequent(texts, (1, 2), None, min_count, shards), "candidates")
    last = candidates
    for size in range(3, max_words + 1):
        last = written(locally_frequent(texts, (size,), context.broadcast(bit_map(last)), min_count, shards), "candidates")
        candidates = candidates.unionAll(last)
    counts = texts.mapInArrow(_count(context.broadcast(bit_map(candidates)), max_words),
                              "lang string, size int, phrase string, n bigint")
    return counts.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).where(
        (F.col("f") >= min_count) | (F.col("size") == 0))


def scored(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the phrases of two words and more, by their lowest-scoring cut."""
    salt = lambda part: F.when(F.instr(part, " ") == 0, F.pmod(F.xxhash64("phrase"), F.lit(WORD_SALTS)).cast("int")).otherwise(0)
    # the counts of single words are asked for by many phrases: each of their copies serves a part of those
    parts = phrases.where("size > 0").select("lang", F.col("phrase").alias("part"), "f", F.explode(
        F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(WORD_SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    words = F.split("phrase", " ", -1)
    cuts = phrases.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), F.explode(
        F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), words.alias("w"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        of = parts.select("lang", F.col("part").alias(side), F.col("salt").alias("_salt"), F.col("f").alias(name))
        cuts = cuts.withColumn("_salt", salt(side)).join(of, ["lang", side, "_salt"]).drop("_salt")
    d = {c: f"cast({c} as decimal(18,0))" for c in "alr"}
    score = F.expr(f"cast({SCALE} as decimal(7,0)) * {d['a']} * {d['a']} div ({d['l']} * {d['r']})")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def contained(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, longest``: the highest count of a phrase with one word more around ``phrase``
    (any longer one is no more frequent than that)."""
    w = F.split("phrase", " ", -1)
    inner = phrases.where("size > 2").select("lang", "f", F.explode(F.array(
        F.array_join(F.slice(w, 1, F.col("size") - 1), " "), F.array_join(F.slice(w, 2, F.col("size") - 1), " "))).alias("phrase"))
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def first_of(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language, with their ``rank``: ranked in parts, then the parts' first rows."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    parts = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    for by in (["lang", "_part"], ["lang"]):
        parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).where(
            F.col("rank") <= top)
    return parts


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases."""
    phrases = written(frequent_phrases(docs, text, lang, min_count, max_words, shards), "phrases")
    kept = scored(phrases).join(contained(phrases), ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (100 * F.col("longest") < CONTAINED_PERCENT * F.col("a")))
    n = phrases.where("size = 0").select("lang", F.col("f").alias("n"))
    return first_of(kept, top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
