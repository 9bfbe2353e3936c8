"""Operator 5: near-duplicate documents by Order MinHash.

A text is the sequence of its ``SHINGLE``-word shingles (words are runs without
white space; a text of fewer words is one shingle). Each of ``SKETCHES``
sketches takes the ``LENGTH`` smallest hashes of the occurrence-labelled
shingles and keeps these shingles in text order, so that equal sketches need
equal order, not only equal sets. Texts that share a sketch are candidates; a
banded alignment of the two shingle sequences, of n and m shingles, verifies
them. With M shingles aligned,

    similarity = M / (n + m - M) >= ``SIMILARITY``

(the Jaccard similarity of the shingles, restricted to those in the same
order). The sets of different shingles must have that Jaccard similarity too,
so that one line repeated hundreds of times makes no texts alike.

A pair with M shingles aligned of U = n + m - M shares a given sketch with
probability C(M, LENGTH) / C(U, LENGTH), which tends to 0.8 ** 8 for long texts
of similarity 0.8 but is far less for short ones. So texts of few shingles have
further sketches of fewer shingles (``SHORT``). As neither text of a pair has
more than U shingles, both have those that U asks for. A pair of similarity 0.8
is missed with at most 1e-3, whatever its length: 3e-4 at U = 5, under 2e-5 from
6 to 40, under 1e-4 to 160, 9.2e-4 just above, 6e-4 for long texts; at 0.85 it
is 6e-6 for long texts at most.

Copies (equal word sequences) are one class and are compared once, as one node. Within a sketch's bucket every member is first compared
with one member, another one in each of ``TURNS`` turns; components are formed
after a turn. Buckets that still hold several components are then compared
whole, block against block, for pairs of different components with similar
sets, which the alignment verifies. So every link of a bucket is either
verified or lies within a component; no task holds more than two blocks, and
only similar pairs are emitted.

Defined results: one row per input row with ``class_id`` (smallest id of the
component) and ``kept`` (id = class). Null and empty texts and texts of white
space link with nothing, also not with one another. Rows with a null id link
with nothing, have a null class and are kept. A node is a sequence of words, not an
id: rows of one id with different texts are judged each by its text, and the kept
row of a class is the least by id and digest of the text (rows equal in both have
equal results; ``one_of_each`` keeps one of them). Only id and text are read; other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_or_empty, written
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 40
LENGTH = 8
#: Further sketches of texts of at most so many shingles: (shingles, sketches, length).
SHORT = ((160, 12, 6), (40, 16, 3))
#: Turns in which a bucket is compared with one of its members, before the pairs that are left.
TURNS = 2
#: Members of a block of a bucket.
BLOCK = 256

_ALL = SKETCHES + sum(sketches for _, sketches, _ in SHORT)
_MULTIPLY = (np.random.default_rng(20).integers(1 << 62, (1 << 63) - 1, _ALL, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = np.random.default_rng(21).integers(0, (1 << 63) - 1, _ALL, dtype=np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """32-bit hashes of the words, equal in every process."""
    return np.fromiter(map(xxhash.xxh32_intdigest, text.split()), np.uint32)


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit shingles of a word sequence; one for a text of fewer than SHINGLE words."""
    if not len(words):
        return np.empty(0, np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    out = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = out * _MIX[1] + words[k:k + n]
    return mix(out)


def occurrences(seq: np.ndarray) -> np.ndarray:
    """How often the element has occurred before, for each place."""
    order = np.argsort(seq, kind="stable")
    s = seq[order]
    new = np.r_[True, s[1:] != s[:-1]]
    place = np.arange(len(seq))
    out = np.empty(len(seq), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return out


def sketch_keys(seq: np.ndarray) -> np.ndarray:
    """The keys of a shingle sequence, SKETCHES and those of SHORT, as signed 64-bit numbers.

    A text of fewer shingles than a sketch's length has no such key, which only copies could share."""
    labelled = mix(seq + occurrences(seq).astype(np.uint64) * _MIX[2])
    out, first = [np.empty(0, np.uint64)], 0
    for most, sketches, take in ((len(seq), SKETCHES, LENGTH), *SHORT):
        no = np.arange(first, first + sketches)
        first += sketches
        if not take <= len(seq) <= most:
            continue
        rows = max(1, (1 << 20) // len(seq))  # bounds the memory of a very long text
        places = np.concatenate([np.argpartition(labelled * _MULTIPLY[no[i:i + rows], None] + _ADD[no[i:i + rows], None],
                                                 take - 1, axis=1)[:, :take] for i in range(0, sketches, rows)])
        places.sort(axis=1)  # text order
        keys = no.astype(np.uint64)
        for j in range(take):
            keys = mix(keys) + labelled[places[:, j]]
        out.append(mix(keys))
    return np.concatenate(out).view(np.int64)


# ---------------------------------------------------------------------------
# verification
# ---------------------------------------------------------------------------
def banded_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int:
    """Deletions and insertions that turn ``a`` into ``b`` if they are at most ``limit``, else
    ``limit`` + 1; only the band of places at most ``limit`` off the diagonal is computed."""
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    width, far = 2 * limit + 1, limit + 1
    off = np.arange(width)
    row = np.where((off >= limit) & (off - limit <= m), off - limit, far)  # place k of row i is column i + k - limit
    padded = np.concatenate([np.zeros(limit, b.dtype), b, np.zeros(width + 1, b.dtype)])
    for i in range(1, n + 1):
        column = off + (i - limit)
        inside = (column >= 1) & (column <= m)
        step = np.r_[row[1:], far] + 1  # a deletion
        step = np.where(inside & (padded[i - 1:i - 1 + width] == a[i - 1]), np.minimum(step, row), step)
        step = np.where(inside, step, np.where(column == 0, i, far))
        row = np.minimum(np.minimum.accumulate(step - off) + off, far)  # insertions
        row = np.where((column < 0) | (column > m), far, row)
        if row.min() > limit:
            return limit + 1
    return int(min(row[m - n + limit], far))


def most_edits(n, m):
    """Edits that a pair of the similarity may need: (n + m - d) / (n + m + d) >= SIMILARITY."""
    return (n + m) * (1.0 - SIMILARITY) / (1.0 + SIMILARITY) + 1e-9


def aligned(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sequences, and their sets, have at least the similarity.

    Bounds settle most pairs: elements without a partner are edits; all outside
    a common chain of elements unique in both are at most the edits. The band
    is computed for the others, so the answer is exact."""
    limit = int(most_edits(len(a), len(b)))
    if abs(len(a) - len(b)) > limit:
        return False
    one, two = np.unique(a), np.unique(b)
    common = len(np.intersect1d(one, two, assume_unique=True))
    if common < SIMILARITY * (len(one) + len(two) - common) - 1e-9:
        return False
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    head = int(apart[0]) if len(apart) else n
    a, b, n = a[head:], b[head:], n - head
    if n:
        apart = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        tail = int(apart[0]) if len(apart) else n
        a, b = a[:len(a) - tail], b[:len(b) - tail]
    if len(a) + len(b) <= limit:
        return True
    ua, fa, ca = np.unique(a, return_index=True, return_counts=True)
    ub, fb, cb = np.unique(b, return_index=True, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if len(a) + len(b) - 2 * int(np.minimum(ca[ia], cb[ib]).sum()) > limit:
        return False
    once = (ca[ia] == 1) & (cb[ib] == 1)
    places = fb[ib[once]][np.argsort(fa[ia[once]])]
    chain = int((places == np.maximum.accumulate(places)).sum()) if len(places) else 0
    if len(a) + len(b) - 2 * chain <= limit:
        return True
    return banded_distance(a, b, limit) <= limit


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------
def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, raw`` (digest of the text), ``d1, d2`` (digest of the words), ``n`` (shingles) and ``keys`` of every row;
    rows without words or id have no keys and null digests of words."""
    def rows(columns: list[list]) -> Iterator[tuple]:
        for k, raw, t in zip(*columns):
            seq = shingles(word_hashes(t)) if k is not None else ()
            if len(seq):
                d = xxhash.xxh128_intdigest(" ".join(t.split()))
                signed = [int(x) - (1 << 64) if x >> 63 else int(x) for x in (d >> 64, d & (1 << 64) - 1)]
                yield (k, raw, *signed, len(seq), sketch_keys(seq))
            else:
                yield k, raw, None, None, 0, []
    t = text_or_empty(text)
    return map_rows(docs.select(F.col(key).cast("bigint"), raw_digest(text), t), rows,
                    "id bigint, raw binary, d1 bigint, d2 bigint, n int, keys array<bigint>")


def raw_digest(text: str) -> Column:
    """Tells rows of one id apart by their texts."""
    return F.unhex(F.md5(text_or_empty(text).cast("binary")))


def near_in_length(n: str, m: str) -> Column:
    """Necessary for the similarity, and cheap."""
    return F.abs(F.col(n) - F.col(m)) <= F.floor(most_edits(F.col(n), F.col(m)))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose texts (``id, words``) align."""
    def run(columns: list[list]) -> Iterator[tuple]:
        last = last_seq = None
        for a, b, x, y in zip(*columns):
            if x != last:
                last, last_seq = x, shingles(np.frombuffer(x, np.uint32))
            if aligned(last_seq, shingles(np.frombuffer(y, np.uint32))):
                yield a, b
    left = texts.select(F.col("id").alias("a"), F.col("words").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("words").alias("y"))
    return map_rows(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y"), run, "a bigint, b bigint", 64)


def word_sequences(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``id, words`` (32-bit hashes) of the nodes ``wanted`` (id, doc, raw: the row that the node stands for)."""
    def rows(columns: list[list]) -> Iterator[tuple]:
        for k, t in zip(*columns):
            yield k, word_hashes(t).tobytes()
    texts = docs.select(F.col(key).cast("bigint").alias("doc"), raw_digest(text).alias("raw"), text_or_empty(text).alias("t"))
    one = texts.join(wanted, ["doc", "raw"]).groupBy("doc", "raw", "id").agg(F.min("t").alias("t"))
    return map_rows(one.select("id", "t"), rows, "id bigint, words binary")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_sets(group: pd.DataFrame) -> pd.DataFrame:
    """The pairs of different components in two blocks of a bucket whose sets of shingles have the similarity.

    Common shingles of all pairs are counted by products of 0/1 matrices, a slice of the shingles at a time."""
    group = group.sort_values("id").reset_index(drop=True)
    sets = [np.unique(shingles(np.frombuffer(w, np.uint32))) for w in group["words"]]
    size = np.array([len(x) for x in sets])
    kinds, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), size), often[column] > 1
    row, column = row[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [at, at + 4096])
        has = np.zeros((len(sets), 4096), np.float32)
        has[row[i:j], column[i:j] - at] = 1.0
        common += has @ has.T
    c, block = group["c"].to_numpy(), group["block"].to_numpy()
    alike = common >= SIMILARITY * (size[:, None] + size - common) - 1e-6
    lo, hi = group["lo"].iloc[0], group["hi"].iloc[0]
    across = (np.minimum(block[:, None], block) == lo) & (np.maximum(block[:, None], block) == hi)
    a, b = np.nonzero(np.triu(alike & across & (c[:, None] != c), 1))
    ids = group["id"].to_numpy()
    return pd.DataFrame({"a": ids[a], "b": ids[b]})


def pairs_in_blocks(members: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of every bucket (``k, id, c``), compared block by block: a bucket
    of any size is spread over tasks, each of about 2 * BLOCK members, and only similar pairs come out."""
    sizes = members.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "k").withColumn("block", F.pmod(F.xxhash64("k", "id"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("k", "id", "c", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return spread.join(words, "id").groupBy("k", "lo", "hi").applyInPandas(similar_sets, "a bigint, b bigint")


def mixed_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members with their present component ``c``, of buckets that hold several components."""
    placed = members.join(found, members["id"] == found["node"], "left").select(
        "k", "id", "n", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("k")
    return placed.join(mixed, "k")


def judged(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, raw, class_id, kept`` of every row: its class, and whether it is the class's first row by id and text."""
    sk = written(sketches(docs, key, text), "sketches")
    some = sk.where(F.col("d1").isNotNull())
    # a node is a sequence of words, whatever ids its rows have; its number is fixed by the written table
    one = F.min(F.struct("id", "raw", "n", "keys")).alias("r")
    nodes = written(some.groupBy("d1", "d2").agg(one).select(
        F.monotonically_increasing_id().alias("id"), "d1", "d2", F.col("r.id").alias("doc"), "r.raw", "r.n", "r.keys"), "nodes")
    keyed = nodes.select("id", "n", F.explode("keys").alias("k"))
    shared = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("k")
    rest = written(keyed.join(shared, "k").withColumn("c", F.col("id")), "members")
    wanted = nodes.select("id", "doc", "raw").join(rest.select("id").distinct(), "id", "left_semi")
    words = written(word_sequences(docs, wanted, key, text), "words")
    links = None
    for turn in range(TURNS):
        # every member against one of its bucket, another one each turn, if their components differ
        lead = rest.groupBy("k").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "k", "c").alias("h"),
                                                    F.xxhash64(F.lit(turn), "id").alias("g"), "id", "n", "c")).alias("r"))
        lead = lead.select("k", F.col("r.id").alias("b"), F.col("r.n").alias("m"), F.col("r.c").alias("d"))
        star = ordered(rest.join(lead, "k").where((F.col("c") != F.col("d")) & near_in_length("n", "m"))
                       .withColumnRenamed("id", "a"))
        found = written(verified(star, words), "links")
        links = found if links is None else links.unionAll(found)
        rest = written(mixed_buckets(rest, components(links, "a", "b")), "members")
    # and the pairs of a bucket that are still in different components
    more = written(ordered(pairs_in_blocks(rest, words)), "pairs")
    links = links.unionAll(written(verified(more, words), "links"))

    # a class is named by the least id of its rows; a node's row is its least one
    found = components(links, "a", "b").select(F.col("node").alias("_node"), "component")
    placed = nodes.select("id", "d1", "d2", "doc", "raw").join(found, F.col("id") == F.col("_node"), "left").select(
        "d1", "d2", "doc", "raw", F.coalesce("component", "id").alias("c"))
    first = placed.groupBy("c").agg(F.min(F.struct("doc", "raw")).alias("first"))
    classes = placed.join(first, "c").select("d1", "d2", "first")
    rows = some.select("id", "raw", "d1", "d2").join(classes, ["d1", "d2"]).select(
        "id", "raw", F.col("first.doc").alias("class_id"), (F.struct(F.col("id").alias("doc"), "raw") == F.col("first")).alias("kept"))
    return rows.unionByName(sk.where(F.col("d1").isNull()).select("id", "raw", F.col("id").alias("class_id"), F.lit(True).alias("kept")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, class_id, kept`` of every row."""
    return judged(docs, key, text).select(F.col("id").cast(docs.schema[key].dataType).alias(key), "class_id", "kept")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each class, and rows without id."""
    kept = judged(docs, key, text).where(F.col("kept") & F.col("id").isNotNull()).select(
        F.col("id").alias("_kept"), F.col("raw").alias("_raw")).distinct()
    rows = docs.where(F.col(key).isNotNull()).withColumn("_own", raw_digest(text))
    chosen = rows.join(kept, (rows[key].cast("bigint") == kept["_kept"]) & (rows["_own"] == kept["_raw"]), "left_semi")
    return chosen.dropDuplicates([key, "_own"]).drop("_own").unionByName(docs.where(F.col(key).isNull()))
