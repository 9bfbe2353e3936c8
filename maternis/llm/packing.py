"""Operator 11: best-fit packing, improved by a swap-based local search.

Every whole text is encoded with the word vocabulary (``pieces``) and ended by
``END_ID``; a longer one than ``CAPACITY`` is cut into pieces of ``CAPACITY`` ids,
the last of which may be shorter. The ids are written as little-endian unsigned
32-bit integers, one row a piece. Only lengths are packed.

A task packs a shard of pieces, dealt by hash: best fit in descending length, then
a local search between the bins that are not full. A bin takes documents from an
emptier bin: it receives one (move), exchanges one for a longer one (one for
one), one for two or two for one. Each exchange moves ids from an emptier to a
fuller bin, so the sum of the squared fills rises, and bins run empty. The search
ends when a round finds no exchange, when ``IDLE_ROUNDS`` rounds emptied no bin, or
when the shard has as few bins as its total allows. The emptiest bins of ``FAN_IN`` shards are then opened and packed again
together, level by level, until one group is left, so that what does not fit is
left over once and not once a shard.

Defined results: a null or empty text is one piece of the end id alone. Every row
is packed; rows with equal or null ids are packed each for itself (``uid`` tells
them apart). Ties between bins and documents are broken by their numbers, so a
repeated task gives the same bins. An empty table gives an empty result. Only key
and text are read; other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .pieces import U4, text_slices, word_coder

CAPACITY = 4096
END_ID = 1
#: Pieces that a task packs.
SHARD_PIECES = 50_000
#: Shards whose emptiest bins are packed again together.
FAN_IN = 500
#: Bins of a shard that are opened again: the emptiest one of this many, one at least.
OPEN_OF = 1_000
#: Bins that a round of the search tries to empty, documents of a bin up to which their pairs are tried,
#: and rounds in a row after which a search that empties no bin ends.
POOL, PAIR_ITEMS, IDLE_ROUNDS = 64, 40, 3
#: Bit positions of ``sequence_id``: level, group, bin.
LEVEL_BIT, GROUP_BIT = 58, 28

PIECE_SCHEMA = "uid bigint, doc_id bigint, piece int, start bigint, length int, ids binary"


# ---------------------------------------------------------------------------
# encoding
# ---------------------------------------------------------------------------
def piece_rows(keys: list, ids: np.ndarray, ends: np.ndarray, capacity: int) -> Iterator[tuple]:
    """(key, piece, start, length, ids) of each text, its end id included."""
    out = np.full(len(ids) + len(keys), END_ID, U4)
    sizes = np.diff(ends, prepend=0) + 1
    to = np.cumsum(sizes)
    keep = np.ones(len(out), bool)
    keep[to - 1] = False
    out[keep] = ids
    raw = out.tobytes()
    for key, a, b in zip(keys, (to - sizes).tolist(), to.tolist()):
        for piece, at in enumerate(range(a, b, capacity)):
            stop = min(at + capacity, b)
            yield key, piece, at - a, stop - at, raw[4 * at:4 * stop]


def encoded_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """``uid, doc_id, piece, start, length, ids`` of every piece of every text.

    ``uid`` counts the rows of a partition; write the result before it is used, so that it is fixed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, uid = word_coder(vocabulary), TaskContext.get().partitionId() << 36
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            for part in text_slices(batch, 1):
                rows = list(zip(*piece_rows(part.column(0).to_pylist(), *coder.encode(part.column(1)), capacity)))
                n = len(rows[0])
                columns = [range(uid, uid + n), *rows]
                uid += n
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                                 names=[c.split()[0] for c in PIECE_SCHEMA.split(", ")])
    return docs.select(F.col(key).cast("bigint").alias("k"), text_or_empty(text).alias("t")).mapInArrow(run, PIECE_SCHEMA)


# ---------------------------------------------------------------------------
# packing of one shard
# ---------------------------------------------------------------------------
def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of item numbers) by best fit in descending length."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []  # the gaps that some bin has, ascending
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[item]
        at = bisect_left(gaps, need)
        if at < len(gaps):
            gap = gaps[at]
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                del gaps[at]
            bins[b].append(item)
        else:
            gap, b = capacity, len(bins)
            bins.append([item])
        if gap := gap - need:
            if not by_gap[gap]:
                insort(gaps, gap)
            by_gap[gap].append(b)
    return bins


class Search:
    """Exchanges that move ids from the emptiest bins of a shard to its other bins that are not full.

    A round takes the ``POOL`` emptiest bins as sources. Their documents, and the pairs of documents of
    a source, are sorted by length, so each other bin finds its best exchange by bisection."""

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.n, self.capacity = lengths, capacity
        self.bins = [list(b) for b in bins]
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.home = {i: b for b, items in enumerate(bins) for i in items}
        self.least = -(-sum(self.fill) // capacity)
        self.used = len(bins)

    def open_bins(self) -> list[int]:
        """Bins that are neither empty nor full, the emptiest first."""
        return sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda b: (self.fill[b], b))

    def start_round(self, sources: list[int]) -> None:
        n = self.n
        self.single = sorted((n[i], i) for b in sources for i in self.bins[b])
        self.pairs = sorted((n[i] + n[j], i, j) for b in sources if len(self.bins[b]) <= PAIR_ITEMS
                            for i, j in combinations(sorted(self.bins[b]), 2))
        self.sources = set(sources)

    def longest(self, table: list[tuple], limit: int, above: int, b: int) -> tuple | None:
        """The greatest entry in (above, limit] that lies whole in one source which is not fuller than bin ``b``."""
        at = bisect_right(table, (limit, len(self.n))) - 1
        while at >= 0 and table[at][0] > above:
            homes = {self.home[i] for i in table[at][1:]}
            a = homes.pop()
            if not homes and a != b and a in self.sources and self.fill[a] <= self.fill[b]:
                return table[at]
            at -= 1
        return None

    def exchange(self, b: int) -> bool:
        """The best exchange that bin ``b`` can make with a source; its documents change places at once."""
        n, gap = self.n, self.capacity - self.fill[b]
        best, give, take = 0, (), ()

        def offer(given: tuple, tables: tuple) -> None:
            nonlocal best, give, take
            out = sum(n[i] for i in given)
            for table in tables:
                if best < gap and (found := self.longest(table, out + gap, out + best, b)):
                    best, give, take = found[0] - out, given, found[1:]

        offer((), (self.single,))  # move
        items = list({n[i]: i for i in self.bins[b]}.values())  # one document of each length
        for i in items:
            if best < gap:
                offer((i,), (self.single, self.pairs))  # one for one, two for one
        if best < gap and len(self.bins[b]) <= PAIR_ITEMS:
            pairs = {n[i] + n[j]: (i, j) for i, j in combinations(self.bins[b], 2)}
            for pair in pairs.values():
                if best < gap:
                    offer(pair, (self.single,))  # one for two
        if not best:
            return False
        a = self.home[take[0]]
        for moved, x, y in ((take, a, b), (give, b, a)):
            for i in moved:
                self.bins[x].remove(i)
                self.bins[y].append(i)
                self.home[i] = y
                self.fill[x] -= n[i]
                self.fill[y] += n[i]
        for i in take:
            if b not in self.sources:
                del self.single[bisect_left(self.single, (n[i], i))]
        for i in give:
            if b not in self.sources:
                insort(self.single, (n[i], i))
        self.used -= not self.bins[a]
        return True

    def run(self) -> list[list[int]]:
        idle = 0
        while self.used > self.least and idle < IDLE_ROUNDS:
            bins, before, moves = self.open_bins(), self.used, 0
            sources = bins[:min(POOL, self.used - self.least + 1)]
            self.start_round(sources)
            for b in [*reversed(bins[len(sources):]), *reversed(sources)]:  # the fullest first
                while self.used > self.least and 0 < self.fill[b] < self.capacity and self.exchange(b):
                    moves += 1
            idle = 0 if self.used < before else idle + 1
            if not moves:
                break
        return [b for b in self.bins if b]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins (lists of item numbers) of at most ``capacity``."""
    return Search(lengths, best_fit(lengths, capacity), capacity).run()


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------
def _pack_group(level: int, last: bool, capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid").reset_index(drop=True)
        lengths, g = group["length"].tolist(), int(group["g"].iloc[0])
        bins = pack(lengths, capacity)
        fill = [sum(lengths[i] for i in b) for b in bins]
        n_open = 0 if last else max(1, len(bins) // OPEN_OF)
        opened = set(sorted(range(len(bins)), key=lambda b: (fill[b], b))[:n_open])
        sequence, offset = np.empty(len(group), np.int64), np.empty(len(group), np.int32)
        is_open = np.zeros(len(group), bool)
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i], is_open[i] = level << LEVEL_BIT | g << GROUP_BIT | b, at, b in opened
                at += lengths[i]
        return pd.DataFrame({"uid": group["uid"], "length": group["length"], "g": group["g"], "sequence_id": sequence,
                             "offset": offset, "open": is_open})
    return run


def placed(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, fan_in: int = FAN_IN) -> DataFrame:
    """``uid, sequence_id, offset`` of every piece (``uid, length``)."""
    full = pieces.where(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).alias("offset"))
    rest = pieces.where(F.col("length") < capacity).select("uid", "length")
    groups = -(-rest.count() // shard_pieces)
    rest = rest.withColumn("g", F.pmod(F.xxhash64("uid"), F.lit(max(groups, 1))))
    out, level = full, 1
    while groups:
        # a level is written: its open bins are read again by the next one
        done = written(rest.groupBy("g").applyInPandas(
            _pack_group(level, groups == 1, capacity),
            "uid bigint, length int, g bigint, sequence_id bigint, offset int, open boolean"), "packed")
        out = out.unionByName(done.where("not open").select("uid", "sequence_id", "offset"))
        if groups == 1:
            break
        rest = done.where("open").select("uid", "length", F.floor(F.col("g") / fan_in).alias("g"))
        groups, level = -(-groups // fan_in), level + 1
    return out


def packed_documents(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES,
                     fan_in: int = FAN_IN) -> DataFrame:
    """The written pieces with their place: all columns of ``pieces``, ``sequence_id``, ``offset``."""
    return pieces.join(placed(pieces, capacity, shard_pieces, fan_in), "uid")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids, doc_ids, lengths``: the packed sequences, each at most the capacity long."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    return packed.groupBy("sequence_id").agg(rows.alias("r")).select(
        "sequence_id", F.aggregate("r.length", F.lit(0), lambda a, x: a + x).alias("length"),
        F.aggregate("r.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"),
        F.col("r.doc_id").alias("doc_ids"), F.col("r.length").alias("lengths"))
