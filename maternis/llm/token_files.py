"""Operator 1: token-id files with Re-Pair grammar compression.

Documents are range-partitioned and sorted by id, encoded with the tokenizers
library (``pieces``: each distinct piece of text once), ended by ``END_ID`` and cut into shards of about ``SHARD_IDS`` ids. In
each shard frequent id pairs are repeatedly replaced by nonterminals: a round
counts all pairs, takes every pair at least as frequent as the round's threshold,
and replaces its occurrences from left to right without overlap. The threshold
starts at a quarter of the most frequent pair's count and falls by four a round
to ``MIN_PAIRS``, until such a round replaces less than 1 in 256 symbols. (Rounds of many pairs instead of one
pair at a time keep the work a few linear passes.)

A file row holds one shard: its place (``part``, ``shard``), ``n_ids``, the
documents (``doc_ids``, ``doc_lens`` in ids), ``rules`` (two unsigned 32-bit
little-endian symbols each; rule k is symbol ``base + k``), ``lens`` (expansion
length of each rule) and ``symbols``. The lengths give random access:
``decode_range`` expands only the symbols that cover the wanted ids. Rows are
written by Spark's Parquet writer, so that a lost task is simply run again.

Defined results: a null or empty text is the end id alone; rows with a null id
come first; rows with equal ids follow one another, by text; an empty table
gives an empty file. Only key and text are read; other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty
from .pieces import U4, byte_coder, text_slices

END_ID = 0
SHARD_IDS = 1 << 19
MIN_PAIRS = 4
#: Counters of a round; of pairs that share one, one is counted, the others in a later round.
BINS = 1 << 18
FILE_SCHEMA = ("part int, shard int, base int, n_ids bigint, doc_ids array<bigint>, doc_lens array<int>, "
               "rules binary, lens binary, symbols binary")


# ---------------------------------------------------------------------------
# grammar
# ---------------------------------------------------------------------------
def repair(ids: np.ndarray, base: int, min_pairs: int = MIN_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules of shape (n, 2), expansion lengths, symbols) of one shard."""
    seq = ids.astype(np.int64)
    rules: list[np.ndarray] = []
    lens = np.ones(base, np.int64)
    owner = np.zeros(BINS, np.int64)
    top, odd = len(seq), 0x9E3779B97F4A7C15
    while len(seq) > 1 and top >= min_pairs:
        pairs = (seq[:-1] << 32) | seq[1:]
        odd = (odd * 0x5851F42D4C957F2D + 2) % (1 << 64) | 1  # pairs that share a bin now won't in the next round
        bins = ((pairs.view(np.uint64) * np.uint64(odd)) >> np.uint64(64 - BINS.bit_length() + 1)).view(np.int64)
        owner[bins] = pairs
        own = owner[bins] == pairs
        n = np.bincount(bins[own], minlength=BINS)
        least = max(min_pairs, min(top, int(n.max())) // 4)
        at = np.flatnonzero(own & (n[bins] >= least))
        first = np.r_[True, np.diff(at) > 1]  # of a run of overlapping pairs
        place = np.arange(len(at))
        at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0] if len(at) else at
        kind = bins[at]
        uses = np.bincount(kind, minlength=BINS)
        twice = uses[kind] >= 2
        if not twice.any():
            if least == min_pairs:
                break
            top = least
            continue
        at, kind = at[twice], kind[twice]
        new = np.flatnonzero(uses >= 2)
        number = np.empty(BINS, np.int64)
        number[new] = np.arange(len(lens), len(lens) + len(new))
        seq[at] = number[kind]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
        top = least if least > min_pairs or len(at) > len(seq) // 256 else 0
        pair = np.stack([owner[new] >> 32, owner[new] & 0xFFFFFFFF], 1)
        rules.append(pair)
        lens = np.concatenate([lens, lens[pair].sum(1)])
    both = np.concatenate(rules) if rules else np.empty((0, 2), np.int64)
    return both.astype(U4), lens[base:].astype(U4), seq.astype(U4)


class Grammar:
    """Decoder of one shard."""

    def __init__(self, rules: bytes, lens: bytes, symbols: bytes, base: int):
        pairs = np.frombuffer(rules, U4).reshape(-1, 2).astype(np.int64)
        self.lens = np.concatenate([np.ones(base, np.int64), np.frombuffer(lens, U4)])
        self.symbols = np.frombuffer(symbols, U4).astype(np.int64)
        self.ends = np.cumsum(self.lens[self.symbols])
        own = np.arange(base, base + len(pairs))
        while (deep := own >= base).any():  # each rule's ids, one after another
            size = 1 + deep
            at = np.cumsum(size) - size
            out = np.empty(size.sum(), np.int64)
            out[at] = np.where(deep, pairs[np.where(deep, own - base, 0), 0] if len(pairs) else 0, own)
            out[at[deep] + 1] = pairs[own[deep] - base, 1]
            own = out
        self.flat = np.concatenate([np.arange(base), own])
        self.offset = np.cumsum(self.lens) - self.lens

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.lens[symbols]
        shift = self.offset[symbols] - (np.cumsum(size) - size)
        return self.flat[np.repeat(shift, size) + np.arange(size.sum())].astype(U4)

    def decode_range(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the shard; only the symbols that cover them are expanded."""
        if stop <= start:
            return np.empty(0, U4)
        a, b = np.searchsorted(self.ends, [start, stop - 1], "right")
        before = int(self.ends[a - 1]) if a else 0
        return self.expand(self.symbols[a:b + 1])[start - before:stop - before]


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------
def _shards(path: str, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, shard = byte_coder(path), TaskContext.get().partitionId(), 0
        base, end = coder.encode_pieces.base, np.array([END_ID], U4)
        keys: list[int | None] = []
        sizes: list[int] = []
        coded: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, total
            ids = np.concatenate(coded)
            rules, lens, symbols = repair(ids, base)
            row = [part, shard, base, len(ids), keys, sizes, rules.tobytes(), lens.tobytes(),
                   symbols.tobytes()]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()),
                     pa.binary(), pa.binary(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array([list(v) if isinstance(v, list) else v], t)
                                              for v, t in zip(row, types)],
                                             names=[c.split()[0] for c in FILE_SCHEMA.split(", ")])
            keys.clear(), sizes.clear(), coded.clear()
            shard, total = shard + 1, 0
            return out

        for batch in batches:
            for piece in text_slices(batch, 1):
                ids, ends = coder.encode(piece.column(1))
                for key, a, b in zip(piece.column(0).to_pylist(), [0, *ends.tolist()], ends.tolist()):
                    keys.append(key)
                    coded += (ids[a:b], end)
                    sizes.append(b - a + 1)
                    total += sizes[-1]
                    if total >= shard_ids:
                        yield flush()
        if keys:
            yield flush()
    return run


def write_token_files(docs: DataFrame, vocabulary: str, out: str, key: str = "doc_id", text: str = "text",
                      shard_ids: int = SHARD_IDS) -> None:
    """Write the compressed shards of all documents, in ascending key order, under ``out``."""
    (docs.select(F.col(key).cast("bigint").alias("k"), text_or_empty(text).alias("t"))
     .repartitionByRange("k").sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
     .mapInArrow(_shards(vocabulary, shard_ids), FILE_SCHEMA)
     .write.option("compression", "zstd").parquet(out))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, shard, base, _, keys, sizes, rules, lens, symbols = (
                    c.to_pylist()[0] for c in batch.slice(row, 1).columns)
                grammar = Grammar(rules, lens, symbols, base)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                ids = grammar.expand(grammar.symbols)
                each = [ids[a:b] for a, b in zip(starts, ends)]
                columns = {"part": pa.array([part] * len(keys), pa.int32()),
                           "shard": pa.array([shard] * len(keys), pa.int32()),
                           "doc_id": pa.array(keys, pa.int64()), "at": pa.array(starts, pa.int64()),
                           "n_tokens": pa.array(sizes, pa.int64()),
                           "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)
    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document in the files.

    ``start`` is a prefix sum in two levels: shards within a part, then parts.
    """
    shards = read_shards(spark, path)
    sizes = shards.select("part", "shard", "n_ids")
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select(
        "part", (F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).alias("part_start"))
    starts = sizes.select("part", "shard", before.alias("shard_start")).join(parts, "part")
    rows = shards.mapInArrow(_documents(with_ids),
                             "part int, shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
                             + ", ids array<int>" * with_ids)
    return rows.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("part_start") + F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
        *["ids"] * with_ids)


def read_range(shards: DataFrame, part: int, shard: int, start: int, stop: int) -> DataFrame:
    """Random access: the ids [start, stop) of one shard as ``pos, id`` rows."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = Grammar(row["rules"], row["lens"], row["symbols"], row["base"]).decode_range(
                    start, min(stop, row["n_ids"]))
                yield pa.RecordBatch.from_pydict({"pos": pa.array(np.arange(start, start + len(ids)), pa.int64()),
                                                  "id": pa.array(ids.astype(np.int32), pa.int32())})
    wanted = shards.where((F.col("part") == part) & (F.col("shard") == shard))
    return wanted.mapInArrow(run, "pos bigint, id int")
