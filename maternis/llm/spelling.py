"""Operator 12: spelling variants by a dictionary of trie-node pairs.

Words are the runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, A-Z in lower case;
the query's contract takes one code point out of some of them (``altered``). The
distinct words are sorted over range partitions and each partition numbers the
nodes of their forward trie: a word takes over the nodes of the prefix that it
shares with the word before it and numbers the rest. Where a partition goes on in
the trie of the one before, its first nodes are renamed to those of that one
(one row a partition goes through the driver). The reversed words give the nodes
of the suffixes likewise. A word of m code points then has the pairs
(prefix node i, suffix node m-1-i), which skip position i, and (prefix node i,
suffix node m-i), which split it there. Words that share a skip pair differ by one
replaced code point; a skip pair of one word that is a split pair of another one is
an inserted code point (of equal code points in a row the first is taken, so each
pair of words is found once). The neighbours are exact; a pair of nodes is shared
by no more words than the alphabet has letters, and one.

The number of a word's last prefix node is its id; ids are in code-point order.
A form has at least ``RATIO`` times the count, so chains of forms are short and are
followed by doubling.

Defined results: a null or empty text has no words; a row with a null id counts
with an empty id in the contract's digest; repeated rows count again; words of any
length are compared whole; ties of n go to the smallest word; an empty table gives
an empty result. Only key and text are read; other columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Of this many runs about one loses a code point in the contract.
ALTERED_OF = 31
#: Entries of a task's word counts before they are handed on.
COUNT_ENTRIES = 300_000
#: Code points of the words that a task numbers.
PART_CHARS = 2_000_000
PART_BIT = 40


# ---------------------------------------------------------------------------
# words
# ---------------------------------------------------------------------------
def altered(doc_id, run: str, prefix: int) -> str:
    """The contract's word of a lower-case run; ``prefix`` is the crc32 of ``<doc_id>:``."""
    h = crc32(run.encode("utf-8"), prefix)
    if h % ALTERED_OF:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def plain(doc_id, run: str, prefix: int) -> str:
    return run


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", word_of: Callable = plain,
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words of at least ``min_length`` code points that occur ``min_count`` times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile("[a-zÀ-ÿ]{%d,}" % min_length)
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                              pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for key_, text_ in zip(batch.column(0), batch.column(1)):
                found = Counter(runs.findall(text_.as_py().encode("utf-8").lower().decode("utf-8")))
                k = key_.as_py()
                prefix = crc32(f"{'' if k is None else k}:".encode())
                for r, n in found.items():
                    word = word_of(k, r, prefix)
                    if len(word) >= min_length:
                        counts[word] += n
                if len(counts) >= COUNT_ENTRIES:
                    yield flush()
        yield flush()
    parts = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---------------------------------------------------------------------------
# tries
# ---------------------------------------------------------------------------
def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


def _number(key_at: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path: list[int] = []
        last, used = "", part << PART_BIT
        for batch in batches:
            flat: list[int] = []
            sizes = []
            for word in batch.column(key_at).to_pylist():
                shared = common_prefix(last, word) if path else -1
                new = len(word) - shared
                path[shared + 1:] = range(used, used + new)
                used, last = used + new, word
                flat += path
                sizes.append(len(path))
            nodes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, nodes.cast(schema.field(batch.num_columns).type), pa.array([part] * len(sizes), pa.int32())],
                schema=schema)
    return run


def trie_nodes(words: DataFrame, key: str, out: str) -> DataFrame:
    """``words`` with the array ``out``: the trie nodes of the prefixes of ``key`` (distinct, not null), by length from 0."""
    from pyspark.sql.pandas.types import to_arrow_schema
    chars = words.agg(F.sum(F.length(key))).first()[0] or 0
    columns = words.columns
    shape = words.select("*", F.array(F.lit(0).cast("bigint")).alias(out), F.lit(0).alias("_part")).schema
    local = written(words.repartitionByRange(-(-chars // PART_CHARS) or 1, key).sortWithinPartitions(key)
                    .mapInArrow(_number(columns.index(key), to_arrow_schema(shape)), shape), "trie")
    # one row a partition: where its words go on in the trie of the partition before
    borders = local.groupBy("_part").agg(F.min(key).alias("first"), F.max(F.struct(key, out)).alias("last")).orderBy("_part")
    renames, path, last = [], None, ""
    for row in borders.collect():
        shared = -1 if path is None else common_prefix(last, row["first"])
        names = [] if path is None else path[:shared + 1]
        mine = row["_part"] << PART_BIT
        path = [names[x - mine] if 0 <= x - mine <= shared else x for x in row["last"][out]]
        last = row["last"][key]
        renames.append((row["_part"], names))
    renamed = words.sparkSession.createDataFrame(renames, "_part int, _names array<bigint>")
    mine = F.shiftleft(F.col("_part").cast("bigint"), PART_BIT)
    return local.join(F.broadcast(renamed), "_part").select(*columns, F.transform(
        out, lambda x: F.when(x - mine < F.size("_names"), F.get("_names", (x - mine).cast("int"))).otherwise(x)).alias(out))


def dictionary(words: DataFrame) -> DataFrame:
    """``id, word, n, prefixes, suffixes`` of every distinct word."""
    forward = trie_nodes(words.select("word", "n"), "word", "prefixes")
    both = trie_nodes(forward.withColumn("drow", F.reverse("word")), "drow", "suffixes")
    return both.select(F.element_at("prefixes", -1).alias("id"), "word", "n", "prefixes", "suffixes")


# ---------------------------------------------------------------------------
# pairs
# ---------------------------------------------------------------------------
SKIP, SKIP_FIRST, SPLIT = 0, 1, 2
PAIR_SCHEMA = "p bigint, s bigint, kind tinyint, id bigint, n bigint"
NEAR_SCHEMA = "a bigint, b bigint, n_a bigint, n_b bigint"


def _node_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The skip and split pairs of ``id, word, n, prefixes, suffixes``."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            ids, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            words = batch.column(1).to_pylist()
            m = np.fromiter(map(len, words), np.int64, len(words))
            chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
            p, s = (batch.column(k).flatten().to_numpy() for k in (3, 4))
            first = np.cumsum(m + 1) - (m + 1)  # of a word's nodes
            begin = np.cumsum(m) - m  # of its code points
            word = np.repeat(np.arange(len(m)), m)
            i = np.arange(len(chars)) - begin[word]
            fresh = np.r_[True, chars[1:] != chars[:-1]] if len(chars) else np.empty(0, bool)
            fresh[begin[m > 0]] = True
            owner = np.repeat(np.arange(len(m)), m + 1)
            j = np.arange(len(p)) - first[owner]
            columns = [np.concatenate([p[first[word] + i], p]),
                       np.concatenate([s[first[word] + m[word] - 1 - i], s[first[owner] + m[owner] - j]]),
                       np.concatenate([np.where(fresh, SKIP_FIRST, SKIP), np.full(len(p), SPLIT)]).astype(np.int8),
                       np.concatenate([ids[word], ids[owner]]), np.concatenate([n[word], n[owner]])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["p", "s", "kind", "id", "n"])


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of rows sorted by (p, s): every two members of a node pair that one change leads to each other."""
    rest = None
    names = ["a", "b", "n_a", "n_b"]

    def pairs(rows: list[np.ndarray]) -> pa.RecordBatch:
        p, s, kind, ids, n = rows
        found = []
        lag = 1
        while lag < len(p):
            same = (p[lag:] == p[:-lag]) & (s[lag:] == s[:-lag])
            if not same.any():
                break
            k, q = kind[lag:], kind[:-lag]
            at = np.flatnonzero(same & ((np.maximum(k, q) < SPLIT) | (np.minimum(k, q) == SKIP_FIRST)))
            found.append((ids[at], ids[at + lag], n[at], n[at + lag]))
            lag += 1
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            rows = [np.concatenate(c) for c in zip(rest, rows)]
        # the last node pair may go on in the next batch
        open_ = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])) if len(rows[0]) else []
        cut = int(open_[-1]) + 1 if len(open_) else 0
        rest = [c[cut:].copy() for c in rows]
        if cut:
            yield pairs([c[:cut] for c in rows])
    if rest is not None:
        yield pairs(rest)


def near_words(entries: DataFrame) -> DataFrame:
    """``a, b, n_a, n_b``: every two words of a dictionary that differ by one code point, once."""
    rows = entries.select("id", "word", "n", "prefixes", "suffixes").mapInArrow(_node_pairs, PAIR_SCHEMA)
    return rows.repartition("p", "s").sortWithinPartitions("p", "s").mapInArrow(_near_pairs, NEAR_SCHEMA)


def roots(forms: DataFrame) -> DataFrame:
    """``id, root`` for ``id, form``: the end of each chain, by doubling."""
    now = written(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        nxt = now.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        step = written(now.join(nxt, F.col("root") == F.col("_id"), "left").select(
            "id", F.coalesce("_root", "root").alias("root"), F.col("_id").isNotNull().alias("moved")), "roots")
        now = step.select("id", "root")
        if step.where("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every distinct word (``word, n``)."""
    entries = written(dictionary(words), "dictionary")
    near = written(near_words(entries), "near")
    sides = near.unionAll(near.select("b", "a", "n_b", "n_a"))
    best = F.max(F.when(F.col("n_b") >= ratio * F.col("n_a"), F.struct("n_b", (-F.col("b")).alias("b"))))
    found = written(sides.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")).select(
        "id", "n_near", (-F.col("best.b")).alias("form"), F.col("best.n_b").alias("form_n")), "found")
    names = entries.select(F.col("id").alias("_id"), F.col("word").alias("_word"))
    ends = roots(found.where(F.col("form").isNotNull()))
    forms = found.where(F.col("form").isNotNull()).join(names, F.col("form") == F.col("_id")).select(
        "id", F.col("_word").alias("form_word"))
    last = ends.join(names, F.col("root") == F.col("_id")).select("id", F.col("_word").alias("root_word"))
    out = entries.select("id", "word", "n").join(found.select("id", "n_near", "form_n"), "id", "left") \
        .join(forms, "id", "left").join(last, "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
                      F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", word_of: Callable = plain) -> DataFrame:
    """The variants among the words of whole texts."""
    return variants(written(word_counts(docs, key, text, word_of), "words"))
