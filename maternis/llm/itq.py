"""Operator 9: near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

An orthogonal rotation of the principal axes is learned so that the signs of
the rotated coordinates make balanced binary codes with little quantisation
error (fitted on at most ``SAMPLE`` vectors, the lowest hashes of the id; every
vector is coded). Each length of vector has its own rotation; a length too rare
in the sample is coded by seeded directions. The code is cut into ``TABLES``
substrings; vectors of one label and length that agree in a whole substring meet
in that table's bucket. Those whose whole codes are within ``RADIUS`` are reranked
with the original vectors: cosine in double precision >= ``COSINE``.

A pair at cosine 0.98 differs in a bit with probability 0.064, agrees in an
8-bit substring with 0.59, and meets in none of 8 tables with 8e-4; nearer pairs
are lost less. A pair is counted in the first table where it meets. Buckets are
compared block against block, and a group of blocks gives one row a vector (its
links and its component there), never the pairs, so a group of thousands of
near copies stays in bounds.

Defined results: vectors that are null, zero, or hold null or non-finite numbers,
and rows with a null label or id, link with nothing; such a row is its own
component. Vectors of different lengths do not link. Repeated rows (same id,
label and vector) count once and have equal results; rows of one id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_rows, written
from .components import components

COSINE = 0.98
TABLES = 8
SAMPLE = 10_000
TURNS = 50
#: Members of a block of a bucket.
BLOCK = 512
#: Greatest Hamming distance of codes that is reranked: at cosine 0.98 a bit differs with probability 0.064, and
#: more than 20 of 64 do with less than 1e-9.
RADIUS = 20
#: Rows of a block, and pairs, that are compared at a time; share of candidates from which all pairs are multiplied.
RERANK, STEP, DENSE = 64, 4096, 0.1


def usable(vector: list | None) -> np.ndarray | None:
    """The vector at unit length, or None."""
    if vector is None or not len(vector) or any(v is None for v in vector):
        return None
    x = np.asarray(vector, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def learn_rotation(x: np.ndarray, turns: int = TURNS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of the codes: sign((v - mean) @ projection)."""
    mean = x.mean(0)
    bits = min(64, x.shape[1])
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    main = axes[:, ::-1][:, :bits]  # the axes of most variance first
    v = (x - mean) @ main
    r = np.linalg.qr(np.random.default_rng(9).normal(size=(bits, bits)))[0]
    for _ in range(turns):
        code = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(code.T @ v)
        r = (u @ w).T
    return mean, main @ r


Rotations = dict[int, tuple[np.ndarray, np.ndarray]]


def fit_rotations(vectors: DataFrame, key: str, vector: str, sample: int = SAMPLE) -> Rotations:
    """A learned rotation for each length that the sample holds at least twice as many vectors of as bits."""
    rows = bounded_sample(vectors.where(F.col(vector).isNotNull()).select(key, vector), key, sample).toPandas()
    by_length: dict[int, list[np.ndarray]] = {}
    for u in map(usable, rows[vector]):
        if u is not None:
            by_length.setdefault(len(u), []).append(u)
    out = {}
    for n, us in by_length.items():
        if len(us) >= 2 * min(64, n):
            mean, learned = learn_rotation(np.stack(us))
            out[n] = mean, np.hstack([learned, start_rotation(n)[1][:, learned.shape[1]:]])
    return out


@lru_cache(maxsize=64)
def start_rotation(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeded directions: the code of vectors of a length that is too rare to learn a rotation, and the bits that
    shorter vectors than 64 numbers lack."""
    q = np.random.default_rng(n).normal(size=(n, 64))
    return np.zeros(n), q / np.linalg.norm(q, axis=0)


def coded(vectors: DataFrame, rotations: Rotations, key: str, vector: str, label: str) -> DataFrame:
    """``id, label, code, unit`` of the usable vectors: eight substrings, and the unit vector's doubles.

    The label is one of label and length, as vectors of different lengths have no cosine."""
    shared = vectors.sparkSession.sparkContext.broadcast(rotations)  # 64 directions a length that the sample holds

    def rows(columns: list[list]) -> Iterator[tuple]:
        for k, y, v in zip(*columns):
            u = usable(v)
            if u is not None:
                mean, projection = shared.value.get(len(u)) or start_rotation(len(u))
                yield k, f"{len(u)}:{y}", np.packbits((u - mean) @ projection >= 0).tobytes(), u.tobytes()
    known = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull())
    return map_rows(known.select(F.col(key).cast("bigint"), F.col(label).cast("string"), F.col(vector)), rows,
                    "id bigint, label string, code binary, unit binary")


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest place reachable by the links, for each of n places."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked_in_blocks(group: pd.DataFrame) -> pd.DataFrame:
    """One row a vector with links: those first met in this table, and the smallest id of its component here."""
    group = group.sort_values("id", kind="stable").reset_index(drop=True)
    ids, block = group["id"].to_numpy(), group["block"].to_numpy()
    unit = np.stack([np.frombuffer(u, np.float64) for u in group["unit"]])
    code = np.stack([np.frombuffer(c, np.uint8) for c in group["code"]])
    lo, hi, table = group["lo"].iloc[0], group["hi"].iloc[0], group["table"].iloc[0]
    first, second = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    word = code.view(np.uint64)[:, 0]
    found = []
    for at in range(0, len(first), RERANK):  # the candidates within the radius, then their original vectors
        rows = first[at:at + RERANK]
        close = np.bitwise_count(word[rows][:, None] ^ word[second]) <= RADIUS
        if close.mean() > DENSE:  # a group of near copies: all products at once are cheaper
            a, b = np.nonzero(close & (unit[rows] @ unit[second].T >= COSINE))
            a, b = rows[a], second[b]
        else:
            a, b = np.nonzero(close)
            a, b = rows[a], second[b]
            near = np.concatenate([np.einsum("ij,ij->i", unit[a[k:k + STEP]], unit[b[k:k + STEP]]) >= COSINE
                                   for k in range(0, len(a), STEP)] or [np.empty(0, bool)])
            a, b = a[near], b[near]
        own = (ids[a] != ids[b]) & ((a < b) | (lo != hi))
        found.append((a[own], b[own]))
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
    new = (code[a] == code[b]).argmax(1) == table
    links = np.bincount(a[new], minlength=len(ids)) + np.bincount(b[new], minlength=len(ids))
    root = local_components(a, b, len(ids))
    some = np.zeros(len(ids), bool)
    some[a] = some[b] = True
    return pd.DataFrame({"id": ids[some], "links": links[some], "root": ids[root[some]]})


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key, n_links, component_id, kept`` of every row."""
    rows = vectors.select(F.col(key))
    codes = written(coded(vectors, fit_rotations(vectors, key, vector), key, vector, label).distinct(), "codes")
    bucket = ["label", "table", "part"]
    met = codes.withColumn("table", F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1)))).withColumn(
        "part", F.substring(F.col("code"), F.col("table") + 1, F.lit(1)))
    sizes = met.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(
        *bucket, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    met = met.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("table", "id"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    found = written(met.select(*bucket, "lo", "hi", "block", "id", "code", "unit").groupBy(*bucket, "lo", "hi").applyInPandas(
        linked_in_blocks, "id bigint, links bigint, root bigint"), "vector-links")
    links = found.groupBy(F.col("id").alias("_id")).agg(F.sum("links").alias("_links"))
    groups = components(found, "id", "root").select(F.col("node").alias("_node"), "component")
    out = rows.join(links, rows[key] == links["_id"], "left").join(groups, F.col(key) == F.col("_node"), "left")
    component = F.coalesce(F.col("component"), F.col(key).cast("bigint"))
    return out.select(key, F.coalesce(F.col("_links"), F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col(key) == component, F.lit(True)).alias("kept"))
