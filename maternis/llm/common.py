"""Helpers shared by the operators: shared scratch tables and Arrow mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maternis.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet on shared storage and read again.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """One row (the least) of each of at most ``limit`` ids, those of the lowest hashes; null ids are left out.

    Rows above a hash that about ``limit`` ids lie below are dropped where they are read, and the rest is
    grouped by id, so what is sorted and sent to the driver doesn't grow with the input, however often an id repeats.
    """
    rows = rows.where(F.col(key).isNotNull())
    ids = rows.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    h = F.xxhash64(F.col(key).cast("string"))
    share = 1.2 * limit / max(ids, 1) + 1e-9
    if share < 1:
        rows = rows.where(h < F.lit(int(-(1 << 63) + share * (1 << 64))))
    rest = [c for c in rows.columns if c != key]
    once = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*")
    return once.orderBy(h, key).limit(limit)


def map_rows(df: DataFrame, rows: Callable[[list[list]], Iterable[tuple]], schema: str,
             slice_rows: int = 256) -> DataFrame:
    """Apply ``rows`` (columns as lists -> result tuples) to slices of at most
    ``slice_rows`` rows, so that memory is bounded by a slice and not by a partition."""
    arrow = pa.schema([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                out = list(rows([c.to_pylist() for c in part.columns]))
                columns = list(zip(*out)) if out else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)
