"""Round trips through landed and published files, on data that Spark derives from the benchmark tables.

Each query writes to a new folder under the shared checkpoint folder and reads it back the way production does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..session import ensure_checkpoint_dir
from ..sources import files
from ..sources import fixtures as FX
from ..sources.publication import Snapshot, snapshot
from ..sources.sinks import write_published_csv
from . import marts as M
from . import pipeline as P
from .classify import classify


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates landed as Parquet by file year, ten years read back: rows by file year and sex."""
    root = _folder(spark, "landed")
    FX.sim_raw(spark, sf_dir).write.partitionBy("ano_arquivo").parquet(root)
    return files.read_landed_raw(spark, root, 2015, 2024).groupBy("ano_arquivo", "sexo").agg(F.count(F.lit(1)).alias("n"))


def landed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preliminary files of two layouts, bound by their headers: rows by all raw columns and file year."""
    root = _folder(spark, "preliminary")
    raw = FX.sim_raw(spark, sf_dir).where(F.col("ano_arquivo") >= S.FIRST_PRELIMINARY_YEAR)
    out = None
    for year, columns in ((S.FIRST_PRELIMINARY_YEAR, S.RAW_COLUMNS[::-1]), (S.FIRST_PRELIMINARY_YEAR + 1, S.RAW_COLUMNS)):
        # other order and case, and columns that the pipeline doesn't read
        rows = raw.where(F.col("ano_arquivo") == year).select(
            F.lit("1").alias("ORIGEM"), *[F.col(c).alias(c.upper()) for c in columns], F.lit("x;y").alias("CB_PRE"))
        rows.write.option("sep", ";").option("header", True).csv(f"{root}/{year}")
        part = files.read_preliminary_csv(spark, f"{root}/{year}", file_year=year, schema=S.RAW_SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*S.RAW_COLUMNS, "ano_arquivo").agg(F.count(F.lit(1)).alias("n"))


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates some of which lie in the file of the year after the death."""
    late = F.coalesce(F.col("codmunres").cast("int") % 7 == 0, F.lit(False)).cast("int")
    return FX.sim_raw(spark, sf_dir).withColumn("ano_arquivo", F.col("ano_arquivo") + late)


def refresh_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official deaths of the history and the preliminary files, counted by file year and merged: a death of one
    year may come from two files."""
    inputs = P.fixture_inputs(spark, sf_dir)
    raw = _shifted(spark, sf_dir)
    parts = []
    for era in (F.col("ano_arquivo") < S.FIRST_PRELIMINARY_YEAR, F.col("ano_arquivo") >= S.FIRST_PRELIMINARY_YEAR):
        parts.append(M.mart_om(classify(raw.where(era), inputs.municipalities, inputs.icd), by=("ano_arquivo",)))
    keys = S.OM_COLUMNS[:-1]
    return parts[0].unionByName(parts[1]).groupBy(*keys).agg(F.sum("obitos").alias("obitos"))


def published(spark: SparkSession, sf_dir: str) -> Snapshot:
    """The marts after a first run over all file years and a refresh of the last three."""
    root = _folder(spark, "published")
    inputs = P.fixture_inputs(spark, sf_dir)
    P.run_batch(spark, inputs, root, years=(1996, 2024))
    P.run_batch(spark, inputs, root, years=(2022, 2024))
    return snapshot(spark, root)


def published_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state mart published as ordered CSV and read back."""
    root = _folder(spark, "csv")
    mart = P.fixture_marts(spark, sf_dir)["uf"]
    write_published_csv(mart, root, order=["uf", "ano"])
    return files.read_delimited(spark, root, schema=mart.schema)
