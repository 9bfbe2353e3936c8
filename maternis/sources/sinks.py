"""Writers: stored marts by file year, published CSV in order, query exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .publication import publish, snapshot


def _split(path: str) -> tuple[str, str]:
    root, _, name = path.rstrip("/").rpartition("/")
    return root, name


def write_mart(df: DataFrame, path: str, file_years: list[int], sort_by: list[str] | None = None) -> None:
    """Replace the file years of the one mart ``<root>/<name>`` in a new published version (``publication``).

    The unit of replacement is the file, not the year of death: a late death in a newer file never touches
    an older file's rows, and a file year without any row left is gone."""
    root, name = _split(path)
    publish(df.sparkSession, root, {name: df}, file_years, sort_by=sort_by)


def read_mart(spark: SparkSession, path: str) -> DataFrame:
    """The mart ``<root>/<name>`` of the newest version, over all its file years; a filter on ``ano`` prunes
    folders. To read several marts of one version, hold a ``publication.snapshot``."""
    root, name = _split(path)
    return snapshot(spark, root).mart(name)


def in_order(df: DataFrame, first: list[str]) -> DataFrame:
    """Rows in a total order: by ``first``, then by the other columns, nulls last. Spark deals ranges of that
    order to tasks, so a code with a third of the rows is spread over several."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in [*first, *(c for c in df.columns if c not in first)]])


def write_published_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Published mart: ',' separated, '.' decimals, header, no index column, ``NA`` for nulls.

    With ``order`` the files, read by name, are one table in that order (``in_order``); pass a stored mart, as
    the ranges are found by a first pass over it."""
    out = df if order is None else in_order(df, order)
    out.write.mode("overwrite").option("header", True).option("sep", ",").option("nullValue", "NA").csv(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Query export: ';' separated, UTF-8, header, no index column."""
    (df.write.mode("overwrite").option("header", True).option("sep", ";")
     .option("encoding", "UTF-8").csv(path))
