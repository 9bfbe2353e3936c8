"""Parameter domains: year bounds, sorted facet values, dependent lists, series counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLLATION = "UNICODE"


def year_bounds(mart: DataFrame, col: str = "ano") -> DataFrame:
    return mart.agg(F.min(col).alias("ano_min"), F.max(col).alias("ano_max"))


def facet_domain(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-null values of ``col`` (locale-aware order: 'Águas'
    sorts before 'Belém'). Distinct runs with partial aggregation."""
    return (df.select(col).where(F.col(col).isNotNull()).distinct()
            .orderBy(F.collate(F.col(col).cast("string"), COLLATION)))


def municipalities_of_state(states: DataFrame, state_name: str) -> DataFrame:
    """Sorted municipalities of a state given by full name."""
    return (states.where(F.col("uf") == state_name).select("municipio")
            .where(F.col("municipio").isNotNull()).distinct()
            .orderBy(F.collate("municipio", COLLATION)))


def series_count(df: DataFrame, col: str) -> DataFrame:
    """Number of distinct values of ``col``, a null counting as one value."""
    return df.agg((F.count_distinct(col)
                   + F.coalesce(F.max(F.col(col).isNull().cast("int")), F.lit(0))).alias("n_series"))


def facet_of_values(values: DataFrame, column: str) -> DataFrame:
    """``facet_domain`` as text from the stored distinct values (``coluna, valor``), without a scan of the mart."""
    of = values.where((F.col("coluna") == column) & F.col("valor").isNotNull()).select(F.col("valor").alias(column)).distinct()
    return of.orderBy(F.collate(F.col(column), COLLATION))


def year_bounds_of_values(values: DataFrame, column: str = "ano") -> DataFrame:
    """``year_bounds`` from the stored distinct values."""
    return year_bounds(values.where(F.col("coluna") == column).select(F.col("valor").cast("int").alias(column)), column)


def series_count_of_values(values: DataFrame, column: str) -> DataFrame:
    """``series_count`` of a whole mart's column from the stored distinct values."""
    return series_count(values.where(F.col("coluna") == column).select(F.col("valor").alias(column)), column)
