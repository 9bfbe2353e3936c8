"""Table search: any-column case-insensitive search, per-column contains filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def search_any(df: DataFrame, term: str) -> DataFrame:
    """Rows where any column, as text, contains ``term`` (case-insensitive)."""
    t = F.lit(term.lower())
    return df.where(reduce(lambda a, b: a | b, [
        F.coalesce(F.lower(F.col(c).cast("string")).contains(t), F.lit(False)) for c in df.columns]))


def filter_contains(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose ``column`` contains ``value`` (case-sensitive substring)."""
    return df.where(F.col(column).contains(value))


def filter_column(df: DataFrame, column: str, term: str) -> DataFrame:
    """The ordinary per-column filter: rows whose ``column``, as text, contains ``term`` in any case."""
    return df.where(F.lower(F.col(column).cast("string")).contains(F.lit(term.lower())))


#: Values of a column up to which a search becomes a list in the filter (more are searched in the rows).
MAX_VALUES = 1_000


def _is_one_of(df: DataFrame, column: str, values: list[str]) -> Column:
    if isinstance(df.schema[column].dataType, T.IntegralType):  # compared as numbers, so that the scan can use it
        return F.col(column).isin([int(v) for v in values])
    return F.col(column).cast("string").isin(values)


def search_values(df: DataFrame, values: DataFrame, term: str, columns: list[str] | None = None,
                  case_sensitive: bool = False, max_values: int = MAX_VALUES) -> DataFrame:
    """``search_any`` (or, of one column, ``filter_column`` and ``filter_contains``) by way of the columns' distinct values.

    ``values`` (``coluna, valor``: ``publication.Snapshot.values``) is searched instead of the rows; the values found
    become lists in the filter, which the scan uses to skip row groups and folders. A column with more hits than
    ``max_values``, or none of whose values are listed, is searched in the rows, so the result is the same.
    """
    wanted = columns or df.columns
    text = (lambda c: c) if case_sensitive else F.lower
    has = lambda c: text(c).contains(F.lit(term if case_sensitive else term.lower()))
    listed = values.where(F.col("coluna").isin(wanted)).groupBy("coluna").agg(
        F.count_if(has(F.col("valor"))).alias("n")).collect()  # one row a column
    few = [r["coluna"] for r in listed if r["n"] <= max_values]
    found: dict[str, list[str]] = {c: [] for c in few}
    for r in values.where(F.col("coluna").isin(few) & has(F.col("valor"))).select("coluna", "valor").distinct().collect():
        found[r["coluna"]].append(r["valor"])
    tests = [_is_one_of(df, c, sorted(v)) for c, v in found.items() if v]
    tests += [has(F.col(c).cast("string")) for c in wanted if c not in found]
    # a null test is no match, and is left null so that the scan can use the filter
    return df.where(reduce(lambda a, b: a | b, tests) if tests else F.lit(False))
