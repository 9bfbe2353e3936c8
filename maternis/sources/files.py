"""Readers for landed registry files and dimension tables (fixed schemas, no inference)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S


def clean_name(name: str) -> str:
    """Lower snake case, accents to ASCII, camelCase split (column names only)."""
    s = unicodedata.normalize("NFKD", name)
    s = "".join(ch for ch in s if not unicodedata.combining(ch))
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower()
    s = re.sub(r"_+", "_", s)
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def unique_names(names: list[str]) -> list[str]:
    """Normalised names; repeated ones get the first numeric suffix that is free."""
    out: list[str] = []
    wanted = [clean_name(c) for c in names]
    for n in wanted:
        name, k = n, 1
        while name in out or (k > 1 and name in wanted):
            k += 1
            name = f"{n}_{k}"
        out.append(name)
    return out


def clean_names(df: DataFrame) -> DataFrame:
    """Normalise every column name (``unique_names``)."""
    return df.toDF(*unique_names(df.columns))


def numeric_to_text(df: DataFrame) -> DataFrame:
    """Cast every numeric column to text (registry codes are labels, not numbers)."""
    return df.select(*[
        F.col(f.name).cast("string").alias(f.name)
        if isinstance(f.dataType, T.NumericType) else F.col(f.name)
        for f in df.schema.fields
    ])


def blanks_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Empty or blank text codes are missing codes."""
    cols = set(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    return df.select(*[
        F.when(F.trim(F.col(c)) == "", F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
        if c in cols else F.col(c)
        for c in df.columns
    ])


def same_columns(a: DataFrame, b: DataFrame) -> bool:
    """Schema check of two inputs, by position (metadata only, no job)."""
    return a.columns == b.columns


def read_landed_raw(spark: SparkSession, root: str, first_year: int | None = None,
                    last_year: int | None = None) -> DataFrame:
    """Landed certificates as Parquet partitioned by ``ano_arquivo``.

    The year range is a filter on the partition column, so only the matching
    folders are listed and read (partition pruning).
    """
    df = spark.read.parquet(root)
    if first_year is not None:
        df = df.where(F.col("ano_arquivo") >= first_year)
    if last_year is not None:
        df = df.where(F.col("ano_arquivo") <= last_year)
    return df


def read_preliminary_csv(spark: SparkSession, paths: list[str] | str, file_year: int | None = None,
                         schema: T.StructType | None = None, encoding: str = "UTF-8") -> DataFrame:
    """';'-separated preliminary files; every column read as text and bound by the header of its own file.

    ``schema`` names the columns that every file must have (in any order and case, among others); a file
    without one of them is an error that names it. Without ``schema`` the columns of all headers are read.
    Each row gets the file year ``ano_arquivo`` of its file's name (the era rules follow the file, not the
    date of death), or ``file_year`` if that is given. Malformed rows are left to ``landing.malformed_rows``.
    """
    from . import landing
    columns = schema.fieldNames() if schema is not None else None
    found = landing.layouts(spark, paths, columns, encoding=encoding)
    rows = landing.bound_rows(spark, found, columns, encoding=encoding).drop("_arquivo")
    return rows.withColumn("ano_arquivo", F.lit(file_year).cast("int")) if file_year is not None else rows


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   sep: str = ",", trim: bool = True) -> DataFrame:
    """Delimited table with header; optional whitespace trim; no escaped quotes.

    ``NA`` is the publisher's mark of a missing value, an empty field is one too."""
    r = (spark.read.option("sep", sep).option("header", True).option("escape", "\\").option("nullValue", "NA")
         .option("emptyValue", "").option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim))
    df = blanks_to_null(r.schema(schema).csv(path) if schema is not None else r.csv(path))
    return clean_names(df) if schema is None else df


INTERVAL_SCHEMA = T.StructType([
    T.StructField("CATINIC", T.StringType()),
    T.StructField("CATFIM", T.StringType()),
    T.StructField("DESCRICAO", T.StringType()),
])


def read_interval_table(spark: SparkSession, path: str) -> DataFrame:
    """ICD interval table: ';' separated, UTF-8 with BOM, doubled quotes inside fields."""
    return (spark.read.option("sep", ";").option("header", True).option("escape", '"')
            .option("encoding", "UTF-8").schema(INTERVAL_SCHEMA).csv(path))


def chapters_frame(spark: SparkSession) -> DataFrame:
    """The 22 ICD-10 chapters as an interval table (CATINIC, CATFIM, DESCRICAO)."""
    from ..operators.dims import with_row_bound
    return with_row_bound(spark.createDataFrame(S.ICD_CHAPTERS, INTERVAL_SCHEMA), len(S.ICD_CHAPTERS))
