"""Header-bound scan of delimited registry files, with a channel for malformed rows.

Publishers change the order, the case and the number of columns from file to file.
Each file's own header line is read (one line a file, by the driver), its names are
normalised, and files of one header form a layout. A layout is scanned as text and
parsed with its own columns; the wanted columns are then taken by name. The batch
reader and the stream use the same scan.

Rows that do not have the fields of their header, or whose quotes do not close, are
not padded or cut: they are set aside with file, line number and text. So are a
header that is repeated inside a file. Empty lines are counted, not kept. For each
file: lines = 1 header + rows + malformed rows + empty lines.

A quoted field may hold separators and doubled quotes, but no line breaks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File name of a preliminary file: DO<yy>OPEN...csv -> file year 20yy.
FILE_YEAR_PATTERN = r"DO(\d{2})OPEN"
CORRUPT = "_corrupt"
BOM = "\ufeff"
SURPLUS_OR_MISSING, OPEN_QUOTE = "surplus or missing fields", "quotes that do not close"
HEADER, EMPTY = "header", "empty"


class MissingColumns(ValueError):
    """A landed file lacks columns that the pipeline reads; the message names file and columns."""


@dataclass(frozen=True)
class Layout:
    """Files with the same header line."""
    header: str
    columns: tuple[str, ...]  # normalised names, in the order of the files
    files: tuple[str, ...]


def year_of_name(name: str) -> int | None:
    """The file year that a file name states."""
    found = re.search(FILE_YEAR_PATTERN, name)
    return 2000 + int(found.group(1)) if found else None


def year_of_file(name: Column) -> Column:
    yy = F.regexp_extract(name, FILE_YEAR_PATTERN, 1)
    return F.when(yy != "", F.lit(2000) + yy.cast("int")).cast("int")


def landed_files(spark: SparkSession, paths: list[str] | str) -> list[str]:
    """The files that paths, folders and globs name, hidden ones left out."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    out = []
    for given in [paths] if isinstance(paths, str) else paths:
        at = hadoop.Path(given)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        found = fs.globStatus(at) or []
        if not len(found):
            raise FileNotFoundError(given)
        for status in found:
            inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
            out += [f.getPath().toString() for f in inside
                    if not f.isDirectory() and f.getPath().getName()[0] not in "._"]
    return sorted(set(out))


def header_line(spark: SparkSession, path: str, encoding: str) -> str:
    """The first line of a file, without byte order mark; only that line is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, encoding))
        return (reader.readLine() or "").removeprefix(BOM)
    finally:
        stream.close()


def header_columns(header: str, sep: str) -> tuple[str, ...]:
    """The normalised names of a header line, repeated ones numbered."""
    from .files import unique_names
    return tuple(unique_names([name.strip().strip('"') for name in header.split(sep)]))


def layouts(spark: SparkSession, paths: list[str] | str, columns: list[str] | None = None, sep: str = ";",
            encoding: str = "UTF-8") -> list[Layout]:
    """The layouts of the landed files; every one must have ``columns``."""
    by_header: dict[str, list[str]] = {}
    for path in landed_files(spark, paths):
        by_header.setdefault(header_line(spark, path, encoding), []).append(path)
    out = [Layout(h, header_columns(h, sep), tuple(f)) for h, f in by_header.items()]
    for layout in out:
        if missing := [c for c in columns or [] if c not in layout.columns]:
            raise MissingColumns(f"{', '.join(layout.files)}: no column {', '.join(missing)}")
    return out


def same_layout(a: Layout, b: Layout) -> bool:
    """Schema check of two files: the same names in the same order."""
    return a.columns == b.columns


def _ddl(names: tuple[str, ...]) -> str:
    return ", ".join(f"`{n}` string" for n in (*names, CORRUPT))


def _lines(spark: SparkSession, layout: Layout, sep: str, encoding: str, numbered: bool = False) -> DataFrame:
    """Every line of a layout's files: its text, origin, fields ``_r`` and ``_problema`` (null: a row; else why not)."""
    text = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    lines = spark.read.text(list(layout.files)).select(
        F.regexp_replace(text, f"^{BOM}|\r$", "").alias("_texto"), F.col("_metadata.file_name").alias("_arquivo"),
        F.col("_metadata.file_path").alias("_caminho"), F.col("_metadata.file_block_start").alias("_bloco"),
        *[F.monotonically_increasing_id().alias("_id")] * numbered)
    fields = F.from_csv("_texto", _ddl(layout.columns), {"sep": sep, "escape": '"', "mode": "PERMISSIVE",
                                                         "columnNameOfCorruptRecord": CORRUPT})
    quotes = F.length("_texto") - F.length(F.replace("_texto", F.lit('"'), F.lit("")))
    problem = (F.when(F.trim("_texto") == "", EMPTY).when(F.col("_texto") == layout.header, HEADER)
               .when(quotes % 2 == 1, OPEN_QUOTE).when(F.col("_r")[CORRUPT].isNotNull(), SURPLUS_OR_MISSING))
    return lines.withColumn("_r", fields).withColumn("_problema", problem)


def _blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) == "", F.lit(None).cast("string")).otherwise(c)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def bound_rows(spark: SparkSession, found: list[Layout], columns: list[str] | None = None, sep: str = ";",
               encoding: str = "UTF-8") -> DataFrame:
    """The well-formed rows: ``columns`` by name (default: those of all headers), blanks as null, then
    ``ano_arquivo`` (the year that the file's name states) and ``_arquivo``."""
    names = columns or list(dict.fromkeys(c for layout in found for c in layout.columns))
    return _union([
        _lines(spark, layout, sep, encoding).where(F.col("_problema").isNull()).select(
            *[_blank_to_null(F.col("_r")[c] if c in layout.columns else F.lit(None).cast("string")).alias(c) for c in names],
            year_of_file(F.col("_arquivo")).alias("ano_arquivo"), "_arquivo")
        for layout in found])


def raw_lines(spark: SparkSession, found: list[Layout], sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """``_arquivo, texto``: the lines as they came, without headers and empty lines."""
    return _union([_lines(spark, layout, sep, encoding).where(
        F.col("_problema").isNull() | ~F.col("_problema").isin(HEADER, EMPTY)).select("_arquivo", F.col("_texto").alias("texto"))
        for layout in found])


def malformed_rows(spark: SparkSession, found: list[Layout], sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """``_arquivo, linha, problema, texto`` of the rows that are set aside; ``linha`` counts from 1, the header.

    A block of a file is read by one task from its start, so ids that rise within a task number its
    lines; the lines of a file's earlier blocks are added (one row a block)."""
    parts = []
    for layout in found:
        lines = _lines(spark, layout, sep, encoding, numbered=True)
        blocks = lines.groupBy("_caminho", "_bloco").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"))
        before = F.sum("_lines").over(Window.partitionBy("_caminho").orderBy("_bloco")) - F.col("_lines")
        bad = lines.where(F.col("_problema") != EMPTY).join(blocks.withColumn("_before", before), ["_caminho", "_bloco"])
        parts.append(bad.select("_arquivo", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("linha"),
                                F.col("_problema").alias("problema"), F.col("_texto").alias("texto"))
                     .where((F.col("linha") > 1) | (F.col("problema") != HEADER)))
    return _union(parts)


def file_counts(spark: SparkSession, found: list[Layout], sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """``_arquivo, linhas, registros, malformados, vazias`` of each file: lines = 1 + rows + malformed + empty."""
    of = lambda *problems: F.count_if(F.col("_problema").isin(*problems))
    return _union([
        _lines(spark, layout, sep, encoding).groupBy("_arquivo").agg(
            F.count(F.lit(1)).alias("linhas"), F.count_if(F.col("_problema").isNull()).alias("registros"),
            # the first line is the header; others like it are not
            (of(OPEN_QUOTE, SURPLUS_OR_MISSING, HEADER) - 1).alias("malformados"), of(EMPTY).alias("vazias"))
        for layout in found])
