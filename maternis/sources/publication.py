"""Versioned, atomic publication of the stored marts, and their maintained merged form.

A run writes new folders only, then one manifest names the folders of every mart:

    <root>/_manifests/v00000007.json           the version: which run holds which file year and year
    <root>/files/<mart>/run=<run>/ano_arquivo=<file year>/ano=<year>/
    <root>/merged/<mart>/run=<run>/ano=<year>/  the mart over all file years
    <root>/values/<mart>/run=<run>/ano_arquivo=<file year>/  the distinct values of its columns

Nothing that a manifest names is ever changed, so a reader that holds a version
(``Snapshot``) reads the same rows of all marts to the end, and a run that is killed
between any two writes leaves readers on the version before. The manifest is
written under another name and renamed. One run publishes at a time; a second one
that commits the same version number gets ``VersionTaken`` and publishes nothing.

The unit of replacement is the file year. The merged mart is not built anew: the
rows of the replaced files come with their counts' signs turned, those of the new
files as they are, and both are summed with the merged rows of just the years of
death that they touch. A row whose counts are all zero is gone. A mart without
counts (one row a death) needs no merging; its merged form are its files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFESTS = "_manifests"
VALUES = T.StructType([T.StructField("coluna", T.StringType()), T.StructField("valor", T.StringType()),
                       T.StructField("linhas", T.LongType()), T.StructField("ano_arquivo", T.IntegerType())])


class VersionTaken(RuntimeError):
    """Another run has published this version meanwhile."""


class CheckFailed(RuntimeError):
    """A run's own checks failed; nothing was published."""


# ---------------------------------------------------------------------------
# the store
# ---------------------------------------------------------------------------
def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, on whatever store it is."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    fs, at = _file_system(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()] if fs.exists(at) else []


def _read_text(spark: SparkSession, path: str) -> str:
    fs, at = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def _write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a file whole or not at all; it must not exist."""
    fs, at = _file_system(spark, path)
    _, draft = _file_system(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise VersionTaken(path)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The published versions, the newest last."""
    fs, at = _file_system(spark, f"{root}/{MANIFESTS}")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


# ---------------------------------------------------------------------------
# a version
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Snapshot:
    """One published version of all marts. Readers keep it, and with it the version."""
    spark: SparkSession
    root: str
    version: int = 0
    #: mart -> folder (``ano_arquivo=...`` or ``ano=...``) -> run
    files: dict[str, dict[str, str]] = field(default_factory=dict)
    merged: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    checks: dict[str, object] = field(default_factory=dict)
    batch: str | None = None

    def _schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schemas[name]))

    def _read(self, kind: str, name: str, found: dict[str, str], schema: T.StructType) -> DataFrame:
        base = f"{self.root}/{kind}/{name}"
        paths = [f"{base}/run={run}/{folder}" for folder, run in sorted(found.items())]
        if not paths:  # every row was withdrawn
            return self.spark.createDataFrame([], schema)
        with_run = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
        return self.spark.read.schema(with_run).option("basePath", base).parquet(*paths).select(*schema.fieldNames())

    def by_file_year(self, name: str, file_years: list[int] | None = None) -> DataFrame:
        """A mart by file year (``ano_arquivo``), of the given ones or all."""
        found = self.files.get(name, {})
        if file_years is not None:
            found = {f: r for f, r in found.items() if f in {f"ano_arquivo={int(y)}" for y in file_years}}
        return self._read("files", name, found, self._schema(name))

    def mart(self, name: str) -> DataFrame:
        """A mart over all its file years: a scan, without aggregation; a filter on ``ano`` prunes folders."""
        if name not in self.schemas:
            raise FileNotFoundError(f"{self.root}: version {self.version} has no mart {name}")
        if not counts_of(self._schema(name)):
            return self.by_file_year(name).drop("ano_arquivo")
        schema = T.StructType([f for f in self._schema(name).fields if f.name != "ano_arquivo"])
        return self._read("merged", name, self.merged.get(name, {}), schema)

    def values(self, name: str) -> DataFrame:
        """``coluna, valor, linhas``: the distinct values (as text, null included) of the mart's columns."""
        stored = self._read("values", name, self.files.get(name, {}), VALUES)
        return stored.groupBy("coluna", "valor").agg(F.sum("linhas").alias("linhas"))


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """A published version (default: the newest; version 0, without marts, if there is none)."""
    found = versions(spark, root)
    if version is None and not found:
        return Snapshot(spark, root)
    at = found[-1] if version is None else version
    if at not in found:
        raise FileNotFoundError(f"{root}: no version {at}")
    return Snapshot(spark, root, **json.loads(_read_text(spark, f"{root}/{MANIFESTS}/v{at:08d}.json")))


def counts_of(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if f.name.startswith("obitos")]


# ---------------------------------------------------------------------------
# a run
# ---------------------------------------------------------------------------
def _write(df: DataFrame, path: str, by: list[str], sort_by: list[str]) -> None:
    """Write sorted folders. The rebalance deals rows by folder and splits or joins its partitions
    by their measured size, so a hot year is spread over tasks and the mart is computed once."""
    (df.hint("rebalance", *by).sortWithinPartitions(*by, *sort_by).write.option("maxRecordsPerFile", 5_000_000)
     .partitionBy(*by).parquet(path))


def _sort_columns(df: DataFrame) -> list[str]:
    return [c for c in ("codigo", "uf") if c in df.columns][:1]


def value_counts(df: DataFrame) -> DataFrame:
    """``coluna, valor, linhas`` by file year of all columns but counts: one pass, combined map-side."""
    columns = [c for c in df.columns if c not in counts_of(df.schema) and c != "ano_arquivo"]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(c).cast("string").alias("valor")) for c in columns]))
    return df.select("ano_arquivo", cells.alias("_c")).groupBy("ano_arquivo", "_c.coluna", "_c.valor").agg(
        F.count(F.lit(1)).alias("linhas")).select("coluna", "valor", "linhas", "ano_arquivo")


def _merge(base: Snapshot, name: str, new: DataFrame, old: DataFrame, touched: list[str], run: str,
           sort_by: list[str] | None) -> None:
    """Write the merged rows of the touched years of death: those of the version before, minus old, plus new."""
    counts = counts_of(new.schema)
    keys = [c for c in new.columns if c not in counts and c != "ano_arquivo"]
    signed = lambda df, sign: df.select(*keys, *[(sign * F.col(c)).alias(c) for c in counts])
    parts = signed(new, 1).unionByName(signed(old, -1))
    before = {f: r for f, r in base.merged.get(name, {}).items() if f in touched}
    if before:
        schema = T.StructType([f for f in base._schema(name).fields if f.name != "ano_arquivo"])
        parts = parts.unionByName(signed(base._read("merged", name, before, schema), 1))
    total = parts.groupBy(*keys).agg(*[F.sum(c).cast(new.schema[c].dataType).alias(c) for c in counts])
    gone = [F.col(c) == 0 for c in counts]
    alive = total.where(~_all(gone)).select(*[c for c in new.columns if c != "ano_arquivo"])
    _write(alive, f"{base.root}/merged/{name}/run={run}", ["ano"], sort_by or _sort_columns(alive))


def _all(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def publish(spark: SparkSession, root: str, marts: dict[str, DataFrame], file_years: list[int],
            check: Callable[[dict[str, DataFrame]], dict] | None = None, batch: str | None = None,
            sort_by: list[str] | None = None, parallel: int = 5) -> Snapshot:
    """Replace the file years of the marts (DataFrames with ``ano_arquivo`` and ``ano``) in one new version.

    ``check`` gets the rows as they were written and returns what the manifest records; it raises
    ``CheckFailed`` to stop the run. ``batch`` names the run's input: if the newest version was made of the same
    one (a run repeated after a failure), that version is returned and nothing is written. ``parallel`` marts are
    written at a time.
    """
    base = snapshot(spark, root)
    if batch is not None and base.batch == batch:
        return base
    run = f"{base.version + 1:08d}-{uuid.uuid4().hex[:12]}"
    years = {f"ano_arquivo={int(y)}" for y in file_years}

    def one(name: str, df: DataFrame) -> tuple[Snapshot, DataFrame]:
        """Write one mart; the snapshot names its folders."""
        df = df.where(F.col("ano_arquivo").isin([int(y) for y in file_years]))
        if name in base.schemas and base._schema(name).fieldNames() != df.columns:
            raise CheckFailed(f"{name}: columns {df.columns} are not those of the published mart")
        at = f"{root}/files/{name}/run={run}"
        _write(df, at, ["ano_arquivo", "ano"], sort_by or _sort_columns(df))
        new_folders = folders(spark, at)
        files = {f: r for f, r in base.files.get(name, {}).items() if f not in years} | {f: run for f in new_folders}
        draft = Snapshot(spark, root, files={name: files}, schemas={name: df.schema.json()})
        rows = draft.by_file_year(name, file_years)
        _write(value_counts(rows), f"{root}/values/{name}/run={run}", ["ano_arquivo"], ["coluna", "valor"])
        if not counts_of(df.schema):
            return draft, rows
        old_folders = {f: r for f, r in base.files.get(name, {}).items() if f in years}
        touched = sorted({d for f in new_folders for d in folders(spark, f"{at}/{f}")}
                         | {d for f, r in old_folders.items() for d in folders(spark, f"{root}/files/{name}/run={r}/{f}")})
        old = base.by_file_year(name, file_years) if old_folders else spark.createDataFrame([], df.schema)
        _merge(base, name, rows, old, touched, run, sort_by)
        draft.merged[name] = {f: r for f, r in base.merged.get(name, {}).items() if f not in touched} | {
            f: run for f in folders(spark, f"{root}/merged/{name}/run={run}")}
        return draft, rows

    # the marts' jobs are small and independent of one another
    with ThreadPoolExecutor(max(1, min(parallel, len(marts)))) as pool:
        done = dict(zip(marts, pool.map(one, marts, marts.values())))
    files, merged, schemas = dict(base.files), dict(base.merged), dict(base.schemas)
    for draft, _ in done.values():
        files, merged, schemas = files | draft.files, merged | draft.merged, schemas | draft.schemas
    written = {name: rows for name, (_, rows) in done.items()}
    record = {"version": base.version + 1, "files": files, "merged": merged, "schemas": schemas,
              "checks": check(written) if check else {}, "batch": batch}
    _write_new(spark, f"{root}/{MANIFESTS}/v{base.version + 1:08d}.json", json.dumps(record, sort_keys=True))
    return snapshot(spark, root, base.version + 1)


def collect_old(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all but the newest ``keep`` versions and every folder that none of those names (also those of
    runs that did not finish, so call it when no run is writing). Returns the deleted folders."""
    found = versions(spark, root)
    kept = [snapshot(spark, root, v) for v in found[-keep:]]
    for v in found[:-keep]:
        remove_path(spark, f"{root}/{MANIFESTS}/v{v:08d}.json")
    named = {f"{kind}/{name}/run={run}/{folder}" for s in kept for kind, marts in (("files", s.files), ("values", s.files), ("merged", s.merged))
             for name, of in marts.items() for folder, run in of.items()}
    deleted = []
    for kind in ("files", "values", "merged"):
        for name in folders(spark, f"{root}/{kind}"):
            for run in folders(spark, f"{root}/{kind}/{name}"):
                inside = folders(spark, f"{root}/{kind}/{name}/{run}")
                old = [f for f in inside if f"{kind}/{name}/{run}/{f}" not in named]
                targets = [f"{kind}/{name}/{run}"] if len(old) == len(inside) else [f"{kind}/{name}/{run}/{f}" for f in old]
                for target in targets:
                    remove_path(spark, f"{root}/{target}")
                    deleted.append(target)
    return deleted
