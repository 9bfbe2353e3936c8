"""Preliminary-year refresh as a Structured Streaming job.

The preliminary files (one ';' CSV per year, re-published with more records
every month) land in a folder. The stream lists new files only (their content is
not read by it); each batch reads its files by their own headers, as the batch
reader does (``sources.landing``). The file source tracks files by path, so a
re-published year lands under a new name, e.g. ``DO24OPEN_20241129.csv``; the year
is read from the ``DOyyOPEN`` part.

The unit of replacement is the file: ``foreachBatch`` classifies the batch once
and replaces exactly its file years in every mart, also where a mart has no row
of them any more, in one published version (``sources.publication``): readers see
all five marts before or after it. Deaths of other years in a file stay in that
file's year and never touch the history. Of several versions of one year in a
batch the latest (by modification time, then name) counts.

Nothing is dropped unseen: each batch writes a report of its files under ``_files``
(year, lines, rows, malformed rows, empty lines, status, reason). Status is
``applied``, ``superseded`` or ``rejected`` (no year in the name, or a column is
missing). Malformed rows of applied files are kept under ``_malformed`` with file and
line, the lines of rejected files under ``_rejected`` as they came; a year is never
inferred from a row.

The streaming checkpoint (in shared storage) records which files were
processed, so a restarted or failed run resumes without losing a file; a batch
retried after its version was published changes nothing. Run it with
``trigger(availableNow=True)`` from the monthly schedule: it processes what has
landed and stops.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..plans.classify import classify
from ..plans.pipeline import write_marts
from ..sources import landing

FILES = "path string, modificationTime timestamp, length bigint, content binary"
REPORT = ("ano_arquivo int, _arquivo string, _publicado timestamp, linhas bigint, registros bigint, malformados bigint, "
          "vazias bigint, status string, motivo string")
APPLIED, SUPERSEDED, REJECTED = "applied", "superseded", "rejected"


def preliminary_stream(spark: SparkSession, landing_dir: str) -> DataFrame:
    """Streaming DataFrame of the landed files: ``path, modificationTime, length``; contents are not read."""
    return (spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "[!._]*")
            .load(landing_dir).select("path", "modificationTime", "length"))


def judge_files(spark: SparkSession, files: list[tuple[str, datetime]], encoding: str) -> list[dict]:
    """Year, status and reason of each file of a batch (``path, modification time``)."""
    out = []
    for path, time in files:
        name = path.rsplit("/", 1)[1]
        row = {"path": path, "_arquivo": name, "_publicado": time, "ano_arquivo": landing.year_of_name(name),
               "status": APPLIED, "motivo": None, "layout": None}
        try:
            (row["layout"],) = landing.layouts(spark, path, encoding=encoding)
            landing.layouts(spark, path, S.RAW_COLUMNS, encoding=encoding)
        except landing.MissingColumns as e:
            row |= {"status": REJECTED, "motivo": str(e).rsplit(": ", 1)[1]}
        if row["ano_arquivo"] is None:
            row |= {"status": REJECTED, "motivo": "the name states no year"}
        out.append(row)
    latest: dict[int, tuple] = {}
    for row in out:
        if row["status"] == APPLIED:
            latest[row["ano_arquivo"]] = max(latest.get(row["ano_arquivo"], ()), (row["_publicado"], row["_arquivo"]))
    for row in out:
        if row["status"] == APPLIED and (row["_publicado"], row["_arquivo"]) != latest[row["ano_arquivo"]]:
            row |= {"status": SUPERSEDED, "motivo": "a later version of the year is in the batch"}
    return out


def refresh_batch(municipalities: DataFrame, icd: DataFrame, garbage: DataFrame, out_root: str,
                  encoding: str = "UTF-8") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: classify the batch's applied files and replace their years in every mart."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        listed = sorted((r["path"], r["modificationTime"], r["length"]) for r in batch.collect())  # one row a file
        if not listed:
            return
        files = judge_files(spark, [f[:2] for f in listed], encoding)
        by_status = {s: [f["path"] for f in files if f["status"] == s] for s in (APPLIED, REJECTED)}
        found = landing.layouts(spark, [f["path"] for f in files], encoding=encoding)
        counts = {r["_arquivo"]: r for r in landing.file_counts(spark, found, encoding=encoding).collect()}  # one row a file
        rows = []
        for f in files:
            n = counts.get(f["_arquivo"])
            rows.append((f["ano_arquivo"], f["_arquivo"], f["_publicado"],
                         *([n["linhas"], n["registros"], n["malformados"], n["vazias"]] if n else [0, 0, 0, 0]),
                         f["status"], f["motivo"]))
        spark.createDataFrame(rows, REPORT).write.mode("overwrite").parquet(f"{out_root}/_files/epoch={epoch_id}")
        if by_status[REJECTED]:
            landing.raw_lines(spark, landing.layouts(spark, by_status[REJECTED], encoding=encoding), encoding=encoding).write.mode(
                "overwrite").parquet(f"{out_root}/_rejected/epoch={epoch_id}")
        if not by_status[APPLIED]:
            return
        applied = landing.layouts(spark, by_status[APPLIED], S.RAW_COLUMNS, encoding=encoding)
        landing.malformed_rows(spark, applied, encoding=encoding).write.mode("overwrite").parquet(
            f"{out_root}/_malformed/epoch={epoch_id}")
        raw = landing.bound_rows(spark, applied, S.RAW_COLUMNS, encoding=encoding).drop("_arquivo")
        years = sorted(f["ano_arquivo"] for f in files if f["status"] == APPLIED)
        write_marts(classify(raw, municipalities, icd), garbage, out_root, years,
                    batch=hashlib.sha256(repr(listed).encode()).hexdigest())
    return run


def start_refresh(spark: SparkSession, landing_dir: str, out_root: str, checkpoint_location: str,
                  municipalities: DataFrame, icd: DataFrame, garbage: DataFrame,
                  available_now: bool = True, encoding: str = "UTF-8") -> StreamingQuery:
    """Start the refresh. ``maxFilesPerTrigger`` is left unset, so a run takes all new files at once."""
    writer = (preliminary_stream(spark, landing_dir).writeStream
              .foreachBatch(refresh_batch(municipalities, icd, garbage, out_root, encoding))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 hour")
    return writer.start()
