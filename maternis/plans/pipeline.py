"""Assembly of the batch pipeline: inputs -> classified -> marts -> writes.

``fixture_*`` builds the inputs from the benchmark tables (see
``sources.fixtures``); ``run_batch`` is the production entry over landed files.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import dims, quality
from ..sources import fixtures as FX
from ..sources import files
from ..sources.publication import CheckFailed, publish, remove_path
from . import marts as M
from .classify import classify


_plans: dict[tuple, object] = {}


def _memo(spark: SparkSession, *key):
    """Per-session memo of lazy plans (DataFrames are immutable; nothing is
    cached in memory, each query still executes its whole plan)."""
    return (spark.sparkContext.applicationId,) + key


@dataclass
class Inputs:
    raw: DataFrame
    municipalities: DataFrame
    icd: DataFrame
    garbage: DataFrame
    states: DataFrame


def fixture_icd(spark: SparkSession) -> DataFrame:
    """ICD dimension of the fixture: each of its cause codes (a fixed,
    duplicate-free list) with category and chapter. Like a full ICD table it
    also lists O935 and O937, which no certificate carries after the O95
    recode, so those rows never match."""
    codes = spark.createDataFrame([(c,) for c in FX.FIXTURE_CODES], "causabas string")
    return dims.icd_dimension(dims.with_row_bound(codes, len(FX.FIXTURE_CODES)), files.chapters_frame(spark),
                              assume_distinct=True)


def fixture_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    k = _memo(spark, "inputs", sf_dir)
    if k not in _plans:
        _plans[k] = Inputs(
            raw=FX.sim_raw(spark, sf_dir),
            municipalities=FX.municipality_dim(spark, sf_dir),
            icd=fixture_icd(spark),
            garbage=FX.garbage_codes(spark),
            states=FX.state_lookup(spark, sf_dir),
        )
    return _plans[k]


def fixture_classified(spark: SparkSession, sf_dir: str, candidates_only: bool = True) -> DataFrame:
    inp = fixture_inputs(spark, sf_dir)
    return classify(inp.raw, inp.municipalities, inp.icd, candidates_only=candidates_only)


def fixture_marts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    k = _memo(spark, "marts", sf_dir)
    if k not in _plans:
        inp = fixture_inputs(spark, sf_dir)
        _plans[k] = M.build_marts(classify(inp.raw, inp.municipalities, inp.icd), inp.garbage)
    return _plans[k]


def era_marts(spark: SparkSession, sf_dir: str, era: str) -> dict[str, DataFrame]:
    """Marts of one era only (history or preliminary files), as the two
    programs of the definition produce them before they are merged."""
    k = _memo(spark, "era_marts", sf_dir, era)
    if k not in _plans:
        inp = fixture_inputs(spark, sf_dir)
        first = S.FIRST_PRELIMINARY_YEAR
        year_filter = F.col("ano_arquivo") < first if era == S.HISTORY else F.col("ano_arquivo") >= first
        c = classify(inp.raw.where(year_filter), inp.municipalities, inp.icd)
        _plans[k] = M.build_marts(c, inp.garbage)
    return _plans[k]


def run_checks(written: dict[str, DataFrame]) -> dict:
    """The checks of a run, on the rows that it wrote: deaths of the official and the per-death mart by year must
    agree, every garbage-code death must be an official one; rows with a null are counted for the record."""
    totals = quality.control_totals(written["om"], written["ac"])

    def differing() -> list:
        return totals.where(~F.col("obitos_om").eqNullSafe(F.col("linhas_ac"))).limit(5).collect()

    def strangers() -> bool:
        # only official deaths of a garbage code can equal one, so the others need not be dealt and counted
        gc, om = written["gc"], written["om"]
        causes = gc.select(F.col("causabas").alias("_cause")).distinct()
        same_cause = om.join(dims.bounded_broadcast(causes), F.col("causabas").eqNullSafe(F.col("_cause")), "left_semi")
        return gc.exceptAll(same_cause.select(*gc.columns)).isEmpty()

    def sums():
        return totals.agg(F.count(F.lit(1)).alias("anos"), F.sum("obitos_om").alias("obitos")).first()

    audited = ("om", "ac", "onm")
    with ThreadPoolExecutor(4) as pool:  # small jobs of their own
        off, only_known, total = pool.submit(differing), pool.submit(strangers), pool.submit(sums)
        nulls = dict(zip(audited, pool.map(lambda name: quality.null_audit(written[name]).count(), audited)))
    if off.result():
        raise CheckFailed(f"control totals differ: {[r.asDict() for r in off.result()]}")
    if not only_known.result():
        raise CheckFailed("garbage-code deaths that are no official deaths")
    return {"years": total.result()["anos"], "deaths": total.result()["obitos"] or 0, "rows_with_nulls": nulls}


def write_marts(classified: DataFrame, garbage: DataFrame, out_root: str, file_years: list[int],
                batch: str | None = None) -> dict[str, str]:
    """Replace the given file years in the five marts, as one published version.

    The classified certificates are staged once, only the columns that the marts read, as Parquet by
    file year on the marts' own (shared) storage; every mart reads the stage, pruned, and the stage
    goes after success. A failed run leaves its stage folder for inspection and publishes nothing.
    """
    spark = classified.sparkSession
    stage = f"{out_root}/_stage-{uuid.uuid4().hex}"
    slim = classified.where(F.col("materno") | F.col("desconsiderado")).select(*M.MART_INPUT, "ano_arquivo")
    slim.write.partitionBy("ano_arquivo").parquet(stage)
    staged = spark.read.schema(slim.schema).parquet(stage)
    marts = M.build_marts(staged, garbage, by=("ano_arquivo",))
    publish(spark, out_root, marts, file_years, check=run_checks, batch=batch)
    remove_path(spark, stage)
    return {name: f"{out_root}/{name}" for name in marts}


def run_batch(spark: SparkSession, inputs: Inputs, out_root: str, years: tuple[int, int] | None = None) -> dict[str, str]:
    """Classify the landed files (of the file years ``years``, inclusive) and replace them in the marts.

    File years of the range without any certificate are replaced by nothing. Read the marts with
    ``sources.sinks.read_mart``, or several of one version with ``sources.publication.snapshot``.
    """
    raw = inputs.raw
    if years is not None:
        raw = raw.where(F.col("ano_arquivo").between(*years))
        file_years = list(range(years[0], years[1] + 1))
    else:
        file_years = sorted(r[0] for r in raw.select("ano_arquivo").distinct().collect() if r[0] is not None)
    unplaced = inputs.raw.where(F.col("ano_arquivo").isNull())
    if not unplaced.isEmpty():
        raise ValueError("certificates without a file year (ano_arquivo): the file is the unit of replacement")
    return write_marts(classify(raw, inputs.municipalities, inputs.icd), inputs.garbage, out_root, file_years)
