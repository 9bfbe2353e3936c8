"""Preliminary refresh as a file stream: history untouched, file years replaced whole."""

import os
import tempfile

from conftest import SF_SMALL, icd, municipalities, raw_rows

from pyspark.sql import functions as F

from maternis import schema as S
from maternis.plans import pipeline as P
from maternis.sources.publication import snapshot
from maternis.sources.sinks import read_mart
from maternis.streaming.refresh import start_refresh


def land(rows, landing, name):
    """One ';' file of raw certificates, named as the publisher names it."""
    tmp = tempfile.mkdtemp(prefix="maternis-land-") + "/f"
    rows.select(*S.RAW_COLUMNS).coalesce(1).write.option("sep", ";").option("header", True).csv(tmp)
    src = [f for f in os.listdir(tmp) if f.endswith(".csv")][0]
    os.makedirs(landing, exist_ok=True)
    os.replace(os.path.join(tmp, src), os.path.join(landing, name))


def test_stream_refresh_matches_batch(spark):
    inp = P.fixture_inputs(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="maternis-stream-")
    out, landing, ck = f"{root}/marts", f"{root}/landing", f"{root}/checkpoint"
    P.run_batch(spark, inp, out, years=(1996, 2022))
    hist_before = read_mart(spark, f"{out}/om").where("ano <= 2022").agg(F.sum("obitos")).first()[0]
    # an older, partial version of 2023 lands first: the latest version counts
    land(inp.raw.where(F.col("ano_arquivo") == 2023).limit(50), landing, "DO23OPEN_20231101.csv")
    os.utime(f"{landing}/DO23OPEN_20231101.csv", (1e9, 1e9))
    for year in (2023, 2024):
        land(inp.raw.where(F.col("ano_arquivo") == year), landing, f"DO{year % 100:02d}OPEN_20241201.csv")
    q = start_refresh(spark, landing, out, ck, inp.municipalities, inp.icd, inp.garbage)
    q.awaitTermination(600)
    assert read_mart(spark, f"{out}/om").where("ano <= 2022").agg(F.sum("obitos")).first()[0] == hist_before
    expected = P.fixture_marts(spark, SF_SMALL)
    for name in ("om", "gc", "ac", "onm", "uf"):
        exp = expected[name]
        got = read_mart(spark, f"{out}/{name}").select(*exp.columns)
        assert got.exceptAll(exp).count() == 0, name
        assert exp.exceptAll(got).count() == 0, name
    status = {r["_arquivo"]: r["status"] for r in spark.read.parquet(f"{out}/_files/*").collect()}
    assert status == {"DO23OPEN_20231101.csv": "superseded", "DO23OPEN_20241201.csv": "applied",
                      "DO24OPEN_20241201.csv": "applied"}


def test_late_deaths_withdrawn_codes_null_dates_and_unnamed_files(spark):
    root = tempfile.mkdtemp(prefix="maternis-stream-")
    out, landing, ck = f"{root}/marts", f"{root}/landing", f"{root}/checkpoint"
    mun, codes = municipalities(spark), icd(spark, ["O000", "O95"])
    garbage = spark.createDataFrame([("O95",)], "causabas string")
    history = raw_rows(spark, [{"dtobito": "01052022"}] * 5)
    P.run_batch(spark, P.Inputs(history, mun, codes, garbage, None), out, years=(2022, 2022))

    def deaths(name):
        return sorted((r.ano or 0, r.causabas, r.obitos) for r in read_mart(spark, f"{out}/{name}").collect())

    def refresh():
        start_refresh(spark, landing, out, ck, mun, codes, garbage).awaitTermination(600)
    # (a) a death of 2022 and (b) one without a date in the file of 2023, (c) a garbage code, (d) files that name no year
    land(raw_rows(spark, [{"dtobito": "01052022", "ano_arquivo": 2023}, {"dtobito": None, "ano_arquivo": 2023},
                          {"dtobito": "01052023", "causabas": "O95"}]), landing, "DO23OPEN_1.csv")
    for k in (1, 2):
        land(raw_rows(spark, [{"dtobito": "01052023"}]), landing, f"part-{k}.csv")
    refresh()
    assert deaths("om") == [(0, "O000", 1), (2022, "O000", 6), (2023, "O95", 1)]
    assert deaths("gc") == [(2023, "O95", 1)]
    assert spark.read.parquet(f"{out}/_rejected/*").count() == 2
    assert read_mart(spark, f"{out}/ac").count() == 8
    # the file of 2023 comes again: the code is corrected, the late death and the one without a date are gone
    land(raw_rows(spark, [{"dtobito": "01052023"}]), landing, "DO23OPEN_2.csv")
    refresh()
    assert deaths("om") == [(2022, "O000", 5), (2023, "O000", 1)]
    assert read_mart(spark, f"{out}/ac").count() == 6
    assert deaths("gc") == [] and snapshot(spark, out).by_file_year("gc", [2023]).count() == 0
