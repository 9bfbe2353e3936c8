"""Readers (CSV variants, BOM interval table), name normalisation, year-partitioned writes."""

import os
import tempfile

from conftest import SF_SMALL

from pyspark.sql import functions as F

from maternis import schema as S
from maternis.sources import files
from maternis import schema as S
from maternis.plans.classify import derive_stage, recode_stage
from maternis.sources.sinks import export_csv, read_mart, write_mart, write_published_csv


def test_clean_names():
    assert files.clean_name("Óbitos Maternos") == "obitos_maternos"
    assert files.clean_name("dtObito") == "dt_obito"
    assert files.clean_name("  CAUSABAS ") == "causabas"


def test_interval_table_with_bom_and_doubled_quotes(spark):
    d = tempfile.mkdtemp(prefix="maternis-test-")
    p = os.path.join(d, "g.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write('CATINIC;CATFIM;DESCRICAO\nF40;F48;"Transtornos ""stress"" e outros"\nA00;A09;Doenças\n')
    rows = files.read_interval_table(spark, p).collect()
    assert [tuple(r) for r in rows] == [("F40", "F48", 'Transtornos "stress" e outros'), ("A00", "A09", "Doenças")]


def test_preliminary_csv_blank_codes_are_null(spark):
    d = tempfile.mkdtemp(prefix="maternis-test-")
    p = os.path.join(d, "DO23.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("SEXO;CAUSABAS;OBITOGRAV;IDADE\n2;O000;;433\n1; ;1;999\n")
    df = files.read_preliminary_csv(spark, p, file_year=2023)
    assert df.columns == ["sexo", "causabas", "obitograv", "idade", "ano_arquivo"]
    got = [tuple(r) for r in df.collect()]
    assert got == [("2", "O000", None, "433", 2023), ("1", None, "1", "999", 2023)]
    assert files.same_columns(df, df)


def test_delimited_trim(spark):
    d = tempfile.mkdtemp(prefix="maternis-test-")
    p = os.path.join(d, "t.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("uf , sigla_uf\n Pará , PA \n")
    assert [tuple(r) for r in files.read_delimited(spark, p).collect()] == [("Pará", "PA")]


def test_numeric_to_text(spark):
    df = files.numeric_to_text(spark.createDataFrame([(1, "a", 2.5)], "a int, b string, c double"))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "string", "string"]


def test_write_mart_replaces_whole_file_years(spark):
    out = tempfile.mkdtemp(prefix="maternis-test-") + "/om"
    schema = "codigo string, ano int, obitos long, ano_arquivo int"
    hist = spark.createDataFrame([("1", 2021, 5, 2021), ("2", 2022, 6, 2022), ("1", 2022, 99, 2023), ("1", None, 9, 2023)], schema)
    write_mart(hist, out, [2021, 2022, 2023], sort_by=["codigo"])
    prelim = spark.createDataFrame([("1", 2023, 7, 2023), ("3", 2024, 8, 2024), ("2", 2022, 1, 2024)], schema)
    write_mart(prelim, out, [2023, 2024], sort_by=["codigo"])
    got = sorted(tuple(r) for r in read_mart(spark, out).select("codigo", "ano", "obitos").collect())
    assert got == [("1", 2021, 5), ("1", 2023, 7), ("2", 2022, 7), ("3", 2024, 8)]
    # folder pruning on read
    plan = read_mart(spark, out).where(F.col("ano") == 2023)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ano" in plan
    # a file year without any row left
    write_mart(prelim.limit(0), out, [2024], sort_by=["codigo"])
    assert sorted(r.ano for r in read_mart(spark, out).collect()) == [2021, 2022, 2023]


def test_preliminary_files_follow_the_era_of_their_name(spark):
    folder = tempfile.mkdtemp(prefix="maternis-test-")
    names = "sexo;causabas;obitograv;obitopuerp;dtobito;idade;racacor;estciv;esc2010;lococor;assistmed;necropsia;fonteinv;codmunres"
    for yy, day in (("23", "31122022"), ("24", "01012024")):
        with open(f"{folder}/DO{yy}OPEN.csv", "w", encoding="utf-8") as f:
            f.write(f"{names}\n2;O000;2;8;{day};430;1;1;1;1;1;1;1;1\n")
    raw = files.read_preliminary_csv(spark, [f"{folder}/DO23OPEN.csv", f"{folder}/DO24OPEN.csv"])
    got = {r["ano_arquivo"]: r for r in derive_stage(recode_stage(raw)).collect()}
    assert sorted(got) == [2023, 2024]
    assert got[2023]["era"] == "preliminar" or got[2023]["era"] == S.PRELIMINARY
    assert got[2023]["ano"] == 2022 and got[2023]["obitopuerp"] == "8"


def test_na_is_null_and_published_marts_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="maternis-test-")
    with open(f"{folder}/m.csv", "w", encoding="utf-8") as f:
        f.write("a,b\n1,NA\n,x\n")
    assert [tuple(r) for r in files.read_delimited(spark, f"{folder}/m.csv").collect()] == [("1", None), (None, "x")]
    mart = spark.createDataFrame([("1", None, 2), ("2", "PA", 3)], "codigo string, uf string, obitos long")
    write_published_csv(mart, f"{folder}/out")
    back = files.read_delimited(spark, f"{folder}/out", schema=mart.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, mart.collect()), key=str)


def test_published_files_are_one_table_in_order(spark):
    import random
    rng = random.Random(6)
    # one code has a third of the rows, some rows have none, and codes repeat
    rows = [("355030" if k % 3 == 0 else rng.choice([None, *map(str, range(100000, 100200))]), rng.choice([2020, 2021, None]),
             rng.choice(["Pará", None, "Águas"]), k % 7) for k in range(6000)]
    df = spark.createDataFrame(rows, "codigo string, ano int, municipio string, obitos int").repartition(5)
    out = tempfile.mkdtemp(prefix="maternis-test-") + "/out"
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as with a table of many files: all its ranges are kept
    try:
        write_published_csv(df, out, order=["codigo", "ano"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    names = sorted(f for f in os.listdir(out) if f.endswith(".csv"))
    got = []
    for name in names:
        lines = open(os.path.join(out, name), encoding="utf-8").read().splitlines()
        assert lines[0] == "codigo,ano,municipio,obitos"
        got += [tuple(line.split(",")) for line in lines[1:]]
    as_text = [tuple("NA" if x is None else str(x) for x in r) for r in rows]
    last = lambda r: tuple((x == "NA", x) for x in r)
    assert got == sorted(as_text, key=last) and len(names) > 3
    hot = [sum(line.startswith("355030") for line in open(os.path.join(out, n), encoding="utf-8")) for n in names]
    assert sum(hot) == 2000 and max(hot) < 1500  # the hot code lies in several files


def test_clean_names_never_collide(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["a", "A ", "a_2", "a_2 "])
    assert len(set(files.clean_names(df).columns)) == 4


def test_export_csv_semicolon(spark):
    out = tempfile.mkdtemp(prefix="maternis-test-") + "/exp"
    export_csv(spark.createDataFrame([("Águas", 3)], "municipio string, obitos long"), out)
    text = "".join(open(os.path.join(out, f), encoding="utf-8").read()
                   for f in sorted(os.listdir(out)) if f.endswith(".csv"))
    assert "municipio;obitos" in text and "Águas;3" in text


def test_landed_raw_partition_pruning(spark):
    from maternis.sources import fixtures as FX
    out = tempfile.mkdtemp(prefix="maternis-test-") + "/raw"
    FX.sim_raw(spark, SF_SMALL).write.partitionBy("ano_arquivo").parquet(out)
    df = files.read_landed_raw(spark, out, 2023, 2024)
    assert {r.ano_arquivo for r in df.select("ano_arquivo").distinct().collect()} == {2023, 2024}
    assert "PartitionFilters" in df._jdf.queryExecution().executedPlan().toString()
    assert set(S.RAW_COLUMNS) <= set(df.columns)


def test_marts_push_candidate_filter_into_landed_scan(spark):
    """On landed Parquet (plain raw columns) the candidate pre-filter reaches
    the scan as pushed filters and the year range as partition filters."""
    from maternis.plans import marts as M
    from maternis.plans import pipeline as P
    from maternis.plans.classify import classify
    from maternis.sources import fixtures as FX
    out = tempfile.mkdtemp(prefix="maternis-test-") + "/raw"
    FX.sim_raw(spark, SF_SMALL).write.partitionBy("ano_arquivo").parquet(out)
    inp = P.fixture_inputs(spark, SF_SMALL)
    raw = files.read_landed_raw(spark, out, 2015, 2024)
    om = M.mart_om(classify(raw, inp.municipalities, inp.icd))
    plan = om._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "FileScan parquet" in line and "sexo" in line][0]
    assert "PushedFilters: [IsNotNull(sexo), EqualTo(sexo,2)" in scan
    assert "PartitionFilters: [isnotnull(ano_arquivo" in scan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("BroadcastExchange")[0]
    expected = P.fixture_marts(spark, SF_SMALL)["om"].where("ano between 2015 and 2024")
    assert om.exceptAll(expected).count() == 0 and expected.exceptAll(om).count() == 0


def test_format_number_br(spark):
    from maternis.functions.classify import format_number_br, long_date_pt
    df = spark.createDataFrame([(1234567.891,)], "x double")
    assert df.select(format_number_br("x", 2)).first()[0] == "1.234.567,89"
    d = spark.createDataFrame([("2024-03-05",)], "d string").select(F.to_date("d").alias("d"))
    assert d.select(long_date_pt("d")).first()[0] == "05 de março de 2024"


def test_published_csv_comma_and_header(spark):
    out = tempfile.mkdtemp(prefix="maternis-test-") + "/pub"
    write_published_csv(spark.createDataFrame([("N01", 2.5)], "uf string, x double"), out)
    text = "".join(open(os.path.join(out, f), encoding="utf-8").read()
                   for f in sorted(os.listdir(out)) if f.endswith(".csv"))
    assert "uf,x" in text and "N01,2.5" in text
