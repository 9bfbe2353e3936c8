"""Header-bound scan: names decide, not positions; malformed rows are set aside; batch and stream agree."""

import os
import tempfile

import pytest
from conftest import RAW_DEFAULTS, icd, municipalities

from maternis import schema as S
from maternis.sources import files, landing
from maternis.sources.sinks import read_mart
from maternis.streaming.refresh import start_refresh

# Another order, upper case, other columns in between: as the publisher's files are.
PUBLISHED = ["ORIGEM", "TIPOBITO", "DTOBITO", "IDADE", "SEXO", "RACACOR", "ESTCIV", "ESC2010", "CODMUNRES", "LOCOCOR",
             "ASSISTMED", "NECROPSIA", "CAUSABAS", "CB_PRE", "OBITOGRAV", "OBITOPUERP", "FONTEINV"]


def folder():
    return tempfile.mkdtemp(prefix="maternis-landing-")


def write(path, header, rows, sep=";", newline="\n", encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(newline.join([sep.join(header)] + [r if isinstance(r, str) else sep.join(r) for r in rows]) + newline)
    return path


def record(header, **values):
    full = {**RAW_DEFAULTS, **values}
    return [full.get(c.lower(), "x") for c in header]


def test_two_files_of_different_layout_give_equal_rows(spark):
    d = folder()
    values = [{"causabas": "O720", "dtobito": "05032023", "idade": "433"}, {"causabas": "O95", "codmunres": ""},
              {"sexo": "1", "racacor": " "}]
    a = write(f"{d}/DO23OPEN.csv", PUBLISHED, [record(PUBLISHED, **v) for v in values])
    b = write(f"{d}/DO24OPEN.csv", list(reversed(S.RAW_COLUMNS)), [record(list(reversed(S.RAW_COLUMNS)), **v) for v in values],
              newline="\r\n", encoding="utf-8-sig")
    both = files.read_preliminary_csv(spark, [a, b], schema=S.RAW_SCHEMA)
    assert both.columns == [*S.RAW_COLUMNS, "ano_arquivo"]
    rows = {y: sorted((tuple(r)[:-1] for r in both.where(f"ano_arquivo = {y}").collect()), key=str) for y in (2023, 2024)}
    want = sorted((tuple((v.get(c, RAW_DEFAULTS[c]).strip() or None) for c in S.RAW_COLUMNS) for v in values), key=str)
    assert rows == {2023: want, 2024: want}
    # the folder or a glob names the same files
    assert files.read_preliminary_csv(spark, d, schema=S.RAW_SCHEMA).exceptAll(both).count() == 0
    assert files.read_preliminary_csv(spark, f"{d}/DO2*.csv", schema=S.RAW_SCHEMA).count() == 6
    # without a schema: the columns of all headers
    assert set(files.read_preliminary_csv(spark, [a, b]).columns) == {c.lower() for c in PUBLISHED} | {"ano_arquivo"}


def test_missing_column_is_an_error_that_names_the_file(spark):
    d = folder()
    header = [c for c in PUBLISHED if c != "OBITOGRAV"]
    write(f"{d}/DO23OPEN.csv", PUBLISHED, [record(PUBLISHED)])
    write(f"{d}/DO24OPEN.csv", header, [record(header)])
    with pytest.raises(landing.MissingColumns, match=r"DO24OPEN.csv.*obitograv"):
        files.read_preliminary_csv(spark, d, schema=S.RAW_SCHEMA)
    found = landing.layouts(spark, d)
    assert len(found) == 2 and not landing.same_layout(*found)
    with pytest.raises(FileNotFoundError):
        landing.layouts(spark, f"{d}/nothing*")


def test_malformed_rows_are_set_aside_with_file_and_line(spark):
    d = folder()
    header = ["SEXO", "CAUSABAS", "IDADE"]
    rows = [["2", "O000", "430"], "2;O95", "", '2;"O95;430', "2;O95;430;9", ";".join(header), '2;"O;1""x";430', "   ", "1;;"]
    a = write(f"{d}/DO23OPEN.csv", header, rows)
    b = write(f"{d}/DO24OPEN.csv", header[::-1], [["430", "O000", "2"], "1"])
    write(f"{d}/DO22OPEN.csv", header, [])
    found = landing.layouts(spark, d)
    good = landing.bound_rows(spark, found, ["sexo", "causabas", "idade"])
    assert sorted((tuple(r) for r in good.collect()), key=str) == sorted([
        ("2", "O000", "430", 2023, "DO23OPEN.csv"), ("2", 'O;1"x', "430", 2023, "DO23OPEN.csv"),
        ("1", None, None, 2023, "DO23OPEN.csv"), ("2", "O000", "430", 2024, "DO24OPEN.csv")], key=str)
    bad = sorted(tuple(r) for r in landing.malformed_rows(spark, found).collect())
    assert bad == [("DO23OPEN.csv", 3, landing.SURPLUS_OR_MISSING, "2;O95"), ("DO23OPEN.csv", 5, landing.OPEN_QUOTE, '2;"O95;430'),
                   ("DO23OPEN.csv", 6, landing.SURPLUS_OR_MISSING, "2;O95;430;9"), ("DO23OPEN.csv", 7, landing.HEADER, ";".join(header)),
                   ("DO24OPEN.csv", 3, landing.SURPLUS_OR_MISSING, "1")]
    counts = {r["_arquivo"]: tuple(r)[1:] for r in landing.file_counts(spark, found).collect()}
    assert counts == {"DO23OPEN.csv": (10, 3, 4, 2), "DO24OPEN.csv": (3, 1, 1, 0), "DO22OPEN.csv": (1, 0, 0, 0)}
    assert all(n == 1 + r + m + e for n, r, m, e in counts.values())
    assert os.path.exists(a) and os.path.exists(b)


def test_line_numbers_over_many_blocks(spark):
    d = folder()
    header = ["SEXO", "CAUSABAS"]
    rows = [["2", f"O{k:03d}"] if k % 97 else "bad" for k in range(5000)]
    write(f"{d}/DO23OPEN.csv", header, rows)
    write(f"{d}/DO24OPEN.csv", header, rows[:700])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        bad = landing.malformed_rows(spark, landing.layouts(spark, d)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {("DO23OPEN.csv", k + 2) for k in range(0, 5000, 97)} | {("DO24OPEN.csv", k + 2) for k in range(0, 700, 97)}
    assert {(r["_arquivo"], r["linha"]) for r in bad} == want and len(bad) == len(want)


def test_latin_1_and_quoted_headers(spark):
    d = folder()
    write(f"{d}/DO23OPEN.csv", ['"Município"', '"SEXO"'], [["São Paulo", "2"]], encoding="latin-1")
    df = files.read_preliminary_csv(spark, d, encoding="ISO-8859-1")
    assert [tuple(r) for r in df.collect()] == [("São Paulo", "2", 2023)] and df.columns[:2] == ["municipio", "sexo"]


def test_stream_reads_by_header_and_reports_every_file(spark):
    d = folder()
    landed, out, ck = f"{d}/landing", f"{d}/marts", f"{d}/checkpoint"
    os.makedirs(landed)
    mun, codes = municipalities(spark), icd(spark, ["O000", "O95", "O720"])
    garbage = spark.createDataFrame([("O95",)], "causabas string")
    lacking = [c for c in PUBLISHED if c != "OBITOPUERP"]
    write(f"{landed}/DO23OPEN.csv", PUBLISHED, [
        record(PUBLISHED, causabas="O720", dtobito="05032023", idade="433"), "1;2", record(PUBLISHED, sexo="1")])
    write(f"{landed}/DO24OPEN_1.csv", lacking, [record(lacking, dtobito="01012024")])
    write(f"{landed}/other.csv", PUBLISHED, [record(PUBLISHED)])
    write(f"{landed}/DO25OPEN.csv", [""], [])
    open(f"{landed}/DO26OPEN.csv", "w").close()  # without a byte there is no file yet

    def refresh():
        start_refresh(spark, landed, out, ck, mun, codes, garbage).awaitTermination(600)
    refresh()
    report = {r["_arquivo"]: r for r in spark.read.parquet(f"{out}/_files/*").collect()}
    assert {k: r.status for k, r in report.items()} == {"DO23OPEN.csv": "applied", "DO24OPEN_1.csv": "rejected",
                                                       "other.csv": "rejected", "DO25OPEN.csv": "rejected"}
    assert "obitopuerp" in report["DO24OPEN_1.csv"].motivo
    r = report["DO23OPEN.csv"]
    assert (r.linhas, r.registros, r.malformados, r.vazias) == (4, 2, 1, 0)
    assert [(r["_arquivo"], r.linha, r.texto) for r in spark.read.parquet(f"{out}/_malformed/*").collect()] == [("DO23OPEN.csv", 3, "1;2")]
    om = [(r.ano, r.causabas, r.idade, r.obitos) for r in read_mart(spark, f"{out}/om").collect()]
    assert om == [(2023, "O720", 33, 1)]
    # the file lands again with the column; the rows of 2023 stay
    write(f"{landed}/DO24OPEN_2.csv", PUBLISHED, [record(PUBLISHED, dtobito="01012024")])
    refresh()
    om = sorted((r.ano, r.causabas, r.idade, r.obitos) for r in read_mart(spark, f"{out}/om").collect())
    assert om == [(2023, "O720", 33, 1), (2024, "O000", 30, 1)]
