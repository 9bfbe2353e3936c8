"""End-to-end: invariants of the marts, batch build, every query against DuckDB."""

import os
import tempfile

import duckdb
import pytest
from conftest import ROOT, SF_SMALL

from pyspark.sql import functions as F

from maternis.operators import quality
from maternis.plans import marts as M
from maternis.plans import pipeline as P
from maternis.sources.sinks import read_mart


def test_mart_invariants(spark):
    marts = P.fixture_marts(spark, "/root/testdata/sf0.01")
    for name, df in quality.invariant_violations(marts).items():
        assert df.count() == 0, name
    # OM and ONM are disjoint and female only (by construction of F1/F2)
    c = P.fixture_classified(spark, "/root/testdata/sf0.01")
    assert c.where("materno and desconsiderado").count() == 0
    assert c.where("(materno or desconsiderado) and sexo <> '2'").count() == 0


def test_state_mart_three_ways_agree(spark):
    marts = P.fixture_marts(spark, SF_SMALL)
    a = marts["uf"]
    b = M.mart_uf(marts["om"], marts["onm"])
    c = M.mart_uf_pivot(marts["om"], marts["onm"])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.exceptAll(c).count() == 0 and c.exceptAll(a).count() == 0


def test_batch_build_and_refresh(spark):
    out = tempfile.mkdtemp(prefix="maternis-test-")
    inp = P.fixture_inputs(spark, SF_SMALL)
    paths = P.run_batch(spark, inp, out)
    om = read_mart(spark, paths["om"])
    expected = P.fixture_marts(spark, SF_SMALL)["om"]
    assert om.select(*expected.columns).exceptAll(expected).count() == 0
    before = om.where("ano <= 2022").agg(F.sum("obitos")).first()[0]
    n_before = om.count()
    # refresh only the preliminary years: history untouched, preliminary replaced
    P.run_batch(spark, inp, out, years=(2023, 2024))
    om2 = read_mart(spark, paths["om"])
    assert om2.where("ano <= 2022").agg(F.sum("obitos")).first()[0] == before
    assert om2.count() == n_before


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "obitos" in df.columns


def _oracle(sf_dir):
    con = duckdb.connect()
    for t in ["region", "nation", "supplier", "orders", "lineitem", "documents", "pages"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


import __spark_entry__ as _E  # noqa: E402

_NAMES = sorted(_E.oracle_sql())


@pytest.mark.parametrize("name", _NAMES)
def test_query_matches_oracle(spark, name):
    import sys
    sys.path.insert(0, os.path.join(ROOT, "tools"))
    from check_oracle import digest, type_mismatches
    df = _E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    sql = _E.oracle_sql()[name]
    res = _oracle(SF_SMALL).execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert type_mismatches(df, res) == []
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)


def test_crosstab_cells_sum_to_margins(spark):
    from maternis.operators import crosstab as X
    from maternis.plans import report as RP
    ac = P.fixture_marts(spark, SF_SMALL)["ac"]
    p = RP.ReportParams(years=(1996, 2024), regions=("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))
    cells = {(r.variavel_linha, r.variavel_coluna): r.obitos
             for r in X.crosstab_table(ac, "racacor", "periodo_do_obito", "cell", p).collect()}
    rows = {k[0] for k in cells if k[0] != "Total"}
    cols = {k[1] for k in cells if k[1] != "Total"}
    grand = cells[("Total", "Total")]
    assert grand == sum(v for (r, c), v in cells.items() if r != "Total" and c != "Total")
    for r in rows:
        assert cells[(r, "Total")] == sum(cells.get((r, c), 0) for c in cols)
    for c in cols:
        assert cells[("Total", c)] == sum(cells.get((r, c), 0) for r in rows)
