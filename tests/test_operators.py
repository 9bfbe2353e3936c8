"""Joins, reports, roll-up, cross-tab, domains, quality and search operators."""

from conftest import SF_SMALL

from pyspark.sql import functions as F

from maternis.operators import crosstab as X
from maternis.operators import dims, domains, quality, rollup, search
from maternis.operators.joins import append, natural_full_join
from maternis.plans import report as RP

OM_SCHEMA = ("uf string, regiao string, ano int, idade int, municipio string, capitulo_cid10 string, "
             "causabas_categoria string, tipo_de_morte_materna string, periodo_do_obito string, "
             "racacor string, investigacao_cmm string, obitos long")


def _om(spark):
    rows = [
        ("N01", "Norte", 2022, 30, "Águas", "XV - Gravidez, parto e puerpério", "O00", "Direta", "P1", "Parda", "Sim", 2),
        ("N02", "Sul", 2022, 25, "Belém", "XV - Gravidez, parto e puerpério", "O00", "Indireta", "P1", "Parda", "Não", 3),
        ("N03", None, 2022, 20, "Zeta", "XV - Gravidez, parto e puerpério", "O10", "Indireta", "P2", "Preta", "Sim", 4),
        ("N03", None, 2022, 60, "Zeta", "I - Algumas doenças infecciosas e parasitárias", "A34", "Direta", "P2", "Preta", "Sim", 5),
        ("N01", "Norte", 2021, 30, "Águas", "XV - Gravidez, parto e puerpério", "O00", "Direta", "P1", None, "Sim", 7),
    ]
    return spark.createDataFrame(rows, OM_SCHEMA)


def _states(spark):
    return spark.createDataFrame([("Estado Um", "N01", "Águas"), ("Estado Dois", "N02", "Belém"),
                                  ("Estado Dois", "N02", "Abaeté")], "uf string, sigla_uf string, municipio string")


def test_natural_full_join_null_keys_match_once(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, b int")
    got = sorted((r.k or "", r.a, r.b) for r in natural_full_join(a, b).collect())
    assert got == [("", 1, 10), ("x", 2, None), ("y", None, 20)]


def test_append_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "a")], "k int, x string")
    b = spark.createDataFrame([(2,)], "k int")
    assert sorted(tuple(r) for r in append(a, b).collect()) == [(1, "a"), (2, None)]


def test_all_regions_keep_null_region_some_regions_drop(spark):
    om = _om(spark)
    all5 = RP.maternal_report(om, RP.ReportParams(year=2022, age_range=(0, 99)))
    assert all5.agg(F.sum("obitos")).first()[0] == 14
    assert {r.regiao for r in all5.collect()} == {"Todas"}
    four = RP.maternal_report(om, RP.ReportParams(year=2022, age_range=(0, 99),
                                                  regions=("Norte", "Sul", "Sudeste", "Nordeste")))
    assert four.agg(F.sum("obitos")).first()[0] == 5


def test_empty_selection_gives_zero_rows(spark):
    assert RP.maternal_report(_om(spark), RP.ReportParams(year=2022, races=())).count() == 0


def test_default_choice_excludes_null_and_age_range(spark):
    r = RP.maternal_report(_om(spark), RP.ReportParams(year=2021))
    assert r.count() == 0  # null race is never in the default choice list
    r = RP.maternal_report(_om(spark), RP.ReportParams(year=2022))
    assert r.agg(F.sum("obitos")).first()[0] == 9  # age 60 outside 10..49


def test_state_and_municipality_levels(spark):
    om, st = _om(spark), _states(spark)
    s = RP.maternal_report(om, RP.ReportParams(year=2022, level=RP.STATE, state="Estado Dois", age_range=(0, 99)), st)
    assert [(r.uf, r.obitos) for r in s.collect()] == [("N02", 3)]
    m = RP.maternal_report(om, RP.ReportParams(year=2022, level=RP.MUNICIPAL, state="Estado Um",
                                               municipality="Águas", age_range=(0, 99)), st)
    assert [(r.municipio, r.obitos) for r in m.collect()] == [("Águas", 2)]
    assert RP.report_table(m, RP.MUNICIPAL).columns == RP.OM_ATTRS + ["obitos"]


def test_exclude_external_is_exact_chapter_xx(spark):
    onm = spark.createDataFrame([
        (2022, "N01", "Norte", "XX - Causas externas de morbidade e de mortalidade", "V89", "P", "Parda", 30, "Sim", 1),
        (2022, "N01", "Norte", "XXI - Fatores", "Z32", "P", "Parda", 30, "Sim", 2),
        (2022, "N01", "Norte", None, "D49", "P", "Parda", 30, "Sim", 4)],
        "ano int, uf string, regiao string, capitulo_cid10 string, causabas_categoria string, "
        "periodo_do_obito string, racacor string, idade int, investigacao_cmm string, obitos long")
    r = RP.not_considered_report(onm, RP.ReportParams(year=2022, exclude_external=True))
    assert r.agg(F.sum("obitos")).first()[0] == 2


def test_nested_rollup_levels_and_totals(spark):
    table = RP.report_table(RP.maternal_report(_om(spark), RP.ReportParams(year=2022, age_range=(0, 99))), RP.NATIONAL)
    g = {(r.nivel, r.capitulo_cid10, r.causabas_categoria): r for r in rollup.nested_rollup(table).collect()}
    total = g[("total", "Total", None)]
    assert total.obitos == 14 and total.ocorrencias == table.count()
    ch = g[("capitulo", "XV - Gravidez, parto e puerpério", None)]
    assert ch.obitos == 9 and ch.tipo_de_morte_materna == "Direta, Indireta"
    assert g[("categoria", "XV - Gravidez, parto e puerpério", "O10")].obitos == 4
    assert ch.racacor == "Todas"


def _ac(spark):
    rows = [(2020, "Norte", "N01", "Parda", 30, "Sim", None), (2020, "Norte", "N01", "Parda", 30, "Sim", "A"),
            (2021, "Norte", "N01", "Preta", 30, "Sim", "A"), (2021, "Sul", "N02", "Parda", 30, "Não", "B"),
            (2021, None, "N03", "Parda", 30, "Sim", "B")]
    return spark.createDataFrame(rows, "ano int, regiao string, uf string, racacor string, idade int, "
                                       "investigacao_cmm string, est_civil string")


def test_crosstab_margins_and_percentages(spark):
    p = RP.ReportParams(years=(2020, 2021), regions=("Norte", "Sul", "Sudeste", "Nordeste", "Centro-Oeste"))
    t = {(r.variavel_linha, r.variavel_coluna): (r.obitos, r.percentual)
         for r in X.crosstab_table(_ac(spark), "est_civil", "ano", "column", p).collect()}
    # the null region row is dropped even with all five regions chosen
    assert t[("Total", "Total")] == (4, 100.0)
    assert t[("Unknown", "2020")] == (1, 50.0)
    assert t[("A", "2021")] == (1, 50.0)
    row = {(r.variavel_linha, r.variavel_coluna): r.percentual
           for r in X.crosstab_table(_ac(spark), "est_civil", "ano", "row", p).collect()}
    assert row[("A", "2020")] == 50.0 and row[("Total", "2021")] == 50.0
    cell = {(r.variavel_linha, r.variavel_coluna): r.percentual
            for r in X.crosstab_table(_ac(spark), "est_civil", "ano", "cell", p).collect()}
    assert cell[("B", "2021")] == 25.0 and cell[("Total", "Total")] == 100.0
    # committee filter applies to the table, not to the chart
    p2 = RP.ReportParams(years=(2020, 2021), regions=p.regions, committee=("Sim",))
    assert X.crosstab_table(_ac(spark), "est_civil", "ano", "cell", p2).where(
        "variavel_linha = 'Total' and variavel_coluna = 'Total'").first().obitos == 3
    assert X.crosstab_long(_ac(spark), "est_civil", "ano", p2).agg(F.sum("obitos")).first()[0] == 4


def test_crosstab_same_variable_and_validation(spark):
    p = RP.ReportParams(years=(2020, 2021), level=RP.NATIONAL)
    diag = X.crosstab_long(_ac(spark), "racacor", "racacor", p).collect()
    assert all(r.variavel_linha == r.variavel_coluna for r in diag)
    import pytest
    with pytest.raises(ValueError):
        X.check_variable("uf", RP.STATE)


def test_domains(spark):
    om = _om(spark)
    assert [r.municipio for r in domains.facet_domain(om, "municipio").collect()] == ["Águas", "Belém", "Zeta"]
    assert tuple(domains.year_bounds(om).first()) == (2021, 2022)
    assert [r.municipio for r in domains.municipalities_of_state(_states(spark), "Estado Dois").collect()] == [
        "Abaeté", "Belém"]
    assert domains.series_count(om, "regiao").first().n_series == 3


def test_quality(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1)], "x string, y int")
    assert [(r.x, r.dupe_count) for r in quality.dupes(df).collect()] == [("a", 2)]
    assert [(r.x, r.dupe_count) for r in quality.dupes(df).collect()] == [("a", 2)]
    assert quality.null_audit(df).count() == 2


def test_search(spark):
    om = _om(spark)
    assert search.search_any(om, "PARDA").count() == 2
    assert search.search_any(om, "águas").count() == 2
    assert search.filter_contains(om, "tipo_de_morte_materna", "ireta").count() == 5
    assert search.filter_contains(om, "tipo_de_morte_materna", "Ireta").count() == 0


def test_interval_join_narrowest(spark):
    from maternis.sources import fixtures as FX
    keys = spark.createDataFrame([("A34",), ("B249",), ("O000",), ("D49",), ("U071",)], "causabas string")
    m = dims.interval_matches(keys, "causabas", FX.nested_intervals(spark))
    n = {r.causabas: r.DESCRICAO for r in dims.narrowest_interval(m, "causabas").collect()}
    assert n["A34"] == "Dezena A30-A39" and n["B249"] == "Dezena B20-B29"
    every = {(r.causabas, r.DESCRICAO.split(" ")[0]) for r in m.collect()}
    assert {("A34", "Bloco"), ("A34", "Dezena")} < every and sum(k == "A34" for k, _ in every) == 3
    # overlapping chapters never multiply a cause
    twice = spark.createDataFrame([("A00", "B99", "wide"), ("A30", "A39", "narrow")], "CATINIC string, CATFIM string, DESCRICAO string")
    assert {r.causabas: r.capitulo_cid10 for r in dims.icd_dimension(keys, twice).collect()} == {
        "A34": "narrow", "B249": "wide", "O000": None, "D49": None, "U071": None}
    assert n["O000"].startswith("XV ") and n["U071"].startswith("XXII ")
    assert "D49" not in n  # gap between chapters II (to D48) and III (from D50)


def test_bounded_broadcast_falls_back(spark):
    big = spark.range(50)
    assert not dims.fits(big, 10)
    assert dims.fits(big, 50)
    plan = big.join(dims.bounded_broadcast(spark.range(5)), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan


def test_small_helpers(spark):
    from maternis.functions.recode import harmonise_marital
    df = spark.createDataFrame([("Solteiro",), ("Casada",), ("União Estável",), (None,)], "est_civil string")
    assert [r[0] for r in df.select(harmonise_marital()).collect()] == ["Solteira", "Casada", "União Estável", None]
    assert rollup.grand_total(_om(spark)).first().obitos == 21
    assert rollup.grand_total(_om(spark).limit(0)).first().obitos == 0
    assert X.variable_label("capitulo_cid10") == "Capítulo da CID-10"
