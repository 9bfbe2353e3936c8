"""

Every query reads the benchmark tables (certificates derived from
``lineitem``; dimensions from ``supplier``/``nation``/``region``; ``orders``;
``documents``) and runs over the whole tables. Each of the reference's own
operators has an independent DuckDB oracle in ``oracle_sql()``; the training-data
operators of ``maternis.llm`` are tested against brute force.
"""

from __future__ import annotations

import os
import sys
import warnings
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from maternis import schema as S  # noqa: E402
from maternis.functions import classify as C  # noqa: E402
from maternis.functions import recode as R  # noqa: E402
from maternis.operators import crosstab as X  # noqa: E402
from maternis.operators import dims, domains, quality, rollup, search  # noqa: E402
from maternis.operators.joins import append, natural_full_join  # noqa: E402
from maternis.plans import landed as LD  # noqa: E402
from maternis.plans import marts as M  # noqa: E402
from maternis.plans import pipeline as P  # noqa: E402
from maternis.plans import report as RP  # noqa: E402
from maternis.plans.classify import derive_stage, recode_stage  # noqa: E402
from maternis.sources import files  # noqa: E402
from maternis.sources import fixtures as FX  # noqa: E402
from maternis.sources import publication as PUB  # noqa: E402

import sql_oracle as O  # noqa: E402

# The training-data operators and their pipeline are optional parts: without them, or without a
# library that only they need, the other queries still load.
try:
    import maternis.llm.queries as LLM
except ImportError as e:
    warnings.warn(f"without the training-data queries: {e}", stacklevel=1)
    LLM = None
try:
    import corpus_pipeline as PIPELINE
except ImportError as e:
    warnings.warn(f"without the pipeline query: {e}", stacklevel=1)
    PIPELINE = None

SMOKE_DIR = "/root/testdata/sf0.001"

# Report parameters used by the registered queries.
YEAR = 2022
SOME_REGIONS = ("AMERICA", "ASIA")
ALL_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
STATE = "NATION_20"
MUNICIPALITY = "Supplier#000000001"
ONM_STATE = "NATION_11"
GC_YEAR = 2022
AC_YEARS = (2015, 2024)
# Columns of the per-death mart on which different deaths coincide.
AC_PROFILE = ("ano", "uf", "racacor", "escolaridade", "periodo_do_obito")


# ---------------------------------------------------------------------------
# helpers
# ---------------------------------------------------------------------------
RAW_KEPT = ("causabas", "obitograv", "obitopuerp", "idade", "racacor", "necropsia")


def _staged(spark: SparkSession, sf: str) -> DataFrame:
    """Every certificate after the recode and derive stages (raw codes kept as cod_*)."""
    raw = FX.sim_raw(spark, sf)
    raw = raw.select(*raw.columns, *[F.col(c).alias(f"cod_{c}") for c in RAW_KEPT])
    return derive_stage(recode_stage(raw))


def _counts(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return _staged(spark, sf).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def _marts(spark, sf):
    return P.fixture_marts(spark, sf)


def _om_national(spark, sf):
    return RP.maternal_report(_marts(spark, sf)["om"], RP.ReportParams(year=YEAR))


def _om_table(spark, sf):
    return RP.report_table(_om_national(spark, sf), RP.NATIONAL)


def _ac_params(level=RP.NATIONAL, regions=ALL_REGIONS):
    return RP.ReportParams(years=AC_YEARS, level=level, regions=regions)


def _numbered_uf_table(spark, sf):
    """The state display table, most maternal deaths first, with the place of each row: one row a state."""
    table = RP.sorted_table(RP.uf_table(RP.uf_report(_marts(spark, sf)["uf"], YEAR)), ("obitos_maternos", "uf"),
                            descending=("obitos_maternos",))
    place = F.row_number().over(Window.orderBy(F.col("obitos_maternos").desc_nulls_last(), F.col("uf").asc_nulls_last(),
                                               F.col("regiao").asc_nulls_last()))
    return table.withColumn("posicao", place.cast("long"))


def _values(df):
    """``coluna, valor, linhas`` of the columns of a table."""
    return PUB.value_counts(df.withColumn("ano_arquivo", F.lit(0))).drop("ano_arquivo")


def _sums_by_state_and_race(spark, sf, mart, name):
    return _marts(spark, sf)[mart].groupBy("uf", "racacor").agg(F.sum("obitos").alias(name))


def _types_in_order(spark, sf):
    rows = _marts(spark, sf)["om"].withColumn("codigo", F.coalesce("codigo", F.lit("")))
    return rollup.values_in_order(rows, ["capitulo_cid10"], "tipo_de_morte_materna", ["codigo", "ano", "causabas"])


def _crosstab_long(spark, sf):
    return X.crosstab_long(_marts(spark, sf)["ac"], "racacor", "ano", _ac_params())


def _icd_causes(spark, sf):
    return FX.sim_raw(spark, sf).select(R.recode_cause("causabas").alias("causabas"))


# ---------------------------------------------------------------------------
# contract
# ---------------------------------------------------------------------------
def entry(spark: SparkSession) -> DataFrame:
    """Flagship: national report of official maternal deaths, 2022, ages 10-49."""
    return _om_national(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        # recodes (every certificate)
        "recode_age_year": lambda s, d: _counts(s, d, "ano", "cod_idade", "idade", "obito_em_idade_fertil"),
        "recode_race": lambda s, d: _counts(s, d, "cod_racacor", "racacor"),
        "recode_marital_era": lambda s, d: _counts(s, d, "era", "estciv", "est_civil"),
        "recode_place": lambda s, d: _counts(s, d, "lococor", "local_ocorrencia_obito"),
        "recode_assist": lambda s, d: _counts(s, d, "assistmed", "assistencia_med"),
        "recode_necropsy": lambda s, d: _counts(s, d, "cod_necropsia", "necropsia"),
        "recode_schooling_era": lambda s, d: _counts(s, d, "ano_arquivo", "esc2010", "escolaridade"),
        "recode_cmm_era": lambda s, d: _counts(s, d, "ano_arquivo", "fonteinv", "investigacao_cmm"),
        "fill_codes_era": lambda s, d: _counts(s, d, "era", "cod_causabas", "causabas", "cod_obitograv",
                                               "obitograv", "cod_obitopuerp", "obitopuerp"),
        "maternal_type": lambda s, d: _counts(s, d, "causabas", "tipo_de_morte_materna"),
        "death_period": lambda s, d: _counts(s, d, "era", "obitograv", "obitopuerp", "periodo_do_obito"),
        # marts
        "mart_om": lambda s, d: _marts(s, d)["om"],
        "mart_gc": lambda s, d: _marts(s, d)["gc"],
        "mart_ac": lambda s, d: _marts(s, d)["ac"],
        "mart_onm": lambda s, d: _marts(s, d)["onm"],
        "mart_uf": lambda s, d: _marts(s, d)["uf"],
        "mart_uf_pivot": lambda s, d: M.mart_uf_pivot(_marts(s, d)["om"], _marts(s, d)["onm"]),
        "mart_uf_from_marts": lambda s, d: M.mart_uf(_marts(s, d)["om"], _marts(s, d)["onm"]),
        # merge of history and preliminary marts
        "append_history_prelim": lambda s, d: append(P.era_marts(s, d, S.HISTORY)["om"],
                                                     P.era_marts(s, d, S.PRELIMINARY)["om"]),
        "natural_full_join": lambda s, d: natural_full_join(P.era_marts(s, d, S.HISTORY)["om"],
                                                            P.era_marts(s, d, S.PRELIMINARY)["om"]),
        "natural_full_join_overlap": lambda s, d: natural_full_join(
            _sums_by_state_and_race(s, d, "om", "obitos_maternos"),
            _sums_by_state_and_race(s, d, "onm", "obitos_desconsiderados"), ["uf", "racacor"]),
        # landed files, refreshes and publication
        "landed_parquet_years": LD.landed_years,
        "landed_csv_by_header": LD.landed_csv,
        "refresh_union": LD.refresh_union,
        "published_om": lambda s, d: LD.published(s, d).mart("om"),
        "published_uf_csv": LD.published_csv,
        # ICD interval joins
        "icd_chapter": lambda s, d: dims.icd_dimension(_icd_causes(s, d), files.chapters_frame(s)),
        "icd_groups_all": lambda s, d: dims.interval_matches(
            _icd_causes(s, d).distinct(), "causabas", FX.nested_intervals(s)),
        "icd_group_narrowest": lambda s, d: dims.narrowest_interval(dims.interval_matches(
            _icd_causes(s, d).distinct(), "causabas", FX.nested_intervals(s)), "causabas"),
        # reports
        "report_om_nacional_all": _om_national,
        "report_om_regions": lambda s, d: RP.maternal_report(
            _marts(s, d)["om"], RP.ReportParams(year=YEAR, regions=SOME_REGIONS)),
        "report_om_state": lambda s, d: RP.maternal_report(
            _marts(s, d)["om"], RP.ReportParams(year=YEAR, level=RP.STATE, state=STATE), FX.state_lookup(s, d)),
        "report_om_municipality": lambda s, d: RP.maternal_report(
            _marts(s, d)["om"], RP.ReportParams(year=YEAR, level=RP.MUNICIPAL, state=STATE,
                                                municipality=MUNICIPALITY), FX.state_lookup(s, d)),
        "report_gc_state": lambda s, d: RP.maternal_report(
            _marts(s, d)["gc"], RP.ReportParams(year=YEAR, level=RP.STATE, state=STATE), FX.state_lookup(s, d)),
        "report_onm_nacional_noext": lambda s, d: RP.not_considered_report(
            _marts(s, d)["onm"], RP.ReportParams(year=YEAR, exclude_external=True)),
        "report_onm_state": lambda s, d: RP.not_considered_report(
            _marts(s, d)["onm"], RP.ReportParams(year=YEAR, level=RP.STATE, state=ONM_STATE), FX.state_lookup(s, d)),
        "report_gc_nacional_all": lambda s, d: RP.maternal_report(_marts(s, d)["gc"], RP.ReportParams(year=YEAR)),
        "report_gc_regions": lambda s, d: RP.maternal_report(
            _marts(s, d)["gc"], RP.ReportParams(year=YEAR, regions=SOME_REGIONS)),
        "report_gc_municipality": lambda s, d: RP.maternal_report(
            _marts(s, d)["gc"], RP.ReportParams(year=GC_YEAR, level=RP.MUNICIPAL, state=STATE,
                                                municipality=MUNICIPALITY), FX.state_lookup(s, d)),
        "report_onm_regions": lambda s, d: RP.not_considered_report(
            _marts(s, d)["onm"], RP.ReportParams(year=YEAR, regions=SOME_REGIONS)),
        "report_onm_municipality": lambda s, d: RP.not_considered_report(
            _marts(s, d)["onm"], RP.ReportParams(year=YEAR, level=RP.MUNICIPAL, state=STATE,
                                                 municipality=MUNICIPALITY), FX.state_lookup(s, d)),
        # municipalities and years that have rows (at the scales whose state has the municipality)
        "report_onm_municipality_2024": lambda s, d: RP.not_considered_report(
            _marts(s, d)["onm"], RP.ReportParams(year=2024, level=RP.MUNICIPAL, state="NATION_11",
                                                 municipality="Supplier#000000004"), FX.state_lookup(s, d)),
        "report_gc_municipality_2024": lambda s, d: RP.maternal_report(
            _marts(s, d)["gc"], RP.ReportParams(year=2024, level=RP.MUNICIPAL, state="NATION_1",
                                                municipality="Supplier#000000008"), FX.state_lookup(s, d)),
        "crosstab_municipal_level": lambda s, d: X.crosstab_long(
            _marts(s, d)["ac"], "racacor", "escolaridade",
            RP.ReportParams(years=AC_YEARS, level=RP.MUNICIPAL, state=STATE, municipality=MUNICIPALITY),
            FX.state_lookup(s, d)),
        "uf_table_sorted": lambda s, d: _numbered_uf_table(s, d),
        "report_uf": lambda s, d: RP.uf_report(_marts(s, d)["uf"], YEAR),
        "nested_rollup": lambda s, d: rollup.nested_rollup(_om_table(s, d)),
        "tree_rollup": lambda s, d: rollup.tree_rollup(_marts(s, d)["om"], dims.interval_tree(FX.nested_intervals(s))),
        "types_in_order": _types_in_order,
        # cross analysis
        "crosstab_long": _crosstab_long,
        "crosstab_pct_column": lambda s, d: X.crosstab_table(_marts(s, d)["ac"], "racacor", "ano", "column",
                                                             _ac_params()),
        "crosstab_pct_row": lambda s, d: X.crosstab_table(_marts(s, d)["ac"], "escolaridade", "periodo_do_obito",
                                                          "row", _ac_params()),
        "crosstab_pct_cell": lambda s, d: X.crosstab_table(_marts(s, d)["ac"], "est_civil", "capitulo_cid10",
                                                           "cell", _ac_params(regions=SOME_REGIONS)),
        "crosstab_state_level": lambda s, d: X.crosstab_table(
            _marts(s, d)["ac"], "escolaridade", "ano", "column",
            RP.ReportParams(years=AC_YEARS, level=RP.STATE, state=STATE), FX.state_lookup(s, d)),
        "crosstab_regional_level": lambda s, d: X.crosstab_long(
            _marts(s, d)["ac"], "necropsia", "assistencia_med",
            RP.ReportParams(years=AC_YEARS, level=RP.REGIONAL, region="ASIA")),
        "report_om_regions_table": lambda s, d: RP.report_table(RP.maternal_report(
            _marts(s, d)["om"], RP.ReportParams(year=YEAR, regions=SOME_REGIONS)), RP.NATIONAL),
        "crosstab_display_column": lambda s, d: X.crosstab_display(X.crosstab_table(
            _marts(s, d)["ac"], "racacor", "ano", "column", _ac_params())),
        # domains
        "facet_domain": lambda s, d: domains.facet_domain(_marts(s, d)["om"], "racacor"),
        "year_bounds": lambda s, d: domains.year_bounds(_marts(s, d)["om"]),
        "municipalities_of_state": lambda s, d: domains.municipalities_of_state(FX.state_lookup(s, d), STATE),
        "series_count": lambda s, d: domains.series_count(_crosstab_long(s, d), "variavel_coluna"),
        # quality
        "dupes_documents": lambda s, d: quality.dupes(FX.table(s, d, "documents").select("text")),
        "dupes_om": lambda s, d: quality.dupes(_marts(s, d)["ac"].select(*AC_PROFILE)),
        "dupe_rows_documents": lambda s, d: quality.duplicate_rows(FX.table(s, d, "documents").select("doc_id", "text"), ["text"]),
        "dupe_rows_ac": lambda s, d: quality.duplicate_rows(_marts(s, d)["ac"].select("codigo", *AC_PROFILE), list(AC_PROFILE)),
        "null_audit": lambda s, d: quality.null_audit(_marts(s, d)["ac"]),
        "control_totals": lambda s, d: quality.control_totals(_marts(s, d)["om"], _marts(s, d)["ac"]),
        # table search and formatting
        "search_any": lambda s, d: search.search_any(_om_table(s, d), "parda"),
        "search_values": lambda s, d: search.search_values(_om_table(s, d), _values(_om_table(s, d)), "parda"),
        "facet_values": lambda s, d: _values(_marts(s, d)["om"]),
        "filter_column": lambda s, d: search.filter_column(_om_table(s, d), "tipo_de_morte_materna", "DIRETA"),
        "filter_contains": lambda s, d: search.filter_contains(_om_table(s, d), "tipo_de_morte_materna", "ireta"),
        "long_date_pt": lambda s, d: FX.table(s, d, "orders").select(
            "o_orderkey", C.long_date_pt("o_orderdate").alias("data_por_extenso")),
    }
    if LLM:
        q |= LLM.QUERIES
    if PIPELINE:
        q["pipeline"] = PIPELINE.run
    return q


def _counts_sql(*cols: str) -> str:
    c = ", ".join(cols)
    return O.with_base(f"SELECT {c}, COUNT(*) AS n FROM s2 GROUP BY {c}")


def oracle_sql() -> dict[str, str]:
    W = O.with_base
    om_table_cols = O.OM_ATTRS + ", obitos"
    om_nat = O.report_sql("om", "all", YEAR, O.OM_ATTRS, O.COMMON_OM)
    om_table = f"SELECT {om_table_cols} FROM ({O.report_select('om', 'all', YEAR, O.OM_ATTRS, O.COMMON_OM)})"
    intervals = ", ".join(
        f"({O._q(lo)}, {O._q(hi)}, {O._q(lbl)})"
        for lo, hi, lbl in S.ICD_CHAPTERS + FX.letter_blocks(S.ICD_CHAPTERS)
        + FX.decade_blocks(FX.letter_blocks(S.ICD_CHAPTERS)))
    groups_all = f"""
iv("CATINIC", "CATFIM", "DESCRICAO") AS (VALUES {intervals}),
causes AS (SELECT DISTINCT CASE WHEN causabas IN ('O935', 'O937') THEN 'O95' ELSE causabas END AS causabas
           FROM sim_raw),
gm AS (
  SELECT k.causabas, substr(k.causabas, 1, 3) AS categoria, iv."CATINIC", iv."CATFIM", iv."DESCRICAO",
         ((ascii(substr(iv."CATFIM", 1, 1)) - 65) * 100 + CAST(substr(iv."CATFIM", 2, 2) AS INTEGER))
       - ((ascii(substr(iv."CATINIC", 1, 1)) - 65) * 100 + CAST(substr(iv."CATINIC", 2, 2) AS INTEGER)) AS largura
  FROM causes k JOIN iv ON substr(k.causabas, 1, 3) BETWEEN iv."CATINIC" AND iv."CATFIM"
  WHERE k.causabas IS NOT NULL
)"""
    tree = groups_all.split("causes AS")[0] + """
nodes AS (SELECT "CATINIC" || '-' || "CATFIM" AS no, *, (ascii("CATINIC") - 65) * 100 + CAST(substr("CATINIC", 2) AS INTEGER) AS lo,
          (ascii("CATFIM") - 65) * 100 + CAST(substr("CATFIM", 2) AS INTEGER) AS hi FROM iv),
placed AS (SELECT a.*, row_number() OVER (ORDER BY a.lo, a.hi DESC) AS ordem,
    (SELECT b.no FROM nodes b WHERE b.lo <= a.lo AND b.hi >= a.hi AND b.no <> a.no ORDER BY b.hi - b.lo, b.no LIMIT 1) AS pai,
    (SELECT COUNT(*) FROM nodes b WHERE b.lo <= a.lo AND b.hi >= a.hi AND b.no <> a.no) AS profundidade,
    (SELECT SUM(m.obitos) FROM om m WHERE m.causabas_categoria BETWEEN a."CATINIC" AND a."CATFIM") AS obitos FROM nodes a)"""
    months = O._list(S.MONTHS_PT)
    uf_cols = ", ".join(S.UF_COLUMNS)
    search_cols = [c.strip() for c in om_table_cols.split(",")]
    search_cond = " OR ".join(f"COALESCE(contains(lower(CAST({c} AS VARCHAR)), 'parda'), false)" for c in search_cols)
    sql = {
        "recode_age_year": _counts_sql("ano", "cod_idade", "idade", "obito_em_idade_fertil"),
        "recode_race": _counts_sql("cod_racacor", "racacor"),
        "recode_marital_era": _counts_sql("era", "estciv", "est_civil"),
        "recode_place": _counts_sql("lococor", "local_ocorrencia_obito"),
        "recode_assist": _counts_sql("assistmed", "assistencia_med"),
        "recode_necropsy": _counts_sql("cod_necropsia", "necropsia"),
        "recode_schooling_era": _counts_sql("ano_arquivo", "esc2010", "escolaridade"),
        "recode_cmm_era": _counts_sql("ano_arquivo", "fonteinv", "investigacao_cmm"),
        "fill_codes_era": _counts_sql("era", "cod_causabas", "causabas", "cod_obitograv", "obitograv",
                                      "cod_obitopuerp", "obitopuerp"),
        "maternal_type": _counts_sql("causabas", "tipo_de_morte_materna"),
        "death_period": _counts_sql("era", "obitograv", "obitopuerp", "periodo_do_obito"),
        "mart_om": W("SELECT * FROM om"),
        "mart_gc": W("SELECT * FROM gc"),
        "mart_ac": W("SELECT * FROM ac"),
        "mart_onm": W("SELECT * FROM onm"),
        "mart_uf": W(f"SELECT {uf_cols} FROM uf_mart"),
        "mart_uf_pivot": W(f"SELECT {uf_cols} FROM uf_mart"),
        "mart_uf_from_marts": W(f"SELECT {uf_cols} FROM uf_mart"),
        "append_history_prelim": W("SELECT * FROM om WHERE ano <= 2022 UNION ALL SELECT * FROM om WHERE ano >= 2023"),
        "natural_full_join": W(
            "SELECT COALESCE(h.codigo, p.codigo) AS codigo, COALESCE(h.municipio, p.municipio) AS municipio, "
            "COALESCE(h.uf, p.uf) AS uf, COALESCE(h.regiao, p.regiao) AS regiao, COALESCE(h.ano, p.ano) AS ano, "
            "COALESCE(h.causabas, p.causabas) AS causabas, "
            "COALESCE(h.causabas_categoria, p.causabas_categoria) AS causabas_categoria, "
            "COALESCE(h.capitulo_cid10, p.capitulo_cid10) AS capitulo_cid10, "
            "COALESCE(h.tipo_de_morte_materna, p.tipo_de_morte_materna) AS tipo_de_morte_materna, "
            "COALESCE(h.periodo_do_obito, p.periodo_do_obito) AS periodo_do_obito, "
            "COALESCE(h.investigacao_cmm, p.investigacao_cmm) AS investigacao_cmm, "
            "COALESCE(h.racacor, p.racacor) AS racacor, COALESCE(h.idade, p.idade) AS idade, "
            "COALESCE(h.obitos, p.obitos) AS obitos "
            "FROM (SELECT * FROM om WHERE ano <= 2022) h FULL OUTER JOIN (SELECT * FROM om WHERE ano >= 2023) p "
            "ON h.codigo IS NOT DISTINCT FROM p.codigo AND h.municipio IS NOT DISTINCT FROM p.municipio "
            "AND h.uf IS NOT DISTINCT FROM p.uf AND h.regiao IS NOT DISTINCT FROM p.regiao "
            "AND h.ano IS NOT DISTINCT FROM p.ano AND h.causabas IS NOT DISTINCT FROM p.causabas "
            "AND h.causabas_categoria IS NOT DISTINCT FROM p.causabas_categoria "
            "AND h.capitulo_cid10 IS NOT DISTINCT FROM p.capitulo_cid10 "
            "AND h.tipo_de_morte_materna IS NOT DISTINCT FROM p.tipo_de_morte_materna "
            "AND h.periodo_do_obito IS NOT DISTINCT FROM p.periodo_do_obito "
            "AND h.investigacao_cmm IS NOT DISTINCT FROM p.investigacao_cmm "
            "AND h.racacor IS NOT DISTINCT FROM p.racacor AND h.idade IS NOT DISTINCT FROM p.idade "
            "AND h.obitos IS NOT DISTINCT FROM p.obitos"),
        "natural_full_join_overlap": W(
            "SELECT COALESCE(a.uf, b.uf) AS uf, COALESCE(a.racacor, b.racacor) AS racacor, a.obitos_maternos, b.obitos_desconsiderados "
            "FROM (SELECT uf, racacor, CAST(SUM(obitos) AS BIGINT) AS obitos_maternos FROM om GROUP BY uf, racacor) a FULL OUTER JOIN "
            "(SELECT uf, racacor, CAST(SUM(obitos) AS BIGINT) AS obitos_desconsiderados FROM onm GROUP BY uf, racacor) b "
            "ON a.uf IS NOT DISTINCT FROM b.uf AND a.racacor IS NOT DISTINCT FROM b.racacor"),
        "landed_parquet_years": W(
            "SELECT ano_arquivo, sexo, COUNT(*) AS n FROM sim_raw WHERE ano_arquivo BETWEEN 2015 AND 2024 GROUP BY ALL"),
        "landed_csv_by_header": W(
            f"SELECT {', '.join(S.RAW_COLUMNS)}, ano_arquivo, COUNT(*) AS n FROM sim_raw WHERE ano_arquivo >= 2023 GROUP BY ALL"),
        "refresh_union": W("SELECT * FROM om").replace(
            O.FILE_YEAR, "CAST(1996 + (l_orderkey + l_suppkey) % 29 + CASE WHEN l_suppkey % 20 <> 0 AND l_suppkey % 7 = 0 THEN 1 ELSE 0 END "
            "AS INTEGER) AS ano_arquivo"),
        "published_om": W("SELECT * FROM om"),
        "published_uf_csv": W(f"SELECT {uf_cols} FROM uf_mart"),
        "icd_chapter": W(
            "SELECT k.causabas, substr(k.causabas, 1, 3) AS causabas_categoria, ch.label AS capitulo_cid10 "
            "FROM (SELECT DISTINCT CASE WHEN causabas IN ('O935', 'O937') THEN 'O95' ELSE causabas END AS causabas "
            "FROM sim_raw) k LEFT JOIN chapters ch ON substr(k.causabas, 1, 3) BETWEEN ch.lo AND ch.hi "
            "WHERE k.causabas IS NOT NULL"),
        "icd_groups_all": W("SELECT * FROM gm", groups_all),
        "icd_group_narrowest": W(
            "SELECT causabas, categoria, \"CATINIC\", \"CATFIM\", \"DESCRICAO\", largura FROM ("
            "SELECT *, row_number() OVER (PARTITION BY causabas ORDER BY largura ASC, \"CATINIC\" DESC) AS rn "
            "FROM gm) WHERE rn = 1", groups_all),
        "report_om_nacional_all": om_nat,
        "report_om_regions": O.report_sql("om", "regions", YEAR, O.OM_ATTRS, O.COMMON_OM, regions=SOME_REGIONS),
        "report_om_state": O.report_sql("om", "state", YEAR, O.OM_ATTRS, O.COMMON_OM, state=STATE),
        "report_om_municipality": O.report_sql("om", "municipality", YEAR, O.OM_ATTRS, O.COMMON_OM, state=STATE,
                                               municipality=MUNICIPALITY),
        "report_gc_state": O.report_sql("gc", "state", YEAR, O.OM_ATTRS, O.COMMON_OM, state=STATE),
        "report_onm_nacional_noext": O.report_sql(
            "onm", "all", YEAR, O.ONM_ATTRS, O.COMMON_ONM,
            extra_where=f" AND capitulo_cid10 <> {O._q(S.EXTERNAL_CHAPTER)}"),
        "report_onm_state": O.report_sql("onm", "state", YEAR, O.ONM_ATTRS, O.COMMON_ONM, state=ONM_STATE),
        "report_gc_nacional_all": O.report_sql("gc", "all", YEAR, O.OM_ATTRS, O.COMMON_OM),
        "report_gc_regions": O.report_sql("gc", "regions", YEAR, O.OM_ATTRS, O.COMMON_OM, regions=SOME_REGIONS),
        "report_gc_municipality": O.report_sql("gc", "municipality", GC_YEAR, O.OM_ATTRS, O.COMMON_OM, state=STATE,
                                               municipality=MUNICIPALITY),
        "report_onm_regions": O.report_sql("onm", "regions", YEAR, O.ONM_ATTRS, O.COMMON_ONM, regions=SOME_REGIONS),
        "report_onm_municipality": O.report_sql("onm", "municipality", YEAR, O.ONM_ATTRS, O.COMMON_ONM, state=STATE,
                                                municipality=MUNICIPALITY),
        "report_onm_municipality_2024": O.report_sql("onm", "municipality", 2024, O.ONM_ATTRS, O.COMMON_ONM, state="NATION_11",
                                                     municipality="Supplier#000000004"),
        "report_gc_municipality_2024": O.report_sql("gc", "municipality", 2024, O.OM_ATTRS, O.COMMON_OM, state="NATION_1",
                                                    municipality="Supplier#000000008"),
        "crosstab_municipal_level": W(
            "SELECT racacor AS variavel_linha, escolaridade AS variavel_coluna, COUNT(*) AS obitos FROM ac "
            f"WHERE ano BETWEEN {AC_YEARS[0]} AND {AC_YEARS[1]} AND racacor IS NOT NULL AND idade BETWEEN 10 AND 49 "
            f"AND municipio = {O._q(MUNICIPALITY)} AND {O.state_in(STATE)} GROUP BY ALL"),
        "uf_table_sorted": W(
            "SELECT *, row_number() OVER (ORDER BY obitos_maternos DESC NULLS LAST, uf ASC NULLS LAST, regiao ASC NULLS LAST) "
            "AS posicao FROM (SELECT uf, regiao, "
            + ", ".join(f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in S.UF_COUNT_COLUMNS)
            + f" FROM uf_mart WHERE ano = {YEAR} AND idade BETWEEN 10 AND 49 GROUP BY uf, regiao)"),
        "report_uf": W(
            "SELECT uf, regiao, ano, " + ", ".join(f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in S.UF_COUNT_COLUMNS)
            + f" FROM uf_mart WHERE ano = {YEAR} AND idade BETWEEN 10 AND 49 GROUP BY uf, regiao, ano"),
        "nested_rollup": W(
            "SELECT CASE GROUPING_ID(capitulo_cid10, causabas_categoria) WHEN 0 THEN 'categoria' "
            "WHEN 1 THEN 'capitulo' ELSE 'total' END AS nivel, "
            "CASE WHEN GROUPING_ID(capitulo_cid10, causabas_categoria) = 3 THEN 'Total' ELSE capitulo_cid10 END "
            "AS capitulo_cid10, causabas_categoria, COUNT(*) AS ocorrencias, CAST(SUM(obitos) AS BIGINT) AS obitos, "
            "string_agg(DISTINCT tipo_de_morte_materna, ', ' ORDER BY tipo_de_morte_materna) AS tipo_de_morte_materna, "
            "'Todos' AS periodo_do_obito, 'Todas' AS racacor, 'Todas as categorias' AS investigacao_cmm "
            "FROM rt GROUP BY ROLLUP (capitulo_cid10, causabas_categoria)",
            f"rt AS ({om_table})"),
        "tree_rollup": W(
            "SELECT no, pai, CAST(profundidade AS INTEGER) AS profundidade, CAST(ordem AS INTEGER) AS ordem, \"CATINIC\", \"CATFIM\", "
            "\"DESCRICAO\", CAST(COALESCE(obitos, 0) AS BIGINT) AS obitos, "
            "CAST(COALESCE(obitos, 0) - COALESCE(dos_filhos, 0) AS BIGINT) AS obitos_proprios FROM placed "
            "LEFT JOIN (SELECT pai AS p, SUM(obitos) AS dos_filhos FROM placed GROUP BY pai) ON p = no", tree),
        "types_in_order": W(
            "SELECT capitulo_cid10, string_agg(tipo_de_morte_materna, ', ' ORDER BY pos) AS tipo_de_morte_materna FROM ("
            "SELECT capitulo_cid10, tipo_de_morte_materna, MIN(pos) AS pos FROM (SELECT *, row_number() OVER (ORDER BY "
            "COALESCE(codigo, ''), ano NULLS FIRST, causabas NULLS FIRST) AS pos FROM om) WHERE tipo_de_morte_materna IS NOT NULL "
            "GROUP BY ALL) GROUP BY capitulo_cid10"),
        "crosstab_long": W(
            "SELECT racacor AS variavel_linha, ano AS variavel_coluna, COUNT(*) AS obitos FROM ac "
            f"WHERE ano BETWEEN {AC_YEARS[0]} AND {AC_YEARS[1]} AND racacor IS NOT NULL AND idade BETWEEN 10 AND 49 "
            f"AND regiao IN ({', '.join(O._q(r) for r in ALL_REGIONS)}) GROUP BY ALL"),
        "crosstab_pct_column": O.crosstab_sql("racacor", "ano", "column", AC_YEARS, ALL_REGIONS),
        "crosstab_pct_row": O.crosstab_sql("escolaridade", "periodo_do_obito", "row", AC_YEARS, ALL_REGIONS),
        "crosstab_pct_cell": O.crosstab_sql("est_civil", "capitulo_cid10", "cell", AC_YEARS, SOME_REGIONS),
        "crosstab_state_level": W(
            "SELECT CASE WHEN gr = 1 THEN 'Total' ELSE COALESCE(r, 'Unknown') END AS variavel_linha, "
            "CASE WHEN gc = 1 THEN 'Total' ELSE COALESCE(c, 'Unknown') END AS variavel_coluna, "
            "CAST(n AS BIGINT) AS obitos, CASE WHEN d > 0 THEN CAST((2000 * n + d) // (2 * d) AS DOUBLE) / 10.0 END "
            "AS percentual FROM (SELECT *, SUM(CASE WHEN gr = 0 THEN n END) OVER (PARTITION BY gc, c) AS d FROM ("
            "SELECT r, c, COUNT(*) AS n, GROUPING(r) AS gr, GROUPING(c) AS gc FROM ("
            "SELECT CAST(escolaridade AS VARCHAR) AS r, CAST(ano AS VARCHAR) AS c FROM ac "
            f"WHERE ano BETWEEN {AC_YEARS[0]} AND {AC_YEARS[1]} AND racacor IS NOT NULL AND idade BETWEEN 10 AND 49 "
            f"AND investigacao_cmm IN {O.ALL_COMMITTEE} AND {O.state_in(STATE)}) GROUP BY CUBE (r, c)))"),
        "crosstab_regional_level": W(
            "SELECT necropsia AS variavel_linha, assistencia_med AS variavel_coluna, COUNT(*) AS obitos FROM ac "
            f"WHERE ano BETWEEN {AC_YEARS[0]} AND {AC_YEARS[1]} AND racacor IS NOT NULL AND idade BETWEEN 10 AND 49 "
            "AND regiao = 'ASIA' GROUP BY ALL"),
        "report_om_regions_table": W(
            f"SELECT {om_table_cols} FROM ("
            + O.report_select("om", "regions", YEAR, O.OM_ATTRS, O.COMMON_OM, regions=SOME_REGIONS) + ")"),
        "crosstab_display_column": (
            "SELECT *, replace(replace(replace(format('{:,}', obitos), ',', '#'), '.', ','), '#', '.') "
            "|| ' (' || COALESCE(replace(replace(replace(format('{:,.1f}', percentual), ',', '#'), '.', ','), '#', '.'), '-') "
            "|| '%)' AS exibicao FROM ("
            + O.crosstab_sql("racacor", "ano", "column", AC_YEARS, ALL_REGIONS) + ")"),
        "facet_domain": W("SELECT DISTINCT racacor FROM om WHERE racacor IS NOT NULL"),
        "year_bounds": W("SELECT MIN(ano) AS ano_min, MAX(ano) AS ano_max FROM om"),
        "municipalities_of_state": W(
            f"SELECT DISTINCT municipio FROM state_lookup WHERE uf = {O._q(STATE)} AND municipio IS NOT NULL"),
        "series_count": W(
            "SELECT CAST(COUNT(DISTINCT variavel_coluna) + COALESCE(MAX(CASE WHEN variavel_coluna IS NULL "
            "THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_series FROM (SELECT ano AS variavel_coluna FROM ac "
            f"WHERE ano BETWEEN {AC_YEARS[0]} AND {AC_YEARS[1]} AND racacor IS NOT NULL AND idade BETWEEN 10 AND 49 "
            f"AND regiao IN ({', '.join(O._q(r) for r in ALL_REGIONS)}) GROUP BY racacor, ano)"),
        "dupes_documents": "SELECT text, COUNT(*) AS dupe_count FROM documents GROUP BY text HAVING COUNT(*) > 1",
        "dupes_om": W(f"SELECT {', '.join(AC_PROFILE)}, COUNT(*) AS dupe_count FROM ac GROUP BY ALL HAVING COUNT(*) > 1"),
        "dupe_rows_documents": ("SELECT text, dupe_count, doc_id FROM (SELECT text, doc_id, COUNT(*) OVER (PARTITION BY text) AS dupe_count "
                                "FROM documents) WHERE dupe_count > 1"),
        "dupe_rows_ac": W(f"SELECT {', '.join(AC_PROFILE)}, dupe_count, codigo FROM (SELECT *, COUNT(*) OVER (PARTITION BY "
                          f"{', '.join(AC_PROFILE)}) AS dupe_count FROM ac) WHERE dupe_count > 1"),
        "null_audit": W("SELECT * FROM ac WHERE " + " OR ".join(f"{c} IS NULL" for c in S.AC_COLUMNS)),
        "control_totals": W(
            "SELECT ano, CAST(SUM(om_n) AS BIGINT) AS obitos_om, CAST(SUM(ac_n) AS BIGINT) AS linhas_ac FROM ("
            "SELECT ano, obitos AS om_n, 0 AS ac_n FROM om UNION ALL SELECT ano, 0, 1 FROM ac) GROUP BY ano"),
        "search_values": W(f"SELECT * FROM ({om_table}) WHERE {search_cond}"),
        "facet_values": W(" UNION ALL ".join(
            f"SELECT '{c}' AS coluna, CAST({c} AS VARCHAR) AS valor, COUNT(*) AS linhas FROM om GROUP BY {c}" for c in S.OM_COLUMNS[:-1])),
        "search_any": W(f"SELECT * FROM ({om_table}) WHERE {search_cond}"),
        "filter_column": W(f"SELECT * FROM ({om_table}) WHERE contains(lower(tipo_de_morte_materna), 'direta')"),
        "filter_contains": W(f"SELECT * FROM ({om_table}) WHERE contains(tipo_de_morte_materna, 'ireta')"),
        "long_date_pt": (
            "SELECT o_orderkey, strftime(o_orderdate, '%d') || ' de ' || "
            f"({months})[month(o_orderdate)] || ' de ' || strftime(o_orderdate, '%Y') AS data_por_extenso "
            "FROM orders"),
    }
    if LLM:
        sql |= LLM.ORACLES
    if PIPELINE and PIPELINE.ORACLE_SQL:
        sql["pipeline"] = PIPELINE.ORACLE_SQL
    return sql
