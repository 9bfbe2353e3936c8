"""Independent DuckDB SQL for every registered query.

Written directly from the definitions (no shared code with the Spark plans
except the fixed label values). Tables ``lineitem supplier nation region
orders documents`` are views registered by the checker.
"""

from __future__ import annotations

from maternis import schema as S
from maternis.sources.fixtures import FIXTURE_CODES, FIXTURE_GARBAGE_CODES


def _q(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _case(col: str, labels: dict, unknown=("9",), unknown_label=S.IGNORED) -> str:
    whens = " ".join(f"WHEN {col} = {_q(k)} THEN {_q(v)}" for k, v in labels.items())
    unk = ", ".join(_q(u) for u in unknown)
    return f"CASE {whens} WHEN {col} IS NULL OR {col} IN ({unk}) THEN {_q(unknown_label)} ELSE NULL END"


CHAPTERS_VALUES = ", ".join(f"({_q(lo)}, {_q(hi)}, {_q(label)})" for lo, hi, label in S.ICD_CHAPTERS)

FILE_YEAR = "CAST(1996 + (l_orderkey + l_suppkey) % 29 AS INTEGER) AS ano_arquivo"
SIM_RAW = f"""
sim_raw AS (
  SELECT
    CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN '1' ELSE '2' END AS sexo,
    ({_list(FIXTURE_CODES)})[l_partkey % 38 + 1] AS causabas,
    (['1', '2', '9', NULL, '8'])[(l_orderkey // 8) % 5 + 1] AS obitograv,
    (['1', '2', '3', '9', NULL, '0', '4', '8'])[l_orderkey % 8 + 1] AS obitopuerp,
    CAST(1 + l_suppkey % 28 AS VARCHAR) || '05' || CAST(1996 + (l_orderkey + l_suppkey) % 29 AS VARCHAR) AS dtobito,
    CASE (l_partkey + l_orderkey) % 17 WHEN 0 THEN NULL WHEN 1 THEN '999' WHEN 2 THEN '305' WHEN 3 THEN '501'
      ELSE '4' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 2, '0') END AS idade,
    (['1', '2', '3', '4', '5', '9', NULL, '6'])[(l_partkey + l_linenumber) % 8 + 1] AS racacor,
    (['1', '2', '3', '4', '5', '9', NULL, '7'])[(l_suppkey + l_linenumber) % 8 + 1] AS estciv,
    (['0', '1', '2', '3', '4', '5', '9', NULL])[(l_partkey + l_suppkey) % 8 + 1] AS esc2010,
    (['1', '2', '3', '4', '5', '6', '9', NULL])[(l_orderkey + l_partkey) % 8 + 1] AS lococor,
    (['1', '2', '9', NULL])[(l_orderkey + l_suppkey) % 4 + 1] AS assistmed,
    (['1', '2', '9', NULL])[(l_partkey + l_suppkey + l_linenumber) % 4 + 1] AS necropsia,
    (['1', '2', '9', NULL, '3'])[(l_suppkey + l_linenumber) % 5 + 1] AS fonteinv,
    CASE WHEN l_suppkey % 20 = 0 THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END AS codmunres,
    {FILE_YEAR}
  FROM lineitem
)"""

# Stage 1: recode / fill / decode (raw codes kept under cod_* names).
STAGE1 = """
s1 AS (
  SELECT
    sexo, codmunres, ano_arquivo, dtobito,
    causabas AS cod_causabas, obitograv AS cod_obitograv, obitopuerp AS cod_obitopuerp, idade AS cod_idade,
    racacor AS cod_racacor, estciv, esc2010, lococor, assistmed, necropsia AS cod_necropsia, fonteinv,
    CASE WHEN ano_arquivo >= 2023 THEN 'preliminar' ELSE 'historico' END AS era,
    CASE WHEN causabas IN ('O935', 'O937') THEN 'O95' ELSE causabas END AS causabas,
    COALESCE(obitograv, '9') AS obitograv,
    CASE WHEN obitopuerp IS NULL OR (ano_arquivo < 2023 AND obitopuerp IN ('0', '4', '8')) THEN '9'
         ELSE obitopuerp END AS obitopuerp,
    TRY_CAST(right(dtobito, 4) AS INTEGER) AS ano,
    CASE WHEN idade IS NULL OR idade = '999' THEN 99
         WHEN TRY_CAST(idade AS DOUBLE) IS NULL THEN NULL
         WHEN TRY_CAST(idade AS DOUBLE) BETWEEN 400 AND 499 THEN TRY_CAST(substr(idade, 2, 2) AS INTEGER)
         ELSE 0 END AS idade
  FROM sim_raw
)"""

STAGE2 = f"""
s2 AS (
  SELECT *,
    {_case('cod_racacor', S.RACE_LABELS)} AS racacor,
    CASE WHEN era = 'historico' THEN {_case('estciv', S.MARITAL_LABELS_HISTORY)}
         ELSE {_case('estciv', S.MARITAL_LABELS_PRELIMINARY)} END AS est_civil,
    {_case('lococor', S.PLACE_LABELS, unknown=('9', '6'))} AS local_ocorrencia_obito,
    {_case('assistmed', S.ASSIST_LABELS)} AS assistencia_med,
    {_case('cod_necropsia', S.NECROPSY_LABELS)} AS necropsia,
    CASE WHEN ano_arquivo <= 2014 THEN 'Ignorado' ELSE {_case('esc2010', S.SCHOOLING_LABELS)} END AS escolaridade,
    CASE WHEN ano_arquivo <= 2005 THEN 'Sem informação' WHEN fonteinv = '1' THEN 'Sim'
         WHEN fonteinv IS NULL OR fonteinv = '9' THEN 'Sem informação' ELSE 'Não' END AS investigacao_cmm,
    CASE WHEN idade IS NULL THEN NULL WHEN idade BETWEEN 10 AND 49 THEN 'Sim' ELSE 'Não' END AS obito_em_idade_fertil,
    CASE WHEN causabas IS NULL THEN NULL
         WHEN causabas BETWEEN 'B200' AND 'B249' OR causabas BETWEEN 'O100' AND 'O109'
           OR (causabas >= 'O240' AND causabas <> 'O244' AND causabas <= 'O259')
           OR causabas = 'O94' OR causabas BETWEEN 'O980' AND 'O999' THEN 'Indireta'
         WHEN causabas = 'O95' THEN 'Não especificada' ELSE 'Direta' END AS tipo_de_morte_materna,
    CASE WHEN obitograv = '1' AND obitopuerp <> '1' AND obitopuerp <> '2' THEN {_q(S.PERIOD_PREGNANCY)}
         WHEN obitograv <> '1' AND obitopuerp = '1' THEN {_q(S.PERIOD_PUERPERIUM_42)}
         WHEN obitograv <> '1' AND obitopuerp = '2' THEN {_q(S.PERIOD_PUERPERIUM_1Y)}
         WHEN (obitograv = '2' AND obitopuerp = '3') OR (obitograv = '2' AND obitopuerp = '9')
           OR (obitograv = '9' AND obitopuerp = '3') THEN {_q(S.PERIOD_NEITHER)}
         WHEN obitograv = '9' AND obitopuerp = '9' THEN {_q(S.PERIOD_NOT_INFORMED)}
         WHEN (obitograv = '1' AND obitopuerp = '1') OR (obitograv = '1' AND obitopuerp = '2')
           THEN {_q(S.PERIOD_INCONSISTENT)}
         ELSE NULL END AS periodo_do_obito
  FROM s1
)"""

DIMS = f"""
chapters(lo, hi, label) AS (VALUES {CHAPTERS_VALUES}),
mun AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS codmunres, CAST(s_suppkey AS VARCHAR) AS res_codigo_adotado,
         s_name AS municipio, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS uf, r_name AS regiao
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
state_lookup AS (
  SELECT n_name AS uf, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS sigla_uf, s_name AS municipio
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
icd_codes AS (
  SELECT DISTINCT CASE WHEN c IN ('O935', 'O937') THEN 'O95' ELSE c END AS causabas
  FROM (SELECT unnest({_list(FIXTURE_CODES)}) AS c) WHERE c IS NOT NULL
),
icd AS (
  SELECT k.causabas, substr(k.causabas, 1, 3) AS causabas_categoria, ch.label AS capitulo_cid10
  FROM icd_codes k LEFT JOIN chapters ch ON substr(k.causabas, 1, 3) BETWEEN ch.lo AND ch.hi
),
garbage AS (SELECT unnest({_list(FIXTURE_GARBAGE_CODES)}) AS causabas)"""

MATERNAL_CLAUSE = """(causabas BETWEEN 'O000' AND 'O959' OR causabas BETWEEN 'O980' AND 'O999'
   OR (causabas = 'A34' AND obitopuerp <> '2')
   OR (causabas BETWEEN 'B200' AND 'B249' AND (obitograv = '1' OR obitopuerp = '1'))
   OR (causabas = 'D392' AND (obitograv = '1' OR obitopuerp = '1'))
   OR (causabas = 'E230' AND (obitograv = '1' OR obitopuerp = '1'))
   OR (causabas BETWEEN 'F530' AND 'F539' AND obitopuerp <> '2')
   OR (causabas = 'M830' AND obitopuerp <> '2'))"""

CLASSIFIED = f"""
classified AS (
  SELECT s2.*, mun.res_codigo_adotado, mun.municipio, mun.uf, mun.regiao,
         icd.causabas_categoria, icd.capitulo_cid10,
         (sexo = '2' AND {MATERNAL_CLAUSE}) AS materno,
         (sexo = '2' AND (obitograv = '1' OR obitopuerp IN ('1', '2')) AND NOT {MATERNAL_CLAUSE}) AS desconsiderado
  FROM s2 LEFT JOIN mun USING (codmunres) LEFT JOIN icd USING (causabas)
)"""

OM = """
om AS (
  SELECT res_codigo_adotado AS codigo, municipio, uf, regiao, ano, causabas, causabas_categoria,
         capitulo_cid10, tipo_de_morte_materna, periodo_do_obito, investigacao_cmm, racacor, idade,
         COUNT(*) AS obitos
  FROM classified WHERE materno GROUP BY ALL
)"""

ONM = """
onm AS (
  SELECT res_codigo_adotado AS codigo, ano, municipio, uf, regiao, capitulo_cid10, causabas_categoria,
         periodo_do_obito, racacor, idade, investigacao_cmm, COUNT(*) AS obitos
  FROM classified WHERE desconsiderado GROUP BY ALL
)"""

AC = """
ac AS (
  SELECT res_codigo_adotado AS codigo, municipio, uf, regiao, ano, racacor, est_civil, escolaridade, idade,
         local_ocorrencia_obito, assistencia_med, necropsia, tipo_de_morte_materna, periodo_do_obito,
         obito_em_idade_fertil, investigacao_cmm, capitulo_cid10
  FROM classified WHERE materno
)"""

GC = """
gc AS (SELECT * FROM om WHERE causabas IN (SELECT causabas FROM garbage))"""

UF_COUNTS = [c for c in S.UF_COUNT_COLUMNS[1:]]
UF = """
onm_keyed AS (
  SELECT uf, regiao, ano, idade, obitos,
         'obitos_descons_' || trim(regexp_replace(strip_accents(lower(periodo_do_obito)), '[^a-z0-9]+', '_', 'g'), '_')
         || CASE WHEN COALESCE(regexp_matches(capitulo_cid10, '^XX'), false) THEN '_ext' ELSE '_exceto_ext' END AS chave
  FROM onm
),
descons_uf AS (
  SELECT uf, regiao, ano, idade, """ + ", ".join(
    f"SUM(CASE WHEN chave = '{c}' THEN obitos ELSE 0 END) AS {c}" for c in UF_COUNTS) + """
  FROM onm_keyed GROUP BY uf, regiao, ano, idade
),
maternos_uf AS (SELECT uf, regiao, ano, idade, SUM(obitos) AS obitos_maternos FROM om GROUP BY ALL),
uf_mart AS (
  SELECT COALESCE(d.uf, m.uf) AS uf, COALESCE(d.regiao, m.regiao) AS regiao, COALESCE(d.ano, m.ano) AS ano,
         COALESCE(d.idade, m.idade) AS idade,
         CAST(COALESCE(m.obitos_maternos, 0) AS BIGINT) AS obitos_maternos, """ + ", ".join(
    f"CAST(COALESCE(d.{c}, 0) AS BIGINT) AS {c}" for c in UF_COUNTS) + """
  FROM descons_uf d FULL OUTER JOIN maternos_uf m
    ON d.uf IS NOT DISTINCT FROM m.uf AND d.regiao IS NOT DISTINCT FROM m.regiao
   AND d.ano IS NOT DISTINCT FROM m.ano AND d.idade IS NOT DISTINCT FROM m.idade
)"""

BASE = [SIM_RAW, STAGE1, STAGE2, DIMS, CLASSIFIED, OM, ONM, AC, GC, UF]


def with_base(select: str, extra_ctes: str = "") -> str:
    ctes = ",".join(BASE) + ("," + extra_ctes if extra_ctes else "")
    return "WITH " + ctes + "\n" + select


ALL_COMMITTEE = "('Sim', 'Não', 'Sem informação')"
COMMON_OM = ("ano = {year} AND tipo_de_morte_materna IS NOT NULL AND periodo_do_obito IS NOT NULL "
             f"AND investigacao_cmm IN {ALL_COMMITTEE} AND racacor IS NOT NULL AND idade BETWEEN 10 AND 49")
COMMON_ONM = ("ano = {year} AND periodo_do_obito IS NOT NULL "
              f"AND investigacao_cmm IN {ALL_COMMITTEE} AND racacor IS NOT NULL AND idade BETWEEN 10 AND 49")
OM_ATTRS = "capitulo_cid10, causabas_categoria, tipo_de_morte_materna, periodo_do_obito, racacor, investigacao_cmm"
ONM_ATTRS = "capitulo_cid10, causabas_categoria, periodo_do_obito, racacor, investigacao_cmm"


def state_in(name: str) -> str:
    return f"uf IN (SELECT DISTINCT sigla_uf FROM state_lookup WHERE uf = {_q(name)})"


def report_sql(*args, **kwargs) -> str:
    return with_base(report_select(*args, **kwargs))


def report_select(mart: str, level: str, year: int, attrs: str, common: str, regions=None, state=None,
                  municipality=None, extra_where: str = "") -> str:
    where = common.format(year=year) + extra_where
    if level == "all":
        keys, sel = "", "ano, 'Todas' AS regiao"
    elif level == "regions":
        where += f" AND regiao IN ({', '.join(_q(r) for r in regions)})"
        sel = "regiao, ano"
    elif level == "state":
        where += " AND " + state_in(state)
        sel = "uf, regiao, ano"
    else:
        where += f" AND municipio = {_q(municipality)} AND " + state_in(state)
        sel = "municipio, uf, regiao, ano"
    return f"SELECT {sel}, {attrs}, CAST(SUM(obitos) AS BIGINT) AS obitos FROM {mart} WHERE {where} GROUP BY ALL"


def crosstab_sql(row: str, col: str, percent: str, years, regions, committee=True) -> str:
    cond = (f"ano BETWEEN {years[0]} AND {years[1]} AND racacor IS NOT NULL AND idade BETWEEN 10 AND 49 "
            f"AND regiao IN ({', '.join(_q(r) for r in regions)})")
    if committee:
        cond += f" AND investigacao_cmm IN {ALL_COMMITTEE}"
    if percent == "column":
        d = "SUM(CASE WHEN gr = 0 THEN n END) OVER (PARTITION BY gc, c)"
    elif percent == "row":
        d = "SUM(CASE WHEN gc = 0 THEN n END) OVER (PARTITION BY gr, r)"
    else:
        d = "(SELECT COUNT(*) FROM base)"
    extra = f"""
base AS (SELECT CAST({row} AS VARCHAR) AS r, CAST({col} AS VARCHAR) AS c FROM ac WHERE {cond}),
cells AS (SELECT r, c, COUNT(*) AS n, GROUPING(r) AS gr, GROUPING(c) AS gc FROM base GROUP BY CUBE (r, c)),
with_d AS (SELECT *, {d} AS d FROM cells)"""
    return with_base(
        "SELECT CASE WHEN gr = 1 THEN 'Total' ELSE COALESCE(r, 'Unknown') END AS variavel_linha, "
        "CASE WHEN gc = 1 THEN 'Total' ELSE COALESCE(c, 'Unknown') END AS variavel_coluna, "
        "CAST(n AS BIGINT) AS obitos, "
        "CASE WHEN d > 0 THEN CAST((2000 * n + d) // (2 * d) AS DOUBLE) / 10.0 END AS percentual FROM with_d",
        extra)
