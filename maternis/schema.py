"""Column contracts and the fixed code labels of the death-certificate domain.

Everything here is metadata: raw columns are read as text (no inference pass,
no lost leading zeros), marts have a fixed column order, and code labels are
plain values that must match the published marts exactly.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Raw certificate columns the pipeline reads. All text, as in the registry files.
RAW_COLUMNS = [
    "sexo", "causabas", "obitograv", "obitopuerp", "dtobito", "idade", "racacor",
    "estciv", "esc2010", "lococor", "assistmed", "necropsia", "fonteinv", "codmunres",
]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

MUNICIPALITY_COLUMNS = ["codmunres", "res_codigo_adotado", "municipio", "uf", "regiao"]
ICD_COLUMNS = ["causabas", "causabas_categoria", "capitulo_cid10"]
STATE_LOOKUP_COLUMNS = ["uf", "sigla_uf", "municipio"]

HISTORY = "historico"
PRELIMINARY = "preliminar"
FIRST_PRELIMINARY_YEAR = 2023

# ---------------------------------------------------------------------------
# Mart contracts (column order is part of the contract)
# ---------------------------------------------------------------------------
OM_COLUMNS = [
    "codigo", "municipio", "uf", "regiao", "ano", "causabas", "causabas_categoria",
    "capitulo_cid10", "tipo_de_morte_materna", "periodo_do_obito", "investigacao_cmm",
    "racacor", "idade", "obitos",
]
AC_COLUMNS = [
    "codigo", "municipio", "uf", "regiao", "ano", "racacor", "est_civil", "escolaridade",
    "idade", "local_ocorrencia_obito", "assistencia_med", "necropsia",
    "tipo_de_morte_materna", "periodo_do_obito", "obito_em_idade_fertil",
    "investigacao_cmm", "capitulo_cid10",
]
ONM_COLUMNS = [
    "codigo", "ano", "municipio", "uf", "regiao", "capitulo_cid10", "causabas_categoria",
    "periodo_do_obito", "racacor", "idade", "investigacao_cmm", "obitos",
]

# ---------------------------------------------------------------------------
# Labels of the registry codes. They must equal the published
# marts character for character.
# ---------------------------------------------------------------------------
RACE_LABELS = {"1": "Branca", "2": "Preta", "3": "Amarela", "4": "Parda", "5": "Indígena"}
MARITAL_LABELS_HISTORY = {
    "1": "Solteira", "2": "Casada", "3": "Viúva", "4": "Separada Judic./Divorciada",
    "5": "União Estável",
}
MARITAL_LABELS_PRELIMINARY = {
    "1": "Solteiro", "2": "Casado", "3": "Viúvo", "4": "Separado Judic./Divorciado",
    "5": "União Estável",
}
PLACE_LABELS = {
    "1": "Hospital", "2": "Outro Estab. Saúde", "3": "Domicílio", "4": "Via Pública",
    "5": "Outros",
}
ASSIST_LABELS = {"1": "Com assistência", "2": "Sem assistência"}
NECROPSY_LABELS = {"1": "Sim", "2": "Não"}
SCHOOLING_LABELS = {
    "0": "Sem escolaridade", "1": "Fundamental I", "2": "Fundamental II", "3": "Médio",
    "4": "Superior incompleto", "5": "Superior completo",
}
IGNORED = "Ignorado"
NO_INFO = "Sem informação"
YES = "Sim"
NO = "Não"

TYPE_INDIRECT = "Indireta"
TYPE_UNSPECIFIED = "Não especificada"
TYPE_DIRECT = "Direta"

PERIOD_PREGNANCY = "Durante a gravidez, parto ou aborto"
PERIOD_PUERPERIUM_42 = "Durante o puerpério, até 42 dias"
PERIOD_PUERPERIUM_1Y = "Durante o puerpério, de 43 dias a menos de 1 ano"
PERIOD_NEITHER = "Não na gravidez ou no puerpério"
PERIOD_NOT_INFORMED = "Não informado ou ignorado"
PERIOD_INCONSISTENT = "Período inconsistente"

EXTERNAL_CHAPTER = "XX - Causas externas de morbidade e de mortalidade"

# ---------------------------------------------------------------------------
# ICD-10 chapters, month names, period slugs, the variable dictionary.
# ---------------------------------------------------------------------------
# ICD-10 chapters: (first category, last category, label). Labels are the
# chapter descriptions without their "Capítulo " prefix.
ICD_CHAPTERS = [
    ("A00", "B99", "I - Algumas doenças infecciosas e parasitárias"),
    ("C00", "D48", "II - Neoplasias [tumores]"),
    ("D50", "D89", "III  - Doenças do sangue e dos órgãos hematopoéticos e alguns transtornos imunitários"),
    ("E00", "E90", "IV - Doenças endócrinas, nutricionais e metabólicas"),
    ("F00", "F99", "V - Transtornos mentais e comportamentais"),
    ("G00", "G99", "VI - Doenças do sistema nervoso"),
    ("H00", "H59", "VII - Doenças do olho e anexos"),
    ("H60", "H95", "VIII - Doenças do ouvido e da apófise mastóide"),
    ("I00", "I99", "IX - Doenças do aparelho circulatório"),
    ("J00", "J99", "X - Doenças do aparelho respiratório"),
    ("K00", "K93", "XI - Doenças do aparelho digestivo"),
    ("L00", "L99", "XII - Doenças da pele e do tecido subcutâneo"),
    ("M00", "M99", "XIII - Doenças do sistema osteomuscular e do tecido conjuntivo"),
    ("N00", "N99", "XIV - Doenças do aparelho geniturinário"),
    ("O00", "O99", "XV - Gravidez, parto e puerpério"),
    ("P00", "P96", "XVI - Algumas afecções originadas no período perinatal"),
    ("Q00", "Q99", "XVII - Malformações congênitas, deformidades e anomalias cromossômicas"),
    ("R00", "R99", "XVIII - Sintomas, sinais e achados anormais de exames clínicos e de laboratório, não classificados em outra parte"),
    ("S00", "T98", "XIX - Lesões, envenenamento e algumas outras conseqüências de causas externas"),
    ("V01", "Y98", "XX - Causas externas de morbidade e de mortalidade"),
    ("Z00", "Z99", "XXI - Fatores que influenciam o estado de saúde e o contato com os serviços de saúde"),
    ("U04", "U99", "XXII - Códigos para propósitos especiais"),
]

# Month names for the long Portuguese date.
MONTHS_PT = [
    "janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho",
    "agosto", "setembro", "outubro", "novembro", "dezembro",
]

# The four periods a not-considered death can have, with the column slug the
# state mart uses for each.
NOT_CONSIDERED_PERIODS = [
    (PERIOD_PREGNANCY, "durante_a_gravidez_parto_ou_aborto"),
    (PERIOD_PUERPERIUM_42, "durante_o_puerperio_ate_42_dias"),
    (PERIOD_PUERPERIUM_1Y, "durante_o_puerperio_de_43_dias_a_menos_de_1_ano"),
    (PERIOD_INCONSISTENT, "periodo_inconsistente"),
]
UF_COUNT_COLUMNS = (
    ["obitos_maternos"]
    + [f"obitos_descons_{slug}_exceto_ext" for _, slug in NOT_CONSIDERED_PERIODS]
    + [f"obitos_descons_{slug}_ext" for _, slug in NOT_CONSIDERED_PERIODS]
)
UF_COLUMNS = ["uf", "regiao", "ano", "idade"] + UF_COUNT_COLUMNS

# Variable dictionary of the cross analysis: label -> AC column.
CROSS_VARIABLES = {
    "Região do país": "regiao",
    "Ano do óbito": "ano",
    "Raça/cor": "racacor",
    "Estado civil": "est_civil",
    "Escolaridade": "escolaridade",
    "UF de residência": "uf",
    "Local de ocorrência do óbito": "local_ocorrencia_obito",
    "Óbito em idade fértil": "obito_em_idade_fertil",
    "Tipo de morte materna": "tipo_de_morte_materna",
    "Período do óbito": "periodo_do_obito",
    "Assistência médica": "assistencia_med",
    "Necrópsia": "necropsia",
    "Capítulo da CID-10": "capitulo_cid10",
    "Investigação por CMM": "investigacao_cmm",
}
GEO_VARIABLES = ("regiao", "uf")
