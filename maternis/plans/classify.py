"""Raw certificates -> classified certificates (one lazy plan for all years).

Stages follow the dependency levels of the derivation, because a Spark
projection reads the *input* values of the columns it overwrites:

1. recode: F1/F2 flags (on raw codes), cause recode, code fills, year from
   the date, age decode, era;
2. derive: labels that read the stage-1 values (fertile age reads the decoded
   age, the type reads the recoded cause, the period reads the filled codes);
3. enrich: municipality and ICD dimension joins (size-checked broadcasts).

Era rules (history vs preliminary files) are columns, not loops: one scan
covers every year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import classify as C
from ..functions import recode as R
from ..operators import dims


def era_of(file_year: Column, first_preliminary_year: int = S.FIRST_PRELIMINARY_YEAR) -> Column:
    return F.when(file_year >= first_preliminary_year, F.lit(S.PRELIMINARY)).otherwise(F.lit(S.HISTORY))


def recode_stage(raw: DataFrame, first_preliminary_year: int = S.FIRST_PRELIMINARY_YEAR) -> DataFrame:
    """Stage 1. Adds ``ano``, ``era`` (and ``ano_arquivo`` if the input has none)."""
    df = raw
    if "ano_arquivo" not in df.columns:
        df = df.withColumn("ano_arquivo", R.year_from_date("dtobito"))
    era = era_of(F.col("ano_arquivo"), first_preliminary_year)
    return df.withColumns({
        "era": era,
        # F1/F2 read the raw codes (they are invariant under the recodes
        # below), so filters on them are pushed down over raw columns only.
        "materno": C.is_maternal(),
        "desconsiderado": C.is_not_considered(),
        "causabas": R.recode_cause("causabas"),
        "obitograv": R.fill_pregnancy_code("obitograv"),
        "obitopuerp": R.fill_puerperium_code("obitopuerp", era),
        "ano": R.year_from_date("dtobito"),
        "idade": R.decode_age("idade"),
    })


def derive_stage(df: DataFrame) -> DataFrame:
    """Stage 2: attribute labels, fertile age, type of maternal death, period."""
    era, file_year = F.col("era"), F.col("ano_arquivo")
    return df.withColumns({
        "racacor": R.recode_race("racacor"),
        "est_civil": R.recode_marital("estciv", era),
        "local_ocorrencia_obito": R.recode_place("lococor"),
        "assistencia_med": R.recode_assistance("assistmed"),
        "necropsia": R.recode_necropsy("necropsia"),
        "escolaridade": R.recode_schooling("esc2010", file_year),
        "investigacao_cmm": R.recode_committee("fonteinv", file_year),
        "obito_em_idade_fertil": R.fertile_age("idade"),
        "tipo_de_morte_materna": C.maternal_type("causabas"),
        "periodo_do_obito": C.death_period("obitograv", "obitopuerp"),
    })


def classify(raw: DataFrame, municipalities: DataFrame, icd: DataFrame,
             first_preliminary_year: int = S.FIRST_PRELIMINARY_YEAR,
             candidates_only: bool = True) -> DataFrame:
    """Classified certificates with flags ``materno`` (F1) and ``desconsiderado`` (F2).

    With ``candidates_only`` (the default for marts) a filter on raw columns,
    a superset of both F1 and F2, is applied first so that it reaches the
    scan: only female pregnancy-related certificates are recoded and joined.
    """
    if candidates_only:
        raw = raw.where(C.raw_candidate())
    df = derive_stage(recode_stage(raw, first_preliminary_year))
    df = dims.enrich_municipality(df, municipalities)
    return dims.enrich_icd(df, icd)
