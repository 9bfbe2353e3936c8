"""The five marts, built from one classified DataFrame.

Aggregations are ``groupBy(...).count()``: Spark combines map-side (partial
aggregation), so a hot key costs one row per task in the shuffle, not one per
certificate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import classify as C
from ..operators import dims
from ..operators.joins import natural_full_join


def _project(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[
        F.col("res_codigo_adotado").alias("codigo") if c == "codigo" else F.col(c)
        for c in columns
    ])


def _count_by_all(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    dims_ = [c for c in columns if c != "obitos"]
    return df.groupBy(*dims_, *by).agg(F.count(F.lit(1)).alias("obitos")).select(*columns, *by)


def mart_om(classified: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Official maternal deaths: municipality x year x cause x attributes x age (x ``by``)."""
    return _count_by_all(_project(classified.where(F.col("materno")), [*S.OM_COLUMNS[:-1], *by]), S.OM_COLUMNS, by)


def mart_gc(om: DataFrame, garbage: DataFrame) -> DataFrame:
    """Maternal deaths whose cause is on the garbage-code list."""
    return dims.keep_codes(om, garbage, "causabas").select(*om.columns)


def mart_ac(classified: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cross-analysis mart: one row per maternal death, 17 attributes, no count."""
    return _project(classified.where(F.col("materno")), [*S.AC_COLUMNS, *by])


def mart_onm(classified: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Female deaths in pregnancy or puerperium whose cause is not maternal."""
    return _count_by_all(_project(classified.where(F.col("desconsiderado")), [*S.ONM_COLUMNS[:-1], *by]),
                         S.ONM_COLUMNS, by)


UF_KEYS = ["uf", "regiao", "ano", "idade"]


def mart_uf(om: DataFrame, onm: DataFrame) -> DataFrame:
    """State mart in one aggregation.

    Both marts are tagged and unioned, then one ``groupBy`` sums the maternal
    deaths and the eight not-considered columns (period x external or not)
    with conditional sums. This is the pivot + null-safe full join + zero fill
    of the definition, with one shuffle and no join: a group exists iff either
    side has rows for it, and absent counts are 0.
    """
    tagged = om.select(*UF_KEYS, F.lit(None).cast("string").alias("_chave"), "obitos").unionByName(
        onm.select(*UF_KEYS, C.uf_pivot_key().alias("_chave"), "obitos"))
    measures = [F.coalesce(F.sum(F.when(F.col("_chave").isNull(), F.col("obitos"))), F.lit(0))
                .cast("long").alias("obitos_maternos")]
    measures += [F.coalesce(F.sum(F.when(F.col("_chave") == name, F.col("obitos"))), F.lit(0))
                 .cast("long").alias(name) for name in S.UF_COUNT_COLUMNS[1:]]
    return tagged.groupBy(*UF_KEYS).agg(*measures).select(*S.UF_COLUMNS)


def mart_uf_single_pass(classified: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """State mart straight from the classified certificates: one scan, one
    shuffle (conditional counts), no join.

    Equal to ``mart_uf(mart_om(c), mart_onm(c))``: a maternal row counts in
    ``obitos_maternos``, a not-considered row in the column of its period and
    external flag; groups are the keys having at least one such row.
    """
    key = C.uf_pivot_key()
    rows = classified.where(F.col("materno") | F.col("desconsiderado")).select(
        *UF_KEYS, *by, "materno", F.when(F.col("desconsiderado"), key).alias("_chave"))
    measures = [F.count_if(F.col("materno")).cast("long").alias("obitos_maternos")]
    measures += [F.count_if(F.coalesce(F.col("_chave") == name, F.lit(False))).cast("long").alias(name)
                 for name in S.UF_COUNT_COLUMNS[1:]]
    return rows.groupBy(*UF_KEYS, *by).agg(*measures).select(*S.UF_COLUMNS, *by)


def mart_uf_pivot(om: DataFrame, onm: DataFrame) -> DataFrame:
    """State mart as written in the definition: pivot the not-considered
    deaths to eight columns, full-join (null-safe) the maternal sums, fill 0.

    The pivot values are passed explicitly: no extra job to find them, and a
    category absent from the data still gets its column.
    """
    keyed = onm.select(*UF_KEYS, C.uf_pivot_key().alias("_chave"), "obitos")
    wide = (keyed.groupBy(*UF_KEYS).pivot("_chave", S.UF_COUNT_COLUMNS[1:])
            .agg(F.sum("obitos")).fillna(0, subset=S.UF_COUNT_COLUMNS[1:]))
    maternal = om.groupBy(*UF_KEYS).agg(F.sum("obitos").alias("obitos_maternos"))
    joined = natural_full_join(wide, maternal, UF_KEYS)
    counts = [c for c in joined.columns if c.startswith("obitos")]
    return joined.fillna(0, subset=counts).select(
        *UF_KEYS, *[F.col(c).cast("long").alias(c) for c in S.UF_COUNT_COLUMNS])


def build_marts(classified: DataFrame, garbage: DataFrame, by: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The five marts; ``by`` adds grouping columns (the stored marts carry the file year)."""
    om = mart_om(classified, by)
    return {
        "om": om,
        "gc": mart_gc(om, garbage),
        "ac": mart_ac(classified, by),
        "onm": mart_onm(classified, by),
        "uf": mart_uf_single_pass(classified, by),
    }


#: Columns that the marts read from the classified certificates.
MART_INPUT = list(dict.fromkeys(
    ["res_codigo_adotado" if c == "codigo" else c
     for c in [*S.OM_COLUMNS[:-1], *S.AC_COLUMNS, *S.ONM_COLUMNS[:-1], *UF_KEYS, "materno", "desconsiderado"]]))
