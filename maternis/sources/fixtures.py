"""Certificate-shaped inputs derived from the benchmark tables.

The registry files are not public in this repository, so the queries read a
``sim_raw`` view computed from ``lineitem`` (one certificate per line item,
integer arithmetic only) and dimensions computed from ``supplier``, ``nation``
and ``region``. The derivation is a plain projection, so the work of every
query grows with ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

# The cause codes the fixture cycles through (the last one is null).
FIXTURE_CODES = [
    "A34", "B20", "B200", "B24", "B249", "B250", "D392", "E230", "F53", "F530", "F539",
    "F54", "M830", "O000", "O100", "O109", "O11", "O240", "O244", "O259", "O26", "O935",
    "O937", "O94", "O95", "O959", "O95X", "O96", "O979", "O98", "O980", "O999", "I219",
    "V892", "X954", "Z321", "U071", None,
]
# Stand-in garbage-code list.
FIXTURE_GARBAGE_CODES = ["O95", "O26", "O94", "O959"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index: Column) -> Column:
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (index + 1).cast("int"))


def sim_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw certificates (all text) plus the integer file year ``ano_arquivo``."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    o, p, s, n = (F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"),
                  F.col("l_linenumber"))
    year = F.lit(1996) + (o + s) % 29
    age_code = (p + o) % 17
    two_digit_qty = F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0")
    # The columns come out of a generator (inline of a one-element array), so
    # they are plain attributes downstream, as a scan of landed files gives:
    # filters on them are not pushed below it by substituting these
    # expressions into every reference of the classification predicates.
    # The file year stays beside it: like the folders of landed files, a filter
    # on it leaves rows out before their columns are made.
    return li.select(year.cast("int").alias("ano_arquivo"), F.inline(F.array(F.struct(
        F.when((o + n) % 5 == 0, F.lit("1")).otherwise(F.lit("2")).alias("sexo"),
        _pick(FIXTURE_CODES, p % 38).alias("causabas"),
        _pick(["1", "2", "9", None, "8"], F.call_function("div", o, F.lit(8)) % 5).alias("obitograv"),
        _pick(["1", "2", "3", "9", None, "0", "4", "8"], o % 8).alias("obitopuerp"),
        F.concat((F.lit(1) + s % 28).cast("string"), F.lit("05"), year.cast("string")).alias("dtobito"),
        F.when(age_code == 0, F.lit(None).cast("string"))
        .when(age_code == 1, F.lit("999"))
        .when(age_code == 2, F.lit("305"))
        .when(age_code == 3, F.lit("501"))
        .otherwise(F.concat(F.lit("4"), two_digit_qty)).alias("idade"),
        _pick(["1", "2", "3", "4", "5", "9", None, "6"], (p + n) % 8).alias("racacor"),
        _pick(["1", "2", "3", "4", "5", "9", None, "7"], (s + n) % 8).alias("estciv"),
        _pick(["0", "1", "2", "3", "4", "5", "9", None], (p + s) % 8).alias("esc2010"),
        _pick(["1", "2", "3", "4", "5", "6", "9", None], (o + p) % 8).alias("lococor"),
        _pick(["1", "2", "9", None], (o + s) % 4).alias("assistmed"),
        _pick(["1", "2", "9", None], (p + s + n) % 4).alias("necropsia"),
        _pick(["1", "2", "9", None, "3"], (s + n) % 5).alias("fonteinv"),
        F.when(s % 20 == 0, F.lit(None).cast("string")).otherwise(s.cast("string")).alias("codmunres"),
    )))).select(*S.RAW_COLUMNS, "ano_arquivo")


def _nation_code(c: Column) -> Column:
    return F.concat(F.lit("N"), F.lpad(c.cast("string"), 2, "0"))


def municipality_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """codmunres, res_codigo_adotado, municipio, uf, regiao (one row per supplier)."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("s_suppkey").cast("string").alias("codmunres"),
            F.col("s_suppkey").cast("string").alias("res_codigo_adotado"),
            F.col("s_name").alias("municipio"),
            _nation_code(F.col("n_nationkey")).alias("uf"),
            F.col("r_name").alias("regiao"),
        )
    )


def state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uf (full state name), sigla_uf (abbreviation), municipio."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("uf"),
        _nation_code(F.col("n_nationkey")).alias("sigla_uf"),
        F.col("s_name").alias("municipio"),
    )


def garbage_codes(spark: SparkSession) -> DataFrame:
    from ..operators.dims import with_row_bound
    return with_row_bound(spark.createDataFrame([(c,) for c in FIXTURE_GARBAGE_CODES], "causabas string"),
                          len(FIXTURE_GARBAGE_CODES))


def letter_blocks(chapters: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Nested interval fixture built by rule: every chapter that spans several
    initial letters is split into one block per letter (e.g. A00-B99 into
    A00-A99 and B00-B99). Each block lies inside its chapter, so a category
    matches one or two nested intervals and the narrowest is unique."""
    out = []
    for lo, hi, _label in chapters:
        if lo[0] == hi[0]:
            continue
        for code in range(ord(lo[0]), ord(hi[0]) + 1):
            letter = chr(code)
            b_lo = lo if letter == lo[0] else f"{letter}00"
            b_hi = hi if letter == hi[0] else f"{letter}99"
            out.append((b_lo, b_hi, f"Bloco {b_lo}-{b_hi}"))
    return out


def decade_blocks(blocks: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """A third level: each letter block cut into blocks of one decade of categories (A00-A09, A10-A19, ...)."""
    out = []
    for lo, hi, _label in blocks:
        for decade in range(int(lo[1]), int(hi[1]) + 1):
            d_lo = max(lo, f"{lo[0]}{decade}0")
            d_hi = min(hi, f"{lo[0]}{decade}9")
            if (d_lo, d_hi) != (lo, hi):
                out.append((d_lo, d_hi, f"Dezena {d_lo}-{d_hi}"))
    return out


def nested_intervals(spark: SparkSession) -> DataFrame:
    """Chapters, their letter blocks and the decades of those: intervals nested three deep."""
    from .files import INTERVAL_SCHEMA
    from ..operators.dims import with_row_bound
    blocks = letter_blocks(S.ICD_CHAPTERS)
    rows = S.ICD_CHAPTERS + blocks + decade_blocks(blocks)
    return with_row_bound(spark.createDataFrame(rows, INTERVAL_SCHEMA), len(rows))
