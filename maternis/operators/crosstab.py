"""Two-variable analysis of the per-death mart: long counts and the
contingency table with margins and percentages.

The contingency table is one ``cube`` (partial aggregation map-side; the
output has (|rows|+1) x (|cols|+1) cells). Margins are told apart from a
null ("Unknown") level by ``grouping()``, never by ``isNull``. Row and column
denominators are windows partitioned by the margin they divide by; the cell
denominator is the cube's own grand-total cell. Only the small cube output is
windowed; the certificates are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.classify import format_number_br, percent_tenths
from ..plans.report import ReportParams, in_choice, level_filter

TOTAL_LABEL = "Total"
UNKNOWN_LABEL = "Unknown"
PERCENT_MODES = ("column", "row", "cell")


def check_variable(name: str, level: str) -> str:
    """A variable must be in the 14-entry dictionary; below national level the
    geography variables are not offered."""
    allowed = set(S.CROSS_VARIABLES.values())
    if level != "Nacional":
        allowed -= set(S.GEO_VARIABLES)
    if name not in allowed:
        raise ValueError(f"variable {name!r} not available at level {level!r}")
    return name


def variable_label(name: str) -> str:
    return next(k for k, v in S.CROSS_VARIABLES.items() if v == name)


def _filtered(ac: DataFrame, p: ReportParams, states: DataFrame | None, with_committee: bool) -> DataFrame:
    # Neither the chart nor the table filters on cause type or period; only
    # the table filters on the committee choice.
    cond = F.lit(True)
    if p.years is not None:
        cond = cond & F.col("ano").between(*p.years)
    if p.year is not None:
        cond = cond & (F.col("ano") == p.year)
    cond = cond & in_choice("racacor", p.races) & F.col("idade").between(*p.age_range)
    if with_committee:
        cond = cond & in_choice("investigacao_cmm", p.committee)
    # Regions are always filtered here: a null region never shows.
    return level_filter(ac.where(cond), p, states, always_filter_regions=True)


def crosstab_long(ac: DataFrame, row: str, col: str, p: ReportParams,
                  states: DataFrame | None = None) -> DataFrame:
    """Deaths by (row value, column value) for the chart."""
    check_variable(row, p.level)
    check_variable(col, p.level)
    df = _filtered(ac, p, states, with_committee=False)
    return (df.select(F.col(row).alias("variavel_linha"), F.col(col).alias("variavel_coluna"))
            .groupBy("variavel_linha", "variavel_coluna")
            .agg(F.count(F.lit(1)).alias("obitos")))


def crosstab_table(ac: DataFrame, row: str, col: str, percent: str, p: ReportParams,
                   states: DataFrame | None = None) -> DataFrame:
    """Contingency table with totals and column / row / cell percentages.

    Output: variavel_linha, variavel_coluna (text; ``Total`` on the margins,
    ``Unknown`` for a missing value), obitos, percentual (one decimal,
    rounded half-up from integers).
    """
    if percent not in PERCENT_MODES:
        raise ValueError(f"percent must be one of {PERCENT_MODES}")
    check_variable(row, p.level)
    check_variable(col, p.level)
    df = _filtered(ac, p, states, with_committee=True)
    base = df.select(F.col(row).cast("string").alias("_r"), F.col(col).cast("string").alias("_c"))
    cells = base.cube("_r", "_c").agg(
        F.count(F.lit(1)).alias("obitos"),
        F.grouping("_r").alias("_gr"),
        F.grouping("_c").alias("_gc"),
    )
    n = F.col("obitos")
    if percent == "column":
        d = F.sum(F.when(F.col("_gr") == 0, n)).over(Window.partitionBy("_gc", "_c"))
    elif percent == "row":
        d = F.sum(F.when(F.col("_gc") == 0, n)).over(Window.partitionBy("_gr", "_r"))
    else:
        # Grand total = the cube's own (Total, Total) cell. The window spans
        # the cube *output* only, (|rows|+1) x (|cols|+1) cells of two
        # categorical variables from the fixed dictionary, so it never holds
        # certificates, and the data is read once (a scalar subquery would
        # recompute the cube in a second pass).
        d = F.max(F.when((F.col("_gr") == 1) & (F.col("_gc") == 1), n)).over(Window.partitionBy())
    return cells.withColumn("_d", d).select(
        F.when(F.col("_gr") == 1, F.lit(TOTAL_LABEL)).otherwise(F.coalesce("_r", F.lit(UNKNOWN_LABEL))).alias("variavel_linha"),
        F.when(F.col("_gc") == 1, F.lit(TOTAL_LABEL)).otherwise(F.coalesce("_c", F.lit(UNKNOWN_LABEL))).alias("variavel_coluna"),
        n.alias("obitos"),
        percent_tenths(n, F.col("_d")).alias("percentual"),
    )


def crosstab_display(table: DataFrame) -> DataFrame:
    """Cell text of the contingency table: ``n (p%)`` in Brazilian format
    (thousands '.', decimals ','), e.g. ``1.234 (56,7%)``."""
    label = F.concat(format_number_br("obitos", 0), F.lit(" ("),
                     F.coalesce(format_number_br("percentual", 1), F.lit("-")), F.lit("%)"))
    return table.withColumn("exibicao", label)
