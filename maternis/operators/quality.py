"""Data-quality checks: null audit, duplicate rows, control totals, invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dims


def null_audit(df: DataFrame) -> DataFrame:
    """Rows with a null in any column."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in df.columns]))


def dupes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that occur more than once, once each, with ``dupe_count``.

    A ``groupBy`` over all columns (null-safe by nature) with map-side partial
    counts: a row repeated a billion times is one row per task in the
    shuffle, never a billion-row group in one task.
    """
    cols = columns or df.columns
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("dupe_count"))
            .where(F.col("dupe_count") > 1))


#: Copies from which a group of equal rows is joined by broadcast, so that its rows are not shuffled to one task.
HOT_COPIES = 100_000


def duplicate_rows(df: DataFrame, columns: list[str] | None = None, hot_copies: int = HOT_COPIES) -> DataFrame:
    """Every copy of the rows that occur more than once (in ``columns``, default all), with ``dupe_count``.

    The counts are combined map-side (``dupes``) and joined back, null matching null. Groups of
    ``hot_copies`` and more, at most rows / ``hot_copies`` of them, are broadcast if their number is
    proven small, so their copies stay where they are read; the copies of the other groups are shuffled,
    fewer than ``hot_copies`` a group. Neither a window nor a list ever holds a group.
    """
    cols = columns or df.columns
    groups = dupes(df.select(*cols))
    rest = [c for c in df.columns if c not in cols]
    hot, cold = groups.where(F.col("dupe_count") >= hot_copies), groups.where(F.col("dupe_count") < hot_copies)
    # the hot groups' counts prove their number: each stands for hot_copies rows at least
    hot_side = dims.bounded_broadcast(hot) if not hot.isEmpty() else None

    def joined(rows: DataFrame, side: DataFrame) -> DataFrame:
        r, g = rows.alias("_r"), side.alias("_g")
        same = reduce(lambda a, b: a & b, [F.col(f"_r.`{c}`").eqNullSafe(F.col(f"_g.`{c}`")) for c in cols])
        return r.join(g, same).select(*[F.col(f"_r.`{c}`") for c in cols], F.col("_g.dupe_count"), *[F.col(f"_r.`{c}`") for c in rest])
    if hot_side is None:
        return joined(df, cold)
    h = hot_side.select(*[F.col(c).alias(f"_h_{k}") for k, c in enumerate(cols)])
    is_hot = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"_h_{k}")) for k, c in enumerate(cols)])
    return joined(df, hot_side).unionByName(joined(df.join(h, is_hot, "left_anti"), cold))


def control_totals(om: DataFrame, ac: DataFrame) -> DataFrame:
    """Per year: deaths in the official mart, and rows of the per-death mart.

    Both come from the same maternal predicate, so the two numbers must agree.
    One union + one aggregation (no join).
    """
    u = (om.select("ano", F.col("obitos").cast("long").alias("_om"), F.lit(0).cast("long").alias("_ac"))
         .unionByName(ac.select("ano", F.lit(0).cast("long").alias("_om"), F.lit(1).cast("long").alias("_ac"))))
    return u.groupBy("ano").agg(F.sum("_om").alias("obitos_om"), F.sum("_ac").alias("linhas_ac"))


def invariant_violations(marts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each value is a DataFrame that must be empty."""
    om, gc, onm, uf = marts["om"], marts["gc"], marts["onm"], marts["uf"]
    totals = control_totals(om, marts["ac"])
    uf_tot = uf.groupBy("ano").agg(
        F.sum("obitos_maternos").alias("m"),
        F.sum(reduce(lambda a, b: a + b, [F.col(c) for c in uf.columns
                                           if c.startswith("obitos_descons")])).alias("d"))
    om_tot = om.groupBy("ano").agg(F.sum("obitos").alias("m"))
    onm_tot = onm.groupBy("ano").agg(F.sum("obitos").alias("d"))
    return {
        "om_vs_ac": totals.where(F.col("obitos_om") != F.col("linhas_ac")),
        "gc_not_in_om": gc.exceptAll(om.select(*gc.columns)),
        "uf_vs_marts": uf_tot.join(om_tot.join(onm_tot, "ano", "full"), "ano", "full")
        .where(~F.coalesce(uf_tot.m, F.lit(0)).eqNullSafe(F.coalesce(om_tot.m, F.lit(0)))
               | ~F.coalesce(uf_tot.d, F.lit(0)).eqNullSafe(F.coalesce(onm_tot.d, F.lit(0)))),
    }
