"""Set-like joins: append of disjoint year ranges and the null-safe natural full join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(*frames: DataFrame) -> DataFrame:
    """Union all by column name; columns missing on one side are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def natural_full_join(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Full outer join on all common columns (or ``on``), where null matches null.

    Keys come out once (coalesced), in ``a``'s order, followed by ``a``'s and
    then ``b``'s other columns. The condition is a conjunction of
    ``eqNullSafe`` terms, which Spark plans as a sort-merge join on the keys.
    """
    keys = on if on is not None else [c for c in a.columns if c in set(b.columns)]
    la, lb = a.alias("_l"), b.alias("_r")
    cond = reduce(lambda x, y: x & y,
                  [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys])
    out = la.join(lb, cond, "full_outer")
    rest_a = [c for c in a.columns if c not in keys]
    rest_b = [c for c in b.columns if c not in keys and c not in rest_a]
    return out.select(
        *[F.coalesce(F.col(f"_l.{k}"), F.col(f"_r.{k}")).alias(k) for k in keys],
        *[F.col(f"_l.{c}").alias(c) for c in rest_a],
        *[F.col(f"_r.{c}").alias(c) for c in rest_b],
    )
