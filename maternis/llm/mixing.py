"""Operator 3: mixing sources to target weights by temperature, all in DataFrame operations.

Token shares p of the sources are raised to an exponent and normalised,
w ~ p ** x. The exponent is bisected in [0, 1]: the largest whose weights reach
the target entropy (a share of the entropy of equal weights), or the smallest
whose repetition (passes over a source) stays within the limit, whichever is
larger: the repetition limit is never exceeded. The budget defaults to one
whole pass of the source that the weights repeat least.

The weights are realised as block permutations. Every pass over a source is a
permutation of its documents by a seeded hash; documents of a source follow one
another at positions that grow with their tokens, so that each of ``blocks``
equal blocks of the output holds the sources by their weights. A document is
taken in a pass while its first token lies within the source's budget.

Positions are prefix sums in two levels (cells of the hash range within a
source and pass, then documents within a cell), so that a source with a third of
all rows is spread over many tasks. Sources are a table, never a list on the
driver; the driver sees one row of totals for each exponent that the bisection tries.

A budget that no exponent keeps within the repetition limit is an error.

Defined results: a null source is a source of its own; null and empty texts
have no tokens, are taken in the first pass, in later ones where the budget
lasts, and take none of it; sources without tokens get weight 0 and one pass;
rows with equal ids or texts are taken like any others; an empty table gives an
empty result. Only key, source, text and the payload are read; other columns may
have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Halvings of the bisection, and how many of them one job decides.
STEPS, HALVINGS = 40, 6
#: Documents of a cell of the permutation, about.
CELL_ROWS = 2_000
SEED = 20


@dataclass(frozen=True)
class Target:
    """Entropy as a share of that of equal weights (None: no target), most passes over a
    source, tokens of the output (None: one pass of the least repeated source), blocks."""

    entropy: float | None = 0.95
    repetition: float | None = 2.0
    budget: float | None = None
    blocks: int = 1_000


def token_count(text: str = "text") -> Column:
    """Runs of characters that are not white space."""
    return F.regexp_count(text_or_empty(text), F.lit(r"\S+")).cast("bigint")


def source_totals(docs: DataFrame, source: str, tokens: str) -> DataFrame:
    """``source, rows, tokens, p`` of every source: partial sums in the map tasks, so a hot source costs one row each."""
    sums = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("rows"), F.sum(tokens).alias("tokens"))
    sums = written(sums, "sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    return sums.withColumn("p", F.when(F.lit(total) > 0, F.col("tokens") / F.lit(float(total) or 1.0)).otherwise(0.0))


def at_exponents(totals: DataFrame, exponents: list[float], target: Target) -> list[tuple[float, float, float]]:
    """Entropy share, largest repetition and budget of the weights p ** x for each exponent x, in one aggregation."""
    raised = totals.where("tokens > 0").select("p", "tokens", F.posexplode(F.array(*map(F.lit, exponents))).alias("at", "x"))
    rows = raised.withColumn("u", F.pow("p", "x")).groupBy("at").agg(
        F.sum("u").alias("z"), F.sum(F.col("u") * F.log("u")).alias("h"), F.count(F.lit(1)).alias("n"),
        F.max(F.col("u") / F.col("tokens")).alias("most"), F.min(F.col("u") / F.col("tokens")).alias("least"))
    out = [(1.0, 0.0, 0.0)] * len(exponents)
    for row in rows.collect():  # one row an exponent
        entropy = math.log(row["z"]) - row["h"] / row["z"]
        budget = target.budget if target.budget is not None else row["z"] / row["least"]
        out[row["at"]] = entropy / math.log(row["n"]) if row["n"] > 1 else 1.0, row["most"] / row["z"] * budget, budget
    return out


def find_exponent(totals: DataFrame, target: Target) -> tuple[float, float]:
    """The exponent and the budget, by bisection; both limits fall or rise steadily with it.

    A job decides several halvings at once: it tries all exponents that these could come to."""
    def fits(result: tuple) -> bool:
        """Whether the weights are even enough: then a larger exponent may do too."""
        return target.entropy is not None and result[0] >= target.entropy

    def repeats(result: tuple) -> bool:
        return target.repetition is not None and result[1] > target.repetition * (1 + 1e-12)

    def bisect(low: float, high: float, holds) -> tuple[float, float]:
        """The last place in ``STEPS`` halvings where ``holds`` does, and the next one."""
        for at in range(0, STEPS, HALVINGS):
            n = 1 << min(HALVINGS, STEPS - at)
            places = [low + (high - low) * k / n for k in range(n + 1)]
            found = [holds(r) for r in at_exponents(totals, places[1:-1], target)]
            k = found.index(False) if False in found else n - 1
            low, high = places[k], places[k + 1]
        return low, high

    at = lambda x: at_exponents(totals, [x], target)[0]
    low = 1.0 if target.entropy is None or fits(at(1.0)) else bisect(0.0, 1.0, fits)[0]
    if repeats(at(low)):
        low = bisect(low, 1.0, repeats)[1]
    last = at(low)
    if target.budget is not None and repeats(last):
        raise ValueError(f"a budget of {target.budget:g} tokens repeats some source more than {target.repetition:g} times at any exponent")
    return low, last[2]


def mixing_plan(docs: DataFrame, target: Target, source: str, tokens: str) -> DataFrame:
    """``source, rows, tokens, p, weight, budget, passes`` of every source."""
    totals = written(source_totals(docs, source, tokens), "totals")
    x, budget = find_exponent(totals, target)
    z = totals.where("tokens > 0").agg(F.sum(F.pow("p", F.lit(x)))).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.pow("p", F.lit(x)) / F.lit(z)).otherwise(0.0)
    share = F.col("weight") * F.lit(float(budget))
    # whole tokens; the tolerance keeps an exact number of passes exact
    return totals.withColumn("weight", weight).withColumn(
        "budget", F.floor(share + 1e-6 * F.greatest(F.lit(1.0), share / 1e6))).withColumn(
        "passes", F.when(F.col("tokens") > 0, F.ceil(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int"))


def mix(docs: DataFrame, target: Target = Target(), source: str = "source", key: str = "doc_id",
        text: str = "text", payload: tuple[str, ...] = ()) -> DataFrame:
    """One row per taken pass of a document: ``key, source, n_tokens, pass, start``
    (tokens of the source before it), ``block`` (of ``target.blocks``) and the ``payload`` columns."""
    slim = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), token_count(text).alias("_n"),
                       F.xxhash64(text_or_empty(text)).alias("_text"),
                       F.struct(*[F.col(c) for c in payload]).alias("_row") if payload else F.lit(None).cast("int").alias("_row"))
    counts = written(slim.drop("_row"), "counts")
    plan = mixing_plan(counts, target, "_source", "_n")
    plan = plan.withColumn("cells", F.greatest(F.lit(1), F.ceil(F.col("rows") / CELL_ROWS)).cast("bigint")).select(
        F.col("source").alias("s"), "tokens", "budget", "passes", "cells")
    plan = written(plan, "plan")

    def passes(rows: DataFrame) -> DataFrame:
        out = rows.join(plan, rows["_source"].eqNullSafe(plan["s"])).withColumn(
            "pass", F.explode(F.sequence(F.lit(0), F.greatest(F.col("passes"), F.lit(1)) - 1)))
        draw = F.xxhash64(F.lit(SEED), "pass", F.col("_key").cast("string"), "_text")
        return out.withColumn("draw", draw).withColumn("cell", F.pmod(F.col("draw"), F.col("cells")))

    order = ["_source", "pass", "cell"]
    cells = passes(counts).groupBy(*order).agg(F.sum("_n").alias("in_cell"), F.first("tokens").alias("tokens"))
    before = Window.partitionBy("_source", "pass").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(cells.withColumn("cell_start", F.coalesce(F.sum("in_cell").over(before), F.lit(0))).select(
        F.col("_source").alias("s2"), F.col("pass").alias("p2"), F.col("cell").alias("c2"), "cell_start"), "cells")
    inside = Window.partitionBy(*order).orderBy("draw", "_key", "_text").rowsBetween(Window.unboundedPreceding, -1)
    rows = passes(slim if payload else counts.withColumn("_row", F.lit(None).cast("int")))
    rows = rows.withColumn("in_cell", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    rows = rows.join(starts, rows["_source"].eqNullSafe(starts["s2"]) & (rows["pass"] == starts["p2"]) & (rows["cell"] == starts["c2"]))
    rows = rows.withColumn("start", F.col("pass") * F.col("tokens") + F.col("cell_start") + F.col("in_cell"))
    taken = rows.where((F.col("start") < F.col("budget")) | (F.col("_n") == 0) & (F.col("pass") == 0))
    block = F.when(F.col("budget") > 0, F.least(F.floor(F.col("start") * target.blocks / F.col("budget")),
                                                F.lit(target.blocks - 1))).otherwise(0).cast("int")
    return taken.select(F.col("_key").alias(key), F.col("_source").alias(source), F.col("_n").alias("n_tokens"),
                        "pass", "start", block.alias("block"), "draw", *[F.col(f"_row.{c}").alias(f"row_{c}") for c in payload])
