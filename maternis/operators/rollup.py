"""Two-level nested roll-up of a report table (chapter -> category -> rows).

One ``rollup`` gives the category rows, the chapter rows and the grand total
(the footer) in a single aggregation with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


LEVEL_CATEGORY, LEVEL_CHAPTER, LEVEL_TOTAL = "categoria", "capitulo", "total"

# Labels shown for columns that are not aggregated at group level.
CONSTANT_LABELS = {
    "periodo_do_obito": "Todos",
    "racacor": "Todas",
    "investigacao_cmm": "Todas as categorias",
}


def unique_join(c: str) -> F.Column:
    """Distinct values of a group, sorted and joined with ', ' (bounded by the
    column's domain, a handful of labels)."""
    return F.array_join(F.array_sort(F.collect_set(c)), ", ")


def nested_rollup(table: DataFrame, outer: str = "capitulo_cid10", inner: str = "causabas_categoria") -> DataFrame:
    """Group rows of the nested table.

    Output columns: nivel, capitulo_cid10, causabas_categoria, ocorrencias
    (leaf rows in the group), obitos (sum), tipo_de_morte_materna (distinct
    values joined, when the table has it), and the constant labels.
    Margin rows are found with ``grouping_id``; a null chapter stays a group
    of its own.
    """
    aggs = [
        F.sum(F.col("obitos").cast("long")).alias("obitos"),
        F.count(F.lit(1)).alias("ocorrencias"),
        F.grouping_id().alias("_gid"),
    ]
    if "tipo_de_morte_materna" in table.columns:
        aggs.append(unique_join("tipo_de_morte_materna").alias("tipo_de_morte_materna"))
    g = table.rollup(outer, inner).agg(*aggs)
    level = (F.when(F.col("_gid") == 0, F.lit(LEVEL_CATEGORY))
             .when(F.col("_gid") == 1, F.lit(LEVEL_CHAPTER))
             .otherwise(F.lit(LEVEL_TOTAL)))
    cols = [level.alias("nivel"),
            F.when(F.col("_gid") == 3, F.lit("Total")).otherwise(F.col(outer)).alias(outer),
            F.col(inner), F.col("ocorrencias"), F.col("obitos")]
    if "tipo_de_morte_materna" in table.columns:
        cols.append(F.col("tipo_de_morte_materna"))
    cols += [F.lit(v).alias(k) for k, v in CONSTANT_LABELS.items() if k in table.columns]
    return g.select(*cols)


def grand_total(table: DataFrame) -> DataFrame:
    """Footer: total deaths of the rows shown."""
    return table.agg(F.coalesce(F.sum(F.col("obitos").cast("long")), F.lit(0)).alias("obitos"))


def values_in_order(table: DataFrame, by: list[str], value: str, position: list[str]) -> DataFrame:
    """``by, value``: the distinct values of each group in the order of their first appearance, joined with ', '.

    A row's place is its tuple of ``position`` columns (nulls first), so the order does not depend on how the rows
    are partitioned. The least place of each value is found first, with partial aggregation; a group then holds
    one row a distinct value (the column's domain, a handful of labels). Null values are left out.
    """
    first = table.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.min(F.struct(*[F.col(c) for c in position])).alias("_first"))
    listed = F.array_sort(F.collect_list(F.struct("_first", F.col(value).cast("string").alias("_value"))))
    return first.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["_value"]), ", ").alias(value))


def tree_rollup(leaves: DataFrame, tree: DataFrame, category: str = "causabas_categoria", count: str = "obitos") -> DataFrame:
    """Deaths of every node of an interval tree (``dims.interval_tree``), its descendants included.

    Output: ``no, pai, profundidade, ordem, CATINIC, CATFIM, DESCRICAO, obitos, obitos_proprios``; the last one
    counts deaths of no child, so a node's deaths are its own plus its children's. Nodes without deaths have 0.
    Leaves are summed by category before the join, so it sees 2,600 rows at most.
    """
    from . import dims
    by_category = leaves.groupBy(category).agg(F.sum(F.col(count).cast("long")).alias("_n"))
    nodes = dims.by_category(tree.select("CATINIC", "CATFIM", "no", "profundidade"), "CATINIC", "CATFIM", "no", "profundidade")
    found = by_category.withColumn("_ordinal", dims.category_ordinal(F.col(category))).join(nodes, "_ordinal")
    deepest = found.groupBy(category).agg(F.max(F.struct("profundidade", "no"))["no"].alias("_own"))
    sums = found.join(deepest, category).groupBy("no").agg(
        F.sum("_n").alias("obitos"), F.sum(F.when(F.col("no") == F.col("_own"), F.col("_n"))).alias("obitos_proprios"))
    return tree.join(sums, "no", "left").select(
        "no", "pai", "profundidade", "ordem", "CATINIC", "CATFIM", "DESCRICAO",
        F.coalesce("obitos", F.lit(0)).cast("bigint").alias("obitos"),
        F.coalesce("obitos_proprios", F.lit(0)).cast("bigint").alias("obitos_proprios"))
