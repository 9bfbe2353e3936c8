"""Dimension joins: municipality and ICD enrichment, code-list semi-join,
ICD interval (range) join and narrowest-interval pick.

Broadcasts are only issued behind a row-count check (``bounded_broadcast``);
above the bound the plain join is returned and Catalyst/AQE pick a shuffle
join instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Size bounds for broadcast sides. Brazil has ~5.6k municipalities and ICD-10
# ~14k four-character codes; the bounds leave room for other registries.
MAX_DIMENSION_ROWS = 200_000


_STATIC_BOUND = "_maternis_max_rows"
_checked: dict[tuple, bool] = {}


def with_row_bound(df: DataFrame, max_rows: int) -> DataFrame:
    """Declare a static row bound, e.g. for a table built from a fixed list.
    ``bounded_broadcast`` then needs no job to prove the size."""
    try:
        setattr(df, _STATIC_BOUND, max_rows)
    except AttributeError:  # a DataFrame class without instance attributes: checked by a job instead
        pass
    return df


def fits(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows.

    A declared static bound is used as is. Otherwise a job reads at most
    ``max_rows + 1`` rows of the (small) side, never the fact table; the answer
    is remembered for the plan's semantic hash within the session.
    """
    static = getattr(df, _STATIC_BOUND, None)
    if static is not None:
        return static <= max_rows
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), max_rows)
    if key not in _checked:
        _checked[key] = df.limit(max_rows + 1).count() <= max_rows
    return _checked[key]


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_DIMENSION_ROWS) -> DataFrame:
    """``F.broadcast(df)`` if ``df`` provably has at most ``max_rows`` rows,
    else ``df`` unchanged (Catalyst/AQE then plan a shuffle join)."""
    return F.broadcast(df) if fits(df, max_rows) else df


#: Keys over which the rows without a key are dealt in a shuffle join.
NULL_KEYS = 1_024


def enrich_municipality(df: DataFrame, municipalities: DataFrame, key: str = "codmunres",
                        max_rows: int = MAX_DIMENSION_ROWS) -> DataFrame:
    """Left join on the residence municipality; unmatched rows keep null geography.

    Above the broadcast bound the rows without a municipality, which match nothing, are dealt over
    ``NULL_KEYS`` keys that no municipality has, so that they do not all meet in one task."""
    if fits(municipalities, max_rows):
        return df.join(F.broadcast(municipalities), on=key, how="left")
    rest = [c for c in municipalities.columns if c != key]
    dealt = F.concat(F.lit("\0"), F.pmod(F.monotonically_increasing_id(), F.lit(NULL_KEYS)).cast("string"))
    rows = df.withColumn("_key", F.coalesce(F.col(key).cast("string"), dealt))
    side = municipalities.withColumn("_key", F.col(key).cast("string")).drop(key)
    return rows.join(side, "_key", "left").select(key, *[c for c in df.columns if c != key], *rest)


def enrich_icd(df: DataFrame, icd: DataFrame, key: str = "causabas") -> DataFrame:
    """Left join on the (recoded) underlying cause."""
    return df.join(bounded_broadcast(icd), on=key, how="left")


def keep_codes(df: DataFrame, codes: DataFrame, key: str = "causabas") -> DataFrame:
    """Rows whose ``key`` is in the code list (left semi-join; null never matches)."""
    small = codes.select(key).distinct()
    bound = getattr(codes, _STATIC_BOUND, None)
    if bound is not None:
        small = with_row_bound(small, bound)
    return df.join(bounded_broadcast(small), on=key, how="left_semi")


def category_ordinal(code: Column) -> Column:
    """Letter + two digits -> a number, so that interval widths can be compared."""
    return (F.ascii(F.substring(code, 1, 1)) - 65) * 100 + F.substring(code, 2, 2).try_cast("int")


def by_category(intervals: DataFrame, lo: str, hi: str, *labels: str) -> DataFrame:
    """One row per interval and category in it: an interval join becomes an equi-join on the ordinal."""
    return intervals.select(lo, hi, *labels, F.explode(F.sequence(
        category_ordinal(F.col(lo)), category_ordinal(F.col(hi)))).alias("_ordinal")).where(
        category_ordinal(F.col(lo)) <= category_ordinal(F.col(hi)))


def interval_matches(keys: DataFrame, key: str, intervals: DataFrame, lo: str = "CATINIC",
                     hi: str = "CATFIM", label: str = "DESCRICAO") -> DataFrame:
    """All intervals, nested to any depth, that contain each distinct key's three-character category
    (a letter and two digits; other categories match nothing).

    Each interval is expanded to its categories, so the join is an equi-join on
    the category's ordinal, at any size of either side.
    Output: key, category, lo, hi, label, width.
    """
    cat = F.substring(F.col(key), 1, 3)
    k = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_cat", cat).withColumn(
        "_ordinal", category_ordinal(cat))
    return (
        k.join(by_category(intervals, lo, hi, label), "_ordinal")
        .select(
            F.col(key), F.col("_cat").alias("categoria"), F.col(lo), F.col(hi), F.col(label),
            (category_ordinal(F.col(hi)) - category_ordinal(F.col(lo))).alias("largura"),
        )
    )


def narrowest_interval(matches: DataFrame, key: str, lo: str = "CATINIC") -> DataFrame:
    """One row per key: the narrowest containing interval (ties: the later start)."""
    w = Window.partitionBy(key).orderBy(F.col("largura").asc(), F.col(lo).desc())
    return matches.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def interval_tree(intervals: DataFrame, lo: str = "CATINIC", hi: str = "CATFIM", label: str = "DESCRICAO") -> DataFrame:
    """The intervals as a tree: ``no, pai, profundidade, ordem`` and the interval's columns.

    ``no`` is the interval's text (``A00-B99``). The parent ``pai`` is the narrowest other interval around it (null:
    none), depth counts the intervals around it, and ``ordem`` is the preorder from 1: by start, the widest first.
    An interval that crosses another one is no part of it. Equal intervals are one node, with the least label. The
    number of categories (2,600) bounds the nodes that lie around a category to the tree's depth, so the equi-join on
    the first category emits one row a node and ancestor.
    """
    nodes = intervals.groupBy(F.col(lo).alias("CATINIC"), F.col(hi).alias("CATFIM")).agg(F.min(label).alias("DESCRICAO")).where(
        category_ordinal(F.col("CATINIC")) <= category_ordinal(F.col("CATFIM")))
    nodes = nodes.select(F.concat_ws("-", "CATINIC", "CATFIM").alias("no"), "CATINIC", "CATFIM", "DESCRICAO",
                         category_ordinal(F.col("CATINIC")).alias("_lo"), category_ordinal(F.col("CATFIM")).alias("_hi"))
    around = by_category(nodes, "CATINIC", "CATFIM", "no", "_lo", "_hi").select(
        F.col("_ordinal").alias("_at"), F.col("no").alias("_no"), F.col("_lo").alias("_from"), F.col("_hi").alias("_to"))
    pairs = nodes.join(around, (F.col("_lo") == F.col("_at")) & (F.col("_hi") <= F.col("_to")) & (F.col("no") != F.col("_no")))
    up = pairs.groupBy("no").agg(F.min(F.struct((F.col("_to") - F.col("_from")).alias("width"), F.col("_no").alias("no")))["no"]
                                 .alias("pai"), F.count(F.lit(1)).cast("int").alias("profundidade"))
    # one row a distinct interval of categories
    order = Window.orderBy(F.col("_lo").asc(), F.col("_hi").desc())
    return nodes.join(up, "no", "left").select(
        "no", "pai", F.coalesce("profundidade", F.lit(0)).alias("profundidade"), F.row_number().over(order).alias("ordem"),
        "CATINIC", "CATFIM", "DESCRICAO")


def icd_dimension(causes: DataFrame, chapters: DataFrame, key: str = "causabas",
                  assume_distinct: bool = False) -> DataFrame:
    """causabas -> causabas_categoria, capitulo_cid10, for every distinct cause.

    The category is the first three characters; the chapter is the chapter
    interval containing it (null in the gaps between chapters). Pass
    ``assume_distinct`` for a code list known to be duplicate-free (skips a
    shuffle).
    """
    codes = causes.select(key).where(F.col(key).isNotNull())
    if not assume_distinct:
        codes = codes.distinct()
    distinct_causes = codes.withColumn("causabas_categoria", F.substring(F.col(key), 1, 3))
    # the narrowest interval of a category, so overlapping intervals never multiply certificates; a letter
    # and two digits make 2,600 categories at most
    width = category_ordinal(F.col("CATFIM")) - category_ordinal(F.col("CATINIC"))
    of_category = by_category(chapters, "CATINIC", "CATFIM", "DESCRICAO").groupBy("_ordinal").agg(
        F.min(F.struct(width.alias("width"), (-category_ordinal(F.col("CATINIC"))).alias("start"), "DESCRICAO")).alias("iv"))
    of_category = with_row_bound(of_category.select("_ordinal", F.col("iv.DESCRICAO").alias("capitulo_cid10")), 2_600)
    out = distinct_causes.withColumn("_ordinal", category_ordinal(F.col("causabas_categoria"))).join(
        bounded_broadcast(of_category), "_ordinal", "left").select(key, "causabas_categoria", "capitulo_cid10")
    bound = getattr(causes, _STATIC_BOUND, None)
    return with_row_bound(out, bound) if bound is not None else out
