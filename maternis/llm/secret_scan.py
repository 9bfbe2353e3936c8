"""Operator 2: secret scan with multipart credential linking, in DataFrame operations.

Base kinds (``assign``, ``access``, ``hex``) are found by their patterns and
always reported. Weak parts (identifier-like and secret-like strings, and
endpoints) are common in clean texts, and are reported only together with their
complement in a scope of ``SCOPE`` code points around them:

    weak_id      with a secret (base assign or hex, or a weak secret)
    weak_secret  with an identifier (base access, or a weak identifier) or an endpoint
    endpoint     with an identifier and a secret

The link is an interval join: intervals are dealt to bins of ``SCOPE`` code
points of their document, joined on document and bin, and compared there. Only
parts are shuffled, never texts; a long document is spread over its bins.

Spans are code points, end exclusive, leftmost and non-overlapping per kind;
weak parts that overlap a base span are that span's. Defined results: null and
empty texts have no spans; rows are told apart by id and text, so repeated ids
with different texts don't mix and repeated rows have equal results; an empty
table gives an empty result. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

SCOPE = 200
#: Kinds in the order of the report, and the base patterns.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a maximal run of 24 or more, as runs that fail are dropped whole
#: Weak parts: an upper-case identifier with a digit, or a named account; a long mixed string, or a shorter
#: hexadecimal one (a longer one is of the base); a web address, or an IPv4 address with a port. None has a greatest
#: length but the last; possessive quantifiers keep the matching of long runs linear.
WEAK_ID = (r"\b(?=[A-Z]*+[0-9])(?=[0-9]*+[A-Z])[A-Z0-9]{16,}+\b"
           r"|(?i:user(?:name)?|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}+")
WEAK_SECRET = (r"(?<![A-Za-z0-9+/=])(?=[A-Z0-9+/]*+[a-z])(?=[a-z0-9+/]*+[A-Z])(?=[A-Za-z+/]*+[0-9])"
               r"[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/=])|\b(?=[a-f]*[0-9])[0-9a-f]{16,23}\b")
ENDPOINT = r"https?://[A-Za-z0-9][^\s\"'<>]{2,}+|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}\b"
#: What a text must hold for its weak parts to matter: cheap to look for.
HINT = r"[A-Z0-9]{16}|[A-Za-z0-9+/]{32}|[0-9a-f]{16}|https?://|[0-9]:[0-9]{2}|[:=]"


#: Matches or spans of a text that are folded at a time: arrays grow by copying, so a fold over all of them would take
#: time by the square of their number.
FOLD = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blocks_of(items: Column) -> Column:
    """array<array>: the items in blocks of ``FOLD``."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / FOLD), F.lit(0)).cast("int")),
                       lambda j: F.slice(items, j * FOLD + 1, FOLD))


def running(values: Column, first: Column, add: Callable[[Column, Column], Column]) -> Column:
    """array: ``first``, then what the values up to each place add up to."""
    return F.aggregate(values, F.array(first), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))


def match_spans(text: Column, pattern: str, least: int = 0) -> Column:
    """array<struct<start, end>> of the pattern's matches, leftmost and non-overlapping, in code points.

    ``least``: shortest length of group 1 (matches that fail are dropped, but consumed). The text between
    matches comes from ``split``; the running sum of the lengths gives the places, block by block."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if least else 0))
    parts = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"), group.alias("group")),
                        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["found"]), F.lit(0)).alias("size"),
                                           (x["found"].isNotNull() & (F.length(x["group"]) >= least)).alias("keep")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["size"]).alias("end"))
        return F.struct((start + x["size"]).alias("at"), F.when(x["keep"], F.concat(acc["out"], F.array(span)))
                        .otherwise(acc["out"]).alias("out"))

    def spans(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
        each = F.zip_with(blocks, F.slice(running(sums, F.lit(0), lambda a, n: a + n), F.lit(1), F.size(blocks)),
                          lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"]))
        return F.flatten(each)
    return F.when(text.rlike(pattern), let(parts, lambda p: let(blocks_of(p), spans))).otherwise(none)


def tagged(spans: Column, kind: str) -> Column:
    """array<struct<start, kind, end>>, which sorts by start, then kind as listed."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                                                 s["end"].alias("end")))


def free_of(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base``; whole blocks of it that lie elsewhere are passed over."""
    def extent(block: Column) -> Column:
        return F.struct(block.alias("items"), F.array_min(F.transform(block, lambda b: b["start"])).alias("lo"),
                        F.array_max(F.transform(block, lambda b: b["end"])).alias("hi"))

    def meets(w: Column, blocks: Column) -> Column:
        return F.exists(blocks, lambda x: (x["lo"] < w["end"]) & (w["start"] < x["hi"]) & F.exists(
            x["items"], lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    free = let(F.transform(blocks_of(base), extent), lambda blocks: F.filter(
        spans, lambda w: ~F.coalesce(meets(w, blocks), F.lit(False))))
    return F.when((F.size(base) == 0) | (F.size(spans) == 0), spans).otherwise(free)


def row_key(key: str, text: str) -> Column:
    return F.md5(F.concat_ws("\x00", F.coalesce(F.col(key).cast("string"), F.lit("")), text_or_empty(text)).cast("binary"))


def scan_parts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, row, base, parts``: base spans, and all parts of texts with weak ones."""
    t = F.col("_t")
    rows = docs.select(F.col(key), row_key(key, text).alias("row"), text_or_empty(text).alias("_t"))
    rows = rows.select(key, "row", "_t", match_spans(t, ASSIGN, 6).alias("assign"), match_spans(t, ACCESS).alias("access"),
                       match_spans(t, HEX).alias("hex"))
    long_enough = F.filter("access", lambda s: s["end"] - s["start"] >= 20)
    rows = rows.withColumn("base", F.concat(tagged(F.col("assign"), "assign"), tagged(long_enough, "access"),
                                            tagged(F.col("hex"), "hex")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    weak = F.concat(*[free_of(tagged(match_spans(t, p), k), F.col("base"))
                      for k, p in (("weak_id", WEAK_ID), ("weak_secret", WEAK_SECRET), ("endpoint", ENDPOINT))])
    rows = rows.withColumn("weak", F.when(t.rlike(HINT), weak).otherwise(none))
    parts = F.when((F.size("weak") > 0) & (F.size("base") + F.size("weak") > 1), F.concat("base", "weak")).otherwise(none)
    return rows.select(key, "row", "base", parts.alias("parts"))


def linked_parts(scanned: DataFrame) -> DataFrame:
    """``row, linked``: the weak parts whose complement lies in their scope."""
    parts = scanned.where(F.size("parts") > 0).select("row", "parts").distinct().select("row", F.explode("parts").alias("p"))
    parts = parts.select("row", "p.*")
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / SCOPE), F.floor(b / SCOPE)))
    weak = parts.where(F.col("kind") >= KINDS.index("weak_id")).withColumn(
        "bin", bins(F.col("start") - SCOPE, F.col("end") + SCOPE))
    other = parts.select("row", F.col("start").alias("s"), F.col("end").alias("e"), F.col("kind").alias("k"),
                         bins(F.col("start"), F.col("end") - 1).alias("bin"))
    near = weak.join(other, ["row", "bin"]).where(
        (F.col("s") <= F.col("end") + SCOPE) & (F.col("e") >= F.col("start") - SCOPE)
        & ~((F.col("s") == F.col("start")) & (F.col("k") == F.col("kind"))))
    has = lambda *kinds: F.max(F.col("k").isin([KINDS.index(x) for x in kinds]))
    met = near.groupBy("row", "start", "kind", "end").agg(
        has("access", "weak_id").alias("an_id"), has("assign", "hex", "weak_secret").alias("a_secret"),
        has("endpoint").alias("an_endpoint"))
    kind = lambda x: F.col("kind") == KINDS.index(x)
    met = met.where(kind("weak_id") & F.col("a_secret") | kind("weak_secret") & (F.col("an_id") | F.col("an_endpoint"))
                    | kind("endpoint") & F.col("an_id") & F.col("a_secret"))
    return met.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, row, base, spans``: sorted arrays of the base spans and of all reported spans."""
    scanned = written(scan_parts(docs, key, text), "secret-parts")
    linked = linked_parts(scanned)
    spans = F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.concat("base", F.coalesce("linked", "base")))
    return scanned.join(linked, "row", "left").select(
        key, "row", F.array_sort("base").alias("base"), F.array_sort(spans).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def secret_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("bigint")
    return find_secrets(docs, key, text).select(
        key, *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each group of overlapping spans (sorted) replaced by the mask; each block of spans works on
    its own part of the text."""
    last = lambda block: F.array_max(F.transform(block, lambda s: s["end"]))

    def part(block: Column, before: Column) -> Column:
        def fold(own: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                more = F.concat(acc["out"], F.substring(own, acc["at"] - before + 1, s["start"] - acc["at"]), F.lit(mask))
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                                F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))
            return F.aggregate(block, F.struct(before.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])
        return let(F.substring(text, before + 1, F.greatest(last(block) - before, F.lit(0))), fold)

    def whole(blocks: Column) -> Column:
        return let(running(F.transform(blocks, last), F.lit(0), lambda a, e: F.greatest(a, e)), lambda ends: F.concat(
            F.array_join(F.zip_with(blocks, F.slice(ends, F.lit(1), F.size(blocks)), part), ""),
            F.substring(text, F.element_at(ends, -1) + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(let(blocks_of(spans), whole))


def mask_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of the text masked; texts without spans stay as they are."""
    hit = find_secrets(docs, key, text).where(F.size("spans") > 0).select(
        F.col("row").alias("_row"), F.col("spans").alias("_spans")).dropDuplicates(["_row"])
    rows = docs.withColumn("_own", row_key(key, text))
    out = rows.join(hit, rows["_own"] == hit["_row"], "left").withColumn(
        text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(masked(F.col(text), F.col("_spans"), mask)))
    return out.select(*docs.columns)
