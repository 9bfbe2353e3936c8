"""Operator 6: URL filter with rules and link-graph propagation, in DataFrame operations.

A rule (host, path, verdict) fits a URL of its host or a subdomain whose path
starts with the rule's; the longest fitting rule judges the URL. URLs without a
rule are judged by their host's place in the link graph: personalised PageRank
spreads trust from the trusted hosts (allow rules judge at least half of their
URLs) along links; distrust spreads from the blocked hosts (block rules judge at
least half) against the links, as a page that links to blocked hosts is suspect.
Seeds share alike. A host whose distrust exceeds its trust by more than
``MARGIN`` of an even share is blocked, any other is allowed.

Host edges are counted links of the pages' HTML to absolute addresses, summed in
the map tasks, so a host with a third of all pages costs one row an edge and
task; self-links are dropped. Each turn is one join and one sum over the edges,
written to shared storage. A walk goes on until all that is left of it could
add no more than ``REST`` of the threshold MARGIN / hosts to any one score, so
the number of turns grows with the logarithm of the hosts (some 125 at 60
hosts, 200 at ten million, if no mass leaves the graph before).

Defined results: a null URL or one without ``://`` has an empty host and path,
no rule, and is allowed; null HTML has no links; hosts without links keep their
seed share; without seeds of a kind that score is 0 everywhere; repeated rows
are judged one by one. Only the id, URL and HTML are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

DAMPING = 0.85
#: What a walk may leave out of a score, in shares of the threshold that blocks a host.
REST = 1e-6
#: Turns after which the scores of a walk are summed up and written.
FOLD = 16
#: Excess of distrust over trust that blocks a host, in shares of 1 / hosts.
MARGIN = 0.1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links to absolute addresses in HTML.
LINK = r"""(?i:href|src)\s*=\s*["']?\s*((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^\s"'<>]+)"""


@dataclass(frozen=True)
class Rule:
    """A rule that fits a host with its subdomains, and paths from a prefix on."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return host & F.col("path").startswith(self.path)


#: The rules of the registered query.
RULES = (Rule("com", "/", True), Rule("example.com", "/en/", False), Rule("www.example.com", "/en/", True),
         Rule("net", "/es/", False), Rule("net", "/fr/", False))


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """Then up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules: tuple[Rule, ...], url: str) -> DataFrame:
    """``host``, ``path``, and ``rule`` (the name of the longest fitting rule, or null) and ``rule_allows``."""
    rows = pages.withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in reversed(ranked):  # the longest is asked first
        name, allow = F.when(r.fits(), r.name).otherwise(name), F.when(r.fits(), F.lit(r.allow)).otherwise(allow)
    return rows.withColumn("rule", name).withColumn("rule_allows", allow)


def host_edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``a, b, n``: counted links from host to host."""
    target = F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)))
    links = pages.where(F.col(html).isNotNull()).select(url_host(F.col(url)).alias("a"), target.alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to"))
    links = links.select("a", url_host(to).alias("b"))
    return links.where((F.col("a") != "") & (F.col("b") != "") & (F.col("a") != F.col("b"))).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"))


def spread(hosts: DataFrame, edges: DataFrame, seed: str, a: str, b: str, error: float) -> DataFrame:
    """``host, score``: personalised PageRank from the hosts' column ``seed`` (a share), along edges a -> b.

    score = (1 - d) * sum of d ** k * (seed walked k steps); mass that reaches a host without
    edges stays there. A mass m on the way adds at most d * m to all later scores together, so the
    walk ends once that is at most ``error``."""
    out = edges.groupBy(F.col(a).alias("host")).agg(F.sum("n").alias("all"))
    steps = written(edges.select(F.col(a).alias("host"), F.col(b).alias("to"), "n").join(out, "host").select(
        "host", "to", (F.col("n") / F.col("all")).alias("p")), "steps")
    walked = hosts.where(F.col(seed) > 0).select("host", F.col(seed).cast("double").alias("m"))
    total = walked.select("host", (F.col("m") * (1 - DAMPING)).alias("s"))
    turn = 0
    while (walked.agg(F.sum("m")).first()[0] or 0.0) * DAMPING > error:
        turn += 1
        walked = written(walked.join(steps, "host").groupBy(F.col("to").alias("host")).agg(
            F.sum(F.col("m") * F.col("p") * DAMPING).alias("m")), "walk")
        total = total.unionAll(walked.select("host", (F.col("m") * (1 - DAMPING)).alias("s")))
        if turn % FOLD == 0:
            total = written(total.groupBy("host").agg(F.sum("s").alias("s")), "scores")
    return total.groupBy("host").agg(F.sum("s").alias("score"))


def host_verdicts(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url", html: str = "html") -> DataFrame:
    """``host, trust, distrust, blocked`` of every host of a page or a link."""
    judged = with_rule(pages.select(F.col(url).alias("_url")), rules, "_url").where("host != ''")
    half = lambda verdict: (2 * F.sum(F.coalesce(verdict, F.lit(False)).cast("int")) >= F.count(F.lit(1))).cast("int")
    seeds = judged.groupBy("host").agg(half(F.col("rule_allows")).alias("good"), half(~F.col("rule_allows")).alias("bad"))
    edges = written(host_edges(pages, url, html), "edges")
    linked = edges.select(F.col("a").alias("host")).unionAll(edges.select(F.col("b").alias("host"))).distinct()
    hosts = written(seeds.unionByName(linked.selectExpr("host", "0 good", "0 bad")).groupBy("host").agg(
        F.max("good").alias("good"), F.max("bad").alias("bad")), "hosts")
    n, good, bad = hosts.agg(F.count(F.lit(1)), F.sum("good"), F.sum("bad")).first()
    hosts = hosts.withColumn("trusted", F.col("good") / F.lit(float(good or 1))).withColumn(
        "blocked_share", F.col("bad") / F.lit(float(bad or 1)))
    error = REST * MARGIN / max(n, 1)
    trust = spread(hosts, edges, "trusted", "a", "b", error).withColumnRenamed("score", "trust")
    distrust = spread(hosts, edges, "blocked_share", "b", "a", error).withColumnRenamed("score", "distrust")
    out = hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left").fillna(0.0, ["trust", "distrust"])
    return out.withColumn("blocked", F.col("distrust") - F.col("trust") > F.lit(MARGIN / max(n, 1)))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url",
               html: str = "html") -> DataFrame:
    """``key, host, path, rule, verdict`` of every row."""
    hosts = host_verdicts(pages, rules, url, html).where("blocked").select(F.col("host").alias("_host"))
    rows = with_rule(pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")), rules, "_url")
    # only rows without a rule need their host; the salted copies spread a host with a third of all pages
    ruled = rows.where(F.col("rule").isNotNull()).withColumn("allowed", F.col("rule_allows"))
    salt = F.pmod(F.xxhash64("_key", "_url"), F.lit(SALTS)).cast("int")
    salted = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    free = rows.where(F.col("rule").isNull()).withColumn("_own", salt)
    free = free.join(salted, (free["host"] == salted["_host"]) & (free["_own"] == salted["_salt"]), "left").withColumn(
        "allowed", F.col("_host").isNull())
    names = ["_key", "host", "path", "rule", "allowed"]
    out = ruled.select(*names).unionAll(free.select(*names))
    return out.select(F.col("_key").alias(key), "host", "path", "rule", F.when(F.col("allowed"), "allow").otherwise("block").alias("verdict"))


#: Copies of a host's verdict in the join with the pages.
SALTS = 16
