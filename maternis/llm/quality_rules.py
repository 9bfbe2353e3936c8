"""Operator 10: quality rules as a learned decision list.

One pass over the texts counts interpretable statistics; sequential covering
then learns from labelled statistics. Each rule is grown condition by condition
(of all midpoints the threshold with the best information gain, on two thirds of
the labelled rows; a rule ends when nothing gains), pruned on the other third, and accepted while it is precise there; the
rows that it covers are set aside and the next rule is learned. The list is
emitted as an ordered Spark conditional expression that first applies the base
rules. The fit uses at most ``MAX_LABELLED`` labelled rows (the lowest hashes of
the id); the statistics and the verdicts cover every row and whole texts.

Defined results: a null text is an empty text (no words: fails the base rules);
ratios over zero are 0; repeated rows are judged one by one; an id with several
labels takes the lowest; null labels are ignored; without labelled rows of both
classes the list is empty and only the base rules decide; an empty table gives an
empty result. Only key and text (and the label's key and label) are read; other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_rows, text_or_empty

#: Most labelled rows that the fit uses.
MAX_LABELLED = 20_000
#: A rule must be this precise on the pruning rows, and cover this many of them.
MIN_PRECISION = 0.95
MIN_COVERED = 3
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower",
          "n_digits", "n_bangs", "n_same", "n_distinct")
#: Statistics that conditions are made of.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"), "bangs_per_word": ("n_bangs", "n_words"),
    "upper_share": ("n_upper", "n_letters"), "digit_share": ("n_digits", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "same_share": ("n_same", "n_words"), "distinct_share": ("n_distinct", "n_words"),
    "mean_word": ("word_chars", "n_words"), "words_per_line": ("n_words", "n_lines"),
}


def count_text(text: str) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``COUNTS``."""
    raw = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()  # ASCII white space only
    n = len(words)
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeated = 0
    if n > 3:
        windows = (hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[2:]
        ordered = np.sort(windows)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            found = np.isin(windows, twice)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k:n - 2 + k] |= found
            repeated = int(covered.sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(raw) - int(hist[0x80:0xC0].sum())
    blanks = int(hist[list(BLANKS)].sum())
    return (n, chars - blanks, int(hist[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated, len(lines),
            int(hist[0x41:0x5B].sum()), int(hist[0x61:0x7B].sum()), int(hist[0x30:0x3A].sum()), int(hist[0x21]),
            int((hashes[1:] == hashes[:-1]).sum()), len(set(words)))


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the counts of every row."""
    def rows(columns: list[list]) -> Iterator[tuple]:
        return ((k, *count_text(t)) for k, t in zip(*columns))
    return map_rows(docs.select(key, text_or_empty(text).alias(text)), rows,
                    f"{key} {dict(docs.dtypes)[key]}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def ratio(name: str) -> Column:
    over, under = RATIOS[name]
    below = F.col("n_upper") + F.col("n_lower") if under == "n_letters" else F.col(under)
    return F.when(below > 0, F.col(over) / below).otherwise(0.0)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


# ---------------------------------------------------------------------------
# learning
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # value >= threshold, else value <= threshold
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.name]
        return v >= self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = ratio(self.name)
        return v >= self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule])


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Conditions added while they gain information about the bad rows; every midpoint between two values is tried."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while True:
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if p == 0 or n == 0:
            break
        best, gain = None, 0.0
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, cum = v[order], np.r_[0, np.cumsum(b[order])]
            at = np.flatnonzero(v[1:] != v[:-1]) + 1  # rows below a midpoint
            cuts = (v[at] + v[at - 1]) / 2
            for above, pos, all_ in ((True, p - cum[at], len(v) - at), (False, cum[at], at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pos > 0, pos * (np.log2(pos / all_) - np.log2(p / (p + n))), 0.0)
                if len(g) and g.max() > gain + 1e-12:
                    best, gain = Condition(name, above, float(cuts[g.argmax()])), float(g.max())
        if best is None:
            break
        held = inside & best.holds(x)
        if held.sum() == inside.sum():  # a midpoint that rounds to a value
            break
        rule.append(best)
        inside = held
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The leading conditions with the best (p - n) / (p + n) on the pruning rows."""
    def worth(r: Rule) -> tuple[float, int]:
        c = covers(r, x)
        p, n = int(bad[c].sum()), int((~bad[c]).sum())
        return ((p - n) / (p + n) if p + n else -1.0, -len(r))
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray) -> list[Rule]:
    """Sequential covering; ``part`` marks the rows that rules are pruned on."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while True:
        g, h = left & ~part, left & part
        rule = grow({k: v[g] for k, v in x.items()}, bad[g])
        if not rule:
            return rules
        held = {k: v[h] for k, v in x.items()}
        rule = prune(rule, held, bad[h])
        c = covers(rule, held)
        if c.sum() < MIN_COVERED or bad[h][c].mean() < MIN_PRECISION:
            return rules
        rules.append(rule)
        left &= ~covers(rule, x)


def fit_rules(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
              max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules for rows that labels mark 0, from at most ``max_labelled`` labelled rows."""
    once = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(
        F.min(label).alias("_label"))
    rows = stats.select(key, *[ratio(r).alias(r) for r in RATIOS]).join(once, key)
    sample = bounded_sample(rows, key, max_labelled).withColumn(
        "_order", F.xxhash64(F.col(key).cast("string"))).drop(key).toPandas()
    bad = (sample["_label"] == 0).to_numpy()
    if not len(bad) or bad.all() or not bad.any():
        return []
    part = (sample["_order"].to_numpy() % 3) == 0
    return learn({r: sample[r].to_numpy(np.float64) for r in RATIOS}, bad, part)


def decision(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression: true keeps the row."""
    out = F.when(base_failed(), False)
    for rule in rules:
        cond = rule[0].column()
        for c in rule[1:]:
            cond = cond & c.column()
        out = out.when(cond, False)
    return out.otherwise(True)


def reason(rules: list[Rule]) -> Column:
    """Which entry of the list decided."""
    out = F.when(base_failed(), "base")
    for rule in rules:
        cond = rule[0].column()
        for c in rule[1:]:
            cond = cond & c.column()
        out = out.when(cond, " and ".join(map(str, rule)))
    return out


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    return stats.select("*", base_failed().alias("base_failed"), decision(rules).alias("kept"),
                        reason(rules).alias("failed_rule"))
