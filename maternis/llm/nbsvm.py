"""Operator 8: quality classifier, naive Bayes support vectors.

A text is the set of its n-grams: UTF-8 byte n-grams of one to four bytes, and
n-grams of one to three word shapes (letter case, digits, symbols, repeated
words), hashed to ``BUCKETS`` indicators. Indicators are scaled by the class
log-count ratio, rows to unit length, and a linear hinge-loss model is fitted
by dual coordinate descent; a logistic curve fitted on rows apart turns margins
into scores. The fit uses at most ``MAX_LABELLED`` labelled rows (the lowest
hashes of the id) of the learning folds, one text an id; scores cover every row
and whole texts and see nothing but the text.

Defined results: a null text is an empty text (no indicators: the bias decides);
repeated rows are scored one by one; null ids and null labels are not learned
from; an id with several labels takes the lowest; without labelled rows of both
classes every score is the share of label 1 (0.5 without any); texts of any
length are scored whole; an empty table gives an empty result. Only key and text
(and the label's key and label) are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_rows, text_or_empty

BUCKETS = 1 << 17
MAX_LABELLED = 3_000
#: A score from here on predicts label 1.
THRESHOLD = 0.7
COST = 1.0
EPOCHS = 30
#: Fold of the held-out rows: crc32 of the id's text, modulo FOLDS.
FOLDS, HELD_OUT = 4, 2

SHIFT = np.uint64(64 - 17)
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
UPPER, LOWER, DIGIT, BANG, PIPE, SYMBOL, HIGH = (1 << i for i in range(7))


def byte_classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    for chars, flag in ((range(0x41, 0x5B), UPPER), (range(0x61, 0x7B), LOWER), (range(0x30, 0x3A), DIGIT),
                        (b"!?", BANG), (b"|", PIPE), (b"#*$%&<>=@_~^", SYMBOL), (range(0x80, 0x100), HIGH)):
        kind[list(chars)] = flag
    return kind


CLASSES = byte_classes()
_seen = np.zeros(BUCKETS, np.uint8)


def buckets(codes: np.ndarray, salt: int) -> np.ndarray:
    return ((codes.astype(np.uint64) + np.uint64(salt)) * ODD[salt % 4] >> SHIFT).view(np.int64)


def indicators(text: str) -> np.ndarray:
    """Sorted buckets of the n-grams of a whole text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.int32)
    wide = raw.astype(np.uint32)
    codes = wide
    for n in range(4):
        if n:
            if len(raw) <= n:
                break
            codes = (codes[:-1] << np.uint32(8)) | wide[n:]
        _seen[buckets(codes, n)] = 1
    blank = (raw == 0x20) | ((raw >= 9) & (raw <= 13))
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if len(start):
        shape = np.bitwise_or.reduceat(CLASSES[raw], start).astype(np.int64)
        words = text.encode("utf-8", "surrogatepass").split()
        same = np.fromiter(map(hash, words), np.int64, len(words))
        shape[1:] |= (same[1:] == same[:-1]).astype(np.int64) << 7
        codes = shape
        for n in range(3):
            if n:
                if len(shape) <= n:
                    break
                codes = (codes[:-1] << 8) | shape[n:]
            _seen[buckets(codes, 5 + n)] = 1
    out = np.flatnonzero(_seen).astype(np.int32)
    _seen[out] = 0
    return out


@dataclass(frozen=True)
class Model:
    """Weights times ratios, squared ratios, bias, and the curve's slope and offset."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, row: np.ndarray) -> float:
        return float(self.weight[row].sum() / max(np.sqrt(self.square[row].sum()), 1e-12)) + self.bias

    def score(self, text: str) -> float:
        z = self.slope * self.margin(indicators(text)) + self.offset
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray,
                 epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of the L2-regularised hinge loss, one dual variable at a time."""
    w, alpha = np.zeros(BUCKETS + 1), np.zeros(len(y))
    diagonal = np.array([v @ v for v in values]) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            row, v = rows[i], values[i]
            gradient = y[i] * (w[row] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]):
                w[row] += step * v
                w[-1] += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w


def fit_curve(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve by Newton steps on smoothed targets."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, b = np.stack([margin, np.ones(len(margin))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -60, 60)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - target) + 1e-3 * b)
        b -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Model of indicator rows and labels 0 and 1."""
    nothing = np.zeros(BUCKETS)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        return Model(nothing, nothing, 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = [np.bincount(np.concatenate([r for r, k in zip(rows, y) if k == c]),
                          minlength=BUCKETS) + 1.0 for c in (0, 1)]
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    square = ratio ** 2
    values = [(ratio[r] / max(np.sqrt(square[r].sum()), 1e-12)).astype(np.float32) for r in rows]
    apart = np.arange(len(y)) % 5 == 4
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart[:] = False
    learn = np.flatnonzero(~apart)
    sign = np.where(y == 1, 1.0, -1.0)
    cost = COST * len(learn) / (2.0 * np.where(y == 1, (y[learn] == 1).sum(), (y[learn] == 0).sum()))
    w = dual_descent([rows[i] for i in learn], [values[i] for i in learn], sign[learn], cost[learn])
    model = Model(w[:-1] * ratio, square, float(w[-1]), 1.0, 0.0)
    judged = np.flatnonzero(apart) if apart.any() else learn
    slope, offset = fit_curve(np.array([model.margin(rows[i]) for i in judged]), y[judged] == 1)
    return Model(model.weight, square, model.bias, slope, offset)


# ---------------------------------------------------------------------------
# Spark
# ---------------------------------------------------------------------------
def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str,
                    max_labelled: int) -> DataFrame:
    """``_label, _text``: one text for each of at most ``max_labelled`` ids of the learning folds."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(key)).select(F.col(key).alias("_id"), F.col(label).alias("_label"))
    ids = bounded_sample(known, "_id", max_labelled)
    texts = docs.select(F.col(key).alias("_id"), text_or_empty(text).alias("_text"))
    # at most max_labelled rows of two numbers: safe to broadcast
    return texts.join(F.broadcast(ids), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                label: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    sample = labelled_sample(docs, labels, key, text, label, max_labelled).select("_id", "_label", "_text")
    rows = map_rows(sample, lambda c: ((k, int(y), indicators(t).tobytes()) for k, y, t in zip(*c)),
                    "id bigint, label int, row binary").toPandas()
    rows = rows.iloc[np.argsort(rows["id"].to_numpy(np.int64), kind="stable")]
    return fit([np.frombuffer(r, np.int32) for r in rows["row"]], rows["label"].to_numpy(np.int64))


def score_quality(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` and the ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input

    def rows(columns: list[list]) -> Iterator[tuple]:
        m = shared.value
        return ((*other, m.score(t)) for t, *other in zip(*columns))
    types = dict(docs.dtypes)
    return map_rows(docs.select(text_or_empty(text).alias("_text"), *keep), rows,
                    ", ".join(f"{k} {types[k]}" for k in keep) + ", score double")
