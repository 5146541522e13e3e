"""Document quality by pairwise ranking.

A preference pair says that one document is better than another. The
Bradley-Terry model gives each document a score that is linear in its features,
and the probability of a preference is the logistic function of the difference
of two scores. So the weights come from logistic loss on differences of
features. A quantile of the scores of the labelled sample is the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch

#: The model is fitted on at most so many labelled rows, those with the smallest hashes, and so many pairs of them.
TRAIN_ROWS, TRAIN_PAIRS = 20_000, 60_000
#: Scores are put on a scale on which the threshold is here.
CUT = 0.3
RIDGE = 1e-2

#: Byte classes: 0 other symbols, 1 lower case, 2 upper case, 3 digits, 4 white space, 5 sentence marks, 6 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _name, _bytes in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t\n\r\x0b\x0c"), (5, b".,;:?!'\"()-")):
    _CLASS[list(_bytes)] = _name
_CLASS[128:] = 6

FEATURES = ("log_words", "repeat", "log_repeat", "distinct", "word_length", "upper", "all_upper", "digit", "symbol", "log_symbol", "marks", "bare", "log_bare", "double_mark", "line_repeat", "ends_marked")


def features(text: str | None) -> list[float]:
    """The features of a whole text, in the order of ``FEATURES``; a null text has those of an empty one."""
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    raw = np.frombuffer(text.encode(), np.uint8)
    c = np.bincount(_CLASS[raw], minlength=7) if len(raw) else np.zeros(7, np.int64)
    size = max(1, len(raw) - int(c[4]))
    letters = max(1, int(c[1] + c[2] + c[6]))
    same = sum(map(eq, words, words[1:])) / n
    bare = sum(1 for w in words if len(w) <= 3 and not any(map(str.isalnum, w))) / n
    lines = [x for x in text.split("\n") if x]
    upper = int(c[2]) / letters
    symbol = int(c[0]) / size
    return [
        np.log1p(len(words)), same, np.log(same + 0.01), len(set(words)) / n, min(20.0, size / n), upper, float(upper > 0.5), int(c[3]) / size,
        symbol, np.log(symbol + 0.01), int(c[5]) / size, bare, np.log(bare + 0.01), text.count("!!") / n, 1 - len(set(lines)) / max(1, len(lines)), float(bool(words) and words[-1][-1:] in ".?!"),
    ]


@dataclass
class Ranking:
    """Weights for centred and scaled features, and the score that is the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; ``CUT`` at the threshold."""
        z = np.clip((self.raw(x) - self.threshold) / self.spread, -500, 500)
        return 1 / (1 + np.exp(-z) * (1 - CUT) / CUT)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Ranking:
    """Fits weights on pairs of a row of label 1 and one of label 0; a sample of one label ranks all alike, above the threshold."""
    mean, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(mean, scale, np.zeros(len(mean)), -1.0, 1.0)
    rng = np.random.default_rng(seed)
    z = np.clip((x - mean) / scale, -8, 8)
    # each row takes part as evenly as can be
    pairs = min(TRAIN_PAIRS, max(len(good), len(bad)) * 10)
    a = np.concatenate([rng.permutation(good) for _ in range(-(-pairs // len(good)))])[:pairs]
    b = np.concatenate([rng.permutation(bad) for _ in range(-(-pairs // len(bad)))])[:pairs]
    d = z[a] - z[b]
    w = np.zeros(d.shape[1])
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        slope = d.T @ (1 - p) / pairs - RIDGE * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    raw = np.sort(z @ w)
    # the quantile below which the share of label 0 lies, between the two scores next to it
    threshold = (raw[len(bad) - 1] + raw[len(bad)]) / 2
    return Ranking(mean, scale, w, float(threshold), max(1e-6, float(raw.std()) / 2))


def _featured(rows: DataFrame, carried: str) -> DataFrame:
    """``(carried, x)`` of ``rows(carried, text)``."""
    schema = f"{carried}, x array<double>"
    out = arrow_schema(T._parse_datatype_string(schema))

    def scan(batches):
        for b in batches:
            if len(b):
                yield batch(out, b.column(0), [features(t.as_py()) for t in b.column(1)])

    return rows.mapInArrow(scan, schema)


def train(docs: DataFrame, labels: DataFrame, seed: int = 5, train_rows: int = TRAIN_ROWS) -> Ranking:
    """Fits the model on ``docs(doc_id, text)`` with ``labels(doc_id, quality)``.

    At most ``train_rows`` labels are used, those with the smallest hashes (and at
    most twice as many rows, where ids repeat), so
    that side of the join and what the driver gets are bounded. Labels other
    than 0 and 1, and null ids, take no part; a repeated label counts each time.
    """
    sample = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    sample = sample.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "y").limit(train_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("y", "text")
    got = _featured(rows, "y int").orderBy(F.xxhash64("y", "x"), "y", "x").limit(2 * train_rows).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, got.column("y").to_numpy(), seed)


def predict(docs: DataFrame, model: Ranking) -> DataFrame:
    """``(doc_id, score, predicted)``, a row for each row of ``docs(doc_id, text, ...)``.

    ``predicted`` is 1 where the score is ``CUT`` or more. A null text is scored
    as an empty one; repeated rows stay; other columns are not used.
    """
    schema = "doc_id long, score double, predicted int"
    out = arrow_schema(T._parse_datatype_string(schema))

    def scan(batches):
        for b in batches:
            if len(b):
                s = model.score(np.array([features(t.as_py()) for t in b.column(1)]))
                yield batch(out, b.column(0), s, (s >= CUT).astype(np.int32))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)


def keep_good(docs: DataFrame, model: Ranking) -> DataFrame:
    """The rows of ``docs`` whose score is ``CUT`` or more, as they are."""
    at = docs.columns.index("text")

    def scan(batches):
        for b in batches:
            if len(b):
                s = model.score(np.array([features(t.as_py()) for t in b.column(at)]))
                yield b.filter(pa.array(s >= CUT))

    return docs.mapInArrow(scan, docs.schema)
