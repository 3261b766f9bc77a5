"""Quality classifier: Naive Bayes support vectors."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playerday.llm.common import fold, table
from playerday.llm.labelled import training_rows

WIDTH = 1 << 20
#: Documents scoring below are rejected.
THRESHOLD = 0.3


def grams(text: str | None) -> np.ndarray:
    """Sorted distinct hashed n-grams of a whole text: words, word pairs and runs of three bytes."""
    data = (text or "").encode("utf-8", "replace").lower()
    words = np.fromiter(map(zlib.crc32, data.split()), np.uint64)
    parts = [words % np.uint64(WIDTH)]
    if len(words) > 1:
        parts.append((words[:-1] * np.uint64(0x9E3779B1) + words[1:]) % np.uint64(WIDTH))
    if len(data) > 2:
        b = np.frombuffer(data, np.uint8).astype(np.uint64)
        runs = b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]
        parts.append(np.unique(runs) * np.uint64(0x85EBCA6B) % np.uint64(WIDTH))
    return np.unique(np.concatenate(parts)).astype(np.int32)


@dataclass
class QualityModel:
    """weights are the support vector's, times the log-count ratios; score = 1 / (1 + exp(-(slope * margin + shift)))."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        size = float(np.sqrt((self.ratios[found] ** 2).sum())) or 1.0
        return float(self.weights[found].sum()) / size + self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(grams(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def log_count_ratios(good: np.ndarray, bad: np.ndarray, totals: tuple[float, float], smooth: float = 1.0) -> np.ndarray:
    """Log of each n-gram's smoothed share of all n-grams of the good documents over that of the bad ones."""
    shares = [(counts + smooth) / (total + WIDTH * smooth) for counts, total in zip((good, bad), totals)]
    return np.log(shares[0] / shares[1]).astype(np.float32)


def dual_coordinate_descent(rows: Sequence[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: float = 1.0, passes: int = 12, tolerance: float = 1e-3, seed: int = 5) -> tuple[np.ndarray, float]:
    """Linear hinge loss over ratio-scaled indicators of length one, solved in the dual one row at a time (Hsieh et al. 2008)."""
    w, bias = np.zeros(len(ratios), np.float32), 0.0
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            found = rows[i]
            value = ratios[found]
            value = value / (np.sqrt((value * value).sum()) or 1.0)
            slope = y[i] * (float(w[found] @ value) + bias) - 1.0
            square = float((value * value).sum()) + 1.0  # the bias is a feature of 1
            step = min(max(alpha[i] - slope / square, 0.0), cost) - alpha[i]
            if step:
                alpha[i] += step
                w[found] += np.float32(step * y[i]) * value
                bias += step * y[i]
                worst = max(worst, abs(step))
        if worst < tolerance:
            break
    return w, bias


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margin to probability, by damped Newton steps on smoothed targets."""
    up, down = int((y > 0).sum()), int((y <= 0).sum())
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    at = np.array([1.0, 0.0])
    x = np.column_stack([margins, np.ones(len(margins))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (p - goal) + 1e-3 * (at - [1.0, 0.0]))
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(max(at[0], 1e-3)), float(at[1])


def pack(found: np.ndarray) -> bytes:
    """Sorted n-grams of a text as the shorter of their gaps and a set of WIDTH bits, compressed: 128 KB at most."""
    gaps = zlib.compress(np.diff(found, prepend=0).astype("<u4").tobytes(), 1)
    if len(gaps) < WIDTH // 64:
        return b"g" + gaps
    bits = np.zeros(WIDTH, np.uint8)
    bits[found] = 1
    return min(b"g" + gaps, b"b" + np.packbits(bits).tobytes(), key=len)


def unpack(packed: bytes) -> np.ndarray:
    if packed[:1] == b"g":
        return np.cumsum(np.frombuffer(zlib.decompress(packed[1:]), "<u4"), dtype=np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1))).astype(np.int32)


class Packed(Sequence):
    """Rows of n-grams that stay packed until they are looked at."""

    def __init__(self, rows: list[bytes]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i):
        return unpack(self.rows[i])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 6000) -> QualityModel:
    """Fit on at most `most` labelled rows, with all their hashed n-grams; fold 1 sets the score's curve.

    What reaches the driver is bounded whatever the texts' length: each row's
    n-grams packed, 128 KB at most. Without labels of both classes every score
    is their mean (0.5 without any).
    """

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([pack(grams(x)) for x in texts], dtype="object")

    sample = training_rows(docs, labels, label, most).select(packed("text").alias("grams"), "label", "fold").toArrow().to_pylist()
    sample.sort(key=lambda r: (r["grams"], r["label"]))  # the same order on every run
    learn = [r for r in sample if r["fold"] != 1]
    y = np.array([1.0 if r["label"] > 0 else -1.0 for r in learn])
    if len(set(y)) < 2:
        good, all_ = sum(r["label"] > 0 for r in sample), len(sample)
        mean = float(np.clip(good / all_, 0.001, 0.999)) if all_ else 0.5
        zero = np.zeros(WIDTH, np.float32)
        return QualityModel(zero, zero, 0.0, 1.0, float(np.log(mean / (1 - mean))))
    rows = Packed([r["grams"] for r in learn])
    good, bad = np.zeros(WIDTH), np.zeros(WIDTH)
    for found, sign in zip(rows, y):
        (good if sign > 0 else bad)[found] += 1
    ratios = log_count_ratios(good, bad, (good.sum(), bad.sum()))
    w, bias = dual_coordinate_descent(rows, y, ratios)
    model = QualityModel(w * ratios, ratios, bias, 1.0, 0.0)
    held = [r for r in sample if r["fold"] == 1]
    curve = held if len({r["label"] > 0 for r in held}) == 2 else learn
    model.slope, model.shift = platt(np.array([model.margin(unpack(r["grams"])) for r in curve]), np.array([1.0 if r["label"] > 0 else -1.0 for r in curve]))
    return model


def quality_score(text: Column, model: QualityModel) -> Column:
    """Score column in [0, 1] of whole texts; null and empty texts have the score of no n-grams.

    A score depends on the text alone: repeated rows score alike, and a very
    long text costs in proportion to its length, in one task.
    """
    shared = SparkSession.active().sparkContext.broadcast(model)  # 8 bytes for each of WIDTH hashes

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(x) for x in texts], dtype="float64")

    return score(text)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = 6000) -> DataFrame:
    """docs without the rows that score below the threshold (a score at it stays); columns unchanged, repeated rows alike."""
    return docs.where(quality_score(F.col("text"), fit(docs, labels, most=most)) >= threshold)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
