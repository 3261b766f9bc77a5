"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playerday.llm.common import SPACE, fold, materialise, table
from playerday.llm.labelled import training_rows

# Second-person words of the corpus's four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie tú ti usted ustedes vosotros su".split())
PREFIXES = (4, 5, 6)
NEAR = 8
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), b"0123456789", b"!?"
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_MASKED = re.compile(r"[^\W\d_][*@$0-9_#+!]+[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_EDGES = ".,;:!?\"'()[]{}<>|%&$#*-_+=~^`\\/"
NAMES = ("hit_rate", "weight_rate", "top", "second", "distinct", "hits", "near_you", "you_rate", "capitals", "loud_words", "punctuation", "marks", "digits", "masked", "stretched", "length")


def learn_lexicon(sample: DataFrame, least: int = 4) -> dict[str, float]:
    """Words and word beginnings ("be:" and 4 to 6 letters) that mark label 1, with their log odds ratio.

    Document counts come from Spark; all terms with the evidence come to the
    driver, of which the bounded sample of labelled rows sets the number.
    """
    word = F.regexp_replace(F.lower("word"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    words = sample.select("doc_id", "label", F.explode(F.array_distinct(F.split("text", SPACE))).alias("word")).select("doc_id", "label", word.alias("word")).where("word <> ''")
    starts = [F.when(F.length("word") >= n, F.concat(F.lit("be:"), F.substring("word", 1, n))) for n in PREFIXES]
    terms = words.select("doc_id", "label", F.explode(F.array_compact(F.array(F.col("word"), *starts))).alias("term")).distinct()
    total = sample.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("a"), F.coalesce(F.sum(1 - F.col("label")), F.lit(0)).alias("b")).first()
    counts = terms.groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).where(F.col("a") >= least)
    odds = F.log((F.col("a") + 0.5) / (total["a"] + 1.0)) - F.log((F.col("b") + 0.5) / (total["b"] + 1.0))
    counts = counts.withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5)))
    return {r["term"]: float(r["odds"]) for r in counts.where("odds > 1.5 and z > 2.5").orderBy("term").collect()}


class Dense:
    """Dense features of whole texts against one lexicon."""

    def __init__(self, lexicon: dict[str, float], most_words: int = 200_000):
        self.lexicon, self.most_words = lexicon, most_words
        self.seen: dict[str, tuple[float, bool]] = {}

    def _word(self, raw: str) -> tuple[float, bool]:
        word = raw.lower().strip(_EDGES)
        weights = [self.lexicon[t] for t in (word, *("be:" + word[:n] for n in PREFIXES if len(word) >= n)) if t in self.lexicon]
        if len(self.seen) >= self.most_words:
            self.seen.clear()
        found = self.seen[raw] = (max(weights, default=0.0), word in SECOND_PERSON)
        return found

    def of(self, text: str | None) -> list[float]:
        """In the order of NAMES; null and empty texts give zeros."""
        text = text or ""
        words = text.split()
        if not words:
            return [0.0] * len(NAMES)
        seen, word = self.seen, self._word
        known = [seen.get(w) or word(w) for w in words]
        hits = [(n, k[0]) for n, k in enumerate(known) if k[0]]
        you = [n for n, k in enumerate(known) if k[1]]
        near = 0.0
        if hits and you:
            marks, places = np.array(you), np.array([n for n, _ in hits])
            at = np.searchsorted(marks, places)
            after = np.where(at < len(marks), marks[np.minimum(at, len(marks) - 1)] - places, 1 << 30)
            before = np.where(at > 0, places - marks[np.maximum(at - 1, 0)], 1 << 30)
            near = float(np.exp(-np.minimum(after, before) / NEAR).sum()) / len(words)
        distinct = sorted({words[n].lower().strip(_EDGES): w for n, w in hits}.values(), reverse=True)
        data = text.encode("utf-8", "replace")
        size, n = len(data), len(words)
        rate = lambda drop: (size - len(data.translate(None, drop))) / size
        odd = [w for w in set(words) if not w.isalpha()]
        return [
            len(hits) / n, sum(w for _, w in hits) / n, *(distinct + [0.0, 0.0])[:2], float(len(distinct)), float(len(hits)), near, len(you) / n,
            rate(_UPPER), sum(w.isupper() and len(w) > 2 for w in words) / n, rate(_PUNCTUATION), rate(_MARKS), rate(_DIGITS),
            sum(1 for w in odd if _MASKED.search(w)) / n, sum(1 for w in set(words) if _STRETCHED.search(w)) / n, math.log1p(n),
        ]


def dense_features(text: Column, lexicon: dict[str, float]) -> Column:
    shared = SparkSession.active().sparkContext.broadcast(lexicon)  # at most `most` entries

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        dense = Dense(shared.value)
        return pd.Series([dense.of(x) for x in texts], dtype="object")

    return features(text)


class ToxicityModel:
    """A lexicon, boosted trees and the isotonic curve from their probability to the score."""

    def __init__(self, lexicon: dict[str, float], trees, curve, mean: float):
        self.lexicon, self.trees, self.curve, self.mean = lexicon, trees, curve, mean

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score) for every row of docs(doc_id, text); null and empty texts are scored too.

        A score depends on the text alone, so repeated rows score alike; other
        columns are left out, whatever their names. A very long text is read
        whole, in one task.
        """
        rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
        if self.trees is None:
            return rows.select("doc_id", F.lit(self.mean).alias("score"))
        rows = rows.select("doc_id", array_to_vector(dense_features(F.col("text"), self.lexicon)).alias("features"))
        rows = self.trees.transform(rows).select("doc_id", F.get(vector_to_array("probability"), F.lit(1)).alias("raw"))
        score = F.col("raw")
        if self.curve is not None:
            rows = self.curve.transform(rows)
            score = F.col("curve")
        return rows.select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 12_000) -> ToxicityModel:
    """Fit on at most `most` labelled rows: folds 2 to 4 give lexicon and trees, fold 1 the calibration.

    Without labels of both classes every score is their mean (0.5 without any).
    """
    sample = materialise(training_rows(docs, labels, label, most), "toxic-sample")
    inner, outer = sample.where("fold <> 1"), sample.where("fold = 1")
    seen = {(r["inner"], r["label"]): r["count"] for r in sample.groupBy((F.col("fold") != 1).alias("inner"), "label").count().collect()}
    if not seen.get((True, 0)) or not seen.get((True, 1)):
        ones, all_ = sum(n for (_, y), n in seen.items() if y), sum(seen.values())
        return ToxicityModel({}, None, None, ones / all_ if all_ else 0.5)
    lexicon = learn_lexicon(inner)
    rows = sample.select("fold", F.col("label").cast("double").alias("label"), array_to_vector(dense_features(F.col("text"), lexicon)).alias("features"))
    rows = materialise(rows.repartition(4), "toxic-features")
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, seed=7, cacheNodeIds=False).fit(rows.where("fold <> 1"))
    curve = None
    if seen.get((False, 0)) and seen.get((False, 1)):
        held = trees.transform(rows.where("fold = 1")).select("label", F.get(vector_to_array("probability"), F.lit(1)).alias("raw"))
        curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="curve").fit(held)
    return ToxicityModel(lexicon, trees, curve, 0.0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = fit(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
