"""A bounded sample of labelled documents, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playerday.llm.common import fold


#: Tasks that the sample is spread over.
PARTS = 32


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label, fold) of at most `most` labelled documents outside the held-out fold.

    The ids with the smallest hashes are taken, so the sample is the same on
    every run. Null labels and labels without a document are left out; where
    labels of one id differ, 1 wins, and where documents repeat an id, the
    least text. At most `most` label rows are broadcast; the texts meet in no
    one task.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("label"))
    known = known.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label", "fold").agg(F.min("text").alias("text"))
    return found.repartition(PARTS, "doc_id").select("doc_id", "text", "label", "fold")
