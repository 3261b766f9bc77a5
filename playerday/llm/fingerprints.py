"""Document fingerprints: threshold-scaled sketches, in DataFrame operations only."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playerday.llm.common import SPACE, let, table

LEAST = -(1 << 63)
WORDS = 5
#: One hash in SCALE is kept.
SCALE = 4


def threshold(scale: int) -> int:
    """Hashes below it are one in `scale` of all signed 64-bit values."""
    return LEAST + (1 << 64) // scale


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """struct<whole, hashes> of a whole text: every distinct shingle hash below the fixed threshold, sorted.

    whole is one hash of all its shingles, so that texts too short for a hash
    below the threshold can still be told to be equal. Words are lower-cased
    and parted by ASCII white space; a text with fewer words than a shingle is
    one shingle; null and wordless texts have no hashes. Equal texts have equal
    sketches, repeated rows too; a very long text has a long sketch, in
    proportion to its distinct shingles.
    """
    parts = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")

    def shingles(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]))
        return F.when(F.size(h) >= words, each).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    def kept(h: Column) -> Column:
        return F.struct(F.xxhash64(h).alias("whole"), F.filter(h, lambda x: x < threshold(scale)).alias("hashes"))

    return let(F.sort_array(F.array_distinct(let(F.transform(parts, lambda w: F.xxhash64(w)), shingles))), kept)


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together, from their sketches alone (whole is then unknown)."""
    return F.struct(F.lit(None).cast("bigint").alias("whole"), F.sort_array(F.array_union(a["hashes"], b["hashes"])).alias("hashes"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles that the other text holds (0 to 1).

    Both sketches hold every hash below one threshold, so the estimate is fair
    however unequal the texts are. It is 1 where all shingles are the same, and
    0 where either sketch has no hashes and they are not.
    """
    least = F.least(F.size(a["hashes"]), F.size(b["hashes"]))
    both = F.size(F.array_intersect(a["hashes"], b["hashes"]))
    same = F.coalesce(a["whole"] == b["whole"], F.lit(False))
    return F.when(same, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(both, least), F.lit(0.0)))


def written(sketched: Column) -> Column:
    """A sketch as text: 16 lower-case hex digits for `whole` and for each hash in order."""
    digits = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.lower(F.concat(digits(sketched["whole"]), F.array_join(F.transform(sketched["hashes"], digits), "")))


def with_next(rows: DataFrame, order: str, columns: list[str], rows_per_bucket: int = 1000, most_buckets: int = 100_000) -> DataFrame:
    """rows with next_<column> of the row that follows in ascending order; after the last the first.

    Rows are dealt to buckets of about equal size by approximate quantiles of
    the order column, so that no task sorts more than its bucket; the first
    rows of each bucket also visit the bucket before, as that one's successor.
    One shuffle of the rows; the bucket table (at most `most_buckets` rows) is
    all that is broadcast. A null sorts first; rows that repeat an id follow
    each other in the order of the named columns.
    """
    key = F.coalesce(F.col(order).cast("bigint"), F.lit(LEAST))
    rows = rows.withColumn("__key", key)
    ids = rows.select(F.col("__key").cast("double").alias("__at"), "__key")
    buckets = min(most_buckets, ids.count() // rows_per_bucket + 1)
    cuts = ids.approxQuantile("__at", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets)) if buckets > 1 else []
    splits = [-float("inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    deal = Bucketizer(splits=splits, inputCol="__at", outputCol="__bucket")
    firsts = deal.transform(ids).groupBy("__bucket").agg(F.min("__key").alias("__key"))
    by = Window.orderBy("__bucket")  # a row per bucket
    before = F.coalesce(F.lag("__bucket").over(by), F.max("__bucket").over(Window.partitionBy()))
    firsts = firsts.select("__key", before.alias("__before"))
    rows = deal.transform(rows.withColumn("__at", F.col("__key").cast("double"))).drop("__at")
    rows = rows.join(F.broadcast(firsts), "__key", "left")
    here = F.struct(F.col("__bucket").alias("bucket"), F.lit(0).alias("guest"))
    there = F.struct(F.col("__before").alias("bucket"), F.lit(1).alias("guest"))
    rows = rows.withColumn("__in", F.explode(F.when(F.col("__before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    row_order = Window.partitionBy("__in.bucket").orderBy("__in.guest", "__key", *columns)
    rows = rows.select("*", *[F.lead(c).over(row_order).alias(f"next_{c}") for c in columns]).where("__in.guest = 0")
    return rows.drop("__key", "__bucket", "__before", "__in")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("sketch", sketch(F.col("text")))
    rows = with_next(docs, "doc_id", ["text", "sketch"])
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - tail), F.left("next_text", tail))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sketch"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
