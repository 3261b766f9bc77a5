"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playerday.llm.common import WORD, materialise, table

#: Sources by code point take these weights in turn.
WEIGHTS = (5.0, 2.0, 1.0)
#: Characters that prose seldom holds, and all but the letters of Latin scripts.
JUNK = r"[|%&$#*{}<>\\~^=_]"
OTHER = r"[^A-Za-z\x{00C0}-\x{024F}]"
#: Word length of plain prose, and the words at which a text counts half for its length.
USUAL, SHORT = 6.0, 20.0
#: Rows that a bin of sampling keys holds at most, about, and bins in an octave at least.
PER_BIN, BINS = 1_000_000, 64


def quality_weight(text: Column) -> Column:
    """Weight in [0.05, 1], a composite of four marks of prose, each in [0, 1] and multiplied.

    The share of letters among the characters that are no white space; few
    unusual symbols; words of a usual length on average; enough words to tell.
    """
    text = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    size, words = F.char_length(text).cast("double"), count(WORD)
    # what is rare is counted: white space and what is no letter
    solid = size - count(r"[\x20\x09-\x0D]")
    letters = (size - count(OTHER)) / F.greatest(solid, F.lit(1.0))
    symbols = 1.0 - F.least(F.lit(0.9), 4.0 * count(JUNK) / F.greatest(solid, F.lit(1.0)))
    apart = F.abs(solid / F.greatest(words, F.lit(1.0)) - USUAL)
    return F.greatest(F.lit(0.05), letters * symbols * (USUAL / (USUAL + apart)) * (words / (words + SHORT)))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that md5 draws from the key; the same on every run and engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, share: float, epochs: float, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) from one row per source.

    A source's target is the smaller of epochs * size and level * weight, with
    the one level at which the targets sum to share * all sizes. Sorted by the
    level at which each source fills up, that level follows from prefix sums;
    so it is one pass over the source table (a row per source), not a loop.
    Sources rank by code point, null last; sources without words get 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights))
    cap = F.col("source_size") * float(epochs)
    rows = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("weight"))
    full = Window.orderBy("fill", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    rows = rows.withColumn("rest", F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("left_weight", F.sum("weight").over(full.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # the first source, in order of filling, whose cap the level would not pass sets the level
    level = F.min(F.when(F.col("rest") / F.col("left_weight") < F.col("fill"), F.struct("fill", (F.col("rest") / F.col("left_weight")).alias("level")))).over(whole)["level"]
    return rows.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, weight: Column | None = None, share: float = 1.5, epochs: float = 2.0, weights=WEIGHTS, seed: int = 17, per_bin: int = PER_BIN, max_broadcast_sources: int = 10_000, carry: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken) for every row of docs(doc_id, text, source).

    carry adds the whole row as the struct __doc; it joins the decision by row
    number at the end, and no sort or window carries it.

    A source takes as many complete epochs as its target holds; the rest of
    the target takes documents in the order of the sampling key
    -ln(u) / weight (Efraimidis and Spirakis), up to the prefix whose words come
    nearest to it. u comes from id and text, so reruns agree and rows that
    share an id or lack one are spread.

    A source may hold any share of the rows: its keys are cut into bins of
    equal width in log2(key). Whatever the weights, a bin of 1/b octave holds
    at most ln(2) / (e * b) of a source, and b grows with the rows, so that a
    bin holds about per_bin of them at most; only bin totals meet in the
    per-source prefix sum.

    Null texts and texts without words have size 0 and take 0; a null source is
    a source of its own; very long texts count whole; repeated rows count each,
    ties by id then size; columns of docs beside doc_id, text and source are
    left out (with carry: kept), whatever their names; an empty table gives no
    rows.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint") if size is None else size
    weight = quality_weight(F.col("text")) if weight is None else weight
    drawn = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    kept = [F.struct(*docs.columns).alias("__doc")] if carry else []
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), size.alias("size"), weight.alias("w"), drawn.alias("drawn"), *kept)
    key = -F.log(uniform(F.col("drawn"), seed)) / F.col("w")
    all_rows = materialise(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "size", key.alias("key"), *(["__doc"] if carry else [])), "mix-rows")
    rows = all_rows.drop("__doc")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialise(targets(sums, share, epochs, weights).withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)), "mix-targets")
    plan = plan.withColumn("want", F.col("target") - F.col("full") * F.col("source_size"))

    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # a null source joins like any other
    plan = plan.withColumn("name", name).drop("source")
    in_octave = max(BINS, math.ceil(rows.count() * math.log(2) / (math.e * per_bin)))
    rows = rows.withColumn("name", name).withColumn("bin", F.floor(F.log2("key") * in_octave))
    bins = rows.groupBy("name", "bin").agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("name").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("name", "bin", F.coalesce(F.sum("bin_size").over(before), F.lit(0)).alias("bins_before"))
    order = Window.partitionBy("name", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(order)).join(bins, ["name", "bin"])
    if plan.count() <= max_broadcast_sources:
        rows = rows.join(F.broadcast(plan), "name")
    else:  # too many sources to broadcast: spread the rows of each over salted copies of its plan row
        salts = 64
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
        rows = rows.join(plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))), ["name", "salt"])
    upto = F.col("bins_before") + F.col("upto")
    chosen = (F.col("size") > 0) & (upto - F.col("size") / 2 <= F.col("want"))
    repeats = F.col("full") + chosen.cast("int")
    decided = rows.select("row", "doc_id", "source", "size", "source_size", "target", repeats.cast("int").alias("repeats"), (repeats * F.col("size")).cast("bigint").alias("taken"))
    return decided.join(all_rows.select("row", "__doc"), "row").drop("row") if carry else decided.drop("row")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it, columns unchanged."""
    taken = mix(docs, carry=True, **how).where("repeats > 0")
    return taken.select(F.explode(F.array_repeat(F.lit(0), F.col("repeats"))), "__doc").select("__doc.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, md5(t) AS d, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size, len(regexp_extract_all(t, '[^\x20\x09-\x0D]'))::DOUBLE AS solid,
         len(regexp_extract_all(t, '[A-Za-z\x{00C0}-\x{024F}]'))::DOUBLE AS letters, len(regexp_extract_all(t, '[|%&$#*{}<>\\~^=_]'))::DOUBLE AS junk
  FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)),
weighed AS (
  SELECT *, greatest(0.05::DOUBLE, letters / greatest(solid, 1.0::DOUBLE) * (1.0::DOUBLE - least(0.9::DOUBLE, 4.0::DOUBLE * junk / greatest(solid, 1.0::DOUBLE)))
         * (6.0::DOUBLE / (6.0::DOUBLE + abs(solid / greatest(size::DOUBLE, 1.0::DOUBLE) - 6.0::DOUBLE))) * (size::DOUBLE / (size::DOUBLE + 20.0::DOUBLE))) AS w FROM docs),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || d), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE) / w AS k FROM weighed),
sources AS (
  SELECT source, sum(size)::DOUBLE AS s, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS wt FROM docs GROUP BY source),
levels AS (
  SELECT a.source, (1.5::DOUBLE * (SELECT sum(s) FROM sources) - coalesce((SELECT sum(2 * b.s) FROM sources b WHERE 2 * b.s / b.wt < 2 * a.s / a.wt), 0))
         / (SELECT sum(b.wt) FROM sources b WHERE 2 * b.s / b.wt >= 2 * a.s / a.wt) AS level, 2 * a.s / a.wt AS fill FROM sources a),
level AS (SELECT arg_min(level, fill) AS level FROM levels WHERE level < fill),
plan AS (
  SELECT source, s, least(2 * s, coalesce((SELECT level FROM level) * wt, 2 * s)) AS target FROM sources),
ordered AS (
  SELECT keyed.*, s, target, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY keyed.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed JOIN plan ON keyed.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, s::BIGINT AS source_size, target,
       ((epochs + CASE WHEN size > 0 AND upto - size / 2.0 <= target - epochs * s THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM ordered
"""
