"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playerday.llm.common import materialise, table
from playerday.llm.components import connected_components
from playerday.llm.jaccard import in_part, near_copy_classes, shingles
from playerday.llm.pairing import pairs_between_classes

BITS = 64


def fingerprint_of(text: str | None, words_per_shingle: int, seed: int, distinct: bool = False) -> int:
    """SimHash of one whole text as a signed 64-bit integer; no words give 0. distinct counts equal shingles once."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    if distinct:
        hashes = np.unique(hashes)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def simhash(text: Column, words_per_shingle: int = 4, seed: int = 42, distinct: bool = False) -> Column:
    """64-bit SimHash column of whole texts.

    A-Z are lower-cased, words are parted by ASCII white space, shingles keep
    their repeats (unless distinct) and are hashed by XXH64. A text with fewer words than a
    shingle is one shingle; null and wordless texts give 0.
    """

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(x, words_per_shingle, seed, distinct) for x in texts], dtype="int64")

    return of(text)


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by one bit at most.

    With m segments the least different one has at most distance // m differing
    bits, so m = distance // 2 + 1 is the smallest that gives one or none.
    """
    m = distance // 2 + 1
    cuts = [round(BITS * i / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def file_by_key(fingerprints: DataFrame, distance: int, *carried: str) -> DataFrame:
    """The distinct carried columns (fp among them), once under each of the 64 keys of fp: a bit's segment with that bit deleted.

    Spark's estimate of the size leaves the 64 out, so joins by key carry a hint against a broadcast of one side.
    """
    parts = segments(distance)
    width = max(w for _, w in parts)
    fp = F.col("fp")
    keys = []
    for first, w in parts:
        value = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << w) - 1))
        keys += [(F.lit((first + i) << width) + value.bitwiseAND(F.lit(~(1 << i)))) for i in range(w)]
    spread = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes become 64 times as many: no merging of partitions here
    rows = fingerprints.select(*carried).where(fp.isNotNull()).repartition(spread, "fp").distinct()
    return rows.select(*carried, F.explode(F.array(*keys)).alias("key"))


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def link_pairs(fingerprints: DataFrame, distance: int = 4, check_bits: int | None = None, apart: str | None = None) -> DataFrame:
    """(a, b) for each two different fingerprints fp within the distance, a < b, once each.

    Every value is filed under one key per bit: the bit's segment with that bit
    deleted. Two values within the distance agree on such a key; the equality
    join finds them and verifies the true distance. Of the keys on which a pair
    agrees only the first counts (the first segment with one difference at
    most, at the differing bit, or at its first bit when it is equal), so the
    join gives each link once however many keys agree. Nothing is capped. With
    check_bits the rows also carry a second fingerprint, check, that may differ
    in that many bits; a row is then (fp, check), and rows of equal fp link too. With apart only links between different values of that
    column count, and (a, b) are those two values, in either order.
    """
    parts = segments(distance)
    width = max(w for _, w in parts)
    filed = file_by_key(fingerprints, distance, "fp", *([] if check_bits is None else ["check"]), *([] if apart is None else [apart]))
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    slot = F.shiftright(F.col("a.key"), width)
    counts_here, before = F.lit(False), F.lit(True)
    for first, w in parts:
        part = F.shiftrightunsigned(differ, first).bitwiseAND(F.lit((1 << w) - 1))
        counts_here |= before & (slot >= first) & (slot < first + w) & ((part != 0) | (slot == first))
        before &= F.bit_count(part) > 1
    near = (F.bit_count(differ) <= distance) & counts_here
    ordered = F.col("a.fp") < F.col("b.fp")
    if check_bits is not None:
        near &= differing(F.col("a.check"), F.col("b.check")) <= check_bits
        ordered |= (F.col("a.fp") == F.col("b.fp")) & (F.col("a.check") < F.col("b.check"))
    named = lambda side: F.col(f"{side}.{apart or 'fp'}") if apart or check_bits is None else F.struct(f"{side}.fp", f"{side}.check")
    chosen = [named("a").alias("a"), named("b").alias("b")]
    if apart is not None:
        return pairs_between_classes(filed, apart, near, ordered, chosen)
    return filed.alias("a").hint("merge").join(filed.alias("b"), (F.col("a.key") == F.col("b.key")) & ordered & near).select(*chosen)


def star_links(nodes: DataFrame, distance: int, check_bits: int | None = None) -> DataFrame:
    """(src, dst): links from each key's smallest node to the others there, at most 64 for each node of nodes(fp, check).

    A node is fp, or with check_bits the struct of fp and check.
    """
    if check_bits is None:
        filed = file_by_key(nodes, distance, "fp")
        least = filed.groupBy("key").agg(F.min("fp").alias("src"))
        found = filed.join(least.hint("merge"), "key").where((F.col("src") != F.col("fp")) & (differing(F.col("src"), F.col("fp")) <= distance))
        return found.select("src", F.col("fp").alias("dst")).distinct()
    filed = file_by_key(nodes, distance, "fp", "check").withColumn("dst", F.struct("fp", "check"))
    least = filed.groupBy("key").agg(F.min("dst").alias("src"))
    near = (differing(F.col("src.fp"), F.col("fp")) <= distance) & (differing(F.col("src.check"), F.col("check")) <= check_bits)
    return filed.join(least.hint("merge"), "key").where((F.col("src") != F.col("dst")) & near).select("src", "dst").distinct()


def classify(rows: DataFrame, distance: int = 4, check_bits: int | None = None) -> DataFrame:
    """rows(doc_id, fp, ...) with class_fp (names the class) and component_id (its smallest doc_id).

    rows is read twice, so it should be a written table. With check_bits rows
    are copies only if equal in fp and check, and class_fp and class_check
    together name the class. Equal fingerprints are one node from the start: copies never become pairs. A large group of near
    copies must not become all its pairs either, so classes grow in two steps:
    first over star links, whose number is bounded by the nodes; then over all
    links between nodes that the first step left in different classes, which
    makes the result the same as over all links.
    """
    keys, name = (["fp"], "fp") if check_bits is None else (["fp", "check"], "node")
    nodes = rows.groupBy(*keys).agg(F.min("doc_id").alias("least_id"))
    nodes = materialise(nodes if check_bits is None else nodes.withColumn("node", F.struct("fp", "check")), "simhash-nodes")
    stars = connected_components(star_links(nodes, distance, check_bits)).withColumnRenamed("node", name)
    begun = nodes.join(stars, name, "left").withColumn("star", F.coalesce("component", name)).drop("component")
    begun = materialise(begun, "simhash-stars")
    links = link_pairs(begun, distance, check_bits, apart="star").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = connected_components(links).withColumnRenamed("node", "star")
    classed = begun.join(groups, "star", "left").select(*keys, "least_id", F.coalesce("component", "star").alias("class_fp"))
    least = classed.groupBy("class_fp").agg(F.min("least_id").alias("component_id"))
    named = classed.join(least, "class_fp").select(*keys, "class_fp", "component_id")
    if check_bits is not None:
        named = named.select(*keys, F.col("class_fp.fp").alias("class_fp"), F.col("class_fp.check").alias("class_check"), "component_id")
    return rows.join(materialise(named, "simhash-classes"), keys)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, class_fp, component_id) for every row of docs.

    component_id is the smallest doc_id reachable over links of at most
    `distance` bits. Null and empty texts have fingerprint 0 and link like any
    other. Rows with a null id join their class but never name it (a class of
    null ids has a null component_id). Repeated rows stay; extra columns and an
    empty table are fine.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), simhash(F.col(text_col), words_per_shingle, seed).alias("fp"))
    return classify(materialise(rows, "simhash-rows"), distance)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4) -> DataFrame:
    """docs with one row of each class of near copies, its columns unchanged.

    Near copies share 0.8 or more of the distinct five-word shingles that
    either has. Every text has its SimHash, and the classes of classify, over
    fingerprints of at most `distance` different bits, are where near copies
    are looked for first. An exact check follows: links are verified on the
    shingles, so a class falls apart where its texts have too few in common,
    and the near copies whose fingerprints lie further apart (no number of bits
    tells 0.8 from less) are found by the shingles they share. Classes are
    closed over the verified links. Texts too few of whose shingles are in any
    other have no near copy; their fingerprints are not filed.

    The row with the smallest id stays (a null id only when the class has no
    other); of rows that repeat the id, the first as written. Null and wordless
    texts are copies of each other.
    """
    held = docs.withColumns({"__shingles": shingles(F.col(text_col)), "__row": F.monotonically_increasing_id()})
    held = held.withColumns({"__n": F.size("__shingles"), "__part": F.size(F.filter("__shingles", in_part)), "__set": F.xxhash64("__shingles")}).drop("__shingles")
    held = materialise(held.withColumn("__fp", simhash(F.col(text_col))), "near-docs")
    first = F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).cast("bigint").alias("doc_id"), F.col("__row").alias("row")))
    sets = held.groupBy(F.col("__set").alias("node")).agg(F.max("__n").alias("n"), F.max("__part").alias("part"), F.min("__fp").alias("fp"), first.alias("first"), F.count("*").alias("copies"))
    sets = materialise(sets, "near-nodes")

    def grouped(nodes: DataFrame) -> DataFrame:
        """(node, group): the SimHash classes of the sets."""
        rows = materialise(sets.join(nodes, "node", "left_semi").select(F.col("node").alias("doc_id"), "fp"), "simhash-rows")
        return classify(rows, distance).select(F.col("doc_id").alias("node"), F.col("class_fp").alias("group"))

    # a set with a thousandth of all rows or more is compared by its first row alone: at most 1,000 sets, which are broadcast
    total = sets.agg(F.sum("copies")).first()[0] or 0
    hot = sets.where((F.col("copies") > 1) & (F.col("copies") * 1000 >= total)).select(F.col("node").alias("__set"), F.col("first.row").alias("__only"))
    once = held.join(F.broadcast(hot), "__set", "left").where(F.col("__only").isNull() | (F.col("__only") == F.col("__row")))
    classes = near_copy_classes(once.select(F.col("__set").alias("node"), F.col(text_col).alias("text")), sets, grouped)
    named = sets.join(classes, "node", "left").groupBy(F.coalesce("class", "node").alias("class"))
    kept = named.agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row"))
    return held.join(kept, "__row", "left_semi").select(*docs.columns)


def hex_of(fp: Column) -> Column:
    """A signed 64-bit fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document.

    A very long text is hashed whole, in blocks, by the task that reads it; from
    there on a row is its fingerprint.
    """
    found = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
