"""Removal of passages that repeat: suffixes of a collection sorted column by column, over Spark.

A substring of LENGTH bytes is dealt by the least hash among its ANCHOR-byte substrings, its anchor.
Equal substrings have equal anchors at equal places, so stretches of text around one anchor, aligned
at it, form a collection of their own: its transform and common prefixes tell which substrings
occur twice. Anchors that occur once in all texts can't be in a repeated substring and are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playerday.llm.collection_bwt import repeated
from playerday.llm.common import discard, materialise, scratch, table

#: Bytes of a substring that counts as repeated, and of an anchor in it.
LENGTH, ANCHOR = 200, 32
#: Window starts that are hashed at once; bytes of stretches that a task sorts at once, beyond which it begins a new collection.
BLOCK, CHUNK = 1 << 18, 4 << 20
#: Different stretches of one anchor beyond which they are dealt anew, by columns.
HOT = 512
#: Columns that stretches of a hot anchor are cut into, level by level. At one column a stretch is the substring itself.
LEVELS = (24, 4, 1)

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_SYMBOLS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out, step = np.ones(n, np.uint64), base
    done = 1
    while done < n:
        some = min(done, n - done)
        out[done : done + some] = out[:some] * np.uint64(step)
        done, step = 2 * done, step * step % (1 << 64)
    return out


_UP, _DOWN = _powers(_MULTIPLIER, BLOCK + 2 * LENGTH), _powers(_INVERSE, BLOCK + 2 * LENGTH)


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of each substring of that length, as unsigned 64-bit integers (at most BLOCK + LENGTH of them)."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOLS[data] * _DOWN[: len(data)], out=sums[1:])
    h = (sums[length:] - sums[: len(sums) - length]) * _UP[: len(sums) - length]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchored(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, anchor, hash): ranges of window starts that share an anchor, its place and its hash; bytes of one text.

    The anchor is the leftmost of the substrings with the least hash, so it depends on the window's bytes alone.
    """
    wide = LENGTH - ANCHOR + 1
    parts = []
    for base in range(0, len(data) - LENGTH + 1, BLOCK):
        block = data[base : base + BLOCK + LENGTH - 1]
        h = rolling(block, ANCHOR)
        least = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
        step = 1
        while 2 * step <= wide:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        rest = wide - step
        least = np.minimum(least[: len(least) - rest], least[rest:])
        place = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        opens = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        parts.append((opens + base, np.append(opens[1:], len(place)) + base, place[opens] + base, h[place[opens]].view(np.int64)))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts))


def stretches(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchored() of one whole text."""
    return anchored(np.frombuffer(text, np.uint8))


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> (hash, n): the anchors of a batch of texts, counted."""
    for batch in batches:
        texts = [x.as_py() for x in batch.column(0)]
        found = [stretches(x)[3] for x in texts if len(x) >= LENGTH]
        hashes, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n.astype(np.int64))], names=["hash", "n"])


def _anchors_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (hash, key): the different anchors of each text."""
    for batch in batches:
        for key, text in zip(*(c.to_pylist() for c in batch.columns)):
            hashes = np.unique(stretches(text)[3])
            if len(hashes):
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array([key] * len(hashes), pa.binary())], names=["hash", "key"])


def digest(hash_: int, first: int, stretch: bytes) -> bytes:
    return hashlib.blake2b(stretch, digest_size=16, key=b"%d:%d" % (hash_, first)).digest()


def _live(text: bytes, live: np.ndarray):
    """(hash, from, anchor, bytes) of the stretches of a text whose anchor is in the sorted live."""
    begin, end, anchor, hashes = stretches(text)
    at = np.searchsorted(live, hashes)
    at[at == len(live)] = 0
    for i in np.flatnonzero(live[at] == hashes).tolist():
        a, b = int(begin[i]), int(end[i])
        yield int(hashes[i]), a, int(anchor[i]), text[a : b + LENGTH - 1]


STRETCH = "id binary, hash bigint, first int, bytes binary, places bigint"


def _stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, live) -> stretches, once a batch, with the number of places."""
    for batch in batches:
        places: dict[tuple[int, int, bytes], int] = {}
        for _, text, live in zip(*(c.to_pylist() for c in batch.columns)):
            for hash_, a, anchor, stretch in _live(text, np.sort(np.array(live, np.int64))):
                one = (hash_, a - anchor, stretch)
                places[one] = places.get(one, 0) + 1
        yield _stretch_batch([(digest(*k), *k, n) for k, n in places.items()])


def _stretch_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["id", "hash", "first", "bytes", "places"])


def _places_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, live) -> (id, key, anchors): where each stretch of a text stands."""
    for batch in batches:
        ids, keys, where = [], [], []
        for key, text, live in zip(*(c.to_pylist() for c in batch.columns)):
            found: dict[bytes, list[int]] = {}
            for hash_, a, anchor, stretch in _live(text, np.sort(np.array(live, np.int64))):
                found.setdefault(digest(hash_, a - anchor, stretch), []).append(anchor)
            ids += found.keys()
            keys += [key] * len(found)
            where += found.values()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(keys, pa.binary()), pa.array(where, pa.list_(pa.int32()))], names=["id", "key", "anchors"])


def _sort_collections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches ordered by hash -> (id, hits): ranges of columns of the repeated substrings.

    A collection ends between two hashes once it holds CHUNK bytes, so a hash
    is never split and a task holds CHUNK bytes and the stretches of one more hash.
    """
    held: list[tuple] = []
    size = 0

    def decided() -> pa.RecordBatch:
        ranges = repeated([x[2] for x in held], np.array([x[1] for x in held], np.int64), np.array([x[3] for x in held], np.int64), LENGTH)
        hits = [(x[0], [{"a": a, "b": b} for a, b in r]) for x, r in zip(held, ranges) if r]
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.binary()), pa.array([h[1] for h in hits], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["id", "hits"])

    last = None
    for batch in batches:
        for id_, hash_, first, stretch, places in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= CHUNK and hash_ != last:
                yield decided()
                held, size = [], 0
            held.append((id_, first, stretch, places))
            size, last = size + len(stretch), hash_
    if held:
        yield decided()


def _cut(width: int):
    """Stretches of a hot hash -> cells of so many columns, with the id of the stretch; hash: of the bytes that all substrings of the cell have."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parents, rows = [], []
            for id_, hash_, first, stretch, places in zip(*(c.to_pylist() for c in batch.columns)):
                end = first + len(stretch) - LENGTH + 1
                for cell in range(first // width, (end - 1) // width + 1):
                    a, b = max(first, cell * width), min(end, (cell + 1) * width)
                    core = stretch[(cell + 1) * width - 1 - first : cell * width + LENGTH - first]
                    new = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=b"%d:%d" % (hash_, cell)).digest(), "little", signed=True)
                    part = stretch[a - first : b - first + LENGTH - 1]
                    parents.append(id_)
                    rows.append((digest(new, a, part), new, a, part, places))
            out = _stretch_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array(parents, pa.binary()), *out.columns], names=["parent", *out.schema.names])

    return cells


def distinct_stretches(rows: DataFrame) -> DataFrame:
    """Each stretch once, with the number of its places."""
    same = [F.any_value(c).alias(c) for c in ("hash", "first", "bytes")]
    return rows.groupBy("id").agg(*same, F.sum("places").alias("places")).select("id", "hash", "first", "bytes", "places")


def repeated_columns(found: DataFrame, hot: int = HOT, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(id, hits): for each stretch of found(id, hash, first, bytes, places) the columns, from the anchor on, where repeated substrings begin.

    found should be a written table. A hash with more than hot different
    stretches, such as those around the ends of a passage that very many
    documents share, is cut into cells of a few columns, dealt by the bytes
    that all substrings of a cell have; cells of one place are out. At one
    column a stretch is one substring, and no group is left.
    """
    groups = found.groupBy("hash").agg(F.count("*").alias("n"))
    large = materialise(groups.where(F.col("n") > hot).select("hash"), "suffix-hot") if levels else None
    split = bool(levels) and large.limit(1).count() > 0
    plain = found.join(large, "hash", "left_anti") if split else found
    plain = plain.select("id", "hash", "first", "bytes", "places").repartition("hash").sortWithinPartitions("hash")
    hits = plain.mapInArrow(_sort_collections, "id binary, hits array<struct<a:int,b:int>>")
    if not split:
        return hits
    cells = found.join(large, "hash", "left_semi").select("id", "hash", "first", "bytes", "places").mapInArrow(_cut(levels[0]), "parent binary, " + STRETCH)
    cells = materialise(cells, "suffix-cells")
    shared = cells.groupBy("hash").agg(F.sum("places").alias("all")).where("all > 1").select("hash")
    some = materialise(distinct_stretches(cells.join(shared, "hash", "left_semi")), "suffix-part")
    below = repeated_columns(some, hot, levels[1:])
    back = below.join(cells.select("id", "parent"), "id").select(F.col("parent").alias("id"), F.explode("hits").alias("hit"))
    back = back.groupBy("id").agg(F.collect_set("hit").alias("hits"))  # at most as many as a stretch has columns
    return hits.union(materialise(back, "suffix-back"))


REMOVED = "key binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def removal(text: bytes, starts: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, rest) where the substrings that begin in the ranges go."""
    edge = np.zeros(len(text) + 1, np.int64)
    for a, b in starts:
        edge[a] += 1
        edge[b + LENGTH - 1] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, copies, ranges in zip(*(c.to_pylist() for c in batch.columns)):
            if copies > 1 and len(text) >= LENGTH:
                gone, runs, rest = len(text), 1, b""
            else:
                gone, runs, rest = removal(text, [(r["a"], r["b"]) for r in ranges or ()])
            rows.append((key, len(text), gone, runs, hashlib.sha256(rest).hexdigest()))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def text_key(text) -> F.col:
    """16 bytes that stand for a text's UTF-8 bytes."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs(doc_id, text).

    Every byte in a substring of LENGTH bytes that starts anywhere else, in any
    row or in the same one, is removed; substrings are judged on the input.

    Equal texts are one row of a table laid out by text, with the number of
    copies; the table meets what is known of a text without being shuffled
    again. Anchors are counted over all texts, those of two places or more give
    stretches, different stretches are sorted by repeated_columns, and the
    ranges go back to the texts. Nothing is capped; see there for hot anchors.

    Null texts are empty; texts shorter than LENGTH lose nothing; repeated
    rows and ids count each (a text that stands twice loses all its bytes);
    very long texts are hashed in blocks and are one row; columns beside doc_id
    and text are left out, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").alias("doc_id"), text.alias("text")).withColumn("key", text_key(F.col("text")))
    name = f"suffix_texts_{scratch(spark, 'x')[-32:]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.groupBy("key").agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
    path = scratch(spark, "suffix-texts")
    texts.write.bucketBy(buckets, "key").option("path", path).option("compression", "zstd").saveAsTable(name)
    used: list[DataFrame] = []
    try:
        texts = spark.table(name)
        texts.work_path = path
        long = texts.where(F.octet_length("text") >= LENGTH)
        counts = long.select("text").mapInArrow(_anchor_counts, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
        shared = materialise(counts.where("n > 1").select("hash"), "suffix-shared")
        anchors = long.select("key", "text").mapInArrow(_anchors_of_texts, "hash bigint, key binary")
        live = materialise(anchors.join(shared, "hash", "left_semi").groupBy("key").agg(F.collect_list("hash").alias("live")), "suffix-live")
        with_live = long.join(live, "key").select("key", "text", "live")
        found = materialise(distinct_stretches(with_live.mapInArrow(_stretch_rows, STRETCH)), "suffix-stretches")
        hits = materialise(repeated_columns(found), "suffix-hits")
        places = with_live.mapInArrow(_places_rows, "id binary, key binary, anchors array<int>")
        ranges = places.join(hits, "id").select("key", F.explode("anchors").alias("at"), "hits").select("key", F.explode(F.transform("hits", lambda h: F.struct((h["a"] + F.col("at")).alias("a"), (h["b"] + F.col("at")).alias("b")))).alias("range"))
        ranges = ranges.groupBy("key").agg(F.collect_list("range").alias("ranges"))  # at most as many as a text has bytes
        done = materialise(texts.join(ranges, "key", "left").select("key", "text", "copies", "ranges").mapInArrow(_remove, REMOVED), "suffix-done")
        used = [texts, shared, live, found, hits]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for df in used:
        discard(df)
    return rows.select("doc_id", "key").join(done, "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing all repeated passages of 200 bytes leaves of every document."""
    return remove_repeats(table(spark, sf_dir, "documents"))
