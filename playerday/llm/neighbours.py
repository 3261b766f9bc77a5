"""Nearest neighbours: inverted file, product-quantised residuals, exact reranking, and a check that none is missed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playerday.llm.common import materialise, table


def usable(vector: Column) -> Column:
    """True for vectors with finite, non-null components that are not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centres of x by Lloyd's rounds from k distinct rows; an empty centre moves to the worst served row."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near, far = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        empty = np.nonzero(counts == 0)[0]
        centres = sums / np.maximum(counts, 1)[:, None]
        centres[empty] = x[np.argsort(-far)[: len(empty)]]
    return centres


#: Distances to centres that are held at once: rows are looked at in blocks, the smaller the more centres there are.
AT_ONCE = 1 << 22


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest centre, and the squared distance."""
    at, far = np.empty(len(x), np.int64), np.empty(len(x), x.dtype)
    squares, block = (centres**2).sum(1), max(1, AT_ONCE // max(1, len(centres)))
    for s in range(0, len(x), block):
        d = squares[None] - 2 * x[s : s + block] @ centres.T
        at[s : s + block] = d.argmin(1)
        far[s : s + block] = d.min(1) + (x[s : s + block] ** 2).sum(1)
    return at, far


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; differences are divided by a power of two first, so none overflows or is lost."""
    apart = np.abs(x - q)
    unit = np.exp2(np.ceil(np.log2(np.maximum(apart.max(axis=1), np.finfo(float).tiny))))
    return np.sqrt(((apart / unit[:, None]) ** 2).sum(axis=1)) * unit


@dataclass
class Index:
    """Coarse centres, a codebook for each slice of the residual, and how many lists a query scans first.

    Vectors are divided by `scale`, a power of two, and the sample's `middle`
    is taken off: no square overflows, and a common offset costs no digits.
    Lists and codes are chosen in single precision, which may choose badly;
    what is said of them (distances, errors, radii) is in double precision, so
    a bad choice costs time and no neighbour.
    """

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]
    scale: float
    probes: int = 1
    middle: np.ndarray | float = 0.0

    def scaled(self, vectors) -> np.ndarray:
        return np.stack(list(vectors)).astype(np.float64) / self.scale - self.middle

    @property
    def slack(self) -> float:
        """Bound of what rounding does to a squared distance, as a part of the squared sum of the lengths that it is made of."""
        return 1e-14 * (self.centres.shape[1] + 64)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """List, residual codes, the part of the rough distance that is the row's own, distance to the centre and error of the code.

        With r the coded residual of a row in list c, |q - c - r|^2 is
        |q - c|^2 - 2 q.r + (2 c.r + |r|^2): the last term is stored. The error
        is |x - c - r|, by which the rough distance may be off.
        """
        lists, _ = nearest(x.astype(np.float32), self.centres)
        centres = self.centres[lists].astype(np.float64)
        rest = x - centres
        codes = np.column_stack([nearest(rest[:, a:b].astype(np.float32), book)[0] for book, a, b in zip(self.books, self.cuts, self.cuts[1:])]).astype(np.uint8)
        coded = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1).astype(np.float64)
        size = lambda v: np.sqrt((v**2).sum(1))
        return lists, codes, 2 * (centres * coded).sum(1) + (coded**2).sum(1), size(rest), size(rest - coded)

    def nearest_lists(self, q: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists that each query scans first, nearest first: `probes`, and more while those hold fewer than `least` rows."""
        squares, block, out = (self.centres**2).sum(1)[None], max(1, AT_ONCE // len(self.centres)), []
        for s in range(0, len(q), block):
            order = np.argsort(squares - 2 * q[s : s + block].astype(np.float32) @ self.centres.T, axis=1, kind="stable")
            enough = (sizes[order].cumsum(axis=1) < least).sum(axis=1) + 1
            out += [line[: max(self.probes, n)].copy() for line, n in zip(order, enough)]
        return out

    def open_lists(self, q: np.ndarray, bounds: np.ndarray, radii: np.ndarray) -> list[np.ndarray]:
        """The lists that may hold a row within each query's bound; radii are the lists' (below 0: empty)."""
        centres, block, out = self.centres.astype(np.float64), max(1, AT_ONCE // len(self.centres)), []
        squares = (centres**2).sum(1)
        for s in range(0, len(q), block):
            some, within = q[s : s + block], bounds[s : s + block, None] + radii[None] + self.slack
            own = (some**2).sum(1)[:, None]
            apart = own + squares[None] - 2 * some @ centres.T - self.slack * (np.sqrt(own) + np.sqrt(squares)[None]) ** 2
            out += [np.flatnonzero(line) for line in (apart <= within**2) & (radii[None] >= 0)]
        return out

    def rough(self, q: np.ndarray, lists: np.ndarray, codes: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, rows): asymmetric squared distances, from one table of products for each query; and their rounding."""
        used, place = np.unique(lists, return_inverse=True)
        centres = self.centres[used].astype(np.float64)
        out = np.stack([((centres - one) ** 2).sum(1) for one in q])[:, place] + shift[None]
        coded = np.zeros(len(lists))
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            book = book.astype(np.float64)
            out -= np.take(2 * (q[:, a:b] @ book.T), codes[:, m], axis=1)
            coded += (book**2).sum(1)[codes[:, m]]
        reach = np.sqrt((centres**2).sum(1))[place] + np.sqrt(coded)
        return out, self.slack * (np.sqrt((q**2).sum(1))[:, None] + reach[None]) ** 2


def probes_for(centres: np.ndarray, x: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """The fewest nearest lists that hold `recall` of the k nearest sampled rows of the first sampled rows."""
    k, q = min(k, len(x) - 1), x[:queries]
    if k < 1:
        return len(centres)
    lists, _ = nearest(x, centres)
    d = (x**2).sum(1)[None] - 2 * q @ x.T
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    best = np.argpartition(d, k - 1, axis=1)[:, :k]
    order = np.argsort((centres**2).sum(1)[None] - 2 * q @ centres.T, axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    held = np.bincount(np.take_along_axis(place, lists[best], axis=1).ravel(), minlength=len(centres)).cumsum() / best.size
    return int(np.searchsorted(held, recall) + 1)


def fit(vectors: DataFrame, rows: int, largest: float, k: int = 10, recall: float = 0.97, most: int = 20_000, slices: int = 16, words: int = 256, seed: int = 9) -> Index:
    """Fit centres and codebooks on the `most` rows of vectors(vec_id, embedding) with the smallest id hashes.

    There are as many lists as the square root of all rows: up to a fortieth of
    the sample they are centres of their own, beyond that a second level, of
    centres of the first one's residuals, divides each alike. The number of
    lists that a query scans first is the least that reaches `recall` within the
    sample, so data in clusters need few and data without any need many. What
    the sample does not show costs time alone: see search.
    """
    sample = vectors.select("embedding", F.xxhash64("vec_id").alias("order"), "vec_id").orderBy("order", "vec_id").limit(most)
    scale = np.exp2(min(1023.0, np.ceil(np.log2(largest))))
    x = np.array([r[0] for r in sample.select("embedding").collect()], np.float64) / scale
    middle = x.mean(axis=0)
    x = (x - middle).astype(np.float32)
    width, lists = x.shape[1], max(1, int(np.sqrt(rows)))
    centres = lloyd(x, max(1, min(lists, len(x) // 40)), 8, seed)
    if lists > 2 * len(centres) and len(x) >= 80:
        rest = x - centres[nearest(x, centres)[0]]
        finer = lloyd(rest, min(len(rest) // 40, -(-lists // len(centres))), 8, seed + 99)
        centres = (centres[:, None] + finer[None]).reshape(-1, width)
    rest = x - centres[nearest(x, centres)[0]]
    cuts = [round(width * i / min(slices, width)) for i in range(min(slices, width) + 1)]
    books = [lloyd(np.ascontiguousarray(rest[:, a:b]), words, 6, seed + 1 + m) for m, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return Index(centres, books, cuts, float(scale), probes_for(centres, x, k, recall), middle)


INDEXED = "list int, row bigint, vec_id bigint, is_query boolean, embedding array<{t}>, codes binary, shift double, far double, error double"
ASKED = "query_row bigint, query_id bigint, embedding array<{t}>, bound double, lists array<int>"
FOUND = "query_row bigint, query_id bigint, row bigint, vec_id bigint, score double"


def search(vectors: DataFrame, queries: Column, k: int = 10, shortlist: int = 100, block_rows: int = 8192, **how) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query row, by exact distance on the original vectors.

    vectors has vec_id and embedding, of floats or doubles; queries is a
    condition on them. Every usable row with an id is indexed. A query scans its
    nearest lists (see fit), at least as many as hold k other rows; of each block of rows the codes' asymmetric
    distances choose the `shortlist` best, whose exact distances are ranked.
    Then the choice is checked, so that no data make it miss a neighbour: rows
    whose asymmetric distance, less the error of their code, is within the k-th
    distance found are looked at too, and so are the other lists that reach as
    far. The check leaves data in clusters nearly as they are and reads nearly
    all of data without any.

    Lists are dealt to groups, and each group is cut into blocks of about
    block_rows rows by a hash of the row, so that a list that a third of all
    rows share is spread over tasks; so are the queries of a group.

    A query's own row is no candidate; other rows that repeat its id are, and a
    repeated id that is a query has a list for each of its rows. Ties go to the
    smaller vec_id. Vectors of different lengths are never compared: each
    length has an index of its own, and its result is written before the next
    one's begins, so a table may hold any number of lengths. Other columns are
    left out, whatever their names; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    number = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{number}>").alias("embedding"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    width = F.size("embedding")
    widths = rows.groupBy(width.alias("width")).agg(F.count("*").alias("rows"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("largest")).orderBy("width").collect()
    found = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for w in widths:
        alike = rows.where(width == w["width"])
        index = fit(alike, w["rows"], w["largest"], k, **how)
        found = found.union(materialise(_search(alike, index, w["rows"], number, k, shortlist, block_rows), "ann-found"))
    return found


def by_group(lists: np.ndarray, groups: int) -> list[tuple[int, np.ndarray]]:
    """(group, its lists) of the lists, dealt by their remainder."""
    of = lists % groups
    order = np.argsort(of, kind="stable")
    parts = np.split(lists[order], np.flatnonzero(np.diff(of[order])) + 1)
    return [(int(part[0] % groups), part.astype(np.int32)) for part in parts if len(part)]


def _search(rows: DataFrame, index: Index, many: int, number: str, k: int, shortlist: int, block_rows: int) -> DataFrame:
    """search for rows(vec_id, embedding, is_query) of one length."""
    shared = rows.sparkSession.sparkContext.broadcast(index)  # a centre for each list: the square root of all rows
    groups = max(1, min(len(index.centres), many // block_rows))
    asked_as = ASKED.format(t=number)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                lists, codes, shift, far, error = shared.value.encode(shared.value.scaled(b["embedding"]))
                yield pd.DataFrame({"list": lists.astype(np.int32), "row": b["row"], "vec_id": b["vec_id"], "is_query": b["is_query"], "embedding": b["embedding"], "codes": [c.tobytes() for c in codes], "shift": shift, "far": far, "error": error})

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = shared.value.nearest_lists(shared.value.scaled(b["embedding"]), sizes, k + 1)
                yield pd.DataFrame({"query_row": b["row"], "query_id": b["vec_id"], "embedding": b["embedding"], "bound": np.inf, "lists": [lists.astype(np.int32) for lists in near]})

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                reached = shared.value.open_lists(shared.value.scaled(b["embedding"]), b["bound"].to_numpy() / shared.value.scale, radii)
                left = [np.setdiff1d(some, lists).astype(np.int32) for some, lists in zip(reached, b["lists"])]
                out = b.assign(lists=left)[["query_row", "query_id", "embedding", "bound", "lists"]]
                yield out[[len(some) > 0 for some in left]]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 64):
                out = [(g, *line[:4], lists) for line in b[s : s + 64].itertuples(index=False) for g, lists in by_group(line[4], groups)]
                yield pd.DataFrame(out, columns=["group", "query_row", "query_id", "embedding", "bound", "lists"])

    numbered = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "is_query", "embedding")
    indexed = materialise(numbered.mapInPandas(encode, INDEXED.format(t=number)), "ann-index").withColumn("group", F.col("list") % F.lit(groups).cast("bigint"))
    sizes, radii = np.zeros(len(index.centres), np.int64), np.full(len(index.centres), -np.inf)  # two numbers for each list
    for r in indexed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        sizes[r["list"]], radii[r["list"]] = r["n"], r["far"]
    # how many blocks each group's rows and queries are cut into: at most a row per group
    cut = lambda n, size: F.greatest(F.lit(1), F.round(n / size)).cast("int")
    row_blocks = materialise(indexed.groupBy("group").agg(cut(F.count("*"), block_rows).alias("row_blocks")), "ann-blocks")
    of = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def scan(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        at, out = shared.value, []
        if len(rows) and len(asked):
            ids, names, lists, error = rows["vec_id"].to_numpy(), rows["row"].to_numpy(), rows["list"].to_numpy(), rows["error"].to_numpy()
            x, q = np.stack(rows["embedding"].tolist()).astype(np.float64), np.stack(asked["embedding"].tolist()).astype(np.float64)
            near_x, near_q = at.scaled(x), at.scaled(q)
            squares = (near_x**2).sum(1)
            codes, shift = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1), rows["shift"].to_numpy()
            own, query_ids, bounds, wanted = asked["query_row"].to_numpy(), asked["query_id"].to_numpy(), asked["bound"].to_numpy(), asked["lists"].tolist()
            here, place = np.unique(lists, return_inverse=True)
            for s in range(0, len(q), 64):
                some = near_q[s : s + 64]
                rough, rounding = at.rough(some, lists, codes, shift)
                scans = np.array([np.isin(here, lists) for lists in wanted[s : s + 64]])
                rough[~scans[:, place] | (names[None] == own[s : s + 64, None])] = np.inf
                first = np.argpartition(rough, shortlist - 1, axis=1)[:, :shortlist] if len(lists) > shortlist else np.tile(np.arange(len(lists)), (len(some), 1))
                most = bounds[s : s + 64].copy()
                for n, picked in enumerate(first):
                    exact = distances(x[picked[rough[n, picked] < np.inf]], q[s + n])
                    if len(exact) >= k:
                        most[n] = min(most[n], np.partition(exact, k - 1)[k - 1])
                reach = most[:, None] / at.scale * (1 + 1e-12) + at.slack
                keep = (rough < np.inf) & (rough - rounding <= (reach + error[None]) ** 2)
                left = np.flatnonzero(keep.any(axis=0))
                length = (some**2).sum(1)[:, None]
                apart = length + squares[left][None] - 2 * some @ near_x[left].T - at.slack * (np.sqrt(length) + np.sqrt(squares[left])[None]) ** 2
                keep = keep[:, left] & (apart <= reach**2)
                for n, line in enumerate(keep):
                    picked = left[line]
                    exact = distances(x[picked], q[s + n])
                    best = np.lexsort((names[picked], ids[picked], exact))[:k]
                    best = best[exact[best] <= bounds[s + n]]
                    out.append((np.full(len(best), own[s + n]), np.full(len(best), query_ids[s + n]), names[picked][best], ids[picked][best], exact[best]))
        columns = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_row", "query_id", "row", "vec_id", "score"), columns)))

    def best(asked: DataFrame, *others: DataFrame) -> DataFrame:
        """The k best of the rows in the lists asked for, and of the others."""
        dealt = materialise(asked.mapInPandas(deal, "group bigint, " + asked_as), "ann-probes")
        query_blocks = dealt.groupBy("group").agg(cut(F.count("*"), block_rows).alias("query_blocks"))
        blocks = row_blocks.join(query_blocks, "group")
        left = indexed.join(blocks, "group").select("group", "list", "row", "vec_id", "embedding", "codes", "shift", "error", of("row", "row_blocks").alias("row_block"), every("query_blocks").alias("query_block"))
        right = dealt.join(blocks, "group").select("group", "query_row", "query_id", "embedding", "bound", "lists", of("query_row", "query_blocks").alias("query_block"), every("row_blocks").alias("row_block"))
        keys = ["group", "row_block", "query_block"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, FOUND)
        for other in others:
            found = found.union(other)
        rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id", "row")).cast("int")
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    asked = materialise(indexed.where("is_query").select("row", "vec_id", "embedding").mapInPandas(probes, asked_as), "ann-asked")
    first = materialise(best(asked).drop("rank"), "ann-first")
    kth = first.groupBy("query_row").agg(F.when(F.count("*") == k, F.max("score")).alias("kth"))
    within = asked.drop("bound").join(kth, "query_row", "left").withColumn("bound", F.coalesce("kth", F.lit(float("inf")))).drop("kth")
    found = best(within.mapInPandas(rest, asked_as), first)
    return found.select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every hundredth vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
