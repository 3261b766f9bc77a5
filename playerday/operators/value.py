"""Value segments: RFM scores, and k-means clusters of log-scaled, standardised features."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playerday.functions.scalars import signed_log1p
from playerday.functions.stats import quintile_scores, with_quantiles
from playerday.sources.schemas import VALUE_LABELS, KMeansConfig

LRFM = ["Recency", "Frequency", "Monetary", "Deposit", "Tenure"]
RFM_LABEL = "Value Segment (RFM Score)"


def rfm_scores(features: DataFrame) -> DataFrame:
    """features with the three quintile scores, RFMScore and its label; ties share a score.

    features is read once for the cuts of all three scores and once for its
    rows: hand over a written table (a row per player).
    """
    scored = {"RecencyDays": "RecencyScore", "Frequency": "FrequencyScore", "NetGaming": "MonetaryScore"}
    df = quintile_scores(features, scored, reverse=["RecencyDays"])
    df = df.withColumn("RFMScore", F.col("RecencyScore") + F.col("FrequencyScore") + F.col("MonetaryScore"))
    score = F.col("RFMScore")
    return df.withColumn(RFM_LABEL, F.when(score >= 13, "Premium").when(score >= 10, "High Value").when(score >= 7, "Medium Value").otherwise("Low Value"))


def lrfm_features(features: DataFrame) -> DataFrame:
    """(UserID, Recency, Frequency, Monetary, Deposit, Tenure), log-scaled."""
    log = lambda c: F.log1p(F.col(c).cast("double"))
    return features.select("UserID", log("RecencyDays").alias("Recency"), log("Frequency").alias("Frequency"), signed_log1p("NetGaming").alias("Monetary"), log("DepositAmount").alias("Deposit"), log("TenureDays").alias("Tenure"))


def standardize(df: DataFrame, columns: list[str] = LRFM) -> DataFrame:
    """(x - mean) / population deviation; a constant column is divided by 1."""
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    wide = df.join(F.broadcast(stats), how="cross")
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}
    return wide.withColumns(scaled).drop(*stats.columns)


def _distances(columns: list[str], centroids: list[list[float]]) -> Column:
    return F.array(*[sum((F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(columns, m)) for m in centroids])


def kmeans_assign(df: DataFrame, centroids: list[list[float]], columns: list[str] = LRFM) -> DataFrame:
    """df with KMeansCluster (the nearest centroid, first on ties) and Distance (squared)."""
    far = _distances(columns, centroids)
    df = df.withColumn("__d", far).withColumn("Distance", F.array_min("__d"))
    return df.withColumn("KMeansCluster", (F.array_position("__d", F.col("Distance")) - 1).cast("int")).drop("__d")


def kmeans_update(df: DataFrame, centroids: list[list[float]], columns: list[str] = LRFM) -> tuple[DataFrame, DataFrame]:
    """One Lloyd step: (cluster, count, new means) and a row with inertia and the largest move of a centroid."""
    near = kmeans_assign(df, centroids, columns)
    means = near.groupBy("KMeansCluster").agg(F.count("*").alias("Players"), *[F.avg(c).alias(c) for c in columns])
    move = F.greatest(*[F.abs(F.col(c) - F.get(F.array(*[F.lit(float(m[i])) for m in centroids]), F.col("KMeansCluster"))) for i, c in enumerate(columns)])
    stats = means.agg(F.max(move).alias("Shift")).join(near.agg(F.sum("Distance").alias("Inertia")), how="cross")
    return means, stats


def inertia(df: DataFrame, centroids: list[list[float]], columns: list[str] = LRFM) -> DataFrame:
    return kmeans_assign(df, centroids, columns).agg(F.sum("Distance").alias("Inertia"))


#: Rows of the matrix in one partition, and rows that starting centres are drawn from.
ROWS_PER_PART, START_ROWS = 100_000, 10_000


def _matrix(scaled: DataFrame, columns: list[str]) -> DataFrame:
    """The features as one cached array column x, in as many partitions as its rows need."""
    data = scaled.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    return data.repartition(max(1, math.ceil(scaled.count() / ROWS_PER_PART))).persist()


def spread_rows(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of x, each drawn with a chance in proportion to its squared distance from those before (k-means++)."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    far = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = far.sum()
        chosen.append(int(rng.choice(len(x), p=far / total)) if total > 0 else int(rng.integers(len(x))))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _lloyd_sums(matrix: DataFrame, models: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(rows, sums of the features, by model and centre; cost by model) of one pass over the matrix for all models.

    Tasks hold the sums of every centre and one batch; they are combined by centre.
    """
    width, all_centres = models[0].shape[1], np.concatenate(models)
    edges = np.cumsum([0, *map(len, models)])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cost = np.zeros(len(all_centres)), np.zeros((len(all_centres), width)), np.zeros(len(all_centres))
        squares = (all_centres**2).sum(axis=1)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, width)
            apart = squares[None] - 2 * x @ all_centres.T
            own = (x**2).sum(axis=1)
            for a, b in zip(edges, edges[1:]):
                near = apart[:, a:b].argmin(axis=1)
                n[a:b] += np.bincount(near, minlength=b - a)
                cost[a:b] += np.bincount(near, weights=np.maximum(own + apart[np.arange(len(x)), a + near], 0), minlength=b - a)
                for d in range(width):
                    sums[a:b, d] += np.bincount(near, weights=x[:, d], minlength=b - a)
        columns = [pa.array(np.arange(len(all_centres))), pa.array(n), pa.array(cost), *[pa.array(sums[:, d]) for d in range(width)]]
        yield pa.RecordBatch.from_arrays(columns, names=["centre", "n", "cost", *[f"s{d}" for d in range(width)]])

    added = [F.sum(c).alias(c) for c in ("n", "cost", *[f"s{d}" for d in range(width)])]
    schema = "centre bigint, n double, cost double, " + ", ".join(f"s{d} double" for d in range(width))
    rows = matrix.mapInArrow(step, schema).groupBy("centre").agg(*added).toPandas().sort_values("centre").to_numpy()  # a row for each centre
    parts = [rows[a:b] for a, b in zip(edges, edges[1:])]
    return [p[:, 1] for p in parts], [p[:, 3:] for p in parts], np.array([p[:, 2].sum() for p in parts])


def kmeans_fits(matrices: list[DataFrame], ks: list[int], config: KMeansConfig = KMeansConfig(), n_init: int | None = None) -> dict[tuple[int, int], list[list[float]]]:
    """(number of the matrix, k) -> centroids of the best of n_init starts (seed, seed + 1, ...) by cost.

    All starts of all k move together: an iteration is one job over the cached
    matrix, which adds up rows and features by nearest centre for every model
    that still moves, so 140 fits take as many passes as the slowest of them.
    What comes back is a row for each centre. Starts are drawn by k-means++
    from the START_ROWS rows with the smallest hashes; a centre without rows
    stays where it is.
    """
    best: dict[tuple[int, int], list[list[float]]] = {}
    for i, matrix in enumerate(matrices):
        some = np.array([r[0] for r in matrix.orderBy(F.xxhash64("x"), "x").limit(START_ROWS).collect()], np.float64)
        if not len(some):
            raise ValueError("no rows to cluster")
        chains = [spread_rows(some, max(ks), config.seed + start) for start in range(n_init or config.n_init)]
        names = [(k, start) for k in ks for start in range(len(chains))]
        models = [chains[start][:k].copy() for k, start in names]
        moving = list(range(len(models)))
        for _ in range(config.max_iter):
            counts, sums, _ = _lloyd_sums(matrix, [models[m] for m in moving])
            still = []
            for m, n, total in zip(moving, counts, sums):
                after = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], models[m])
                if np.sqrt(((after - models[m]) ** 2).sum(axis=1)).max() > config.tol:
                    still.append(m)
                models[m] = after
            moving = still
            if not moving:
                break
        _, _, costs = _lloyd_sums(matrix, models)
        for k in ks:
            _, m = min((costs[m], m) for m, (of, _) in enumerate(names) if of == k)
            best[i, k] = models[m].tolist()
    return best


def kmeans_fit(scaled: DataFrame, config: KMeansConfig = KMeansConfig(), k: int | None = None, n_init: int | None = None, columns: list[str] = LRFM) -> list[list[float]]:
    """Centroids of the best of n_init runs."""
    data = _matrix(scaled, columns)
    try:
        return kmeans_fits([data], [k or config.k], config, n_init)[0, k or config.k]
    finally:
        data.unpersist()


def silhouette(df: DataFrame, columns: list[str] = LRFM, key: str = "UserID", cluster: str = "KMeansCluster", most: int = KMeansConfig.silhouette_sample) -> DataFrame:
    """Exact mean Euclidean silhouette of a bounded sample; a lone point counts 0, a single cluster gives 0.

    All pairs of the sample are taken, so df may have `most` rows at most; more
    raise an error (see silhouette_sample).
    """
    if (rows := df.limit(most + 1).count()) > most:
        raise ValueError(f"a silhouette takes {most} rows at most, found {rows} or more: hand over a sample")
    a = df.select(F.col(key).alias("i"), F.col(cluster).alias("ci"), F.array(*columns).alias("x"))
    b = df.select(F.col(key).alias("j"), F.col(cluster).alias("cj"), F.array(*columns).alias("y"))
    far = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    pairs = a.join(F.broadcast(b), F.col("i") != F.col("j")).groupBy("i", "ci", "cj").agg(F.avg(far).alias("d"))
    inside = F.max(F.when(F.col("ci") == F.col("cj"), F.col("d")))
    outside = F.min(F.when(F.col("ci") != F.col("cj"), F.col("d")))
    each = pairs.groupBy("i").agg(inside.alias("a"), outside.alias("b"))
    width = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.agg(F.coalesce(F.avg(width), F.lit(0.0)).alias("MeanSilhouette"))


def silhouette_sample(scaled: DataFrame, config: KMeansConfig = KMeansConfig()) -> DataFrame:
    """The rows with the smallest id hashes: the same sample on every run."""
    return scaled.orderBy(F.md5(F.col("UserID").cast("string").cast("binary")), "UserID").limit(config.silhouette_sample)


def kmeans_diagnostics(scaled: DataFrame, config: KMeansConfig = KMeansConfig()) -> DataFrame:
    """(K, Inertia, MeanSilhouette, SilhouetteSampleSize, Selected) for each K, and a row of commentary without K.

    The silhouette's sample is clustered on its own.
    """
    spark = scaled.sparkSession
    sample = silhouette_sample(scaled, config).persist()
    matrices = [_matrix(scaled, LRFM), _matrix(sample, LRFM)]
    try:
        best = kmeans_fits(matrices, list(config.k_range), config)
        size, rows = sample.count(), []
        for k in config.k_range:
            cost = inertia(scaled, best[0, k]).first()[0]
            width = silhouette(kmeans_assign(sample, best[1, k]), most=config.silhouette_sample).first()[0]
            rows.append((k, round(cost, 2), round(width, 4), size, "Yes" if k == config.k else ""))
    finally:
        for cached in (sample, *matrices):
            cached.unpersist()
    found = spark.createDataFrame(rows, "K int, Inertia double, MeanSilhouette double, SilhouetteSampleSize bigint, Selected string")
    note = diagnostics_note(found, config).select(F.format_string(f"K={config.k} is selected; the silhouette is best at K=%d with %.4f, and all values lie within %.3f of each other ({config.n_init} starts for each fit)", F.col("BestK.K"), "BestSilhouette", "Spread"))
    return found.union(note.select(*[F.lit(None)] * 4, "*"))


def diagnostics_note(diagnostics: DataFrame, config: KMeansConfig = KMeansConfig()) -> DataFrame:
    """(BestK, BestSilhouette, Spread, SelectedIsBest) of a diagnostics table."""
    best = F.max_by(F.struct("K"), F.struct("MeanSilhouette", -F.col("K")))
    return diagnostics.agg(best.alias("BestK"), F.max("MeanSilhouette").alias("BestSilhouette"), F.round(F.max("MeanSilhouette") - F.min("MeanSilhouette"), 3).alias("Spread"), (best["K"] == config.k).alias("SelectedIsBest"))


def archetypes(centroids: DataFrame) -> DataFrame:
    """Centroid rows with Behaviour Archetype; equal names carry their cluster id."""
    r, f, m = (F.col(c) for c in ("Recency", "Frequency", "Monetary"))
    life = F.when(r < -0.5, "Active").when(r > 0.5, "Lapsed").otherwise("Cooling")
    kind = F.when(m < -0.5, "Net Winners").when(m > 0.5, "Whales").when(f > 0, "Regulars").otherwise("Casuals")
    named = centroids.withColumn("__name", F.concat_ws(" ", life, kind))
    twice = F.count("*").over(Window.partitionBy("__name")) > 1
    suffix = F.concat(F.lit(" (C"), F.col("KMeansCluster").cast("string"), F.lit(")"))
    return named.withColumn("Behaviour Archetype", F.when(twice, F.concat("__name", suffix)).otherwise(F.col("__name"))).drop("__name")


def cluster_profile(clustered: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """One row per cluster: size, net gaming, medians, share, tier (by net gaming per player) and archetype."""
    spark = clustered.sparkSession
    points = spark.createDataFrame([(i, *c) for i, c in enumerate(centroids)], "KMeansCluster int, " + ", ".join(f"{c} double" for c in LRFM))
    rows = clustered.groupBy("KMeansCluster").agg(F.count("*").alias("Players"), F.sum("NetGaming").cast("double").alias("TotalNetGaming"))
    medians = {f"Median{c}": (c, 0.5) for c in ("NetGaming", "RecencyDays", "Frequency", "DepositAmount")}
    rows = with_quantiles(rows, clustered, medians, ["KMeansCluster"])
    rows = rows.withColumn("NetGamingPerPlayer", F.col("TotalNetGaming") / F.col("Players")).join(F.broadcast(archetypes(points)), "KMeansCluster")
    place = F.row_number().over(Window.orderBy("NetGamingPerPlayer", "KMeansCluster"))  # a row per cluster
    label = F.get(F.array(*map(F.lit, VALUE_LABELS)), F.least(place - 1, F.lit(len(VALUE_LABELS) - 1)))
    share = F.try_divide("TotalNetGaming", F.sum("TotalNetGaming").over(Window.partitionBy()))
    return rows.withColumns({"Value Segment": label, "NetGamingShare": share})


def kmeans_segments(features: DataFrame, config: KMeansConfig = KMeansConfig(), n_init: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(features with KMeansCluster, Value Segment, Behaviour Archetype; cluster profile)."""
    scaled = standardize(lrfm_features(features))
    centroids = kmeans_fit(scaled, config, n_init=n_init)
    near = kmeans_assign(scaled, centroids).select("UserID", "KMeansCluster")
    clustered = features.join(near, "UserID")
    profile = cluster_profile(clustered, centroids)
    return clustered.join(F.broadcast(profile.select("KMeansCluster", "Value Segment", "Behaviour Archetype")), "KMeansCluster"), profile
