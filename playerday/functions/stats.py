"""Ranks, quantiles and category shares without a single-partition window and without a group in one reducer."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playerday.sources.files import written

#: Distinct values that a task sums in order.
PER_PART = 100_000
#: A value held by this share of the rows or more is joined by broadcast; there are at most as many such values as fit.
HOT_SHARE = 1000


def value_counts(df: DataFrame, columns: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(*by, column, value, ties): each distinct non-null value of each column, as double, with its rows; one pass over df."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c.cast("double").alias("value")) for n, c in columns.items()]))
    rows = df.select(*by, each.alias("__e")).select(*by, "__e.*").where("value IS NOT NULL")
    return rows.groupBy(*by, "column", "value").agg(F.count("*").alias("ties"))


def same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys, nulls too."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def cumulative(df: DataFrame, columns: dict[str, Column], by: Sequence[str] = (), per_part: int | None = None) -> DataFrame:
    """value_counts with before, the rows of the same group and column below the value, and total, all of them.

    The counts are dealt in order of group, column and value to parts of at most
    about per_part values each, so their number grows with the distinct values
    and no part depends on how a group's values lie. Sums run inside a part; one
    row a part and group is summed in order across parts.
    """
    keys = [*by, "column"]
    counts = written(value_counts(df, columns, by), "value-counts")
    parts = max(1, math.ceil(counts.count() / (per_part or PER_PART)))
    ranged = counts.repartitionByRange(parts, *keys, "value") if parts > 1 else counts.coalesce(1)
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "value-parts")
    of_part = Window.partitionBy(*keys).orderBy("part")
    sums = ranged.groupBy(*keys, "part").agg(F.sum("ties").alias("inside"))
    sums = sums.select(*keys, "part", F.coalesce(F.sum("inside").over(of_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"), F.sum("inside").over(Window.partitionBy(*keys)).alias("total"))
    order = Window.partitionBy(*keys, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumn("running", F.coalesce(F.sum("ties").over(order), F.lit(0)))
    joined = running.join(sums, same(running, sums, [*keys, "part"]))
    return joined.select(*[running[k] for k in keys], "value", "ties", (F.col("below") + F.col("running")).alias("before"), "total")


def quantiles(df: DataFrame, wanted: dict[str, tuple[str | Column, float]], by: Sequence[str] = (), per_part: int | None = None) -> DataFrame:
    """(*by, *wanted): exact quantiles by linear interpolation, wanted as name -> (column, share); null without values.

    Groups whose columns are all null have no row. Exact percentiles of the
    engine keep all distinct values of a group in one reducer; here two order
    statistics of each quantile are picked from cumulative counts.
    """
    named = {n: F.col(c) if isinstance(c, str) else c for n, (c, _) in wanted.items()}
    plain = {c: F.col(c) for c, _ in wanted.values() if isinstance(c, str)}
    source = {n: c if isinstance(c, str) else n for n, (c, _) in wanted.items()}
    columns = plain | {n: named[n] for n in wanted if source[n] not in plain}
    rows = cumulative(df, columns, by, per_part)
    aggs, results = [], []
    for i, (name, (_, share)) in enumerate(wanted.items()):
        place = (F.col("total") - 1) * float(share)
        mine = F.col("column") == source[name]
        for end, p in (("lo", F.floor(place)), ("hi", F.least(F.floor(place) + 1, F.col("total") - 1))):
            aggs.append(F.max(F.when(mine & (F.col("before") <= p) & (p < F.col("before") + F.col("ties")), F.col("value"))).alias(f"__{end}{i}"))
        aggs.append(F.max(F.when(mine, place - F.floor(place))).alias(f"__part{i}"))
        results.append((F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__part{i}")).alias(name))
    return (rows.groupBy(*by) if by else rows).agg(*aggs).select(*by, *results)


def with_quantiles(out: DataFrame, df: DataFrame, wanted: dict[str, tuple[str | Column, float]], by: Sequence[str]) -> DataFrame:
    """out(*by, ...), a row per group of df, with the quantiles of the group."""
    found = quantiles(df, wanted, by)
    found = found.select(*[F.col(f"`{b}`").alias(f"__{i}") for i, b in enumerate(by)], *wanted)
    met = reduce(lambda x, y: x & y, [out[f"`{b}`"].eqNullSafe(found[f"__{i}"]) for i, b in enumerate(by)])
    return out.join(found, met, "left").drop(*[f"__{i}" for i in range(len(by))])


def avg_ranks(df: DataFrame, columns: dict[str, str], per_part: int | None = None) -> DataFrame:
    """df with twice the average rank (ties share it) of each column in columns[column]; null for null values.

    Twice the rank is an integer, so scores built on it are exact. df is read
    once for the ranks of all columns and once for the rows. Ranks of values
    that a thousandth of the rows or more share come by broadcast (a thousand
    rows a column at most), the others by a join whose keys are all small.
    """
    ranks = written(cumulative(df, {c: F.col(c) for c in columns}, per_part=per_part).select("column", "value", "total", "ties", (2 * F.col("before") + F.col("ties") + 1).alias("rank")), "ranks")
    out = df
    for column, name in columns.items():
        mine = ranks.where(F.col("column") == column)
        hot = F.col("ties") * HOT_SHARE >= F.col("total")
        hot_ranks = mine.where(hot).select(F.col("value").alias("__hot"), F.col("rank").alias("__hot_rank"))
        other = mine.where(~hot).select(F.col("value").alias("__value"), F.col("rank").alias("__rank"))
        value = F.col(column).cast("double")
        out = out.join(F.broadcast(hot_ranks), value == F.col("__hot"), "left")
        out = out.join(other, F.when(F.col("__hot_rank").isNull(), value) == F.col("__value"), "left")
        out = out.withColumn(name, F.coalesce("__hot_rank", "__rank")).drop("__hot", "__hot_rank", "__value", "__rank")
    return out


def quintile(twice_rank: Column, n: Column, bins: int = 5, reverse: bool = False) -> Column:
    """ceil(bins * average rank / n), within 1..bins, in integer arithmetic."""
    score = F.greatest(F.lit(1), F.least(F.lit(bins), F.expr("1") * F.floor((twice_rank * bins + 2 * n - 1) / (2 * n)))).cast("int")
    return (bins + 1 - score) if reverse else score


def quintile_scores(df: DataFrame, columns: dict[str, str], bins: int = 5, reverse: Sequence[str] = ()) -> DataFrame:
    """df with the quintile of each column's average rank among all rows of df in columns[column].

    The score grows with the value, so it is fixed by the least value of each
    score: bins - 1 cuts a column, which one pass over df and its value counts
    give and one row brings back; no join on values. A null value has no score.
    """
    rows = cumulative(df, {c: F.col(c) for c in columns} | {"__rows": F.lit(0)})
    # a score counts rows with null values too
    counted = rows.agg(F.max(F.when(F.col("column") == "__rows", F.col("total"))).alias("__n"))
    rows = rows.where("column <> '__rows'").join(F.broadcast(counted), how="cross")
    score = quintile(2 * F.col("before") + F.col("ties") + 1, F.col("__n"), bins)
    cuts = [F.min(F.when((F.col("column") == c) & (score > k), F.col("value"))).alias(f"__{i}_{k}") for i, c in enumerate(columns) for k in range(1, bins)]
    out = df.join(F.broadcast(rows.agg(*cuts)), how="cross")  # one row
    for i, (c, name) in enumerate(columns.items()):
        value = F.col(c).cast("double")
        above = sum((F.coalesce(value >= F.col(f"__{i}_{k}"), F.lit(False)).cast("int") for k in range(1, bins)), F.lit(1))
        out = out.withColumn(name, F.when(value.isNotNull(), F.lit(bins + 1) - above if c in reverse else above))
    return out.drop(*[f"__{i}_{k}" for i in range(len(columns)) for k in range(1, bins)])


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], per_part: int | None = None) -> dict[str, float | None]:
    """name -> exact quantile over all rows, for name -> (column, share); one row reaches the driver."""
    return quantiles(df, wanted, per_part=per_part).first().asDict()


def category_mix(df: DataFrame, segment: str, column: str, top: int | None = None) -> DataFrame:
    """(segment, dimension, value, players, share): shares of a category in each segment; null is Unknown."""
    counts = df.groupBy(F.col(segment).alias("segment"), F.coalesce(F.col(column).cast("string"), F.lit("Unknown")).alias("value")).agg(F.count("*").alias("players"))
    share = F.col("players") / F.sum("players").over(Window.partitionBy("segment"))
    out = counts.withColumn("share", share)
    if top:
        order = Window.partitionBy("segment").orderBy(F.desc("players"), "value")
        out = out.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top).drop("n")
    return out.select("segment", F.lit(column).alias("dimension"), "value", "players", "share")


def mix_text(mix: DataFrame) -> DataFrame:
    """(segment, dimension, text): "name: 12%" parts, largest first."""
    part = F.struct((-F.col("players")).alias("n"), F.col("value"), F.format_string("%s: %.0f%%", "value", F.bround(F.col("share") * 100, 0)).alias("text"))
    return mix.groupBy("segment", "dimension").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), ", ").alias("text"))
