"""Pairs of rows that share a key but not a class, without the pairs inside a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with more rows, of two classes or more, are paired by way of their main class.
HOT_KEY = 1000


def pairs_between_classes(filed: DataFrame, apart: str, near: Column, ordered: Column, chosen: list[Column], hot_key: int = HOT_KEY) -> DataFrame:
    """The chosen columns of rows a and b of filed(key, apart, ...), for every two of one key, in different classes and near.

    near and ordered are conditions on the aliases a and b, ordered true one
    way round for any two rows. A key with one row, or whose rows share one
    class, makes no pair and is left out before the join. In a key of many rows
    the largest class is nearly always most of it: there only the others, the
    strangers, are paired, with the main class and among themselves, so that a
    group of near copies beside a stranger is not squared. The result is the
    same for every hot_key.

    filed is often exploded from a few bytes a row, which Spark's estimate of its
    size leaves out: unhinted, its joins would be broadcast by way of the driver.
    """
    stats = filed.groupBy("key").agg(F.min(apart).alias("low"), F.max(apart).alias("high"), F.count("*").alias("n"))
    left_out = stats.where(f"(low = high AND n > 1) OR (low < high AND n > {hot_key})").select("key")
    few = filed.join(left_out.hint("merge"), "key", "left_anti")
    same_key, differ = F.col("a.key") == F.col("b.key"), F.col(f"a.{apart}") != F.col(f"b.{apart}")
    plain = few.alias("a").hint("merge").join(few.alias("b"), same_key & ordered & differ & near).select(*chosen)

    hot = filed.join(stats.where(f"low < high AND n > {hot_key}").select("key").hint("merge"), "key", "left_semi")
    main = hot.groupBy("key", apart).count().groupBy("key").agg(F.max_by(apart, "count").alias("main"))
    marked = hot.join(main.hint("merge"), "key")
    strangers = marked.where(F.col(apart) != F.col("main"))
    once = (F.col(f"b.{apart}") == F.col("b.main")) | ordered
    return plain.union(strangers.alias("a").hint("merge").join(marked.alias("b"), same_key & once & differ & near).select(*chosen))
