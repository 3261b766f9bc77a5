"""Data profiling, and checks of a player-day table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from playerday.sources.files import laid_out, work_tables
from playerday.sources.schemas import MONEY, NUMERIC, PLAYER_DAY


def _violations(df: DataFrame) -> dict[str, Column]:
    """Check -> aggregate of its violations in the rows of df, whatever the types that they were read in."""
    text = lambda c: F.col(c).cast("string")
    bad = {"no rows": F.when(F.count("*") == 0, 1).otherwise(0).cast("bigint"), "invalid ActivityDate": F.count_if(text("ActivityDate").try_cast("date").isNull()), "invalid UserID": F.count_if(text("UserID").try_cast("bigint").isNull())}
    return bad | {f"invalid {c}": F.count_if(text(c).try_cast("double").isNull() | F.isnan(text(c).try_cast("double"))) for c in NUMERIC}


def _missing(df: DataFrame) -> list[tuple[str, int]]:
    return [(f"missing column {c}", 1) for c in PLAYER_DAY if c not in df.columns]


def validate_player_day(df: DataFrame) -> DataFrame:
    """(check, violations): missing columns, no rows, bad dates, non-numeric values, repeated player-days."""
    if missing := _missing(df):
        return df.sparkSession.createDataFrame(missing, "check string, violations bigint")
    row = df.agg(*[v.alias(k) for k, v in _violations(df).items()])
    twice = df.groupBy("UserID", "ActivityDate").count().agg(F.count_if(F.col("count") > 1).alias("repeated player-day"))
    row = row.join(twice, how="cross")
    return row.unpivot([], row.columns, "check", "violations")


def load_player_day(df: DataFrame) -> DataFrame:
    """A read player-day table, checked, typed, trimmed and laid out by player; raises on any violation.

    The checks are metrics observed on the one pass that writes the laid-out
    table. An executor lost during it may count a violation twice, never a
    violation where there is none.
    """
    spark = df.sparkSession
    if missing := _missing(df):
        raise ValueError(f"violations: {dict(missing)}")
    money = [c for c in NUMERIC if c.endswith(("Wagers", "Winnings", "Amount"))]
    text = lambda c: F.col(c).cast("string")
    kinds = {c: MONEY if c in money else "bigint" for c in NUMERIC} | {"UserID": "bigint", "ActivityDate": "date", "CashGameAvgOdds": "double", "TournamentAvgOdds": "double"}
    # whole numbers may be written like 19.0, as exact decimals they keep all digits
    cast = {c: text(c).try_cast("decimal(28,5)").try_cast(k) if k == "bigint" else text(c).try_cast(k) for c, k in kinds.items()}
    rows, days = Observation(), Observation()
    read = df.observe(rows, *[v.alias(k) for k, v in _violations(df).items()])
    read = read.withColumns(cast | {"Gender": F.trim("Gender"), "Country": F.trim("Country")}).select(*PLAYER_DAY)
    by = Window.partitionBy("UserID", "ActivityDate").orderBy("ActivityDate")
    read = read.repartition("UserID").withColumn("__place", F.row_number().over(by))  # a repeated day is counted once, at its second row
    read = read.observe(days, F.count_if(F.col("__place") == 2).alias("repeated player-day")).drop("__place")
    with work_tables(spark) as work:
        out = laid_out(read, "player-days")
        # of a table without rows nothing may be observed at all
        bad = {"no rows": 1} if out.isEmpty() else {k: v for k, v in (rows.get | days.get).items() if v}
        if not bad:
            work.keep()
    if bad:
        raise ValueError(f"violations: {bad}")
    return out


def profile(df: DataFrame, name: str, key: str, distinct: list[str], dates: list[str] = (), measures: list[str] = ()) -> DataFrame:
    """(Table, Metric, Value) of a staging table: rows, distinct keys, date span (days since 1970), sums, means, nulls."""
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    aggs = {"rows": F.count("*")} | {f"distinct {c}": F.countDistinct(c) for c in [key, *distinct]} | {f"min {c}": F.min(day(c)) for c in dates} | {f"max {c}": F.max(day(c)) for c in dates}
    aggs |= {f"sum {c}": F.sum(c) for c in measures} | {f"avg {c}": F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double")) for c in measures}
    aggs |= {f"nulls {c}": F.count_if(F.col(c).isNull()) for c in df.columns}
    row = df.agg(*[v.cast("double").alias(k) for k, v in aggs.items()])
    return row.unpivot([], row.columns, "Metric", "Value").select(F.lit(name).alias("Table"), "Metric", "Value")


#: Of a sketch: k of the quantiles (rank error about 1.65 / k^0.9) and lg of the registers of the distinct count (error 1.04 / 2^(lg / 2)).
KLL_K, HLL_LG = 2000, 14


def _is_number(kind: str) -> bool:
    return kind in ("int", "bigint", "double", "float", "smallint") or kind.startswith("decimal")


def column_sketches(df: DataFrame, span: Column | None = None) -> DataFrame:
    """(Span, column_name, column_type, ...): what summaries of each column are made of, by span of the rows (null: one span).

    Counts, extremes, sums and two sketches: quantiles (KLL) and distinct
    values (HLL). Rows of new spans are put beside the old ones; a summary over
    any of them is a merge. One pass over df, a row per column and span.
    """
    each = []
    for c, t in df.dtypes:
        x = F.col(c).cast("double") if _is_number(t) else F.lit(None).cast("double")
        facts = {"column_name": F.lit(c), "column_type": F.lit(t), "min": F.min(c).cast("string"), "max": F.max(c).cast("string"), "least": F.min(x), "most": F.max(x), "rows": F.count("*"), "nulls": F.count_if(F.col(c).isNull()), "values": F.count(x), "mean": F.avg(x), "squares": F.var_pop(x) * F.count(x), "quantiles": F.kll_sketch_agg_double(x, F.lit(KLL_K)), "distinct": F.hll_sketch_agg(F.col(c).cast("string"), HLL_LG)}
        each.append(F.struct(*[v.alias(k) for k, v in facts.items()]))
    spans = df.groupBy((F.lit(None).cast("date") if span is None else span).alias("Span")).agg(F.array(*each).alias("columns"))
    return spans.select("Span", F.inline("columns"))


def summarize(sketches: DataFrame) -> DataFrame:
    """A row per column of column_sketches: type, min, max, approximate distinct count, mean, deviation, quartiles, count, null share.

    Spans are merged: deviations by the sums of squares within and between
    spans, quartiles and distinct counts by their sketches. Texts compare as
    texts, numbers as numbers.
    """
    n = F.sum("values")
    mean = F.try_divide(F.sum(F.col("mean") * F.col("values")), n)
    between = F.sum(F.col("values") * F.col("mean") * F.col("mean")) - n * mean * mean
    quarter = lambda q: F.when(n > 0, F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("quantiles", KLL_K), F.lit(q)))
    return sketches.groupBy("column_name", "column_type").agg(
        F.coalesce(F.min_by("min", "least"), F.min("min")).alias("min"), F.coalesce(F.max_by("max", "most"), F.max("max")).alias("max"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("approx_unique"), mean.alias("avg"), F.sqrt(F.try_divide(F.sum("squares") + F.greatest(between, F.lit(0.0)), n - 1)).alias("std"),
        quarter(0.25).alias("q25"), quarter(0.5).alias("q50"), quarter(0.75).alias("q75"), F.sum("rows").alias("count"), F.try_divide(100.0 * F.sum("nulls"), F.sum("rows")).alias("null_percentage"),
    )


def frequencies(df: DataFrame, column: str, amount: str | None = None) -> DataFrame:
    """Rows (and the sum of an amount) by value."""
    more = [F.round(F.sum(amount), 2).alias("TotalAmount")] if amount else []
    return df.groupBy(column).agg(F.count("*").alias("RowCount"), *more).orderBy(F.desc("RowCount"), column)


def rows_by_year(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy(F.year(date).alias("Year")).agg(F.count("*").alias("RowCount")).orderBy("Year")


def top_active_users(df: DataFrame, n: int = 10) -> DataFrame:
    """The users with the most rows; ties to the smaller id."""
    return df.groupBy("UserID").agg(F.count("*").alias("RowCount")).orderBy(F.desc("RowCount"), "UserID").limit(n)
