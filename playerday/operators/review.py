"""The review queue of top withdrawers, and checks of the file that comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playerday.operators.features import net_gaming
from playerday.sources.schemas import REVIEW, REVIEW_DECISIONS, REVIEW_STATUSES


def top_withdrawers(player_day: DataFrame, n: int = 50, strict: bool = False) -> DataFrame:
    """The n players with the largest withdrawals, with their details on the last day of a withdrawal.

    One aggregation per player; a top-n per task and a merge, no full sort.
    strict raises unless there are exactly n.
    """
    df = net_gaming(player_day)
    out = F.col("WithdrawalAmount") > 0
    latest = F.max_by(F.struct("ActivityDate", "Gender", "Age", "Country"), F.when(out, F.col("ActivityDate")))
    totals = df.groupBy("UserID").agg(*[F.sum(c).alias(c) for c in ("WagerAmount", "WinningAmount", "DepositAmount", "WithdrawalAmount")], latest.alias("last"), F.count_if(out).alias("__days"))
    top = totals.where("__days > 0").orderBy(F.desc("WithdrawalAmount"), "UserID").limit(n)
    top = top.select(F.col("last.ActivityDate").alias("ActivityDate"), "UserID", "last.Gender", "last.Age", "last.Country", "WagerAmount", "WinningAmount", "DepositAmount", "WithdrawalAmount")
    if strict and (found := top.count()) != n:
        raise ValueError(f"expected {n} players with successful withdrawals, found {found}")
    return top


def review_table(top: DataFrame) -> DataFrame:
    """The twelve review columns; nothing is reviewed yet."""
    texts = [F.col("ActivityDate"), F.col("UserID").cast("string"), F.trim("Gender"), F.col("Age"), F.trim("Country"), *[F.col(c).cast("double") for c in ("WagerAmount", "WinningAmount", "DepositAmount", "WithdrawalAmount")], F.lit(REVIEW_STATUSES[0]), F.lit(""), F.lit("")]
    return top.select(*[c.alias(name) for c, name in zip(texts, REVIEW)])


def validate_review(returned: DataFrame, baseline: DataFrame, position: str = "position", n: int = 50, tolerance: float = 1e-8) -> DataFrame:
    """(check, violations) of a returned review table; both tables carry their row position.

    Texts are trimmed before they are compared; amounts may differ by the tolerance.
    """
    spark = returned.sparkSession
    columns = [c for c in returned.columns if c != position]
    if columns != REVIEW:
        return spark.createDataFrame([("columns", 1)], "check string, violations bigint")
    clean = returned.withColumns({c: F.trim(F.col(c)) for c in ("Player ID", "Gender", "Country", "Review Status", "Decision")})
    base = baseline.select(position, *[F.col(c).alias(f"b_{c}") for c in REVIEW[:9]])
    both = clean.join(base, position, "full_outer")
    same = F.lit(True)
    for c in REVIEW[:9]:
        a, b = F.col(c), F.col(f"b_{c}")
        same &= F.coalesce(F.abs(a.cast("double") - b.cast("double")) <= tolerance, a.isNull() & b.isNull()) if c.endswith("Amount") else a.cast("string").eqNullSafe(F.trim(b.cast("string")))
    counts = clean.agg(F.count("*").alias("rows"), F.countDistinct("Player ID").alias("ids"), F.count_if(~F.coalesce(F.col("Review Status").isin(REVIEW_STATUSES), F.lit(False))).alias("status"), F.count_if(~F.coalesce(F.col("Decision").isin(REVIEW_DECISIONS), F.lit(False))).alias("decision"))
    out = counts.join(both.agg(F.count_if(~same).alias("changed")), how="cross").select(
        F.lit(0).cast("bigint").alias("columns"), F.abs(F.col("rows") - n).alias("row count"), (F.col("rows") - F.col("ids")).alias("duplicate players"), F.col("changed").alias("changed fields"), F.col("status").alias("review status"), F.col("decision").alias("decision")
    )
    return out.unpivot([], out.columns, "check", "violations")


def require_valid(report: DataFrame) -> None:
    """Raise with every violated check of a (check, violations) report."""
    bad = {r[0]: r[1] for r in report.where("violations > 0").collect()}
    if bad:
        raise ValueError(f"violations: {bad}")
