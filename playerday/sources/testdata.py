"""The source tables derived from the test schema's orders, lines, customers and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playerday.sources.files import typed
from playerday.sources.schemas import SOURCES

#: The tables of the test schema that are read.
READ = ("orders", "lineitem", "customer", "nation")
_USER = "CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 15 ELSE o_custkey END"


def _day(column: str) -> str:
    """A date folded into one year from 2015-02-01."""
    return f"date_add(DATE'2015-02-01', CAST(datediff(CAST({column} AS DATE), DATE'1995-01-01') % 365 AS INT))"


def load_testdata(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """name -> DataFrame for the eight sources; rows and columns as in SOURCES."""

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    orders = read("orders").withColumn("u", F.expr(_USER))
    play = read("lineitem").join(orders.select("o_orderkey", "u"), F.col("l_orderkey") == F.col("o_orderkey"))
    play = play.withColumn("Wagers", F.expr("CAST(CAST(l_extendedprice AS DECIMAL(18,5)) * (CASE WHEN u % 50 = 7 THEN CAST(0.01 AS DECIMAL(3,2)) ELSE CAST(1 AS DECIMAL(3,2)) END) AS DECIMAL(18,5))"))
    share = "CASE l_linenumber % 4 WHEN 0 THEN CAST(0.0 AS DECIMAL(2,1)) WHEN 1 THEN CAST(0.5 AS DECIMAL(2,1)) WHEN 2 THEN CAST(0.9 AS DECIMAL(2,1)) ELSE CAST(1.8 AS DECIMAL(2,1)) END"
    odds = "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_discount = 0 THEN 0D ELSE 1 + l_discount * 20 END"

    def played(status: str, count: str) -> DataFrame:
        return play.where(F.col("l_linestatus") == status).selectExpr("u AS UserID", f"{_day('l_shipdate')} AS Date", f"CAST(l_quantity AS INT) AS {count}", f"{odds} AS Odds", "Wagers", f"CAST(Wagers * ({share}) AS DECIMAL(18,5)) AS Winnings")

    pay = orders.selectExpr(
        "u AS UserID", "o_orderkey AS id", f"{_day('o_orderdate')} AS Date", "date_format(timestamp_seconds(o_orderkey % 86400), 'HH:mm:ss') AS Time", "o_orderpriority AS PayMeth",
        "CASE o_orderkey % 3 WHEN 0 THEN 'Card' WHEN 1 THEN 'E-wallet' ELSE 'Bank transfer' END AS PayMethCat", "CAST(o_totalprice AS DECIMAL(18,5)) AS Amount",
        "CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'P' AND u % 5 = 3) THEN 'F' ELSE 'S' END AS Status", "o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') AS out",
    )
    tables = {
        "country_reference": read("nation").selectExpr("n_nationkey AS CountryCode", "concat(' ', n_name, ' ') AS Country"),
        "demographics": read("customer").selectExpr("c_custkey AS UserID", "date_add(DATE'1950-01-01', CAST((c_custkey * 7919) % 20075 AS INT)) AS DateOfBirth", "CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 100 < 78 THEN 'M' ELSE 'F' END AS Gender", "c_nationkey AS CountryCode"),
        "games": played("O", "CashGames"),
        "tournaments": played("F", "Tournaments"),
    }
    for name, out, status, key in (("deposits_successful", False, "S", "DepositID"), ("deposits_failed", False, "F", "DepositID"), ("withdrawals_successful", True, "S", "WithdrawalID"), ("withdrawals_failed", True, "F", "WithdrawalID")):
        tables[name] = pay.where((F.col("out") == out) & (F.col("Status") == status)).withColumnRenamed("id", key)
    return {name: typed(df, SOURCES[name]) for name, df in tables.items()}
