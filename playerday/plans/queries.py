"""Registered queries over the test schema, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playerday.functions.stats import category_mix
from playerday.operators import activity, features, quality, reports, review, risk, value
from playerday.plans.oracle import CENTROIDS, PREFIX, cast, distance, r, rs
from playerday.sources import files
from playerday.sources.schemas import NUMERIC, PLAYER_DAY, REVIEW, SOURCES, RiskThresholds
from playerday.sources.testdata import READ, load_testdata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LOWERED = RiskThresholds(1000.0, 0.50, 0.50, 500.0, 1.20, 3, 0.30, 0.90, 3, 1.5, 90, 0.80, 0.80, 5)


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Decimals and doubles as doubles rounded to so many digits (money has five), other integers as bigint."""
    out = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        if t.startswith("decimal") or t in ("double", "float"):
            x = F.round(x.cast("double"), digits)
        elif t in ("int", "smallint", "tinyint"):
            x = x.cast("bigint")
        out.append(x.alias(c))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = PREFIX + sql
        return f

    return register


src = load_testdata

#: (application, folder, frame) -> (fingerprint of the files read, frames, their work tables).
_shared: dict[tuple, tuple] = {}


def shared(build: Callable) -> Callable:
    """build(spark, sf), which writes frames, done once for every query that uses them, as long as the files read are the same.

    When a file of the folder's tables is replaced, added or removed, the frames
    are built anew and the old ones removed.
    """

    def get(spark, sf):
        key, now = (spark.sparkContext.applicationId, sf, build.__name__), files.fingerprint(spark, [f"{sf}/{t}.parquet" for t in READ])
        if key in _shared and _shared[key][0] != now:
            files.discard(spark, _shared.pop(key)[2])
        if key not in _shared:
            before = set(files._work)
            made = build(spark, sf)
            _shared[key] = (now, made, [p for p in files._work if p not in before])
        return _shared[key][1]

    return get


def release(spark) -> None:
    """Remove all shared frames; the next query builds what it needs from the tables."""
    while _shared:
        files.discard(spark, _shared.popitem()[1][2])


@shared
def day(spark, sf):
    return files.laid_out(activity.player_day(src(spark, sf)), "day")


@shared
def player_sets(spark, sf):
    return files.written(activity.player_sets(day(spark, sf)), "player-sets")


@shared
def feats(spark, sf):
    return files.written(features.player_features(day(spark, sf)), "features")


@shared
def risks(spark, sf):
    return files.written(risk.risk_segments(feats(spark, sf)), "risk")


@shared
def segs(spark, sf):
    return files.written(value.rfm_scores(risks(spark, sf)), "scores")


@shared
def clusters(spark, sf):
    """Players with cluster and value segment, and the profile of the clusters."""
    return tuple(files.written(df, "clusters") for df in value.kmeans_segments(segs(spark, sf)))


@shared
def scaled(spark, sf):
    return files.written(value.standardize(value.lrfm_features(feats(spark, sf))), "scaled")


# --- sources and their profiles

MONEY = ("DepositAmount", "DepositFailedAmount", "WithdrawalAmount", "WithdrawalFailedAmount")
COUNTS = ("DepositSuccessCount", "DepositFailedCount", "WithdrawalSuccessCount", "WithdrawalFailedCount")

#: By source table: its rows in SQL, key, dates and measures; payments are named by their tag in the detail table.
_STAGING = {
    "country_reference": ("country", "CountryCode", [], []),
    "demographics": ("demo", "UserID", ["DateOfBirth"], []),
    "games": ("games", "UserID", ["Date"], ["Wagers", "Winnings"]),
    "tournaments": ("tournaments", "UserID", ["Date"], ["Wagers", "Winnings"]),
}
for _name, _tag, _kind in (("deposits_successful", "Deposit_Success", "Deposit"), ("deposits_failed", "Deposit_Failed", "Deposit"), ("withdrawals_successful", "Withdrawal_Success", "Withdrawal"), ("withdrawals_failed", "Withdrawal_Failed", "Withdrawal")):
    _rows = f"(SELECT *, ActivityDate AS Date, TransactionID AS {_kind}ID FROM detail WHERE source_table = '{_tag}')"
    _STAGING[_name] = (_rows, "UserID", ["Date"], ["Amount"])


def _sources(t: dict[str, DataFrame]) -> DataFrame:
    one = lambda df, name, measure: df.agg(F.lit(name).alias("source"), F.count("*").alias("n"), (F.sum(measure).cast("double") if measure else F.lit(0.0)).alias("amount"))
    parts = [(t["games"], "games", "Wagers"), (t["tournaments"], "tournaments", "Wagers"), (activity.transaction_detail(t), "payments", "Amount"), (t["demographics"], "demographics", None), (t["country_reference"], "country_reference", None)]
    return reduce(DataFrame.union, [one(*p) for p in parts])


_ONE = "SELECT '{}' AS source, count(*) AS n, {} FROM {}"
query(
    "load_sources",
    " UNION ALL ".join(_ONE.format(name, r(amount, "amount"), rows) for name, amount, rows in (("games", "sum(Wagers)", "games"), ("tournaments", "sum(Wagers)", "tournaments"), ("payments", "sum(Amount)", "detail"), ("demographics", "0", "demo"), ("country_reference", "0", "country"))),
)(lambda s, d: _sources(src(s, d)))


def _staging_sql(name: str) -> str:
    rows, key, dates, measures = _STAGING[name]
    columns = [c.split()[0] for c in SOURCES[name].split(", ")]
    day_of = lambda f, c: f"date_diff('day', DATE '1970-01-01', {f}({c}))"
    facts = {"rows": "count(*)", f"distinct {key}": f"count(DISTINCT {key})"}
    facts |= {f"min {c}": day_of("min", c) for c in dates} | {f"max {c}": day_of("max", c) for c in dates}
    facts |= {f"sum {c}": f"sum({c})::DOUBLE" for c in measures} | {f"avg {c}": f"sum({c})::DOUBLE / count({c})" for c in measures}
    facts |= {f"nulls {c}": f"count(*) FILTER ({c} IS NULL)" for c in columns}
    values = ", ".join(f"({v})::DOUBLE" for v in facts.values())
    return f"SELECT '{name}' AS \"Table\", unnest({list(facts)}) AS Metric, round(unnest([{values}]), 6) AS Value FROM {rows}"


def _staging_profiles(s, d) -> DataFrame:
    tables = src(s, d)
    return reduce(DataFrame.union, [quality.profile(tables[n], n, key, [], dates, measures) for n, (_, key, dates, measures) in _STAGING.items()])


query("profile_staging", " UNION ALL ".join(map(_staging_sql, _STAGING)))(_staging_profiles)


def _summary_sql(name: str) -> str:
    """The exact columns of a summary; means and deviations of numbers at four digits."""
    parts = []
    for c, kind in (x.split() for x in SOURCES[name].split(", ")):
        number = kind != "string" and kind != "date"
        ends = [f"{f}({c})::VARCHAR AS {f}" for f in ("min", "max")] if kind in ("string", "date") or "int" in kind else [f"NULL::VARCHAR AS {f}" for f in ("min", "max")]
        avg, std = (f"round(avg({c}::DOUBLE), 4)", f"round(stddev_samp({c}::DOUBLE), 4)") if number else ("NULL::DOUBLE", "NULL::DOUBLE")
        parts.append(f"SELECT '{c}' AS column_name, {', '.join(ends)}, {avg} AS avg, {std} AS std, count(*) AS count, {r(f'100.0 * count(*) FILTER ({c} IS NULL) / count(*)', 'null_percentage')} FROM {_STAGING[name][0]}")
    return " UNION ALL ".join(parts)


def _summary(name: str) -> Query:
    """The exact columns of the summary, merged from sketches by day of the rows where the table has days; ends of fractions are left out, whose texts engines write in different ways."""

    def run(s, d) -> DataFrame:
        span = F.col("Date") if "Date date" in SOURCES[name] else None
        out = quality.summarize(quality.column_sketches(src(s, d)[name], span))
        whole = ~(F.col("column_type").startswith("decimal") | (F.col("column_type") == "double"))
        ends = [F.when(whole, F.col(c)).alias(c) for c in ("min", "max")]
        return out.select("column_name", *ends, *[F.round(c, 4).alias(c) for c in ("avg", "std")], "count", "null_percentage")

    return run


for _name in SOURCES:
    query(f"summarize_{_name}", _summary_sql(_name))(_summary(_name))

query("freq_gender", "SELECT Gender, count(*) AS RowCount FROM demo GROUP BY 1")(lambda s, d: quality.frequencies(src(s, d)["demographics"], "Gender"))
query("freq_paymethcat", "SELECT source_table, PayMethCat, count(*) AS RowCount, " + r("sum(Amount)", "TotalAmount", 2) + " FROM detail GROUP BY 1, 2")(
    lambda s, d: activity.transaction_detail(src(s, d)).groupBy("source_table", "PayMethCat").agg(F.count("*").alias("RowCount"), F.round(F.sum("Amount"), 2).alias("TotalAmount"))
)
_YEARS = (("birth", "demo", "demographics", "DateOfBirth"), ("games", "games", "games", "Date"), ("tournaments", "tournaments", "tournaments", "Date"))


def _rows_by_year(s, d) -> DataFrame:
    t = src(s, d)
    paid = activity.transaction_detail(t).groupBy(F.col("source_table").alias("source"), F.year("ActivityDate").alias("Year")).agg(F.count("*").alias("RowCount"))
    return reduce(DataFrame.union, [quality.rows_by_year(t[table], c).select(F.lit(n), "*") for n, _, table, c in _YEARS], paid)


query(
    "rows_by_year",
    " UNION ALL ".join(f"SELECT '{n}' AS source, year({c}) AS Year, count(*) AS RowCount FROM {t} GROUP BY 2" for n, t, _, c in _YEARS) + " UNION ALL SELECT source_table, year(ActivityDate), count(*) FROM detail GROUP BY 1, 2",
)(_rows_by_year)
_MOST = "SELECT UserID, count(*) AS RowCount FROM {} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
query("top_active_users", _MOST.format("games"))(lambda s, d: quality.top_active_users(src(s, d)["games"]))
query("top_active_tournament_users", _MOST.format("tournaments"))(lambda s, d: quality.top_active_users(src(s, d)["tournaments"]))

# --- player-days and months

query("player_dimension", "SELECT UserID, DateOfBirth, Gender, CountryCode::BIGINT AS CountryCode, Country FROM dim")(lambda s, d: activity.player_dimension(src(s, d)))
query("game_daily", "SELECT UserID, ActivityDate, " + cast("CashGames") + ", " + rs("CashGameWagers", "CashGameWinnings", "CashGameAvgOdds") + " FROM gd")(lambda s, d: activity.game_daily(src(s, d)))
query("tournament_daily", "SELECT UserID, ActivityDate, " + cast("Tournaments") + ", " + rs("TournamentWagers", "TournamentWinnings", "TournamentAvgOdds") + " FROM td")(lambda s, d: activity.tournament_daily(src(s, d)))
query("transaction_detail", "SELECT UserID, ActivityDate, TransactionID, Time, PayMeth, PayMethCat, " + r("Amount") + ", Status, source_table, transaction_type FROM detail")(lambda s, d: activity.transaction_detail(src(s, d)))
query("transaction_daily", "SELECT UserID, ActivityDate, " + cast("TransactionCount", *COUNTS) + ", " + rs(*MONEY) + " FROM xd")(lambda s, d: activity.transaction_daily(src(s, d)))
query("player_day_spine", "SELECT UserID, ActivityDate FROM spine")(lambda s, d: activity.player_day_spine(src(s, d)))
_PD = "UserID, ActivityDate, Gender, Age::BIGINT AS Age, Country, CountryCode::BIGINT AS CountryCode, " + cast("CashGames", "Tournaments", *COUNTS)
_PD += ", " + rs("CashGameWagers", "CashGameWinnings", "CashGameAvgOdds", "TournamentWagers", "TournamentWinnings", "TournamentAvgOdds", *MONEY)
query("player_day", f"SELECT {_PD} FROM pd")(day)
_CHECKS = ["no rows", "invalid ActivityDate", "invalid UserID", *[f"invalid {c}" for c in NUMERIC], "repeated player-day"]
_BAD = ["0", "count(*) FILTER (ActivityDate IS NULL)", "count(*) FILTER (UserID IS NULL)", *[f"count(*) FILTER ({c} IS NULL)" for c in NUMERIC], "count(*) - count(DISTINCT (UserID, ActivityDate))"]
query("validate_player_day", f"SELECT unnest({_CHECKS}) AS \"check\", unnest([{', '.join(_BAD)}])::BIGINT AS violations FROM pd")(lambda s, d: quality.validate_player_day(day(s, d)))

#: Planted faults: what becomes of a player-day by its player and date, in Spark and in DuckDB.
_FAULT = "(UserID * 31 + day(ActivityDate)) % 97"


def _planted(s, d) -> DataFrame:
    """The player-days as a text sheet in which faults have been planted."""
    fault = F.expr(_FAULT)
    text = day(s, d).withColumn("fault", fault).withColumns({c: F.col(c).cast("string") for c in PLAYER_DAY})
    bad = {c: F.when(F.col("fault") == i, F.lit("n/a")).otherwise(F.col(c)) for i, c in enumerate(("ActivityDate", "Age", "CashGameWagers", "DepositAmount", "WithdrawalFailedCount"))}
    bad["Tournaments"] = F.when(F.col("fault") == 9, F.lit("NaN")).otherwise(F.col("Tournaments"))
    sheet = text.withColumns(bad)
    return sheet.union(sheet.where("fault = 11")).drop("fault")


_PLANTED = {"ActivityDate": 0, "Age": 1, "CashGameWagers": 2, "DepositAmount": 3, "WithdrawalFailedCount": 4, "Tournaments": 9}
_TWICE = "sum(CASE WHEN f = 11 THEN 2 ELSE 1 END) FILTER ({})"
_FOUND = [f"coalesce({_TWICE.format(f'f = {_PLANTED[c]} OR {c} IS NULL' if c in _PLANTED else f'{c} IS NULL')}, 0)" for c in ("ActivityDate", "UserID", *NUMERIC)]
_REPEATED = "count(*) FILTER (f = 11) + (SELECT count(*) FROM (SELECT 1 FROM pd WHERE " + _FAULT + " = 0 GROUP BY UserID HAVING count(*) > 1))"
query(
    "validate_player_day_planted",
    f"SELECT unnest({_CHECKS}) AS \"check\", unnest([0, {', '.join(_FOUND)}, {_REPEATED}])::BIGINT AS violations FROM (SELECT *, {_FAULT} AS f FROM pd)",
)(lambda s, d: quality.validate_player_day(_planted(s, d)))

_SOME = " FROM unpiv WHERE c > 0 OR w > 0 OR v > 0 OR o IS NOT NULL "
query(
    "monthly_by_game_type",
    "SELECT MonthDate, GameType, count(DISTINCT CASE WHEN c > 0 OR w > 0 OR v > 0 THEN UserID END) AS PlayerVolume, " + ", ".join([r("sum(w)", "TotalWagers"), r("sum(v)", "TotalWinnings"), r("avg(CASE WHEN o > 0 THEN o END)", "AverageOdds")]) + _SOME + "GROUP BY MonthDate, GameType",
)(lambda s, d: activity.monthly_by_game_type(day(s, d)))


def _distinct_players(s, d) -> DataFrame:
    """Players by game type in each month, each year and the whole span, all from the stored sets."""
    sets = player_sets(s, d)
    spans = [("month", F.col("MonthDate")), ("year", F.trunc("MonthDate", "year")), ("all", None)]
    return reduce(DataFrame.union, [activity.distinct_players(sets, span).select(F.lit(n).alias("Unit"), "*") for n, span in spans])


_PLAYED = "(SELECT UserID, MonthDate, GameType FROM unpiv WHERE c > 0 OR w > 0 OR v > 0 UNION ALL SELECT UserID, date_trunc('month', ActivityDate)::DATE, 'Any' FROM pd)"
query(
    "distinct_players",
    " UNION ALL ".join(f"SELECT '{n}' AS Unit, {span} AS Span, GameType, count(DISTINCT UserID) AS Players FROM {_PLAYED} GROUP BY ALL" for n, span in (("month", "MonthDate"), ("year", "date_trunc('year', MonthDate)::DATE"), ("all", "NULL::DATE"))),
)(_distinct_players)

# --- features

query("net_gaming", "SELECT UserID, ActivityDate, " + rs("WagerAmount", "WinningAmount", "NetGaming") + " FROM net")(lambda s, d: features.net_gaming(day(s, d)).select("UserID", "ActivityDate", "WagerAmount", "WinningAmount", "NetGaming"))
query("withdrawal_days", "SELECT UserID, ActivityDate, " + r("WithdrawalAmount") + " FROM pd WHERE WithdrawalAmount > 0")(lambda s, d: day(s, d).where("WithdrawalAmount > 0").select("UserID", "ActivityDate", "WithdrawalAmount"))
query("loss_chasing", "SELECT UserID, ActivityDate, " + r("PrevNetGaming") + ", GapDays::BIGINT AS GapDays, ChaseFlag::BIGINT AS ChaseFlag FROM flagged")(
    lambda s, d: features.with_sequence(features.net_gaming(day(s, d))).select("UserID", "ActivityDate", "PrevNetGaming", "GapDays", "ChaseFlag")
)
query("streaks", "SELECT UserID, StreakID::BIGINT AS StreakID, count(*) AS Days FROM flagged GROUP BY ALL")(lambda s, d: features.with_sequence(features.net_gaming(day(s, d))).groupBy("UserID", "StreakID").agg(F.count("*").alias("Days")))
query(
    "sequence_features",
    "SELECT UserID, " + cast("LossChasingDays", "MaxConsecutiveActiveDays", "RecentDepositWithoutEarlierBaseline") + ", " + rs("MaxDailyDeposit", "MaxDailyLoss", "RecentAvgDeposit", "EarlierAvgDeposit", "DepositEscalationRatio") + " FROM seq",
)(lambda s, d: features.sequence_features(day(s, d)))
_F_INT = ("Age", "CountryCode", "CashGames", "Tournaments", *COUNTS, "Frequency", "RecencyDays", "TenureDays", "LossChasingDays", "MaxConsecutiveActiveDays", "RecentDepositWithoutEarlierBaseline", "AgeEligibilityFlag")
_F_DBL = ("CashGameWagers", "CashGameWinnings", "TournamentWagers", "TournamentWinnings", "WagerAmount", "WinningAmount", "NetGaming", "DepositAmount", "WithdrawalAmount", "AvgCashOdds")
_F_DBL += ("MaxDailyDeposit", "MaxDailyLoss", "RecentAvgDeposit", "EarlierAvgDeposit", "DepositEscalationRatio", "ActivityRate", "WithdrawalToDeposit", "Playthrough")
_F_DBL += ("DepositFailedRate", "WithdrawalFailedRate", "FailedTxnRate", "CashGameShare", "TournamentShare", "WagerPerActiveDay", "NetLossPerActiveDay")
_F_TEXT = ("UserID", "FirstActivityDate", "LastActivityDate", "Gender", "Country", "AgeBand")
query("player_features", f"SELECT {', '.join(_F_TEXT)}, " + cast(*_F_INT) + ", " + rs(*_F_DBL) + " FROM pf")(lambda s, d: feats(s, d).select(*_F_TEXT, *_F_INT, *_F_DBL))

# --- risk

_RISK = "SELECT UserID, " + cast(*risk.FLAGS, "AMLRiskScore", "RGRiskScore") + ', "Risk Segment", "Risk Driver" FROM risk'
_risk_columns = ["UserID", *risk.FLAGS, "AMLRiskScore", "RGRiskScore", "Risk Segment", "Risk Driver"]
query("risk_segments", _RISK)(lambda s, d: risks(s, d).select(*_risk_columns))
query("risk_segments_lowered", _RISK + "2")(lambda s, d: risk.risk_segments(feats(s, d), LOWERED).select(*_risk_columns))


def _flag_sql(c: str) -> str:
    mean = lambda x, name: r(f"sum(CASE WHEN {c} = 1 THEN {x} END)::DOUBLE / nullif(sum({c}), 0)", name)
    category = "AML" if c.startswith("AML") else "Responsible Gambling"
    return f"SELECT '{c}' AS Flag, '{category}' AS Category, sum({c})::BIGINT AS PlayersTriggered, {r(f'avg({c})', 'ShareOfPlayers')}, {mean('NetGaming', 'AvgNetGaming')}, {mean('WithdrawalAmount', 'AvgWithdrawalAmount')} FROM risk"


query("risk_flag_summary", " UNION ALL ".join(map(_flag_sql, risk.FLAGS)))(lambda s, d: risk.risk_flag_summary(risks(s, d)))
query("review_queue", 'SELECT UserID, "Risk Segment", "Risk Driver", ' + cast("AMLRiskScore", "RGRiskScore") + " FROM risk WHERE AMLRiskScore > 0 OR RGRiskScore > 0")(lambda s, d: risk.review_queue(risks(s, d)))

# --- value segments

query("rfm_scores", "SELECT UserID, " + cast("RecencyScore", "FrequencyScore", "MonetaryScore", "RFMScore") + ', rfm AS "Value Segment (RFM Score)" FROM seg')(
    lambda s, d: segs(s, d).select("UserID", "RecencyScore", "FrequencyScore", "MonetaryScore", "RFMScore", value.RFM_LABEL)
)
query("rank_correlation", "SELECT " + r("corr(rc, rd)", "RankCorrelation") + " FROM seg")(lambda s, d: reports.rank_correlation(segs(s, d)))
query("lrfm_features", "SELECT UserID, " + rs(*value.LRFM) + " FROM lrfm")(lambda s, d: value.lrfm_features(feats(s, d)))
query("standardize", "SELECT UserID, " + rs(*value.LRFM) + " FROM scaled")(scaled)
_D4 = "list_value(" + ", ".join(distance(m) for m in CENTROIDS) + ")"
_FAR = f"SELECT *, {_D4} AS l FROM scaled"
_NEAREST = "(list_position(l, list_min(l)) - 1)::BIGINT"
query("kmeans_assign", f"SELECT UserID, {_NEAREST} AS KMeansCluster, {r('list_min(l)', 'Distance')} FROM ({_FAR})")(lambda s, d: value.kmeans_assign(scaled(s, d), CENTROIDS).select("UserID", "KMeansCluster", "Distance"))
query("kmeans_update", f"SELECT {_NEAREST} AS KMeansCluster, count(*) AS Players, " + ", ".join(r(f"avg({c})", c) for c in value.LRFM) + f" FROM ({_FAR}) GROUP BY 1")(lambda s, d: value.kmeans_update(scaled(s, d), CENTROIDS)[0])
query("inertia", f"SELECT {r('sum(list_min(l))', 'Inertia', 3)} FROM ({_FAR})")(lambda s, d: value.inertia(scaled(s, d), CENTROIDS).select(F.round("Inertia", 3).alias("Inertia")))
_SAMPLE = f"(SELECT *, list_position(l, list_min(l)) AS c FROM ({_FAR} ORDER BY md5(UserID::VARCHAR), UserID LIMIT 1500))"
_APART = "sqrt(" + " + ".join(f"(p.{c} - q.{c})**2" for c in value.LRFM) + ")"
query(
    "silhouette",
    f"""SELECT round(coalesce(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 0), 6) AS MeanSilhouette FROM (
  SELECT i, max(m) FILTER (ci = cj) AS a, min(m) FILTER (ci <> cj) AS b FROM (
    SELECT p.UserID AS i, p.c AS ci, q.c AS cj, avg({_APART}) AS m FROM {_SAMPLE} p, {_SAMPLE} q WHERE p.UserID <> q.UserID GROUP BY ALL) GROUP BY i)""",
)(lambda s, d: value.silhouette(value.kmeans_assign(value.silhouette_sample(scaled(s, d)), CENTROIDS)))
_MEANS = f"(SELECT {_NEAREST} AS k, {', '.join(f'avg({c}) AS {c}' for c in value.LRFM)} FROM ({_FAR}) GROUP BY 1)"
_MOVES = ", ".join(f"abs({c} - {[m[i] for m in CENTROIDS]}[k + 1])" for i, c in enumerate(value.LRFM))
query("kmeans_shift", f"SELECT {r(f'(SELECT sum(list_min(l)) FROM ({_FAR}))', 'Inertia', 3)}, {r('max(move)', 'Shift')} FROM (SELECT greatest({_MOVES}) AS move FROM {_MEANS})")(
    lambda s, d: value.kmeans_update(scaled(s, d), CENTROIDS)[1].select(F.round("Inertia", 3).alias("Inertia"), "Shift")
)
query(
    "archetypes",
    f"""SELECT k::BIGINT AS KMeansCluster, CASE WHEN count(*) OVER (PARTITION BY t) > 1 THEN t || ' (C' || k || ')' ELSE t END AS "Behaviour Archetype" FROM (SELECT k,
  CASE WHEN Recency < -0.5 THEN 'Active' WHEN Recency > 0.5 THEN 'Lapsed' ELSE 'Cooling' END || ' ' ||
  CASE WHEN Monetary < -0.5 THEN 'Net Winners' WHEN Monetary > 0.5 THEN 'Whales' WHEN Frequency > 0 THEN 'Regulars' ELSE 'Casuals' END AS t FROM {_MEANS})""",
)(lambda s, d: value.archetypes(value.kmeans_update(scaled(s, d), CENTROIDS)[0]).select("KMeansCluster", "Behaviour Archetype"))
query("kmeans_segments")(lambda s, d: clusters(s, d)[0].select("UserID", "KMeansCluster", "Value Segment", "Behaviour Archetype"))
query("cluster_profile")(lambda s, d: clusters(s, d)[1])
query("player_segments")(lambda s, d: reports.player_segments(clusters(s, d)[0]))
query("method_crosstab")(lambda s, d: reports.method_crosstab(clusters(s, d)[0]))
query("method_summary")(lambda s, d: reports.method_summary(clusters(s, d)[0]))
query("kmeans_diagnostics")(lambda s, d: value.kmeans_diagnostics(scaled(s, d)))
_METRICS = {"Players segmented": "count(*)", "High Risk share of players": "avg((\"Risk Segment\" = 'High Risk')::INT)"}
_METRICS |= {f"{v} players": f"count(*) FILTER (rfm = '{v}')" for v in ("Low Value", "Medium Value", "High Value", "Premium")}
_METRICS |= {f"{k} players": f"count(*) FILTER (\"Risk Segment\" = '{k}')" for k in ("Low Risk", "Medium Risk", "High Risk")}
_METRICS["Value / Risk rank correlation"] = "corr(rc, rd)"
query("risk_summary", f"SELECT unnest({list(_METRICS)}) AS Metric, round(unnest([{', '.join(f'({v})::DOUBLE' for v in _METRICS.values())}]), 4) AS Value FROM seg")(lambda s, d: reports.risk_summary(segs(s, d)))

# --- profiles and the matrix

_MEDIANS = ("TenureDays", "RecencyDays", "Frequency", "WagerAmount", "NetGaming", "DepositAmount", "WithdrawalAmount", "WithdrawalToDeposit", "AvgCashOdds", "CashGameShare")
_SHARE = "{0}::DOUBLE / sum({0}) OVER ()::DOUBLE"
_PROFILE_COLUMNS = [
    r("median(Age)", "MedianRecordedAge"),
    r("median(CASE WHEN Age >= 19 THEN Age END)", "MedianAge19Plus"),
    "sum(AgeEligibilityFlag)::BIGINT AS Under19Players",
    *[r(f"median({c}::DOUBLE)", f"Median{c}") for c in _MEDIANS],
    r("quantile_cont(WagerAmount::DOUBLE, 0.9)", "P90WagerAmount"),
    r("sum(WagerAmount)", "TotalWagerAmount"),
    r("sum(NetGaming)", "TotalNetGaming"),
    r("avg(FailedTxnRate)", "AvgFailedTxnRate"),
    r("avg(LossChasingDays)", "AvgLossChasingDays"),
    r(_SHARE.format("count(*)"), "PlayerShare"),
    r("sum(AgeEligibilityFlag)::DOUBLE / count(*)", "Under19Share"),
    r(_SHARE.format("sum(NetGaming)"), "NetGamingShare"),
    r(_SHARE.format("sum(WagerAmount)"), "WagerShare"),
]


def _mix_sql(column: str, top: int) -> str:
    """(g, text) of the shares of a category in each segment {g}."""
    name = f"coalesce({column}, 'Unknown')"
    counts = f"SELECT {{g}} AS g, {name} AS v, count(*) AS n, sum(count(*)) OVER (PARTITION BY {{g}}) AS t, row_number() OVER (PARTITION BY {{g}} ORDER BY count(*) DESC, {name}) AS k FROM seg GROUP BY 1, 2"
    return f"(SELECT g, string_agg(v || ': ' || round_even(100 * (n::DOUBLE / t), 0)::INT || '%', ', ' ORDER BY n DESC, v) AS {column}Mix FROM ({counts}) WHERE k <= {top} GROUP BY g)"


_PROFILE = f"SELECT {{g}} AS Segment, count(*) AS Players, {', '.join(_PROFILE_COLUMNS)} FROM seg GROUP BY 1"
_PROFILE = f"SELECT p.*, AgeBandMix, GenderMix, CountryMix FROM ({_PROFILE}) p JOIN {_mix_sql('AgeBand', 99)} a ON a.g = p.Segment JOIN {_mix_sql('Gender', 99)} b ON b.g = p.Segment JOIN {_mix_sql('Country', 3)} c ON c.g = p.Segment"
query("segment_profile_value", _PROFILE.replace("{g}", "rfm"))(lambda s, d: reports.segment_profile(segs(s, d), value.RFM_LABEL))
query("segment_profile_risk", _PROFILE.replace("{g}", '"Risk Segment"'))(lambda s, d: reports.segment_profile(segs(s, d), "Risk Segment"))
_CELL = [
    "count(UserID) AS Players",
    r("coalesce(sum(NetGaming), 0)", "TotalNetGaming"),
    r("median(NetGaming::DOUBLE)", "MedianNetGaming"),
    r("coalesce(sum(WithdrawalAmount), 0)", "TotalWithdrawalAmount"),
    "count(*) FILTER (AMLRiskScore > 0) AS AMLIndicatorPlayers",
    "count(*) FILTER (RGRiskScore > 0) AS RGIndicatorPlayers",
    "count(*) FILTER (AMLRiskScore >= 3) AS AMLHighPriorityPlayers",
    "count(*) FILTER (RGRiskScore >= 4) AS RGHighPriorityPlayers",
    r("count(UserID)::DOUBLE / sum(count(UserID)) OVER ()", "PlayerShare"),
    r("coalesce(sum(NetGaming), 0)::DOUBLE / sum(sum(NetGaming)) OVER ()::DOUBLE", "NetGamingShare"),
]
_GRID = """(VALUES
  ('Premium', 'High Risk', 'Prioritise manual Compliance and Responsible Gambling review before any targeted promotion; determine action only after case review.'),
  ('Premium', 'Medium Risk', 'Continue service cautiously, monitor the triggered indicators, and review before personalised promotion.'),
  ('Premium', 'Low Risk', 'Consider high-touch retention and personalised service within standard responsible-gambling controls.'),
  ('High Value', 'High Risk', 'Prioritise manual review and pause targeted promotional decisions until the indicators are assessed.'),
  ('High Value', 'Medium Risk', 'Monitor the triggered indicators and use conservative, reviewable retention activity.'),
  ('High Value', 'Low Risk', 'Prioritise for retention and relevant cross-sell testing with normal controls.'),
  ('Medium Value', 'High Risk', 'Route for manual review; avoid automated promotional escalation while indicators remain unresolved.'),
  ('Medium Value', 'Medium Risk', 'Use low-cost lifecycle activity and monitor for movement in the review indicators.'),
  ('Medium Value', 'Low Risk', 'Use scalable reactivation and cross-sell tests, measuring incremental response.'),
  ('Low Value', 'High Risk', 'Route for proportionate manual review; do not infer misconduct from the segment label alone.'),
  ('Low Value', 'Medium Risk', 'Use automated servicing and monitor the specific review indicators.'),
  ('Low Value', 'Low Risk', 'Use low-cost automated reactivation and measure cost per reactivated player.')) g(v, k, act)"""
query("value_risk_matrix", f'SELECT v AS "Value Segment", k AS "Risk Segment", act AS "Recommended Action", {", ".join(_CELL)} FROM {_GRID} LEFT JOIN seg ON rfm = v AND "Risk Segment" = k GROUP BY v, k, act')(
    lambda s, d: reports.value_risk_matrix(segs(s, d))
)


def _mixes(s, d) -> DataFrame:
    df = risks(s, d)
    return reduce(DataFrame.union, [category_mix(df, "Risk Segment", c, top) for c, top in (("Gender", None), ("AgeBand", None), ("Country", 3))])


def _risk_mix_sql(c: str, top: int) -> str:
    name, of = f"coalesce({c}, 'Unknown')", 'PARTITION BY any_value("Risk Segment")'
    share = r(f"count(*)::DOUBLE / sum(count(*)) OVER ({of})", "share")
    counts = f"SELECT \"Risk Segment\" AS segment, '{c}' AS dimension, {name} AS value, count(*) AS players, {share}, row_number() OVER ({of} ORDER BY count(*) DESC, {name}) AS n FROM risk GROUP BY \"Risk Segment\", {name}"
    return f"SELECT segment, dimension, value, players, share FROM ({counts}) WHERE n <= {top}"


query("category_mix", " UNION ALL ".join(_risk_mix_sql(c, top) for c, top in (("Gender", 99), ("AgeBand", 99), ("Country", 3))))(_mixes)
_DAYS = "(SELECT date_diff('day', DATE '1970-01-01', {}(ActivityDate)) FROM pd)::DOUBLE"
_NOTES = {
    "FirstDay": _DAYS.format("min"), "LastDay": _DAYS.format("max"), "Players": "count(*)", "MedianRecencyDays": "median(RecencyDays)", "MinAge": "min(Age)", "MaxAge": "max(Age)", "MedianAge": "median(Age)",
    "Under19Players": "count(*) FILTER (Age < 19)", "TotalTurnover": "sum(WagerAmount)::DOUBLE", "TotalNetGaming": "sum(NetGaming)::DOUBLE", "NetAheadPlayers": "count(*) FILTER (NetGaming < 0)",
    "NeverWithdrew": "count(*) FILTER (WithdrawalAmount = 0)", "NeverDeposited": "count(*) FILTER (DepositAmount = 0)", "ZeroWagerPlayers": "count(*) FILTER (WagerAmount = 0)",
}
query("data_quality_notes", f"SELECT unnest({list(_NOTES)}) AS Topic, round(unnest([{', '.join(f'({v})::DOUBLE' for v in _NOTES.values())}]), 6) AS Value FROM pf")(lambda s, d: reports.data_quality_notes(day(s, d), feats(s, d)))

# --- dashboard

_TOTALS = (("Wagers", "WagerAmount"), ("Winnings", "WinningAmount"), ("NetGaming", "NetGaming"), ("Deposits", "DepositAmount"), ("Withdrawals", "WithdrawalAmount"))
_PER = (("AvgWagerPerPlayer", "sum(WagerAmount)::DOUBLE / count(DISTINCT UserID)"), ("HoldRate", "sum(NetGaming)::DOUBLE / sum(WagerAmount)::DOUBLE"), ("NetGamingPerPlayer", "sum(NetGaming)::DOUBLE / count(DISTINCT UserID)"))
query("kpi_summary", "SELECT count(DISTINCT UserID) AS ActivePlayers, " + ", ".join([*[r(f"sum({c})", n) for n, c in _TOTALS], *[r(e, n) for n, e in _PER]]) + " FROM net")(lambda s, d: reports.kpi_summary(day(s, d), player_sets(s, d)))
_MONTHS = "(SELECT date_trunc('month', ActivityDate)::DATE AS MonthDate, " + ", ".join(f"sum({c})::DOUBLE AS {c}" for c in ("WagerAmount", "WinningAmount", "NetGaming")) + " FROM net GROUP BY 1)"
_CHANGE = [r(f"{c} - lag({c}) OVER (ORDER BY MonthDate)", n) for c, n in (("WagerAmount", "WagerChange"), ("NetGaming", "NetGamingChange"))]
query("monthly_trend", "SELECT MonthDate, " + ", ".join([rs("WagerAmount", "WinningAmount", "NetGaming"), *_CHANGE]) + f" FROM {_MONTHS}")(lambda s, d: reports.monthly_trend(day(s, d)))
query(
    "game_mix_by_year", "SELECT year(MonthDate) AS Year, GameType, " + r("sum(w)", "Wagers") + ", " + r("sum(w)::DOUBLE / sum(sum(w)) OVER (PARTITION BY year(MonthDate))::DOUBLE", "WagerShare") + _SOME + "GROUP BY year(MonthDate), GameType"
)(lambda s, d: reports.game_mix_by_year(day(s, d)))
_BAND = "CASE WHEN Age <= 18 THEN 'Under 19' WHEN Age <= 24 THEN '19-24' WHEN Age <= 34 THEN '25-34' WHEN Age <= 44 THEN '35-44' WHEN Age <= 54 THEN '45-54' WHEN Age <= 64 THEN '55-64' WHEN Age > 64 THEN '65+' END"
_SUMS = ", ".join([r("sum(WagerAmount)", "Wagers"), r("sum(NetGaming)", "NetGaming"), r(_SHARE.format("sum(WagerAmount)"), "WagerShare"), r(_SHARE.format("sum(NetGaming)"), "NetGamingShare")])
_PARTS = {c: f"SELECT '{c}' AS Dimension, coalesce({x}, 'Unknown') AS Value, {_SUMS} FROM net GROUP BY coalesce({x}, 'Unknown')" for c, x in (("Country", "Country"), ("Gender", "Gender"), ("AgeBand", _BAND))}
for _c, _sql in _PARTS.items():
    query(f"contribution_by_{_c.lower()}", _sql)(lambda s, d, c=_c: reports.contribution_by(day(s, d), c))
query("contributions", " UNION ALL ".join([*_PARTS.values(), f"SELECT 'All' AS Dimension, 'All' AS Value, {_SUMS} FROM net"]))(lambda s, d: reports.contributions(day(s, d)))
query("contribution_by_segment", f"SELECT 'Value Segment (RFM Score)' AS Dimension, rfm AS Value, {_SUMS} FROM seg GROUP BY rfm")(lambda s, d: reports.contribution(segs(s, d), value.RFM_LABEL))
_SUCCESS = [r(f"sum({k}SuccessCount)::DOUBLE / nullif(sum({k}SuccessCount) + sum({k}FailedCount), 0)", f"{k}SuccessRate") for k in ("Deposit", "Withdrawal")]
query("payment_success_by_year", "SELECT year(ActivityDate) AS Year, " + ", ".join([*_SUCCESS, *[r(f"sum({k}FailedAmount)", f"{k}FailedAmount") for k in ("Deposit", "Withdrawal")]]) + " FROM pd GROUP BY 1")(lambda s, d: reports.payment_success_by_year(day(s, d)))
_AVERAGES = [r("avg(WagerAmount::DOUBLE)", "AvgWager"), r("avg(DepositAmount::DOUBLE)", "AvgDeposit"), r("avg(Frequency)", "AvgFrequency"), r("sum(NetGaming)", "NetGaming"), r(_SHARE.format("sum(NetGaming)"), "RevenueShare")]
query("segment_kpis", "SELECT rfm AS Segment, count(*) AS Players, " + ", ".join(_AVERAGES) + " FROM seg GROUP BY 1")(lambda s, d: reports.segment_kpis(segs(s, d)))
query("high_risk_by_value", "SELECT rfm AS Segment, count(*) FILTER (\"Risk Segment\" = 'High Risk') AS HighRiskPlayers FROM seg GROUP BY 1")(lambda s, d: reports.high_risk_by_value(segs(s, d)))
query(
    "dim_date",
    "SELECT x::DATE AS Date, year(x) AS Year, quarter(x) AS Quarter, month(x) AS Month, dayofweek(x) + 1 AS DayOfWeek, date_trunc('month', x)::DATE AS MonthDate FROM (SELECT unnest(generate_series(min(ActivityDate)::TIMESTAMP, max(ActivityDate)::TIMESTAMP, INTERVAL 1 DAY)) AS x FROM pd)",
)(lambda s, d: reports.dim_date(day(s, d)))
query("dim_player", 'SELECT dim.UserID, DateOfBirth, dim.Gender, dim.CountryCode::BIGINT AS CountryCode, dim.Country, rfm AS "Value Segment", "Risk Segment" FROM dim LEFT JOIN seg USING (UserID)')(
    lambda s, d: reports.dim_player(activity.player_dimension(src(s, d)), segs(s, d))
)

# --- the review queue

_LATEST = "arg_max({'ActivityDate': ActivityDate, 'Gender': Gender, 'Age': Age, 'Country': Country}, CASE WHEN WithdrawalAmount > 0 THEN ActivityDate END) AS l"
_PAID = ", ".join(f"sum({c}) AS {c}" for c in ("WagerAmount", "WinningAmount", "DepositAmount", "WithdrawalAmount"))
query(
    "top_withdrawers",
    "SELECT l.ActivityDate, UserID, l.Gender, l.Age::BIGINT AS Age, l.Country, " + rs("WagerAmount", "WinningAmount", "DepositAmount", "WithdrawalAmount") + f" FROM (SELECT UserID, {_LATEST}, {_PAID} FROM net GROUP BY UserID HAVING max(net.WithdrawalAmount) > 0 ORDER BY sum(net.WithdrawalAmount) DESC, UserID LIMIT 50)",
)(lambda s, d: review.top_withdrawers(day(s, d)))
_REVIEW = ("ActivityDate", "UserID::VARCHAR", "Gender", "Age", "Country", *[f"round({c}, 6)" for c in ("WagerAmount", "WinningAmount", "DepositAmount", "WithdrawalAmount")], "'To be reviewed'", "''", "''")
query("review_table")(lambda s, d: review.review_table(review.top_withdrawers(day(s, d))))
ORACLES["review_table"] = f"SELECT {', '.join(f'{e} AS \"{c}\"' for e, c in zip(_REVIEW, REVIEW))} FROM ({ORACLES['top_withdrawers']})"


def _returned(s, d) -> DataFrame:
    """Checks of the review table as it would come back with every fifth amount changed and every seventh decision left blank."""
    by = Window.orderBy(F.desc("Withdrawal Amount"), "Player ID")  # fifty rows
    base = review.review_table(review.top_withdrawers(day(s, d))).withColumn("position", F.row_number().over(by))
    at = F.col("position")
    back = base.withColumns({"Decision": F.when(at % 7 == 0, "").otherwise("No Action required"), "Wager Amount": F.col("Wager Amount") + F.when(at % 5 == 0, 1e-3).otherwise(0.0)})
    return review.validate_review(back, base)


query(
    "validate_review",
    "SELECT unnest(['columns', 'row count', 'duplicate players', 'changed fields', 'review status', 'decision']) AS \"check\", unnest([0, 50 - least(50, n), 0, least(50, n) // 5, 0, least(50, n) // 7])::BIGINT AS violations FROM (SELECT count(*) AS n FROM (SELECT UserID FROM pd WHERE WithdrawalAmount > 0 GROUP BY UserID))",
)(_returned)
assert set(ORACLES) <= set(QUERIES) and len(PLAYER_DAY) == 22
