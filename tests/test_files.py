"""Text sheets, partition overwrite and the checks of a read table."""

import os

import pytest
from pyspark.sql import functions as F

from playerday.operators import activity, quality
from playerday.plans import jobs
from playerday.sources import files
from playerday.sources.schemas import PLAYER_DAY, SOURCES
from playerday.sources.testdata import load_testdata

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sheets(spark, tmp_path_factory):
    """The eight sources as text sheets of one file each."""
    root = str(tmp_path_factory.mktemp("sheets"))
    for name, df in load_testdata(spark, SF).items():
        pdf = df.toPandas()
        pdf.to_csv(f"{root}/{name}.csv", index=False)
    return root


def rewritten(sheets, tmp_path, name, change):
    """A copy of the sheets in which the lines of one are changed."""
    for n in SOURCES:
        with open(f"{sheets}/{n}.csv") as f:
            lines = f.read().splitlines()
        with open(f"{tmp_path}/{n}.csv", "w") as f:
            f.write("\n".join(change(lines) if n == name else lines) + "\n")
    return str(tmp_path)


def test_text_sheets_equal_the_tables(spark, sheets):
    tables = load_testdata(spark, SF)
    for name, df in files.load_sources(spark, sheets, "csv").items():
        assert df.dtypes == tables[name].dtypes
        if name != "country_reference":  # a reader of text trims no blanks either
            assert df.exceptAll(tables[name]).count() == 0 and df.count() == tables[name].count()


def test_rows_that_do_not_fit_are_set_aside(spark, sheets, tmp_path):
    """Bad dates, bad numbers and rows cut short; the good rows stay, in a sheet with columns in another order and one too many."""

    def change(lines):
        head = lines[0].split(",")
        order = [head.index(c) for c in ("Winnings", "UserID", "Date", "CashGames", "Odds", "Wagers")]
        moved = [",".join([*[line.split(",")[i] for i in order], "x"]) for line in lines]
        moved[0] = moved[0][:-1] + "Remark"
        moved[1] = moved[1].replace("2015-", "2015/13/", 1)
        moved[2] = "many" + moved[2]
        moved[3] = "1.0,2"
        return moved

    path = rewritten(sheets, tmp_path, "games", change)
    tables, rejected = files.load_text_sources(spark, path)
    want = load_testdata(spark, SF)["games"].count()
    assert tables["games"].count() == want - 3 and tables["games"].columns == ["UserID", "Date", "CashGames", "Odds", "Wagers", "Winnings"]
    bad = rejected.collect()
    assert {r.table for r in bad} == {"games"} and len(bad) == 3 and any(r.row.startswith("many") for r in bad)
    with pytest.raises(ValueError, match="games"):
        files.load_sources(spark, path, "csv")


def test_missing_column(spark, sheets, tmp_path):
    path = rewritten(sheets, tmp_path, "demographics", lambda lines: [line.rsplit(",", 1)[0] for line in lines])
    with pytest.raises(ValueError, match="CountryCode"):
        files.load_text_sources(spark, path)


def test_job_from_text_sheets(spark, sheets, tmp_path):
    jobs.build_player_day(spark, sheets, str(tmp_path), "csv")
    assert files.read_player_day(spark, f"{tmp_path}/player_day").count() == activity.player_day(load_testdata(spark, SF)).count()


def stamps(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_rerun_of_a_month_leaves_the_others(spark, tmp_path):
    days = files.written(activity.player_day(load_testdata(spark, SF)), "test")
    files.write_player_day(days, f"{tmp_path}/days")
    files.write_monthly(activity.monthly_by_game_type(days), f"{tmp_path}/months", "parquet")
    for folder, write in (("days", lambda some: files.write_player_day(some, f"{tmp_path}/days")), ("months", lambda some: files.write_monthly(activity.monthly_by_game_type(some), f"{tmp_path}/months", "parquet"))):
        before = stamps(f"{tmp_path}/{folder}")
        march = days.where("trunc(ActivityDate, 'month') = '2015-03-01'").withColumn("CashGames", F.lit(1).cast("bigint"))
        write(march)
        after = stamps(f"{tmp_path}/{folder}")
        changed = set(before.items()) ^ set(after.items())
        assert changed and all("Month=2015-03-01" in path for path, _ in changed)
    back = files.read_player_day(spark, f"{tmp_path}/days")
    assert back.count() == days.count() and back.where("ActivityDate BETWEEN '2015-03-01' AND '2015-03-31' AND CashGames <> 1").count() == 0
    assert files.read_player_day(spark, f"{tmp_path}/days", months=["2015-03-01"]).count() == march.count()


@pytest.fixture(scope="module")
def valid(spark):
    """Player-days without a violation."""
    return files.written(activity.player_day(load_testdata(spark, SF)).where("Age IS NOT NULL AND CountryCode IS NOT NULL"), "test")


def scans(spark, work):
    """Jobs that work runs."""
    group = f"count-{id(work)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_load_checks_in_the_pass_that_writes(spark, valid, tmp_path):
    days = valid
    files.write_player_day(days, f"{tmp_path}/days", "csv")
    read = files.read_player_day(spark, f"{tmp_path}/days", "csv")
    loaded = quality.load_player_day(read)
    assert loaded.columns == PLAYER_DAY and dict(loaded.dtypes)["CashGameWagers"] == "decimal(18,5)" and dict(loaded.dtypes)["ActivityDate"] == "date"
    assert loaded.exceptAll(days.select(*[F.col(c).cast(t).alias(c) for c, t in loaded.dtypes])).count() == 0
    assert quality.validate_player_day(read).where("violations > 0").count() == 0

    _, jobs_of_load = scans(spark, lambda: quality.load_player_day(read))
    _, jobs_of_write = scans(spark, lambda: files.laid_out(read.repartition("UserID"), "test"))
    assert jobs_of_load <= jobs_of_write + 1  # no scan for the checks, one look for a first row


@pytest.mark.parametrize(
    ("fault", "found"),
    [
        ("withColumn('ActivityDate', F.when(F.col('UserID') == '7', 'soon').otherwise(F.col('ActivityDate')))", "invalid ActivityDate"),
        ("withColumn('UserID', F.when(F.col('UserID') == '7', 'x').otherwise(F.col('UserID')))", "invalid UserID"),
        ("withColumn('Age', F.when(F.col('UserID') == '7', None).otherwise(F.col('Age')))", "invalid Age"),
        ("withColumn('DepositAmount', F.when(F.col('UserID') == '7', 'NaN').otherwise(F.col('DepositAmount')))", "invalid DepositAmount"),
        ("union(df.where(F.col('UserID') == '7'))", "repeated player-day"),
        ("limit(0)", "no rows"),
        ("drop('Country')", "missing column Country"),
    ],
)
def test_load_raises_every_violation(spark, valid, fault, found):
    df = valid.select(*[F.col(c).cast("string").alias(c) for c in PLAYER_DAY])
    bad = eval(f"df.{fault}", {"df": df, "F": F})
    before = set(files._work)
    with pytest.raises(ValueError, match=found):
        quality.load_player_day(bad)
    assert set(files._work) == before  # the table goes when it is not valid
