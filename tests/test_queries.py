"""A few registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.parametrize("name", ["monthly_by_game_type", "player_day", "sequence_features", "risk_segments"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    norm = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted(names) == cols
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_matrix_has_its_actions(spark):
    """The query and its SQL give the text of every cell of the matrix, empty cells included."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    cell = ["Value Segment", "Risk Segment", "Recommended Action", "Players"]
    found = con.execute(entry.oracle_sql()["value_risk_matrix"])
    names = [c[0] for c in found.description]
    want = sorted(tuple(r[names.index(c)] for c in cell) for r in found.fetchall())
    df = entry.queries()["value_risk_matrix"](spark, SF)
    assert sorted(names) == sorted(df.columns) and len(want) == 12 and all(r[2] for r in want)
    assert sorted(tuple(r[c] for c in cell) for r in df.collect()) == want
