"""Every registered record query against its SQL in DuckDB, at the smallest size."""

import math

import duckdb
import pytest

from idlattice.plans import inputs
from idlattice.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in inputs.TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def normal(df):
    def one(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("nan", "NaT", "<NA>"):
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return str(bool(x))
        return repr(float(x)) if isinstance(x, (int, float)) or type(x).__name__.startswith(("int", "float")) else str(x)

    return sorted("|".join(map(one, row)) for row in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    mine, theirs = QUERIES[name](spark, DIR).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert normal(mine) == normal(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_inputs_are_whole(spark, duck):
    passports, items = (duck.execute(f"select count(*) from {x}").fetchone()[0] for x in (f"({inputs.SQL['passport_src']}) p", "lineitem"))
    assert inputs.source(spark, DIR, "candidate_src").count() == 3 * passports
    assert inputs.source(spark, DIR, "boxes").count() == items
