"""Every registered query with SQL against DuckDB, on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from tallyhouse.plans import catalog, stored, whole  # noqa: F401  each registers its queries
from tallyhouse.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        out.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return out


def plain(v):
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_splits_add_up(spark):
    rows = QUERIES["cancel_all_splits"](spark, SF).collect()
    for split in {r.split for r in rows}:
        whole = {r.records_used for r in QUERIES[f"cancel_{split}"](spark, SF).collect()}
        assert whole == {sum(r.denominator for r in rows if r.split == split)}
    for r in QUERIES["lead_time_by_month"](spark, SF).collect():
        assert r.numerator == r.band_0 + r.band_1 + r.band_2 + r.band_3 + r.band_4
