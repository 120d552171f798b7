"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from driftline.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return repr(v) if isinstance(v, float) else str(v)


def rows(names, values):
    return sorted(tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_duckdb(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", ["paper_account", "walk_forward_folds", "calibrated_oof", "coefficient_intervals", "bankroll_monte_carlo", "power_monte_carlo"])
def test_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["support_pattern", "support_conditions", "pattern_variants_sweep", "reclaim_study", "eager_study", "trend_study", "evaluate_gates", "grid_summary", "within_day_permutation"])
def test_has_rows_on_longer_tables(spark, name):
    assert catalogue.queries()[name](spark, SF.replace("0.001", "0.01")).count() > 0


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() > 0
