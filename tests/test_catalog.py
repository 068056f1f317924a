"""Every query with SQL against DuckDB on the smallest tables; the others by their rows."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from aidlake.plans import catalog  # noqa: E402
from aidlake.sources.tables import NAMES  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
SLOW = {"picture_network", "network_flags", "recovery_boosted", "triage_languages", "rescue_routes", "relief_allocation", "knowledge_communities", "knowledge_levels", "price_network", "haze_autoencoder"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_and_types(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.SQL[name])
    types = {d[0]: str(d[1]) for d in want.description}
    assert {n: TYPES.get(t, t) for n, t in df.dtypes} == types
    names = list(types)
    rows = lambda found, cols: sorted(tuple(plain(r[cols.index(n)]) for n in names) for r in found)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - SLOW))
def test_rows_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(5).collect()


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["pricing_summary"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan and "l_orderkey" not in plan.split("ReadSchema")[-1]


def test_the_large_table_is_joined_after_the_region_is_chosen(spark):
    plan = catalog.QUERIES["nation_revenue"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    depth = {t: next(len(x) - len(x.lstrip(" :+-")) for x in plan.splitlines() if c in x and "Relation" in x) for t, c in (("region", "r_name"), ("lineitem", "l_extendedprice"))}
    assert depth["lineitem"] < depth["region"]
