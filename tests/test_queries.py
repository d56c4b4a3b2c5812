"""Every query with an oracle against DuckDB on the small tables; every other query runs."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = {k: q for m in entry._MODULES for k, q in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    if hasattr(v, "asDict"):
        return plain(list(v))
    if isinstance(v, dict):
        return plain(list(v.values()))
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in SQL:
        return
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(str([plain(r[k]) for k in at]) for r in cur.fetchall())


def test_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["span_of", "track_id", "found", "from_at", "to_at"] and df.count() > 0
    assert set(SQL) <= set(QUERIES)


def test_partitions_do_not_matter(spark, sf):
    names = ["p4_found", "recording_manifest", "missing_positions", "byte_identity", "band_join"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append([sorted(map(str, CORE[name](spark, sf).collect())) for name in names])
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]


def test_plans(spark, sf):
    """Top-k is one operator, filters and columns reach the scan."""
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "TakeOrderedAndProject" in plan(CORE["part_search_page"](spark, sf))
    p = plan(CORE["jobs_newest"](spark, sf))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in p and "props" not in p
    assert "PythonUDF" not in p and "MapInArrow" not in plan(CORE["exact_duplicates"](spark, sf))
