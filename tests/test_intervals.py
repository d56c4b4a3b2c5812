import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.operators.intervals import periods_and_gaps

SCHEMA = "track_id long, a long, b long, k string, s string, found string"


def brute(rows):
    out = []
    for t in {r[0] for r in rows if r[0] is not None}:
        own = sorted((a, b) for k, a, b in rows if k == t and a is not None and b is not None and b > a)
        merged = []
        for a, b in own:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(t, "period", a, b) for a, b in merged]
        out += [(t, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(out)


def run(spark, rows, slice_rows=50_000):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return sorted(map(tuple, periods_and_gaps(df, "track_id", "a", "b", slice_rows).collect()))


def test_stated_cases(spark):
    rows = [(1, 0, 10), (1, 10, 20), (1, 5, 7), (1, 30, 40), (1, 30, 40), (1, None, 5), (1, 9, 9), (1, 50, 45), (None, 0, 5), (2, 0, 2**55), (2, -(2**50), -5), (3, 4, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.one_of(st.none(), st.integers(0, 60)), st.one_of(st.none(), st.integers(0, 60))), max_size=60), st.integers(1, 7))
def test_against_brute_force_in_slices(spark, rows, slice_rows):
    assert run(spark, rows, slice_rows) == brute(rows)


@pytest.mark.parametrize("slice_rows", [7, 10_000])
def test_hot_entity(spark, slice_rows):
    rows = [(1, k * 10, k * 10 + (9 if k % 3 else 25)) for k in range(700)] + [(k, 0, 5) for k in range(2, 60)] + [(1, 0, 300)]
    assert run(spark, rows, slice_rows) == brute(rows)


@pytest.mark.parametrize("slice_rows", [50_000, 1])
def test_bounds_up_to_two_to_the_62(spark, slice_rows):
    top = 2**62
    rows = [(1, -top, top), (1, 0, 5), (1, 10**18, 10**18 + 7), (2, -(10**18), 10**18), (2, 10**18, 3 * 10**18), (2, 3 * 10**18 + 4, top), (3, 0, 10**18 + 1), (3, 10**17 + 5, 10**17 + 6)]
    assert run(spark, rows, slice_rows) == brute(rows)


def test_an_outlying_start_does_not_fill_a_slice(spark):
    """Slices are quantiles of the rows, not equal ranges of starts."""
    from shelfmark.operators.intervals import periods

    rows = [(1, k * 10, k * 10 + 5) for k in range(1000)] + [(1, 10**15, 10**15 + 1)]
    assert run(spark, rows, 100) == brute(rows)
    df = spark.createDataFrame(rows, "k long, a long, b long").repartitionByRange(11, "k", "a")
    assert max(df.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 300
    got = periods(spark.createDataFrame([(1, 1, 0, 9, "x"), (1, 2, 9, 12, "x"), (1, 1, 9, 12, "x")], "k int, s int, a int, e int, slice string"), ["k", "s"], "a", "e")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0, 12), (1, 2, 9, 12)]
