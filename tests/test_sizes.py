import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.operators import aggregates as A
from gridloom.plans import catalog
from gridloom.plans import queries as _queries  # noqa: F401


def compared(spark, tmp_path, name, events):
    """A query's and its SQL's rows, over so many events."""
    spark.range(events).select(F.col("id").alias("event_id"), (F.pmod(F.xxhash64("id"), F.lit(20000)) / 100).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    want = duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def test_a_block_that_ends_where_the_box_does(spark, tmp_path):
    """Of 30 cells along an axis, blocks end at 0.3."""
    got, want = compared(spark, tmp_path, "block_regions", 30**3)
    assert got == want


def test_the_middle_of_an_odd_lattice(spark, tmp_path):
    """Of 9 cells along an axis, the middle one is at 0, where there is no radial velocity."""
    got, want = compared(spark, tmp_path, "fields_relative", 9**3)
    at = 4 * 81 + 4 * 9 + 4
    assert [r for r in got if r[0] == at] == [r for r in want if r[0] == at]
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=2e-6)


def test_means_relative_to_a_profile_are_exact(spark):
    """Many equal weights that aren't sums of powers of two: their sum is rounded to one side at each step."""
    cells = spark.range(0, 200000, 1, 1).select(F.lit(0.5).alias("z"), F.lit(0.1).alias("w"), (F.col("id") % 2 + 1).cast("double").alias("f"))
    got = A.relative_to_profile(cells, {"f": F.col("f")}, 0.0, 1.0, 1, F.col("z"), F.col("w")).select("p_f").distinct().collect()
    assert [r.p_f for r in got] == [1.5]
