import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import pairs
from gridloom.plans import catalog
from gridloom.plans import queries as _queries  # noqa: F401


def test_all_pairs_by_blocks(spark, tmp_path):
    """Against the SQL on several blocks with copies, a null velocity, NaN and infinite components; no join makes the pairs one by one."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.3, (700, 9))
    x[600:650] = x[:50]
    rows = [[float(v) for v in r] for r in x]
    rows[5][4], rows[9] = None, None
    rows[11][0], rows[13][5], rows[17][7], rows[19][1] = (float(v) for v in ("nan", "nan", "inf", "inf"))
    spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["sf_anisotropic"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {(r[-1], r[0]): r[1:-1] for r in duckdb.sql(catalog.ORACLE_SQL["sf_anisotropic"]).fetchall()}
    columns = [c[0] for c in duckdb.sql("DESCRIBE " + catalog.ORACLE_SQL["sf_anisotropic"]).fetchall()][1:-1]
    found = {(r.kind, r.bin): tuple(r[c] for c in columns) for r in got.collect()}
    assert found.keys() == want.keys()
    for k, v in want.items():
        assert found[k] == pytest.approx(v, abs=2e-8, nan_ok=True)


@pytest.mark.parametrize("log", [False, True])
def test_weights_and_a_box(spark, log):
    """All pairs by blocks against the pairs one by one: weights, a periodic box, logarithmic bins, ids that are structs and ids that occur twice."""
    rng = np.random.default_rng(4)
    rows = [(n % 290, *(float(v) for v in r)) for n, r in enumerate(rng.random((300, 10)) - 0.5)]
    names = ["vx", "vy", "vz", "bx", "by", "bz"]
    points = spark.createDataFrame(rows, ["n", "x", "y", "z", *names, "w"]).withColumn("id", F.struct("n")).withColumn("w", F.when(F.col("n") % 7 > 0, F.col("w")).otherwise(0.0)).cache()
    args = (points, ("vx", "vy", "vz"), ("bx", "by", "bz"), 0.05, 0.8, 6)
    table = pairs.pair_table(points, names, box=(1.0, 1.0, 1.0))
    whole = {r.bin: r for r in pairs.binned(table, F.col("r"), {"vel": F.sqrt(sum(((F.col(f"{v}_2") - F.col(f"{v}_1")) ** 2 for v in names[:3]), F.lit(0.0)))}, 0.05, 0.8, 6, 3, log=log).collect()}
    got = {r.bin: r for r in pairs.anisotropic(*args, orders=3, log=log, box=(1.0, 1.0, 1.0)).where("kind = 'all'").collect()}
    assert got.keys() == whole.keys()
    for k, r in whole.items():
        assert got[k].n == r.n and (got[k].weight, got[k].vel_1, got[k].vel_3) == pytest.approx((r.weight, r.vel_1, r.vel_3), rel=1e-9)
