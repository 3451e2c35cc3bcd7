import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.fields import Fields
from gridloom.operators import aggregates as A
from gridloom.operators import lattice as L
from gridloom.operators import spectral, surface
from gridloom.snapshot import Series, Snapshot
from gridloom.sources.meshbin import MeshBinSource, write_meshbin
from gridloom.sources.particles import ParticleSource, read_vtk, write_particles


def cube(spark, n, value):
    c = spark.range(n**3).select(F.expr(f"int(id div {n * n})").alias("k"), F.expr(f"int((id div {n}) % {n})").alias("j"), F.expr(f"int(id % {n})").alias("i"))
    at = {a: (F.col(b) + 0.5) / n for a, b in L.AXES.items()}
    return c.withColumn("f", value(at))


def test_parseval_and_two_waves(spark):
    n = 16
    cells = cube(spark, n, lambda at: 1 + 0.3 * F.sin(2 * math.pi * 3 * at["x"]) + 0.4 * F.cos(2 * math.pi * 7 * at["z"]))
    modes = spectral.transform(cells, "f", (n, n, n)).withColumn("p", F.col("re") ** 2 + F.col("im") ** 2)
    total = modes.agg(F.sum("p")).first()[0]
    assert total == pytest.approx(cells.agg(F.sum(F.col("f") ** 2)).first()[0], rel=1e-10)
    varying = modes.where("kz + ky + kx > 0").agg(F.sum("p")).first()[0] / n**3
    assert varying == pytest.approx(0.125, rel=1e-9)


def test_spectrum_splits_into_comp_and_sol(spark):
    n = 8
    cells = cube(spark, n, lambda at: F.sin(2 * math.pi * at["x"])).withColumn("g", F.col("f") * 0)
    got = spectral.spectrum_helmholtz(cells, ("f", "g", "g"), (n, n, n), (1.0, 1.0, 1.0), 9).agg(F.sum("comp"), F.sum("sol")).first()
    assert got[0] == pytest.approx(n**3 / 2) and got[1] == pytest.approx(0, abs=1e-9)


def test_gradient_of_a_wave(spark):
    n = 32
    cells = cube(spark, n, lambda at: F.sin(2 * math.pi * at["x"]))
    got = L.gradient(cells, "f", dict.fromkeys("xyz", 1 / n)).select("i", "df_dx", "df_dy").collect()
    for r in got[:200]:
        assert r.df_dx == pytest.approx(2 * math.pi * math.cos(2 * math.pi * (r.i + 0.5) / n), abs=0.06) and r.df_dy == pytest.approx(0, abs=1e-9)


def test_area_of_plane_and_sphere(spark):
    n = 16
    plane = cube(spark, n, lambda at: at["z"])
    assert surface.isosurface_area(plane, "f", 0.5, (n, n, n), (1 / n,) * 3, periodic=(False, True, True)).first()[0] == pytest.approx(1.0)
    ball = cube(spark, n, lambda at: F.sqrt(sum(((at[a] - 0.5) ** 2 for a in "xyz"), F.lit(0.0))))
    assert surface.isosurface_area(ball, "f", 0.3, (n, n, n), (1 / n,) * 3).first()[0] == pytest.approx(4 * math.pi * 0.09, rel=0.03)


def test_fields():
    mesh = [f"{c}{n}{m}" for c, ms in (("x", ("min", "max")), ("nx", ("",))) for n in (1, 2, 3) for m in ms]
    f = Fields(["k", "j", "i", "dens", "eint", "velx", "vely", "velz", *mesh])
    assert f.sql("mass") and "bcc1" not in f.sql("etot")
    with pytest.raises(ValueError):
        f.sql("nothing")
    f.register("double", "dens * 2.0e0")
    assert f.sql("double") == "(dens) * 2.0e0"
    assert len(f.formulas) > 150


def test_calc_rejects_and_cleans(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("nan"), 1.0), (None, 1.0), (3.0, 0.0)], "v double, w double")
    assert A.calc(df, {"v": F.col("v")}, "sum", F.col("w")).first()[0] == 1.0
    assert A.calc(df.limit(0), {"v": F.col("v")}, "average").first()[0] == 0.0
    with pytest.raises(ValueError):
        A.calc(df, {"v": F.col("v")}, "median")
    with pytest.raises(ValueError):
        A.extrema(df.limit(0), F.col("v"))


def test_meshbin_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    header = "<mesh>\nnghost = 2 # ghosts\nnx1 = 8\n<meshblock>\nnx1 = 4\nnx2 = 4\nnx3 = 4\n<hydro>\ngamma = 1.4\neos = adiabatic\n"
    blocks = [{"logical": (b, 0, 0, 0), "geometry": (b / 2, b / 2 + 0.5, 0, 1, 0, 1), "data": {v: rng.random((4, 4, 4)) for v in ("dens", "eint", "velx", "vely", "velz")}} for b in range(2)]
    for n in (0, 1):
        write_meshbin(f"{tmp_path}/run.{n:05d}.bin", blocks, list(blocks[0]["data"]), header, ghosts=2)
    series = Series(spark, str(tmp_path), "run")
    snap = series(0)
    assert snap is series(0) and snap.fields.parameters["gamma"] == 1.4
    got = {(r.mb, r.k, r.j, r.i): r.dens for r in snap.cells.collect()}
    assert len(got) == 128 and got[1, 2, 3, 0] == blocks[1]["data"]["dens"][2, 3, 0]
    mass = snap.cells.agg(F.sum(snap.col("mass"))).first()[0]
    assert mass == pytest.approx(sum(b["data"]["dens"].sum() for b in blocks) / 128)
    assert series.cells([0, 1]).groupBy("snapshot").count().count() == 2
    with pytest.raises(ValueError):
        Snapshot.load(spark, "cells.pkl")
    spark.dataSource.register(MeshBinSource)
    assert spark.read.format("meshbin").option("blocks_per_partition", 1).load(f"{tmp_path}/run.00000.bin").rdd.getNumPartitions() == 2


def test_particles_round_trip(spark, tmp_path):
    n, rng = 25, np.random.default_rng(2)
    reals = {c: rng.random(n) * 2 - 0.5 for c in ("x", "y", "z")}
    write_particles(f"{tmp_path}/p.bin", reals, {"gid": np.zeros(n), "tag": np.arange(n)}, {"dens": rng.random(n)})
    spark.dataSource.register(ParticleSource)
    rows = spark.read.format("particlebin").option("rows_per_partition", 10).load(f"{tmp_path}/p.bin").orderBy("tag").collect()
    assert [r.x for r in rows] == reals["x"].tolist() and len(rows) == n
    few = spark.read.format("particlebin").option("columns", "x,z").load(f"{tmp_path}/p.bin")
    assert few.columns == ["x", "z"]
    counts = L.deposit(few, {"i": (F.col("x"), 0.0, 1.0, 4)}, normalize=False).collect()
    want = np.histogram(np.mod(reals["x"], 1.0), 4, (0, 1))[0]
    assert {r.i: r.density for r in counts} == dict(enumerate(want.tolist()))
    points = rng.random((n, 3)).astype(">f4")
    with open(f"{tmp_path}/p.vtk", "wb") as f:
        f.write(b"# vtk DataFile Version 2.0\ntitle\nBINARY\nDATASET UNSTRUCTURED_GRID\ntime 0.5\ncycle 3\n" + f"POINTS {n} float\n".encode() + points.tobytes() + f"\nPOINT_DATA {n}\nSCALARS gid int\nLOOKUP_TABLE default\n".encode() + np.zeros(n, ">i4").tobytes() + b"\nSCALARS ptag int\nLOOKUP_TABLE default\n" + np.arange(n).astype(">i4").tobytes())
    assert sorted(r.tag for r in read_vtk(spark, f"{tmp_path}/p.vtk").collect()) == list(range(n))


def test_neighbours_across_levels(spark):
    rows = [(0, 0, 0, 0, 0)] + [(1 + n, 2 + (n & 1), n >> 1 & 1, n >> 2, 1) for n in range(8)]
    blocks = spark.createDataFrame(rows, "mb int, lx1 int, lx2 int, lx3 int, level int")
    got = {}
    for r in L.neighbour_blocks(blocks, (2, 1, 1), periodic=False).collect():
        got.setdefault((r.mb, r.direction), set()).add(r.neighbour)
    assert got[0, "+1"] == {1, 3, 5, 7} and got[1, "-1"] == {0} and got[1, "+1"] == {2}
