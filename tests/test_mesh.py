import math
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.fields import Fields
from gridloom.functions.units import ATOMIC_MASS, BOLTZMANN, Units
from gridloom.operators import aggregates as A
from gridloom.operators import lattice as L
from gridloom.operators import mesh as M
from gridloom.operators import pairs, spectral, surface
from gridloom.snapshot import Snapshot
from gridloom.sources.meshbin import write_meshbin
from gridloom.sources.particles import write_particles

NAMES = ["dens", "eint", "velx", "vely", "velz", "bcc1", "bcc2", "bcc3"]


def header(n, bc=("periodic", "periodic", "outflow")):
    return "<mesh>\nnghost = 2\n" + "".join(f"nx{d} = {n}\nx{d}min = -0.5\nx{d}max = 0.5\nix{d}_bc = {bc[d - 1]}\n" for d in (1, 2, 3)) + "<meshblock>\nnx1 = 4\nnx2 = 4\nnx3 = 4\n<mhd>\ngamma = 1.4\neos = adiabatic\n"


def write(path, data, n, text=None):
    m = n // 4
    blocks = [{"logical": (x, y, z, 0), "geometry": [e for a in (x, y, z) for e in (a / m - 0.5, (a + 1) / m - 0.5)], "data": {v: d[4 * z : 4 * z + 4, 4 * y : 4 * y + 4, 4 * x : 4 * x + 4] for v, d in data.items()}} for z in range(m) for y in range(m) for x in range(m)]
    write_meshbin(path, blocks, list(data), text or header(n))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    return {v: rng.random((8, 8, 8)) + 0.5 for v in NAMES}


@pytest.fixture(scope="module")
def snap(spark, data, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('mesh')}/run.00000.bin"
    write(path, data, 8)
    return Snapshot.load(spark, path)


def partials(d):
    wrapped = [(np.roll(d, -1, a) - np.roll(d, 1, a)) / (2 / 8) for a in (2, 1)]
    return {"x": wrapped[0], "y": wrapped[1]}


@pytest.mark.parametrize("order", [1, 2])
def test_gradient_across_blocks(snap, data, order):
    got = snap.gradient("dens", edge_order=order).toPandas()
    want = partials(data["dens"]) | {"z": np.gradient(data["dens"], 1 / 8, axis=0, edge_order=order)}
    for a in "xyz":
        assert np.allclose(got[f"ddens_d{a}"], want[a][got.gk, got.gj, got.gi], rtol=1e-10, atol=1e-12)


def test_divergence_curl_and_current(snap, data):
    z = lambda v: np.gradient(data[v], 1 / 8, axis=0)
    d = snap.divergence(("velx", "vely", "velz")).toPandas()
    assert np.allclose(d["div"], (partials(data["velx"])["x"] + partials(data["vely"])["y"] + z("velz"))[d.gk, d.gj, d.gi])
    c = snap.curl(("bcc1", "bcc2", "bcc3")).toPandas()
    b = {v: partials(data[v]) | {"z": z(v)} for v in ("bcc1", "bcc2", "bcc3")}
    want = [b["bcc3"]["y"] - b["bcc2"]["z"], b["bcc1"]["z"] - b["bcc3"]["x"], b["bcc2"]["x"] - b["bcc1"]["y"]]
    for a, w in zip("xyz", want, strict=True):
        assert np.allclose(c[f"curl_{a}"], w[c.gk, c.gj, c.gi])
    t = snap.table(["cur"]).agg(F.sum("cur")).first()[0]
    assert t == pytest.approx(np.sqrt(sum(w**2 for w in want)).sum() * snap.fields.parameters["c_code"], rel=1e-9)


def mixed(spark):
    """Root of 8^3 cells in blocks of 4: the block at the origin is refined into eight."""
    rows = []
    for z in range(2):
        for y in range(2):
            for x in range(2):
                rows += [(x, y, z, 0)] if (x, y, z) != (0, 0, 0) else [(a, b, c, 1) for c in range(2) for b in range(2) for a in range(2)]
    cells = []
    for mb, (x, y, z, level) in enumerate(rows):
        w = 0.5 / 2**level
        ends = [e for a in (x, y, z) for e in (a * w, (a + 1) * w)]
        cells += [(mb, k, j, i, x, y, z, level, *ends) for k in range(4) for j in range(4) for i in range(4)]
    names = "mb int, k int, j int, i int, lx1 int, lx2 int, lx3 int, level int, " + ", ".join(f"x{n}{m} double" for n in (1, 2, 3) for m in ("min", "max"))
    df = spark.createDataFrame(cells, names).withColumn("f", F.expr("x1min + (x1max - x1min) * (i + 0.5) / 4 + 2 * (x2min + (x2max - x2min) * (j + 0.5) / 4)"))
    return Snapshot(df, None, **{f"nx{n}": 4 for n in (1, 2, 3)}, **{f"Nx{n}": 8 for n in (1, 2, 3)})


def test_levels(spark):
    snap = mixed(spark)
    assert snap.levels() == [0, 1] and snap.cells.count() == 15 * 64
    g = snap.gradient("f").toPandas()
    assert len(g) == 15 * 64
    # away from where levels meet (the planes at 0.5 within the first octant's faces) a linear field's slope is exact
    inner = g[(g.level == 0) & ((g.gi < 3) | (g.gi > 4)) & ((g.gj < 3) | (g.gj > 4)) & ((g.gk < 3) | (g.gk > 4)) | (g.level == 1) & (g.gi < 7) & (g.gj < 7) & (g.gk < 7)]
    assert np.allclose(inner.df_dx, 1) and np.allclose(inner.df_dy, 2) and np.allclose(inner.df_dz, 0) and len(inner) > 500
    # there the neighbour's value is taken as it is, of a centre that is up to a quarter of a coarse cell aside: first order
    assert g.df_dx.between(0, 2).all() and g.df_dy.between(0.5, 3.5).all() and g.df_dz.abs().max() <= 0.75
    root = snap.lattice(["f"]).toPandas()
    assert len(root) == 512 and np.allclose(root.f, (root.i + 0.5) / 8 + 2 * (root.j + 0.5) / 8)
    fine = snap.lattice(["f"], 1).toPandas()
    assert len(fine) == 4096 and np.allclose(fine[(fine.k < 8) & (fine.j < 8) & (fine.i < 8)].f, ((fine.i + 0.5) / 16 + (fine.j + 0.5) / 8)[(fine.k < 8) & (fine.j < 8) & (fine.i < 8)])
    box = snap.lattice(["f"], 0, [0.0, 0.5, 0.25, 0.5, 0.0, 0.125])
    assert box.count() == 4 * 2 * 1


def test_profile_relative(snap, data):
    t = snap.table(["nrho", "nvelx", "eflxwave"]).toPandas()
    z = M.with_global(snap.cells, (4, 4, 4)).select("mb", "k", "j", "i", "gk").toPandas().set_index(["mb", "k", "j", "i"]).loc[list(zip(t.mb, t.k, t.j, t.i, strict=True))]["gk"].to_numpy()
    assert np.allclose(t.nrho, t.dens / data["dens"].mean((1, 2))[z]) and np.allclose(t.nvelx, t.velx - data["velx"].mean((1, 2))[z])
    assert t.eflxwave.abs().sum() > 0
    with pytest.raises(ValueError):
        snap.col("nrho")
    with pytest.raises(ValueError):
        snap.table(["nothing"])
    r = snap.table(["rand", "R"]).agg(F.min("rand"), F.max("rand"), F.count("R")).first()
    assert 0 <= r[0] < r[1] < 1 and r[2] == 512


def test_units():
    u = Units(3.0, 5.0, 7.0)
    rho, n = 5.0 / 27, 5.0 / 27 / 0.618 / ATOMIC_MASS
    p = 5.0 / (3.0 * 49)
    assert u.density_cgs == pytest.approx(rho) and u.pressure_cgs == pytest.approx(p) and u.number_density_cgs == pytest.approx(n)
    assert u.heating_cgs == pytest.approx(p / 7 / n) and u.cooling_cgs == pytest.approx(p / 7 / n**2)
    assert u.temperature_cgs == pytest.approx((3 / 7) ** 2 * 0.618 * ATOMIC_MASS / BOLTZMANN)
    assert u.conductivity_cgs == pytest.approx(p * (3 / 7) * 3 / u.temperature_cgs) and u.entropy_kevcm2 == pytest.approx(p / 1.60218e-9 / n ** (5 / 3))
    with pytest.raises(AttributeError):
        u.nothing


def test_select_is_the_single_expressions(snap):
    names = ["etot", "velr", "mach", "amtot", "Trangebool", "beta_mw", "r_sol"]
    f = Fields(snap.cells.columns, mhd=True, parameters=snap.fields.parameters)
    many = f.select(snap.cells, names)
    both = many.select(*[F.col(n).alias(f"a_{n}") for n in names], *[f(n).alias(f"b_{n}") for n in names]).toPandas()
    assert all(np.allclose(both[f"a_{n}"], both[f"b_{n}"], equal_nan=True) for n in names) and many.columns == snap.cells.columns + names


def test_facades(spark, snap, data, tmp_path):
    d = snap.dist(["dens"], bins=20)["dens"]
    x = np.log10(data["dens"])
    want, _ = np.histogram(x, 20, density=True)
    assert np.allclose([r.dat for r in d.orderBy("bin").collect()], want)
    m = snap.results["dist_dens_moments"].first()
    assert m.mean == pytest.approx(x.mean(), abs=0.02)
    assert snap.dist(["dens"])["dens"] is d
    h = snap.dist2d(("dens", "eint"), scales="", bins=[3, 4]).orderBy("bx", "by").collect()
    want, _, _ = np.histogram2d(data["dens"].ravel(), data["eint"].ravel(), (3, 4), density=True)
    assert np.allclose([r.dat for r in h], want.ravel())
    p = snap.profile(["dens"]).orderBy("bin").collect()
    assert np.allclose([r.dens for r in p], data["dens"].mean((1, 2)))
    assert sum(r.norm for r in snap.radial(["dens", "mdot"], bins=5).collect()) == pytest.approx(1 - 8 / 512)  # the middle eight are nearer than a cell
    lo, hi = snap.extrema(["dens"], scales="log10", vert_range=(-0.3, 0.3))
    assert lo[0] == pytest.approx(x[2:6].min()) and hi[0] == pytest.approx(x[2:6].max())
    stack = snap.projection_stack("dens", weights="dens")
    got = stack["z"].toPandas()
    want = (data["dens"] ** 2).sum(0) / data["dens"].sum(0)
    assert set(stack) == set("xyz") and np.allclose(got.value, want[got.py, got.px])
    s = snap.slice("dens", xyz=[-0.5, 0.5, -0.5, 0.5, 0.0, 0.25]).toPandas()
    assert np.allclose(s.dens, data["dens"][4:6].mean(0)[s.j, s.i])
    at = snap.slice_coord(xyz=[-0.5, 0.5, -0.5, 0.5, 0.0, 0.25]).toPandas()
    assert len(at) == 64 and np.allclose(at.z, 0.125) and np.allclose(at.x, (at.i + 0.5) / 8 - 0.5)
    for r in (snap.sf(["dens"], bins=4), snap.sf_helmholtz(bins=4), snap.sf_aniso(bins=4), snap.spectrum("dens", bins=5), snap.spectrum_helmholtz(bins=5)):
        assert r.count() > 0
    few = snap.sf(["dens"], bins=4, sample=0.25, redo=True).agg(F.sum("n")).first()[0]
    assert 0.15 < few / (512 * 511 / 2) < 0.35
    near = snap.sf_aniso(bins=4, sample=0.01, redo=True).where("kind = 'all'").agg(F.sum("n")).first()[0]
    assert near > 2 * 0.01 * 512 * 511 / 2  # 0.01 is every pair of a block, 0.16 of those across a face
    several = snap.sf(["dens"], weights=["dens", "ones"], bins=3, redo=True)
    assert {r.weighting for r in several.collect()} == {"dens", "ones"}
    snap.results = {k: v for k, v in snap.results.items() if k.startswith(("dist_", "profile"))}
    snap.save(f"{tmp_path}/run.00007.results")
    write(f"{tmp_path}/run.00007.bin", data, 8)
    both = Snapshot.load_both(spark, str(tmp_path), 7, "run")
    assert both.results["dist_dens"].count() == 20 and both.cells.count() == 512
    assert Snapshot.load_both(spark, str(tmp_path), 7, "run").blocks().count() == 8
    with pytest.raises(FileNotFoundError, match="00008"):
        Snapshot.load_both(spark, str(tmp_path), 8, "run")


@pytest.mark.parametrize("count", [(4, 4, 4), (1, 2, 5)])
def test_pairs_of_nearby_regions_are_drawn_more_often(spark, count):
    """Shares by kind against their definition, no pair twice, nearby ones whole where the share is 1, and means that stand for all pairs."""
    rng = np.random.default_rng(5)
    region, periodic, names = rng.integers(0, count, (500, 3)), (True, True, False), ("x", "y", "z")
    x = (region + rng.random((500, 3))) / count
    rows = [(k, *v.tolist(), 0.0 if k == 9 else 1.0, *r.tolist()) for k, (v, r) in enumerate(zip(x, region, strict=True))]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double, w double, region_x int, region_y int, region_z int")
    table = pairs.pair_table(points, [], sample=0.1, regions=count, periodic=periodic)
    got = {(r.id_1, r.id_2): r.share for r in table.select("id_1", "id_2", "share").collect()}
    assert len(got) == table.count()
    a, b = np.triu_indices(500, 1)
    a, b = a[(a != 9) & (b != 9)], b[(a != 9) & (b != 9)]
    d = np.abs(region[a] - region[b])
    d = np.where(periodic, np.minimum(d, np.array(count) - d), d)
    share = np.where(d.max(1) > 1, 0.1, np.array([1.0, 1.0, 0.5, 0.2])[np.minimum(d, 1).sum(1)])
    want = {(int(p), int(q)): s for p, q, s in zip(a, b, share, strict=True)}
    assert all(want[k] == s for k, s in got.items()) and all(k in got for k, s in want.items() if s == 1.0)
    for s in (0.5, 0.2, 0.1):
        n = sum(v == s for v in want.values())
        assert n < 500 or sum(v == s for v in got.values()) == pytest.approx(s * n, rel=0.25)
    r = np.sqrt(((x[a] - x[b]) ** 2).sum(1))
    one = pairs.binned(table, F.lit(0.5), {"r": F.col("r")}, 0.0, 1.0, 1).first()
    assert one.n == len(got) and one.r_1 == pytest.approx(r.mean(), rel=0.05)


def test_block_regions(snap):
    regions = {r.region for r in M.box_class(snap.blocks(), [-0.5, 0.0, -0.5, 0.25, -0.5, 0.5]).collect()}
    assert regions == {"inside", "partial"}
    assert [r.at for r in M.faces(snap.cells.sparkSession, 0.0, 1.0, 4).orderBy("face").collect()] == [0, 0.25, 0.5, 0.75, 1]


def cube(spark, n, value):
    c = spark.range(n**3).select(F.expr(f"int(id div {n * n})").alias("k"), F.expr(f"int((id div {n}) % {n})").alias("j"), F.expr(f"int(id % {n})").alias("i"))
    at = {a: (F.col(b) + 0.5) / n for a, b in L.AXES.items()}
    return c.withColumn("f", value(at))


def ball(at):
    return F.sqrt(sum(((at[a] - 0.5) ** 2 for a in "xyz"), F.lit(0.0)))


def test_areas(spark, monkeypatch):
    n, s = 24, (1 / 24,) * 3
    cells = cube(spark, n, ball)
    whole = surface.isosurface_area(cells, "f", 0.3, (n,) * 3, s).first()[0]
    assert whole == pytest.approx(4 * math.pi * 0.09, rel=0.02)
    monkeypatch.setattr(surface, "TILE", 5)  # tiles of any size give the same
    assert surface.isosurface_area(cells, "f", 0.3, (n,) * 3, s).first()[0] == pytest.approx(whole, rel=1e-12)
    smooth = surface.smoothed_area(cells, F.col("f") <= 0.3, (n,) * 3, s).first()[0]
    assert smooth == pytest.approx(whole, rel=0.1)
    monkeypatch.setattr(surface, "TILE", 32)
    assert surface.smoothed_area(cells, F.col("f") <= 0.3, (n,) * 3, s).first()[0] == pytest.approx(smooth, rel=1e-9)
    assert surface.offset_area(cells, "f", 0.3, (n,) * 3, s, step=2).first()[0] == pytest.approx(whole, rel=0.05)
    with pytest.raises(ValueError):
        surface.isosurface_area(cells, "f", 0.3, (n,) * 3, s, step=5)
    plane = cube(spark, 16, lambda at: F.when(at["z"] < 0.5, 0.0).otherwise(1.0))
    for area in (surface.isosurface_area(plane, "f", 0.5, (16,) * 3, (1 / 16,) * 3, (False, True, True)), surface.smoothed_area(plane, F.col("f") > 0.5, (16,) * 3, (1 / 16,) * 3, (False, True, True))):
        assert area.first()[0] == pytest.approx(1.0, rel=1e-9)


def test_area_facade(spark, tmp_path):
    z, y, x = np.indices((8, 8, 8))
    data = dict.fromkeys(NAMES, np.ones((8, 8, 8))) | {"eint": np.where(z < 4, 1.0, 100.0)}
    write(f"{tmp_path}/run.bin", data, 8)
    snap = Snapshot.load(spark, f"{tmp_path}/run.bin")
    got = {r.step: r.area for r in snap.area(4.0, steps=(1, 2)).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == pytest.approx(1.0)
    assert snap.area(4.0, steps=(1,), method="smoothed").first().area == pytest.approx(1.0)
    levels = surface.interface_levels(snap.cells, 0.4 * F.avg("eint") / F.avg("dens"), 0.4, 0).collect()
    assert [r.x3min for r in levels] == [-0.5]
    with pytest.raises(ValueError):
        snap.area(float("nan"))


def test_spectrum_options(spark):
    n = 16
    cells = cube(spark, n, lambda at: 1 + 0.3 * F.sin(2 * math.pi * 3 * at["x"]) + 0.4 * F.cos(2 * math.pi * 7 * at["z"])).cache()
    box = (1.0,) * 3
    log = spectral.spectrum(cells, "f", (n,) * 3, box, 12, log=True).toPandas()
    assert log["power"].sum() / n**3 == pytest.approx(0.125, rel=1e-9)  # the mean has no logarithm
    a = cells.toPandas().sort_values(["k", "j", "i"]).f.to_numpy().reshape(n, n, n)[2:-2]
    w = np.hamming(12)
    w /= np.sqrt((w * w).mean())
    want = (np.abs(np.fft.fftn(a * w[:, None, None])) ** 2).sum() / a.size
    got = spectral.spectrum(cells, "f", (n,) * 3, box, 200, crop=2, window=True).agg(F.sum("power")).first()[0]
    assert got == pytest.approx(want, rel=0.35) and got <= want * (1 + 1e-9)  # corners beyond the last shell don't count
    weighted = spectral.spectrum(cells.withColumn("w", F.lit(1.0)), "f", (n,) * 3, box, 9, weight="w").toPandas()
    assert weighted["power"].sum() == pytest.approx(n**3 * n**3, rel=1e-6)  # the weight's power is its mean's


def test_blur_and_windows(spark):
    rng = np.random.default_rng(5)
    image = rng.random((9, 7))
    df = spark.createDataFrame([(x, y, float(image[x, y])) for x in range(9) for y in range(7)], "px int, py int, value double")
    got = {(r.px, r.py): r.value for r in A.blurred(df, (9, 7), 0.8).collect()}
    k = np.exp(-0.5 * (np.arange(-3, 4) / 0.8) ** 2)
    k /= k.sum()
    want = image
    for axis in (0, 1):
        pad = [(3, 3) if a == axis else (0, 0) for a in (0, 1)]
        want = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, np.pad(want, pad, mode="symmetric"))
    assert all(got[x, y] == pytest.approx(want[x, y]) for x in range(9) for y in range(7))
    for kind, f in {"hamming": np.hamming, "hanning": np.hanning, "blackman": np.blackman, "kaiser": lambda n: np.kaiser(n, 14.0)}.items():
        w = f(11) / np.sqrt((f(11) ** 2).mean())
        assert np.allclose([r[0] for r in spark.range(11).select(A.window(F.col("id"), 11, kind)).collect()], w)


def test_empty_bins_are_there(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.9, 2.0)], "x double, v double")
    p = A.profile(df, F.col("x"), {"v": F.col("v")}, 0.0, 1.0, 4, F.lit(1.0)).orderBy("bin").collect()
    assert [(r.norm, r.v) for r in p] == [(1, 1), (0, 0), (0, 0), (1, 2)]
    assert A.distribution_2d(df, F.col("x"), F.col("v"), (0.0, 1.0), (0.0, 2.0), (3, 2), F.lit(1.0)).count() == 6
    empty = L.deposit(df.limit(0), {"i": (F.col("x"), 0.0, 1.0, 3)})
    assert [r.density for r in empty.collect()] == [0.0] * 3


def test_load_particles(spark, snap, tmp_path):
    rng = np.random.default_rng(6)
    reals = {c: rng.random(9) for c in ("x", "y", "z", "velx", "vely", "velz")}
    write_particles(f"{tmp_path}/prtcl.00003.prtclbin", reals, {"gid": np.zeros(9), "tag": np.arange(9)})
    p = snap.load_particles(spark, folder=str(tmp_path), number=3)
    got = p.select(snap.particle("r").alias("r"), snap.particle("R").alias("c"), snap.particle("vx").alias("v"), snap.particle("vtot").alias("t")).toPandas()
    assert np.allclose(got.r, np.sqrt(reals["x"] ** 2 + reals["y"] ** 2 + reals["z"] ** 2)) and np.allclose(got.v, reals["velx"]) and np.allclose(got.c, np.hypot(reals["x"], reals["y"]))
    with pytest.raises(ValueError):
        snap.particle("dens")
    with pytest.raises(ValueError):
        snap.load_particles(spark, "p.txt")


def test_hdf_needs_its_library(spark):
    if "h5py" not in sys.modules and not any(f.exists() for f in map(lambda p: __import__("pathlib").Path(p) / "h5py", sys.path)):
        with pytest.raises(ValueError, match="h5py"):
            Snapshot.load(spark, "/nowhere/run.00000.athdf")


def test_blocks_and_columns_that_are_read(spark, data, tmp_path):
    path = f"{tmp_path}/run.bin"
    write(path, data, 8)
    few = spark.read.format("meshbin").option("columns", "velx,dens").option("box", "-0.5,-0.1,-0.5,0.5,-0.5,-0.3").load(path)
    assert [c for c in few.columns if c in data] == ["velx", "dens"] and {(r.lx1, r.lx2, r.lx3) for r in few.select("lx1", "lx2", "lx3").distinct().collect()} == {(0, 0, 0), (0, 1, 0)}
    r = few.where("mb = 2 AND k = 1 AND j = 2 AND i = 3").first()
    assert r.dens == data["dens"][1, 6, 3] and r.velx == data["velx"][1, 6, 3]
    with pytest.raises(Exception, match="no such variables"):
        spark.read.format("meshbin").option("columns", "nothing").load(path)


def test_follow_writes_a_batch_once(spark, tmp_path):
    from gridloom.streaming.follow import follow, write_batch

    spark.range(5).withColumn("v", F.col("id") * 1.0).write.parquet(f"{tmp_path}/in")
    total = lambda cells: cells.agg(F.sum("v").alias("s"))
    for _ in range(2):  # the second start finds nothing new
        follow(spark, f"{tmp_path}/in", "id long, v double", total, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [(r.s, r.batch) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(10.0, 0)]
    write_batch(total(spark.read.parquet(f"{tmp_path}/in")), f"{tmp_path}/out", 0)  # a batch that is tried again
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
