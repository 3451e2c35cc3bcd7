"""The library's operators over the star-schema tables. Queries over events take all of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.fields import Fields
from gridloom.operators import aggregates as A
from gridloom.operators import lattice as L
from gridloom.operators import mesh as M
from gridloom.operators import pairs as P
from gridloom.operators import spectral, surface
from gridloom.plans import field_sql
from gridloom.plans.catalog import query
from gridloom.snapshot import Snapshot


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _calc(operation: str, sql: str):
    def run(spark, sf_dir):
        items = _table(spark, sf_dir, "lineitem")
        values = {"price": F.col("l_extendedprice"), "discount": F.col("l_discount")}
        return _rounded(A.calc(items, values, operation, F.col("l_quantity")), 4)

    query(f"calc_{operation}", f"SELECT {', '.join(f'round({sql.format(v=v)}, 4) AS {n}' for n, v in (('price', 'l_extendedprice'), ('discount', 'l_discount')))} FROM lineitem")(run)


for _operation, _sql in {"sum": "sum({v} * l_quantity)", "min": "min({v})", "max": "max({v})", "average": "sum({v} * l_quantity) / sum(l_quantity)"}.items():
    _calc(_operation, _sql)


@query("calc_filtered_extrema", "SELECT round(min(log10(l_discount)), 6) AS lo, round(max(log10(l_discount)), 6) AS hi FROM lineitem WHERE l_discount > 0 AND l_quantity != 0 AND l_tax > 0.01 AND l_tax < 0.07")
def calc_filtered_extrema(spark, sf_dir):
    lo, hi = A.extrema(_table(spark, sf_dir, "lineitem"), A.scaled(F.col("l_discount"), "log10"), F.col("l_quantity"), (F.col("l_tax") > 0.01) & (F.col("l_tax") < 0.07))
    return _rounded(spark.range(1).select(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))


DIST = (2.9, 5.1, 50)
DIST_SQL = """
WITH v AS (SELECT log10(l_extendedprice) AS v, l_quantity AS w FROM lineitem),
h AS (SELECT least(floor((v - 2.9) / (5.1 - 2.9) * 50), 49)::INT AS bin, sum(w) AS w FROM v WHERE v >= 2.9 AND v <= 5.1 GROUP BY 1),
f AS (SELECT b.range::INT AS bin, coalesce(h.w, 0) AS w FROM range(50) b LEFT JOIN h ON h.bin = b.range),
d AS (SELECT bin, 2.9 + (bin + 0.5) * ((5.1 - 2.9) / 50) AS loc, w / (sum(w) OVER () * ((5.1 - 2.9) / 50)) AS dat FROM f)
"""


def _dist(spark, sf_dir):
    return A.distribution(_table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), *DIST, F.col("l_quantity"), "log10")


@query("dist1d", DIST_SQL + "SELECT bin, round(loc, 6) AS loc, round(dat, 6) AS dat FROM d")
def dist1d(spark, sf_dir):
    return _rounded(_dist(spark, sf_dir))


@query(
    "dist1d_moments",
    DIST_SQL + """, m AS (SELECT sum(dat * 0.044 * loc) AS mean, sqrt(sum(dat * 0.044 * loc * loc)) AS rms FROM d)
SELECT round(mean, 6) AS mean, round(rms, 6) AS rms, round(sqrt(rms * rms - mean * mean), 6) AS sigma, round(sum(dat * 0.044 * (loc - mean) ** 3), 6) AS skew, round(sum(dat * 0.044 * (loc - mean) ** 4), 6) AS kurtosis FROM d, m GROUP BY mean, rms""",
)
def dist1d_moments(spark, sf_dir):
    return _rounded(A.moments(_dist(spark, sf_dir), *DIST))


@query(
    "dist2d",
    """WITH b AS (SELECT least(floor((log10(l_extendedprice) - 2.9) / (5.1 - 2.9) * 20), 19)::INT AS bx, least(floor((l_quantity - 0.0) / (51.0 - 0.0) * 17), 16)::INT AS "by", l_quantity AS w FROM lineitem WHERE log10(l_extendedprice) BETWEEN 2.9 AND 5.1),
g AS (SELECT a.range::INT AS bx, c.range::INT AS "by" FROM range(20) a, range(17) c), h AS (SELECT bx, "by", sum(w) AS w FROM b GROUP BY ALL)
SELECT bx, "by", round(2.9 + bx * ((5.1 - 2.9) / 20), 6) AS loc1, round(0.0 + "by" * (51.0 / 17), 6) AS loc2, round(coalesce(w, 0) / (sum(w) OVER () * ((5.1 - 2.9) / 20 * (51.0 / 17))), 6) AS dat FROM g LEFT JOIN h USING (bx, "by")""",
)
def dist2d(spark, sf_dir):
    items = _table(spark, sf_dir, "lineitem")
    return _rounded(A.distribution_2d(items, F.log10("l_extendedprice"), F.col("l_quantity"), (2.9, 5.1), (0.0, 51.0), (20, 17), F.col("l_quantity")))


def _lattice_sql() -> str:
    return """n AS (SELECT ceil(cbrt(count(*)) - 1e-9)::INT AS n FROM events),
lattice AS (SELECT event_id AS id, (event_id // (n * n))::INT AS k, ((event_id // n) % n)::INT AS j, (event_id % n)::INT AS i, value AS f, n,
  (event_id % 7)::DOUBLE - 3 AS velx, (event_id % 5)::DOUBLE - 2 AS vely, (event_id % 11)::DOUBLE - 5 AS velz,
  (event_id % 3)::DOUBLE + 0.5 AS bcc1, (event_id % 4)::DOUBLE - 1 AS bcc2, (event_id % 6)::DOUBLE - 2 AS bcc3,
  1 + value / 100 AS dens, 2 + value / 50 AS eint, (event_id % 2)::DOUBLE AS coolr,
  -0.5::DOUBLE AS x1min, 0.5::DOUBLE AS x1max, -0.5::DOUBLE AS x2min, 0.5::DOUBLE AS x2max, -0.5::DOUBLE AS x3min, 0.5::DOUBLE AS x3max,
  n::DOUBLE AS nx1, n::DOUBLE AS nx2, n::DOUBLE AS nx3
  FROM events, n)"""


def _lattice(spark, sf_dir) -> tuple[DataFrame, int]:
    """All events as cells of the smallest cube that holds them; the id, and so the cell, is dense. The last layers' cells beyond the events aren't there."""
    events = _table(spark, sf_dir, "events").select("event_id", "value")
    n = math.ceil(events.count() ** (1 / 3) - 1e-9)
    e = F.col("event_id")
    mod = lambda m, d: (e % m).cast("double") + d
    cells = events.select(
        e.alias("id"), F.expr(f"int(event_id div {n * n})").alias("k"), F.expr(f"int((event_id div {n}) % {n})").alias("j"), F.expr(f"int(event_id % {n})").alias("i"), F.col("value").alias("f"),
        mod(7, -3.0).alias("velx"), mod(5, -2.0).alias("vely"), mod(11, -5.0).alias("velz"), mod(3, 0.5).alias("bcc1"), mod(4, -1.0).alias("bcc2"), mod(6, -2.0).alias("bcc3"),
        (1 + F.col("value") / 100).alias("dens"), (2 + F.col("value") / 50).alias("eint"), mod(2, 0.0).alias("coolr"),
        *[F.lit(v).alias(f"x{d}{m}") for d in (1, 2, 3) for m, v in (("min", -0.5), ("max", 0.5))], *[F.lit(float(n)).alias(f"nx{d}") for d in (1, 2, 3)],
    )
    return cells, n


#: Cells of a block's edge where the lattice is cut into blocks.
EDGE = 4


def _snapshot(spark, sf_dir) -> tuple[Snapshot, int]:
    """The lattice cut into blocks of EDGE cells, periodic.

    A block's upper bound is its lower one and its width. Cells' centres x, y, z are those of the whole
    mesh: from the blocks' rounded bounds, the middle of an odd lattice wouldn't be at 0.
    """
    cells, n = _lattice(spark, sf_dir)
    cells = cells.withColumns({c: FIELDS(c) for c in "xyz"})
    lx = [F.floor(F.col(c) / EDGE).cast("int") for c in "ijk"]
    m = -(-n // EDGE)
    cells = cells.withColumns({f"lx{d}": lx[d - 1] for d in (1, 2, 3)}).withColumn("mb", ((F.col("lx3") * m + F.col("lx2")) * m + F.col("lx1")).cast("int")).withColumn("level", F.lit(0))
    low = {d: F.lit(-0.5) + F.col(f"lx{d}") * (EDGE / n) for d in (1, 2, 3)}
    cells = cells.withColumns({f"x{d}min": at for d, at in low.items()} | {f"x{d}max": at + F.lit(EDGE / n) for d, at in low.items()} | {f"nx{d}": F.lit(float(EDGE)) for d in (1, 2, 3)})
    cells = cells.withColumns({c: F.col(c) % EDGE for c in "kji"})
    return Snapshot(cells, None, **{f"nx{d}": EDGE for d in (1, 2, 3)}, **{f"Nx{d}": n for d in (1, 2, 3)}, **{f"X{d}{m}": v for d in (1, 2, 3) for m, v in (("min", -0.5), ("max", 0.5))}, periodic=1.0, **LIMITS), n


RAW = ["k", "j", "i", "f", "velx", "vely", "velz", "bcc1", "bcc2", "bcc3", "dens", "eint", "coolr", "nx1", "nx2", "nx3", *[f"x{d}{m}" for d in (1, 2, 3) for m in ("min", "max")]]
LIMITS = {"T_cold": 3e-9, "T_hot": 4e-9, "T_min": 2e-9, "T_max": 5e-9, "x_lo": -0.25, "x_hi": 0.25, "y_lo": -0.25, "y_hi": 0.4, "z_lo": -0.1, "z_hi": 0.3, "gamma": 1.4}
FIELDS = Fields(RAW, mhd=True, parameters=LIMITS)
LATER = ("cur", "nrho", "nprs", "nvel", "eflxwave", "delrhodelT", "delvrdelT")
GROUPS: dict[str, list[str]] = {}
for _name in FIELDS.formulas:
    if _name in RAW or _name.startswith(LATER) or _name == "R":
        continue
    _kind = "weighted" if _name.endswith(("_mw", "_vw")) else "masks" if "bool" in _name else "fluxes" if "flx" in _name or "mdot" in _name else "magnetic" if _name[:3] in ("bcc", "bto", "v_A", "mac", "bet", "bro", "pth", "ema") else "coordinates" if _name in ("x", "y", "z", "r", "R_cyl", "theta", "phi", "b", "l", "zeros", "ones", "r_sol", "x_sol", "b_sol", "l_sol") or _name[0] == "d" or "vol" in _name else "gas"
    GROUPS.setdefault(_kind, []).append(_name)


def _fields(kind: str, names: list[str]) -> None:
    alias = lambda n: "f_" + n.replace("^", "")
    digits = lambda n: -6 if n in ("x_sol", "r_sol") else 14 if n == "temp_cgs" else 6

    def run(spark, sf_dir):
        cells, _ = _lattice(spark, sf_dir)
        cells = FIELDS.select(cells, names)
        return cells.select("id", *[(F.round(A.finite(F.col(f"`{n}`").cast("double")), digits(n)) + F.lit(0.0)).alias(alias(n)) for n in names])

    value = lambda n: f"round(CASE WHEN isfinite({field_sql.column(n)}) THEN {field_sql.column(n)} ELSE 0 END, {digits(n)}) + 0.0::DOUBLE AS \"{alias(n)}\""
    query(f"fields_{kind}", f"WITH {_lattice_sql()}, fields AS ({field_sql.select('lattice')}) SELECT id, {', '.join(map(value, names))} FROM fields")(run)


for _kind, _names in GROUPS.items():
    _fields(_kind, _names)


_RELATIVE = [*(f"{n}{s}" for n in ("nrho", "nprs", "eflxwave", "delrhodelT", "delvrdelT") for s in ("", "_hot", "_range")), "nvelx", "nvely", "nvelz"]


def _relative_sql() -> str:
    profiled = {"dens": "dens", "pres": "pres", "temp": "temp", "velr": "velr"}
    w = {"": "1.0", "_hot": "thotbool", "_range": "trangebool"}
    means = [f"coalesce(sum({q} * {weight}) / nullif(sum({weight}), 0), 0) AS p_{q}{s}" for s, weight in w.items() for q in profiled] + [f"avg(vel{c}) AS p_vel{c}" for c in "xyz"]
    out = [f"vel{c} - p_vel{c} AS nvel{c}" for c in "xyz"]
    for s in w:
        out += [f"dens / nullif(p_dens{s}, 0) AS nrho{s}", f"pres / nullif(p_pres{s}, 0) AS nprs{s}", f"(pres - p_pres{s}) * (velr - p_velr{s}) AS eflxwave{s}", f"(dens - p_dens{s}) * (temp - p_temp{s}) AS delrhodelT{s}", f"(velr - p_velr{s}) * (temp - p_temp{s}) AS delvrdelT{s}"]
    shown = ", ".join(f'round({n}, 6) + 0.0::DOUBLE AS "{n}"' for n in _RELATIVE)
    return f"WITH {_lattice_sql()}, fields AS ({field_sql.select('lattice')}), p AS (SELECT k, {', '.join(means)} FROM fields GROUP BY k), o AS (SELECT id, {', '.join(out)} FROM fields JOIN p USING (k)) SELECT id, {shown} FROM o"


@query("fields_relative", _relative_sql())
def fields_relative(spark, sf_dir):
    snap, _ = _snapshot(spark, sf_dir)
    return _rounded(snap.table(_RELATIVE).select("id", *_RELATIVE))


for _axis, _index in L.AXES.items():

    def _profile(axis=_axis, index=_index):
        @query(
            f"profile_{axis}",
            f"""WITH {_lattice_sql()}, p AS (SELECT {index} AS bin, sum(dens) AS norm, sum(f * dens) / sum(dens) AS f, sqrt(greatest(sum(f * f * dens) / sum(dens) - (sum(f * dens) / sum(dens)) ** 2, 0)) AS f_sigma FROM lattice GROUP BY 1),
b AS (SELECT unnest(range(n))::INT AS bin, n FROM n) SELECT bin, round(-0.5 + (bin + 0.5) * (1.0 / n), 6) AS coord, round(coalesce(norm, 0), 6) AS norm, round(coalesce(f, 0), 6) AS f, round(coalesce(f_sigma, 0), 6) AS f_sigma FROM b LEFT JOIN p USING (bin)""",
        )
        def run(spark, sf_dir):
            cells, n = _lattice(spark, sf_dir)
            return _rounded(A.profile(cells, FIELDS(axis), {"f": F.col("f")}, -0.5, 0.5, n, F.col("dens")))

    _profile()


@query(
    "profile_radial",
    f"""WITH {_lattice_sql()}, c AS (SELECT f, dens, log10(sqrt((((i + 0.5) / n) - 0.5) ** 2 + (((j + 0.5) / n) - 0.5) ** 2 + (((k + 0.5) / n) - 0.5) ** 2)) AS v FROM lattice),
b AS (SELECT least(floor((v + 1.3) / (0.0 + 1.3) * 13), 12)::INT AS bin, f, dens FROM c WHERE v >= -1.3 AND v <= 0),
p AS (SELECT bin, sum(dens) AS norm, sum(f * dens) / sum(dens) AS f, sqrt(greatest(sum(f * f * dens) / sum(dens) - (sum(f * dens) / sum(dens)) ** 2, 0)) AS f_sigma FROM b GROUP BY bin),
e AS (SELECT range::INT AS bin, 10 ** (-1.3 + (range + 0.5) * (1.3 / 13)) AS r FROM range(13))
SELECT bin, round(-1.3 + (bin + 0.5) * (1.3 / 13), 6) AS coord, round(r, 6) AS r, round(coalesce(norm, 0), 6) AS norm, round(coalesce(f, 0) * 4 * pi() * r ** 2, 6) AS f, round(coalesce(f_sigma, 0), 6) AS f_sigma FROM e LEFT JOIN p USING (bin)""",
)
def profile_radial(spark, sf_dir):
    cells, n = _lattice(spark, sf_dir)
    return _rounded(A.radial_profile(cells, FIELDS("r"), {"f": F.col("f")}, -1.3, 0.0, 13, F.col("dens"), flux=True))


@query("projection", f"WITH {_lattice_sql()} SELECT i AS px, j AS py, round(sum(f * dens) / sum(dens), 6) AS value FROM lattice GROUP BY i, j")
def projection(spark, sf_dir):
    cells, _ = _lattice(spark, sf_dir)
    return _rounded(A.projection(cells, F.col("i"), F.col("j"), F.col("f"), F.col("dens")))


@query(
    "projection_window",
    f"""WITH {_lattice_sql()}, w AS (SELECT unnest(range(n))::INT AS k, 0.54 - 0.46 * cos(2 * pi() * unnest(range(n)) / (n - 1)) AS w FROM n), s AS (SELECT k, w / sqrt(avg(w * w) OVER ()) AS w FROM w)
SELECT i AS px, j AS py, round(sum(f * w * dens) / sum(dens), 6) AS value FROM lattice JOIN s USING (k) GROUP BY i, j""",
)
def projection_window(spark, sf_dir):
    snap, n = _snapshot(spark, sf_dir)
    return _rounded(snap.projection("f", axis="z", weights="dens", window="hamming"))


@query(
    "dist_auto",
    f"""WITH {_lattice_sql()}, v AS (SELECT log10(dens) AS v, 1.0 / (n * n * n) AS w FROM lattice), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
h AS (SELECT least(floor((v - lo) / (hi - lo) * 1000), 999)::INT AS bin, sum(w) AS w FROM v, e GROUP BY 1), f AS (SELECT range::INT AS bin, coalesce(w, 0) AS w FROM range(1000) b LEFT JOIN h ON h.bin = b.range)
SELECT bin, round(lo + (bin + 0.5) * ((hi - lo) / 1000), 6) AS loc, round(w / (sum(w) OVER () * ((hi - lo) / 1000)), 6) AS dat FROM f, e""",
)
def dist_auto(spark, sf_dir):
    snap, _ = _snapshot(spark, sf_dir)
    return _rounded(snap.dist(["dens"])["dens"])


@query("coarsen", f"WITH {_lattice_sql()} SELECT (k // 2)::INT AS k, (j // 2)::INT AS j, (i // 2)::INT AS i, round(avg(f), 6) AS f FROM lattice GROUP BY 1, 2, 3")
def coarsen(spark, sf_dir):
    return _rounded(L.coarsen(_lattice(spark, sf_dir)[0], ["f"]))


@query("refine", f"WITH {_lattice_sql()}, c AS (SELECT unnest([0, 1]) AS d) SELECT (k * 2 + a.d)::INT AS k, (j * 2 + b.d)::INT AS j, (i * 2 + c.d)::INT AS i, f FROM lattice, c a, c b, c")
def refine(spark, sf_dir):
    return L.refine(_lattice(spark, sf_dir)[0], ["f"])


def _mixed(spark, sf_dir) -> tuple[DataFrame, int]:
    """The lattice as level 1 of a mesh: every other block as it is, the others coarsened into blocks of level 0."""
    cells, n = _lattice(spark, sf_dir)
    odd = (F.floor(F.col("k") / EDGE) + F.floor(F.col("j") / EDGE) + F.floor(F.col("i") / EDGE)) % 2 == 1
    shown = [F.col(c).alias(f"g{c}") for c in "kji"]
    fine = cells.where(~odd).select(*shown, F.lit(1).alias("level"), "f")
    coarse = L.coarsen(cells.where(odd), ["f"]).select(*shown, F.lit(0).alias("level"), "f")
    return fine.unionByName(coarse), n


@query("resample_levels", f"WITH {_lattice_sql()}, m AS (SELECT k // 2 AS k, j // 2 AS j, i // 2 AS i, avg(f) AS f FROM lattice WHERE (k // 4 + j // 4 + i // 4) % 2 = 1 GROUP BY ALL), c AS (SELECT unnest([0, 1]) AS d) SELECT k, j, i, round(f, 6) AS f FROM lattice WHERE (k // 4 + j // 4 + i // 4) % 2 = 0 UNION ALL SELECT (m.k * 2 + a.d)::INT, (m.j * 2 + b.d)::INT, (m.i * 2 + c.d)::INT, round(f, 6) FROM m, c a, c b, c")
def resample_levels(spark, sf_dir):
    return _rounded(M.resample(_mixed(spark, sf_dir)[0], ["f"], 1))


@query("resample_to_root", f"WITH {_lattice_sql()} SELECT (k // 2)::INT AS k, (j // 2)::INT AS j, (i // 2)::INT AS i, round(avg(f), 6) AS f FROM lattice GROUP BY 1, 2, 3")
def resample_to_root(spark, sf_dir):
    return _rounded(M.resample(_mixed(spark, sf_dir)[0], ["f"], 0))


@query("slice_mean", f"WITH {_lattice_sql()} SELECT j, k, round(avg(f), 6) AS f FROM lattice WHERE i >= 2 AND i < 5 GROUP BY j, k")
def slice_mean(spark, sf_dir):
    return _rounded(L.slice_mean(_lattice(spark, sf_dir)[0], "f", "x", 2, 5))


@query("slice_box", f"WITH {_lattice_sql()} SELECT j, i, round(avg(f), 6) AS f FROM lattice WHERE k >= floor(0.25 * n) AND k < floor(0.5 * n) AND j >= floor(0.125 * n) AND j < floor(0.75 * n) GROUP BY j, i")
def slice_box(spark, sf_dir):
    snap, _ = _snapshot(spark, sf_dir)
    return _rounded(snap.slice("f", xyz=[-0.5, 0.5, -0.375, 0.25, -0.25, 0.0]))


@query("uniform_centres", "SELECT k.range::INT AS k, j.range::INT AS j, i.range::INT AS i, round(-1 + (i.range + 0.5) * 0.4, 6)::DOUBLE AS x, round((j.range + 0.5) * 0.5, 6)::DOUBLE AS y, round(2 + (k.range + 0.5) * 1.0, 6)::DOUBLE AS z, 0.4::DOUBLE AS dx, 0.5::DOUBLE AS dy, 1.0::DOUBLE AS dz FROM range(3) k, range(4) j, range(5) i")
def uniform_centres(spark, sf_dir):
    return _rounded(M.centres(spark, [-1.0, 1.0, 0.0, 2.0, 2.0, 5.0], (5, 4, 3)))


_BLOCKED = "b AS (SELECT *, k // 4 AS lx3, j // 4 AS lx2, i // 4 AS lx1, (n + 3) // 4 AS m FROM lattice)"


@query(
    "block_regions",
    f"""WITH {_lattice_sql()}, {_BLOCKED}, g AS (SELECT ((lx3 * m + lx2) * m + lx1)::INT AS mb, n, -0.5 + lx1 * (4.0 / n) AS a1, -0.5 + lx2 * (4.0 / n) AS a2, -0.5 + lx3 * (4.0 / n) AS a3, count(*) AS cells FROM b GROUP BY ALL)
SELECT mb, cells, round((4.0 / n) ** 3, 6) AS volume, CASE WHEN a1 + 4.0 / n < -0.3 OR a1 > 0.3 OR a2 + 4.0 / n < -0.3 OR a2 > 0.3 OR a3 + 4.0 / n < -0.3 OR a3 > 0.3 THEN 'outside'
  WHEN a1 >= -0.3 AND a1 + 4.0 / n <= 0.3 AND a2 >= -0.3 AND a2 + 4.0 / n <= 0.3 AND a3 >= -0.3 AND a3 + 4.0 / n <= 0.3 THEN 'inside' ELSE 'partial' END AS region FROM g""",
)
def block_regions(spark, sf_dir):
    snap, _ = _snapshot(spark, sf_dir)
    return _rounded(M.box_class(snap.blocks(), [-0.3, 0.3] * 3).select("mb", "cells", "volume", "region"))


def _d(v: str, axis: str) -> str:
    at = L.AXES[axis]
    rest = ", ".join(c for c in "kji" if c != at)
    w = f"OVER (PARTITION BY {rest} ORDER BY {at} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    o = f"OVER (PARTITION BY {rest} ORDER BY {at})"
    closed = f"first_value({at}) {w} = 0 AND last_value({at}) {w} = n - 1"
    after = f"CASE WHEN lead({at}) {o} = {at} + 1 THEN lead({v}) {o} WHEN {closed} AND {at} = n - 1 THEN first_value({v}) {w} END"
    before = f"CASE WHEN lag({at}) {o} = {at} - 1 THEN lag({v}) {o} WHEN {closed} AND {at} = 0 THEN last_value({v}) {w} END"
    return f"coalesce((({after}) - ({before})) / (2 * (1.0 / n)), (({after}) - {v}) / (1.0 / n), ({v} - ({before})) / (1.0 / n), 0)"


@query("gradient", f"WITH {_lattice_sql()} SELECT k, j, i, {', '.join(f'round({_d("f", a)}, 6) + 0.0::DOUBLE AS df_d{a}' for a in 'xyz')} FROM lattice")
def gradient(spark, sf_dir):
    cells, n = _lattice(spark, sf_dir)
    return _rounded(L.gradient(cells.select("k", "j", "i", "f"), "f", dict.fromkeys("xyz", 1 / n), n=n).drop("f"))


@query("gradient_blocks", f"WITH {_lattice_sql()} SELECT id, {', '.join(f'round({_d("f", a)}, 6) + 0.0::DOUBLE AS df_d{a}' for a in 'xyz')} FROM lattice")
def gradient_blocks(spark, sf_dir):
    snap, _ = _snapshot(spark, sf_dir)
    return _rounded(snap.gradient("f").select("id", "df_dx", "df_dy", "df_dz"))


@query("divergence", f"WITH {_lattice_sql()}, d AS (SELECT k, j, i, {', '.join(f'{_d(f"vel{a}", a)} AS d{a}' for a in 'xyz')} FROM lattice) SELECT k, j, i, round(dx + dy + dz, 6) + 0.0::DOUBLE AS div FROM d")
def divergence(spark, sf_dir):
    cells, n = _lattice(spark, sf_dir)
    return _rounded(L.divergence(cells.select("k", "j", "i", "velx", "vely", "velz"), ("velx", "vely", "velz"), dict.fromkeys("xyz", 1 / n), n=n).select("k", "j", "i", "div"))


_CURL = f"d AS (SELECT id, k, j, i, {', '.join(f'{_d(f"bcc{v}", a)} AS d{v}{a}' for v, a in ((3, 'y'), (2, 'z'), (1, 'z'), (3, 'x'), (2, 'x'), (1, 'y')))} FROM lattice)"


@query("curl", f"WITH {_lattice_sql()}, {_CURL} SELECT k, j, i, round(d3y - d2z, 6) + 0.0::DOUBLE AS curl_x, round(d1z - d3x, 6) + 0.0::DOUBLE AS curl_y, round(d2x - d1y, 6) + 0.0::DOUBLE AS curl_z FROM d")
def curl(spark, sf_dir):
    cells, n = _lattice(spark, sf_dir)
    return _rounded(L.curl(cells.select("k", "j", "i", "bcc1", "bcc2", "bcc3"), ("bcc1", "bcc2", "bcc3"), dict.fromkeys("xyz", 1 / n), n=n).select("k", "j", "i", "curl_x", "curl_y", "curl_z"))


@query(
    "fields_current",
    f"WITH {_lattice_sql()}, {_CURL}, c AS (SELECT id, 2.99792458 * (d3y - d2z) AS x, 2.99792458 * (d1z - d3x) AS y, 2.99792458 * (d2x - d1y) AS z FROM d) SELECT id, round(x, 5) + 0.0::DOUBLE AS curx, round(y, 5) + 0.0::DOUBLE AS cury, round(z, 5) + 0.0::DOUBLE AS curz, round(sqrt(x * x + y * y + z * z), 5) AS cur FROM c",
)
def fields_current(spark, sf_dir):
    snap, _ = _snapshot(spark, sf_dir)
    snap.fields.parameters["c_code"] = 2.99792458
    return _rounded(snap.table(["curx", "cury", "curz", "cur"]).select("id", "curx", "cury", "curz", "cur"), 5)


@query(
    "interface_levels",
    f"""WITH {_lattice_sql()}, {_BLOCKED}, t AS (SELECT lx3, lx2, lx1, n, log10(avg(f) / avg(dens)) AS t FROM b GROUP BY ALL), z AS (SELECT round(-0.5 + lx3 * (4.0 / n), 6) AS x3min, avg(t) AS log_t, row_number() OVER (ORDER BY lx3) AS o FROM t GROUP BY lx3, n),
c AS (SELECT o FROM z ORDER BY abs(log_t - log10(18.0)), o LIMIT 1) SELECT x3min, round(log_t, 6) AS log_t FROM z, c WHERE abs(z.o - c.o) <= 1""",
)
def interface_levels(spark, sf_dir):
    snap, _ = _snapshot(spark, sf_dir)
    return _rounded(surface.interface_levels(snap.cells, F.avg("f") / F.avg("dens"), 18.0))


_BLOCKS = "SELECT DISTINCT (k // 4 * ((n + 3) // 4) + j // 4) * ((n + 3) // 4) + i // 4 AS mb, i // 4 AS lx1, j // 4 AS lx2, k // 4 AS lx3, (n + 3) // 4 AS m FROM lattice"


@query(
    "neighbour_blocks",
    f"""WITH {_lattice_sql()}, b AS ({_BLOCKS}),
w AS (SELECT mb, m, d, (lx1 + a + m) % m AS lx1, (lx2 + e + m) % m AS lx2, (lx3 + c + m) % m AS lx3 FROM b, (VALUES ('+1', 1, 0, 0), ('-1', -1, 0, 0), ('+2', 0, 1, 0), ('-2', 0, -1, 0), ('+3', 0, 0, 1), ('-3', 0, 0, -1)) t(d, a, e, c))
SELECT w.mb::INT AS mb, d AS direction, b.mb::INT AS neighbour FROM w JOIN b USING (lx1, lx2, lx3)""",
)
def neighbour_blocks(spark, sf_dir):
    cells, n = _lattice(spark, sf_dir)
    m = (n + 3) // 4
    at = [F.floor(F.col(c) / 4).cast("int").alias(f"lx{d}") for d, c in ((1, "i"), (2, "j"), (3, "k"))]
    blocks = cells.select(*at).distinct().select(F.expr(f"int((lx3 * {m} + lx2) * {m} + lx1)").alias("mb"), "lx1", "lx2", "lx3", F.lit(0).alias("level"))
    return L.neighbour_blocks(blocks, (m, m, m))


_POINTS = "SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, 1.0::DOUBLE AS w, " + ", ".join(f"embedding[{k + 4}]::DOUBLE AS {n}" for k, n in enumerate(("vx", "vy", "vz", "bx", "by_", "bz"))) + " FROM embeddings"


def _points(spark, sf_dir):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[e(k).alias(n) for k, n in enumerate(("x", "y", "z", "vx", "vy", "vz", "bx", "by_", "bz"))], F.lit(1.0).alias("w"))


_PAIRS = f"p AS ({_POINTS}), q AS (SELECT *, sqrt(lx * lx + ly * ly + lz * lz) AS r FROM (SELECT b.x - a.x AS lx, b.y - a.y AS ly, b.z - a.z AS lz, b.vx - a.vx AS dx, b.vy - a.vy AS dy, b.vz - a.vz AS dz FROM p a JOIN p b ON a.id < b.id))"
_SF = "SELECT least(floor((r - 0.0) / (1.0 - 0.0) * 25), 1000)::INT AS bin, count(*) AS n, (2 * count(*))::DOUBLE AS weight, {} FROM {} WHERE r >= 0 AND r < 1 GROUP BY 1"


@query("sf_exhaustive", f"WITH {_PAIRS} " + _SF.format("round(avg(abs(dx)), 8) AS vx_1, round(avg(dx * dx), 8) AS vx_2", "q"))
def sf_exhaustive(spark, sf_dir):
    return _rounded(P.structure_function(_points(spark, sf_dir), ["vx"], 0.0, 1.0, 25), 8)


@query(
    "sf_helmholtz",
    f"WITH {_PAIRS}, h AS (SELECT *, abs(dx * lx + dy * ly + dz * lz) / (r + 1e-10) AS c FROM q), s AS (SELECT *, sqrt(greatest(dx * dx + dy * dy + dz * dz - c * c, 0)) AS t FROM h) " + _SF.format("round(avg(c), 8) AS comp_1, round(avg(c * c), 8) AS comp_2, round(avg(t), 8) AS sol_1, round(avg(t * t), 8) AS sol_2", "s"),
)
def sf_helmholtz(spark, sf_dir):
    return _rounded(P.helmholtz(_points(spark, sf_dir), ("vx", "vy", "vz"), 0.0, 1.0, 25), 8)


@query(
    "sf_weighted_log",
    f"""WITH p AS (SELECT *, (id % 3)::DOUBLE AS u FROM ({_POINTS})), q AS (SELECT sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2) AS r, abs(b.u * b.vx - a.u * a.vx) AS d, a.u + b.u AS w FROM p a JOIN p b ON a.id < b.id WHERE a.u != 0 AND b.u != 0)
SELECT floor((log10(r) - log10(0.05)) / (log10(1.0) - log10(0.05)) * 20)::INT AS bin, count(*) AS n, sum(w) AS weight, round(avg(d), 8) AS vx_1, round(avg(d * d), 8) AS vx_2, 'u' AS weighting FROM q WHERE r >= 0.05 AND r < 1 GROUP BY 1""",
)
def sf_weighted_log(spark, sf_dir):
    points = _points(spark, sf_dir).withColumn("u", (F.col("id") % 3).cast("double"))
    return _rounded(P.structure_function(points, ["vx"], 0.05, 1.0, 20, log=True, weights=["u"]), 8)


def _anisotropic_sql() -> str:
    kinds = (("all", "r", "true"), ("parallel", "l_par", "c > 0.9"), ("perpendicular", "l_perp", "c <= 0.1"))
    powers = ", ".join(f"round(avg({a} ** {p}), 8) AS {a}_{p}" for a in ("vel", "vel_perp", "bcc", "bcc_perp") for p in (1, 2))
    each = " UNION ALL ".join(f"SELECT floor({l} * 25)::INT AS bin, count(*) AS n, (2 * count(*))::DOUBLE AS weight, {powers}, '{kind}' AS kind FROM e WHERE {l} >= 0 AND {l} < 1 AND {within} GROUP BY 1" for kind, l, within in kinds)
    return f"""WITH p AS ({_POINTS}), q AS (SELECT b.x - a.x AS lx, b.y - a.y AS ly, b.z - a.z AS lz, b.vx - a.vx AS vx, b.vy - a.vy AS vy, b.vz - a.vz AS vz, b.bx - a.bx AS bx, b.by_ - a.by_ AS by_, b.bz - a.bz AS bz,
  (a.bx + b.bx) / 2 AS mx, (a.by_ + b.by_) / 2 AS my, (a.bz + b.bz) / 2 AS mz FROM p a JOIN p b ON a.id < b.id),
u AS (SELECT *, sqrt(lx * lx + ly * ly + lz * lz) AS r, sqrt(mx * mx + my * my + mz * mz) AS m FROM q), o AS (SELECT *, abs(lx * mx + ly * my + lz * mz) / m AS l_par FROM u WHERE r > 1e-30 AND m > 1e-30),
e AS (SELECT r, l_par, sqrt(greatest(r * r - l_par * l_par, 0)) AS l_perp, l_par / r AS c, sqrt(vx * vx + vy * vy + vz * vz) AS vel, sqrt(greatest(vx * vx + vy * vy + vz * vz - ((vx * mx + vy * my + vz * mz) / m) ** 2, 0)) AS vel_perp,
  sqrt(bx * bx + by_ * by_ + bz * bz) AS bcc, sqrt(greatest(bx * bx + by_ * by_ + bz * bz - ((bx * mx + by_ * my + bz * mz) / m) ** 2, 0)) AS bcc_perp FROM o)
{each}"""


@query("sf_anisotropic", _anisotropic_sql())
def sf_anisotropic(spark, sf_dir):
    return _rounded(P.anisotropic(_points(spark, sf_dir), ("vx", "vy", "vz"), ("bx", "by_", "bz"), 0.0, 1.0, 25), 8)


@query(
    "particle_grid",
    """WITH c AS (SELECT least(floor((((embedding[3]::DOUBLE + 0.5) % 1.0 + 1.0) % 1.0) * 4), 3)::INT AS k, least(floor((((embedding[2]::DOUBLE + 0.5) % 1.0 + 1.0) % 1.0) * 4), 3)::INT AS j, least(floor((((embedding[1]::DOUBLE + 0.5) % 1.0 + 1.0) % 1.0) * 4), 3)::INT AS i FROM embeddings),
g AS (SELECT a.range::INT AS k, b.range::INT AS j, d.range::INT AS i FROM range(4) a, range(4) b, range(4) d), n AS (SELECT k, j, i, count(*) AS n FROM c GROUP BY ALL)
SELECT k, j, i, round(coalesce(n, 0) / avg(coalesce(n, 0)) OVER (), 6) AS density FROM g LEFT JOIN n USING (k, j, i)""",
)
def particle_grid(spark, sf_dir):
    points = _points(spark, sf_dir)
    return _rounded(L.deposit(points, {"k": (F.col("z"), -0.5, 0.5, 4), "j": (F.col("y"), -0.5, 0.5, 4), "i": (F.col("x"), -0.5, 0.5, 4)}))


@query("particle_profile", "WITH c AS (SELECT least(floor((((embedding[1]::DOUBLE + 0.5) % 1.0 + 1.0) % 1.0) * 8), 7)::INT AS i FROM embeddings), n AS (SELECT i, count(*) AS n FROM c GROUP BY i) SELECT a.range::INT AS i, coalesce(n, 0)::DOUBLE AS density FROM range(8) a LEFT JOIN n ON n.i = a.range")
def particle_profile(spark, sf_dir):
    return L.deposit(_points(spark, sf_dir), {"i": (F.col("x"), -0.5, 0.5, 8)}, normalize=False)


def _transform_sql(values: dict[str, str]) -> str:
    """modes: c, kz, ky, kx, re, im over sqrt(cells), axis by axis; absent cells count as 0."""
    turn = "2 * pi() * w.w * t.{} / n"
    given = " UNION ALL ".join(f"SELECT '{c}' AS c, k, j, i, {v} AS re, 0.0 AS im, n FROM lattice" for c, v in values.items())
    step = lambda source, at, name, rest: f"SELECT c, {rest}, w.w AS {name}, sum(re * cos({turn.format(at)}) + im * sin({turn.format(at)})) AS re, sum(im * cos({turn.format(at)}) - re * sin({turn.format(at)})) AS im, n FROM {source} t, w GROUP BY c, {rest}, w.w, n"
    return f"""w AS (SELECT unnest(range(n)) AS w FROM n), t0 AS ({given}), t1 AS ({step("t0", "i", "kx", "k, j")}), t2 AS ({step("t1", "j", "ky", "k, kx")}), t3 AS ({step("t2", "k", "kz", "kx, ky")}),
modes AS (SELECT c, n, re / sqrt(n * n * n) AS re, im / sqrt(n * n * n) AS im, {', '.join(f"(CASE WHEN k{a} < (n + 1) // 2 THEN k{a} ELSE k{a} - n END)::DOUBLE AS k{a}" for a in "xyz")} FROM t3)"""


def _shell_sql(powers: list[str], source: str) -> str:
    shown = ", ".join(f"round(sum({p}), 4) AS {p}, round(sum({p}) / count(*), 4) AS {p}_dens, round(4 * pi() * ((bin + 0.5) * n / 8) ** 2 * sum({p}) / count(*), 4) AS {p}_norm" for p in powers)
    return f"SELECT bin, count(*) AS nk, round((bin + 0.5) * n / 8, 4) AS k, {shown} FROM (SELECT *, floor(sqrt(kx * kx + ky * ky + kz * kz) * 8 / n)::INT AS bin FROM {source}) WHERE bin < 8 GROUP BY bin, n"


@query("spectrum", f"WITH {_lattice_sql()}, {_transform_sql({'f': 'f / 100'})}, p AS (SELECT *, re * re + im * im AS power FROM modes) " + _shell_sql(["power"], "p"))
def spectrum(spark, sf_dir):
    cells, n = _lattice(spark, sf_dir)
    return _rounded(spectral.spectrum(cells.withColumn("u", F.col("f") / 100), "u", (n, n, n), (1.0, 1.0, 1.0), 9), 4)


@query(
    "spectrum_helmholtz",
    f"""WITH {_lattice_sql()}, {_transform_sql({a: f'vel{a} / 10' for a in 'xyz'})},
v AS (SELECT kx, ky, kz, n, sum(re * re + im * im) AS whole, sum(re * CASE c WHEN 'x' THEN kx WHEN 'y' THEN ky ELSE kz END) AS re, sum(im * CASE c WHEN 'x' THEN kx WHEN 'y' THEN ky ELSE kz END) AS im FROM modes GROUP BY kx, ky, kz, n),
p AS (SELECT *, (re * re + im * im) / (kx * kx + ky * ky + kz * kz + 1e-16) AS comp, whole - (re * re + im * im) / (kx * kx + ky * ky + kz * kz + 1e-16) AS sol FROM v) """
    + _shell_sql(["comp", "sol"], "p"),
)
def spectrum_helmholtz(spark, sf_dir):
    cells, n = _lattice(spark, sf_dir)
    names = ("velx", "vely", "velz")
    return _rounded(spectral.spectrum_helmholtz(cells.withColumns({v: F.col(v) / 10 for v in names}), names, (n, n, n), (1.0, 1.0, 1.0), 9), 4)


def _area_sql(iso: float) -> str:
    """Each cube of eight cells in six tetrahedra along its diagonal; a tetrahedron's corners by value, and the triangles that the level cuts out of it."""
    tetrahedra = ", ".join(f"([{', '.join(map(str, t))}])" for t in surface.TETRAHEDRA)
    edges = {1: [(1, 4), (2, 4), (3, 4)], 2: [(1, 3), (1, 4), (2, 4), (2, 3)], 3: [(1, 2), (1, 3), (1, 4)]}
    cut = lambda a, b, c: f"s[{a}].{c} + ({iso} - s[{a}].v) / (s[{b}].v - s[{a}].v) * (s[{b}].{c} - s[{a}].{c})"
    points = ", ".join(f"CASE m {' '.join(f'WHEN {m} THEN {cut(*e[k], c)}' for m, e in edges.items() if k < len(e))} END AS {c}{k}" for k in range(4) for c in "zyx")
    side = lambda a, b, c: f"({c}{b} - {c}{a})"
    cross = lambda a, b, c, u, v: f"({side(a, b, u)} * {side(a, c, v)} - {side(a, b, v)} * {side(a, c, u)}) ** 2"
    triangle = lambda a, b, c: "0.5 * sqrt(" + " + ".join(cross(a, b, c, u, v) for u, v in ("yx", "zx", "zy")) + ")"
    return f"""WITH {_lattice_sql()}, d AS (SELECT range AS c, range >> 2 & 1 AS z, range >> 1 & 1 AS y, range & 1 AS x FROM range(8)),
cubes AS (SELECT a.k, a.j, a.i, a.n, list({{'v': b.f, 'z': d.z::DOUBLE, 'y': d.y::DOUBLE, 'x': d.x::DOUBLE}} ORDER BY d.c) AS corners FROM lattice a, d JOIN lattice b ON b.k = (a.k + d.z) % a.n AND b.j = (a.j + d.y) % a.n AND b.i = (a.i + d.x) % a.n GROUP BY a.k, a.j, a.i, a.n HAVING count(*) = 8),
tets AS (SELECT n, list_sort([corners[t.c[1] + 1], corners[t.c[2] + 1], corners[t.c[3] + 1], corners[t.c[4] + 1]]) AS s FROM cubes, (VALUES {tetrahedra}) t(c)),
cuts AS (SELECT n, s, len(list_filter(s, lambda p: p.v > {iso})) AS m FROM tets), p AS (SELECT n, m, {points} FROM cuts WHERE m BETWEEN 1 AND 3)
SELECT round(coalesce(sum(({triangle(0, 1, 2)} + CASE WHEN m = 2 THEN {triangle(0, 2, 3)} ELSE 0 END) / (n * n)), 0), 6) AS area FROM p"""


@query("isosurface_area", _area_sql(60.0))
def isosurface_area(spark, sf_dir):
    cells, n = _lattice(spark, sf_dir)
    return _rounded(surface.isosurface_area(cells, "f", 60.0, (n, n, n), (1 / n,) * 3))
