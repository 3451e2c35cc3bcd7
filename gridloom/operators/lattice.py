"""Lattices: stencils, refinement, slices, block neighbours and particle deposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = {"x": "i", "y": "j", "z": "k"}


def derivative(value: str, axis: str, spacing: float | Column, periodic: bool = True, *, index: dict[str, str] = AXES, n: int | Column | None = None, by: tuple[str, ...] = (), edge_order: int = 1) -> Column:
    """Central difference along an axis over neighbours in place; where there is none, one-sided of ``edge_order`` (1: two points, 2: three).

    A periodic line of ``n`` cells (None: as far as it goes) wraps if both its ends are there.
    ``by`` names columns that tell lattices apart, such as the level. Cells without any
    neighbour have 0. Derivatives along one axis share one sort.
    """
    at = F.col(index[axis])
    line = Window.partitionBy(*by, *[c for c in index.values() if c != index[axis]]).orderBy(index[axis])
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.col(value)
    beside = lambda k: F.when(F.lag(at, -k).over(line) == at + k, F.lag(value, -k).over(line))
    before, after = beside(-1), beside(1)
    if periodic:
        first, last = F.first(at).over(whole), F.last(at).over(whole)
        closed = (first == 0) & (last > first) & (F.lit(True) if n is None else last == n - 1)
        before = F.coalesce(before, F.when(closed & (at == first), F.last(value).over(whole)))
        after = F.coalesce(after, F.when(closed & (at == last), F.first(value).over(whole)))
    up, down = (after - here) / spacing, (here - before) / spacing
    if edge_order == 2:
        up = F.coalesce((4 * after - 3 * here - beside(2)) / (2 * spacing), up)
        down = F.coalesce((3 * here - 4 * before + beside(-2)) / (2 * spacing), down)
    return F.coalesce((after - before) / (2 * spacing), up, down, F.lit(0.0))


def gradient(cells: DataFrame, value: str, spacing: dict, periodic: bool | dict = True, **options) -> DataFrame:
    return _derived(cells, {a: [value] for a in "xyz"}, spacing, periodic, options).withColumnsRenamed({f"_d_{value}_{a}": f"d{value}_d{a}" for a in "xyz"})


def _derived(cells: DataFrame, wanted: dict[str, list[str]], spacing: dict, periodic: bool | dict, options: dict) -> DataFrame:
    """``cells`` and _d_<value>_<axis>; ``n`` in the options may be by axis."""
    for axis, values in wanted.items():
        wraps = periodic[axis] if isinstance(periodic, dict) else periodic
        own = {k: v[axis] if k == "n" and isinstance(v, dict) else v for k, v in options.items()}
        cells = cells.withColumns({f"_d_{v}_{axis}": derivative(v, axis, spacing[axis], wraps, **own) for v in values})
    return cells


def divergence(cells: DataFrame, values: tuple[str, str, str], spacing: dict, periodic: bool | dict = True, **options) -> DataFrame:
    out = _derived(cells, {a: [v] for a, v in zip("xyz", values, strict=True)}, spacing, periodic, options)
    parts = [f"_d_{v}_{a}" for a, v in zip("xyz", values, strict=True)]
    return out.withColumn("div", F.col(parts[0]) + F.col(parts[1]) + F.col(parts[2])).drop(*parts)


def curl(cells: DataFrame, values: tuple[str, str, str], spacing: dict, periodic: bool | dict = True, **options) -> DataFrame:
    x, y, z = values
    out = _derived(cells, {"x": [y, z], "y": [x, z], "z": [x, y]}, spacing, periodic, options)
    d = lambda v, a: F.col(f"_d_{v}_{a}")
    out = out.withColumns({"curl_x": d(z, "y") - d(y, "z"), "curl_y": d(x, "z") - d(z, "x"), "curl_z": d(y, "x") - d(x, "y")})
    return out.drop(*[c for c in out.columns if c.startswith("_d_")])


def coarsen(cells: DataFrame, values: list[str], factor: int = 2) -> DataFrame:
    """Parents' means."""
    parent = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in "kji"]
    return cells.groupBy(*parent).agg(*[F.avg(v).alias(v) for v in values])


def refine(cells: DataFrame, values: list[str], factor: int = 2) -> DataFrame:
    """Children repeat their parent: no shuffle."""
    out = cells
    for c in "kji":
        out = out.withColumn(f"_{c}", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn(c, (F.col(c) * factor + F.col(f"_{c}")).cast("int")).drop(f"_{c}")
    return out.select("k", "j", "i", *values)


def slice_mean(cells: DataFrame, value: str, axis: str, lo: int, hi: int) -> DataFrame:
    """The mean along an axis over cells lo <= index < hi."""
    other = [c for c in AXES.values() if c != AXES[axis]]
    return cells.where((F.col(AXES[axis]) >= lo) & (F.col(AXES[axis]) < hi)).groupBy(*other).agg(F.avg(value).alias(value))


def neighbour_blocks(blocks: DataFrame, counts: tuple[int, int, int], periodic: bool = True) -> DataFrame:
    """mb, direction, neighbour: for the six directions the block of the same level, else the coarser, else each finer one that touches."""
    rows = []
    for axis, n in zip(("lx1", "lx2", "lx3"), counts, strict=True):
        for step, name in ((1, f"+{axis[-1]}"), (-1, f"-{axis[-1]}")):
            size = F.lit(n) * F.pow(F.lit(2), F.col("level")).cast("int")
            target = F.pmod(F.col(axis) + step, size) if periodic else F.col(axis) + step
            rows.append(blocks.select("mb", "level", F.lit(name).alias("direction"), F.lit(axis).alias("axis"), F.lit(step).alias("step"), *[(target if a == axis else F.col(a)).cast("int").alias(a) for a in ("lx1", "lx2", "lx3")]))
    want = rows[0]
    for r in rows[1:]:
        want = want.unionByName(r)
    key = ["level", "lx1", "lx2", "lx3"]
    have = blocks.select(F.col("mb").alias("neighbour"), *key)
    same = want.join(have, key).select("mb", "direction", "neighbour", F.lit(0).alias("rank"))
    up = want.withColumn("level", F.col("level") - 1).withColumns({a: F.floor(F.col(a) / 2).cast("int") for a in key[1:]})
    coarse = up.join(have, key).select("mb", "direction", "neighbour", F.lit(1).alias("rank"))
    finer = have.select("neighbour", (F.col("level") - 1).alias("level"), *[F.floor(F.col(a) / 2).cast("int").alias(a) for a in key[1:]], *[F.col(a).alias(f"f{a}") for a in key[1:]])
    side = F.when(F.col("step") > 0, 0).otherwise(1)
    touches = F.pmod(F.when(F.col("axis") == "lx1", F.col("flx1")).when(F.col("axis") == "lx2", F.col("flx2")).otherwise(F.col("flx3")), F.lit(2)) == side
    fine = want.join(finer, key).where(touches).select("mb", "direction", "neighbour", F.lit(2).alias("rank"))
    found = same.unionByName(coarse).unionByName(fine)
    best = F.min("rank").over(Window.partitionBy("mb", "direction"))
    return found.withColumn("best", best).where("rank = best").select("mb", "direction", "neighbour")


def wrap(value: Column, lo: float, hi: float) -> Column:
    span = hi - lo
    return (F.pmod(F.pmod(value - lo, F.lit(span)) + span, F.lit(span))) + lo


def deposit(particles: DataFrame, axes: dict[str, tuple[Column, float, float, int]], normalize: bool = True) -> DataFrame:
    """Counts of particles in cells, empty cells too; by the mean if ``normalize``. ``axes``: name -> (position, lo, hi, cells)."""
    cell = [F.least(F.floor((wrap(c, lo, hi) - lo) / (hi - lo) * n), F.lit(n - 1)).cast("int").alias(a) for a, (c, lo, hi, n) in axes.items()]
    counts = particles.select(*cell).groupBy(*axes).agg(F.count("*").alias("n"))
    total = 1
    for _, _, _, n in axes.values():
        total *= n
    rest, index = F.col("id"), {}
    for a, (_, _, _, n) in reversed(axes.items()):
        index[a] = (rest % n).cast("int")
        rest = F.floor(rest / n)
    grid = particles.sparkSession.range(total).select(*[index[a].alias(a) for a in axes])
    full = grid.join(counts, list(axes), "left").withColumn("density", F.coalesce("n", F.lit(0)).cast("double")).drop("n")
    if not normalize:
        return full
    # the mean is particles over cells; a row with the total is broadcast
    mean = counts.agg((F.coalesce(F.sum("n"), F.lit(0)) / total).alias("mean"))
    full = full.crossJoin(F.broadcast(mean))
    return full.withColumn("density", F.when(F.col("mean") > 0, F.col("density") / F.col("mean")).otherwise(0.0)).drop("mean")
