"""Blocks of a mesh as one lattice: global cell indices, resampling to a level, stencils across blocks and levels.

Cells have (mb, k, j, i) within their block, the block's logical place (lx1, lx2, lx3,
level) and its bounds. The lattice of a level has the mesh's cells times 2^level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import lattice

#: Axis: the block's place, the cell's index in the block, the global index, the number of the axis.
AXES = {"x": ("lx1", "i", "gi", 1), "y": ("lx2", "j", "gj", 2), "z": ("lx3", "k", "gk", 3)}
GLOBAL = {a: g for a, (_, _, g, _) in AXES.items()}
BACK = {g: c for _, c, g, _ in AXES.values()}


def with_global(cells: DataFrame, block: tuple[int, int, int]) -> DataFrame:
    """``cells`` and gi, gj, gk, the indices in the lattice of the cell's level. ``block``: a block's cells (nx1, nx2, nx3)."""
    return cells.withColumns({g: (F.col(lx) * block[n - 1] + F.col(c)).cast("int") for lx, c, g, n in AXES.values()})


def spacing(cells: DataFrame) -> dict[str, Column]:
    """Cell widths by axis, from the blocks' bounds and cells (nx1.. as columns)."""
    return {a: (F.col(f"x{n}max") - F.col(f"x{n}min")) / F.col(f"nx{n}") for a, (_, _, _, n) in AXES.items()}


def refined_count(root: tuple[int, int, int], level: int) -> tuple[int, int, int]:
    """Cells of a level's lattice, as (n1, n2, n3)."""
    return tuple(n << level for n in root)


def _times(levels: Column) -> Column:
    """2 to the power of ``levels``, as an integer."""
    return F.call_function("shiftleft", F.lit(1), levels.cast("int"))


def resample(cells: DataFrame, values: list[str], level: int = 0) -> DataFrame:
    """(k, j, i, values) on the lattice of ``level``: coarser cells repeat, finer ones are averaged by volume.

    ``cells`` has gk, gj, gi and level. Repeating needs no shuffle; averages are summed before one.
    """
    g = list(BACK)
    whole = cells.select(*g, "level", *values).where(F.col("level") <= level)
    for name in g:
        times = _times(F.lit(level) - F.col("level"))
        whole = whole.withColumn("_n", times).withColumn("_d", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn(name, (F.col(name) * F.col("_n") + F.col("_d")).cast("int")).drop("_n", "_d")
    up = F.col("level") - level
    fine = cells.select(*g, "level", *values).where(F.col("level") > level).withColumn("_w", F.pow(F.lit(8.0), F.lit(level) - F.col("level")))
    fine = fine.groupBy(*[F.floor(F.col(name) / _times(up)).cast("int").alias(name) for name in g]).agg(*[(F.sum(F.col(v) * F.col("_w")) / F.sum("_w")).alias(v) for v in values])
    return whole.select(*g, *[F.col(v).cast("double").alias(v) for v in values]).unionByName(fine).withColumnsRenamed(BACK)


def in_box(lattice_: DataFrame, xyz: list[float] | None, bounds: list[float], n: tuple[int, int, int]) -> DataFrame:
    """The lattice's cells in a box, from int((lo - min) / width) up to, not with, int((hi - min) / width) along each axis."""
    for (_, c, _, m), k in zip(AXES.values(), range(3), strict=True):
        if xyz:
            lo, hi = bounds[2 * k], bounds[2 * k + 1]
            at = [int((b - lo) * n[m - 1] / (hi - lo)) for b in (xyz[2 * k], xyz[2 * k + 1])]
            lattice_ = lattice_.where((F.col(c) >= at[0]) & (F.col(c) < max(at[1], at[0] + 1)))
    return lattice_


def default_slab(bounds: list[float], root: tuple[int, int, int], zoom: int = 0, level: int = 0) -> list[float]:
    """A thin slab about x3 = 0, the middle 2^-zoom of the mesh."""
    x1, x2, x3 = bounds[:2], bounds[2:4], bounds[4:]
    return [b / 2**zoom for b in x1 + x2] + [b / 2**level / root[2] for b in x3]


def centres(spark: SparkSession, bounds: list[float], n: tuple[int, int, int]) -> DataFrame:
    """(k, j, i, x, y, z, dx, dy, dz): the uniform lattice of n cells within the bounds, made where it is read."""
    n1, n2, n3 = n
    at = spark.range(n1 * n2 * n3).select((F.floor(F.col("id") / (n1 * n2))).cast("int").alias("k"), (F.floor(F.col("id") / n1) % n2).cast("int").alias("j"), (F.col("id") % n1).cast("int").alias("i"))
    width = [(bounds[2 * k + 1] - bounds[2 * k]) / n[k] for k in range(3)]
    at = at.withColumns({a: F.lit(bounds[2 * k]) + (F.col(c) + 0.5) * width[k] for k, (a, c) in enumerate(zip("xyz", "ijk", strict=True))})
    return at.withColumns({f"d{a}": F.lit(width[k]) for k, a in enumerate("xyz")})


def faces(spark: SparkSession, lo: float, hi: float, n: int) -> DataFrame:
    """(face, at): the n + 1 cell faces of an axis."""
    return spark.range(n + 1).select(F.col("id").cast("int").alias("face"), (F.lit(lo) + F.col("id") * ((hi - lo) / n)).alias("at"))


def blocks(cells: DataFrame) -> DataFrame:
    """A row a block: place, level, bounds, number of cells and volume."""
    bounds = [f"x{n}{m}" for n in (1, 2, 3) for m in ("min", "max")]
    out = cells.groupBy("mb", "lx1", "lx2", "lx3", "level", *bounds).agg(F.count("*").alias("cells"))
    return out.withColumn("volume", (F.col("x1max") - F.col("x1min")) * (F.col("x2max") - F.col("x2min")) * (F.col("x3max") - F.col("x3min")))


def box_class(blocks_: DataFrame, xyz: list[float]) -> DataFrame:
    """``blocks_`` and ``region``: inside, partial or outside a box. Outside ones needn't be read."""
    lo, hi = zip(*[(F.col(f"x{k + 1}min"), F.col(f"x{k + 1}max")) for k in range(3)], strict=True)
    out = inside = None
    for k in range(3):
        o, w = (hi[k] < xyz[2 * k]) | (lo[k] > xyz[2 * k + 1]), (lo[k] >= xyz[2 * k]) & (hi[k] <= xyz[2 * k + 1])
        out, inside = (o, w) if out is None else (out | o, inside & w)
    return blocks_.withColumn("region", F.when(out, "outside").when(inside, "inside").otherwise("partial"))


def with_ghosts(cells: DataFrame, values: list[str], block: tuple[int, int, int]) -> DataFrame:
    """``cells`` (with g*, level, _h* and ``values``) and _ghost: where levels meet, what stands beside the finer and the coarser cells.

    Only cells at block faces are sent: each as its eight children, and each eight that
    have a parent of their own as that parent. Neighbouring blocks differ by one level at most.
    """
    shown = [*GLOBAL.values(), "level", *values]
    real = cells.withColumn("_ghost", F.lit(False))
    near = lambda wide: [(F.col(c) < wide) | (F.col(c) >= block[n - 1] - wide) for _, c, _, n in AXES.values()]
    edge, wide = near(1), near(2)
    children = cells.where(edge[0] | edge[1] | edge[2]).select(*shown)
    for g in GLOBAL.values():
        children = children.withColumn("_d", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(g, (F.col(g) * 2 + F.col("_d")).cast("int")).drop("_d")
    children = children.withColumn("level", F.col("level") + 1)
    parents = cells.where((F.col("level") > 0) & (wide[0] | wide[1] | wide[2])).groupBy(*[F.floor(F.col(g) / 2).cast("int").alias(g) for g in GLOBAL.values()], (F.col("level") - 1).alias("level")).agg(*[F.avg(v).alias(v) for v in values])
    ghosts = children.unionByName(parents).withColumn("_ghost", F.lit(True))
    return real.unionByName(ghosts, allowMissingColumns=True)


def stencil(operator, cells: DataFrame, values: str | tuple[str, ...], block: tuple[int, int, int], root: tuple[int, int, int], periodic: dict[str, bool], *, levels: bool = True, edge_order: int = 1) -> DataFrame:
    """lattice.gradient, divergence or curl over all blocks: cells' neighbours are the cells beside them, whatever their block.

    Between levels the neighbour is the coarser cell, or the mean of the finer ones, at its
    own width: first order. ``levels``: whether there may be several.
    """
    names = [values] if isinstance(values, str) else list(dict.fromkeys(values))
    whole = with_global(cells, block)
    whole = whole.withColumns({f"_h{a}": w for a, w in spacing(whole).items()})
    if levels:
        whole = with_ghosts(whole, names, block)
    n = {a: F.lit(root[k - 1]) * _times(F.col("level")) for a, (_, _, _, k) in AXES.items()}
    out = operator(whole, values, {a: F.col(f"_h{a}") for a in "xyz"}, periodic, index=GLOBAL, n=n, by=("level",), edge_order=edge_order)
    out = out.where(~F.col("_ghost")).drop("_ghost") if levels else out
    return out.drop(*[f"_h{a}" for a in "xyz"])


gradient, divergence, curl = ((lambda *args, _f=f, **options: stencil(_f, *args, **options)) for f in (lattice.gradient, lattice.divergence, lattice.curl))
