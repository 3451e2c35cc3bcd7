"""Areas of isosurfaces by marching tetrahedra: each cube of eight neighbouring cell centres is cut into six tetrahedra."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CORNERS = np.array([[c >> 2 & 1, c >> 1 & 1, c & 1] for c in range(8)], float)  # z, y, x
TETRAHEDRA = ((0, 1, 3, 7), (0, 1, 5, 7), (0, 2, 3, 7), (0, 2, 6, 7), (0, 4, 5, 7), (0, 4, 6, 7))


def _triangle(a, b, c):
    return 0.5 * np.linalg.norm(np.cross(b - a, c - a), axis=-1)


def cube_areas(values: np.ndarray, iso: float, spacing: tuple[float, float, float]) -> np.ndarray:
    """The area within each cube (rows of 8 corners in the order of CORNERS)."""
    corners, area = CORNERS * np.array(spacing), np.zeros(len(values))
    for tet in TETRAHEDRA:
        v, p = values[:, tet], corners[list(tet)]
        order = np.argsort(v, axis=1)
        v, p = np.take_along_axis(v, order, 1), p[order]
        above = (v > iso).sum(1)
        cut = lambda rows, a, b: p[rows, a] + ((iso - v[rows, a]) / (v[rows, b] - v[rows, a]))[:, None] * (p[rows, b] - p[rows, a])  # noqa: B023, E731
        for n in (1, 2, 3):
            rows = np.flatnonzero(above == n)
            if not len(rows):
                continue
            if n == 2:
                q = [cut(rows, a, b) for a, b in ((0, 2), (0, 3), (1, 3), (1, 2))]
                area[rows] += _triangle(q[0], q[1], q[2]) + _triangle(q[0], q[2], q[3])
            else:
                one, others = (3, (0, 1, 2)) if n == 1 else (0, (1, 2, 3))
                q = [cut(rows, min(one, o), max(one, o)) for o in others]
                area[rows] += _triangle(*q)
    return area


#: Cells of a tile's edge.
TILE = 32


def _size(n: tuple[int, int, int], step: int) -> list[int]:
    if step <= 0 or any(m % step for m in n):
        raise ValueError(f"a step of {step} doesn't divide {n} cells")
    return [m // step for m in n]


def _tiles(cells: DataFrame, size: list[int], periodic: tuple[bool, bool, bool], tile: int, halo: int) -> DataFrame:
    """(tk, tj, ti, k, j, i, v): each cell in its tile, and in those within ``halo`` cells and one more above; k, j, i from the tile's corner.

    What a cell is sent to more than once is the tiles' faces, not its eight cubes.
    """
    for c, m, wrap in zip("kji", size, periodic, strict=True):
        turns = -(-(halo + 1) // m) if wrap else 0
        cells = cells.withColumn(f"_g{c}", F.explode(F.array(*[F.col(c) + t * m for t in range(-turns, turns + 1)])) if wrap else F.col(c)).where(F.col(f"_g{c}").between(-halo, m + halo))
        g, last = F.col(f"_g{c}"), (m - 1) // tile
        low, high = F.greatest(F.ceil((g - halo - tile) / tile), F.lit(0)), F.least(F.floor((g + halo) / tile), F.lit(last))
        cells = cells.withColumn(f"t{c}", F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))))
        cells = cells.withColumn(c, (g - F.col(f"t{c}") * tile).cast("int")).drop(f"_g{c}")
    return cells


def _sampled(cells: DataFrame, value: str, size: list[int], step: int, offset: tuple[int, int, int]) -> DataFrame:
    """Every ``step``-th cell from ``offset`` (k, j, i) on, its indices counted in steps."""
    there = [F.pmod(F.col(c) - o, F.lit(step)) == 0 for c, o in zip("kji", offset, strict=True)]
    here = [F.pmod(F.floor((F.col(c) - o) / step), F.lit(m)).cast("int").alias(c) for c, o, m in zip("kji", offset, size, strict=True)]
    return cells.where(there[0] & there[1] & there[2]).select(*here, F.col(value).cast("double").alias("v"))


def _crossed(a: np.ndarray, iso: float, spacing) -> float:
    """The area within the cubes of a block of values; cubes with a NaN corner don't count."""
    n = [m - 1 for m in a.shape]
    corners = np.stack([a[z : z + n[0], y : y + n[1], x : x + n[2]].ravel() for z, y, x in CORNERS.astype(int)], 1)
    low, high = corners.min(1), corners.max(1)
    return float(cube_areas(corners[(low <= iso) & (high > iso)], iso, spacing).sum())


def _dense(pdf: pd.DataFrame, tile: int, halo: int) -> np.ndarray:
    a = np.full((tile + 1 + 2 * halo,) * 3, np.nan)
    a[tuple(pdf[c].to_numpy() + halo for c in "kji")] = pdf["v"].to_numpy()
    return a


def isosurface_area(cells: DataFrame, value: str, iso: float, n: tuple[int, int, int], spacing: tuple[float, float, float], periodic: tuple[bool, bool, bool] = (True, True, True), step: int = 1, offset: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """One row: area of value == iso over the lattice (k, j, i) of every ``step``-th cell from ``offset`` on. Cubes without all corners don't count.

    n, spacing, periodic and offset are in the order z, y, x. A step that doesn't divide the lattice is an error.
    Tiles whose values don't cross the level give 0 at once; wherever block faces lie, cubes meet their corners.
    """
    size = _size(n, step)
    wide = tuple(step * s for s in spacing)

    def areas(pdf: pd.DataFrame) -> pd.DataFrame:
        crosses = pdf["v"].min() <= iso < pdf["v"].max()
        return pd.DataFrame({"area": [_crossed(_dense(pdf, TILE, 0), iso, wide) if crosses else 0.0]})

    tiles = _tiles(_sampled(cells, value, size, step, offset), size, periodic, TILE, 0)
    return tiles.groupBy("tk", "tj", "ti").applyInPandas(areas, "area double").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"))


def offset_area(cells: DataFrame, value: str, iso: float, n, spacing, periodic=(True, True, True), step: int = 1, offsets: str = "half") -> DataFrame:
    """The mean area over samplings of every ``step``-th cell from 0, and along periodic axes also from step / 2, of those that cross the level."""
    if offsets not in ("none", "half"):
        raise ValueError(f"unknown offsets {offsets!r}")
    starts = [[0] if offsets == "none" or not wrap else sorted({0, step // 2}) for wrap in periodic]
    out = None
    for offset in ((k, j, i) for k in starts[0] for j in starts[1] for i in starts[2]):
        one = isosurface_area(cells, value, iso, n, spacing, periodic, step, offset)
        out = one if out is None else out.unionByName(one)
    return out.agg(F.coalesce(F.avg(F.when(F.col("area") > 0, F.col("area"))), F.lit(0.0)).alias("area"))


def smoothed_area(cells: DataFrame, inside: Column, n, spacing, periodic=(True, True, True), step: int = 1, sigma_factor: float = 1.0) -> DataFrame:
    """The area of the half level of the indicator ``inside`` (0 or 1) after a Gaussian of sigma_factor * step cells, cut at 4 sigma.

    Beyond open ends the last value goes on. A tile carries a halo of the kernel's reach.
    """
    if step <= 0 or sigma_factor <= 0:
        raise ValueError("step and sigma_factor must be positive")
    sigma = sigma_factor * step
    reach, size = int(4 * sigma + 0.5), list(n)
    tile = max(TILE, reach)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()

    def areas(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a = _dense(pdf, tile, reach)
        for axis, (t, m, wrap) in enumerate(zip(key, size, periodic, strict=True)):
            at = np.arange(-reach, tile + reach + 1) + t * tile
            if not wrap:  # the last value goes on
                a = a.take(np.clip(at, 0, m - 1) - t * tile + reach, axis)
            lines = np.lib.stride_tricks.sliding_window_view(a, 2 * reach + 1, axis)
            a = lines @ kernel
            beyond = np.flatnonzero(at[reach : reach + a.shape[axis]] > m - (not wrap))
            a[tuple(beyond if x == axis else slice(None) for x in range(3))] = np.nan
        return pd.DataFrame({"area": [_crossed(a, 0.5, spacing)]})

    marked = cells.select("k", "j", "i", F.when(inside, 1.0).otherwise(0.0).alias("v"))
    tiles = _tiles(marked, size, periodic, tile, reach)
    return tiles.groupBy("tk", "tj", "ti").applyInPandas(areas, "area double").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"))


def interface_levels(cells: DataFrame, temperature: Column, level: float, buffer: int = 1) -> DataFrame:
    """(x3min, log_t) of the layers of blocks about the one whose mean log10 block temperature is nearest to ``level``, ``buffer`` on either side.

    A block's temperature is that of its mean energy over its mean density where ``temperature``
    is an aggregate expression such as avg(eint) / avg(dens) times a constant.
    """
    layers = cells.groupBy("x3min", "mb").agg(F.log10(temperature).alias("t")).groupBy("x3min").agg(F.avg("t").alias("log_t"))  # a row a layer
    order = Window.orderBy("x3min")
    ranked = layers.withColumn("n", F.row_number().over(order))
    nearest = ranked.agg(F.min_by("n", F.struct(F.abs(F.col("log_t") - math.log10(level)), F.col("n"))).alias("at"))
    return ranked.crossJoin(F.broadcast(nearest)).where(F.abs(F.col("n") - F.col("at")) <= buffer).select("x3min", "log_t")
