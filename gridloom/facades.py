"""A snapshot's analyses by field names, with ranges and defaults of their own; results are remembered by name."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import aggregates as A
from gridloom.operators import lattice as L
from gridloom.operators import mesh, pairs, spectral, surface

PLANES = {"x": ("y", "z"), "y": ("x", "z"), "z": ("x", "y")}
#: A radial quantity whose name holds one of these is a flux, so it is taken over the sphere.
FLUXES = ("mdot", "flx")
STEPS = (1, 2, 4, 8, 16, 32, 64)
FAR = 1e-300


class Facades:
    """Mixed into Snapshot, which has table(), weight(), lattice(), results, root, bounds and periodic."""

    def _kept(self, key: str, redo: bool, make) -> DataFrame:
        if redo or key not in self.results:
            self.results[key] = make()
        return self.results[key]

    def _within(self, vert_range) -> Column | None:
        return None if vert_range is None else (self.fields("z") > vert_range[0]) & (self.fields("z") < vert_range[1])

    def _scales(self, names: list[str], scales: str | list[str]) -> list[str]:
        return [scales] * len(names) if isinstance(scales, str) else list(scales)

    def calc(self, names: list[str], operation: str = "sum", *, scale: str = "", weights: str | Column | None = "vol") -> DataFrame:
        cells = self.table(names)
        return A.calc(cells, {n: F.col(f"`{n}`") for n in names}, operation, self.weight(weights), scale)

    def extrema(self, names: list[str], *, scales: str | list[str] = "", weights: str | Column | None = "vol", vert_range=None) -> tuple[list[float], list[float]]:
        """The smallest and the largest finite value of each field over cells with a weight, strictly within a range of z."""
        cells = self.table(names)
        found = [A.extrema(cells, A.scaled(F.col(f"`{n}`"), s), self.weight(weights), self._within(vert_range)) for n, s in zip(names, self._scales(names, scales), strict=True)]
        return [lo for lo, _ in found], [hi for _, hi in found]

    def dist(self, names: list[str], *, suffix: str = "", scale: str = "log10", bins: int = 1000, weights="vol", pdf_range=None, vert_range=None, redo: bool = False) -> dict[str, DataFrame]:
        """1-D distributions over the range of the data, or a given one; moments are kept as <name><suffix>_moments."""
        out = {}
        for n in names:

            def make(n=n):
                cells = self.table([n])
                cells = cells if vert_range is None else cells.where(self._within(vert_range))
                lo, hi = pdf_range or A.extrema(cells, A.scaled(F.col(f"`{n}`"), scale), self.weight(weights))
                one = A.distribution(cells, F.col(f"`{n}`"), lo, hi, bins, self.weight(weights), scale)
                self.results[f"dist_{n}{suffix}_moments"] = A.moments(one, lo, hi, bins)
                return one

            out[n] = self._kept(f"dist_{n}{suffix}", redo, make)
        return out

    def dist2d(self, names: tuple[str, str], *, suffix: str = "", scales=("log10", "log10"), weightnorm: bool = True, bins=200, weights="vol", pdf_range=None, vert_range=None, redo: bool = False) -> DataFrame:
        def make():
            cells = self.table(list(names))
            cells = cells if vert_range is None else cells.where(self._within(vert_range))
            x, y = (A.scaled(F.col(f"`{n}`"), s) for n, s in zip(names, self._scales(list(names), scales), strict=True))
            (xr, yr) = pdf_range or (A.extrema(cells, x, self.weight(weights)), A.extrema(cells, y, self.weight(weights)))
            return A.distribution_2d(cells, x, y, xr, yr, (bins, bins) if isinstance(bins, int) else tuple(bins), self.weight(weights), weightnorm)

        return self._kept(f"dist2d_{names[0]}_{names[1]}{suffix}", redo, make)

    def profile(self, names: list[str], *, axis: str = "z", suffix: str = "", bins: int | None = None, weights="vol", vert_range=None, redo: bool = False, aggregate=None) -> DataFrame:
        """Weighted means and deviations along an axis; a bin a cell of the root mesh unless given. ``aggregate``: another operator of A.profile's signature."""
        k = "xyz".index(axis)

        def make():
            cells = self.table(names)
            lo, hi = self.bounds[2 * k], self.bounds[2 * k + 1]
            if vert_range is not None:
                lo, hi = vert_range
            return (aggregate or A.profile)(cells, self.fields(axis), {n: F.col(f"`{n}`") for n in names}, lo, hi, bins or self.root[k], self.weight(weights))

        return self._kept(f"profile_{axis}_{'_'.join(names)}{suffix}", redo, make)

    def vertical(self, names: list[str], **options) -> DataFrame:
        return self.profile(names, axis="z", **options)

    def radial(self, names: list[str], *, suffix: str = "", bins: int = 100, weights="vol", radial_range=None, rad_scale: str = "log", flux: bool | None = None, redo: bool = False) -> DataFrame:
        """Over log10 r from the smallest cell to the farthest corner's centre, or over r. Fluxes (by name unless told) are taken over the sphere."""

        def make():
            cells = self.table(names)
            r = self.fields("r")
            if radial_range is None:
                low, high = cells.agg(F.min(self.fields("dx")), F.max(r)).first()
                lo, hi = (math.log10(max(low, FAR)), math.log10(max(high, FAR))) if rad_scale == "log" else (0.0, high)
            else:
                lo, hi = radial_range
            own = {n: any(f in n for f in FLUXES) if flux is None else flux for n in names}
            values = {n: A.finite(F.col(f"`{n}`")) for n in names}
            plain = A.radial_profile(cells, r, values, lo, hi, bins, self.weight(weights), rad_scale == "log")
            sphere = 4 * math.pi * F.col("r") ** 2
            return plain.withColumns({n: F.col(f"`{n}`") * sphere for n in names if own[n]})

        return self._kept(f"radial_{'_'.join(names)}{suffix}", redo, make)

    def projection(self, name: str, *, axis: str = "x", weights="vol", bins: tuple[int, int] | None = None, window: str | None = None, sigma: float | None = None, redo: bool = False) -> DataFrame:
        """(px, py, value): weighted means along an axis; pixels span the cells' centres. ``window``: along the axis, on the value; ``sigma``: a Gaussian blur."""

        def make():
            cells = self.table([name])
            a, b = PLANES[axis]
            ka, kb, kc = ("xyz".index(c) for c in (a, b, axis))
            nx, ny = bins or (self.root[ka], self.root[kb])
            (xl, xh), (yl, yh) = (A.extrema(cells, self.fields(c)) for c in (a, b))
            value = F.col(f"`{name}`")
            if window:
                lo, hi = self.bounds[2 * kc], self.bounds[2 * kc + 1]
                n = self.root[kc]
                value = value * A.window(A.bin_index(self.fields(axis), lo, hi, n), n, window)
            px, py = A.bin_index(self.fields(a), xl, xh, nx), A.bin_index(self.fields(b), yl, yh, ny)
            image = A.projection(cells, px, py, value, self.weight(weights))
            return A.blurred(image, (nx, ny), sigma) if sigma else image

        return self._kept(f"projection_{name}_{axis}", redo, make)

    def projection_stack(self, name: str, axes: str = "xyz", **options) -> dict[str, DataFrame]:
        return {a: self.projection(name, axis=a, **options) for a in axes}

    def slice(self, name: str, *, zoom: int = 0, level: int = 0, xyz: list[float] | None = None, axis: str = "z") -> DataFrame:
        """The mean along an axis over a box of the level's lattice, by default a thin slab about x3 = 0."""
        box = xyz or mesh.default_slab(self.bounds, self.root, zoom, level)
        return self.lattice([name], level, box).groupBy(*[c for c in L.AXES.values() if c != L.AXES[axis]]).agg(F.avg(name).alias(name))

    def slice_coord(self, *, zoom: int = 0, level: int = 0, xyz: list[float] | None = None, axis: str = "z") -> DataFrame:
        """Where slice()'s pixels are: the means of the cells' centres along the axis."""
        box = xyz or mesh.default_slab(self.bounds, self.root, zoom, level)
        n = mesh.refined_count(self.root, level)
        cells = mesh.in_box(mesh.centres(self.cells.sparkSession, self.bounds, n), box, self.bounds, n)
        return cells.groupBy(*[c for c in L.AXES.values() if c != L.AXES[axis]]).agg(*[F.avg(c).alias(c) for c in "xyz"])

    def _box(self, level: int) -> tuple:
        n1, n2, n3 = mesh.refined_count(self.root, level)
        return (n3, n2, n1), tuple(self.bounds[2 * k + 1] - self.bounds[2 * k] for k in (2, 1, 0))

    def spectrum(self, name: str, *, bins: int = 256, level: int = 0, log: bool = False, skip: int = 0, window: bool = False, weight_name: str | None = None, redo: bool = False) -> DataFrame:
        n, box = self._box(level)
        names = [name] if weight_name is None else [name, weight_name]
        return self._kept(f"spectrum_{name}", redo, lambda: spectral.spectrum(self.lattice(names, level), name, n, box, bins, log=log, crop=skip, window=window, weight=weight_name))

    def spectrum_helmholtz(self, var: str = "vel", *, bins: int = 200, level: int = 0, log: bool = False, redo: bool = False) -> DataFrame:
        n, box = self._box(level)
        names = self._vector(var)
        return self._kept(f"spectrum_{var}_helmholtz", redo, lambda: spectral.spectrum_helmholtz(self.lattice(list(names), level), names, n, box, bins, log=log))

    def _vector(self, var: str) -> tuple[str, str, str]:
        return tuple(f"{var}{c}" for c in ("123" if var == "bcc" else "xyz"))

    def _points(self, names: list[str], weights) -> DataFrame:
        cells = self.table(names)
        at = [self.fields(c).alias(c) for c in "xyz"]
        several = [self.weight(w).alias(w) for w in weights if w not in names] if isinstance(weights, list) else []
        one = F.lit(1.0) if isinstance(weights, list) else self.weight(weights)
        return cells.select(F.struct("mb", "k", "j", "i").alias("id"), *at, one.alias("w"), *[F.col(n) for n in names], *several, *self._regions())

    def _regions(self) -> list[Column]:
        """region_x, _y, _z: the root level's block that a cell is in."""
        if "lx1" not in self.cells.columns:
            return []
        return [F.floor(F.col(f"lx{n}") / F.pow(F.lit(2.0), F.col("level"))).cast("int").alias(f"region_{a}") for n, a in ((1, "x"), (2, "y"), (3, "z"))]

    def _separations(self, bins: int, rmin: float | None, near: bool = False) -> tuple[float, float, dict]:
        size = [self.bounds[2 * k + 1] - self.bounds[2 * k] for k in range(3)]
        least = rmin or min(s / n for s, n in zip(size, self.root, strict=True))
        # an open axis is as one of twice its length: no separation is wrapped
        box = tuple(s if self.periodic[a] else 2 * s for a, s in zip("xyz", size, strict=True))
        drawn = {"regions": tuple(-(-n // b) for n, b in zip(self.root, self.block, strict=True)), "periodic": tuple(self.periodic[a] for a in "xyz")} if near and self._regions() else {}
        return least, 0.5 * math.sqrt(sum(s * s for s in size)), {"box": box} | drawn

    def sf(self, names: list[str], *, weights: str | list[str] | None = "ones", bins: int = 100, orders: int = 2, log: bool = True, sample: float = 1.0, xyz=None, rmin: float | None = None, redo: bool = False) -> DataFrame:
        """Structure functions from the smallest cell to half the diagonal. ``sample``: the share of the pairs that is drawn."""
        lo, hi, box = self._separations(bins, rmin)
        lists = weights if isinstance(weights, list) else None
        return self._kept(f"sf_{'_'.join(names)}", redo, lambda: pairs.structure_function(self._points(names, weights), names, lo if log else 0.0, hi, bins, orders, log=log, xyz=xyz, weights=lists, sample=sample, **box))

    def sf_helmholtz(self, var: str = "vel", *, weights="ones", bins: int = 100, orders: int = 2, log: bool = True, sample: float = 1.0, xyz=None, redo: bool = False) -> DataFrame:
        lo, hi, box = self._separations(bins, None)
        names = self._vector(var)
        return self._kept(f"sf_{var}_helmholtz", redo, lambda: pairs.helmholtz(self._points(list(names), weights), names, lo if log else 0.0, hi, bins, orders, log=log, xyz=xyz, sample=sample, **box))

    def sf_aniso(self, vel: str = "vel", bcc: str = "bcc", *, weights="ones", bins: int = 100, orders: int = 2, log: bool = True, sample: float = 1.0, xyz=None, near: bool = True, redo: bool = False, **angles) -> DataFrame:
        """``near``: whether a sample draws pairs of nearby blocks more often (pairs.BOOSTS, or ``boosts``)."""
        lo, hi, box = self._separations(bins, None, near)
        v, b = self._vector(vel), self._vector(bcc)
        return self._kept(f"sf_{vel}_{bcc}_aniso", redo, lambda: pairs.anisotropic(self._points([*v, *b], weights), v, b, lo if log else 0.0, hi, bins, orders=orders, log=log, xyz=xyz, sample=sample, **angles, **box))

    def area(self, t_peak: float, *, steps=STEPS, method: str = "sharp", phase: str = "cold", sigma_factor: float = 1.0, level: int = 0, redo: bool = False) -> DataFrame:
        """(step, area) of the surface of temperature ``t_peak``: "sharp" on log10 T where steps divide the mesh and the offsets' mean where they don't fit a block, or "smoothed"."""
        if not (t_peak > 0 and math.isfinite(t_peak)):
            raise ValueError("the temperature must be positive and finite")
        n, box = self._box(level)
        spacing, periodic = tuple(b / m for b, m in zip(box, n, strict=True)), tuple(self.periodic[a] for a in "zyx")
        cells = self.lattice(["temp"], level).withColumn("log_t", F.log10(F.when(F.col("temp") > 0, F.col("temp"))))
        small = min(self.block)

        def one(step: int) -> DataFrame:
            if method == "smoothed":
                inside = F.col("temp") <= t_peak if phase == "cold" else F.col("temp") >= t_peak
                return surface.smoothed_area(cells, inside, n, spacing, periodic, step, sigma_factor)
            routed = surface.isosurface_area if step <= small else surface.offset_area
            return routed(cells, "log_t", math.log10(t_peak), n, spacing, periodic, step=step)

        out = None
        for step in steps:
            key = f"area_{method}_{phase if method == 'smoothed' else ''}_{t_peak:g}_{sigma_factor:g}_{step}"
            made = self._kept(key, redo, lambda: one(step).withColumn("step", F.lit(step)).select("step", "area"))  # noqa: B023
            out = made if out is None else out.unionByName(made)
        return out
