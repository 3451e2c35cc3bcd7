"""Weighted aggregates, distributions, profiles and projections: bin ids and grouped sums.

Every operator is one pass: a bin id is arithmetic on the value, groups are
partially aggregated before the shuffle, and what is shuffled is a row a bin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column, neginf: float = 0.0) -> Column:
    """NULL, NaN and infinities become 0 (minus infinity: ``neginf``)."""
    return F.when(c == float("-inf"), F.lit(neginf)).when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def scaled(c: Column, scale: str = "") -> Column:
    if scale not in ("", "linear", "log10", "log", "ln"):
        raise ValueError(f"unknown scale {scale!r}")
    return F.log10(F.when(c > 0, c)) if scale in ("log10", "log") else F.log(F.when(c > 0, c)) if scale == "ln" else c


def calc(cells: DataFrame, values: dict[str, Column], operation: str = "sum", weights: Column | None = None, scale: str = "") -> DataFrame:
    """One row, a column a value: sum(f w), min(f), max(f) or sum(f w) / sum(w) (0 if the weights aren't positive)."""
    w = F.lit(1.0) if weights is None else weights
    clean = {n: finite(scaled(v, scale)) for n, v in values.items()}
    made = {
        "sum": lambda v: F.sum(v * w), "min": F.min, "max": F.max,
        "average": lambda v: F.when(F.sum(w) > 0, F.sum(v * w) / F.sum(w)).otherwise(0.0),
    }.get(operation)
    if made is None:
        raise ValueError(f"unknown operation {operation!r}")
    return cells.agg(*[made(v).alias(n) for n, v in clean.items()])


def extrema(cells: DataFrame, value: Column, weights: Column | None = None, within: Column | None = None) -> tuple[float, float]:
    """Smallest and largest finite value with a non-zero weight."""
    valid = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    for also in ([weights != 0] if weights is not None else []) + ([within] if within is not None else []):
        valid = valid & also
    lo, hi = cells.agg(F.min(F.when(valid, value)), F.max(F.when(valid, value))).first()
    if lo is None:
        raise ValueError("no valid values")
    return lo, hi


def bin_index(value: Column, lo: float, hi: float, bins: int) -> Column:
    """0 .. bins - 1 for lo <= value <= hi (the last bin is closed), else NULL."""
    k = F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return F.when((value >= lo) & (value <= hi), k)


def distribution(cells: DataFrame, value: Column, lo: float, hi: float, bins: int, weights: Column, scale: str = "") -> DataFrame:
    """bin, loc, dat: the weighted density over all bins, empty ones too."""
    width = (hi - lo) / bins
    kept = cells.select(bin_index(finite(scaled(value, scale)), lo, hi, bins).alias("bin"), weights.alias("w")).where("bin IS NOT NULL")
    sums = kept.groupBy("bin").agg(F.sum("w").alias("w"))
    every = cells.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = every.join(F.broadcast(sums), "bin", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))  # a row a bin
    norm = F.sum("w").over(Window.partitionBy()) * width
    return full.select("bin", (F.lit(lo) + (F.col("bin") + 0.5) * width).alias("loc"), F.when(norm > 0, F.col("w") / norm).otherwise(0.0).alias("dat"))


def moments(dist: DataFrame, lo: float, hi: float, bins: int) -> DataFrame:
    """mean, rms, sigma and the third and fourth central moments of a distribution."""
    p = F.col("dat") * ((hi - lo) / bins)
    first = dist.agg(F.sum(p * F.col("loc")).alias("mean"), F.sqrt(F.sum(p * F.col("loc") ** 2)).alias("rms"))
    joined = dist.crossJoin(F.broadcast(first))  # one row
    d = F.col("loc") - F.col("mean")
    return joined.groupBy("mean", "rms").agg(F.sum(p * d**3).alias("skew"), F.sum(p * d**4).alias("kurtosis")).withColumn("sigma", F.sqrt(F.greatest(F.col("rms") ** 2 - F.col("mean") ** 2, F.lit(0.0))))


def _bins(spark, n: int, name: str) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias(name))


def distribution_2d(cells: DataFrame, x: Column, y: Column, xr: tuple, yr: tuple, bins: tuple[int, int], weights: Column, weightnorm: bool = True) -> DataFrame:
    """bx, by, loc1, loc2 (the pixel's lower edges) and dat over all pixels, empty ones too; density by weight, or by area."""
    spark, (nx, ny) = cells.sparkSession, bins
    kept = cells.select(bin_index(finite(x), *xr, nx).alias("bx"), bin_index(finite(y), *yr, ny).alias("by"), weights.alias("w")).where("bx IS NOT NULL AND by IS NOT NULL")
    width, height = (xr[1] - xr[0]) / nx, (yr[1] - yr[0]) / ny
    norm = F.sum("w").over(Window.partitionBy()) * (width * height) if weightnorm else F.lit(width * height * nx * ny)
    sums = kept.groupBy("bx", "by").agg(F.sum("w").alias("w"))
    pixels = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("bx"), F.floor(F.col("id") / nx).cast("int").alias("by"))
    full = pixels.join(sums, ["bx", "by"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))  # a row a pixel
    return full.select("bx", "by", (F.lit(xr[0]) + F.col("bx") * width).alias("loc1"), (F.lit(yr[0]) + F.col("by") * height).alias("loc2"), F.when(norm != 0, F.col("w") / norm).otherwise(0.0).alias("dat"))


def profile(cells: DataFrame, along: Column, values: dict[str, Column], lo: float, hi: float, bins: int, weights: Column) -> DataFrame:
    """bin, coord, norm (the weights' sum) and for each value its weighted mean and deviation in the bin; all bins, 0 in empty ones."""
    at = bin_index(along, lo, hi, bins).alias("bin")
    kept = cells.select(at, weights.alias("w"), *[v.alias(n) for n, v in values.items()]).where("bin IS NOT NULL")
    sums = kept.groupBy("bin").agg(F.sum("w").alias("w"), *[F.sum(F.col(n) * F.col("w")).alias(f"{n}_1") for n in values], *[F.sum(F.col(n) ** 2 * F.col("w")).alias(f"{n}_2") for n in values])
    full = _bins(cells.sparkSession, bins, "bin").join(F.broadcast(sums), "bin", "left")  # a row a bin
    mean = lambda n, p: F.when(F.col("w") > 0, F.col(f"{n}_{p}") / F.col("w")).otherwise(0.0)
    out = [c for n in values for c in (mean(n, 1).alias(n), F.sqrt(F.greatest(mean(n, 2) - mean(n, 1) ** 2, F.lit(0.0))).alias(f"{n}_sigma"))]
    return full.select("bin", (F.lit(lo) + (F.col("bin") + 0.5) * ((hi - lo) / bins)).alias("coord"), F.coalesce("w", F.lit(0.0)).cast("double").alias("norm"), *out)


def radial_profile(cells: DataFrame, r: Column, values: dict[str, Column], lo: float, hi: float, bins: int, weights: Column, log: bool = True, flux: bool = False) -> DataFrame:
    """A profile over log10 r (or r); fluxes are taken over the sphere, 4 pi r^2."""
    along = F.when(r > 0, F.log10(r)).otherwise(-2.0) if log else r  # the origin counts as far inside
    out = profile(cells, along, values, lo, hi, bins, weights)
    radius = F.pow(F.lit(10.0), F.col("coord")) if log else F.col("coord")
    out = out.withColumn("r", radius)
    return out.withColumns({n: F.col(n) * 4 * math.pi * radius**2 for n in values}) if flux else out


def projection(cells: DataFrame, px: Column, py: Column, value: Column, weights: Column) -> DataFrame:
    """px, py and the weighted mean along the line of sight."""
    sums = cells.groupBy(px.alias("px"), py.alias("py")).agg(F.sum(finite(value) * weights).alias("s"), F.sum(weights).alias("w"))
    return sums.select("px", "py", F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0).alias("value"))


def window(index: Column, n: int, kind: str = "hamming", beta: float = 14.0) -> Column:
    """A window of ``n`` places over their root mean square."""
    import numpy as np

    shape = np.kaiser(n, beta) if kind == "kaiser" else {"hamming": np.hamming, "hanning": np.hanning, "blackman": np.blackman}[kind](n)
    if n <= 4096:  # as a literal; longer windows are expressions
        return F.get(F.array(*[F.lit(float(v)) for v in shape / np.sqrt((shape**2).mean())]), index.cast("int"))
    t = 2 * math.pi * index / (n - 1)
    wave = {"hamming": 0.54 - 0.46 * F.cos(t), "hanning": 0.5 - 0.5 * F.cos(t), "blackman": 0.42 - 0.5 * F.cos(t) + 0.08 * F.cos(2 * t)}[kind]
    return wave / float(np.sqrt((shape**2).mean()))


def blurred(image: DataFrame, size: tuple[int, int], sigma: float, value: str = "value") -> DataFrame:
    """An image (px, py, ``value``) after a Gaussian of ``sigma`` pixels, cut at 4 sigma, edges mirrored: one axis after the other, each a join of a row with its kernel."""
    import numpy as np

    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    taps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(w)).alias("w")) for d, w in zip(range(-reach, reach + 1), kernel, strict=True)])
    for axis, n in (("px", size[0]), ("py", size[1])):
        other = "py" if axis == "px" else "px"
        # where each pixel is seen from: a tap of the target, mirrored at the edges, lands on it
        targets = image.sparkSession.range(n).select(F.col("id").cast("int").alias("to"), F.explode(taps).alias("tap"))
        m = F.pmod(F.col("to") + F.col("tap.d"), F.lit(2 * n))
        seen = targets.select("to", F.when(m < n, m).otherwise(2 * n - 1 - m).cast("int").alias(axis), F.col("tap.w").alias("w")).groupBy("to", axis).agg(F.sum("w").alias("w"))
        image = image.join(F.broadcast(seen), axis).groupBy(F.col("to").alias(axis), other).agg(F.sum(F.col(value) * F.col("w")).alias(value))  # pixels along an axis times taps
    return image.select("px", "py", value)


def relative_to_profile(cells: DataFrame, values: dict[str, Column], lo: float, hi: float, bins: int, along: Column, weights: Column, suffix: str = "", of: DataFrame | None = None) -> DataFrame:
    """cells and p_<name><suffix>: the value in the cell's bin of the vertical profile, of ``cells`` or of ``of``. The profile is a row a bin, so it is broadcast.

    Weights that are alike round their sum to one side, so the means are corrected by the mean of what is left over them.
    """
    at, of = bin_index(along, lo, hi, bins), cells if of is None else of
    p = profile(of, along, values, lo, hi, bins, weights).select("bin", *[F.col(n).alias(f"p_{n}{suffix}") for n in values])
    kept = of.select(at.alias("bin"), weights.alias("_w"), *[v.alias(f"_{n}") for n, v in values.items()]).where("bin IS NOT NULL").join(F.broadcast(p), "bin")
    over = kept.groupBy("bin").agg(*[finite(F.try_divide(F.sum(F.col("_w") * (F.coalesce(f"_{n}", F.lit(0.0)) - F.col(f"p_{n}{suffix}"))), F.sum("_w"))).alias(f"_{n}") for n in values])
    p = p.join(F.broadcast(over), "bin", "left").select("bin", *[(F.col(f"p_{n}{suffix}") + F.coalesce(f"_{n}", F.lit(0.0))).alias(f"p_{n}{suffix}") for n in values])
    return cells.withColumn("bin", at).join(F.broadcast(p), "bin", "left").drop("bin")
