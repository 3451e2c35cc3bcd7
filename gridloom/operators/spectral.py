"""Power spectra: a transform of each plane, a shuffle to lines, a transform of each line, and sums over shells.

Planes leave as one row a line, with the values of all components side by side, and
lines are summed over shells where they are transformed: what is shuffled is the cube
once, then a row a line and shell. Cells that aren't there count as 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hamming(n: int) -> np.ndarray:
    w = np.hamming(n)
    return w / np.sqrt((w * w).mean())


def _planes(cells: DataFrame, values: list[str], n: tuple[int, int, int], crop: int = 0, window: bool = False) -> DataFrame:
    """(k, ky, line): of each plane's lines the 2-D transform, complex values of all components one after another."""
    nz, ny, nx = n
    along = hamming(nz) if window else np.ones(nz)

    def plane(pdf: pd.DataFrame) -> pd.DataFrame:
        a, k = np.zeros((len(values), ny, nx)), int(pdf["k"].iloc[0])
        for c in range(len(values)):
            a[c, pdf["j"], pdf["i"]] = pdf[f"v{c}"]
        f = np.fft.fft2(a) * along[k]
        return pd.DataFrame({"k": k, "ky": np.arange(ny), "line": [f[:, y].tobytes() for y in range(ny)]})

    inside = cells.withColumn("k", (F.col("k") - crop).cast("int")).where((F.col("k") >= 0) & (F.col("k") < nz)) if crop else cells
    return inside.select("k", "j", "i", *[F.col(f"`{v}`").cast("double").alias(f"v{c}") for c, v in enumerate(values)]).groupBy("k").applyInPandas(plane, "k int, ky int, line binary")


def _lines(pdf: pd.DataFrame, components: int, n: tuple[int, int, int]) -> np.ndarray:
    """(component, kz, kx) of one ky: the 3-D transform over sqrt(cells)."""
    nz, ny, nx = n
    a = np.zeros((components, nz, nx), complex)
    for k, line in zip(pdf["k"], pdf["line"], strict=True):
        a[:, k] = np.frombuffer(line, complex).reshape(components, nx)
    return np.fft.fft(a, axis=1) / np.sqrt(nz * ny * nx)


def transform(cells: DataFrame, value: str, n: tuple[int, int, int]) -> DataFrame:
    """kz, ky, kx, re, im of the 3-D transform over sqrt(cells). A task holds a plane, then a block of lines."""

    def modes(pdf: pd.DataFrame) -> pd.DataFrame:
        f = _lines(pdf, 1, n)[0].ravel()
        kz, kx = np.divmod(np.arange(n[0] * n[2]), n[2])
        return pd.DataFrame({"kz": kz, "ky": int(pdf["ky"].iloc[0]), "kx": kx, "re": f.real, "im": f.imag})

    return _planes(cells, [value], n).groupBy("ky").applyInPandas(modes, "kz int, ky int, kx int, re double, im double")


class Shells:
    """bins - 1 linear shells up to the largest wave number, or ``bins`` logarithmic ones from a quarter of the smallest."""

    def __init__(self, n: tuple[int, int, int], box: tuple[float, float, float], bins: int, log: bool = False):
        self.top, self.log = min(m / length for m, length in zip(n, box, strict=True)), log
        self.bins = bins if log else bins - 1
        self.low = 0.25 * min(1 / length for length in box) if log else 0.0
        if log:
            self.edges = np.logspace(np.log10(self.low), np.log10(self.top), self.bins + 1)
        else:
            self.edges = np.linspace(0.0, self.top, self.bins + 1)

    def index(self, k: np.ndarray) -> np.ndarray:
        """The shell of each wave number; -1: none."""
        at = np.searchsorted(self.edges, k, "right") - 1
        at[k == self.edges[-1]] = self.bins - 1
        return np.where((k >= self.edges[0]) & (k <= self.edges[-1]), at, -1)


def _shell_sums(cells: DataFrame, values: list[str], powers: list[str], power, n, box, shells: Shells, crop: int = 0, window: bool = False) -> DataFrame:
    """bin, nk, k and for each power its sum, mean and 4 pi k^2 mean. ``power``: transforms and (kz, ky, kx) to arrays, one a power."""
    freq = [np.fft.fftfreq(m) * m / length for m, length in zip(n, box, strict=True)]

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        kz, ky, kx = freq[0][:, None], freq[1][int(pdf["ky"].iloc[0])], freq[2][None, :]
        at = shells.index(np.sqrt(kz**2 + ky**2 + kx**2).ravel())
        inside = at >= 0
        out = {"nk": np.bincount(at[inside], minlength=shells.bins)}
        for name, p in zip(powers, power(_lines(pdf, len(values), n), (kz, ky, kx)), strict=True):
            out[name] = np.bincount(at[inside], p.ravel()[inside], shells.bins)
        some = np.flatnonzero(out["nk"])
        return pd.DataFrame({"bin": some} | {c: v[some] for c, v in out.items()})

    lines = _planes(cells, values, n, crop, window).groupBy("ky").applyInPandas(sums, "bin int, nk long, " + ", ".join(f"{p} double" for p in powers))
    out = lines.groupBy("bin").agg(F.sum("nk").alias("nk"), *[F.sum(p).alias(p) for p in powers])
    mid = F.array(*[F.lit(float(m)) for m in 0.5 * (shells.edges[1:] + shells.edges[:-1])])
    out = out.withColumn("k", F.get(mid, F.col("bin")))
    for p in powers:
        out = out.withColumn(f"{p}_dens", F.col(p) / F.col("nk")).withColumn(f"{p}_norm", 4 * np.pi * F.col("k") ** 2 * F.col(p) / F.col("nk"))
    return out


def _cropped(n: tuple[int, int, int], box: tuple[float, float, float], crop: int) -> tuple:
    return (n[0] - 2 * crop, *n[1:]), (box[0] * (n[0] - 2 * crop) / n[0], *box[1:])


def spectrum(cells: DataFrame, value: str, n, box, bins: int, *, log: bool = False, crop: int = 0, window: bool = False, weight: str | None = None) -> DataFrame:
    """Power over shells. n and box are in the order z, y, x. ``crop``: layers that go at both ends of z; ``window``: a Hamming window along z.

    ``weight``: a second field whose power multiplies the first's, mode by mode.
    """
    n, box = _cropped(n, box, crop)
    values = [value] if weight is None else [value, weight]
    power = lambda f, k: [np.prod(np.abs(f) ** 2, axis=0)]
    return _shell_sums(cells, values, ["power"], power, n, box, Shells(n, box, bins, log), crop, window)


def spectrum_helmholtz(cells: DataFrame, vector: tuple[str, str, str], n, box, bins: int, *, log: bool = False) -> DataFrame:
    """Compressive (along k) and solenoidal power of a vector field."""

    def power(f, k):
        kz, ky, kx = k
        k2 = kz**2 + ky**2 + kx**2 + 1e-16
        along = kx * f[0] + ky * f[1] + kz * f[2]
        comp = np.abs(along) ** 2 / k2
        rest = [f[c] - along * kc / k2 for c, kc in enumerate((kx, ky, kz))]
        return comp, sum(np.abs(r) ** 2 for r in rest)

    return _shell_sums(cells, list(vector), ["comp", "sol"], power, n, box, Shells(n, box, bins, log))
