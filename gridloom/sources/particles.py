"""Particle dumps: the column-wise binary format (by ranges of particles) and legacy VTK."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Fixed value: the number that starts a dump.
MAGIC = 43
REALS = ("x", "y", "z", "velx", "vely", "velz")
INTS = ("gid", "tag", "lastmove", "lastlevel")


def read_header(path: str) -> dict:
    with open(path, "rb") as f:
        magic, n, reals, ints, grid = np.frombuffer(f.read(40), "<i8").tolist()
        if magic != MAGIC:
            raise ValueError(f"{path}: not a particle dump")
        time, dt, cycle = np.frombuffer(f.read(24), "<f8").tolist()
        names = [f.read(16).split(b"\0")[0].decode().strip() for _ in range(grid)]
        start = f.tell()
    columns = [REALS[k] if k < 6 else f"rdata_{k}" for k in range(reals)] + [INTS[k] if k < 4 else f"idata_{k}" for k in range(ints)] + names
    kinds = ["<f8"] * reals + ["<i4"] * ints + ["<f8"] * grid
    offsets = start + np.concatenate([[0], np.cumsum([n * int(k[2]) for k in kinds])])
    if os.path.getsize(path) < offsets[-1]:
        raise ValueError(f"{path}: truncated")
    return {"particles": n, "time": time, "dt": dt, "cycle": int(cycle), "columns": dict(zip(columns, zip(kinds, offsets[:-1].tolist()), strict=True))}


class _Rows(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class ParticleReader(DataSourceReader):
    """Reads only the columns that are asked for: each is a contiguous run in the file."""

    def __init__(self, path: str, schema: StructType, rows: int):
        self.path, self.schema, self.rows = path, schema, rows

    def partitions(self):
        n = read_header(self.path)["particles"]
        return [_Rows(k, min(self.rows, n - k)) for k in range(0, n, self.rows)] or [_Rows(0, 0)]

    def read(self, partition):
        columns = read_header(self.path)["columns"]
        with open(self.path, "rb") as f:
            arrays = []
            for name in self.schema.names:
                kind, at = columns[name]
                f.seek(at + partition.first * int(kind[2]))
                arrays.append(pa.array(np.frombuffer(f.read(partition.count * int(kind[2])), kind)))
        yield pa.RecordBatch.from_arrays(arrays, names=self.schema.names)


class ParticleSource(DataSource):
    """Options: path; columns (comma-separated, such as x,y,z for positions only); rows_per_partition."""

    @classmethod
    def name(cls):
        return "particlebin"

    def schema(self):
        columns = read_header(self.options["path"])["columns"]
        wanted = self.options.get("columns")
        names = wanted.split(",") if wanted else list(columns)
        if missing := [n for n in names if n not in columns]:
            raise ValueError(f"no such columns: {missing}")
        return StructType([StructField(n, IntegerType() if columns[n][0] == "<i4" else DoubleType()) for n in names])

    def reader(self, schema):
        return ParticleReader(self.options["path"], schema, int(self.options.get("rows_per_partition", 1_000_000)))


def write_particles(path: str, reals: dict[str, np.ndarray], ints: dict[str, np.ndarray], grid: dict[str, np.ndarray] | None = None, *, time: float = 0.0, dt: float = 0.0, cycle: int = 0) -> None:
    grid = grid or {}
    n = len(next(iter(reals.values())))
    with open(path, "wb") as f:
        f.write(np.array([MAGIC, n, len(reals), len(ints), len(grid)], "<i8").tobytes() + np.array([time, dt, cycle], "<f8").tobytes())
        f.write(b"".join(name.encode().ljust(16, b"\0") for name in grid))
        for columns, kind in ((reals, "<f8"), (ints, "<i4"), (grid, "<f8")):
            for c in columns.values():
                f.write(np.asarray(c, kind).tobytes())


#: Names that mean the same, and fields of places and velocities.
ALIASES = {"vx": "velx", "vy": "vely", "vz": "velz"}
FORMULAS = {"r": "sqrt(x*x + y*y + z*z)", "R": "sqrt(x*x + y*y)", "vtot": "sqrt(velx*velx + vely*vely + velz*velz)", "theta": "acos(try_divide(z, sqrt(x*x + y*y + z*z)))", "phi": "atan2(y, x)"}


def field(columns: list[str], name: str) -> Column:
    """A particle column, or a derived one. What isn't there is an error, not zeros."""
    name = ALIASES.get(name, name) if name not in columns else name
    if name in columns:
        return F.col(f"`{name}`")
    needed = ("velx", "vely", "velz") if name == "vtot" else ("x", "y", "z")
    if name not in FORMULAS or not set(needed) <= set(columns):
        raise ValueError(f"No particle field called {name!r}")
    return F.expr(FORMULAS[name])


def read_vtk(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, gid, tag of a legacy binary VTK file (big-endian points, then two scalar fields)."""

    def parse(batches):
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                at = raw.index(b"POINTS")
                line = raw[at : raw.index(b"\n", at)]
                n, at = int(line.split()[1]), at + len(line) + 1
                points = np.frombuffer(raw, ">f4", 3 * n, at).reshape(n, 3).astype(float)
                columns = [points[:, c] for c in range(3)]
                at += 12 * n
                for _ in range(2):
                    at = raw.index(b"LOOKUP_TABLE", at)
                    at = raw.index(b"\n", at) + 1
                    columns.append(np.frombuffer(raw, ">i4", n, at).astype("i4"))
                    at += 4 * n
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["x", "y", "z", "gid", "tag"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "x double, y double, z double, gid int, tag int")
