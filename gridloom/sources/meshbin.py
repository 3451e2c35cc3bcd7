"""Block-structured binary snapshots (version 1.1) as a Spark data source.

``spark.dataSource.register(MeshBinSource)``, then
``spark.read.format("meshbin").load(path)``: one row a cell. Blocks have equal
sizes unless the file says otherwise, so the block table is read by seeking from
header to header, and each partition reads its own range of blocks. The options
``columns`` (variables, comma-separated) and ``box`` (six bounds) leave the other
variables, and the blocks outside the box, unread. The path must be one that executors
can open (a shared mount).
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

INDEX = ["mb", "k", "j", "i"]
BLOCK = ["lx1", "lx2", "lx3", "level"]
GEOMETRY = ["x1min", "x1max", "x2min", "x2max", "x3min", "x3max"]


@dataclass
class Head:
    """What stands before the blocks."""

    time: float
    cycle: int
    variables: list[str]
    location: str
    value: str
    parameters: dict[str, dict[str, str]]
    start: int

    @property
    def ghosts(self) -> int:
        return int(self.parameters.get("mesh", {}).get("nghost", 0))


def parse_parameters(text: str) -> dict[str, dict[str, str]]:
    """<block> lines and key = value lines; # starts a comment."""
    found, block = {}, "none"
    for line in (x.split("#")[0].strip() for x in text.splitlines()):
        if line.startswith("<"):
            block = line.strip("<>").strip()
            found.setdefault(block, {})
        elif "=" in line:
            key, value = line.split("=", 1)
            found.setdefault(block, {})[key.strip()] = value.strip()
    return found


def read_head(path: str) -> Head:
    with open(path, "rb") as f:
        if not (first := f.readline().split()) or not first[-1].endswith(b"=1.1"):
            raise ValueError(f"{path}: not a block file of version 1.1")
        last = lambda: f.readline().split(b"=")[-1]
        pre = dict(tuple(x.strip() for x in f.readline().decode().split("=", 1)) for _ in range(int(last()) - 1))
        kinds = {"4": "f4", "8": "f8"}
        if not {pre["size of location"], pre["size of variable"]} <= set(kinds):
            raise ValueError(f"{path}: sizes must be 4 or 8 bytes")
        last()
        names = [v.decode() for v in f.readline().split()[1:]]
        text = f.read(int(last())).decode()
        return Head(float(pre["time"]), int(pre["cycle"]), names, kinds[pre["size of location"]], kinds[pre["size of variable"]], parse_parameters(text), f.tell())


def block_offsets(path: str, head: Head) -> list[int]:
    """Where each block starts."""
    size, at, found = os.path.getsize(path), head.start, []
    loc, val = int(head.location[1]), int(head.value[1])
    with open(path, "rb") as f:
        while at < size:
            found.append(at)
            f.seek(at)
            b = struct.unpack("=6i", f.read(24))
            cells = (b[1] - b[0] + 1) * (b[3] - b[2] + 1) * (b[5] - b[4] + 1)
            at += 24 + 16 + 6 * loc + cells * val * len(head.variables)
    return found


def write_meshbin(path: str, blocks: list[dict], variables: list[str], parameters: str, *, time: float = 0.0, cycle: int = 0, value: str = "f8", ghosts: int = 0) -> None:
    """The sink for small data and tests. blocks: logical (4 ints), geometry (6 floats), data {variable: array (nz, ny, nx)}."""
    text = parameters.encode()
    with open(path, "wb") as f:
        f.write(b"mesh version=1.1\nsize of preheader=5\n" + f"time={time}\ncycle={cycle}\nsize of location=8\nsize of variable={value[1]}\nnumber of variables={len(variables)}\nvariables: {' '.join(variables)}\nheader offset={len(text)}\n".encode() + text)
        for b in blocks:
            nz, ny, nx = b["data"][variables[0]].shape
            f.write(struct.pack("=6i", ghosts, ghosts + nx - 1, ghosts, ghosts + ny - 1, ghosts, ghosts + nz - 1) + struct.pack("=4i", *b["logical"]) + struct.pack("=6d", *b["geometry"]))
            for v in variables:
                f.write(np.ascontiguousarray(b["data"][v], f"<{value}").tobytes())


class _Range(InputPartition):
    def __init__(self, path: str, blocks: list[tuple[int, int]]):
        self.path, self.blocks = path, blocks


def _geometry(f, head: Head, at: int) -> tuple[tuple, tuple, np.ndarray, int]:
    """(cells by x, y, z; logical place and level; bounds; where the variables start) of the block at ``at``."""
    f.seek(at)
    b = struct.unpack("=6i", f.read(24))
    logical = struct.unpack("=4i", f.read(16))
    bounds = np.frombuffer(f.read(6 * int(head.location[1])), f"<{head.location}").astype(float)
    return (b[1] - b[0] + 1, b[3] - b[2] + 1, b[5] - b[4] + 1), logical, bounds, f.tell()


class MeshBinReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, blocks: int, box: list[float] | None):
        self.path, self.schema, self.blocks, self.box = path, schema, blocks, box

    def partitions(self):
        head = read_head(self.path)
        offsets = list(enumerate(block_offsets(self.path, head)))
        if self.box:
            with open(self.path, "rb") as f:
                meets = lambda g: all(g[2 * k] <= self.box[2 * k + 1] and g[2 * k + 1] >= self.box[2 * k] for k in range(3))
                offsets = [(mb, at) for mb, at in offsets if meets(_geometry(f, head, at)[2])]
        return [_Range(self.path, offsets[k : k + self.blocks]) for k in range(0, len(offsets), self.blocks)] or [_Range(self.path, [])]

    def read(self, partition):
        head = read_head(partition.path)
        wanted, size = [head.variables.index(v) for v in self.schema.names[len(INDEX + BLOCK + GEOMETRY) :]], int(head.value[1])
        with open(partition.path, "rb") as f:
            for mb, at in partition.blocks:
                (nx, ny, nz), logical, bounds, start = _geometry(f, head, at)
                n, data = nx * ny * nz, []
                for v in wanted:
                    f.seek(start + v * n * size)
                    data.append(np.frombuffer(f.read(n * size), f"<{head.value}").astype(float))
                k, rest = np.divmod(np.arange(n, dtype=np.int32), nx * ny)
                j, i = np.divmod(rest, nx)
                columns = [np.full(n, mb, np.int32), k, j, i, *(np.full(n, x, np.int32) for x in logical), *(np.full(n, x) for x in bounds), *data]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=self.schema.names)


class MeshBinSource(DataSource):
    """Options: path; blocks_per_partition (64); columns and box, see above."""

    @classmethod
    def name(cls):
        return "meshbin"

    def schema(self):
        there = read_head(self.options["path"]).variables
        wanted = self.options["columns"].split(",") if "columns" in self.options else there
        if missing := [v for v in wanted if v not in there]:
            raise ValueError(f"no such variables: {missing}")
        whole = [StructField(c, IntegerType()) for c in INDEX + BLOCK]
        return StructType(whole + [StructField(c, DoubleType()) for c in GEOMETRY + wanted])

    def reader(self, schema):
        box = [float(b) for b in self.options["box"].split(",")] if "box" in self.options else None
        return MeshBinReader(self.options["path"], schema, int(self.options.get("blocks_per_partition", 64)), box)
