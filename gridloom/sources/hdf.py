"""HDF5 snapshots and particle dumps, where the h5py library is installed.

Blocks, or ranges of particles, are rows of a small table that tasks read their part
by; the path must be one that executors can open (a shared mount).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.sources.meshbin import BLOCK, GEOMETRY, INDEX, parse_parameters


def _open(path: str):
    try:
        import h5py
    except ImportError as e:
        raise ValueError(f"{path}: reading HDF5 needs the h5py library") from e
    return h5py.File(path, "r")


def _text(x) -> str:
    return x.decode() if isinstance(x, bytes) else str(x)


def read_snapshot(spark: SparkSession, path: str, blocks_per_task: int = 16) -> tuple[DataFrame, dict]:
    """(cells, header): datasets of (variable, block, z, y, x) as the attributes DatasetNames, NumVariables and VariableNames say."""
    with _open(path) as f:
        header = parse_parameters(_text(f.attrs["Header"]))
        n_blocks = int(f.attrs["NumMeshBlocks"])
        names, at = [_text(v) for v in f.attrs["VariableNames"]], []
        for dataset, count in zip(f.attrs["DatasetNames"], f.attrs["NumVariables"], strict=True):
            at += [(_text(dataset), k) for k in range(int(count))]

    def read(batches):
        with _open(path) as f:
            for batch in batches:
                for mb in batch.column("id").to_pylist():
                    data = [np.asarray(f[d][k, mb], np.float64) for d, k in at]
                    nz, ny, nx = data[0].shape
                    k, j, i = (a.ravel().astype(np.int32) for a in np.indices((nz, ny, nx)))
                    ends = [float(f[f"x{n}f"][mb][e]) for n in (1, 2, 3) for e in (0, -1)]
                    place = [int(x) for x in f["LogicalLocations"][mb]] + [int(f["Levels"][mb])]
                    whole = [np.full(len(k), mb, np.int32), k, j, i, *(np.full(len(k), p, np.int32) for p in place), *(np.full(len(k), e) for e in ends), *(d.ravel() for d in data)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in whole], names=[*INDEX, *BLOCK, *GEOMETRY, *names])

    schema = ", ".join([f"{c} int" for c in INDEX + BLOCK] + [f"`{c}` double" for c in GEOMETRY + names])
    tasks = spark.range(0, n_blocks, 1, max(1, -(-n_blocks // blocks_per_task)))
    return tasks.mapInArrow(read, schema), header


def read_particles(spark: SparkSession, path: str, rows: int = 1_000_000) -> DataFrame:
    """The columns of the groups ParticleRealData, ParticleIntData and GridData, by ranges of particles."""
    groups = {"ParticleRealData": "double", "ParticleIntData": "int", "GridData": "double"}
    with _open(path) as f:
        columns = [(g, c, kind) for g, kind in groups.items() if g in f for c in f[g]]
        n = len(f[columns[0][0]][columns[0][1]]) if columns else 0

    def read(batches):
        with _open(path) as f:
            for batch in batches:
                for first in batch.column("id").to_pylist():
                    parts = [pa.array(np.asarray(f[g][c][first : first + rows], np.float64 if kind == "double" else np.int32)) for g, c, kind in columns]
                    yield pa.RecordBatch.from_arrays(parts, names=[c for _, c, _ in columns])

    return spark.range(0, n, rows, max(1, -(-n // rows))).mapInArrow(read, ", ".join(f"`{c}` {kind}" for _, c, kind in columns))
