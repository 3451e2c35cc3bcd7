"""A snapshot: cells, header and fields; series of snapshots; results kept as Parquet."""

from __future__ import annotations

import json
import os
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.facades import Facades
from gridloom.functions.fields import MASKS, Fields
from gridloom.functions.units import Units
from gridloom.operators import aggregates, mesh
from gridloom.sources import hdf, particles
from gridloom.sources.meshbin import MeshBinSource, read_head

RELATIVE = ("nrho", "nprs", "nvelx", "nvely", "nvelz", "eflxwave", "delrhodelT", "delvrdelT")
CURRENT = ("curx", "cury", "curz", "cur")


class Snapshot(Facades):
    """``cells`` has a row a cell; ``fields`` resolves names to columns over it.

    Without a header (a Parquet table), the mesh is named by parameters: nx1, nx2, nx3 (a
    block's cells), Nx1.. (the root mesh's; else the same), and the bounds and periodic
    flags of ``mesh``.
    """

    def __init__(self, cells: DataFrame, header: dict[str, dict[str, str]] | None = None, **parameters: float):
        self.cells, self._header, self.results, self.particles = cells, header or {}, {}, None
        gas = next((b for b in ("hydro", "mhd") if b in self._header), "hydro")
        self.is_mhd = "mhd" in self._header or {"bcc1", "bcc2", "bcc3"} <= set(cells.columns)
        self.eos = self.header(gas, "eos", str, "adiabatic")
        gamma = 1.0 if self.eos == "isothermal" else self.header(gas, "gamma", float, 5 / 3)
        numbers = {"gamma": gamma} | {f"nx{n}": float(self._header["meshblock"][f"nx{n}"]) for n in (1, 2, 3) if "meshblock" in self._header}
        if self.eos == "isothermal":
            numbers["iso_sound_speed"] = self.header(gas, "iso_sound_speed", float, 1.0)
        given = self._header.get("units", {})
        units = Units(*[float(given.get(k, d)) for k, d in (("length_cgs", 1), ("mass_cgs", 1), ("time_cgs", 1), ("mu", 0.618))])
        self.fields = Fields(cells.columns, mhd=self.is_mhd, eos=self.eos, parameters=numbers | parameters, units=units)
        found = self._header.get("mesh", {})
        known = self.fields.parameters
        if all(f"nx{n}" in known for n in (1, 2, 3)):
            self.block = tuple(int(known[f"nx{n}"]) for n in (1, 2, 3))
            self.root = tuple(int(found.get(f"nx{n}", known.get(f"Nx{n}", known[f"nx{n}"]))) for n in (1, 2, 3))
            self.bounds = [float(found.get(f"x{n}{m}", known.get(f"X{n}{m}", d))) for n in (1, 2, 3) for m, d in (("min", 0.0), ("max", 1.0))]
        # a block file without a header entry is taken as periodic on neither side
        self.periodic = {a: found.get(f"ix{n}_bc", "periodic" if known.get("periodic", 0.0) else "open") == "periodic" for a, n in (("x", 1), ("y", 2), ("z", 3))}

    @classmethod
    def load(cls, spark: SparkSession, path: str, **parameters: float) -> Snapshot:
        """A block file (.bin), an HDF5 snapshot (.athdf, with h5py) or a Parquet table of cells; anything else is a ValueError."""
        if path.endswith(".bin"):
            spark.dataSource.register(MeshBinSource)
            return cls(spark.read.format("meshbin").load(path), read_head(path).parameters, **parameters)
        if path.endswith(".athdf"):
            return cls(*hdf.read_snapshot(spark, path), **parameters)
        if path.endswith(".parquet"):
            return cls(spark.read.parquet(path), **parameters)
        raise ValueError(f"unsupported file: {path}")

    @classmethod
    def load_both(cls, spark: SparkSession, folder: str, number: int, prefix: str, **parameters: float) -> Snapshot:
        """The snapshot ``prefix.NNNNN`` of the folder or its ``bin`` folder: cells from .bin or .athdf, and results kept beside it (.results).

        Either alone does; neither is a FileNotFoundError that names the places.
        """
        places = [f"{d}/{prefix}.{number:05d}" for d in (folder, f"{folder}/bin")]
        cells = next((p + ext for p in places for ext in (".athdf", ".bin") if os.path.exists(p + ext)), None)
        kept = next((p + ".results" for p in places if os.path.isdir(p + ".results")), None)
        if cells is None and kept is None:
            raise FileNotFoundError("none of " + ", ".join(p + ext for p in places for ext in (".athdf", ".bin", ".results")))
        snap = cls.load(spark, cells, **parameters) if cells else cls(spark.range(0).select(F.lit(0).alias("mb")), **parameters)
        return snap.restore(kept) if kept else snap

    def header(self, block: str, key: str, kind=str, default=None):
        try:
            return kind(self._header[block][key])
        except KeyError:
            warnings.warn(f"no {block}/{key} in the header, taking {default!r}", UserWarning, stacklevel=2)
            return default

    def col(self, name: str) -> Column:
        """A field over ``cells``. The current and profile-relative fields need further columns: see table()."""
        if self._name(name) in RELATIVE or name in CURRENT and self.is_mhd:
            raise ValueError(f"{name!r} isn't an expression over the cells alone; take it from table()")
        return self.fields(name)

    def weight(self, of: str | Column | None) -> Column:
        """A weight by name or as a column; None: 1."""
        return F.lit(1.0) if of is None else self.fields(of) if isinstance(of, str) else of

    @staticmethod
    def _name(name: str) -> str:
        return name.removesuffix("_hot").removesuffix("_range")

    def levels(self) -> list[int]:
        """The levels that blocks have; of a Parquet table without a level column, 0."""
        return sorted(r[0] for r in self.cells.select("level").distinct().collect()) if "level" in self.cells.columns else [0]  # a few numbers

    def table(self, names: list[str]) -> DataFrame:
        """``cells`` and the fields ``names``, profile-relative ones and the current too, as columns."""
        cells, needed = self.cells, self.fields.needs(names)
        extra = [n for n in needed if n not in self.fields.formulas and n not in self.fields.parameters and n not in self.fields.raw and n not in self.fields.added]
        fields = self.fields.over(cells.columns)
        if any(n.startswith("dbcc") for n in extra):
            wanted = list(cells.columns)
            for b in ("bcc1", "bcc2", "bcc3"):
                cells = self.gradient(b, cells=cells)
            cells = cells.select(*wanted, *[c for c in cells.columns if c.startswith("dbcc")])
        plain = cells  # not those that a profile was joined to: each would be made anew for the next one
        for suffix, mask in MASKS.items():
            own = [n for n in extra if n.startswith("p_") and next((s for s in ("_hot", "_range") if n.endswith(s)), "") == suffix]
            if own:
                source = {n[2 : len(n) - len(suffix)]: fields(n[2 : len(n) - len(suffix)]) for n in own}
                w = fields("vol") if mask is None else fields("vol") * fields(mask)
                cells = aggregates.relative_to_profile(cells, source, self.bounds[4], self.bounds[5], self.root[2], fields("z"), w, suffix, plain)
        return self.fields.over(cells.columns).select(cells, names)

    def gradient(self, name: str, *, edge_order: int = 1, cells: DataFrame | None = None) -> DataFrame:
        """The cells with d<name>_dx, _dy, _dz; across blocks and levels, periodic as the header says."""
        return self._stencil(mesh.gradient, name, [name], edge_order, cells)

    def divergence(self, names: tuple[str, str, str], *, edge_order: int = 1) -> DataFrame:
        return self._stencil(mesh.divergence, names, names, edge_order)

    def curl(self, names: tuple[str, str, str], *, edge_order: int = 1) -> DataFrame:
        return self._stencil(mesh.curl, names, names, edge_order)

    def _stencil(self, operator, values, names, edge_order, cells=None) -> DataFrame:
        cells = self.cells if cells is None else cells
        derived = [n for n in dict.fromkeys(names) if n not in cells.columns]
        cells = self.fields.over(cells.columns).select(cells, derived) if derived else cells
        cells = cells.withColumns({f"nx{n}": F.lit(float(self.block[n - 1])) for n in (1, 2, 3) if f"nx{n}" not in cells.columns})
        return operator(cells, values, self.block, self.root, self.periodic, levels=len(self.levels()) > 1, edge_order=edge_order)

    def lattice(self, names: list[str], level: int = 0, xyz: list[float] | None = None) -> DataFrame:
        """(k, j, i, names) on the uniform lattice of ``level``; of a box's cells only, if given."""
        cells = mesh.with_global(self.table(names), self.block)
        return mesh.in_box(mesh.resample(cells, names, level), xyz, self.bounds, mesh.refined_count(self.root, level))

    def blocks(self) -> DataFrame:
        return mesh.blocks(self.cells)

    def load_particles(self, spark: SparkSession, path: str | None = None, *, folder: str = ".", number: int = 0, prefix: str = "prtcl", suffix: str = "prtclbin") -> DataFrame:
        """Particles from a path, or ``folder/prefix.NNNNN.suffix``: a binary dump, VTK, or HDF5 (with h5py)."""
        path = path or f"{folder}/{prefix}.{number:05d}.{suffix}"
        if path.endswith(".vtk"):
            self.particles = particles.read_vtk(spark, path)
        elif path.endswith((".h5", ".hdf5")):
            self.particles = hdf.read_particles(spark, path)
        elif path.endswith((".prtclbin", ".bin")):
            spark.dataSource.register(particles.ParticleSource)
            self.particles = spark.read.format("particlebin").load(path)
        else:
            raise ValueError(f"unsupported file: {path}")
        return self.particles

    def particle(self, name: str) -> Column:
        """A column of the particles, or a field of their places and velocities."""
        if self.particles is None:
            raise ValueError("no particles are loaded")
        return particles.field(self.particles.columns, name)

    def keep(self, name: str, result: DataFrame, path: str | None = None) -> DataFrame:
        """Remembers a result product; written to and read from ``path`` if given."""
        if path:
            result.write.mode("overwrite").parquet(f"{path}/{name}")
            result = self.cells.sparkSession.read.parquet(f"{path}/{name}")
        self.results[name] = result
        return result

    def save(self, path: str, leave: tuple[str, ...] = ()) -> None:
        """Writes all results but ``leave``, and the header, to a folder: a Parquet table each and a table of what there is."""
        spark, names = self.cells.sparkSession, [n for n in self.results if n not in leave]
        for n in names:
            self.results[n].write.mode("overwrite").parquet(f"{path}/{n}")
        spark.createDataFrame([(json.dumps({"results": names, "header": self._header}),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta.json")

    def restore(self, path: str) -> Snapshot:
        """Adds the results of a folder that save() wrote; those that are there stay."""
        spark = self.cells.sparkSession
        meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta.json").first()["meta"])
        self._header = self._header or meta["header"]
        self.results = {n: spark.read.parquet(f"{path}/{n}") for n in meta["results"]} | self.results
        return self


class Series:
    """Snapshots ``path/basename.NNNNN.ext``, each read once."""

    def __init__(self, spark: SparkSession, path: str, basename: str, ext: str = "bin"):
        self.spark, self.name, self.loaded = spark, f"{path}/{basename}.{{n:05d}}.{ext}", {}

    def __call__(self, n: int) -> Snapshot:
        if n not in self.loaded:
            self.loaded[n] = Snapshot.load(self.spark, self.name.format(n=n))
        return self.loaded[n]

    def cells(self, ns: list[int]) -> DataFrame:
        parts = [self(n).cells.withColumn("snapshot", F.lit(n)) for n in ns]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
