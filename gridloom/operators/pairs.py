"""Two-point statistics: structure functions over all unordered pairs, or a hashed sample of them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-30


#: How many times likelier pairs of nearby regions are drawn: in one region, or in regions that share a face, an edge, a corner.
BOOSTS = {"same": 100.0, "face": 16.0, "edge": 4.0, "corner": 2.0}


def _slots(share: float) -> int:
    return max(1, round(1 / share))


def _slot(of: str, seed: int, slots: int | Column) -> Column:
    return F.pmod(F.xxhash64(of, F.lit(seed)), F.lit(slots) if isinstance(slots, int) else slots)


def _beside(axis: str, count: int, periodic: bool) -> Column:
    """The regions of an axis that are at most one away from a point's: structs of the region and 0 (its own) or 1."""
    own = F.col(f"region_{axis}")
    move = lambda d: F.pmod(own + d, F.lit(count)) if periodic else own + d
    every = F.array_distinct(F.array(F.struct(own.alias("at"), F.lit(0).alias("off")), *[F.struct(move(d).cast("int").alias("at"), F.lit(1).alias("off")) for d in (1, -1)]))
    return F.filter(every, lambda s: ((s["off"] == 0) | (s["at"] != own)) & (s["at"] >= 0) & (s["at"] < count))


def _drawn(one: DataFrame, two: DataFrame, sample: float, regions: tuple[int, int, int], periodic: tuple[bool, bool, bool], boosts: dict[str, float], seed: int) -> DataFrame:
    """Pairs by the regions of their points (region_x, _y, _z): nearby ones at their boosted shares by an equi-join on region and slot, the rest at ``sample`` on a slot."""
    shares = [min(1.0, sample * boosts.get(k, 1.0)) for k in ("same", "face", "edge", "corner")]
    slots = F.array(*[F.lit(_slots(s)).cast("long") for s in shares])
    share = F.array(*[F.lit(1.0 / _slots(s)) for s in shares])
    at = [f"region_{c}" for c in "xyz"]
    here = one
    for c, n, p in zip("xyz", regions, periodic, strict=True):
        here = here.withColumn(f"_{c}", F.explode(_beside(c, n, p)))
    kind = F.col("_x.off") + F.col("_y.off") + F.col("_z.off")
    here = here.withColumn("_kind", kind).withColumn("slot", _slot("id_1", seed, F.get(slots, F.col("_kind")))).withColumns({f"_at_{c}": F.col(f"_{c}.at") for c in "xyz"}).drop("_x", "_y", "_z", *at)
    there = two.withColumn("_kind", F.explode(F.array(*[F.lit(k) for k in range(4)]))).withColumn("slot", _slot("id_2", seed + 1, F.get(slots, F.col("_kind")))).withColumnsRenamed({f"region_{c}": f"_at_{c}" for c in "xyz"})
    near = here.join(there, [*[f"_at_{c}" for c in "xyz"], "_kind", "slot"]).withColumn("share", F.get(share, F.col("_kind")))
    apart = F.lit(False)
    far = one.withColumn("slot", _slot("id_1", seed, _slots(sample))).join(two.withColumn("slot", _slot("id_2", seed + 1, _slots(sample))).withColumnsRenamed({r: f"_{r}" for r in at}), "slot")
    for c, n, p in zip("xyz", regions, periodic, strict=True):
        d = F.abs(F.col(f"region_{c}") - F.col(f"_region_{c}"))
        apart = apart | ((F.least(d, n - d) if p else d) > 1)
    far = far.where(apart).withColumn("share", F.lit(1.0 / _slots(sample)))
    kept = [c for c in one.columns if c not in at] + [c for c in two.columns if c not in at] + ["share"]
    return near.select(*kept).unionByName(far.select(*kept)).where("id_1 < id_2")


def pair_table(points: DataFrame, columns: list[str], box: tuple[float, float, float] | None = None, sample: float = 1.0, seed: int = 1, regions: tuple[int, int, int] | None = None, periodic: tuple[bool, bool, bool] = (True, True, True), boosts: dict[str, float] | None = None) -> DataFrame:
    """All pairs a < b of ``points`` (id, x, y, z, w, ...) as *_1, *_2 columns, with separation lx, ly, lz and r.

    Exhaustive pairs are a definition for small sets; for large ones ``sample``
    keeps that share of each point's partners by a hash of the pair of blocks, so
    partners are drawn by an equi-join on a hash slot and not compared at all.
    With ``regions``, the number of regions along each axis, whose places are the int columns
    region_x, _y, _z, nearby pairs are drawn more often, by ``boosts`` (BOOSTS unless given), as
    far pairs outnumber them. The column ``share`` tells how likely a pair was, and binned() weighs by it.
    """
    places = [f"region_{c}" for c in "xyz"] if regions and sample < 1 else []
    one = points.select(*[F.col(c).alias(f"{c}_1") for c in ["id", "x", "y", "z", "w", *columns]], *places).where("w_1 != 0")
    two = points.select(*[F.col(c).alias(f"{c}_2") for c in ["id", "x", "y", "z", "w", *columns]], *places).where("w_2 != 0")
    if places:
        pairs = _drawn(one, two, sample, regions, periodic, BOOSTS if boosts is None else boosts, seed)
    elif sample < 1:
        pairs = one.withColumn("slot", _slot("id_1", seed, _slots(sample))).join(two.withColumn("slot", _slot("id_2", seed + 1, _slots(sample))), "slot").where("id_1 < id_2")
    else:
        pairs = one.join(two, F.col("id_1") < F.col("id_2"))
    for n, c in enumerate("xyz"):
        d = F.col(f"{c}_2") - F.col(f"{c}_1")
        if box:
            d = F.when(d > box[n] / 2, d - box[n]).when(d < -box[n] / 2, d + box[n]).otherwise(d)
        pairs = pairs.withColumn(f"l{c}", d)
    return pairs.withColumn("r", F.sqrt(F.col("lx") ** 2 + F.col("ly") ** 2 + F.col("lz") ** 2))


def binned(pairs: DataFrame, along: Column, amounts: dict[str, Column], lo: float, hi: float, bins: int, orders: int = 2, within: Column | None = None, log: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """bin, n, weight and for each amount the mean of its powers 1 .. orders over bins [lo, hi), equal in the separation or in its logarithm.

    Pairs with a column ``share`` stand for 1 / share pairs in the means; n and weight are of the pairs that were drawn.
    """
    if log:
        along, lo, hi = F.log10(F.when(along > 0, along)), math.log10(lo), math.log10(hi)
    stands = [(1 / F.col("share")).alias("_of")] if "share" in pairs.columns else []
    mean = lambda v: F.sum(v * F.col("_of")) / F.sum("_of") if stands else F.avg(v)
    kept = pairs.select(*stands, F.floor((along - lo) / (hi - lo) * bins).cast("int").alias("bin"), (F.col("w_1") + F.col("w_2")).alias("w"), (F.lit(True) if within is None else within).alias("_in"), *by, *[a.alias(n) for n, a in amounts.items()])
    kept = kept.where((F.col("bin") >= 0) & (F.col("bin") < bins) & F.col("_in"))
    return kept.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum("w").alias("weight"), *[mean(F.col(n) ** p).alias(f"{n}_{p}") for n in amounts for p in range(1, orders + 1)])


def within_box(points: DataFrame, xyz: list[float] | None) -> DataFrame:
    """The points in an inclusive box (2, 4 or 6 bounds: along x, then y, then z)."""
    for c, lo, hi in zip("xyz", (xyz or [])[::2], (xyz or [])[1::2], strict=False):
        points = points.where(F.col(c).between(lo, hi))
    return points


def structure_function(points: DataFrame, fields: list[str], lo: float, hi: float, bins: int, orders: int = 2, log: bool = False, xyz: list[float] | None = None, weights: list[str] | None = None, **pairs) -> DataFrame:
    """Of |w2 f2 - w1 f1| for each field. ``weights``: columns that are weights one after another, told apart by a column ``weighting``; else the column w."""
    points, out = within_box(points, xyz), None
    for name in weights or [None]:
        here = points if name is None else points.withColumn("w", F.col(name))
        table = pair_table(here, fields, **pairs)
        one = binned(table, F.col("r"), {f: F.abs(F.col("w_2") * F.col(f"{f}_2") - F.col("w_1") * F.col(f"{f}_1")) for f in fields}, lo, hi, bins, orders, log=log)
        one = one if name is None else one.withColumn("weighting", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _difference(vector: tuple[str, str, str]) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{v}_2") - F.col(f"{v}_1") for v in vector)


def helmholtz(points: DataFrame, vector: tuple[str, str, str], lo: float, hi: float, bins: int, orders: int = 2, log: bool = False, xyz: list[float] | None = None, **pairs) -> DataFrame:
    """comp: the difference along the separation; sol: what is across it."""
    dx, dy, dz = _difference(vector)
    comp = F.abs(dx * F.col("lx") + dy * F.col("ly") + dz * F.col("lz")) / (F.col("r") + 1e-10)
    sol = F.sqrt(F.greatest(dx**2 + dy**2 + dz**2 - comp**2, F.lit(0.0)))
    return binned(pair_table(within_box(points, xyz), list(vector), **pairs), F.col("r"), {"comp": comp, "sol": sol}, lo, hi, bins, orders, log=log)


#: Pairs that a task holds at a time: some thirty arrays of that many doubles, which should stay in its core's cache.
TILE = 8192


def _crossed(points: DataFrame) -> DataFrame:
    """``points`` (id and others) in blocks by a hash of the id, each sent to every two blocks p <= q that it is one of; ``own`` tells which.

    The blocks grow with the root of the points' number, and so do the copies of a point.
    """
    if points.schema["id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        points = points.withColumn("id", F.to_json(F.struct("id")))
    blocks = max(1, math.ceil(math.sqrt(points.count()) / 10))
    own = points.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return own.withColumns({"p": F.least("own", "_to"), "q": F.greatest("own", "_to")}).drop("_to").repartition(blocks * (blocks + 1) // 2, "p", "q")


def _tiles(pdf: pd.DataFrame) -> Iterator[tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray | None]]:
    """Columns of rows and of what they meet, and which of the pairs count (None: all): every two points of a group's two blocks, or of its only one, whose ids differ."""
    one, two = (pdf[pdf["own"] == pdf[c].iat[0]] for c in "pq")
    alone = pdf["p"].iat[0] == pdf["q"].iat[0]
    if alone:
        one = two = one.assign(rank=np.unique(one["id"].to_numpy(), return_inverse=True)[1]).sort_values("rank")
    a, b = ({c: np.ascontiguousarray(d[c].to_numpy()) for c in d.columns if c not in ("id", "own", "p", "q")} for d in (one, two))
    step = max(1, TILE // max(1, len(two)))
    for k in range(0, len(one) if len(two) else 0, step):
        rows = {c: x[k : k + step] for c, x in a.items()}
        others = {c: x[k:] for c, x in b.items()} if alone else b
        yield rows, others, rows["rank"][:, None] < others["rank"][None, :] if alone else None


def _dot(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    out, part = one[0] * two[0], one[1] * two[1]
    out += part
    np.multiply(one[2], two[2], out=part)
    out += part
    return out


def _across(whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """sqrt(whole - part^2), 0 where rounding makes that negative."""
    out = part * part
    np.subtract(whole, out, out=out)
    np.maximum(out, 0.0, out=out)
    return np.sqrt(out, out=out)


def _anisotropic_sums(lo: float, hi: float, bins: int, cos_parallel: float, cos_perpendicular: float, orders: int, log: bool, box: tuple[float, float, float] | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A group of _crossed() to kind, bin, n, weight, known (pairs with a velocity) and the sums of the amounts' powers."""
    kinds, names = ("all", "parallel", "perpendicular"), ("vel", "vel_perp", "bcc", "bcc_perp")
    columns = ["n", "weight", "known", *[f"{a}_{p}" for a in names for p in range(1, orders + 1)]]
    start, width = (math.log10(lo), math.log10(hi) - math.log10(lo)) if log else (lo, hi - lo)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((len(columns), len(kinds) * bins))
        w = 2 * pdf["w"].iat[0] if pdf["w"].nunique(dropna=False) == 1 else None
        whole = pdf["known"].all()
        with np.errstate(all="ignore"):
            for a, b, counts in _tiles(pdf):
                moved = lambda c: b[c][None, :] - a[c][:, None]  # noqa: B023, E731
                l, v, d = ([moved(f"{n}{k}") for k in "012"] for n in "xvb")
                for k, size in enumerate(box or ()):
                    l[k] = np.where(l[k] > size / 2, l[k] - size, np.where(l[k] < -size / 2, l[k] + size, l[k]))
                m = [a[f"b{k}"][:, None] + b[f"b{k}"][None, :] for k in "012"]  # twice the mean field, whose direction is taken
                field = np.sqrt(_dot(m, m))
                r2 = _dot(l, l)
                r = np.sqrt(r2)
                kept = (r > TINY) & ~(field <= 2 * TINY)
                if counts is not None:
                    kept &= counts
                along = np.abs(_dot(l, m))
                along /= field
                cos = along / r
                v2, d2 = _dot(v, v), _dot(d, d)
                vm, dm = _dot(v, m), _dot(d, m)
                vm /= field
                dm /= field
                amounts = [np.sqrt(v2), _across(v2, vm), np.sqrt(d2), _across(d2, dm)]
                known = None if whole else a["known"][:, None] & b["known"][None, :]
                rows, places = [], []
                for kind, (at, within) in enumerate(((r, kept), (along, kept & (cos > cos_parallel)), (None, kept & (cos <= cos_perpendicular)))):
                    some = slice(None) if within.all() else np.flatnonzero(within)
                    at = at.ravel()[some] if at is not None else _across(r2.ravel()[some], along.ravel()[some])
                    place = np.log10(np.where(at > 0, at, np.nan)) if log else at
                    place = (place - start if start else place) / width * bins
                    inside = (place >= 0) & (place < bins)
                    if not inside.all():
                        some, place = (np.arange(within.size) if isinstance(some, slice) else some)[inside], place[inside]
                    rows.append(some)
                    places.append(place.astype(np.intp) + kind * bins)
                place = np.concatenate(places)
                taken = lambda x: np.concatenate([x.ravel()[k] for k in rows])  # noqa: B023, E731
                summed = lambda x: np.bincount(place, x, len(kinds) * bins)  # noqa: B023, E731
                total[0] += (n := np.bincount(place, minlength=len(kinds) * bins))
                total[1] += n * w if w is not None else summed(taken(a["w"][:, None] + b["w"][None, :]))
                has = None if known is None else taken(known)
                total[2] += n if has is None else summed(has)
                for k, amount in enumerate(amounts):
                    x = taken(amount)
                    x = x if k > 1 or has is None else np.where(has, x, 0.0)
                    for p in range(orders):
                        power = power * x if p else x
                        total[3 + k * orders + p] += summed(power)
        out = pd.DataFrame(total.T, columns=columns).assign(kind=np.repeat(kinds, bins), bin=np.tile(np.arange(bins), len(kinds)))
        return out[out["n"] > 0].astype({"n": "int64", "known": "int64", "bin": "int32"})[["kind", "bin", *columns]]

    return sums


def _anisotropic_whole(points: DataFrame, velocity: tuple[str, str, str], field: tuple[str, str, str], lo: float, hi: float, bins: int, cos_parallel: float, cos_perpendicular: float, orders: int, log: bool, box: tuple[float, float, float] | None = None) -> DataFrame:
    """anisotropic() over all pairs: arrays of pairs of two blocks of points, of which only the bins' sums leave a task."""
    at = {f"{n}{k}": F.col(c).cast("double") for n, of in (("x", "xyz"), ("v", velocity), ("b", field)) for k, c in enumerate(of)}
    named = points.select("id", F.col("w").cast("double").alias("w"), *[c.alias(n) for n, c in at.items()]).where("w != 0 AND id IS NOT NULL")
    named = named.where(" AND ".join(f"{n} IS NOT NULL" for n in at if n[0] != "v"))
    named = named.withColumn("known", F.col("v0").isNotNull() & F.col("v1").isNotNull() & F.col("v2").isNotNull())
    named = named.withColumns({n: F.when(F.col(n).isNull(), 0.0).otherwise(F.col(n)) for n in ("v0", "v1", "v2")})
    amounts = [f"{a}_{p}" for a in ("vel", "vel_perp", "bcc", "bcc_perp") for p in range(1, orders + 1)]
    sums = _anisotropic_sums(lo, hi, bins, cos_parallel, cos_perpendicular, orders, log, box)
    each = _crossed(named).groupBy("p", "q").applyInPandas(sums, "kind string, bin int, n long, weight double, known long, " + ", ".join(f"{a} double" for a in amounts))
    each = each.withColumns({a: F.coalesce(a, F.lit(math.nan)) for a in ("weight", *amounts)})  # pandas' NaN come back as nulls
    mean = lambda a: F.sum(a) / F.nullif(F.sum("n" if a.startswith(("vel_perp", "bcc")) else "known"), F.lit(0))  # noqa: E731  # greatest() makes an unknown part across the field 0
    return each.groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), *[mean(a).alias(a) for a in amounts])


def anisotropic(points: DataFrame, velocity: tuple[str, str, str], field: tuple[str, str, str], lo: float, hi: float, bins: int, cos_parallel: float = 0.9, cos_perpendicular: float = 0.1, orders: int = 2, log: bool = False, xyz: list[float] | None = None, **pairs) -> DataFrame:
    """Differences of the velocity and the magnetic field, whole and across the local mean field; kind: all, parallel, perpendicular separations."""
    if pairs.get("sample", 1.0) >= 1:
        return _anisotropic_whole(within_box(points, xyz), velocity, field, lo, hi, bins, cos_parallel, cos_perpendicular, orders, log, pairs.get("box"))
    table = pair_table(within_box(points, xyz), [*velocity, *field], **pairs)
    mean = [0.5 * (F.col(f"{b}_1") + F.col(f"{b}_2")) for b in field]
    size = F.sqrt(sum((m**2 for m in mean), F.lit(0.0)))
    table = table.withColumn("_b", size).where((F.col("_b") > TINY) & (F.col("r") > TINY))
    unit = [m / F.col("_b") for m in mean]
    along = F.abs(sum((F.col(f"l{c}") * u for c, u in zip("xyz", unit, strict=True)), F.lit(0.0)))
    table = table.withColumn("l_par", along).withColumn("l_perp", F.sqrt(F.greatest(F.col("r") ** 2 - F.col("l_par") ** 2, F.lit(0.0)))).withColumn("_cos", F.col("l_par") / F.col("r"))
    amounts = {}
    for name, v in (("vel", velocity), ("bcc", field)):
        d = _difference(v)
        whole = sum((c**2 for c in d), F.lit(0.0))
        part = sum((c * u for c, u in zip(d, unit, strict=True)), F.lit(0.0))
        amounts |= {name: F.sqrt(whole), f"{name}_perp": F.sqrt(F.greatest(whole - part**2, F.lit(0.0)))}
    # the three kinds of separation are rows of one pass over the pairs
    kinds = (("all", F.col("r"), F.lit(True)), ("parallel", F.col("l_par"), F.col("_cos") > cos_parallel), ("perpendicular", F.col("l_perp"), F.col("_cos") <= cos_perpendicular))
    rows = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), l.alias("l"), w.alias("in")) for k, l, w in kinds]), lambda s: s["in"]))
    each = table.select(*[c for c in ("w_1", "w_2", "share") if c in table.columns], *[a.alias(n) for n, a in amounts.items()], rows.alias("_s")).withColumn("kind", F.col("_s.kind"))
    return binned(each, F.col("_s.l"), {n: F.col(n) for n in amounts}, lo, hi, bins, orders, log=log, by=("kind",))
