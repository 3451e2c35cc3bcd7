"""Near-duplicate documents by SetSketch registers.

A document's word shingles, hashed, fill ``REGISTERS`` registers: each is the
smallest of exponentially distributed hash values, kept as its truncated logarithm
to base ``BASE``. Registers merge by max() and agree with the sets' similarity, so
bands of them are keys under which similar documents meet. Documents with equal
sets are one class, by the SHA-256 of the whole sorted set. In a band's bucket every class is paired with one centre only; of the pairs,
those that the joint likelihood of the two sketches puts far below the threshold go,
the others are confirmed on the full sets. Where the classes of a bucket still are in
different components, they are compared on full sets, in blocks within tasks that
return links between components only: the stars cost no link.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, bounded_batches, components, more_components, numbered, small_side, table, with_component

REGISTERS, BAND = 288, 6
BASE, RATE, TOP = 1.001, 20.0, 65535
#: A pair goes without a look at its sets if its estimate is below this; at 0.8 the estimate's deviation is 0.03.
LEAST_ESTIMATE = 0.55
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_M = _RNG.integers(1, 1 << 63, (REGISTERS // BAND, BAND), dtype=np.uint64) | np.uint64(1)
REMEMBERED = 100_000
#: A group's classes are compared in blocks of SPREAD times the root of their number, within these bounds, and of so many shingles on a side.
SPREAD, BLOCK_LEAST, BLOCK_MOST, BLOCK_ITEMS = 2.0, 96, 2048, 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles of ``width`` words; the whole sequence is one if it is shorter."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known, hashes = self.known, np.empty(len(words), np.uint64)
        if len(known) > REMEMBERED:
            known.clear()
        for k, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            hashes[k] = h
        width = min(self.width, len(words))
        last = len(words) - width + 1
        out = np.full(last, width, np.uint64)
        for k in range(width):
            out = _mix(out + hashes[k : k + last])
        return np.unique(out)


def registers(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 256):
        np.minimum(least, (x[k : k + 256, None] * _A + _B).min(0), out=least)
    value = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    return _mix((regs.reshape(_M.shape).astype(np.uint64) * _M).sum(1, dtype=np.uint64) + np.arange(len(_M), dtype=np.uint64)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of each pair (rows of registers, set sizes) with the largest joint likelihood."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    for share in np.linspace(0, 1, 101):
        j = share * np.minimum(u / v, v / u)
        up, down = p(np.maximum(u - v * j, 1e-9)), p(np.maximum(v - u * j, 1e-9))
        fit = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-9))
        better = fit > best
        best[better], at[better] = fit[better], j[better]
    return at


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.sha256(shingles.tobytes()).digest()


def _sketch(width: int):
    def run(batches):
        shingler = Shingler(width)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                n, digest, keys, regs = [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingler(text)
                    r = registers(s) if len(s) else None
                    n.append(len(s))
                    digest.append(_digest(s) if len(s) else None)
                    keys.append(None if r is None else bands(r))
                    regs.append(None if r is None else r.tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(regs, pa.binary())], ["doc_id", "row", "n", "digest", "keys", "regs"])

    return run


def _sets(width: int):
    def run(batches):
        shingler = Shingler(width)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array([shingler(t).view(np.int64) for t in part.column("text").to_pylist()], pa.list_(pa.int64()))], ["cid", "items"])

    return run


def _likely(batches):
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            keep = estimate(a, b, n_a, n_b) >= LEAST_ESTIMATE
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _linked(percent: int):
    def run(key, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """For each query one member of each other component that it is linked with, by the inverted lists of the members' shingles."""
        a, b = [], []
        if len(members) and len(queries):
            ids, comps, sizes = members["cid"].to_numpy(), members["c"].to_numpy(), members["items"].map(len).to_numpy()
            items, owner = np.concatenate(members["items"].to_numpy()), np.repeat(np.arange(len(members)), sizes)
            order = np.argsort(items, kind="stable")
            items, owner = items[order], owner[order]
            for cid, c, own in zip(queries["cid"], queries["c"], queries["items"], strict=True):
                lo, hi = np.searchsorted(items, own, "left"), np.searchsorted(items, own, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(members))
                hit = np.flatnonzero((100 * common >= percent * (sizes + len(own) - common)) & (comps != c))
                first = np.unique(comps[hit], return_index=True)[1]
                a += [cid] * len(first)
                b += ids[hit[first]].tolist()
        return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    return run


def _compare(members: DataFrame, queries: DataFrame, sets: DataFrame, scratch: Scratch, percent: int, *, alike: bool = False) -> DataFrame:
    """Links (a, b) of the queries with the members of the same group (group, cid, c, n in both), in blocks of bounded rows and bytes within tasks.

    ``alike``: both sides are the same rows, so that half of the blocks do.
    """

    def parts(rows: DataFrame, name: str) -> DataFrame:
        block = F.least(F.lit(float(BLOCK_MOST)), F.greatest(F.lit(float(BLOCK_LEAST)), SPREAD * F.sqrt(F.count("*"))))
        return rows.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / float(BLOCK_ITEMS))).cast("int").alias(name))

    grid = scratch.write(parts(members, "rows").join(parts(queries, "columns"), "group"), "blocks")
    every = lambda lo, hi: F.explode(F.sequence(lo, hi))
    own = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    first, last = F.lit(0), lambda n: F.col(n) - 1
    inside = members.join(grid, "group").withColumn("x", own("rows")).select("group", "cid", "c", "x", every(F.col("x") if alike else first, last("columns")).alias("y"))
    asked = queries.join(grid, "group").withColumn("y", own("columns")).select("group", "cid", "c", "y", every(first, F.col("y") if alike else last("rows")).alias("x"))
    inside, asked = (sets.join(small_side(rows), "cid") for rows in (inside, asked))  # where few are compared, the other sets stay where they are
    asked = asked.select(*[F.col(k).alias(k) for k in asked.columns])  # columns of its own, where both sides come from ``sets``
    key = ["group", "x", "y"]
    return scratch.write(inside.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_linked(percent), "a long, b long"), "links")


def _open(members: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """Of the buckets whose classes are in several components: ``to``, the component with most classes there, and key, cid, n, c of the classes that aren't of it."""
    placed = scratch.write(with_component(members.select("key", "cid", "n"), comps, "cid", "c").select("key", "cid", "n", "c"), "placed")
    parts = placed.groupBy("key", "c").agg(F.count("*").alias("size")).groupBy("key").agg(F.max(F.struct("size", "c")).alias("top"), F.count("*").alias("parts"))
    tops = scratch.write(parts.where("parts > 1").select("key", F.col("top.c").alias("to")), "tops")
    open_ = scratch.write(placed.join(tops, "key").where("c != to"), "open")
    scratch.drop(placed)
    return open_


def _against_largest(open_: DataFrame, classes: DataFrame, comps: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links between buckets' largest components and the buckets' other classes."""
    queries = scratch.write(open_.select(F.col("to").alias("group"), "cid", "c", "n").distinct(), "queries")
    wanted = scratch.write(queries.select("group").distinct(), "groups")
    asked = with_component(classes, comps, "cid", "c").select(F.col("c").alias("group"), "cid", "c", "n")
    return _compare(scratch.write(asked.join(wanted, "group", "left_semi"), "asked"), queries, sets, scratch, percent)


def _among_rest(open_: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links between the classes of a bucket that aren't of its largest component: bucket by bucket, those with the same classes once."""
    marks = [F.sum(F.xxhash64("cid", F.lit(k)).cast("decimal(38,0)")).alias(f"mark{k}") for k in (1, 2)]
    several = open_.groupBy("key").agg(F.count("*").alias("size"), F.min("c").alias("low"), F.max("c").alias("high"), F.min("cid").alias("least"), *marks).where("low < high")
    once = scratch.write(several.groupBy("size", "least", "mark1", "mark2").agg(F.min("key").alias("key")).select("key"), "once")
    queries = scratch.write(open_.join(once, "key").select(F.col("key").alias("group"), "cid", "c", "n"), "rest")
    return _compare(queries, queries, sets, scratch, percent, alike=True)


def _with_rest(members: DataFrame, comps: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """``comps`` with all links between classes of the same bucket that the stars left out.

    A class that joins a bucket's largest component hasn't been compared with the
    classes that met that component before, so the pass is repeated until it returns
    no link: then none of a bucket's other classes is linked with the largest component
    as it is, and only pairs of the others are left. Each pass but the last unites components.
    """
    classes = scratch.write(members.select("cid", "n").distinct(), "bucketed")
    while True:
        open_ = _open(members, comps, scratch)
        if open_.isEmpty():
            return comps
        more = _against_largest(open_, classes, comps, sets, scratch, percent)
        if more.isEmpty():
            break
        comps = scratch.write(more_components(comps, more, scratch), "components")
    more = _among_rest(open_, sets, scratch, percent)
    return comps if more.isEmpty() else scratch.write(more_components(comps, more, scratch), "components")


def _with_class(sketched: DataFrame) -> DataFrame:
    """``sketched`` and cid, the class's number: a hash of the set's digest by which no two digests that are there agree, so that equal numbers are equal digests."""
    for seed in range(100):
        numbers = sketched.withColumn("cid", F.when(F.col("n") > 0, F.xxhash64(F.lit(seed), "digest")))
        twice = numbers.where("n > 0").groupBy("cid").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high")
        if twice.isEmpty():
            return numbers.drop("digest")
    raise ValueError("no hash tells the sets apart")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, row_col: str | None = None) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept: a row a row of ``docs``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their
    sets of ``width``-word shingles (64-bit hashes of them). component_id is the smallest
    id that links reach. Null text is empty; an empty set links with nothing. Null ids can't
    be a component's id: a component of such rows only has a null one. kept is true
    for one row a component, that of the smallest id (the first in the table if
    rows repeat). ``row`` is the row's number: that of ``row_col`` (unique longs) if given,
    else of common.numbered(). A text, its set and its hashes must fit a task; other columns
    don't matter, whatever their names. No rows: no rows. Two documents that are linked at
    0.8 miss each other in all 48 bands with a probability of 5e-7.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(row_col).alias("row")] if row_col else []))
    texts = (texts if row_col else numbered(texts, scratch)).select("doc_id", "row", F.coalesce("text", F.lit("")).alias("text"))
    sketched = scratch.write(texts.mapInArrow(_sketch(width), "doc_id long, row long, n long, digest binary, keys array<long>, regs binary"), "sketches")
    sketched = _with_class(sketched)

    keyed = sketched.where("n > 0").select("cid", "n", F.explode("keys").alias("key"))
    buckets = scratch.write(keyed.groupBy("key").agg(F.min("cid").alias("low"), F.max("cid").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "size"), "buckets")
    shared = scratch.write(keyed.join(buckets, "key").distinct(), "shared")
    # the centre of a bucket's star is the class that meets most others: of near copies, what they were copied from
    degree = scratch.write(shared.groupBy("cid").agg(F.sum("size").alias("degree")), "degrees")
    centres = scratch.write(shared.select("key", "cid").join(degree, "cid").groupBy("key").agg(F.max(F.struct("degree", "cid")).alias("top")).select("key", F.col("top.cid").alias("a")), "centres")
    members = scratch.write(shared.select("key", "cid", "n").join(centres, "key"), "members")
    scratch.drop(shared)
    stars = scratch.write(members.where("cid != a").groupBy("a", F.col("cid").alias("b")).agg(F.count("*").alias("shared")), "stars")

    met = small_side(degree.select("cid"))
    chosen = sketched.select("cid", "row", "n", "regs").join(met, "cid", "left_semi").groupBy("cid").agg(F.min_by(F.struct("row", "n", "regs"), "row").alias("r"))
    chosen = scratch.write(chosen.select("cid", "r.*"), "met")
    sets = scratch.write(texts.select("row", "text").join(small_side(chosen.select("row", "cid")), "row").select("cid", "text").mapInArrow(_sets(width), "cid long, items array<long>"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = scratch.write(pairs.select("a", "b"), "pairs")
        for side in "ab":
            both = chosen.select(F.col("cid").alias(side), F.col("n").alias(f"n_{side}"), F.col("regs").alias(f"regs_{side}")).join(small_side(both) if side == "a" else both, side)
        # sizes alone can rule a pair out
        both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        both = scratch.write(both.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(_likely, "a long, b long"), "likely")
        for side in "ab":
            both = sets.select(F.col("cid").alias(side), F.col("items").alias(f"items_{side}")).join(small_side(both) if side == "a" else both, side)
        common = F.size(F.array_intersect("items_a", "items_b"))
        return both.where(100 * common >= percent * (F.size("items_a") + F.size("items_b") - common)).select("a", "b")

    def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = with_component(pairs, comps, side, f"c_{side}")
        return pairs.where("c_a != c_b").select("a", "b")

    # each class with the smallest of the bucket that it shares most bands with, then the other stars that are still apart
    first = stars.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    links = scratch.write(confirmed(first), "links")
    comps = scratch.write(components(links, scratch), "components")
    second = stars.select("a", "b").join(first, ["a", "b"], "left_anti")
    comps = scratch.write(more_components(comps, scratch.write(confirmed(apart(second, comps)), "links"), scratch), "components")
    comps = _with_rest(members, comps, sets, scratch, percent)

    # tables with a row a key, so that adaptive execution can split a hot set's or root's rows
    comps = scratch.write(comps.select(F.col("id").alias("cid"), "component"), "roots")
    rows = sketched.select("doc_id", "row", "n", "cid").join(comps, "cid", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("component", "cid"))).drop("cid", "component")
    groups = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count("*").alias("m")).where("m > 1")
    groups = scratch.write(groups.select("root", "least", F.col("first.row").alias("keep_row")), "groups")
    rows = rows.join(small_side(groups), "root", "left")
    single = F.col("keep_row").isNull()
    return rows.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(single, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), (single | (F.col("row") == F.col("keep_row"))).alias("kept"))


def op5_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).drop("row")
