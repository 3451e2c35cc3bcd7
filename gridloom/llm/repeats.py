"""Repeated passages: column-wise multi-document sorting of candidate regions.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere.
Every such string holds an anchor: the smallest hash of ``GRAM`` bytes in it, which
depends on the string alone. So occurrences of a string share an anchor at the same
place, and only anchors whose hash is found more than once matter. What surrounds an
anchor (all strings that hold it) is its region. Equal regions are covered whole; those
that follow each other closely within a text, as in a run of one byte, are one row.
The distinct regions of anchors with several are sorted column by column, from the
last to the first: each round puts one more symbol in front of every region's
suffix, by a stable sort of the order so far, as in a collection's Burrows-Wheeler
transform, and updates the common prefixes of neighbours in that order. A string
starting in the column is repeated if it has LENGTH symbols in common with a
neighbour. Regions are handled in blocks of bounded size, whose columns are read
one after another. The regions of an anchor with more of them than a block takes are
told apart by the hashes of their strings, grouped by Spark, instead of in one block.
Regions are equal if 128 bits of hashes are (the anchor's and the region's).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, bounded_batches, numbered, small_side, table

LENGTH, GRAM = 200, 32
#: Bytes that are hashed at once; longer texts are cut into overlapping pieces.
PIECE = 1 << 20
#: Regions in a block, on average; an anchor with more than HOT of them isn't put into a block.
BLOCK, HOT = 5_000, 16_000
PAD = 256


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position (GRAM a power of two)."""
    h, odd = b.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(odd) + h[step:]
        h ^= h >> np.uint64(29)
        odd = (odd * odd + 2 * step + 1) % (1 << 64) | 1
        step *= 2
    return (h * np.uint64(0xBF58476D1CE4E5B9)) ^ (h >> np.uint64(32))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """min or max over each run of ``width`` values."""
    out, have = x, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    more = width - have
    return pick(out[: len(out) - more], out[more:]) if more else out


def anchors(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the GRAM-byte strings that are the least of some ``length``-byte string of ``raw``."""
    at, hashes = [], []
    width = length - GRAM + 1
    for k in range(0, len(raw) - length + 1, PIECE):
        h = _gram_hashes(np.frombuffer(raw, np.uint8, min(PIECE + length - 1, len(raw) - k), k))
        least = _slide(h, width, np.minimum)  # of the string from each position
        most = _slide(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
        hit = np.flatnonzero(most == h)
        at.append(hit + k)
        hashes.append(h[hit])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    where, first = np.unique(np.concatenate(at), return_index=True)
    return where, np.concatenate(hashes)[first]


def _runs(h: np.ndarray, g: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, counts): anchors by (h, g, at), and the runs of equal ones of which each starts within ``length`` of the one before."""
    order = np.lexsort((at, g, h))
    h, g, at = h[order], g[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (at[1:] - at[:-1] > length)
    starts = np.flatnonzero(new)
    return order, starts, np.diff(np.append(starts, len(at)))


def _anchors(length: int):
    """A row a run of equal regions: the anchor's and the region's hash, the row, the first and the last place, and how many."""

    def run(batches):
        import xxhash

        left = length - GRAM
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows, places, ends, counts, hashes, regions = [], [], [], [], [], []
                for row, text in zip(part.column("row").to_numpy(), part.column("text").to_pylist(), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    at, h = anchors(raw, length)
                    h, g = h.view(np.int64), np.fromiter((xxhash.xxh3_64_intdigest(raw[max(0, p - left) : p + length], min(p, left)) for p in at.tolist()), np.uint64, len(at)).view(np.int64)
                    order, starts, n = _runs(h, g, at, length)
                    first = order[starts]
                    rows.append(np.full(len(starts), row))
                    places.append(at[first])
                    ends.append(at[order[starts + n - 1]] if len(starts) else at)
                    counts.append(n)
                    hashes.append(h[first])
                    regions.append(g[first])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (hashes, regions, rows, places, ends, counts)], ["h", "g", "row", "at", "to", "n"])

    return run


def _string_hashes(length: int):
    """For each region the 128-bit hash of every string of ``length`` that holds its anchor, and where it starts."""

    def run(batches):
        import xxhash

        for batch in batches:
            for r in batch.to_pylist():
                region, start = r["region"], r["at"] - r["left"]
                hashes = [xxhash.xxh3_128_digest(region[k : k + length]) for k in range(min(r["left"], len(region) - length) + 1)]
                n = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array([r["row"]] * n, pa.int64()), pa.array([start + k for k in range(n)], pa.int64()), pa.array([r["alone"]] * n, pa.bool_())], ["string", "row", "lo", "alone"])

    return run


def _cut(length: int):
    def run(batches):
        left = length - GRAM
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for r in batch.slice(k, 64).to_pylist():
                    raw = r["text"].encode("utf-8", "surrogatepass")
                    at = r["places"]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p["block"] for p in at], pa.int32()), pa.array([r["row"]] * len(at), pa.int64()), pa.array([p["at"] for p in at], pa.int64()), pa.array([p["alone"] for p in at], pa.bool_()),
                            pa.array([min(p["at"], left) for p in at], pa.int32()), pa.array([raw[max(0, p["at"] - left) : p["at"] + length] for p in at], pa.binary()),
                        ],
                        ["block", "row", "at", "alone", "left", "region"],
                    )

    return run


def sort_columns(symbols: np.ndarray, length: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) start column below ``starts`` of each row's strings of ``length`` that another row has in the same column; -1: none.

    ``symbols`` has a row of uint16 a column of the regions, PAD where there is none.
    """
    columns, m = symbols.shape
    order, common = np.arange(m), np.zeros(m + 1, np.int32)  # common[i]: of the suffixes at i - 1 and i
    least, most = np.full(m, -1), np.full(m, -1)
    for c in range(columns - 1, -1, -1):
        now = symbols[c][order]
        perm = np.argsort(now, kind="stable")
        at, sym = perm, now[perm]
        equal = np.flatnonzero((sym[1:] == sym[:-1]) & (sym[1:] != PAD)) + 1
        then = np.zeros(m + 1, np.int32)
        if len(equal):
            spans = np.stack([at[equal - 1] + 1, at[equal] + 1], 1).ravel()
            then[equal] = np.minimum.reduceat(common, spans)[::2] + 1
            # of suffixes below the last column nothing is known yet, so they have nothing but this symbol in common
            if c == columns - 1:
                then[equal] = 1
        order, common = order[perm], then
        if c < starts:
            long = common >= length
            hit = order[long[:-1] | long[1:]]
            most[hit] = np.maximum(most[hit], c)
            least[hit] = c
    return least, most


def _repeated(length: int):
    left = length - GRAM

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        symbols = np.full((left + length, len(pdf)), PAD, np.uint16)
        for k, (region, before) in enumerate(zip(pdf["region"], pdf["left"], strict=True)):
            symbols[left - before : left - before + len(region), k] = np.frombuffer(region, np.uint8)
        least, most = sort_columns(symbols, length, left + 1)
        hit = (least >= 0) & pdf["alone"].to_numpy()
        at = pdf["at"].to_numpy()[hit] - left
        return pd.DataFrame({"row": pdf["row"].to_numpy()[hit], "lo": at + least[hit], "hi": at + most[hit] + length})

    return run


def merge_spans(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((max(0, lo), min(size, hi)) for lo, hi in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _remove(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            n, kept, cut = [], [], []
            for r in part.select(["text", "spans"]).to_pylist():
                raw = r["text"].encode("utf-8", "surrogatepass")
                spans = merge_spans([(s["lo"], s["hi"]) for s in r["spans"] or []], len(raw))
                ends = [0, *(x for s in spans for x in s), len(raw)]
                n.append(len(raw))
                kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                cut.append([{"lo": lo, "hi": hi} for lo, hi in spans])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(cut, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, row_col: str | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (lo, hi of removed bytes, maximal, in order), kept (the remaining bytes): a row a row of ``docs``.

    Matches never cross texts and are judged on the input. Null text is empty;
    texts shorter than ``length`` have no matches. Repeated rows are texts of their
    own, so they repeat each other. Rows are told apart by ``row_col`` (unique longs) if
    given, else by common.numbered(); ids are carried along, other columns don't matter.
    Whole texts are read; one text, with its spans, must fit a task. No rows: no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "repeats")
    left = length - GRAM
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(row_col).alias("row")] if row_col else []))
    texts = (texts if row_col else numbered(texts, scratch)).select("doc_id", "row", F.coalesce("text", F.lit("")).alias("text"))
    found = scratch.write(texts.select("row", "text").mapInArrow(_anchors(length), "h long, g long, row long, at long, to long, n long"), "anchors")
    # tables with a row a key, so that adaptive execution can split a hot anchor's or region's rows
    often = scratch.write(found.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "often")
    shared = scratch.write(found.join(often, "h"), "shared")
    scratch.drop(found)
    regions = scratch.write(shared.groupBy("h", "g").agg(F.sum("n").alias("n"), F.min(F.struct("row", "at")).alias("first")), "regions")
    whole = shared.join(regions.where("n > 1").select("h", "g"), ["h", "g"]).select("row", (F.col("at") - left).alias("lo"), (F.col("to") + length).alias("hi"))
    several = scratch.write(regions.groupBy("h").agg(F.count("*").alias("ways")).where("ways > 1"), "several")
    reps = regions.join(several, "h").select("h", F.col("first.row").alias("row"), F.col("first.at").alias("at"), (F.col("n") == 1).alias("alone"), (F.col("ways") > HOT).alias("hot"))
    reps = scratch.write(reps, "representatives")
    total, hot = reps.agg(F.count("*"), F.coalesce(F.sum(F.col("hot").cast("int")), F.lit(0))).first()
    blocks = max(1, -(-(total - hot) // BLOCK))
    block = F.when(~F.col("hot"), F.pmod(F.xxhash64("h"), F.lit(blocks))).cast("int")
    places = reps.withColumn("block", block).groupBy("row").agg(F.collect_list(F.struct("block", "at", "alone")).alias("places"))
    some = texts.select("row", "text").join(small_side(reps.select("row").distinct()), "row", "left_semi").join(places, "row")
    cut = some.mapInArrow(_cut(length), "block int, row long, at long, alone boolean, left int, region binary")
    partly = cut.where("block IS NOT NULL").groupBy("block").applyInPandas(_repeated(length), "row long, lo long, hi long")
    if hot:
        strings = scratch.write(cut.where("block IS NULL").mapInArrow(_string_hashes(length), "string binary, row long, lo long, alone boolean"), "strings")
        twice = scratch.write(strings.groupBy("string").agg(F.min(F.struct("row", "lo")).alias("first"), F.max(F.struct("row", "lo")).alias("last")).where("first < last").select("string"), "twice")  # one place can be found by several anchors
        partly = partly.unionByName(strings.where("alone").join(twice, "string").select("row", "lo", (F.col("lo") + length).alias("hi")))
    spans = scratch.write(whole.unionByName(partly).groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    scratch.drop(shared)
    return texts.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(_remove, "doc_id long, n_bytes long, spans array<struct<lo:long,hi:long>>, kept binary")


def op6_remove_repeats(spark, sf_dir):
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, straight from the definition."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out
