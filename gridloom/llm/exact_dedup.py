"""Exact duplicates by a tree-merge of sorted digest runs.

Each partition sorts its (digest, id) pairs and keeps one row a digest: a run, which is
a sequence of packed chunks of sorted rows. Then runs meet in rounds: in round r the
runs of ``FAN`` neighbouring nodes, cut into ranges of the digest, are merged. Only the
chunks are put in order, by their first key; their rows stay packed and sorted on the
way. Whatever is below the first key of the newest chunk can't come again, so a merge
holds one open chunk of each run besides the new ones; of equal keys it keeps the
preferred identifier and adds up the counts. After log_FAN(partitions) rounds every
range has one run. Copies are gone before they are shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, ascii_lower, bounded_batches, numbered, table

FAN = 8
#: Digest ranges. Their number, not a group's size, decides what one task merges in the last round.
RANGES = 1024
#: Rows of a chunk at most, and chunks that are merged at once.
CHUNK, AT_ONCE = 1024, 64
RUN = "node int, part int, first binary, rows binary"
#: The key is the digest and the byte length; in byte order.
ENTRY = np.dtype([("key", "S40"), ("no_id", "u1"), ("id", "<i8"), ("rid", "<i8"), ("n", "<i8")])


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    """The rows (digest, n_bytes, id, rid) of a batch, packed."""
    rows = np.empty(batch.num_rows, ENTRY)
    key = np.empty((batch.num_rows, 40), np.uint8)
    key[:, :32] = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
    key[:, 32:] = batch.column("n_bytes").to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
    rows["key"] = key.view("S40")[:, 0]
    rows["no_id"] = batch.column("id").is_null().to_numpy(zero_copy_only=False)
    rows["id"] = batch.column("id").fill_null(0).to_numpy()
    rows["rid"], rows["n"] = batch.column("rid").to_numpy(), 1
    return rows


def _collapse(rows: np.ndarray, keep: str) -> np.ndarray:
    """One row a key of ``rows``, which are in the keys' order: the preferred identifier and the sum of the counts."""
    new = np.ones(len(rows), bool)
    new[1:] = rows["key"][1:] != rows["key"][:-1]
    if new.all():
        return rows
    ids = ~rows["id"] if keep == "max" else rows["id"]
    rows = rows[np.lexsort((rows["rid"], ids, rows["no_id"], np.cumsum(new)))]
    starts = np.flatnonzero(new)
    out = rows[starts]
    out["n"] = np.add.reduceat(rows["n"], starts)
    return out


def _chunks(node: int, rows: np.ndarray):
    """``rows``, in order, as chunks that lie in one range each."""
    if not len(rows):
        return
    head = np.ascontiguousarray(rows["key"]).view(np.uint8).reshape(-1, 40)[:, :4]
    part = (np.ascontiguousarray(head).view(">u4")[:, 0].astype(np.int64) * RANGES) >> 32
    ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(rows)).tolist()
    starts = [k for lo, hi in zip([0, *ends[:-1]], ends, strict=True) for k in range(lo, hi, CHUNK)]
    spans = list(zip(starts, [*starts[1:], len(rows)], strict=True))
    for k in range(0, len(spans), AT_ONCE):
        some = spans[k : k + AT_ONCE]
        at = [lo for lo, _ in some]
        yield pa.RecordBatch.from_arrays(
            [pa.array([node] * len(some), pa.int32()), pa.array(part[at].astype(np.int32)), pa.array([bytes(rows["key"][lo]).ljust(40, b"\0") for lo in at], pa.binary()), pa.array([rows[lo:hi].tobytes() for lo, hi in some], pa.binary())],
            ["node", "part", "first", "rows"],
        )


def _first_runs(keep: str):
    """A partition's rows (node, digest, n_bytes, id, rid), sorted by digest and length, as a run."""

    def run(batches):
        last, node = np.empty(0, ENTRY), 0
        for batch in batches:
            if batch.num_rows:
                node = batch.column("node")[0].as_py()
                rows = _collapse(np.concatenate([last, _entries(batch)]), keep)
                last = rows[-1:]
                yield from _chunks(node, rows[:-1])
        yield from _chunks(node, last)

    return run


def _merge(keep: str):
    """Merges the runs of each node: chunks come by (node, first)."""

    def run(batches):
        node, held = None, np.empty(0, ENTRY)
        for batch in batches:
            of = batch.column("node").to_numpy()
            edges = np.flatnonzero(np.diff(of)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(of)], strict=True):
                for k in range(lo, hi, AT_ONCE):
                    if of[k] != node:
                        yield from _chunks(node, held)
                        node, held = int(of[k]), np.empty(0, ENTRY)
                    chunks = [np.frombuffer(c, ENTRY) for c in batch.column("rows").slice(k, min(AT_ONCE, hi - k)).to_pylist()]
                    rows = np.concatenate([held, *chunks])
                    rows = _collapse(rows[np.argsort(np.ascontiguousarray(rows["key"]), kind="stable")], keep)
                    done = np.searchsorted(rows["key"], chunks[-1]["key"][0])  # what comes later isn't below this
                    yield from _chunks(node, rows[:done])
                    held = rows[done:]
        yield from _chunks(node, held)

    return run


def _unpack(batches):
    for batch in batches:
        for packed in batch.column("rows").to_pylist():
            rows = np.frombuffer(packed, ENTRY)
            key = np.ascontiguousarray(rows["key"]).view(np.uint8).reshape(-1, 40)
            digests, n_bytes = key[:, :32].tobytes(), np.ascontiguousarray(key[:, 32:]).view(">i8")[:, 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([digests[k : k + 32] for k in range(0, len(digests), 32)], pa.binary()), pa.array(n_bytes), pa.array(rows["id"], mask=rows["no_id"].astype(bool)), pa.array(rows["rid"]), pa.array(rows["n"])],
                ["digest", "n_bytes", "keep_id", "keep_rid", "group_size"],
            )


def merge_runs(base: DataFrame, keep: str = "max") -> DataFrame:
    """The last runs of ``base`` (digest, n_bytes, id, rid): a row (digest, n_bytes, keep_id, keep_rid, group_size) a distinct digest."""
    bounded_batches(base.sparkSession)
    runs = base.select(F.spark_partition_id().alias("node"), "digest", "n_bytes", "id", "rid").sortWithinPartitions("digest", "n_bytes")
    nodes, step = base.rdd.getNumPartitions(), _first_runs(keep)
    while nodes > 1:
        nodes = math.ceil(nodes / FAN)
        runs = runs.mapInArrow(step, RUN).withColumn("node", F.floor(F.col("node") / FAN).cast("int"))
        runs, step = runs.repartition("part", "node").sortWithinPartitions("node", "first"), _merge(keep)
    # the last step unpacks by itself: another Python function in its stage would be another worker beside each task's
    return runs.mapInArrow(lambda batches: _unpack(step(batches)), "digest binary, n_bytes long, keep_id long, keep_rid long, group_size long")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", row_col: str | None = None) -> DataFrame:
    """A row a row of ``docs``: doc_id, rid, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Runs are ordered by the SHA-256 of the whole text, which with the byte length also is
    the check of equality; texts themselves aren't shuffled. ``keep`` = "max" or "min" says
    whose row stays; null ids come last, and of rows with the same id and text
    (repeated rows) the first in the table stays, so one row a group is kept.
    ``rid`` is the row's number: that of ``row_col`` (unique longs) if given, else of
    common.numbered(). Other columns don't matter, whatever their names. Texts may be as
    long as a row can be. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), *([F.col(row_col).alias("rid")] if row_col else []))
    base = (base if row_col else numbered(base, scratch, "rid")).withColumn("t", normalised(F.col("t")))
    base = scratch.write(base.select("id", "rid", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), F.octet_length("t").cast("long").alias("n_bytes")), "digests")
    groups = merge_runs(base, keep).where("group_size > 1")
    joined = base.join(groups, ["digest", "n_bytes"], "left")
    alone = F.col("keep_rid").isNull()
    return joined.select(
        F.col("id").alias("doc_id"), "rid", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op2_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_duplicates(docs).drop("rid")


OP2_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
