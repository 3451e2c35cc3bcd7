"""Mixing sources to target weights: hash-threshold histograms, DataFrame functions only.

Every document has a 60-bit hash of its id. A source's budget is met by the
documents whose hash is at or below a threshold. The threshold is found without
a sort: words are summed by source and the first 12 bits of the hash, the bucket
in which the running sum passes the budget is found, and only that bucket's
documents are summed again by the next 12 bits, until it holds one hash. Budgets
are nested: a larger budget takes all that a smaller one takes, and more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, small_side, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3
BITS, STEP = 60, 12


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(doc_id: Column) -> Column:
    hexed = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(hexed, 1, BITS // 4), 16, 10).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _targets(sources: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """Water-filling: shares by weight, cut at ``repeats`` times a source's size, the excess reshared."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    n = sources.withColumn("rank", F.row_number().over(rank) - 1)
    n = n.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    n = n.withColumn("cap", F.col("source_size") * repeats)
    every, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    big = lambda c: c.cast("decimal(38,0)")
    total, weight_left = F.sum("source_size").over(every), F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    cap_before = F.coalesce(F.sum("cap").over(before), F.lit(0))
    n = n.withColumn("total", total).withColumn("full", big(F.col("cap")) * weight_left <= big(total - cap_before) * F.col("weight"))
    spent, open_weight = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every), F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    share = (F.col("total") - spent).cast("double") * F.col("weight") / F.greatest(open_weight, F.lit(1))
    return n.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)).select("key", "source_size", "target")


def plan_mix(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """(sized, plan): a row a document (doc_id, key, size, h), and a row a source (key, source_size, target, copies, upto).

    A document of a source is taken ``copies`` times, and once more if its hash
    h is at most ``upto`` (null: none). The boundary hash is taken if that
    leaves the source nearer its target. The state between levels is a row a
    source, kept as a table; it is broadcast only if small.

    Null text has size 0. A null source is a source, the last. Rows with equal
    ids (repeated rows; null ids) share a hash, so are taken alike. A source
    without words has target 0 and keeps its documents once. No rows: no sources.
    """
    sized = scratch.write(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _key(F.col(source_col)).alias("key"), words(F.col(text_col)).alias("size"), _hash(F.col(id_col)).alias("h")), "sized")
    sources = sized.groupBy("key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    plan = _targets(sources, weights, repeats)
    copies = F.when(F.col("source_size") == 0, 1).otherwise(F.least(F.lit(repeats), F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))).cast("long")
    plan = plan.withColumn("copies", copies)
    plan = scratch.write(plan.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size")) * F.when(F.col("source_size") > 0, 1).otherwise(0)), "plan")
    state = plan.where("source_size > 0").select("key", "budget", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("before"))
    done = None
    for shift in range(BITS - STEP, -1, -STEP):
        inside = sized.select("key", "size", "h").join(small_side(state), "key").where(F.shiftright("h", shift + STEP) == F.col("bucket"))
        hist = inside.groupBy("key", "budget", "before", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("w"), F.min("h").alias("low"), F.max("h").alias("high"))
        run = Window.partitionBy("key").orderBy("bucket")
        hist = hist.withColumn("upto", F.col("before") + F.sum("w").over(run))
        over = hist.where("upto > budget").withColumn("first", F.row_number().over(run)).where("first = 1")
        found = scratch.write(over.select("key", "budget", "bucket", (F.col("upto") - F.col("w")).alias("before"), "w", "low", "high"), "boundary")
        ended = found.where("low = high" if shift else "true")
        ended = ended.select("key", F.when(F.col("before") + F.col("w") - F.col("budget") <= F.col("budget") - F.col("before"), F.col("low")).otherwise(F.col("low") - 1).alias("upto"))
        done = ended if done is None else done.unionByName(ended)
        state = found.where("low < high").select("key", "budget", "bucket", "before")
        if state.isEmpty():
            break
    return sized, scratch.write(plan.join(done, "key", "left").drop("budget"), "thresholds")


def _copies() -> Column:
    return (F.col("copies") + F.when(F.col("h") <= F.col("upto"), 1).otherwise(0)).cast("long")


def mix_decisions(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: a row a document. See plan_mix for the cases."""
    sized, plan = plan_mix(docs, Scratch(docs.sparkSession, "mix"), **options)
    taken = sized.join(small_side(plan), "key").withColumn("copies", _copies())
    return taken.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mixed rows themselves: columns as in ``docs``, a row for each time a document is taken."""
    _, plan = plan_mix(docs, Scratch(docs.sparkSession, "mix"), id_col=id_col, source_col=source_col, **options)
    kept = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), _key(F.col(source_col)).alias("key"), _hash(F.col(id_col)).alias("h"))
    rows = rows.join(small_side(plan.select("key", "copies", "upto")), "key")
    return rows.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.when(_copies() > 0, _copies()))).alias("_copy")).select(*kept)


def op1_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_decisions(docs)


OP1_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM sources),
prefix AS (
  SELECT *, sum(source_size) OVER () AS total,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left, coalesce(sum(cap) OVER before, 0) AS cap_before
  FROM weighed WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap::HUGEINT * weight_left <= (total - cap_before)::HUGEINT * weight AS is_full FROM prefix),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE
    (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::DOUBLE * weight / greatest(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (), 1)::DOUBLE END AS target
  FROM capped),
planned AS (SELECT *, CASE WHEN source_size = 0 THEN 1 ELSE least(3, floor(target / greatest(source_size, 1)))::BIGINT END AS base FROM targets),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN greatest(0.0, target - base * source_size) ELSE -1 END AS budget FROM planned),
run AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.base, b.budget, s.h,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS w
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source),
taken AS (
  SELECT *, base + CASE WHEN budget >= 0 AND (upto <= budget OR (upto - w <= budget AND upto - budget <= budget - (upto - w))) THEN 1 ELSE 0 END AS copies FROM run)
SELECT doc_id, size, source_size, target, copies::BIGINT AS copies, (size * copies)::BIGINT AS taken FROM taken
"""
