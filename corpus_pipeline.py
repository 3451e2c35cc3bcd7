"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again for the next one. All but
the last return the columns of ``docs``. Stages 1 to 3 drop rows of the table they
read by numbers that are the same in every job (common.numbered), so rows with null or
repeated ids are told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, exact_dedup, language, mixing, near_dedup
from gridloom.llm.common import Scratch, fresh, numbered, small_side, table

#: Documents whose language is known with less than this probability go, as do those without a letter.
LEAST_SCORE = 0.5


def _numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    row = fresh(docs.columns, "row")
    return numbered(docs, scratch, row), row


def _without(rows: DataFrame, row: str, dropped: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` without those whose numbers are in ``dropped`` (one column), and without the numbers."""
    gone = scratch.write(dropped.toDF(row), "dropped")
    return rows.join(small_side(gone), row, "left_anti").drop(row)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the classifier, trained on the labelled ones, knows for sure."""
    model = language.train(docs)
    if model is None:  # nothing to learn from, nothing to reject by
        return docs
    scratch = Scratch(spark, "language")
    rows, row = _numbered(docs, scratch)
    said = language.predict(rows.select(F.col(row).alias("row"), "text"), model)
    return _without(rows, row, said.where((F.col("lang_pred") == language.UNKNOWN) | (F.col("score") < LEAST_SCORE)).select("row"), scratch)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    scratch = Scratch(spark, "exact")
    rows, row = _numbered(docs, scratch)
    found = exact_dedup.exact_duplicates(rows, row_col=row)
    return _without(rows, row, found.where(~F.col("kept")).select("rid"), scratch)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles (similarity 0.8 or more) connect, the one with the smallest doc_id stays."""
    scratch = Scratch(spark, "near")
    rows, row = _numbered(docs, scratch)
    found = near_dedup.near_duplicates(rows, width=5, percent=80, row_col=row)
    return _without(rows, row, found.where(~F.col("kept")).select("row"), scratch)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are taken 0 to 3 times, by their sources' targets."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The other columns, n_tokens, the ids and the SHA-256 of the decoded bytes."""
    import public_tokenizers

    back = byte_bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return back.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix), ("byte_bpe", encode)]
#: A trained classifier and sketches aren't SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
