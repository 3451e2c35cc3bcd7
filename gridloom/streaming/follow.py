"""Operators over a growing folder of snapshots: each micro-batch runs the batch operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def write_batch(result: DataFrame, out: str, number: int) -> None:
    """Writes a batch's folder, ``batch=number`` of the table ``out``, over whatever an attempt before left there."""
    result.write.mode("overwrite").parquet(f"{out}/batch={number}")


def follow(spark: SparkSession, path: str, schema, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Starts a query that writes operator(new cells) to the Parquet table ``out``, which is split by batch; a batch that is tried again replaces its own rows."""
    each = lambda batch, number: write_batch(operator(batch), out, number)
    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
