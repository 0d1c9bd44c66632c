"""Sinks of batches that may be written again: a ledger says which attempt of a batch counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.audit import activity_entry, model_log_entry, redact


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def commit_batch(rows: DataFrame, path: str, batch: int) -> bool:
    """Write a batch under ``path`` unless the ledger has it; whether it was written.

    Each attempt writes a folder of its own, then the ledger's entry of the batch names that attempt. An attempt that dies
    leaves a folder that nobody reads; one that comes after the entry writes nothing. The entry is Spark's own write of one file,
    complete with its ``_SUCCESS`` mark.
    """
    spark, entry = rows.sparkSession, f"{path}/ledger/batch={batch}"
    if _exists(spark, f"{entry}/_SUCCESS"):
        return False
    attempt = uuid.uuid4().hex
    rows.write.parquet(f"{path}/rows/batch={batch}/attempt={attempt}")
    spark.range(1).select(F.lit(attempt).alias("attempt")).coalesce(1).write.mode("overwrite").parquet(entry)
    return True


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches in the ledger, each once, with ``batch``: only attempts that the ledger names are read."""
    entries = spark.read.option("basePath", f"{path}/ledger").parquet(f"{path}/ledger").select(F.col("batch").cast("long").alias("batch"), "attempt")
    rows = spark.read.option("basePath", f"{path}/rows").option("mergeSchema", "true").parquet(f"{path}/rows")
    met = rows.withColumn("batch", F.col("batch").cast("long")).join(entries, ["batch", "attempt"], "left_semi")
    return met.select(*[c for c in met.columns if c not in ("batch", "attempt")], "batch")


def _sink(stream: DataFrame, path: str, entries: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Start a stream that commits each of its batches once, however often it is run again from its checkpoint or without one."""

    def commit(batch: DataFrame, number: int) -> None:
        commit_batch(entries(batch), path, number)

    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(commit).start()


def audit_sink(stream: DataFrame, path: str, columns: list[str], nested: str | None = None) -> StreamingQuery:
    """Analyses to the audit log: personal information masked first, missing counts as 0."""
    counts = [c for c, kind in stream.dtypes if kind in ("int", "bigint")]
    return _sink(stream, path, lambda batch: redact(batch, columns, nested).fillna(0, counts))


def model_log_sink(stream: DataFrame, path: str) -> StreamingQuery:
    return _sink(stream, path, model_log_entry)


def activity_sink(stream: DataFrame, path: str) -> StreamingQuery:
    return _sink(stream, path, activity_entry)
