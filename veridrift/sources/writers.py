"""Writers of logs, training rows, experiment results and fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import model_log_entry, redact


def append_audit(results: DataFrame, path: str, columns: list[str], nested: str | None = None) -> None:
    """Append analyses to the audit log, personal information masked first, missing counts as 0, partitioned by day."""
    counts = [c for c, kind in results.dtypes if kind in ("int", "bigint")]
    rows = redact(results, columns, nested).fillna(0, counts)
    rows.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)


def append_model_log(rows: DataFrame, path: str) -> None:
    model_log_entry(rows).write.mode("append").parquet(path)


def write_training_rows(rows: DataFrame, path: str) -> None:
    """JSON lines; nulls are written."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_cases_csv(rows: DataFrame, path: str, sets: list[str] = ()) -> None:
    """CSV with a header: booleans as 0 and 1, sets joined with a pipe."""
    flat = {c: F.array_join(c, "|") for c in sets} | {c: F.col(c).cast("int") for c, kind in rows.dtypes if kind == "boolean"}
    rows.withColumns(flat).write.mode("overwrite").option("header", True).csv(path)


def save_model(model: DataFrame, path: str) -> None:
    """A fitted threshold or bin table."""
    model.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_tracker(predictions: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """One JSON document for each key with its predictions and statistics."""
    fields = [c for c in predictions.columns if c != key]
    per = predictions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("predictions"))
    joined = per.join(stats.select(key, F.struct(*[c for c in stats.columns if c != key]).alias("stats")), key, "left")
    return joined.select(key, F.to_json(F.struct("predictions", "stats")).alias("document"))


def write_run_metadata(spark: SparkSession, path: str, settings: dict, results: dict) -> None:
    """Settings and results of a run as one JSON document, written like any table so that the path may be remote."""
    from json import dumps

    document = dumps({"settings": settings, "results": results}, sort_keys=True)
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.mode("overwrite").text(path)
