"""Streams of predictions and outcomes: coverage over count windows, joins with late outcomes, windowed audit counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COVERAGE_SCHEMA = "key string, n long, coverage double, gap double, severity string"


def coverage_monitor(stream: DataFrame, key: str, seq: list[str], covered: str, window: int = 100, target: float = 0.9, tolerance: float = 0.05) -> DataFrame:
    """Coverage of the last ``window`` outcomes of each key after each batch: ``key, n, coverage, gap, severity``.

    State is a key's last ``window`` flags. ``covered`` is a boolean column; rows of a batch are
    taken in the order of ``seq``.
    """

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(seq)
        seen, flags = state.get if state.exists else (0, "")
        flags = (flags + "".join("1" if c else "0" for c in rows["covered"]))[-window:]
        state.update((seen + len(rows), flags))
        n, coverage = len(flags), flags.count("1") / len(flags)
        gap = target - coverage
        level = "none" if n < window // 2 or gap <= 0 else "low" if gap < tolerance else "medium" if gap < 2 * tolerance else "high" if gap < 3 * tolerance else "critical"
        yield pd.DataFrame({"key": [str(group[0])], "n": [n], "coverage": [coverage], "gap": [gap], "severity": [level]})

    rows = stream.select(F.col(key).cast("string").alias("key"), *seq, F.col(covered).cast("boolean").alias("covered"))
    return rows.groupBy("key").applyInPandasWithState(update, COVERAGE_SCHEMA, "seen long, flags string", "update", GroupStateTimeout.NoTimeout)


def outcome_join(predictions: DataFrame, outcomes: DataFrame, wait: str = "30 days") -> DataFrame:
    """Predictions with their outcomes by id, if these come within ``wait``; state older than that is dropped.

    ``predictions``: prediction_id, predicted_at, lower, upper; ``outcomes``: outcome_id, observed_at, outcome.
    """
    p = predictions.withWatermark("predicted_at", wait)
    o = outcomes.withWatermark("observed_at", wait)
    on = F.expr(f"prediction_id = outcome_id and observed_at >= predicted_at and observed_at <= predicted_at + interval {wait}")
    return p.join(o, on).select("prediction_id", "predicted_at", "observed_at", F.col("outcome").between(F.col("lower"), F.col("upper")).alias("covered"))


def audit_counts(logs: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Log entries of each action in tumbling event-time windows; later entries than ``late`` are left out."""
    windowed = logs.withWatermark("timestamp", late).groupBy(F.window("timestamp", every), "action")
    return windowed.agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "action", "n")


def run_once(stream: DataFrame, path: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Process what there is, then stop; returns what was written to ``path``. ``update`` mode keeps the last row of each key."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint")
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer.foreachBatch(store).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, _batch long").parquet(path)
    last = rows.groupBy(*(keys or [])).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in (keys or [])]), "_batch").alias("r"))
    return last.select(*(keys or []), "r.*")
