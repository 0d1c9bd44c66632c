"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and about the bytes, that a task holds as Python objects at a time.
STEP, STEP_BYTES = 256, 8 << 20


#: Bytes of an Arrow batch on its way to a worker (Spark's default is 64 MB): very long texts come few at a time.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``BATCH_BYTES``, unless a smaller bound is set."""
    now = spark.conf.get(_BATCH)
    if not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def slices(batches: Iterable[pa.RecordBatch], step: int = STEP) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of at most ``step`` rows, fewer where rows are long."""
    for batch in batches:
        rows = max(1, min(step, STEP_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(column: pa.Array) -> list[str]:
    """The strings of a column, null as the empty string."""
    return pc.fill_null(column.cast(pa.string()), "").to_pylist()


def ids_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that text operators read, whatever else the table has."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free_name(base: str, *tables: DataFrame) -> str:
    """``base``, lengthened until no column of the tables has that name in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def shared_folder(spark: SparkSession) -> str:
    """A new path under the cluster's shared ``spark.checkpoint.dir``. Where that is unset a temporary folder is set for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            base = set_dir.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            base = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, base, True)
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Lets Spark drop the shuffle files of a job once its table is written, not when the driver next collects garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost no recomputation."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    small_batches(spark)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def again(table: DataFrame) -> DataFrame:
    """A table of ``written`` under new column identities, to be joined with itself."""
    spark, path = table.sparkSession, table._written_to
    out = spark.read.schema(table.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
