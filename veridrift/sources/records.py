"""Landed records as a registered format: predicates on patient, kind and id reach the reader, which opens only the files that can have them."""

from __future__ import annotations

import io
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

RECORD = "patient_id string, resource_type string, id string, pos int, name string, detail string, active boolean"
FORMAT, BUCKETS = "landed_records", 64
_PUSHED = "spark.sql.python.filterPushdown.enabled"


def land_records(facts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write ``RECORD`` rows as JSON lines in a folder for each bucket of the patient's crc32, so that a patient's records lie in one folder."""
    rows = facts.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in RECORD.split(", ")])
    bucket = F.coalesce(F.crc32("patient_id") % buckets, F.lit(0))
    rows.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").option("ignoreNullFields", "true").json(path)


def _uri(path: str) -> str:
    """``/folder`` and ``file:/folder`` as URIs; others as they are, for stores that pyarrow reads."""
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class RecordReader(DataSourceReader):
    """Takes equality and membership on ``patient_id, resource_type, id``; a patient decides the bucket."""

    def __init__(self, options: dict) -> None:
        self.path, self.buckets = options["path"], int(options.get("buckets", BUCKETS))
        self.per_patient = int(options["perpatient"]) if options.get("perpatient") else None
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in ("patient_id", "resource_type", "id"):
                yield f
                continue
            values = {str(v) for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
            self.wanted[column] = self.wanted[column] & values if column in self.wanted else values

    def partitions(self) -> list[_Files]:
        """A task for each file, or for each bucket where rows of a patient are counted."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(_uri(self.path))
        patients = self.wanted.get("patient_id")
        which = None if patients is None else {zlib.crc32(p.encode()) % self.buckets for p in patients}
        out = []
        for folder in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            m = re.fullmatch(r"bucket=(\d+)", PurePosixPath(folder.path).name)
            if m and (which is None or int(m[1]) in which):
                files = sorted(i.path for i in store.get_file_info(fs.FileSelector(folder.path)) if i.is_file and i.path.endswith(".json"))
                out += [_Files([f]) for f in files] if self.per_patient is None else [_Files(files)]
        return out

    def read(self, partition: _Files) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(_uri(self.path))
        names, seen = [c.split()[0] for c in RECORD.split(", ")], Counter()
        for path in partition.paths:
            with store.open_input_stream(path) as raw:
                for line in io.TextIOWrapper(raw, "utf-8"):
                    try:
                        row = json.loads(line)
                    except ValueError:
                        continue  # a malformed line costs its own row only
                    if any(row.get(c) not in values for c, values in self.wanted.items()):
                        continue
                    key = (row.get("patient_id"), row.get("resource_type"))
                    seen[key] += self.per_patient is not None
                    if self.per_patient is None or seen[key] <= self.per_patient:
                        yield tuple(row.get(c) for c in names)


class RecordSource(DataSource):
    """``spark.read.format("landed_records").option("path", ...)``; option ``perPatient`` bounds the rows of a patient and kind, as a page of a record system does."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: object) -> RecordReader:
        return RecordReader({k.lower(): v for k, v in self.options.items()})


#: Sources by name; each is a registered format that gives ``RECORD`` rows.
PROVIDERS: dict[str, type[DataSource]] = {FORMAT: RecordSource}


def records_session(spark: SparkSession) -> SparkSession:
    """A session of its own that knows the formats of ``PROVIDERS`` and lets predicates reach them; the given session's settings stay."""
    session = spark.newSession()
    session.conf.set(_PUSHED, "true")
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    for source in PROVIDERS.values():
        session.dataSource.register(source)
    return session


def records(session: SparkSession, path: str, provider: str = FORMAT, **options: str) -> DataFrame:
    """All records of a provider; filters on patient, kind and id that follow are answered by its reader."""
    return session.read.format(provider).option("path", path).options(**options).load()
