"""Landed records as a format, and sinks whose batches may come again."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from veridrift.sources import ledger, records

FACTS = [(f"p{i % 40}", ["Condition", "MedicationRequest"][i % 2], str(i), i, f"name {i}", None if i % 3 else "5 mg", i % 5 > 0) for i in range(400)] + [(None, "Condition", "x", 1, "nobody", None, None)]


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("records"))
    records.land_records(spark.createDataFrame(FACTS, records.RECORD), path)
    return records.records_session(spark), path


def test_all_records_and_filters(landed):
    session, path = landed
    everything = records.records(session, path)
    assert sorted(map(tuple, everything.collect()), key=str) == sorted(FACTS, key=str)
    assert {r.id for r in everything.where("patient_id = 'p7'").collect()} == {f[2] for f in FACTS if f[0] == "p7"}
    assert {r.id for r in everything.where("patient_id in ('p7', 'p9') and pos > 100 and resource_type = 'MedicationRequest'").collect()} == {f[2] for f in FACTS if f[0] in ("p7", "p9") and f[3] > 100 and f[1] == "MedicationRequest"}
    assert [r.name for r in everything.where("id = '17'").collect()] == ["name 17"]
    assert everything.where("patient_id = 'p7' and patient_id = 'p8'").count() == 0
    assert everything.where("patient_id is null").count() == 1


def test_pages_and_malformed_lines(landed, tmp_path):
    session, path = landed
    paged = records.records(session, path, perPatient="3").where("patient_id = 'p8'")
    assert {(r.resource_type, r.n) for r in paged.groupBy("resource_type").agg(F.count("*").alias("n")).collect()} == {("Condition", 3)}
    (tmp_path / "bucket=0").mkdir()
    (tmp_path / "bucket=0" / "part.json").write_text('{"patient_id": "a", "id": "1"}\nnot json\n{"patient_id": "b"\n{"patient_id": "c"}\n')
    assert {r.patient_id for r in records.records(session, f"file:{tmp_path}").collect()} == {"a", "c"}


def test_predicates_reach_the_reader(landed):
    session, path = landed
    asked = records.records(session, path).where("patient_id = 'p7' and pos > 3")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    kept = [line for line in plan.split("\n") if "Filter" in line]
    assert not any("patient_id#" in line and "= p7" in line for line in kept), plan
    every = records.RecordReader({"path": path})
    one = records.RecordReader({"path": path})
    left = list(one.pushFilters([EqualTo(("patient_id",), "p7"), In(("id",), ("7", "8")), GreaterThan(("pos",), 3)]))
    assert left == [GreaterThan(("pos",), 3)]
    folders = lambda reader: {p.rsplit("/", 1)[0] for f in reader.partitions() for p in f.paths}
    assert len(folders(one)) == 1 < len(folders(every))
    assert {r[2] for f in one.partitions() for r in one.read(f)} == {"7"}
    assert asked.rdd.getNumPartitions() == len(one.partitions())


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    rows = spark.range(5).select(F.col("id").cast("string").alias("user_id"))
    assert ledger.commit_batch(rows, str(tmp_path), 0)
    assert not ledger.commit_batch(rows, str(tmp_path), 0)
    assert ledger.commit_batch(rows.limit(2), str(tmp_path), 1)
    rows.write.parquet(f"{tmp_path}/rows/batch=2/attempt=died")  # an attempt that never came to its entry
    assert ledger.committed(spark, str(tmp_path)).groupBy("batch").count().orderBy("batch").collect() == [(0, 5), (1, 2)]
    assert ledger.commit_batch(rows, str(tmp_path), 2)
    assert ledger.committed(spark, str(tmp_path)).count() == 12


@pytest.mark.parametrize("kind", ["audit", "model", "activity"])
def test_streams_that_start_anew_commit_once(spark, tmp_path, kind):
    shape = "user_id string, action string, text string, entropy double, uncertainty double, confidence double, n int, claims array<struct<claim_text:string>>"
    rows = [("u", "a", "call 5551234567", None, 0.5, 0.2, None, [("ssn 123-45-6789",)])] * 4
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
    start = {"audit": lambda: ledger.audit_sink(stream, f"{tmp_path}/log", ["text"], "claims"), "model": lambda: ledger.model_log_sink(stream, f"{tmp_path}/log"), "activity": lambda: ledger.activity_sink(stream, f"{tmp_path}/log")}[kind]
    start().awaitTermination()
    (tmp_path / "log" / "checkpoint").rename(tmp_path / "lost")  # as after a driver whose checkpoint is lost
    start().awaitTermination()
    got = ledger.committed(spark, f"{tmp_path}/log").collect()
    assert len(got) == 4
    if kind == "audit":
        assert got[0].text == "call [PHONE]" and got[0].claims[0].claim_text == "ssn [SSN]" and got[0].n == 0
    if kind == "model":
        assert got[0].score == 0.5
    if kind == "activity":
        assert got[0].user_id == "u" and got[0].ip is None
