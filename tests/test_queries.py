"""Every query of the library against its SQL on the smallest tables; plans; streams against their batch twins."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from veridrift.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        return f"{float(v):.8g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    assert comparable(df.collect(), df.columns) == comparable(cursor.fetchall(), [c[0] for c in cursor.description])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entailment_clusters_compare_whole_texts(spark, tmp_path):
    texts = {1: ["the dose is 5", "the dose is 9", " The  dose is 5", None, "the"], 2: ["abc", "abd", "abc"]}
    rows = [(c, t, text) for c, said in texts.items() for t, text in enumerate(said)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.cluster_id for r in QUERIES["entailment_clusters"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 0, (1, 3): 2, (1, 4): 3, (2, 0): 0, (2, 1): 1, (2, 2): 0}


def test_entailment_clusters_make_no_pairs(spark, tmp_path):
    rows = [(1, 3, "b"), (1, 1, "a"), (1, 2, "b"), (1, 5, None), (1, 4, None), (1, 7, " B"), (1, None, "a"), (2, 0, ""), (2, 1, " "), (None, 0, "a")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = QUERIES["entailment_clusters"](spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().toString() and dict(df.dtypes) == {"conv_id": "bigint", "turn": "bigint", "cluster_id": "int"}
    assert {(r.conv_id, r.turn): r.cluster_id for r in df.collect()} == {(1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 7): 1, (1, 4): 2, (1, 5): 3, (1, None): 4, (2, 0): 0, (2, 1): 0, (None, 0): 0}


def test_fitted_pipeline_reads_texts_once(spark):
    assert not [f for f in QUERIES["fitted_pipeline"](spark, SF).inputFiles() if "documents" in f]


def test_finance_claims_of_several_lines_take_the_first_supplier(spark, tmp_path):
    lines = "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double"
    first, rest = [(k, 1, None if k == 3 else 5, 5.0) for k in range(1, 9)], [(k, 1, 6, 6.0) for k in range(1, 2000)]
    for name, rows in (("a", first), ("b", rest)):  # the larger file is read first
        spark.createDataFrame(rows, lines).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    os.makedirs(f"{tmp_path}/lineitem.parquet")
    for name in ("a", "b"):
        next(Path(tmp_path, name).glob("part-*.parquet")).rename(f"{tmp_path}/lineitem.parquet/{name}.parquet")
    spark.createDataFrame([(5,), (6,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.claim_id: r.fact_value for r in QUERIES["finance_numeric_match"](spark, str(tmp_path)).collect()}
    assert [got[k * 8 + 1] for k in range(1, 10)] == [5.0, 5.0, None, 5.0, 5.0, 5.0, 5.0, 5.0, 6.0]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_down_and_prune(spark):
    plan = QUERIES["audit_recent"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), IsNotNull(event_type)" in plan or "EqualTo(event_type,error)" in plan
    assert "TakeOrderedAndProject" in plan and "props" not in plan.split("ReadSchema")[1].split("\n")[0]
    plan = QUERIES["review_queue_topk"](spark, SF)._jdf.queryExecution().toString()
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_library_works_without_the_training_data_part(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in (".git", "veridrift", "corpus_pipeline.py"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "veridrift").mkdir()
    for p in (ROOT / "veridrift").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "veridrift" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ece' in q and not [x for x in q if x.startswith('op')]; print(len(q))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
