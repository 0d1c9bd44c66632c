"""Fitted stages against the functions they wrap, and extraction as table functions."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from veridrift.functions import packs, risk, table_functions
from veridrift.operators import calibration, extraction, governance, stages


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(2)
    return spark.createDataFrame([(i, p := rng.random() * 1.2 - 0.1, float(rng.random() < p), rng.choice(["verified", "not_found", "contradiction"]), rng.random(), rng.choice([None, rng.random()]), rng.choice(["warfarin", "aspirin"])) for i in range(300)], "k long, p double, y double, status string, faithfulness double, entropy double, claim_text string").cache()


def test_a_pipeline_is_fitted_saved_and_loaded(spark, scored, tmp_path):
    chosen = Pipeline(stages=[stages.stage("conformal", inputCol="p", labelCol="y", target=0.8), stages.stage("histogram", inputCol="p", labelCol="y", bins=7, least=40), stages.stage("rules")])
    chosen.write().overwrite().save(f"{tmp_path}/unfitted")
    fitted = Pipeline.load(f"{tmp_path}/unfitted").fit(scored)
    fitted.save(f"{tmp_path}/fitted")
    got = {r.k: r for r in PipelineModel.load(f"{tmp_path}/fitted").transform(scored).collect()}
    residuals = scored.select("*", F.abs(F.col("p") - F.col("y")).alias("s"))
    t = calibration.conformal_threshold(residuals, "s", 0.8).first().threshold
    bins = calibration.apply_bins(scored, calibration.fit_bins(scored, "p", "y", 7), "p", least=40, bins=7)
    want = bins.select("k", "p", "calibrated", calibration.level_set(F.col("p"), F.lit(t)).alias("levels"), risk.predicted_risk(F.col("status"), F.col("faithfulness"), F.col("entropy"), F.col("claim_text")).alias("r"))
    for r in want.collect():
        g = got[r.k]
        assert g.calibrated == pytest.approx(r.calibrated) and g.interval.levels == r.levels and g.predicted == r.r
        assert (g.interval.lower, g.interval.upper) == pytest.approx((max(0, r.p - t), min(1, r.p + t)))


def test_stages_with_nulls_and_names(spark, scored):
    model = stages.stage("histogram", inputCol="p", labelCol="y").fit(scored)
    assert [r.calibrated for r in model.transform(spark.createDataFrame([(None,)], "p double")).collect()] == [None]
    with pytest.raises(ValueError, match="conformal, histogram, rules"):
        stages.stage("neural")
    with pytest.raises(ValueError, match="no scores"):
        stages.stage("conformal", inputCol="p", labelCol="y").fit(scored.where("false"))


def test_table_functions_equal_the_operators(spark):
    session = spark.newSession()
    table_functions.register(session)
    rows = [(1, "Title\n" + "x" * 70 + "\nNext \n" + "y" * 61 + "\n" + "z" * 65), (2, "It returned 5%. 25 bps\nand low risk"), (3, None), (4, "")]
    texts = session.createDataFrame(rows, "k long, t string")
    texts.createOrReplaceTempView("texts")
    got = session.sql("select k, c.* from texts, lateral domain_claims(t, 'finance') as c").collect()
    want = governance.domain_claims(texts, "k", "t", packs.FINANCE).drop("risk").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
    got = session.sql("select k, s.section, s.body, s.n_lines from texts, lateral text_sections(t, 60) as s").collect()
    want = extraction.sections(texts, "k", "t", F.length("line") < 60).select("k", "section", "body", "n_lines").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 2
    for call in ("domain_claims(t, 'music')", "domain_claims(t, t)", "text_sections(t, -1)"):
        with pytest.raises(AnalysisException):
            session.sql(f"select * from texts, lateral {call}").collect()
