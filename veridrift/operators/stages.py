"""Calibrators and predictors as stages of a machine-learning pipeline: fitted, saved, loaded and chosen by name."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.base import Params
from pyspark.ml.param import Param, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import risk
from . import calibration


class _Persisted(DefaultParamsReadable, DefaultParamsWritable):
    """What a fitted stage knows is among its params, so that Spark's own format saves all of it."""


class _Columns(HasInputCol, HasLabelCol, HasOutputCol):
    @keyword_only
    def __init__(self, **kwargs: object) -> None:
        super().__init__()
        self._defaults()
        self._set(**kwargs)

    def _defaults(self) -> None:
        pass


class _HasTarget(Params):
    target = Param(Params._dummy(), "target", "share of intervals that must cover", TypeConverters.toFloat)


class _HasBins(Params):
    bins = Param(Params._dummy(), "bins", "equal-width bins", TypeConverters.toInt)
    least = Param(Params._dummy(), "least", "rows from which a bin's value counts", TypeConverters.toInt)


class ConformalModel(_Columns, _HasTarget, Model, _Persisted):
    """Adds ``outputCol``: ``struct(lower, upper, levels)``, the prediction widened by the threshold within 0 and 1 and the review levels that it meets."""

    threshold = Param(Params._dummy(), "threshold", "conformal quantile of the residuals", TypeConverters.toFloat)
    n = Param(Params._dummy(), "n", "rows calibrated on", TypeConverters.toInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        p, t = F.col(self.getInputCol()).cast("double"), F.lit(self.getOrDefault(self.threshold))
        interval = F.struct(F.greatest(F.lit(0.0), p - t).alias("lower"), F.least(F.lit(1.0), p + t).alias("upper"), calibration.level_set(p, t).alias("levels"))
        return df.withColumn(self.getOutputCol(), interval)


class ConformalRegressor(_Columns, _HasTarget, Estimator, _Persisted):
    """Fits the conformal quantile of ``abs(inputCol - labelCol)``; null predictions or labels are not calibrated on, no rows are an error."""

    def _defaults(self) -> None:
        self._setDefault(target=0.9, outputCol="interval")

    def _fit(self, df: DataFrame) -> ConformalModel:
        scores = df.select(F.abs(F.col(self.getInputCol()).cast("double") - F.col(self.getLabelCol()).cast("double")).alias("s")).where("s is not null")
        found = calibration.conformal_threshold(scores, "s", self.getOrDefault(self.target)).first()
        return self._copyValues(ConformalModel())._set(threshold=found.threshold, n=found.n)


class HistogramModel(_Columns, _HasBins, Model, _Persisted):
    """Adds ``outputCol``: the value of the score's bin, or the score itself where the bin had too few rows."""

    values = Param(Params._dummy(), "values", "value of each bin", TypeConverters.toListFloat)
    counts = Param(Params._dummy(), "counts", "rows of each bin", TypeConverters.toListInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        n, score = self.getOrDefault(self.bins), calibration.clamped(F.col(self.getInputCol()).cast("double"))
        at = F.least((score * n).cast("int"), F.lit(n - 1))
        value = F.get(F.lit(self.getOrDefault(self.values)), at)
        enough = F.get(F.lit(self.getOrDefault(self.counts)), at) >= self.getOrDefault(self.least)
        return df.withColumn(self.getOutputCol(), F.when(F.col(self.getInputCol()).isNull(), None).when(enough, value).otherwise(score))


class HistogramCalibrator(_Columns, _HasBins, Estimator, _Persisted):
    """Fits the mean label of each bin of the score."""

    def _defaults(self) -> None:
        self._setDefault(bins=10, least=1, outputCol="calibrated")

    def _fit(self, df: DataFrame) -> HistogramModel:
        rows = calibration.fit_bins(df, self.getInputCol(), self.getLabelCol(), self.getOrDefault(self.bins)).orderBy("bin").collect()  # a row a bin
        return self._copyValues(HistogramModel())._set(values=[r.value for r in rows], counts=[r.n for r in rows])


class RulePredictor(_Columns, Transformer, _Persisted):
    """Adds ``outputCol``: risk score, review level and confidence of the rules, from ``status, faithfulness, entropy`` and the claim in ``inputCol``."""

    def _defaults(self) -> None:
        self._setDefault(outputCol="predicted", inputCol="claim_text")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), risk.predicted_risk(F.col("status"), F.col("faithfulness"), F.col("entropy"), F.col(self.getInputCol())))


#: Stages by the name under which a run's settings choose them.
REGISTRY = {"conformal": ConformalRegressor, "histogram": HistogramCalibrator, "rules": RulePredictor}


def stage(name: str, **params: object) -> Estimator | Transformer:
    """A registered stage; an unknown name is an error that says which there are."""
    if name not in REGISTRY:
        raise ValueError(f"no stage {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**params)
