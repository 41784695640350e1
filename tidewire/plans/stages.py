"""The exact scaler and the boosted trees as stages of one ML ``Pipeline``.

Both learn from the rows whose ``splitCol`` says ``train`` and change all rows. A fitted pipeline
is saved and loaded like any other; what a stage has learned is one of its params, as JSON.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.dataset import fit_scaler
from tidewire.operators.features import TARGET
from tidewire.plans.trees import BoostedTrees, TreePreset, fit_trees, with_prediction
from tidewire.schemas import TECHNICAL_FEATURES, q


class _Stage(Params, DefaultParamsReadable, DefaultParamsWritable):
    splitCol = Param(Params._dummy(), "splitCol", "column that says which rows are train rows", TypeConverters.toString)
    learned = Param(Params._dummy(), "learned", "what fitting has found, as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(splitCol="split")


class _ScalerParams(_Stage, HasInputCols):
    method = Param(Params._dummy(), "method", "robust or standard", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(method="robust")


class ExactScaler(_ScalerParams, Estimator):
    """M4 as an estimator: exact median and IQR, or mean and deviation, of the train rows."""

    @keyword_only
    def __init__(self, *, inputCols=None, method="robust", splitCol="split"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ExactScalerModel:
        train = dataset.filter(F.col(self.getOrDefault("splitCol")) == "train")
        fitted = fit_scaler(train, self.getInputCols(), self.getOrDefault("method"))
        held = {r.feature: [r.center, r.scale] for r in fitted.collect()}
        return self._copyValues(ExactScalerModel()._set(learned=json.dumps(held)))


class ExactScalerModel(_ScalerParams, Model):
    """``(x - center) / scale`` in place; a column without train values becomes NULL."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = json.loads(self.getOrDefault("learned"))

        def scaled(c: str):
            center, scale = held.get(c, (None, None))
            return F.try_divide(q(c) - F.lit(center).cast("double"), F.lit(scale).cast("double"))

        return dataset.withColumns({c: scaled(c) for c in self.getInputCols()})


class _TreeParams(_Stage, HasInputCols, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    settings = Param(Params._dummy(), "settings", "a TreePreset as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(labelCol=TARGET, predictionCol="y_hat")

    def _features(self) -> list[str] | str:
        return self.getInputCols() if self.isSet("inputCols") else self.getFeaturesCol()


class TreeRegressor(_TreeParams, Estimator):
    """M5 as an estimator over numeric ``inputCols``, or the array column ``featuresCol``."""

    @keyword_only
    def __init__(self, *, inputCols=None, featuresCol=None, labelCol=TARGET, predictionCol="y_hat", splitCol="split", settings=None):
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        if isinstance(settings, TreePreset):
            given["settings"] = json.dumps(asdict(settings))
        self._set(**given)

    def _fit(self, dataset: DataFrame) -> TreeRegressorModel:
        rows = dataset.withColumn("split", F.col(self.getOrDefault("splitCol")))
        settings = TreePreset(**json.loads(self.getOrDefault("settings")))
        model = fit_trees(rows, self._features(), settings, self.getLabelCol())
        return self._copyValues(TreeRegressorModel()._set(learned=model.to_json()))


class TreeRegressorModel(_TreeParams, Model):
    """Adds the prediction of the best round. ``trees`` is the model behind it (M7, M8)."""

    @property
    def trees(self) -> BoostedTrees:
        return BoostedTrees.from_json(self.getOrDefault("learned"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return with_prediction(self.trees, dataset, self._features(), self.getPredictionCol())


def model_pipeline(
    settings: TreePreset,
    features: Sequence[str],
    continuous: Sequence[str] = TECHNICAL_FEATURES,
    method: str = "robust",
    label: str = TARGET,
) -> Pipeline:
    """E3 from the split on: scale the continuous features by the train rows, fit the trees.

    ``features`` are all inputs of the trees, one-hot columns included; ``continuous`` those that
    are scaled. Pass rows with a ``split`` column, best a written table.
    """
    scaler = ExactScaler(inputCols=list(continuous), method=method)
    return Pipeline(stages=[scaler, TreeRegressor(inputCols=list(features), labelCol=label, settings=settings)])
