"""Classifier and regressor wrappers over pyspark.ml estimators."""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewright.operators.stats import confusion, regression_errors

Space = Callable[[random.Random], Mapping[str, Any]]


class Learner:
    """Feature columns, an estimator and, once fitted, its model.  Null features count as 0."""

    kind: type[Model] = Model
    measure = ""

    def __init__(self, estimator: Estimator, features: Sequence[str], target: str, seed: int = 42) -> None:
        self.estimator, self.features, self.target, self.seed = estimator, list(features), target, seed
        self.best: Mapping[str, Any] | None = None
        self.best_score: float | None = None
        self.model: Model | None = None

    def _assembled(self, df: DataFrame) -> DataFrame:
        filled = df.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(0.0)) for f in self.features})
        return VectorAssembler(inputCols=self.features, outputCol="features").transform(filled)

    def _with(self, params: Mapping[str, Any]) -> Estimator:
        e = self.estimator.copy()
        e._set(featuresCol="features", labelCol=self.target, seed=self.seed, **params)
        return e

    def optimise(self, train: DataFrame, validation: DataFrame, space: Space, trials: int = 50,
                 measure: Callable[[DataFrame], float] | None = None) -> Mapping[str, Any]:
        """Random search over ``space``, a function from a seeded generator to parameters; keeps and gives the best.

        ``measure`` gives a number to maximise for the validation rows with their ``prediction``; of equal ones the
        earlier trial stays.  The default is the F1 of a classifier, the negative RMSE of a regressor.
        """
        rng, best, measure = random.Random(self.seed), None, measure or self.score
        fitted_on, checked = self._assembled(train).select("features", self.target).persist(), self._assembled(validation).persist()
        try:
            for _ in range(trials):
                params = dict(space(rng))
                score = measure(self._with(params).fit(fitted_on).transform(checked))
                if best is None or score > best[0]:
                    best = (score, params)
        finally:
            fitted_on.unpersist()
            checked.unpersist()
        if best is None:
            raise ValueError("no trials")
        self.best_score, self.best = best
        return self.best

    def fit(self, train: DataFrame, params: Mapping[str, Any] | None = None) -> Learner:
        params = params if params is not None else self.best
        if params is None:
            raise RuntimeError("give parameters or optimise first")
        self.model = self._with(params).fit(self._assembled(train))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """The table with ``prediction`` (and ``probability_1`` of a classifier)."""
        if self.model is None:
            raise RuntimeError("fit or load a model first")
        out = self.model.transform(self._assembled(df))
        more = [vector_to_array("probability")[1].alias("probability_1")] if "probability" in out.columns else []
        return out.select(*df.columns, "prediction", *more)

    def evaluate(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def score(self, predicted: DataFrame) -> float:
        raise NotImplementedError

    def importances(self) -> list[tuple[str, float]]:
        """Features by importance, or by the size of their coefficients, largest first."""
        m = self.model
        values = getattr(m, "featureImportances", None) if m is not None else None
        if values is None:
            values = getattr(m, "coefficients", None)
        if values is None:
            raise AttributeError("the model has neither importances nor coefficients")
        return sorted(zip(self.features, map(abs, values.toArray().tolist())), key=lambda x: (-x[1], x[0]))

    def save(self, path: str) -> None:
        """Write the model to ``path`` and the best parameters, if any were searched, beside it as JSON."""
        if self.model is None:
            raise RuntimeError("nothing to save before fit")
        self.model.write().overwrite().save(path)
        known = SparkSession.active().createDataFrame([(json.dumps(dict(self.best)) if self.best is not None else None,)], "value string")
        known.coalesce(1).write.mode("overwrite").json(path.rstrip("/") + ".parameters")

    def load(self, path: str) -> Learner:
        """Read the model and the best parameters; a model of another kind raises TypeError."""
        try:
            self.model = self.kind.load(path)
        except Exception as e:
            raise TypeError(f"{path} holds no {self.kind.__name__}") from e
        found = SparkSession.active().read.schema("value string").json(path.rstrip("/") + ".parameters").first()
        self.best = json.loads(found.value) if found is not None and found.value is not None else None
        return self


class Classifier(Learner):
    kind = GBTClassificationModel

    def __init__(self, features: Sequence[str], target: str, estimator: Estimator | None = None, seed: int = 42) -> None:
        super().__init__(estimator or GBTClassifier(), features, target, seed)

    def evaluate(self, df: DataFrame) -> DataFrame:
        return confusion(self.predict(df), self.target, "prediction")

    def score(self, predicted: DataFrame) -> float:
        return confusion(predicted, self.target, "prediction").first()["f1"]


class Regressor(Learner):
    kind = GBTRegressionModel

    def __init__(self, features: Sequence[str], target: str, estimator: Estimator | None = None, seed: int = 42) -> None:
        super().__init__(estimator or GBTRegressor(), features, target, seed)

    def evaluate(self, df: DataFrame) -> DataFrame:
        return regression_errors(self.predict(df), self.target, "prediction")

    def score(self, predicted: DataFrame) -> float:
        return -regression_errors(predicted, self.target, "prediction").first()["rmse"]
