"""Classification of objects by their property vectors: a kernel machine, or Spark ML's own models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.feature import MaxAbsScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelry.functions.graph import discard, written

from .labels import AXES

#: Objects that a kernel machine is expressed in; the most that training draws.
LANDMARKS = 256


def training_labels(planes: DataFrame, truth: DataFrame) -> DataFrame:
    """(label, truth): 1 if all voxels of a 2D label lie in the (dilated) truth mask, else 0; mixed labels are 0."""
    v = planes.where("label <> 0").join(truth.select(*AXES, F.lit(1).alias("_t")), AXES, "left")
    return v.groupBy("label").agg(F.min(F.coalesce("_t", F.lit(0))).alias("truth"))


def _kernel(x: np.ndarray, landmarks: np.ndarray, gamma: float) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (landmarks * landmarks).sum(axis=1) - 2 * x @ landmarks.T
    return np.exp(-gamma * np.maximum(square, 0))


@dataclass
class KernelModel:
    """sign(sum_j weights[j] exp(-gamma |x / scale - landmarks[j]|^2) + intercept): small whatever it was trained on."""

    features: list[str]
    scale: list[float]
    gamma: float
    landmarks: np.ndarray
    weights: np.ndarray
    intercept: float

    def _scaled(self) -> Column:
        return F.array(*[F.col(f"`{c}`").cast("double") / s for c, s in zip(self.features, self.scale)])

    def transform(self, props: DataFrame) -> DataFrame:
        """``props`` with decision and prediction (1.0 if the decision is above 0); rows with a missing property go."""
        landmarks, weights, gamma, intercept = self.landmarks, self.weights, self.gamma, self.intercept

        @F.pandas_udf("double")
        def decide(x: pd.Series) -> pd.Series:
            return pd.Series(_kernel(np.stack(x.to_list()), landmarks, gamma) @ weights + intercept) if len(x) else pd.Series([], dtype=float)

        whole = props.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in self.features))
        return whole.withColumn("decision", decide(self._scaled())).withColumn("prediction", (F.col("decision") > 0).cast("double"))

    def save(self, spark: SparkSession, path: str) -> None:
        """A Parquet file: a row a landmark, the settings on each."""
        rows = [(i, x.tolist(), float(w), self.features, list(map(float, self.scale)), float(self.gamma), float(self.intercept)) for i, (x, w) in enumerate(zip(self.landmarks, self.weights))]
        spark.createDataFrame(rows, "i int, landmark array<double>, weight double, features array<string>, scale array<double>, gamma double, intercept double").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> KernelModel:
        rows = spark.read.parquet(path).orderBy("i").collect()  # LANDMARKS rows at most
        return KernelModel(list(rows[0].features), list(rows[0].scale), rows[0].gamma, np.array([r.landmark for r in rows]), np.array([r.weight for r in rows]), rows[0].intercept)


def train_kernel_classifier(props: DataFrame, features: list[str], truth: str = "truth", gamma: float | None = None, cost: float = 1.0, landmarks: int = LANDMARKS, seed: int = 0) -> KernelModel:
    """A support vector machine with a Gaussian kernel, by Nystroem's method: properties are divided by their largest
    absolute values; objects in feature space are projected on the span of at most ``landmarks`` objects, drawn by hash,
    and a linear machine is fitted there on all objects. ``gamma`` is 1 / (number of properties * their variance) unless
    given. Rows with a missing property are left out."""
    spark = props.sparkSession
    number = [F.col(f"`{c}`").cast("double") for c in features]
    rows = props.select(F.col(truth).cast("double").alias("truth"), F.array(*number).alias("x")).where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)) & F.col("truth").isNotNull())
    rows = written(rows, "training")
    at = [F.col("x")[i] for i in range(len(features))]
    sums = rows.agg(F.count("*").alias("n"), *[f(a).alias(f"{k}{i}") for i, a in enumerate(at) for k, f in (("m", lambda v: F.max(F.abs(v))), ("s", F.sum), ("q", lambda v: F.sum(v * v)))]).first()
    if not sums.n:
        raise ValueError("no object has all properties")
    scale = [sums[f"m{i}"] or 1.0 for i in range(len(features))]
    if gamma is None:
        mean = sum(sums[f"s{i}"] / scale[i] for i in range(len(features))) / (sums.n * len(features))
        spread = sum(sums[f"q{i}"] / scale[i] ** 2 for i in range(len(features))) / (sums.n * len(features)) - mean**2
        gamma = 1 / (len(features) * spread) if spread > 1e-12 else 1.0
    drawn = rows.select("x").distinct().orderBy(F.xxhash64(F.lit(seed), "x"), "x").limit(landmarks).collect()
    marks = np.array([r.x for r in drawn]) / scale
    value, vector = np.linalg.eigh(_kernel(marks, marks, gamma))
    good = value > 1e-10 * value.max()
    project = vector[:, good] / np.sqrt(value[good])

    @F.pandas_udf("array<double>")
    def mapped(x: pd.Series) -> pd.Series:
        return pd.Series(list(_kernel(np.stack(x.to_list()) / scale, marks, gamma) @ project)) if len(x) else pd.Series([], dtype=object)

    inside = written(rows.select("truth", mapped("x").alias("z")), "training-mapped")  # read by every step of the fit
    svc = LinearSVC(featuresCol="vector", labelCol="truth", maxIter=100, regParam=1 / (cost * sums.n), standardization=False)
    fit = svc.fit(inside.select("truth", array_to_vector("z").alias("vector")))
    discard(rows, inside)
    return KernelModel(features, scale, gamma, marks, project @ fit.coefficients.toArray(), fit.intercept)


def train_object_classifier(props: DataFrame, features: list[str], kind: str = "kernel", seed: int = 0) -> KernelModel | PipelineModel:
    """A kernel machine, or behind max-abs scaling a linear one (``svc``) or a ``forest``. Rows with a missing property are
    left out."""
    if kind == "kernel":
        return train_kernel_classifier(props, features, seed=seed)
    last = LinearSVC(featuresCol="scaled", labelCol="truth", maxIter=20, regParam=0.01) if kind == "svc" else RandomForestClassifier(featuresCol="scaled", labelCol="truth", numTrees=30, seed=seed)
    steps = [VectorAssembler(inputCols=features, outputCol="vector", handleInvalid="skip"), MaxAbsScaler(inputCol="vector", outputCol="scaled"), last]
    return Pipeline(stages=steps).fit(props)


def apply_object_rules(predicted: DataFrame, bright: float | None = None, large: float | None = None) -> DataFrame:
    """(label, inside): intensity above ``bright`` always in, area above ``large`` always out (and last)."""
    inside = F.col("prediction") > 0.5
    if bright is not None:
        inside = F.when(F.col("mean") > bright, True).otherwise(inside)
    if large is not None:
        inside = F.when(F.col("area") > large, False).otherwise(inside)
    return predicted.select("label", inside.alias("inside"))


def predict_objects(model: KernelModel | PipelineModel, props: DataFrame, bright: float | None = None, large: float | None = None) -> DataFrame:
    return apply_object_rules(model.transform(props), bright, large)


def paint_prediction(vol: DataFrame, inside: DataFrame) -> DataFrame:
    """Voxels of the labels that are in."""
    return vol.where("label <> 0").join(inside.where("inside").select("label"), "label", "left_semi").select(*AXES, "label")
