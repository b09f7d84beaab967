"""Classifiers, tuning and cross-validation on MLlib pipelines.

* Every estimator is wrapped in a ``Pipeline`` (scaler -> assembler ->
  classifier) so scaling is fitted on training rows only (T11).
* Labels are indexed once with a ``StringIndexerModel`` kept beside the
  pipeline; predictions are decoded with ``IndexToString``.
* Gaussian naive Bayes is implemented with two grouped aggregates and a
  log-likelihood expression (exact ``var_smoothing``), not MLlib.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .forest import BinnedForest
from .kernel import LandmarkKernel
from .mlp import AdamPerceptron
from .scale import fit_scaler


# ------------------------------------------------------------------ scaler stage
class _ScalerParams(HasInputCols):
    method = Param(Params._dummy(), "method", "scaling method", typeConverter=TypeConverters.toString)
    centers = Param(Params._dummy(), "centers", "fitted centers", typeConverter=TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "fitted scales", typeConverter=TypeConverters.toListFloat)


class FeatureScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage around ``scale.fit_scaler``: population-std standard,
    minmax, robust (exact quantiles), maxabs or per-row unit_vector."""

    @keyword_only
    def __init__(self, inputCols: Sequence[str] | None = None, method: str = "standard"):
        super().__init__()
        self._setDefault(method="standard")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "FeatureScalerModel":
        cols = self.getInputCols()
        state = fit_scaler(dataset, self.getOrDefault("method"), cols)
        return FeatureScalerModel(inputCols=cols, method=state.method,
                                  centers=[float(state.center.get(c) or 0.0) for c in cols],
                                  scales=[float(state.scale.get(c) or 1.0) for c in cols])


class FeatureScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, method="standard", centers=None, scales=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        if self.getOrDefault("method") == "unit_vector":
            norm = F.sqrt(sum((F.col(c).cast("double") ** 2 for c in cols), F.lit(0.0)))
            div = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
            return dataset.withColumns({c: F.col(c).cast("double") / div for c in cols})
        cs, ss = self.getOrDefault("centers"), self.getOrDefault("scales")
        return dataset.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                                    for c, m, s in zip(cols, cs, ss)})


# ------------------------------------------------------------------ registry
@dataclass
class ModelSpec:
    """``build(n_train, **params)`` makes the classifier; ``grid`` lists the
    parameters that tuning tries. A ``kernel`` of ``rbf`` (default of a spec
    with ``rbf``) puts the landmark features in front."""

    name: str
    build: Callable[..., object]
    grid: list[dict] = field(default_factory=list)
    probabilistic: bool = True
    rbf: bool = False


def _lr(n: int, C: float = 1.0):  # noqa: N803 - the parameter's public name
    # scikit-learn minimises C * sum(loss) + 0.5 ||w||^2; MLlib minimises
    # mean(loss) + 0.5 * regParam ||w||^2  ->  regParam = 1 / (C n), with the
    # rows of the very fit.
    # tol 1e-4: MLlib's measure of progress is its own, so stopping points differ from scikit-learn's
    return LogisticRegression(family="multinomial", maxIter=1000, regParam=1.0 / (C * max(n, 1)),
                              elasticNetParam=0.0, standardization=False, tol=1e-4)


# the original sets no iteration limit; the tolerance ends a fit long before this
SVM_MAX_ITER = 10_000


#: beyond it the classes of a margin machine are fitted one after the other, as each fit holds all rows in memory
ROWS_SIDE_BY_SIDE = 1_000_000


def _svm(n: int, C: float = 1.0, kernel: str = "rbf"):  # noqa: N803
    return OneVsRest(classifier=LinearSVC(regParam=1.0 / (C * max(n, 1)), maxIter=SVM_MAX_ITER, tol=1e-3, standardization=False),
                     parallelism=4 if n <= ROWS_SIDE_BY_SIDE else 1)


def _mlp(n: int, hidden: Sequence[int] = (128, 64)):
    # the layer sizes are completed in build_pipeline, which knows inputs and classes
    return AdamPerceptron(layers=[1, *hidden, 1])


# fixed values: the model names and tuning grids of the original. Unlimited
# depth is 30, MLlib's largest; minimal split sizes 2, 5, 10 are leaf sizes 1, 2, 5.
DEFAULT_MODELS: dict[str, ModelSpec] = {
    "LogisticRegression": ModelSpec("LogisticRegression", _lr, [{"C": c} for c in (0.01, 0.1, 1, 10, 100)]),
    "DecisionTree": ModelSpec(
        "DecisionTree",
        lambda n, maxDepth=30, minInstancesPerNode=1: BinnedForest(
            numTrees=1, bootstrap=False, maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode),
        [{"maxDepth": d, "minInstancesPerNode": m} for d in (5, 10, 20, 30) for m in (1, 2, 5)]),
    "RandomForest": ModelSpec(
        "RandomForest",
        lambda n, numTrees=200, maxDepth=30: BinnedForest(numTrees=numTrees, maxDepth=maxDepth, seed=42),
        [{"numTrees": t, "maxDepth": d} for t in (100, 200, 300) for d in (10, 20, 30)]),
    "KNN": ModelSpec("KNN", lambda n: None, [{"k": k} for k in (3, 5, 7, 11)], probabilistic=False),
    "SVM": ModelSpec("SVM", _svm, [{"C": c, "kernel": k} for c in (0.1, 1, 10) for k in ("rbf", "linear")], rbf=True),
    "GaussianNB": ModelSpec("GaussianNB", lambda n: None, [{"var_smoothing": v} for v in (1e-9, 1e-8, 1e-7)]),
    "MLP": ModelSpec("MLP", _mlp, [{"hidden": h} for h in ((64,), (128, 64), (256, 128, 64))]),
}


class MarginCalibration(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Platt scaling of a one-vs-rest margin classifier: margins of rows that
    the classifier wasn't fitted on (``FOLDS`` hash folds) are mapped to class
    probabilities by a logistic regression. The prediction stays the margin
    classifier's, fitted on all rows."""

    FOLDS = 3

    def __init__(self, classifier=None):
        super().__init__()
        self.classifier = classifier

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        from functools import reduce

        # read by every fold and class: made once, and on disk, as each fit keeps its own blocks in memory
        kept = dataset.select("features", "label_idx").persist(StorageLevel.DISK_ONLY)
        try:
            folded = kept.withColumn("__cal", F.pmod(F.xxhash64(vector_to_array("features")), F.lit(self.FOLDS)))
            raw = []
            for f in range(self.FOLDS):
                fitted = self._fitted(folded.where(F.col("__cal") != f))
                raw.append(fitted.transform(folded.where(F.col("__cal") == f)).select("label_idx", "rawPrediction"))
            margins = reduce(DataFrame.unionByName, raw)
            platt = LogisticRegression(featuresCol="rawPrediction", labelCol="label_idx", predictionCol="__platt",
                                       rawPredictionCol="__platt_raw", family="multinomial", maxIter=200).fit(margins)
            return PipelineModel([self._fitted(kept), platt])
        finally:
            kept.unpersist()

    def _fitted(self, rows: DataFrame) -> Model:
        """The classifier on ``rows``, which are on disk while it is fitted: else
        one-vs-rest would keep a second copy of them in memory."""
        part = rows.persist(StorageLevel.DISK_ONLY)
        try:
            return self.classifier.fit(part)
        finally:
            if "__cal" in rows.columns:
                part.unpersist()


# ------------------------------------------------------------------ Gaussian NB
def fit_gaussian_nb(df: DataFrame, features: Sequence[str], label: str, var_smoothing: float = 1e-9) -> DataFrame:
    """T6 state: one row per class with prior, means and smoothed variances
    (population variance + var_smoothing x the largest feature variance)."""
    feats = list(features)
    eps = df.agg(F.array_max(F.array(*[F.var_pop(F.col(c).cast("double")) for c in feats])).alias("m")) \
        .select((F.col("m") * var_smoothing).alias("eps"), F.lit(1).alias("__k"))
    per = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col(c).cast("double")).alias(f"mu_{c}") for c in feats],
        *[F.var_pop(F.col(c).cast("double")).alias(f"var_{c}") for c in feats]).withColumn("__k", F.lit(1))
    tot = F.sum("n").over(Window.partitionBy())  # over the per-class rows only
    st = per.join(eps, "__k").withColumn("prior", F.col("n") / tot)
    return st.select(F.col(label).alias("class"), "prior",
                     *[F.col(f"mu_{c}") for c in feats],
                     *[(F.col(f"var_{c}") + F.col("eps")).alias(f"var_{c}") for c in feats])


def predict_gaussian_nb(df: DataFrame, state: DataFrame, features: Sequence[str],
                        out: str = "prediction") -> DataFrame:
    """T6 scoring: joint log-likelihood per class as literal expressions (the
    state has one row per class), argmax with ties to the first class in
    sorted order, and normalised class probabilities."""
    rows = sorted(state.collect(), key=lambda r: r["class"])  # k rows
    jll = []
    for r in rows:
        e = F.lit(math.log(r["prior"]))
        for c in features:
            v, mu = r[f"var_{c}"], r[f"mu_{c}"]
            e = e - 0.5 * math.log(2 * math.pi * v) - (F.col(c).cast("double") - F.lit(mu)) ** 2 / F.lit(2 * v)
        jll.append(F.struct(e.alias("ll"), F.lit(r["class"]).alias("cls")))
    arr = F.array(*jll)
    best = F.aggregate(arr, arr[0], lambda acc, x: F.when(x["ll"] > acc["ll"], x).otherwise(acc))
    mx = F.array_max(F.transform(arr, lambda x: x["ll"]))
    denom = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.exp(x["ll"] - mx))
    probs = F.transform(arr, lambda x: F.exp(x["ll"] - mx) / denom)
    return df.withColumn(out, best["cls"]).withColumn("probability", probs)


# ------------------------------------------------------------------ pipelines
def index_labels(df: DataFrame, label: str, out: str = "label_idx"):
    """Alphabetical label codes (scikit-learn LabelEncoder order)."""
    return StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="error").fit(df)


def build_pipeline(spec: ModelSpec, features: Sequence[str], n_train: int, n_classes: int,
                   scaler: str = "standard", label_col: str = "label_idx", params: dict | None = None) -> Pipeline:
    """Scaler (fitted inside each fit) -> assembler or landmark kernel -> classifier."""
    feats, params = list(features), dict(params or {})
    stages = [FeatureScaler(inputCols=feats, method=scaler)] if scaler else []
    if params.get("kernel", "rbf" if spec.rbf else "linear") == "rbf":
        stages.append(LandmarkKernel(inputCols=feats, outputCol="features", gamma=1.0 / len(feats)))
    else:
        stages.append(VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep"))
    est = spec.build(n_train, **params)
    if isinstance(est, AdamPerceptron):
        est = est.setLayers([len(feats), *est.getLayers()[1:-1], n_classes])
    est = est.setFeaturesCol("features").setLabelCol(label_col)
    if isinstance(est, OneVsRest) and spec.probabilistic:
        est = MarginCalibration(est.setRawPredictionCol("rawPrediction"))
    stages.append(est)
    return Pipeline(stages=stages)


def decode_predictions(pred: DataFrame, indexer, label_out: str = "predicted_label") -> DataFrame:
    return IndexToString(inputCol="prediction", outputCol=label_out, labels=indexer.labels).transform(pred)


def probability_columns(pred: DataFrame, class_names: Sequence[str], digits: int = 1) -> DataFrame:
    """confidence = max probability x 100 (half-even rounding) and a
    class -> percent map."""
    plain = pred.schema["probability"].dataType.typeName() == "array"  # naive Bayes gives an array
    arr = F.col("probability") if plain else vector_to_array("probability")
    pct = F.transform(arr, lambda p: F.bround(p * 100.0, digits))
    return pred.withColumn("confidence", F.bround(F.array_max(arr) * 100.0, digits)) \
        .withColumn("probabilities", F.map_from_arrays(F.array(*[F.lit(c) for c in class_names]), pct))
