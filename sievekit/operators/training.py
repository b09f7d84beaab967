"""Training, tuning, cross-validation and scoring on any table.

Everything takes DataFrames: a feature table with a label column, and models
by name or the caller's own ``ModelSpec``. What a fit needs to know about its
training rows (their number, scaling, label codes) is derived in that fit. A
``Fitted`` model carries its label list, can be saved as one artifact folder
and scores without any training data.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import FEATURE_COLUMNS
from ..functions.text import preview
from ..session import reliable_checkpoint
from .enrich import enrich_severity
from .evaluate import evaluate
from .features import add_payload_features
from .forest import BinnedForest, grown_together
from .knn import knn_classify
from .models import (
    DEFAULT_MODELS, FeatureScalerModel, FeatureScaler, ModelSpec, build_pipeline, fit_gaussian_nb, index_labels,
    predict_gaussian_nb, probability_columns,
)
from .splits import assign_folds

#: rows of the narrow feature table per partition of an iterative fit; beyond
#: ``FIT_PARTITIONS`` of them up to ``MOST_ROWS_PER_FIT_PARTITION``, as every step costs a task per partition
ROWS_PER_FIT_PARTITION = 25_000
FIT_PARTITIONS = 32
MOST_ROWS_PER_FIT_PARTITION = 100_000
#: folds and configurations that are fitted at the same time
PARALLEL_FITS = 4


def for_fitting(df: DataFrame) -> DataFrame:
    """Materialise a feature table once at full parallelism, then merge its
    partitions to ``ROWS_PER_FIT_PARTITION`` rows or more: iterative fits run a
    job per step, in which tiny partitions cost more than they compute. The
    number of partitions follows the rows, whatever the cluster's size."""
    data = reliable_checkpoint(df)
    return data.coalesce(fit_partitions(data.count()))


def fit_partitions(rows: int) -> int:
    small = min(FIT_PARTITIONS, math.ceil(rows / ROWS_PER_FIT_PARTITION))
    return max(1, small, math.ceil(rows / MOST_ROWS_PER_FIT_PARTITION))


@dataclass
class Fitted:
    """A fitted model with everything that scoring needs. ``kind`` is
    ``pipeline``, ``gaussian_nb`` or ``knn``."""

    name: str
    kind: str
    features: list[str]
    labels: list[str]
    model: PipelineModel | None = None
    table: DataFrame | None = None  # naive Bayes: a row per class; kNN: training vectors
    scaler: FeatureScalerModel | None = None
    k: int = 5

    def transform(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """Adds ``prediction`` (a label code), and ``probability`` if the
        model gives any. kNN needs ``key``, a column that names the rows."""
        if self.kind == "pipeline":
            return self.model.transform(df)
        if self.kind == "gaussian_nb":
            return predict_gaussian_nb(df, self.table, self.features).withColumn("prediction", F.col("prediction").cast("double"))
        if key is None:
            raise ValueError("kNN scoring needs a key column")
        votes = knn_classify(self.scaler.transform(self.table), self.scaler.transform(df), self.features, "label_idx", key, k=self.k)
        return df.join(votes.select(key, F.col("prediction").cast("double").alias("prediction")), key, "left")

    def save(self, path: str) -> None:
        """A new version in a folder of its own, with model files and metadata;
        only when all of it is written, a pointer file makes it the current
        one. So a broken save leaves the former version as it was."""
        spark = SparkSession.active()
        path = path.rstrip("/")
        version = f"version-{uuid.uuid4().hex}"
        at = f"{path}/{version}"
        if self.model is not None:
            self.model.write().save(f"{at}/model")
        if self.scaler is not None:
            self.scaler.write().save(f"{at}/scaler")
        if self.table is not None:
            self.table.write.parquet(f"{at}/table")
        about = {"name": self.name, "kind": self.kind, "features": self.features, "labels": self.labels, "k": self.k}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{at}/metadata")
        _point_to(spark, path, version)


#: versions that stay when a new one becomes current
KEPT_VERSIONS = 3


def _fs(spark: SparkSession, path: str):
    """(file system, path class) of a Hadoop path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p(path))


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of the pointer files, oldest first. All of a pointer
    is in its name, so it is there whole or not at all."""
    fs, p = _fs(spark, path)
    if not fs.exists(p(path)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p(path))]
    return sorted((int(n[8:20]), n[21:]) for n in names if re.fullmatch(r"current-\d{12}-version-[0-9a-f]{32}", n))


def _point_to(spark: SparkSession, path: str, version: str) -> None:
    """Make a version current by creating an empty file, and drop versions
    that are older than the last ``KEPT_VERSIONS``. Of two saves at the same
    time the one of the greater name wins; both are whole."""
    fs, p = _fs(spark, path)
    before = _pointers(spark, path)
    number = before[-1][0] + 1 if before else 1
    fs.create(p(f"{path}/current-{number:012d}-{version}"), False).close()
    for n, old in before[: max(0, len(before) + 1 - KEPT_VERSIONS)]:
        fs.delete(p(f"{path}/current-{n:012d}-{old}"), False)
        fs.delete(p(f"{path}/{old}"), True)


def load_artifact(spark: SparkSession, path: str) -> Fitted | None:
    """The current version of a saved model, or None if there is none."""
    path = path.rstrip("/")
    versions = _pointers(spark, path)
    path = f"{path}/{versions[-1][1]}" if versions else path  # else a folder of one unversioned model
    if not _exists(spark, f"{path}/metadata/_SUCCESS"):
        return None
    about = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    parts = {"pipeline": ["model"], "gaussian_nb": ["table"], "knn": ["table", "scaler"]}[about["kind"]]
    if not all(_exists(spark, f"{path}/{p}") for p in parts):
        return None
    return Fitted(
        **about,
        model=PipelineModel.load(f"{path}/model") if "model" in parts else None,
        scaler=FeatureScalerModel.load(f"{path}/scaler") if "scaler" in parts else None,
        table=spark.read.parquet(f"{path}/table") if "table" in parts else None,
    )


def _spec(model: str | ModelSpec) -> ModelSpec:
    return DEFAULT_MODELS[model] if isinstance(model, str) else model


def fit(train: DataFrame, features: Sequence[str], label: str, model: str | ModelSpec, scaler: str = "standard",
        **params) -> Fitted:
    """Fit one model on a table; ``params`` override the model's defaults
    (those of its grid, e.g. ``C`` or ``maxDepth``)."""
    spec, feats = _spec(model), list(features)
    indexer = index_labels(train, label)
    rows = indexer.transform(train)
    common = {"name": spec.name, "features": feats, "labels": list(indexer.labels)}
    if spec.name == "GaussianNB":
        state = fit_gaussian_nb(rows, feats, "label_idx", params.get("var_smoothing", 1e-9))
        state = train.sparkSession.createDataFrame(state.collect(), state.schema)  # a row per class
        return Fitted(kind="gaussian_nb", table=state, **common)
    if spec.name == "KNN":
        fitted = FeatureScaler(inputCols=feats, method=scaler).fit(rows)
        return Fitted(kind="knn", table=rows.select("label_idx", *feats), scaler=fitted, k=params.get("k", 5), **common)
    pipe = build_pipeline(spec, feats, rows.count(), len(indexer.labels), scaler, params=params)
    return Fitted(kind="pipeline", model=pipe.fit(rows), **common)


def fit_trees(train: DataFrame, features: Sequence[str], label: str, model: str | ModelSpec, configurations: Sequence[dict],
              scaler: str = "standard") -> list[Fitted]:
    """``fit`` for every configuration of a tree or forest; what doesn't depend on
    it (label codes, scaling, borders and cells) is made once, and the trees of
    several configurations are grown in the same jobs."""
    spec, feats = _spec(model), list(features)
    indexer = index_labels(train, label)
    rows = indexer.transform(train)
    n, classes = rows.count(), len(indexer.labels)
    stages = [build_pipeline(spec, feats, n, classes, scaler, params=params).getStages() for params in configurations]
    front = Pipeline(stages=stages[0][:-1]).fit(rows)
    prepared = stages[0][-1].prepare(front.transform(rows))
    return [Fitted(name=spec.name, kind="pipeline", features=feats, labels=list(indexer.labels), model=PipelineModel([*front.stages, m]))
            for m in grown_together([s[-1] for s in stages], prepared)]


class _Shared:
    """``fit`` for ``uses`` configurations of a model on one table: label codes,
    their number, scaling and the feature vectors, the same for all of them, are
    made once and kept until the last one is fitted."""

    def __init__(self, train: DataFrame, features: Sequence[str], label: str, model: str | ModelSpec, uses: int, scaler: str = "standard"):
        self.train, self.features, self.label, self.spec, self.scaler = train, list(features), label, _spec(model), scaler
        self.left, self.lock, self.rows = uses, Lock(), None

    def _prepare(self, params: dict) -> None:
        indexer = index_labels(self.train, self.label)
        rows = indexer.transform(self.train)
        self.labels, self.n = list(indexer.labels), rows.count()
        self.front = Pipeline(stages=self._stages(params)[:-1]).fit(rows)
        self.rows = self.front.transform(rows).select("features", "label_idx").persist(StorageLevel.MEMORY_AND_DISK)

    def _stages(self, params: dict) -> list:
        return build_pipeline(self.spec, self.features, self.n, len(self.labels), self.scaler, params=params).getStages()

    def fit(self, params: dict) -> Fitted:
        with self.lock:
            if self.rows is None:
                self._prepare(params)
        try:
            last = self._stages(params)[-1].fit(self.rows)
        finally:
            with self.lock:
                self.left -= 1
                if not self.left:
                    self.rows.unpersist()
        return Fitted(name=self.spec.name, kind="pipeline", features=self.features, labels=self.labels, model=PipelineModel([*self.front.stages, last]))


def metrics(fitted: Fitted, test: DataFrame, label: str, key: str | None = None) -> dict[str, float]:
    """M4 on a held-out table: accuracy, precision, recall, F1. Labels that
    the model never saw count as wrong."""
    code = F.array_position(F.array(*[F.lit(x) for x in fitted.labels]), F.col(label).cast("string")) - 1
    pred = fitted.transform(test.withColumn("__truth", F.when(code >= 0, code).cast("double")), key)
    row = evaluate(pred, "__truth", "prediction", [float(i) for i in range(len(fitted.labels))]).collect()[0]
    return {c: float(row[c]) for c in ("accuracy", "precision", "recall", "f1")}


def train_and_evaluate(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                       models: Mapping[str, ModelSpec] | Sequence[str] | None = None,
                       key: str | None = None) -> tuple[dict[str, dict[str, float]], dict[str, Fitted]]:
    """Fit every model and score it on ``test``; results and the fitted
    models, both by name."""
    if models is None:
        models = DEFAULT_MODELS
    specs = dict(models) if isinstance(models, Mapping) else {m: DEFAULT_MODELS[m] for m in models}
    fitted = {name: fit(train, features, label, spec) for name, spec in specs.items()}
    return {name: metrics(f, test, label, key) for name, f in fitted.items()}, fitted


def best_model(results: Mapping[str, Mapping[str, float]]) -> str:
    """The highest F1, then the first name."""
    return min(results, key=lambda n: (-results[n]["f1"], n))


def _fold_scores(folded: DataFrame, folds: int, features: Sequence[str], label: str, key: str, model: str | ModelSpec,
                 configurations: Sequence[dict]) -> list[list[float]]:
    """F1 of every configuration on every fold; up to ``PARALLEL_FITS`` fits
    are submitted at a time, each a distributed job of its own."""
    def one(job: tuple[dict, int]) -> float:
        params, f = job
        fitted = fit(folded.where(F.col("fold") != f), features, label, model, **params)
        return metrics(fitted, folded.where(F.col("fold") == f), label, key)["f1"]

    def trees(f: int) -> list[float]:
        test = folded.where(F.col("fold") == f)
        return [metrics(m, test, label, key)["f1"] for m in fit_trees(folded.where(F.col("fold") != f), features, label, model, configurations)]

    if isinstance(_spec(model).build(1), BinnedForest):
        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            return [list(s) for s in zip(*pool.map(trees, range(folds)))]
    if _spec(model).name in ("KNN", "GaussianNB"):
        jobs = [(params, f) for params in configurations for f in range(folds)]
        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            scores = list(pool.map(one, jobs))
        return [scores[i : i + folds] for i in range(0, len(scores), folds)]

    # fold by fold: what its configurations share is made by the first of them and dropped after the last
    fronts = {str(p.get("kernel")) for p in configurations}
    shared = {(f, k): _Shared(folded.where(F.col("fold") != f), features, label, model, sum(str(p.get("kernel")) == k for p in configurations))
              for f in range(folds) for k in fronts}

    def prepared(job: tuple[int, dict]) -> float:
        f, params = job
        fitted = shared[f, str(params.get("kernel"))].fit(params)
        return metrics(fitted, folded.where(F.col("fold") == f), label, key)["f1"]

    jobs = sorted(((f, p) for f in range(folds) for p in configurations), key=lambda j: (j[0], str(j[1].get("kernel"))))
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        scores = {(f, id(p)): s for (f, p), s in zip(jobs, pool.map(prepared, jobs))}
    return [[scores[f, id(p)] for f in range(folds)] for p in configurations]


def _mean_std(scores: Sequence[float]) -> tuple[float, float]:
    mean = sum(scores) / len(scores)
    return mean, (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5


def cross_validate(df: DataFrame, features: Sequence[str], label: str, key: str, model: str | ModelSpec, folds: int = 5,
                   seed: int = 42, **params) -> dict:
    """Weighted F1 of each stratified fold, with mean and population
    standard deviation. Scaling, label codes and penalty are those of the
    fold's own training rows."""
    folded = for_fitting(assign_folds(df, key, folds, seed=seed, label=label))
    scores = _fold_scores(folded, folds, features, label, key, model, [params])[0]
    mean, std = _mean_std(scores)
    return {"mean": mean, "std": std, "all": scores}


def search(df: DataFrame, features: Sequence[str], label: str, key: str, model: str | ModelSpec, strategy: str = "grid",
           folds: int = 5, n_iter: int = 20) -> list[tuple[dict, float, float]]:
    """(parameters, mean F1, std) of every tried configuration, best first."""
    grid = _spec(model).grid or [{}]
    if strategy == "random" and len(grid) > n_iter:
        order = sorted(range(len(grid)), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
        grid = [grid[i] for i in sorted(order[:n_iter])]
    folded = for_fitting(assign_folds(df, key, folds, seed=42, label=label))
    scores = _fold_scores(folded, folds, features, label, key, model, grid)
    return sorted([(params, *_mean_std(s)) for params, s in zip(grid, scores)], key=lambda r: (-r[1], str(r[0])))


def tune(name: str, original: Fitted, train: DataFrame, features: Sequence[str], label: str, key: str, strategy: str = "grid",
         folds: int = 5, n_iter: int = 20) -> Fitted:
    """The best configuration fitted on all rows of ``train``. A name
    without a grid gives the original model back."""
    spec = DEFAULT_MODELS.get(name)
    if spec is None or not spec.grid:
        return original
    params = search(train, features, label, key, spec, strategy, folds, n_iter)[0][0]
    return fit(train, features, label, spec, **params)


def score(payloads: DataFrame, fitted: Fitted, payload: str = "payload", severity: str = "base", key: str | None = None) -> DataFrame:
    """The input's columns, then preview, label, confidence and
    probabilities in percent (if the model gives any), severity, and the
    payload's features."""
    feats = add_payload_features(payloads, payload)
    pred = fitted.transform(feats, key)
    names = F.array(*[F.lit(x) for x in fitted.labels])
    pred = pred.withColumn("label", F.element_at(names, F.col("prediction").cast("int") + 1))
    if "probability" in pred.columns:
        pred = probability_columns(pred, fitted.labels)
    out = enrich_severity(pred, "label", severity)
    own = [c for c in ("confidence", "probabilities") if c in out.columns]
    return out.select(*payloads.columns, preview(payload, 80).alias("preview"), "label", *own, "severity", "severity_score",
                      *FEATURE_COLUMNS)


def predict_payloads(payloads: DataFrame, artifact: Fitted | str, payload: str = "payload") -> DataFrame:
    """``Payload``, ``predicted_label`` and ``confidence`` from a model or
    the folder of a saved one; raises if that is missing."""
    if isinstance(artifact, str):
        path, artifact = artifact, load_artifact(payloads.sparkSession, artifact)
        if artifact is None:
            raise FileNotFoundError(f"no model artifact in {path}; fit and save one first")
    out = score(payloads, artifact, payload)
    return out.select(F.col(payload).alias("Payload"), F.col("label").alias("predicted_label"),
                      *(["confidence"] if "confidence" in out.columns else []))


def audit(scored: DataFrame, label: str, predicted: str = "label") -> DataFrame:
    """Adds ``is_error``, 1 where the prediction differs from the label
    or is missing."""
    same = F.col(label).cast("string").eqNullSafe(F.col(predicted).cast("string"))
    return scored.withColumn("is_error", (~same).cast("int"))
