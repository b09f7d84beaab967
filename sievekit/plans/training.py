"""Training, tuning, cross-validation and scoring jobs (T8-T13, P1-P4) on the
corpus of the given tables: thin callers of ``operators.training``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import FEATURE_COLUMNS
from ..operators import training as tr
from ..operators.aggregates import score_summary
from ..operators.evaluate import classification_report, confusion_table, per_class_metrics, pr_curve, roc_auc
from ..operators.features import add_payload_features
from ..operators.forest import BinnedForest
from ..operators.models import DEFAULT_MODELS, ModelSpec, index_labels
from ..operators.select import pca_project
from ..operators.splits import n_splits_for, stratified_split
from ..session import reliable_checkpoint
from ..sources.io import scratch_path
from .corpus import labelled_corpus

FEATS = list(FEATURE_COLUMNS)

#: T13's regularised forest: 150 trees, depth 6, leaves of 3
REGULARISED = ModelSpec(
    "RandomForestRegularised",
    lambda n: BinnedForest(numTrees=150, maxDepth=6, minInstancesPerNode=3, seed=42))


def feature_table(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    """ID, text_label, seven features, split ('train'/'test'). The features are made
    first, one pass over the text as it is read, and kept without it: the split looks
    at keys and labels only, and no text is shuffled."""
    corpus = add_payload_features(labelled_corpus(spark, sf_dir), "Payload", counted=True)
    narrow = reliable_checkpoint(corpus.select("ID", "text_label", *FEATS))
    keys = stratified_split(narrow.select("ID", "text_label"), "text_label", "ID", 0.2, seed=seed)
    return narrow.drop("text_label").join(keys, "ID")


def _prepared(spark, sf_dir):
    """The narrow feature table with label codes, materialised for the fits."""
    data = feature_table(spark, sf_dir).select("ID", "text_label", "split", *FEATS)
    data = tr.for_fitting(data)
    indexer = index_labels(data, "text_label")
    data = indexer.transform(data)
    return data, data.where(F.col("split") == "train"), data.where(F.col("split") == "test"), indexer


def _train_test(spark, sf_dir):
    data, train, test, _ = _prepared(spark, sf_dir)
    return data.drop("label_idx"), train.drop("label_idx"), test.drop("label_idx")


def compare_models(spark: SparkSession, sf_dir: str, names: Sequence[str] | None = None) -> DataFrame:
    """Fit each model on the train split, score the test split; one
    metrics row per model, best (highest F1, then name) first."""
    _, train, test = _train_test(spark, sf_dir)
    results, _ = tr.train_and_evaluate(train, test, FEATS, "text_label", names, key="ID")
    rows = [(n, m["accuracy"], m["precision"], m["recall"], m["f1"]) for n, m in results.items()]
    out = spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1 double")
    return out.orderBy(F.desc("f1"), F.asc("model"))


def cross_validate(spark: SparkSession, sf_dir: str, name: str = "RandomForest", k: int | None = None) -> DataFrame:
    """Weighted F1 per stratified fold of the training split,
    with mean and population standard deviation beside every fold."""
    _, train, _ = _train_test(spark, sf_dir)
    cv = tr.cross_validate(train, FEATS, "text_label", "ID", name, k or n_splits_for(train, "text_label"))
    folds = spark.createDataFrame(list(enumerate(cv["all"])), "fold int, f1 double")
    s = score_summary(folds, "f1").first()
    return folds.withColumns({"mean_f1": F.lit(s["mean"]), "std_f1": F.lit(s["std"])})


def tune(spark: SparkSession, sf_dir: str, name: str = "LogisticRegression", strategy: str = "grid",
         n_iter: int = 20, folds: int = 5, top: int = 10) -> DataFrame:
    """The best ``top`` configurations with mean and std of weighted F1."""
    _, train, _ = _train_test(spark, sf_dir)
    rows = tr.search(train, FEATS, "text_label", "ID", name, strategy, folds, n_iter)
    rows = [(", ".join(f"{p}={v}" for p, v in params.items()) or "default", mean, std) for params, mean, std in rows]
    return spark.createDataFrame(rows, "params string, mean_f1 double, std_f1 double").orderBy(
        F.desc("mean_f1"), F.asc("params")).limit(top)


def saved_model(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Fit a model on the train split and save it; the artifact's folder."""
    _, train, _ = _train_test(spark, sf_dir)
    path = scratch_path(spark, f"model-{name}")
    tr.fit(train, FEATS, "text_label", name).save(path)
    return path


def score_batch(spark: SparkSession, sf_dir: str, payloads: DataFrame, name: str = "RandomForest",
                severity: str = "base") -> DataFrame:
    """``payloads`` (column ``payload``) scored by a model that is
    loaded from its saved artifact."""
    return tr.score(payloads, tr.load_artifact(spark, saved_model(spark, sf_dir, name)), severity=severity)


def prediction_audit(spark: SparkSession, sf_dir: str, name: str = "GaussianNB") -> DataFrame:
    """Every payload of the corpus with label, prediction and error flag."""
    corpus = labelled_corpus(spark, sf_dir).select("ID", "text_label", F.col("Payload").alias("payload"))
    train = tr.for_fitting(add_payload_features(corpus, "payload", counted=True).select("ID", "text_label", *FEATS))
    scored = tr.score(corpus, tr.fit(train, FEATS, "text_label", name))
    return tr.audit(scored, "text_label")


def train_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demo training job - regularised forest, CV F1, hold-out
    metrics and the tables behind its charts - as long rows (section, name,
    other, value)."""
    data, train, test = _train_test(spark, sf_dir)
    folds = n_splits_for(train, "text_label")
    cv = tr.cross_validate(train, FEATS, "text_label", "ID", REGULARISED, folds)
    fitted = tr.fit(train, FEATS, "text_label", REGULARISED)
    labels = fitted.labels
    scored = tr.reliable_checkpoint(_with_probabilities(fitted.transform(test), labels))
    names = F.array(*[F.lit(x) for x in labels])
    scored = scored.withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1))
    confusion = confusion_table(scored, "text_label", "predicted", labels)
    report = classification_report(per_class_metrics(confusion))
    m = tr.metrics(fitted, test, "text_label")
    importances = fitted.model.stages[-1].featureImportances.toArray().tolist()
    small = [("summary", k, "", float(v)) for k, v in {
        "final_accuracy": m["accuracy"], "final_f1": m["f1"], "cv_f1_mean": cv["mean"], "cv_f1_std": cv["std"],
        "trained_on": data.count(), "cv_folds": folds}.items()]
    small += [("importance", f, "", float(v)) for f, v in zip(FEATS, importances)]
    schema = "section string, name string, other string, value double"
    out = spark.createDataFrame(small, schema)
    scores = {c: f"p_{i}" for i, c in enumerate(labels)}

    def add(section, df, name, other, value):
        return out.unionByName(df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"),
                                         F.col(other).cast("string").alias("other") if other else F.lit("").alias("other"),
                                         F.col(value).cast("double").alias("value")))

    out = add("class_distribution", data.groupBy("text_label").count(), "text_label", None, "count")
    out = add("confusion", confusion, "actual", "predicted", "n")
    out = add("report_f1", report, "row", None, "f1")
    out = add("roc_auc", roc_auc(scored, "text_label", scores), "class", None, "auc")
    out = add("pr_precision", pr_curve(scored, "text_label", scores), "class", "recall", "precision")
    pca = pca_project(data, FEATS, 2, keep=("ID", "text_label"))
    out = add("pca_1", pca, "ID", "text_label", "PC1")
    return add("pca_2", pca, "ID", "text_label", "PC2")


def _with_probabilities(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    return df.select("ID", "text_label", "prediction", *[p[i].alias(f"p_{i}") for i in range(len(labels))])
