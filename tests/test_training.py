"""Training and scoring on the caller's own tables (ports of the original's
train and predict tests)."""

import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.sql import functions as F

from sievekit.functions.dialect import FEATURE_COLUMNS
from sievekit.operators import training as tr
from sievekit.operators.evaluate import classification_report, confusion_table, overall_metrics, per_class_metrics
from sievekit.operators.features import add_payload_features

FEATS = list(FEATURE_COLUMNS)
PAYLOADS = [("Select a paint color for the room.",), ("1' OR '1'='1'; DROP TABLE users;--",), ("<script>alert('XSS')</script>",), ("",)]


@pytest.fixture(scope="module")
def split(spark):
    """Three classes with means -2 / 0 / 2, 270 training and 90 test rows."""
    noise = lambda k: F.abs(F.hash(F.col("id"), F.lit(k))) % 1000 / 1000.0 - 0.5
    df = spark.range(360).select("id", F.concat(F.lit("c"), F.col("id") % 3).alias("label"),
                                 *[((F.col("id") % 3 - 1) * 2 + noise(i)).alias(c) for i, c in enumerate(FEATS)])
    df = tr.for_fitting(df)
    return df.where("id < 270"), df.where("id >= 270")


def test_train_and_evaluate(split):
    results, fitted = tr.train_and_evaluate(*split, FEATS, "label", ["DecisionTree", "GaussianNB", "KNN"], key="id")
    assert set(results) == set(fitted) == {"DecisionTree", "GaussianNB", "KNN"}
    for m in results.values():
        assert set(m) == {"accuracy", "precision", "recall", "f1"} and all(0.95 <= v <= 1 for v in m.values())
    assert tr.best_model(results) in results


def test_labels_unseen_in_training_count_as_wrong(split):
    train, test = split
    fitted = tr.fit(train.where("label <> 'c2'"), FEATS, "label", "GaussianNB")
    assert tr.metrics(fitted, test, "label")["accuracy"] == pytest.approx(2 / 3)


def test_tune_gives_a_fitted_model(split):
    train, test = split
    original = tr.fit(train, FEATS, "label", "GaussianNB")
    best = tr.tune("GaussianNB", original, train, FEATS, "label", "id", folds=2)
    assert best is not original and tr.metrics(best, test, "label")["f1"] > 0.95
    assert tr.tune("NoSuchModel", original, train, FEATS, "label", "id") is original


def test_cross_validation(split):
    cv = tr.cross_validate(split[0], FEATS, "label", "id", "GaussianNB", folds=3)
    assert len(cv["all"]) == 3 and cv["mean"] > 0.95 and cv["std"] >= 0


def test_svm_has_probabilities(split):
    train, test = split
    rows = tr.fit(train, FEATS, "label", "SVM").transform(test).select("label", "prediction", "probability").collect()
    assert all(abs(sum(r.probability) - 1) < 1e-6 for r in rows)
    assert sum(f"c{int(r.prediction)}" == r.label for r in rows) / len(rows) > 0.95


@pytest.mark.parametrize("name", ["DecisionTree", "GaussianNB", "KNN"])
def test_artifacts(spark, tmp_path, name):
    corpus = spark.createDataFrame([(i, p[0] * (1 + i % 3), ["Normal", "SQLi", "XSS"][i % 4 % 3]) for i in range(40) for p in [PAYLOADS[i % 4 % 3]]],
                                   "id int, payload string, label string")
    train = add_payload_features(corpus, "payload").select("id", "label", *FEATS)
    fitted = tr.fit(train, FEATS, "label", name)
    fitted.save(str(tmp_path / "m"))
    loaded = tr.load_artifact(spark, str(tmp_path / "m"))
    assert loaded.labels == fitted.labels and loaded.kind == fitted.kind
    payloads = spark.createDataFrame([(k, p[0]) for k, p in enumerate(PAYLOADS)], "k int, payload string")
    a, b = (sorted(map(str, tr.score(payloads, m, key="k").collect())) for m in (fitted, loaded))
    assert a == b and len(a) == 4
    if name != "KNN":
        out = tr.predict_payloads(payloads, str(tmp_path / "m"))
        assert out.columns == ["Payload", "predicted_label", "confidence"] and out.count() == 4
        assert all(0 <= r.confidence <= 100 for r in out.collect())


def test_missing_artifact(spark, tmp_path):
    assert tr.load_artifact(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        tr.predict_payloads(spark.createDataFrame(PAYLOADS, "payload string"), str(tmp_path / "none"))


def test_audit_flags_missing_predictions(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", None)], "truth string, label string")
    assert [r.is_error for r in tr.audit(df, "truth").collect()] == [0, 1, 1]


def test_every_row_counts_in_the_metrics(spark):
    rows = [("a", "a")] * 4 + [("b", "b")] * 2 + [("a", None), ("b", None), ("a", "x"), (None, "a")]
    per = per_class_metrics(confusion_table(spark.createDataFrame(rows, "y string, p string"), "y", "p", ["a", "b"]))
    assert overall_metrics(per).first().accuracy == pytest.approx(0.6)
    report = {r.row: r for r in classification_report(per).collect()}
    assert report["accuracy"].f1 == pytest.approx(0.6) and report["accuracy"].support == 10 and report["a"].support == 6


def test_trees_of_a_fold_share_their_cells(split, monkeypatch):
    """borders and cells were made anew for every configuration."""
    train, test = split
    from sievekit.operators.forest import BinnedForest

    calls, prepare = [], BinnedForest.prepare
    monkeypatch.setattr(BinnedForest, "prepare", lambda self, df: calls.append(1) or prepare(self, df))
    grid = [{"maxDepth": 1}, {"maxDepth": 5, "minInstancesPerNode": 2}]
    shared = tr.fit_trees(train, FEATS, "label", "DecisionTree", grid)
    assert len(calls) == 1
    for fitted, params in zip(shared, grid):
        assert tr.metrics(fitted, test, "label") == tr.metrics(tr.fit(train, FEATS, "label", "DecisionTree", **params), test, "label")


def test_configurations_share_what_a_fold_prepares(spark, split, monkeypatch):
    """label codes, scaling and feature vectors were made anew for every configuration."""
    calls, index = [], tr.index_labels
    monkeypatch.setattr(tr, "index_labels", lambda *a: calls.append(1) or index(*a))
    spec = tr.ModelSpec("LogisticRegression", lambda n, C=1.0: LogisticRegression(maxIter=1, regParam=C / n), [{"C": 1.0}, {"C": 200.0}])
    folded = tr.for_fitting(tr.assign_folds(split[0], "id", 2, seed=42, label="label"))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    scores = tr._fold_scores(folded, 2, FEATS, "label", "id", spec, spec.grid)
    assert len(calls) == 2 and spark.sparkContext._jsc.getPersistentRDDs().size() == before
    own = tr.fit(folded.where("fold <> 1"), FEATS, "label", spec, C=200.0)
    assert scores[1][1] == tr.metrics(own, folded.where("fold = 1"), "label")["f1"]


def test_partitions_of_a_fit_follow_the_rows():
    """every step of a fit costs a task per partition."""
    assert [tr.fit_partitions(n) for n in (0, 1, 25_001, 800_000)] == [1, 1, 2, 32]
    assert tr.fit_partitions(5_400_000) == 54 and tr.fit_partitions(10**9) == 10_000


def test_margins_are_learned_from_vectors_made_once(spark):
    """the kernel's coordinates were computed again by every fold, class and pass."""
    from pyspark.ml.functions import array_to_vector

    from sievekit.operators.models import DEFAULT_MODELS, MarginCalibration

    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def coordinates(i):
        made.add(1)
        return [i % 3 - 1.0, i % 7 / 7]

    df = spark.range(0, 200, 1, 1).select(array_to_vector(coordinates("id")).alias("features"), (F.col("id") % 3).cast("double").alias("label_idx"))
    machine = OneVsRest(classifier=LinearSVC(maxIter=1), labelCol="label_idx", rawPredictionCol="rawPrediction")
    MarginCalibration(machine).fit(df)
    assert made.value == 200
    assert DEFAULT_MODELS["SVM"].build(10**7).getParallelism() == 1
