"""Queries for model training, tuning and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import FEATURE_COLUMNS
from ..operators.models import fit_gaussian_nb, predict_gaussian_nb
from ..session import read_table
from .catalog import query
from .corpus import CORPUS_SQL
from .sqltext import sql_features
from .training import compare_models, cross_validate, prediction_audit, score_batch, train_report, tune

FEATS = list(FEATURE_COLUMNS)


def _fit_one(name):
    def run(spark, sf_dir):
        return compare_models(spark, sf_dir, [name])
    run.__doc__ = f"T1-T7: hold-out metrics of {name} (train split -> test split)."
    return run


for _n, _key in (("KNN", "compare_knn"), ("LogisticRegression", "fit_logreg"), ("DecisionTree", "fit_tree"), ("RandomForest", "fit_forest"),
                 ("SVM", "fit_svm"), ("MLP", "fit_mlp")):
    query(_key)(_fit_one(_n))


@query("compare_models")
def q_compare_models(spark, sf_dir):
    """Every registry model on the same split, best first."""
    return compare_models(spark, sf_dir)


@query("tune_grid")
def q_tune_grid(spark, sf_dir):
    """Weighted-F1 grid search of logistic regression's C over stratified folds."""
    return tune(spark, sf_dir, "LogisticRegression", "grid")


@query("tune_random")
def q_tune_random(spark, sf_dir):
    """Seeded random subset (without replacement) of the decision-tree grid."""
    return tune(spark, sf_dir, "DecisionTree", "random")


@query("cross_validate")
def q_cross_validate(spark, sf_dir):
    """Per-fold weighted F1 of a leak-free pipeline."""
    return cross_validate(spark, sf_dir, "LogisticRegression")


@query("train_report")
def q_train_report(spark, sf_dir):
    """Demo training job summary."""
    return train_report(spark, sf_dir)


@query("score_batch")
def q_score_batch(spark, sf_dir):
    """Score every benchmark text with a forest trained on the corpus."""
    b = read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("payload"))
    return score_batch(spark, sf_dir, b, "RandomForest")


@query("prediction_audit")
def q_prediction_audit(spark, sf_dir):
    """Prediction and error flag of every payload of the corpus."""
    return prediction_audit(spark, sf_dir).select("ID", "text_label", "label", "is_error", "preview")


def _gnb_sql(var_smoothing: float = 1e-9) -> str:
    f = sql_features("Payload")
    feats = ", ".join(f"CAST({f[c]} AS DOUBLE) AS {c}" if c != "payload_entropy" else f"{f[c]} AS {c}" for c in FEATS)
    mus = ", ".join(f"avg({c}) AS mu_{c}, var_pop({c}) AS var_{c}" for c in FEATS)
    maxvar = "greatest(" + ", ".join(f"(SELECT var_pop({c}) FROM tr)" for c in FEATS) + ")"
    ll = " + ".join(f"(-0.5 * ln(2 * pi() * (var_{c} + eps)) - ({c} - mu_{c}) * ({c} - mu_{c}) / (2 * (var_{c} + eps)))"
                    for c in FEATS)
    return f"""
WITH base AS (SELECT ID, Label, text_label, {feats} FROM {CORPUS_SQL}),
tr AS (SELECT * FROM base),
st AS (SELECT text_label AS cls, count(*) / (SELECT count(*) FROM tr) AS prior, {mus}, {maxvar} * {var_smoothing} AS eps
       FROM tr GROUP BY text_label),
sc AS (SELECT b.ID, st.cls, ln(prior) + {ll} AS ll FROM base b, st)
SELECT ID, arg_max(cls, ll) AS prediction FROM sc GROUP BY ID
"""


from .catalog import ORACLE  # noqa: E402

ORACLE["prediction_audit"] = f"""
WITH p AS ({_gnb_sql().strip().rstrip(';')})
SELECT c.ID, c.text_label, p.prediction AS label, CAST(c.text_label <> p.prediction AS INTEGER) AS is_error,
       CASE WHEN length(c.Payload) > 80 THEN substr(c.Payload, 1, 80) || '…' ELSE c.Payload END AS preview
FROM {CORPUS_SQL} c JOIN p USING (ID)"""


@query("fit_gaussian_nb", _gnb_sql())
def q_fit_gaussian_nb(spark, sf_dir):
    """Gaussian naive Bayes fitted on the whole corpus (class means,
    population variances + var_smoothing x max variance) and its argmax class
    for every payload."""
    from ..operators.features import add_payload_features
    from .corpus import labelled_corpus

    from ..session import reliable_checkpoint

    # fit (two aggregates) and predict both read the features: compute them once
    df = reliable_checkpoint(add_payload_features(labelled_corpus(spark, sf_dir), "Payload", counted=True).select(
        "ID", "text_label", *[F.col(c).cast("double").alias(c) for c in FEATS]))
    state = fit_gaussian_nb(df, FEATS, "text_label")
    return predict_gaussian_nb(df, state, FEATS).select("ID", "prediction")


def _knn_sql(k: int = 5, plain: bool = False) -> str:
    """``plain``: features and distances as they are, not rounded, and labels
    coded 0, 1, 2 in the order of their names."""
    from .corpus import scored_corpus_sql
    from .q_splits import STRATIFIED_SPLIT_SQL

    fs = FEATS
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS mu_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS sd_{c}" for c in fs)
    one = lambda c: f"(CAST({c} AS DOUBLE) - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1 ELSE sd_{c} END"
    scaled = ", ".join(f"{one(c)} AS {c}" if plain else f"round({one(c)}, 9) AS {c}" for c in fs)
    source = scored_corpus_sql()
    if plain:
        raw = sql_features("Payload")
        source = f"(SELECT ID, 3 - Label AS Label, {', '.join(f'{raw[c]} AS {c}' for c in fs)} FROM {CORPUS_SQL})"
    dist = "0.0"
    for c in fs:
        dist = f"({dist} + (q.{c} - t.{c}) * (q.{c} - t.{c}))"
    order = ", ".join(f"t.{c}" for c in fs)
    return f"""
WITH sp AS ({STRATIFIED_SPLIT_SQL}),
f AS (SELECT s.ID, s.Label, {', '.join('s.' + c for c in fs)}, sp.split FROM {source} s JOIN sp USING (ID)),
st AS (SELECT {stats} FROM f WHERE split = 'train'),
sc AS (SELECT ID, Label, split, {scaled} FROM f, st),
tv AS (SELECT {', '.join(fs)}, Label, count(*) AS w FROM sc WHERE split = 'train' GROUP BY ALL),
pr AS (SELECT q.ID, t.Label, t.w, sqrt({dist}) AS d,
         sum(t.w) OVER (PARTITION BY q.ID ORDER BY sqrt({dist}), t.Label, {order}
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
       FROM sc q, tv t WHERE q.split = 'test'),
tk AS (SELECT ID, Label, least(w, greatest({k} - (cum - w), 0)) AS take FROM pr),
v AS (SELECT ID, Label, sum(take) AS votes FROM tk WHERE take > 0 GROUP BY ALL)
SELECT ID, CAST(arg_max(Label, votes * 1000 - Label) AS BIGINT) AS prediction, CAST(max(votes) AS BIGINT) AS votes
FROM v GROUP BY ID
"""


@query("fit_knn", _knn_sql())
def q_fit_knn(spark, sf_dir):
    """T4: exact 5-nearest-neighbour votes for the test split, features
    standardised with train statistics (population std), by best-first descent
    through a stored k-d tree (no all-pairs join)."""
    from ..operators.knn import knn_classify
    from ..operators.scale import fit_scaler, transform
    from ..operators.splits import stratified_split
    from .corpus import scored_corpus

    s = scored_corpus(spark, sf_dir, True).select("ID", "Label", *FEATS)
    sp = stratified_split(s, "Label", "ID", 0.2, seed=42)
    train = sp.where(F.col("split") == "train")
    state = fit_scaler(train, "standard", FEATS)
    scaled = transform(sp, state).withColumns({c: F.round(c, 9) for c in FEATS})
    out = knn_classify(scaled.where(F.col("split") == "train"), scaled.where(F.col("split") == "test"),
                       FEATS, "Label", "ID", k=5)
    return out.select("ID", F.col("prediction").cast("bigint"), F.col("votes").cast("bigint"))


def _split_sql() -> str:
    from .corpus import scored_corpus_sql

    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, Label AS y, CAST({c} AS DOUBLE) AS x FROM s" for c in FEATS)
    sq = lambda p: " + ".join(f"CAST({p}{k} AS DOUBLE) * {p}{k}" for k in (1, 2, 3))
    return f"""
WITH s AS {scored_corpus_sql()}, l AS ({parts}),
h AS (SELECT feature, x, {', '.join(f'count(*) FILTER (WHERE y = {k}) AS c{k}' for k in (1, 2, 3))} FROM l GROUP BY feature, x),
w AS (SELECT feature, x, lead(x) OVER (PARTITION BY feature ORDER BY x) AS nxt,
  {', '.join(f'sum(c{k}) OVER (PARTITION BY feature ORDER BY x) AS l{k}, sum(c{k}) OVER (PARTITION BY feature) AS t{k}' for k in (1, 2, 3))} FROM h),
r AS (SELECT feature, x, nxt, l1, l2, l3, t1 - l1 AS r1, t2 - l2 AS r2, t3 - l3 AS r3 FROM w WHERE nxt IS NOT NULL),
q AS (SELECT feature, x, nxt, l1 + l2 + l3 AS n_left, r1 + r2 + r3 AS n_right, ({sq('l')}) / (l1 + l2 + l3) + ({sq('r')}) / (r1 + r2 + r3) AS score FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY score DESC, x) AS nth FROM q)
SELECT feature, round(x / 2 + nxt / 2, 6) AS threshold, CAST(n_left AS BIGINT) AS n_left, CAST(n_right AS BIGINT) AS n_right,
       round(1 - score / (n_left + n_right), 6) AS gini FROM b WHERE nth = 1
"""


@query("tree_splits", _split_sql())
def q_tree_splits(spark, sf_dir):
    """The exact best root split of the corpus on each feature."""
    from ..operators.cart import split_table
    from .corpus import scored_corpus

    t = split_table(scored_corpus(spark, sf_dir, counted=True).select("Label", *FEATS), FEATS, "Label")
    return t.select("feature", F.round("threshold", 6).alias("threshold"), "n_left", "n_right", F.round("gini", 6).alias("gini"))


@query("fit_tree_exact")
def q_fit_tree_exact(spark, sf_dir):
    """Exact tree of the training split, unlimited depth, applied to the test split."""
    from ..operators.cart import fit_tree, predict_tree
    from ..operators.splits import stratified_split
    from .corpus import scored_corpus

    s = stratified_split(scored_corpus(spark, sf_dir, True).select("ID", "Label", *FEATS), "Label", "ID", 0.2, seed=42)
    tree = fit_tree(s.where(F.col("split") == "train"), FEATS, "Label", min_samples_split=2)
    return predict_tree(s.where(F.col("split") == "test"), tree, "ID")


def _scored_sql(var_smoothing: float = 1e-9) -> str:
    from .q_splits import STRATIFIED_SPLIT_SQL

    f, b = sql_features("Payload"), sql_features("text")
    num = lambda of: ", ".join(f"CAST({of[c]} AS DOUBLE) AS {c}" for c in FEATS)
    mus = ", ".join(f"avg({c}) AS mu_{c}, var_pop({c}) AS var_{c}" for c in FEATS)
    maxvar = "greatest(" + ", ".join(f"(SELECT var_pop({c}) FROM tr)" for c in FEATS) + ")"
    ll = " + ".join(f"(-0.5 * ln(2 * pi() * (var_{c} + eps)) - ({c} - mu_{c}) * ({c} - mu_{c}) / (2 * (var_{c} + eps)))" for c in FEATS)
    return f"""
WITH sp AS ({STRATIFIED_SPLIT_SQL}),
tr AS (SELECT text_label, {num(f)} FROM {CORPUS_SQL} c JOIN sp USING (ID) WHERE sp.split = 'train'),
st AS (SELECT text_label AS cls, count(*) / (SELECT count(*) FROM tr) AS prior, {mus}, {maxvar} * {var_smoothing} AS eps FROM tr GROUP BY text_label),
q AS (SELECT item_id, {num(b)} FROM benchmark),
sc AS (SELECT item_id, cls, ln(prior) + {ll} AS ll FROM q, st),
t AS (SELECT *, max(ll) OVER (PARTITION BY item_id) AS top FROM sc),
p AS (SELECT item_id, arg_max(cls, ll) AS label, round(100 / sum(exp(ll - top)), 1) AS confidence FROM t GROUP BY item_id)
SELECT item_id, label, confidence, sev AS severity, CAST(score AS INTEGER) AS severity_score
FROM p JOIN (VALUES ('XSS', 'CRITICAL', 95), ('SQLi', 'HIGH', 85), ('Normal', 'SAFE', 10)) AS b(lbl, sev, score) ON lbl = label
"""


@query("score_artifact", _scored_sql())
def q_score_artifact(spark, sf_dir):
    """Benchmark texts scored by a naive Bayes model that was
    trained on the training split, saved, and loaded from its current version."""
    b = read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("payload"))
    return score_batch(spark, sf_dir, b, "GaussianNB").select("item_id", "label", "confidence", "severity", F.col("severity_score").cast("int").alias("severity_score"))


def _bayes_folds_sql(smoothings=(1e-9, 1e-8, 1e-7)) -> str:
    """CTEs up to f1(fold, v, f1): weighted F1 of naive Bayes on each of five
    stratified folds, for each variance smoothing."""
    f = sql_features("Payload")
    feats = ", ".join(f"CAST({f[c]} AS DOUBLE) AS {c}" for c in FEATS)
    mus = ", ".join(f"avg({c}) AS mu_{c}, var_pop({c}) AS var_{c}" for c in FEATS)
    most = "greatest(" + ", ".join(f"var_pop({c})" for c in FEATS) + ")"
    ll = " + ".join(f"(-0.5 * ln(2 * pi() * (var_{c} + mv * v)) - ({c} - mu_{c}) * ({c} - mu_{c}) / (2 * (var_{c} + mv * v)))" for c in FEATS)
    return f"""
b AS (SELECT ID, text_label, {feats} FROM {CORPUS_SQL}),
n AS (SELECT text_label, count(*) AS n FROM b GROUP BY text_label),
o AS (SELECT text_label, coalesce(sum(n) OVER (ORDER BY text_label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM n),
d AS (SELECT b.*, (off + row_number() OVER (PARTITION BY text_label ORDER BY md5('42|' || ID), ID) - 1) % 5 AS fold FROM b JOIN o USING (text_label)),
k(test) AS (VALUES (0), (1), (2), (3), (4)),
st AS (SELECT test, text_label AS cls, count(*) AS c, {mus} FROM d JOIN k ON fold <> test GROUP BY ALL),
mv AS (SELECT test, {most} AS mv, count(*) AS n FROM d JOIN k ON fold <> test GROUP BY ALL),
sc AS (SELECT ID, text_label AS y, test AS fold, v, cls, ln(c / n) + {ll} AS ll FROM d JOIN st ON fold = test JOIN mv USING (test), (VALUES {', '.join(f'({v!r})' for v in smoothings)}) vs(v)),
p AS (SELECT ID, y, fold, v, arg_max(cls, ll) AS z FROM sc GROUP BY ALL),
m AS (SELECT fold, v, n.text_label AS cls, count(*) FILTER (WHERE y = n.text_label) AS s, count(*) FILTER (WHERE z = n.text_label) AS pr,
             count(*) FILTER (WHERE y = n.text_label AND z = n.text_label) AS tp FROM p, n GROUP BY ALL),
f1 AS (SELECT fold, v, sum(s * CASE WHEN s + pr = 0 THEN 0 ELSE 2.0 * tp / (s + pr) END) / sum(s) AS f1 FROM m GROUP BY ALL)"""


def _corpus_features(spark, sf_dir):
    from ..operators.features import add_payload_features
    from ..operators.training import for_fitting
    from .corpus import labelled_corpus

    return for_fitting(add_payload_features(labelled_corpus(spark, sf_dir), "Payload", counted=True).select("ID", "text_label", *FEATS))


@query("cross_validate_bayes", f"""WITH {_bayes_folds_sql((1e-9,))}
SELECT CAST(fold AS INTEGER) AS fold, round(f1, 6) AS f1, round(avg(f1) OVER (), 6) AS mean_f1, round(stddev_pop(f1) OVER (), 6) AS std_f1 FROM f1""")
def q_cross_validate_bayes(spark, sf_dir):
    """Weighted F1 of naive Bayes on five stratified folds of the corpus."""
    from ..operators.training import cross_validate as folds_of

    cv = folds_of(_corpus_features(spark, sf_dir), FEATS, "text_label", "ID", "GaussianNB", 5)
    rows = [(i, round(f, 6), round(cv["mean"], 6), round(cv["std"], 6)) for i, f in enumerate(cv["all"])]
    return spark.createDataFrame(rows, "fold int, f1 double, mean_f1 double, std_f1 double")


@query("tune_bayes", f"""WITH {_bayes_folds_sql()}
SELECT 'var_smoothing=' || CASE v WHEN 1e-9 THEN '1e-09' WHEN 1e-8 THEN '1e-08' ELSE '1e-07' END AS params,
       round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1 FROM f1 GROUP BY v""")
def q_tune_bayes(spark, sf_dir):
    """Mean and deviation of weighted F1 for every smoothing in the grid of naive Bayes."""
    from ..operators.training import search

    found = search(_corpus_features(spark, sf_dir), FEATS, "text_label", "ID", "GaussianNB", "grid", 5)
    rows = [(", ".join(f"{k}={v}" for k, v in params.items()), round(mean, 6), round(std, 6)) for params, mean, std in found]
    return spark.createDataFrame(rows, "params string, mean_f1 double, std_f1 double")


def _weighted_sql(pairs: str, model: str) -> str:
    """One metrics row of CTE ``pairs`` (y, z)."""
    return f"""
c AS (SELECT k.cls, count(*) FILTER (WHERE y = k.cls) AS s, count(*) FILTER (WHERE z = k.cls) AS pr, count(*) FILTER (WHERE y = k.cls AND z = k.cls) AS tp
      FROM {pairs}, (VALUES ('Normal'), ('SQLi'), ('XSS')) k(cls) GROUP BY k.cls)
SELECT '{model}' AS model, sum(tp) / sum(s) AS accuracy, sum(s * CASE WHEN pr = 0 THEN 0 ELSE tp / pr END) / sum(s) AS precision,
       sum(s * CASE WHEN s = 0 THEN 0 ELSE tp / s END) / sum(s) AS recall,
       sum(s * CASE WHEN s + pr = 0 THEN 0 ELSE 2.0 * tp / (s + pr) END) / sum(s) AS f1 FROM c"""


def _holdout_bayes_sql(var_smoothing: float = 1e-9) -> str:
    from .q_splits import STRATIFIED_SPLIT_SQL

    f = sql_features("Payload")
    feats = ", ".join(f"CAST({f[c]} AS DOUBLE) AS {c}" for c in FEATS)
    mus = ", ".join(f"avg({c}) AS mu_{c}, var_pop({c}) AS var_{c}" for c in FEATS)
    most = "greatest(" + ", ".join(f"(SELECT var_pop({c}) FROM b WHERE split = 'train')" for c in FEATS) + ")"
    ll = " + ".join(f"(-0.5 * ln(2 * pi() * (var_{c} + eps)) - ({c} - mu_{c}) * ({c} - mu_{c}) / (2 * (var_{c} + eps)))" for c in FEATS)
    return f"""WITH sp AS ({STRATIFIED_SPLIT_SQL}),
b AS (SELECT ID, text_label, split, {feats} FROM {CORPUS_SQL} c JOIN sp USING (ID)),
st AS (SELECT text_label AS cls, count(*) / (SELECT count(*) FROM b WHERE split = 'train') AS prior, {mus}, {most} * {var_smoothing} AS eps
       FROM b WHERE split = 'train' GROUP BY text_label),
sc AS (SELECT ID, text_label AS y, cls, ln(prior) + {ll} AS ll FROM b, st WHERE split = 'test'),
pz AS (SELECT ID, y, arg_max(cls, ll) AS z FROM sc GROUP BY ID, y),{_weighted_sql('pz', 'GaussianNB')}"""


@query("compare_bayes", _holdout_bayes_sql())
def q_compare_bayes(spark, sf_dir):
    """Hold-out metrics of naive Bayes (train split -> test split)."""
    return compare_models(spark, sf_dir, ["GaussianNB"])


ORACLE["compare_knn"] = f"""WITH v0 AS ({_knn_sql(plain=True)}),
pz AS (SELECT c.text_label AS y, CASE v0.prediction WHEN 2 THEN 'XSS' WHEN 1 THEN 'SQLi' ELSE 'Normal' END AS z FROM v0 JOIN {CORPUS_SQL} c USING (ID)),{_weighted_sql('pz', 'KNN')}"""
