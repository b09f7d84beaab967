"""Evaluation as tables (M1-M8).

Input: one row per scored example with a true label, a predicted label and
optionally one score column per class. All metrics come from grouped counts:
the confusion table is (classes x classes) rows; curves group by
(class, score) first and take running sums with ``running_sum``, which never
puts a whole class into one task and shuffles the grouped scores once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .prefix import running_sum


def confusion_table(df: DataFrame, label: str, prediction: str, classes: Sequence) -> DataFrame:
    """M5: (actual, predicted, n) over the fixed class order, zeros filled.

    No row is lost: labels or predictions that are null or not in
    ``classes`` are counted under null, in extra rows with a null position
    that exist only when there are such values.

    The counts, at most (classes + 1)^2 rows, come to the driver, so the scored rows
    are computed once; the table lies in one partition, and what is made of it
    shuffles nothing."""
    spark, none = df.sparkSession, F.lit(None).cast("int")
    place = lambda c: F.coalesce(*[F.when(F.col(c) == F.lit(x), F.lit(i)) for i, x in enumerate(classes)], none)
    counts = df.groupBy(place(label).alias("a"), place(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    got = {(r["a"], r["p"]): r["n"] for r in counts.collect()}
    first = [list(classes).index(c) for c in classes]
    cells = [(i, j, got.get((a, p), 0)) for i, a in enumerate(first) for j, p in enumerate(first)]
    cells += [(a, p, n) for (a, p), n in got.items() if a is None or p is None]
    listed = F.array(*[F.lit(c) for c in classes])

    def named(col: str, at: str):
        # of the type that holds the listed classes and the column's values
        kind = spark.range(1).select(F.explode(listed).alias("c")).unionByName(df.select(F.col(col).alias("c"))).schema["c"].dataType
        return F.get(listed.cast(ArrayType(kind)), F.col(at))

    table = spark.createDataFrame(cells, "a_pos int, p_pos int, n bigint").coalesce(1)
    return table.select("a_pos", named(label, "a_pos").alias("actual"), "p_pos", named(prediction, "p_pos").alias("predicted"), "n")


def per_class_metrics(confusion: DataFrame, beta: float = 1.0) -> DataFrame:
    """Per class: tp, fp, fn, support, precision, recall, f-beta
    (zero_division -> 0). Support counts every row of the class, whatever
    was predicted; rows whose label is null or not listed form one more class
    (null) that nothing predicts."""
    def part(pos, cls, tp, support, pred_n):
        return F.struct(pos.alias("position"), cls.cast(confusion.schema["actual"].dataType).alias("class"), tp.cast("bigint").alias("tp"),
                        support.cast("bigint").alias("support"), pred_n.cast("bigint").alias("pred_n"))

    # a cell counts for its label and, if there is one, for its prediction: one pass, no join
    actual, predicted, n, zero = F.col("actual"), F.col("predicted"), F.col("n"), F.lit(0)
    own = part(F.col("a_pos"), actual, F.when(actual == predicted, n).otherwise(zero), n, zero)
    other = part(F.col("p_pos"), predicted, zero, zero, n)
    parts = confusion.select(F.explode(F.when(predicted.isNull(), F.array(own)).otherwise(F.array(own, other))).alias("r")).select("r.*")
    m = parts.groupBy("position", "class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "pred_n")])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("pred_n").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support").cast("double")), F.lit(0.0))
    b2 = beta * beta
    f = F.coalesce(F.try_divide((1 + b2) * F.col("precision") * F.col("recall"),
                                b2 * F.col("precision") + F.col("recall")), F.lit(0.0))
    return (m.withColumn("precision", prec).withColumn("recall", rec).withColumn("f1", f)
            .select("position", "class", "tp",
                    (F.col("pred_n") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"),
                    F.col("support").cast("bigint").alias("support"), "precision", "recall", "f1"))


def overall_metrics(per_class: DataFrame) -> DataFrame:
    """M1/M2: accuracy and support-weighted precision / recall / F1."""
    return per_class.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"))


def binary_metrics(per_class: DataFrame, positive) -> DataFrame:
    """M3: with two classes, the positive class's precision/recall/F1 (plus accuracy)."""
    is_pos = F.col("class") == F.lit(positive)  # never true of the null class
    return per_class.agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
                         *[F.max(F.when(is_pos, F.col(c))).alias(c) for c in ("precision", "recall", "f1")])


def evaluate(df: DataFrame, label: str, prediction: str, classes: Sequence) -> DataFrame:
    """M4 building block: one row of metrics; binary average with exactly two
    classes (positive = the larger code, as the original caller passes), else weighted."""
    per = per_class_metrics(confusion_table(df, label, prediction, classes))
    if len(classes) == 2:
        return binary_metrics(per, sorted(classes)[-1])
    return overall_metrics(per)


def classification_report(per_class: DataFrame) -> DataFrame:
    """M6: per-class rows, then accuracy, macro avg and weighted avg rows
    (row, precision, recall, f1, support); accuracy has only f1 and support."""
    cls = per_class.where("class IS NOT NULL").select(
        F.col("position"), F.col("class").cast("string").alias("row"), "precision", "recall", "f1", "support")
    listed = lambda c: F.avg(F.when(F.col("class").isNotNull(), F.col(c)))
    tot = per_class.agg(
        F.sum("support").alias("s"), F.sum("tp").alias("t"),
        listed("precision").alias("mp"), listed("recall").alias("mr"), listed("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    def row(pos, name, p, r, f):
        return F.struct(F.lit(pos).alias("position"), F.lit(name).alias("row"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"),
                        F.col("s").cast("bigint").alias("support"))

    none = F.lit(None)
    summary = tot.select(F.explode(F.array(
        row(1000, "accuracy", none, none, F.col("t") / F.col("s")),
        row(1001, "macro avg", F.col("mp"), F.col("mr"), F.col("mf")),
        row(1002, "weighted avg", F.col("wp"), F.col("wr"), F.col("wf")),
    )).alias("r")).select("r.*")
    return cls.unionByName(summary)


def _score_long(df: DataFrame, label: str, score_cols: dict) -> DataFrame:
    """(class, y, score) with y = 1 when the example belongs to the class."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("class"), (F.col(label) == F.lit(c)).cast("int").alias("y"),
                 F.col(s).cast("double").alias("score"))
        for c, s in score_cols.items()])).alias("r")).select("r.*")


def curve_points(df: DataFrame, label: str, score_cols: dict) -> DataFrame:
    """Shared M7/M8 core: per class and distinct score (descending), the
    cumulative true/false positives and the class totals."""
    long = _score_long(df, label, score_cols)
    g = long.groupBy("class", "score").agg(F.sum("y").alias("tp"), F.sum(1 - F.col("y")).alias("fp"))
    cum = running_sum(g, ["class"], [F.desc("score")], ["tp", "fp"])  # keeps tp, fp and adds cum_tp, cum_fp
    # from the checkpointed curve, so the scores aren't computed again
    totals = cum.groupBy("class").agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"))
    return cum.join(F.broadcast(totals), "class")  # one row per class


def roc_curve(df: DataFrame, label: str, score_cols: dict) -> DataFrame:
    """M7: (class, threshold, fpr, tpr) one-vs-rest, thresholds at every
    distinct score plus the (+inf, 0, 0) start; collinear points are kept."""
    pts = curve_points(df, label, score_cols)
    body = pts.select("class", F.col("score").alias("threshold"),
                      (F.col("cum_fp") / F.col("N")).alias("fpr"), (F.col("cum_tp") / F.col("P")).alias("tpr"))
    start = pts.select("class").distinct().select("class", F.lit(float("inf")).alias("threshold"),
                                                  F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return body.unionByName(start)


def roc_auc(df: DataFrame, label: str, score_cols: dict) -> DataFrame:
    """M7: trapezoidal AUC per class. Each distinct score adds the trapezoid
    fp_i/N x (tpr_i + tpr_(i-1))/2 with tpr_(i-1) = (cum_tp_i - tp_i)/P, so
    the area is a plain aggregate over the curve points (no window)."""
    pts = curve_points(df, label, score_cols)
    area = F.col("fp") * (2 * F.col("cum_tp") - F.col("tp")) / (2.0 * F.col("P") * F.col("N"))
    return pts.groupBy("class").agg(F.sum(area).alias("auc"))


def pr_curve(df: DataFrame, label: str, score_cols: dict) -> DataFrame:
    """M8: (class, threshold, precision, recall) at every distinct score,
    plus the (precision 1, recall 0) end point."""
    pts = curve_points(df, label, score_cols)
    body = pts.select("class", F.col("score").alias("threshold"),
                      (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"),
                      (F.col("cum_tp") / F.col("P")).alias("recall"))
    end = pts.select("class").distinct().select("class", F.lit(None).cast("double").alias("threshold"),
                                                F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return body.unionByName(end)
