"""Feature selection and projection.

X1 estimates mutual information from a contingency table over exact
quantile bins (one long-form pass for all features; the deviation from the
k-nearest-neighbour estimator is documented). X2-X4 use the
importances of binned forests, which don't depend on partitions; X5 centres the features before MLlib PCA (MLlib does not).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .forest import BinnedForest
from .quantiles import exact_quantiles, unpivot_numeric


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """X1 scores: (feature, mi) in nats. Each feature is cut at its exact
    1/bins .. (bins-1)/bins quantiles; bin = number of cuts below the value."""
    feats = list(features)
    long = df.select(F.col(label).alias("__y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in feats])).alias("kv")) \
        .select("__y", "kv.feature", "kv.x").where(F.col("x").isNotNull())
    q = exact_quantiles(long, "x", [i / bins for i in range(1, bins)], ["feature"])
    cuts = q.groupBy("feature").agg(F.array_sort(F.collect_list("q")).alias("cuts"))  # bins-1 values per feature
    binned = long.join(F.broadcast(cuts), "feature").withColumn(
        "bin", F.size(F.filter("cuts", lambda c: c < F.col("x"))))
    joint = binned.groupBy("feature", "bin", "__y").agg(F.count(F.lit(1)).alias("n_by"))
    w_f = Window.partitionBy("feature")
    w_fb = Window.partitionBy("feature", "bin")
    w_fy = Window.partitionBy("feature", "__y")
    j = (joint.withColumn("n", F.sum("n_by").over(w_f)).withColumn("n_b", F.sum("n_by").over(w_fb))
         .withColumn("n_y", F.sum("n_by").over(w_fy)))  # windows over the small contingency table
    term = (F.col("n_by") / F.col("n")) * F.log((F.col("n_by") * F.col("n")) / (F.col("n_b") * F.col("n_y")))
    return j.groupBy("feature").agg(F.sum(term).alias("mi"))


def select_k_best(scores: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """X1 selection: top-k by score (ties: column order); names come back in
    the original column order with their rank."""
    pos = {c: i for i, c in enumerate(order)}
    arr = F.create_map(*[x for c in order for x in (F.lit(c), F.lit(pos[c]))])
    s = scores.withColumn("position", arr[F.col("feature")])
    w = Window.orderBy(F.desc("mi"), F.asc("position"))  # one row per feature
    k = min(k, len(order))
    return s.withColumn("rank", F.row_number().over(w)).withColumn("selected", (F.col("rank") <= k).cast("int"))


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


#: rows of a partition of ``laid_out``, about
LAYOUT_ROWS = 25_000


def laid_out(df: DataFrame, cols: Sequence[str], rows: int = LAYOUT_ROWS) -> DataFrame:
    """``cols`` of ``df`` in partitions of about ``rows`` rows, which depend on the
    rows alone: dealt by hash and sorted. Equal rows are counted first and
    numbered, so copies spread like any others."""
    equal = reliable_checkpoint(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__c")))
    n = equal.agg(F.sum("__c")).first()[0] or 0
    one = equal.withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), "__c")))
    dealt = one.repartition(max(1, -(-n // rows)), F.xxhash64(*cols, "__nth"))
    return dealt.sortWithinPartitions(*cols, "__nth").select(*cols)


def rf_importances(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, seed: int = 42) -> DataFrame:
    """Normalised importances (sum 1), descending; the same however the
    rows of ``df`` are partitioned."""
    model = BinnedForest(labelCol=label, featuresCol="features", numTrees=trees, seed=seed, maxDepth=30).fit(_assembled(df, features))
    imp = model.featureImportances.toArray().tolist()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), F.asc("feature"))


def select_from_model(importances: DataFrame, threshold: str | float = "mean") -> DataFrame:
    """Keep features whose importance >= threshold ('mean', 'median' or a number)."""
    if isinstance(threshold, str):
        if threshold not in ("mean", "median"):
            raise ValueError("threshold must be 'mean', 'median' or a number")
        agg = F.avg("importance") if threshold == "mean" else F.median("importance")
        t = importances.agg(agg.alias("t")).collect()[0]["t"]  # one value over #features rows
    else:
        t = float(threshold)
    return importances.withColumn("selected", (F.col("importance") >= F.lit(t)).cast("int"))


def recursive_elimination(df: DataFrame, features: Sequence[str], label: str, n_features: int,
                          trees: int = 50, seed: int = 42) -> list[str]:
    """Refit and drop the least important feature until ``n_features``
    remain (<= p fits on a cached table); names in original order."""
    keep = list(features)
    n_features = min(n_features, len(keep))
    base = df.select(label, *keep).cache()
    try:
        while len(keep) > n_features:
            imp = rf_importances(base, keep, label, trees, seed).collect()
            worst = min(imp, key=lambda r: (r["importance"], -keep.index(r["feature"])))["feature"]
            keep.remove(worst)
    finally:
        base.unpersist()
    return [f for f in features if f in keep]


def pca_project(df: DataFrame, features: Sequence[str], k: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """Centred PCA scores PC1..PCk; each component's sign is fixed so its
    largest-magnitude loading is positive."""
    feats = list(features)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in feats]).collect()[0]
    centred = df.select(*keep, *[(F.col(c).cast("double") - F.lit(means[c] or 0.0)).alias(c) for c in feats])
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(_assembled(centred, feats))
    pc = model.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    out = model.transform(_assembled(centred, feats)).withColumn("__a", vector_to_array("pcs"))
    return out.select(*keep, *[(F.col("__a")[j] * F.lit(signs[j])).alias(f"PC{j + 1}") for j in range(k)])
