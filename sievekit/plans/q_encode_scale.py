"""Queries for encoding and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import FEATURE_COLUMNS
from ..operators.aggregates import equal_width_histogram
from ..operators.encode import category_values, code_table, label_decode, label_encode, one_hot, one_hot_sparse
from ..operators.scale import METHODS, fit_scaler, transform
from ..session import read_table
from .catalog import query
from .corpus import scored_corpus, scored_corpus_sql

S = scored_corpus_sql()


@query("label_encode", """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand_code,
       CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type_code,
       CAST(dense_rank() OVER (ORDER BY CAST(p_size AS VARCHAR)) - 1 AS INTEGER) AS p_size_code
FROM part
""")
def q_label_encode(spark, sf_dir):
    """Sorted-text codes per column (p_size shows the '1' < '10' < '2' order)."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    for c in ("p_brand", "p_type", "p_size"):
        p, _ = label_encode(p, c, out_col=f"{c}_code")
    return p.select("p_partkey", *[F.col(f"{c}_code").cast("int").alias(f"{c}_code") for c in ("p_brand", "p_type", "p_size")])


@query("label_decode", """
SELECT CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code, o_orderpriority AS decoded, count(*) AS n
FROM orders GROUP BY o_orderpriority
""")
def q_label_decode(spark, sf_dir):
    """Encode the order priority, then decode the codes back."""
    o = read_table(spark, sf_dir, "orders").select("o_orderpriority")
    enc, table = label_encode(o, "o_orderpriority", out_col="code")
    dec = label_decode(enc.select("code"), "code", table, "decoded")
    return dec.groupBy(F.col("code").cast("int").alias("code"), "decoded").agg(F.count(F.lit(1)).alias("n"))


@query("one_hot", """
WITH cats AS (SELECT DISTINCT c_mktsegment AS v FROM customer)
SELECT c.c_custkey, 'c_mktsegment_' || cats.v AS category, CASE WHEN c.c_mktsegment = cats.v THEN 1.0 ELSE 0.0 END AS value
FROM customer c, cats
""")
def q_one_hot(spark, sf_dir):
    """Dense one-hot of the market segment, shown in long form."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    cats = {"c_mktsegment": category_values(c, "c_mktsegment")}
    wide = one_hot(c, cats)
    cols = [x for x in wide.columns if x != "c_custkey"]
    return wide.unpivot(["c_custkey"], cols, "category", "value")


@query("one_hot_sparse", """
SELECT p_partkey, CAST((SELECT count(DISTINCT p_name) FROM part) AS BIGINT) AS size,
       CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS BIGINT) AS index FROM part
""")
def q_one_hot_sparse(spark, sf_dir):
    """E4 with as many categories as part names, as (size, index)."""
    p = one_hot_sparse(read_table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name")
    return p.select("p_partkey", "onehot.size", "onehot.index")


def _scale_sql(method: str) -> str:
    exprs = []
    for c in FEATURE_COLUMNS:
        x = f"CAST({c} AS DOUBLE)"
        if method == "standard":
            e = f"({x} - avg({x}) OVER ()) / CASE WHEN stddev_pop({x}) OVER () = 0 THEN 1 ELSE stddev_pop({x}) OVER () END"
        elif method == "minmax":
            e = (f"({x} - min({x}) OVER ()) / CASE WHEN max({x}) OVER () - min({x}) OVER () = 0 THEN 1 "
                 f"ELSE max({x}) OVER () - min({x}) OVER () END")
        elif method == "robust":
            iqr = f"(quantile_cont({x}, 0.75) OVER () - quantile_cont({x}, 0.25) OVER ())"
            e = f"({x} - quantile_cont({x}, 0.5) OVER ()) / CASE WHEN {iqr} = 0 THEN 1 ELSE {iqr} END"
        elif method == "maxabs":
            e = f"{x} / CASE WHEN max(abs({x})) OVER () = 0 THEN 1 ELSE max(abs({x})) OVER () END"
        else:
            norm = "sqrt(" + " + ".join(f"CAST({k} AS DOUBLE) * CAST({k} AS DOUBLE)" for k in FEATURE_COLUMNS) + ")"
            e = f"{x} / CASE WHEN {norm} = 0 THEN 1 ELSE {norm} END"
        exprs.append(f"round({e}, 6) AS {c}")
    return f"SELECT ID, {', '.join(exprs)} FROM {S}"


def _scale_query(method: str):
    def run(spark, sf_dir):
        df = scored_corpus(spark, sf_dir, True).select("ID", *FEATURE_COLUMNS)
        out = transform(df, fit_scaler(df, method, list(FEATURE_COLUMNS)))
        return out.select("ID", *[F.round(c, 6).alias(c) for c in FEATURE_COLUMNS])
    run.__doc__ = f"E5-E9: {method} scaling of the seven features."
    return run


for _m in METHODS:
    query(f"scale_{_m}", _scale_sql(_m))(_scale_query(_m))


def _scaled_len_sql(method: str) -> str:
    x = "CAST(payload_len AS DOUBLE)"
    e = {
        "standard": f"({x} - avg({x}) OVER ()) / CASE WHEN stddev_pop({x}) OVER () = 0 THEN 1 ELSE stddev_pop({x}) OVER () END",
        "minmax": f"({x} - min({x}) OVER ()) / CASE WHEN max({x}) OVER () = min({x}) OVER () THEN 1 ELSE max({x}) OVER () - min({x}) OVER () END",
        "robust": f"({x} - quantile_cont({x}, 0.5) OVER ()) / CASE WHEN quantile_cont({x}, 0.75) OVER () = quantile_cont({x}, 0.25) OVER () "
                  f"THEN 1 ELSE quantile_cont({x}, 0.75) OVER () - quantile_cont({x}, 0.25) OVER () END",
        "maxabs": f"{x} / CASE WHEN max(abs({x})) OVER () = 0 THEN 1 ELSE max(abs({x})) OVER () END",
        "unit_vector": f"{x} / CASE WHEN abs({x}) = 0 THEN 1 ELSE abs({x}) END",
    }[method]
    return f"SELECT '{method}' AS method, round({e}, 9) AS v FROM {S}"


@query("scaling_histogram", f"""
WITH s AS ({' UNION ALL '.join(_scaled_len_sql(m) for m in METHODS)}),
r AS (SELECT method, min(v) AS mn, max(v) AS mx FROM s GROUP BY 1),
c AS (SELECT s.method, CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((v - mn) / (mx - mn) * 50), 49) END AS INTEGER) AS bin,
             count(*) AS n FROM s JOIN r USING (method) GROUP BY ALL),
d AS (SELECT method, CAST(unnest(range(0, 50)) AS INTEGER) AS bin FROM r)
SELECT d.method, d.bin, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM d LEFT JOIN c ON c.method = d.method AND c.bin = d.bin
""")
def q_scaling_histogram(spark, sf_dir):
    """50-bin histograms of payload length under each of the five scalers."""
    base = scored_corpus(spark, sf_dir, True).select("payload_len")
    parts = []
    for m in METHODS:
        scaled = transform(base, fit_scaler(base, m, ["payload_len"]))
        parts.append(scaled.select(F.lit(m).alias("method"), F.round("payload_len", 9).alias("v")))
    allv = parts[0]
    for p in parts[1:]:
        allv = allv.unionByName(p)
    return equal_width_histogram(allv, "v", 50, ["method"]).select("method", "bin", "n")


@query("code_table", """
SELECT c_name AS value, CAST(row_number() OVER (ORDER BY c_name) - 1 AS INTEGER) AS c_name_code
FROM (SELECT DISTINCT c_name FROM customer)
""")
def q_code_table(spark, sf_dir):
    """E3 state for a high-cardinality column (range-partitioned ranking)."""
    t = code_table(read_table(spark, sf_dir, "customer"), "c_name")
    return t.withColumn(t.columns[1], F.col(t.columns[1]).cast("int"))
