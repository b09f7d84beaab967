"""Labelled payload tables built from the driver tables.

The reference works on one labelled table ``(Payload, Label, text_label, ID)``
with three classes. Our three-class corpus comes from the given tables:
page markup is the XSS-like class, conversation turns the SQLi-like class and
documents the normal class. Everything is lazy; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ID STRING, Payload STRING, Label BIGINT, text_label STRING`` from
    pages (1 XSS), conversations (2 SQLi) and documents (3 Normal)."""
    pages = read_table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("ID"),
        F.col("html").alias("Payload"), F.lit(1).cast("bigint").alias("Label"), F.lit("XSS").alias("text_label"))
    convs = read_table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("ID"),
        F.col("text").alias("Payload"), F.lit(2).cast("bigint").alias("Label"), F.lit("SQLi").alias("text_label"))
    docs = read_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("ID"),
        F.col("text").alias("Payload"), F.lit(3).cast("bigint").alias("Label"), F.lit("Normal").alias("text_label"))
    return pages.unionByName(convs).unionByName(docs)


CORPUS_SQL = """(
  SELECT 'p' || CAST(page_id AS VARCHAR) AS ID, html AS Payload, CAST(1 AS BIGINT) AS Label, 'XSS' AS text_label FROM pages
  UNION ALL
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR), text, CAST(2 AS BIGINT), 'SQLi' FROM conversations
  UNION ALL
  SELECT 'd' || CAST(doc_id AS VARCHAR), text, CAST(3 AS BIGINT), 'Normal' FROM documents
)"""


# ---------------------------------------------------------------------------
# Deterministic scored corpus: a keyword rule predicts the class and three
# feature-derived scores act as class probabilities. Used as the input of the
# evaluation, aggregation and ordering queries, so those are value-checkable
# without a trained model.
# ---------------------------------------------------------------------------
def scored_corpus(spark: SparkSession, sf_dir: str, several_passes: bool = False,
                  counted: bool | None = None) -> DataFrame:
    """The narrow scored table (no text). It is lazy, so a single-pass summary
    computes only the features it reads; an operator that takes several
    passes asks for ``several_passes`` and gets it materialised once. ``counted``
    (by default where it is materialised) takes the features from one Arrow pass."""
    from ..operators.features import add_payload_features
    from ..session import reliable_checkpoint

    f = add_payload_features(labelled_corpus(spark, sf_dir), "Payload", counted=several_passes if counted is None else counted)
    ent = F.round("payload_entropy", 6)
    length = F.greatest(F.col("payload_len"), F.lit(1)).cast("double")
    z_xss = F.col("kw_xss") * 2.0 + F.round(F.col("special_char_cnt") / length * 10.0, 2)
    z_sqli = F.col("kw_sql") * 2.0 + F.round(F.col("digit_ratio") * 10.0, 2)
    z_norm = F.round(ent / 2.0, 2)
    total = z_xss + z_sqli + z_norm
    prob = lambda z: F.round(F.when(total > 0, z / total).otherwise(F.lit(1.0 / 3.0)), 6)
    pred = F.when(F.col("kw_xss") == 1, 1).when(F.col("kw_sql") == 1, 2).otherwise(3).cast("bigint")
    scored = f.select(
        "ID", "Label", "text_label", "payload_len", ent.alias("payload_entropy"), "special_char_cnt",
        "digit_ratio", "upper_ratio", "kw_sql", "kw_xss",
        pred.alias("prediction"),
        prob(z_xss).alias("p_xss"), prob(z_sqli).alias("p_sqli"), prob(z_norm).alias("p_normal"),
    )
    return reliable_checkpoint(scored) if several_passes else scored


def scored_corpus_sql() -> str:
    from .sqltext import sql_features

    f = sql_features("Payload")
    feats = ",\n    ".join(
        f"{f[c]} AS {c}" if c != "payload_entropy" else f"round({f[c]}, 6) AS payload_entropy"
        for c in ("payload_len", "payload_entropy", "special_char_cnt", "digit_ratio", "upper_ratio", "kw_sql", "kw_xss"))
    return f"""(
  SELECT *, round(CASE WHEN z_xss + z_sqli + z_norm > 0 THEN z_xss / (z_xss + z_sqli + z_norm) ELSE 1.0 / 3.0 END, 6) AS p_xss,
         round(CASE WHEN z_xss + z_sqli + z_norm > 0 THEN z_sqli / (z_xss + z_sqli + z_norm) ELSE 1.0 / 3.0 END, 6) AS p_sqli,
         round(CASE WHEN z_xss + z_sqli + z_norm > 0 THEN z_norm / (z_xss + z_sqli + z_norm) ELSE 1.0 / 3.0 END, 6) AS p_normal
  FROM (
    SELECT ID, Label, text_label, payload_len, payload_entropy, special_char_cnt, digit_ratio, upper_ratio, kw_sql, kw_xss,
      CAST(CASE WHEN kw_xss = 1 THEN 1 WHEN kw_sql = 1 THEN 2 ELSE 3 END AS BIGINT) AS prediction,
      kw_xss * 2.0 + round(special_char_cnt / CAST(greatest(payload_len, 1) AS DOUBLE) * 10.0, 2) AS z_xss,
      kw_sql * 2.0 + round(digit_ratio * 10.0, 2) AS z_sqli,
      round(payload_entropy / 2.0, 2) AS z_norm
    FROM (SELECT ID, Label, text_label,
    {feats}
    FROM {CORPUS_SQL})
  )
)"""
