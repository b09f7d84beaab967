"""Corpus pipeline: documents to packed training sequences.

``STAGES`` lists (name, function). Each function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm import decision_list, gru_langid, pow2_packing, simhash_gray, suffix_dedup
from sievekit.llm.common import read_docs
from sievekit.session import checkpoint_dir

#: a document goes if no language reaches this pooled probability, or 1.6 times
#: an even share where there are more than four languages
LEAST_SCORE = 0.4
#: repeated strings from so many bytes on are cut out: less than fifty words
#: take with the space between them, so a repeated passage of fifty words has one
REPEAT_BYTES = 240


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID by the recurrent network; documents without a letter and
    those that no learned language explains go."""
    net = gru_langid.fit(docs, ~gru_langid.held_out())
    if net is None:
        return docs
    tagged = gru_langid.predict(docs, net)
    pred, score = tagged.columns[-2:]
    least = min(LEAST_SCORE, 1.6 / len(net.langs))
    return tagged.where((F.col(pred) != gru_langid.UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base rule and learned decision list; documents they reject go."""
    return decision_list.keep_good(docs, read_docs(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash_gray.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of ``REPEAT_BYTES`` are cut out; ``n_chars`` follows the text."""
    out = suffix_dedup.dedup_strings(docs, length=REPEAT_BYTES)
    if "n_chars" in docs.columns:
        changed = F.col(out.columns[-2]) > 0
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces with their token ids."""
    return pow2_packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language),
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("packing", packing),
]

#: no SQL expresses the language network and the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them lie in the
    shared checkpoint folder."""
    docs = read_docs(spark, sf_dir)
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
