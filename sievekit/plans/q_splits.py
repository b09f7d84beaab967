"""Queries for splits, folds and synthetic data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.splits import assign_folds, group_folds, stratified_split, time_folds
from ..operators.synth import (
    CLASS_ORDER, FILLER_WORDS, NORMAL_TEMPLATES, SQLI_TEMPLATES, XSS_TEMPLATES, inject_label_noise, synthetic_corpus,
)
from ..session import read_table
from .catalog import query
from .corpus import CORPUS_SQL, labelled_corpus

MD5 = "md5('42|' || CAST({k} AS VARCHAR))"


STRATIFIED_SPLIT_SQL = f"""
WITH t AS {CORPUS_SQL},
c AS (SELECT Label, count(*) AS n FROM t GROUP BY Label),
a AS (SELECT Label, n, CAST(ceil(0.2 * (SELECT sum(n) FROM c)) AS BIGINT) * n / (SELECT sum(n) FROM c) AS cont FROM c),
b AS (SELECT Label, floor(cont) AS fl, cont - floor(cont) AS rem FROM a),
q AS (SELECT Label, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, Label) <=
                                   (SELECT CAST(ceil(0.2 * (SELECT sum(n) FROM c)) AS BIGINT)) - (SELECT sum(fl) FROM b)
                              THEN 1 ELSE 0 END AS quota FROM b),
r AS (SELECT ID, Label, row_number() OVER (PARTITION BY Label ORDER BY {MD5.format(k='ID')}, ID) AS rk FROM t)
SELECT r.ID, r.Label, CASE WHEN rk <= quota THEN 'test' ELSE 'train' END AS split FROM r JOIN q USING (Label)
"""


@query("stratified_split", STRATIFIED_SPLIT_SQL)
def q_stratified_split(spark, sf_dir):
    """K1: exact 80/20 stratified split of the three-class corpus."""
    c = labelled_corpus(spark, sf_dir).select("ID", "Label")
    return stratified_split(c, "Label", "ID", 0.2, seed=42).select("ID", "Label", "split")


@query("stratified_folds", f"""
WITH t AS {CORPUS_SQL},
c AS (SELECT Label, count(*) AS n FROM t GROUP BY Label),
o AS (SELECT Label, coalesce(sum(n) OVER (ORDER BY Label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM c)
SELECT ID, Label, CAST((off + row_number() OVER (PARTITION BY Label ORDER BY {MD5.format(k='ID')}, ID) - 1) % 5 AS INTEGER) AS fold
FROM t JOIN o USING (Label)
""")
def q_stratified_folds(spark, sf_dir):
    """K2: stratified 5-fold assignment."""
    c = labelled_corpus(spark, sf_dir).select("ID", "Label")
    return assign_folds(c, "ID", 5, seed=42, label="Label").select("ID", "Label", "fold")


@query("plain_folds", f"""
SELECT event_id, CAST((row_number() OVER (ORDER BY {MD5.format(k='event_id')}, event_id) - 1) % 5 AS INTEGER) AS fold
FROM events
""")
def q_plain_folds(spark, sf_dir):
    """K3: shuffled 5-fold assignment of the scan log."""
    e = read_table(spark, sf_dir, "events").select("event_id")
    return assign_folds(e, "event_id", 5, seed=42).select("event_id", "fold")


@query("group_folds", """
SELECT event_id, user_id, CAST(CAST(('0x' || substr(md5('42|' || CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold
FROM events
""")
def q_group_folds(spark, sf_dir):
    """GroupKFold-style: all events of a user in one fold."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id")
    return group_folds(e, "user_id", 5, seed=42)


@query("time_folds", """
SELECT event_id, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) * 5 / (SELECT count(*) FROM events)) AS INTEGER) AS fold
FROM events
""")
def q_time_folds(spark, sf_dir):
    """Expanding time split: five equal-count folds in (ts, event_id) order."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts")
    return time_folds(e, "ts", "event_id", 5).select("event_id", "fold")


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _pick_sql(key: str, purpose: str, mod: int) -> str:
    return f"CAST(CAST(('0x' || substr(md5('42|{purpose}|' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) % {mod} AS INTEGER)"


def _gen_sql() -> str:
    parts = []
    for cls, tm in (("XSS", XSS_TEMPLATES), ("SQLi", SQLI_TEMPLATES), ("Normal", NORMAL_TEMPLATES)):
        filled = (f"replace({_sql_list(tm)}[{_pick_sql('event_id', 'tmpl-' + cls, len(tm))} + 1], '{{w}}', "
                  f"{_sql_list(FILLER_WORDS)}[{_pick_sql('event_id', 'word-' + cls, len(FILLER_WORDS))} + 1])")
        payload = (f"CASE WHEN {_pick_sql('event_id', 'ws-' + cls, 10000)} < 1500 "
                   f"THEN regexp_replace({filled}, '^([^ ]*) ', '\\1  ') ELSE {filled} END")
        parts.append(f"SELECT event_id, {payload} AS payload, '{cls}' AS label FROM events")
    return "\nUNION ALL\n".join(parts)


@query("synth_payloads", f"""
SELECT DISTINCT payload, label FROM ({_gen_sql()})
""")
def q_synth_payloads(spark, sf_dir):
    """G1: one synthetic payload per class for every scan-log event, then
    deduplicated (the demo generator's cleaning)."""
    keys = read_table(spark, sf_dir, "events").select("event_id")
    return synthetic_corpus(keys, "event_id", seed=42)


def _noise_sql() -> str:
    cls = _sql_list(CLASS_ORDER)
    return f"""
WITH t AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'Normal' WHEN 'click' THEN 'Normal'
                                 WHEN 'error' THEN 'XSS' ELSE 'SQLi' END AS label FROM events),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42|noise|' || CAST(event_id AS VARCHAR)), event_id) AS rk,
             CAST(floor((SELECT count(*) FROM t) * 0.03) AS BIGINT) AS m FROM t)
SELECT event_id,
  CASE WHEN rk <= m THEN list_filter({cls}, lambda c: c <> label)[{_pick_sql('event_id', 'other', 2)} + 1] ELSE label END AS label,
  rk <= m AS flipped
FROM r
"""


@query("label_noise", _noise_sql())
def q_label_noise(spark, sf_dir):
    """Exactly int(0.03 n) labels flipped to another class."""
    e = read_table(spark, sf_dir, "events")
    lab = (F.when(F.col("event_type").isin("view", "click"), "Normal")
           .when(F.col("event_type") == "error", "XSS").otherwise("SQLi"))
    t = e.select("event_id", lab.alias("label"))
    return inject_label_noise(t, "event_id", "label", 0.03, seed=42).select("event_id", "label", "flipped")


@query("class_share_by_split", f"""
WITH s AS ({STRATIFIED_SPLIT_SQL}),
g AS (SELECT split, Label, count(*) AS n FROM s GROUP BY ALL)
SELECT split, Label, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY split), 3) * 100 AS share_pct FROM g
""")
def q_class_share_by_split(spark, sf_dir):
    """A2 per split: class shares in the train and test parts (stratification check)."""
    from ..operators.aggregates import proportions

    c = labelled_corpus(spark, sf_dir).select("ID", "Label")
    s = stratified_split(c, "Label", "ID", 0.2, seed=42)
    return proportions(s, "Label", groups=["split"])


@query("shuffle_positions", f"""
SELECT event_id, CAST(row_number() OVER (ORDER BY {MD5.format(k='event_id')}, event_id) AS BIGINT) AS position FROM events
""")
def q_shuffle_positions(spark, sf_dir):
    """H6: position of every event in the seeded shuffle."""
    from ..operators.ordering import shuffle_positions

    e = read_table(spark, sf_dir, "events").select("event_id")
    return shuffle_positions(e, "event_id").select("event_id", (F.col("position") + 1).alias("position"))
