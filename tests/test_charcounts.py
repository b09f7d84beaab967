"""Character counts of a block of texts against plain Python, row by row."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from sievekit.functions import charcounts
from sievekit.functions.dialect import BASE, FEATURE_COLUMNS
from sievekit.operators.features import add_payload_features
from sievekit.plans.corpus import scored_corpus


SF001 = "/root/testdata/sf0.001"


def plain(t):
    c, low = Counter(t), t.lower()
    return {"counts": list(c.values()), "special": sum(c[x] for x in BASE.special_chars),
            "digits": sum(c[chr(x)] for x in range(48, 58)), "upper": sum(c[chr(x)] for x in range(65, 91)),
            "kw_sql": int(any(k in low for k in BASE.sql_keywords)), "kw_xss": int(any(k in low for k in BASE.xss_keywords))}


def texts():
    r = random.Random(7)
    alphabet = "abcSELECT <>script'()123éß漢字😀İK-/*select drop"
    own = ["", "sele", "ct", "-", "-", "<scr", "ipt", "SELEct", "linK", "UNİON"]
    return own + ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 5, 80, 700]))) for _ in range(300)]


@pytest.mark.parametrize("block", [1 << 20, 3000, 64])
def test_counts_equal_plain_counts(monkeypatch, block):
    monkeypatch.setattr(charcounts, "BLOCK_BYTES", block)
    for rows in (texts(), [t for t in texts() if t.isascii()], [""], []):
        data = pa.array([t.encode() for t in rows], pa.binary())
        got = charcounts.stats_of(data, BASE.special_chars, BASE.sql_keywords, BASE.xss_keywords)
        assert got.to_pylist() == [plain(t) for t in rows]


def test_sliced_and_invalid():
    raw = [b"x", b"a\xff\xfeb", b"\xe6\xbc", b"12"]
    data = pa.array(raw, pa.large_binary())[1:]
    got = charcounts.stats_of(data, BASE.special_chars, BASE.sql_keywords, BASE.xss_keywords)
    assert got.to_pylist() == [plain(t.decode(errors="replace")) for t in raw[1:]]


def test_counted_features_equal_the_expressions(spark):
    """Bit by bit; and their plan counts once, not once per distinct character."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, *texts()])], "k int, t string")
    for dialect in ("base", "extended"):
        a, b = add_payload_features(df, "t", dialect), add_payload_features(df, "t", dialect, counted=True)
        assert a.columns == b.columns
        assert sorted(a.collect(), key=lambda r: r["k"]) == sorted(b.collect(), key=lambda r: r["k"])
    plan = add_payload_features(df, "t", counted=True).select("k", *FEATURE_COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "replace(" not in plan and "regexp_count" not in plan


def test_corpus_counts_characters_once(spark):
    plan = scored_corpus(spark, SF001, counted=True)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "replace(" not in plan
