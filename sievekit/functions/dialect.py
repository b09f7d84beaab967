"""Feature dialects: the character sets and keyword lists behind the
lexical payload features.

Two dialects exist because the original project computes the features in
two slightly different ways: ``base`` (the batch/CLI extractor) and
``extended`` (the demo extractor). A dialect is plain data; every feature
function takes one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Fixed values. These must equal the original extractor's lists character
# for character, otherwise the features (and every model trained on them)
# differ. Natural order, as published.
# ---------------------------------------------------------------------------
BASE_SPECIAL_CHARS = "<>\"'()"
BASE_SQL_KEYWORDS = ("select", "union", "insert", "drop", "delete", "update", "from", "where", "--", "/*")
BASE_XSS_KEYWORDS = ("<script", "alert(", "onerror", "onload", "javascript:", "eval(", "<svg", "<img")

EXTENDED_SPECIAL_CHARS = "<>\"'()=;-%"
EXTENDED_SQL_KEYWORDS = ("select", "union", "insert", "drop", "--", "or 1=1", "' or '", "sleep(", "waitfor")
EXTENDED_XSS_KEYWORDS = ("<script", "onerror", "onload", "javascript:", "<img", "<svg", "onmouseover", "%3cscript")

# notebook's quick three-feature vector counts these characters
QUICK_SPECIAL_CHARS = "<>\"\\()"

# the smoothing term of the base entropy formula (-sum p*log2(p + eps))
BASE_ENTROPY_EPSILON = 1e-12
# ---------------------------------------------------------------------------

FEATURE_COLUMNS = (
    "payload_len", "payload_entropy", "special_char_cnt",
    "digit_ratio", "upper_ratio", "kw_sql", "kw_xss",
)


@dataclass(frozen=True)
class FeatureDialect:
    """Parameters of the seven lexical features.

    unicode_classes: count digits / upper-case letters with Unicode classes
    (Python ``isdigit``/``isupper`` semantics) instead of ASCII ``[0-9]`` /
    ``[A-Z]``.
    entropy_epsilon: 0 gives exact Shannon entropy; the base extractor adds
    1e-12 inside the log, a difference far below 6 decimal places.
    """

    name: str
    special_chars: str
    sql_keywords: tuple[str, ...]
    xss_keywords: tuple[str, ...]
    unicode_classes: bool = False
    entropy_epsilon: float = 0.0

    def with_(self, **changes) -> "FeatureDialect":
        return replace(self, **changes)


BASE = FeatureDialect("base", BASE_SPECIAL_CHARS, BASE_SQL_KEYWORDS, BASE_XSS_KEYWORDS, unicode_classes=False)
EXTENDED = FeatureDialect("extended", EXTENDED_SPECIAL_CHARS, EXTENDED_SQL_KEYWORDS, EXTENDED_XSS_KEYWORDS,
                          unicode_classes=True)

DIALECTS = {"base": BASE, "extended": EXTENDED}


def get_dialect(d: "str | FeatureDialect") -> FeatureDialect:
    if isinstance(d, FeatureDialect):
        return d
    try:
        return DIALECTS[d]
    except KeyError:
        raise ValueError(f"Unknown dialect '{d}'. Choose from {sorted(DIALECTS)}") from None
