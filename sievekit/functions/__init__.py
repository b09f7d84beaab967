from .dialect import BASE, EXTENDED, FEATURE_COLUMNS, FeatureDialect, get_dialect
from .text import (
    confidence_pct, contains_any, count_chars, digit_ratio, map_lookup, payload_feature_columns,
    payload_len, preview, shannon_entropy, strip_py, text_or_empty, upper_ratio,
)
