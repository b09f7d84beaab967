"""DuckDB SQL fragments used by the oracle queries. They are written
independently of the Spark expressions (regexes and unnest instead of
translate and higher-order functions) so the oracle is a real cross-check."""

from __future__ import annotations

from ..functions.dialect import BASE, FeatureDialect


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re_class(chars: str) -> str:
    out = []
    for ch in chars:
        out.append("\\" + ch if ch in "\\]^-[" else ch)
    return _sq("[" + "".join(out) + "]")


def sql_count_chars(x: str, chars: str) -> str:
    return f"CAST(length({x}) - length(regexp_replace({x}, {_re_class(chars)}, '', 'g')) AS INTEGER)"


def sql_count_regex(x: str, cls: str) -> str:
    return f"CAST(length({x}) - length(regexp_replace({x}, {_sq(cls)}, '', 'g')) AS INTEGER)"


def sql_ratio(count_sql: str, x: str) -> str:
    return f"CAST({count_sql} AS DOUBLE) / CAST(greatest(length({x}), 1) AS DOUBLE)"


def sql_any(x: str, keywords) -> str:
    return "CAST((" + " OR ".join(f"contains(lower({x}), {_sq(k)})" for k in keywords) + ") AS INTEGER)"


def sql_entropy_rowwise(x: str) -> str:
    """Per-row entropy with a correlated list expression (used where a key is
    not at hand); the keyed oracle uses unnest + GROUP BY instead."""
    return (
        f"(CASE WHEN length({x}) = 0 THEN 0.0 ELSE "
        f"-list_sum(list_transform(list_distinct(string_split({x}, '')), lambda c: "
        f"((length({x}) - length(replace({x}, c, ''))) / length({x})) * "
        f"log2((length({x}) - length(replace({x}, c, ''))) / length({x})))) END)"
    )


def sql_features(x: str, d: FeatureDialect = BASE, entropy: str | None = None) -> dict[str, str]:
    """The seven features of payload SQL expression ``x`` (ASCII classes)."""
    return {
        "payload_len": f"CAST(length({x}) AS INTEGER)",
        "payload_entropy": entropy or sql_entropy_rowwise(x),
        "special_char_cnt": sql_count_chars(x, d.special_chars),
        "digit_ratio": sql_ratio(sql_count_regex(x, "[0-9]"), x),
        "upper_ratio": sql_ratio(sql_count_regex(x, "[A-Z]"), x),
        "kw_sql": sql_any(x, d.sql_keywords),
        "kw_xss": sql_any(x, d.xss_keywords),
    }


def sql_entropy_cte(table_sql: str, key: str, x: str, name: str = "ent") -> str:
    """CTE text ``name(k, payload_entropy)`` via unnest + two GROUP BYs.
    Texts without characters have no row: LEFT JOIN and coalesce to 0."""
    return f"""{name}_ch AS (
  SELECT {key} AS k, unnest(string_split({x}, '')) AS ch FROM {table_sql}
), {name}_cnt AS (
  SELECT k, ch, count(*) AS c FROM {name}_ch WHERE length(ch) > 0 GROUP BY k, ch
), {name} AS (
  SELECT k, -sum((c / n) * log2(c / n)) AS payload_entropy
  FROM (SELECT k, c, sum(c) OVER (PARTITION BY k) AS n FROM {name}_cnt) GROUP BY k
)"""
