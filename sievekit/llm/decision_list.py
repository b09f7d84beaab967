"""Quality rules as a learned decision list.

Statistics per document (whole text, words are runs of
``[^\\x20\\x09-\\x0D]``): ``n_words``, ``word_chars``, ``n_symbols``,
``n_dup_lines``, ``n_repeat_words``. Rules test thresholds on these counts and
on their ratios.

Learning is sequential covering on a bounded sample of labelled rows: two
thirds grow a rule for the bad class, adding at each step the threshold test
with the largest information gain; one third prunes it, dropping final tests
while that does not lower the rule's worth ``(bad - good) / covered``. A rule
that is precise enough on both parts joins the list, the rows it covers
leave, and the next rule is grown on the rest. The list is emitted as ordered
Spark conditional expressions, readable with ``describe``.

Edge cases: a null or empty text has no words and fails the base rule. A
label without a document, a document without label, null labels and equal
rows are fine: a document with several labels counts as bad if any says so.
Without labels the list is empty and only the base rule decides. Rows of
equal ``doc_id`` are judged each on its own text. Input columns all stay; an
own column whose name is taken gets a numbered one. An empty table gives no
rows. A text of any length is counted whole, in one row's memory. Ties: of tests
with equal gain the first feature's first threshold is taken, of pruned rules
with equal worth the shorter one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import ASCII_SPACE, fresh, ship

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: ratios that rules may test: name -> (numerator, denominator)
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "symbols_per_char": ("n_symbols", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_lines_per_word": ("n_dup_lines", "n_words"),
}
FEATURES = (*STATS, *RATIOS)
#: the bound of the labelled sample that a list is learned from
SAMPLE_ROWS = 20_000
MAX_RULES, MAX_TESTS = 8, 4
#: a rule must be at least so precise on the pruning part, and cover so many bad rows
MIN_PRECISION, MIN_BAD = 0.9, 5
SYMBOLS = b"#*$%&|<>"


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, ASCII_SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    dup = len(lines) - len(set(lines))
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen: dict = {}
            for w in windows:
                seen[w] = seen.get(w, 0) + 1
            until = 0  # words before this index are counted
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 3 - max(i, until)
                    until = i + 3
    return n, len(text) - spaces, symbols, dup, repeated


def with_stats(docs: DataFrame, text: str = "text", column: str = "__stats") -> DataFrame:
    """Append a struct of the five counts."""
    ship(docs.sparkSession)

    @F.pandas_udf("struct<" + ",".join(f"{s}:long" for s in STATS) + ">")
    def stats(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_stats(t) for t in texts], columns=list(STATS), dtype="int64")

    return docs.withColumn(column, stats(F.col(f"`{text}`")))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self, stats: str) -> Column:
        x = feature_column(self.feature, stats)
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Test, ...]


def feature_column(name: str, stats: str) -> Column:
    """A feature as a Spark expression over the struct of counts."""
    if name in STATS:
        return F.col(f"`{stats}`.{name}").cast("double")
    a, b = (F.col(f"`{stats}`.{c}").cast("double") for c in RATIOS[name])
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def feature_table(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out = {s: np.asarray(counts[s], dtype=np.float64) for s in STATS}
    for name, (a, b) in RATIOS.items():
        out[name] = np.divide(out[a], out[b], out=np.zeros_like(out[a]), where=out[b] > 0)
    return out


def _covers(rule: Rule, table: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, (t.holds(table) for t in rule), rows)


def _best_test(table: dict[str, np.ndarray], rows: np.ndarray, bad: np.ndarray) -> tuple[float, Test | None]:
    """The threshold test with the largest information gain among ``rows``:
    bad rows kept times the rise of the log share of bad rows."""
    best, test = 0.0, None
    p0, n0 = int((rows & bad).sum()), int((rows & ~bad).sum())
    if not p0 or not n0:
        return 0.0, None
    before = math.log2(p0 / (p0 + n0))
    for f in FEATURES:
        x, y = table[f][rows], bad[rows]
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        ends = np.flatnonzero(x[:-1] < x[1:])  # a threshold lies between different values
        if not len(ends):
            continue
        low_bad = np.cumsum(y)[ends]
        low_all = ends + 1
        for above, p, total in ((False, low_bad, low_all), (True, p0 - low_bad, len(x) - low_all)):
            share = np.divide(p, total, out=np.zeros(len(p)), where=p > 0)
            gain = np.where(p > 0, p * (np.log2(np.maximum(share, 1e-12)) - before), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-9:
                best, test = float(gain[k]), Test(f, above, float((x[ends[k]] + x[ends[k] + 1]) / 2))
    return best, test


def learn(counts: dict[str, np.ndarray], bad: np.ndarray, order: np.ndarray) -> list[Rule]:
    """Sequential covering. ``order`` is a repeatable pseudo-random number
    per row; it parts growing from pruning rows."""
    table, rules = feature_table(counts), []
    bad = np.asarray(bad, dtype=bool)
    grow_part = np.asarray(order) % 3 != 0
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < MAX_RULES and (left & bad & grow_part).sum() >= MIN_BAD:
        rule: Rule = ()
        rows = left & grow_part
        while len(rule) < MAX_TESTS:
            gain, test = _best_test(table, rows, bad)
            if test is None:
                break
            rule += (test,)
            rows = rows & test.holds(table)
        if not rule:
            break
        hold_out = left & ~grow_part

        def worth(r: Rule, over: np.ndarray = hold_out) -> float:
            c = _covers(r, table, over)
            return (2.0 * (c & bad).sum() - c.sum()) / c.sum() if c.any() else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        both = _covers(rule, table, left)
        held = both & hold_out
        precise = min((both & bad).sum() / max(1, both.sum()), (held & bad).sum() / max(1, held.sum()))
        if (both & bad).sum() < MIN_BAD or precise < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~both
    return rules


def describe(rules: list[Rule]) -> str:
    return "\n".join(["if " + " and ".join(map(str, r)) + " then drop" for r in rules] + ["else keep"])


def verdict(rules: list[Rule], stats: str = "__stats") -> tuple[Column, Column]:
    """The list as ordered conditional expressions: whether a document is
    kept, and the number of the rule that decided (0: none fired)."""
    kept, fired = F.lit(True), F.lit(0)
    for k in range(len(rules), 0, -1):
        test = reduce(lambda a, b: a & b, (t.column(stats) for t in rules[k - 1]))
        kept = F.when(test, F.lit(False)).otherwise(kept)
        fired = F.when(test, F.lit(k)).otherwise(fired)
    return kept, fired


def base_failed(stats: str = "__stats") -> Column:
    n, repeated = F.col(f"`{stats}`.n_words"), F.col(f"`{stats}`.n_repeat_words")
    return (n < 50) | (100 * repeated > 50 * n)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn a list from at most ``sample_rows`` labelled documents, the ones
    with the smallest hash of their key; label 0 is bad. Of rows that share a
    key one is learned from, the one whose text has the smallest hash."""
    marked = (
        labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull())
        .groupBy(F.col(f"`{key}`").cast("string").alias("k"))
        .agg(F.min((F.col(f"`{label}`") > 0).cast("int")).alias("good"))
        .withColumn("order", F.pmod(F.xxhash64(F.lit("rules"), "k"), F.lit(1 << 40)))
        .orderBy("order", "k")
        .limit(sample_rows)
    )
    some = docs.select(docs[f"`{key}`"].cast("string").alias("k"), docs[f"`{text}`"].alias("text")).join(F.broadcast(marked), "k")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "good", "order", "s")).alias("r")
    rows = with_stats(some, "text", "s").groupBy("k").agg(one).select("r.good", "r.order", *[F.col(f"r.s.{c}").alias(c) for c in STATS]).toPandas()
    rows = rows.sort_values(["order", *STATS], kind="stable")
    return learn({c: rows[c].to_numpy() for c in STATS}, rows["good"].to_numpy() == 0, rows["order"].to_numpy())


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """All columns, the five counts, ``base_failed``, ``kept`` and the number
    of the rule that fired."""
    s = fresh(docs.columns, "__stats")
    kept, fired = verdict(rules, s)
    out = with_stats(docs, text, s).withColumns({"__base": base_failed(s)})
    names = docs.columns
    return out.select(
        *[F.col(f"`{c}`") for c in names],
        *[F.col(f"`{s}`.{c}").alias(fresh(names, c)) for c in STATS],
        F.col("__base").alias(fresh(names, "base_failed")),
        (~F.col("__base") & kept).alias(fresh(names, "kept")),
        fired.alias(fresh(names, "rule")),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the learned list and the base rule keep."""
    s = fresh(docs.columns, "__stats")
    kept, _ = verdict(fit(docs, labels), s)
    return with_stats(docs, "text", s).where(~base_failed(s) & kept).select(*[F.col(f"`{c}`") for c in docs.columns])
