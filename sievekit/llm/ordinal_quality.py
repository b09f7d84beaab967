"""Document quality by ordinal regression on graded ratings.

A cumulative-link model: one weight vector ``w`` over hashed text features is
shared by all grades, and ordered thresholds cut its score, so
``P(grade <= k) = sigmoid(theta_k - w.x)``. It yields the expected grade and
the tail probability ``P(grade >= top)``, by which documents are selected.

Features are present or not: a text's words (ASCII lower case), their first
five bytes, and their last two, hashed to ``2**BITS`` buckets. Training runs on
at most ``SAMPLE_PER_GRADE`` labelled documents per grade (smallest hash of the
id) with adaptive steps and an L1 pull to zero, so words that say nothing get no
weight; the spacing of thresholds is a logarithm, so they stay ordered.

Edge cases: a null or empty text has no features and gets the model's
intercept. Null labels aren't learned from; a document with several ratings
takes the lowest. Grades that don't occur are skipped; with fewer than two
grades there is no model, and everything has grade 0 and is kept. Equal texts
get equal results. Of rows that share a key one is learned from. A text of any
length is hashed whole, a few megabytes of texts at a time. Ties in the order
of the sample go by grade and size. All columns stay; own columns whose name is
taken get a numbered one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.blocks import Rolling, mix
from sievekit.llm.common import ASCII_SPACE, fresh, ship

BITS = 18
SAMPLE_PER_GRADE = 3_000
STEPS, BATCH, RATE, L1 = 2_500, 32, 0.3, 1e-4
_SPACE = np.zeros(256, bool)
_SPACE[list(ASCII_SPACE)] = True
_TABLE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]  # ASCII letters without case
_WORD = Rolling(0x9E3779B97F4A7C15)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of all texts, and where each text's buckets begin
    (one more entry than texts)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[raw]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    size = np.flatnonzero(space & ~np.r_[True, space[:-1]]) - start
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right").astype(np.uint64)
    values = _TABLE[raw]
    head, tail = np.minimum(size, 5), np.minimum(size, 2)
    kinds = [_WORD.ranges(values, start, size), _WORD.ranges(values, start, head), _WORD.ranges(values, start + size - tail, tail)]
    bucket = [mix(h + np.uint64(k)) >> np.uint64(64 - BITS) for k, h in enumerate(kinds)]
    key = np.unique(np.concatenate([doc << np.uint64(BITS) | b for b in bucket]))
    at = np.searchsorted(key >> np.uint64(BITS), np.arange(len(texts) + 1, dtype=np.uint64))
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), at


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class CumulativeLink:
    """Weights, and thresholds as a first value and logarithms of gaps."""

    def __init__(self, grades: list[int]):
        self.grades = grades
        self.w = np.zeros(1 << BITS)
        self.cut = np.r_[-1.0, np.zeros(len(grades) - 2)]

    @property
    def theta(self) -> np.ndarray:
        return np.cumsum(np.r_[self.cut[0], np.exp(self.cut[1:])])

    def fit(self, rows: list[np.ndarray], y: np.ndarray, steps: int = STEPS, seed: int = 5) -> list[float]:
        rng = np.random.default_rng(seed)
        seen, seen_cut, losses = np.full(len(self.w), 1e-6), np.full(len(self.cut), 1e-6), []
        for _ in range(-(-steps * BATCH // len(rows))):
            total = 0.0
            order = rng.permutation(len(rows))
            for k in range(0, len(order), BATCH):
                pick = order[k : k + BATCH]
                sizes = np.array([len(rows[i]) for i in pick])
                index = np.concatenate([rows[i] for i in pick]).astype(np.int64)
                of = np.repeat(np.arange(len(pick)), sizes)
                s = np.bincount(of, weights=self.w[index], minlength=len(pick))
                edges = np.r_[-np.inf, self.theta, np.inf]
                upper, lower = edges[y[pick] + 1], edges[y[pick]]
                fa = np.where(np.isinf(upper), 1.0, _sigmoid(np.where(np.isinf(upper), 0, upper) - s))
                fb = np.where(np.isinf(lower), 0.0, _sigmoid(np.where(np.isinf(lower), 0, lower) - s))
                p = np.maximum(fa - fb, 1e-9)
                total -= float(np.log(p).sum())
                grad = np.bincount(index, weights=(1 - fa - fb)[of], minlength=len(self.w)) / len(pick)
                touched = np.unique(index)
                g = grad[touched]
                seen[touched] += g * g
                step = RATE / np.sqrt(seen[touched])
                w = self.w[touched] - step * g
                self.w[touched] = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
                by_theta = np.bincount(y[pick], weights=-fa * (1 - fa) / p, minlength=len(self.grades))[:-1]
                by_theta = by_theta + np.bincount(y[pick], weights=fb * (1 - fb) / p, minlength=len(self.grades))[1:]
                by_cut = np.cumsum(by_theta[::-1])[::-1] / len(pick)
                by_cut[1:] *= np.exp(self.cut[1:])
                seen_cut += by_cut * by_cut
                self.cut = np.clip(self.cut - RATE * by_cut / np.sqrt(seen_cut), -20, 3)
            losses.append(total / len(rows))
        return losses

    def tails(self, score: np.ndarray) -> np.ndarray:
        """(rows, grades - 1): the probability of a grade above each
        threshold."""
        return 1 - _sigmoid(self.theta[None, :] - score[:, None])


def grade_column(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Grade of a rating: 0 toxic, 1 poor, 2 good; null if either is null."""
    q, t = F.col(f"`{quality}`"), F.col(f"`{toxic}`")
    return F.when(q.isNull() | t.isNull(), None).when(t > 0, 0).when(q > 0, 2).otherwise(1)


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, key: str = "doc_id", text: str = "text", per_grade: int = SAMPLE_PER_GRADE) -> CumulativeLink | None:
    """Train on at most ``per_grade`` documents of each grade."""
    ship(docs.sparkSession)
    graded = ratings.select(F.col(f"`{key}`").alias("k"), grade.cast("int").alias("grade")).where("k IS NOT NULL AND grade IS NOT NULL").groupBy("k").agg(F.min("grade").alias("grade"))
    counts = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}
    if len(counts) < 2:
        return None
    rank = F.pmod(F.xxhash64(F.lit("ordinal"), "k"), F.lit(1 << 40))
    limit = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1 << 40, int(1.3 * per_grade / n * (1 << 40)) + 1))])
    # bounded whatever the input: the broadcast spares a shuffle of all texts
    chosen = graded.withColumn("rank", rank).where(F.col("rank") < limit[F.col("grade")])
    chosen = chosen.orderBy("rank", "k").limit(2 * per_grade * len(counts))

    @F.pandas_udf("binary")
    def buckets(texts: pd.Series) -> pd.Series:
        return pd.Series([features([(t or "").encode()])[0].astype("<i4").tobytes() for t in texts])

    # one row a key (the text of the smallest hash), so rows that share a key stay within the bound
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "grade", "rank", "x")).alias("r")
    rows = (
        docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text"))
        .join(F.broadcast(chosen), "k")
        .withColumn("x", buckets("text"))
        .groupBy("k")
        .agg(one)
        .select("r.grade", "r.rank", "r.x")
        .toPandas()
    )
    rows["n"] = rows["x"].map(len)
    rows = rows.sort_values(["grade", "rank", "n"], kind="stable").groupby("grade").head(per_grade)
    grades = sorted(int(g) for g in rows["grade"].unique())
    if len(grades) < 2:
        return None
    model = CumulativeLink(grades)
    model.fit([np.frombuffer(bytes(x), "<i4") for x in rows["x"]], rows["grade"].map({g: i for i, g in enumerate(grades)}).to_numpy())
    return model


def score(docs: DataFrame, model: CumulativeLink | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """All columns, ``expected_grade``, ``p_top`` (the probability of the
    highest grade) and ``kept`` (``p_top`` is at least ``least``)."""
    ship(docs.sparkSession)
    s = fresh(docs.columns, "__score")

    @F.pandas_udf("struct<grade:double,top:double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            raws = [(t or "").encode() for t in texts]
            grade, top, at = [], [], 0
            while at < len(raws):  # a few megabytes of text at a time
                stop, size = at, 0
                while stop < len(raws) and (stop == at or size + len(raws[stop]) <= 2_000_000):
                    size += len(raws[stop])
                    stop += 1
                if model is None:
                    grade += [0.0] * (stop - at)
                    top += [1.0] * (stop - at)
                else:
                    index, begin = features(raws[at:stop])
                    sums = np.r_[0.0, np.cumsum(model.w[index])]
                    tails = model.tails(sums[begin[1:]] - sums[begin[:-1]])
                    grade += (model.grades[0] + tails @ np.diff(model.grades)).tolist()
                    top += tails[:, -1].tolist()
                at = stop
            yield pd.DataFrame({"grade": grade, "top": top})

    names = docs.columns
    return docs.withColumn(s, run(F.col(f"`{text}`"))).select(
        *[F.col(f"`{c}`") for c in names],
        F.col(f"`{s}`.grade").alias(fresh(names, "expected_grade")),
        F.col(f"`{s}`.top").alias(fresh(names, "p_top")),
        (F.col(f"`{s}`.top") >= least).alias(fresh(names, "kept")),
    )
