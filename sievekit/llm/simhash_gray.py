"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints of 64 bits come from the XXH64 values of word shingles. Two
fingerprints within ``distance`` bits agree on at least one of
``distance + 1`` blocks, so each distinct fingerprint is dealt once per block
under that block's value. Inside a task the fingerprints of each value are
sorted by Gray rank, in which neighbours differ in few bits, and a tree is
built over runs of ``FAN``: a node's mask and pattern hold the bits that all
its fingerprints share. The index is joined with itself from the roots down.
A pair of nodes carries the differences among the bits both share; a child
pair adds only the bits that become shared there, and a pair beyond the
distance is dropped with everything below it. A pair whose unshared bits
can't exceed the distance any more is accepted whole, and a pair whose
fingerprints are already in one group is skipped, so dense groups aren't
enumerated. Tasks return one link per fingerprint to its local group.

A block value that holds more than ``HOT_ROWS`` distinct fingerprints is
split by the blocks of the remaining bits in the same way (pairs within the
distance also agree on one of those). Where such a part still holds more, as in
a large family around one centre, its fingerprints are dealt into runs by hash
and every two runs meet under a key of their own, about ``HOT_ROWS``
fingerprints together; the number of tasks grows with these rows. So a common
value isn't one task's load.

Edge cases: null, empty and word-less texts have fingerprint zero and are
linked like any other. Equal rows get equal results. A text of any length is
fingerprinted whole, in one row's memory. A null ``doc_id`` is
never a component's name unless no row of the component has another. Extra
columns are ignored by ``near_groups`` and kept by ``keep_one``. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm.common import cut, fresh, ship
from sievekit.llm.components import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
FAN = 8
HOT_ROWS = 400_000
_CHUNK = 100_000  # node pairs looked at together


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        h = np.array([digest(joined, SEED)], dtype=np.uint64)
    else:
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 8192):
        ones += np.unpackbits(h[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(h)))


def with_fingerprint(docs: DataFrame, text: str = "text", column: str = "__fp", shingle: int = SHINGLE) -> DataFrame:
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(column, run(F.col(f"`{text}`")))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchical index over fingerprints that are sorted by group and Gray
    rank. Level 0 holds single fingerprints, the last one a root per group."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.levels: list[dict[str, np.ndarray]] = []
        n = len(fp)
        node = {"group": group, "all": fp, "any": fp, "first": np.arange(n), "size": np.ones(n, np.int64), "child": None, "children": None}
        while True:
            node["mask"] = ~(node["all"] ^ node["any"])
            self.levels.append(node)
            g = node["group"]
            begins = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            counts = np.diff(np.r_[begins, len(g)])
            if counts.max(initial=0) <= 1:
                return
            nth = np.arange(len(g)) - np.repeat(begins, counts)
            cut_at = np.flatnonzero(nth % FAN == 0)
            node = {
                "group": g[cut_at],
                "all": np.bitwise_and.reduceat(node["all"], cut_at),
                "any": np.bitwise_or.reduceat(node["any"], cut_at),
                "first": node["first"][cut_at],
                "size": np.add.reduceat(node["size"], cut_at),
                "child": cut_at,
                "children": np.diff(np.r_[cut_at, len(g)]),
            }

    def links(self, distance: int) -> np.ndarray:
        """Per fingerprint the index of its local group's first member."""
        n = len(self.levels[0]["all"])
        label = np.arange(n)
        top = len(self.levels) - 1
        roots = np.flatnonzero(self.levels[top]["size"] > 1)
        zero = np.zeros(len(roots), np.int64)
        stack = [(top, roots, roots, zero, np.zeros(len(roots), np.uint64))]
        while stack:
            level, a, b, acc, shared = stack.pop()
            if len(a) > _CHUNK:
                stack.append((level, a[_CHUNK:], b[_CHUNK:], acc[_CHUNK:], shared[_CHUNK:]))
                a, b, acc, shared = a[:_CHUNK], b[:_CHUNK], acc[:_CHUNK], shared[:_CHUNK]
            nodes = self.levels[level]
            both = nodes["mask"][a] & nodes["mask"][b]
            acc = acc + np.bitwise_count((nodes["all"][a] ^ nodes["all"][b]) & both & ~shared)
            near = acc <= distance
            if level:  # skip what one group holds already
                low = np.minimum.reduceat(label, nodes["first"])
                high = np.maximum.reduceat(label, nodes["first"])
                near &= ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            else:
                near &= label[a] != label[b]
            a, b, acc, both = a[near], b[near], acc[near], both[near]
            whole = acc + 64 - np.bitwise_count(both).astype(np.int64) <= distance
            if whole.any():
                label = self._join(label, level, a[whole], b[whole])
            a, b, acc, both = a[~whole], b[~whole], acc[~whole], both[~whole]
            if not level or not len(a):
                continue
            same = a == b
            for pick in (~same, same):  # pairs of one node with itself come first: they are pushed last
                if pick.any():
                    stack.append((level - 1, *self._open(nodes, a[pick], b[pick], acc[pick], both[pick])))
        return label

    @staticmethod
    def _open(nodes, a, b, acc, both):
        ca, cb = nodes["children"][a], nodes["children"][b]
        total = ca * cb
        pair = np.repeat(np.arange(len(a)), total)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(total) - total, total)
        x = nodes["child"][a][pair] + nth // cb[pair]
        y = nodes["child"][b][pair] + nth % cb[pair]
        keep = (a[pair] != b[pair]) | (x <= y)
        pair, x, y = pair[keep], x[keep], y[keep]
        return x, y, acc[pair], both[pair]

    def _join(self, label, level, a, b):
        """Put all members of each accepted node pair into one group."""
        nodes = self.levels[level]
        if level == 0:
            u, v = a, b
        else:
            us, vs = [], []
            for n in (a, b):
                size = nodes["size"][n]
                member = np.repeat(nodes["first"][n], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                us.append(member)
                vs.append(np.repeat(nodes["first"][a], size))
            u, v = np.concatenate(us), np.concatenate(vs)
        while True:
            x, y = label[u], label[v]
            if (x == y).all():
                return label
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:  # every label points at its group's first member
                up = label[label]
                if (up == label).all():
                    break
                label = up


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    """``bits`` cut into ``parts`` runs of nearly equal size."""
    edges = [len(bits) * k // parts for k in range(parts + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:])]


def _value(fp: Column, bits: list[int]) -> Column:
    """The bits of a run (adjacent, or in two stretches) as a number."""
    out, shift, k = F.lit(0).cast("long"), 0, 0
    while k < len(bits):
        j = k
        while j + 1 < len(bits) and bits[j + 1] == bits[j] + 1:
            j += 1
        width = j - k + 1
        part = F.shiftrightunsigned(fp, bits[k]).bitwiseAND(F.lit((1 << width) - 1))
        out = out + F.shiftleft(part, shift)
        shift, k = shift + width, j + 1
    return out


def run_pairs(keyed: DataFrame, hot_rows: int) -> tuple[DataFrame, int]:
    """Cut the groups of ``keyed`` (``fp``, ``key``) that hold more than
    ``hot_rows`` rows: they are dealt into runs of half that size, and each
    row goes to the pairs of its run with every other one, so any two rows
    still meet. Returns the new keys and how many rows the pairs have."""
    large = cut(keyed.groupBy("key").count().where(F.col("count") > hot_rows).select("key", F.ceil(2 * F.col("count") / hot_rows).alias("runs"), "count"))
    rows = large.agg(F.sum(F.col("count") * (F.col("runs") - 1))).first()[0]
    if rows is None:
        return keyed, 0
    run = F.pmod(F.xxhash64(F.lit("run"), "fp"), F.col("runs"))  # at least three runs, so each run meets another
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1), lambda k: k != F.col("run"))
    pair = F.transform(others, lambda k: F.xxhash64("key", F.least(k, F.col("run")), F.greatest(k, F.col("run"))))
    dealt = keyed.join(F.broadcast(large), "key", "left").withColumn("run", run)
    return dealt.select("fp", F.explode(F.when(F.col("runs").isNull(), F.array("key")).otherwise(pair)).alias("key")), rows


def links(fps: DataFrame, distance: int = DISTANCE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links ``a``-``b`` that connect all of the distinct fingerprints in
    column ``fp`` that lie within ``distance`` bits of each other."""
    spark = fps.sparkSession
    ship(spark)
    blocks = _blocks(list(range(64)), distance + 1)
    fp = F.col("fp")
    dealt = fps.select(fp, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _value(fp, bits).alias("v")) for i, bits in enumerate(blocks)])).alias("k")).select("fp", "k.i", "k.v")
    # at most (distance + 1) * 2**13 block values exist, whatever the input
    large = dealt.groupBy("i", "v").count().where(F.col("count") > hot_rows).collect()
    hot = [(r["i"], r["v"]) for r in large]
    rows = len(blocks) * (fps.count() + sum(r["count"] for r in large))
    key = F.xxhash64("i", "v")
    keyed, paired = dealt, 0
    if hot:
        is_hot = F.concat_ws(":", "i", "v").isin([f"{i}:{v}" for i, v in hot])
        parts = []
        for i in sorted({i for i, _ in hot}):
            rest = [b for b in range(64) if b not in blocks[i]]
            sub = F.array(*[F.xxhash64(F.lit(i), F.col("v"), F.lit(j), _value(fp, bits)) for j, bits in enumerate(_blocks(rest, distance + 1))])
            parts.append(keyed.where(is_hot & (F.col("i") == i)).select("fp", F.explode(sub).alias("key")))
        split = parts[0]
        for p in parts[1:]:
            split = split.unionByName(p)
        split, paired = run_pairs(split, hot_rows)
        keyed = keyed.where(~is_hot).select("fp", key.alias("key")).unionByName(split)
    else:
        keyed = keyed.select("fp", key.alias("key"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-(rows + paired) // hot_rows))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        fp = np.concatenate([g[0] for g in got]).view(np.uint64)
        group = np.concatenate([g[1] for g in got])
        order = np.lexsort((gray_rank(fp), group))
        fp, group = fp[order], group[order]
        label = GrayIndex(group, fp).links(distance)
        linked = np.flatnonzero(label != np.arange(len(label)))
        a, b = fp[linked].view(np.int64), fp[label[linked]].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return keyed.repartition(n, "key").mapInArrow(join, "a long, b long")


def fp_components(fps: DataFrame, distance: int = DISTANCE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``fp`` (distinct) and ``root``: one fingerprint per component."""
    roots = components(links(fps.select("fp"), distance, hot_rows))
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id`` per document."""
    rows = cut(with_fingerprint(docs.select(docs[f"`{key}`"].alias("doc_id"), docs[f"`{text}`"].alias("text")), "text", "fp", shingle).select("doc_id", "fp"))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    of = cut(fp_components(fps, distance, hot_rows))
    names = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.select("fp", "root").join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The input's columns, one row of each component: that of the smallest
    id (null ids last), then the smallest row hash. Of equal rows one stays."""
    names = docs.columns
    h = fresh(names, "__row")
    cols = [F.col(f"`{c}`") for c in names]
    tagged = docs.withColumn(h, F.struct(F.xxhash64(*cols), F.hash(*cols)))
    rows = cut(with_fingerprint(tagged.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(h).alias("row")), "text", "fp", shingle).select("doc_id", "row", "fp"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row"))
    fps = cut(rows.groupBy("fp").agg(best.alias("best")))
    of = fp_components(fps, distance)
    winners = of.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(h)).distinct()
    once = Window.partitionBy(h).orderBy(F.lit(0))
    n = fresh(names, "__nth")
    return tagged.join(winners, h).withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).select(*cols)
