"""Merkle manifest of a dataset, checked by a recursive query that climbs.

``build`` makes every row of a table a leaf and stores the tree above the
leaves as a table of node rows: a node holds the digests of its up to ``FAN``
children (its *run*), its own place among its siblings and the key of its
parent. Rows of one language form a tree of their own, in ``doc_id`` order;
the languages' subroots, in byte order of the language, form the top tree.

``climb`` is one recursive common table expression of Spark SQL. It starts from
one claimed leaf digest a row, joins it with its parent's node row, puts out the
siblings found there and the parent's digest as it follows from the claim, and
goes on from that node's parent link until the root. So a claim that differs
from the leaf that was built (a tampered row) arrives at another root.

The work is spread by key everywhere: places come from one range partition of
the rows, a run has at most ``FAN`` digests, and a step of the climb moves one
short row a leaf. The proof's digests are put together once, after the climb,
instead of being dragged along in every step. Levels of the tree are cut with
checkpoints.

Edge cases: null fields are hashed as ``-``; rows without a language form the
first tree; a null ``doc_id`` sorts first; rows with one ``doc_id`` are ordered
by their leaf digest, and each is a leaf of its own; a single row is leaf,
subroot and root at once, and its proof is the digest of no siblings. Empty and
very long texts need no special care: a text is hashed where it is read and
doesn't travel. An empty table gives an empty result. Other columns of the
table aren't read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import cut, ship
from sievekit.operators.prefix import positions

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: a node's key is ``level * LEVEL + index``
LEVEL = 1 << 56
#: the tree of the languages' subroots
TOP = -1
#: languages are joined by broadcast up to so many (counted), by shuffle beyond
BROADCAST_LANGS = 10_000
#: stored node rows of a partition, about
NODE_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(**changed: Column) -> Column:
    """SHA-256 (binary) of the row's fields, each as byte count, ``:`` and
    value, or ``-`` if null. ``changed`` replaces fields by other columns."""
    parts = []
    for name in FIELDS:
        s = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hash(children: Column) -> Column:
    """Digest of concatenated digests, taken as lower-case hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(children)), 256))


def _link(tree: Column, level: int, index: Column, nodes: Column, trees: int) -> list[Column]:
    """(parent_tree, parent, slot) of node ``index`` of a level that has
    ``nodes`` nodes: the level above, or the top tree, or nothing."""
    inside, above = nodes > 1, (tree != TOP) & F.lit(trees > 1)
    return [F.when(inside, tree).when(above, F.lit(TOP)).cast("long").alias("parent_tree"),
            F.when(inside, F.lit((level + 1) * LEVEL) + F.shiftright(index, 3))
             .when(above, F.lit(LEVEL) + F.shiftright(tree, 3)).cast("long").alias("parent"),
            F.when(inside, index % FAN).when(above, tree % FAN).cast("int").alias("slot")]


def _levels(base: DataFrame, most: int, rows: int, trees: int) -> tuple[list[DataFrame], DataFrame]:
    """Node rows of every level above ``base`` (tree, index, digest, nodes;
    ``rows`` of them), and the last remaining node of each tree (tree, digest).
    A level has an eighth of the rows below it and as much fewer partitions."""
    stored, tops = [], base.where("nodes = 1").select("tree", "digest")
    level, cur = 0, base
    while most > 1:
        level, most, rows = level + 1, -(-most // FAN), rows // FAN + trees
        run = F.array_sort(F.collect_list(F.struct("index", "digest")))  # at most FAN
        cur = (cur.where("nodes > 1").groupBy("tree", F.shiftright("index", 3).alias("up")).agg(
            F.aggregate(run, F.unhex(F.lit("")), lambda a, x: F.concat(a, x["digest"])).alias("run"), F.first("nodes").alias("below"))
            .select("tree", F.col("up").alias("index"), "run", _hash(F.col("run")).alias("digest"),
                    F.shiftright(F.col("below") + FAN - 1, 3).alias("nodes")))
        cur = cut(cur.coalesce(rows // NODE_ROWS + 1))
        stored.append(cur.select("tree", (F.lit(level * LEVEL) + F.col("index")).alias("node"), "run",
                                 *_link(F.col("tree"), level, F.col("index"), F.col("nodes"), trees)))
        tops = tops.unionByName(cur.where("nodes = 1").select("tree", "digest"))
    return stored, tops


@dataclass
class Manifest:
    """``leaves``: one row a document with its place (tree, position), leaf
    digest, claimed digest and parent link. ``nodes``: the stored levels.
    ``subroots``: (tree, digest). ``root``: lower-case hex, None if empty."""

    leaves: DataFrame
    nodes: DataFrame | None
    subroots: DataFrame
    trees: int
    root: str | None


def build(docs: DataFrame, claim: Column | None = None) -> Manifest:
    """Build the manifest of ``docs``. ``claim`` is the leaf digest to be
    checked later (binary; the leaf's own if null or not given)."""
    ship(docs.sparkSession)
    digest = leaf_digest()
    fields = docs.select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), digest.alias("digest"),
                         (F.lit(None).cast("binary") if claim is None else claim).alias("claim"))
    placed = positions(fields, ["lang"], [F.asc_nulls_first("id"), F.asc("digest")])
    langs = cut(positions(placed.groupBy("lang").agg(F.count(F.lit(1)).alias("nodes")), [], [F.asc_nulls_first("lang")], "tree"))
    trees, most, rows = langs.agg(F.count(F.lit(1)), F.max("nodes"), F.sum("nodes")).first()
    small = langs.select(F.col("lang").alias("of"), "tree", "nodes")
    leaves = placed.join(F.broadcast(small) if trees <= BROADCAST_LANGS else small, F.col("lang").eqNullSafe(F.col("of"))).drop("of")
    base = leaves.select("tree", F.col("position").alias("index"), "digest", "nodes")
    stored, tops = _levels(base, most or 0, rows or 0, trees)
    tops = cut(tops.coalesce(trees // NODE_ROWS + 1))
    top = tops.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("index"), "digest", F.lit(trees).cast("long").alias("nodes"))
    more, last = _levels(top, trees, trees, trees)
    root = last.select(F.lower(F.hex("digest"))).first()  # one row
    nodes = None
    for part in stored + more:
        nodes = part if nodes is None else nodes.unionByName(part)
    leaves = leaves.select("id", "tree", "position", "digest", "claim",
                           *_link(F.col("tree"), 0, F.col("position"), F.col("nodes"), trees))
    return Manifest(leaves, nodes, tops, trees, root[0] if root else None)


_CLIMB = f"""
WITH RECURSIVE up(tree, position, id, leaf, at_tree, at_node, slot, step, digest, siblings) MAX RECURSION LEVEL 200 AS (
  SELECT tree, position, id, digest, parent_tree, parent, slot, 0, coalesce(claim, digest), CAST(X'' AS BINARY) FROM {{leaves}}
  UNION ALL
  SELECT tree, position, NULL, NULL, parent_tree, parent, next_slot, step + 1,
         unhex(sha2(lower(hex(concat(before, digest, after))), 256)), concat(before, after)
  FROM (SELECT up.tree, up.position, n.parent_tree, n.parent, n.slot AS next_slot, up.step, up.digest,
               substring(n.run, 1, 32 * up.slot) AS before, substring(n.run, 32 * up.slot + 33) AS after
        FROM up JOIN {{nodes}} n ON up.at_tree = n.tree AND up.at_node = n.node)
)
SELECT * FROM (SELECT * FROM up LIMIT ALL)
"""


def climb(found: Manifest) -> DataFrame:
    """Every claim's way to the root: one row a leaf and step (step 0 is the
    leaf itself) with the siblings met and the digest folded so far."""
    spark = found.leaves.sparkSession
    nodes = found.nodes
    if nodes is None:  # a single leaf has no node above it
        nodes = spark.createDataFrame([], "tree bigint, node bigint, run binary, parent_tree bigint, parent bigint, slot int")
    return spark.sql(_CLIMB, leaves=found.leaves, nodes=nodes)


def proofs(found: Manifest) -> DataFrame:
    """Per leaf: doc_id, tree, leaf, proof (hex digests of its siblings, level
    by level up to the root) and the root that follows from its claim."""
    steps = climb(found)
    parts = F.array_sort(F.collect_list(F.struct("step", "siblings")))  # one a level
    per = steps.groupBy("tree", "position").agg(F.max("id").alias("doc_id"), F.max("leaf").alias("leaf"), parts.alias("parts"),
                                                F.max_by("digest", "step").alias("folded"))
    return per.select("doc_id", "tree", F.lower(F.hex("leaf")).alias("leaf"),
                      F.array_join(F.transform("parts", lambda p: F.lower(F.hex(p["siblings"]))), "").alias("proof"),
                      F.lower(F.hex("folded")).alias("folded_root"))


def tampered() -> Column:
    """Leaf digest after tampering, null where the row stays as it is: rows
    whose ``crc32`` of the decimal ``doc_id`` 3 divides get their text's A-Z
    lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return F.when(hit, leaf_digest(text=F.translate(F.col("text"), UPPER, LOWER)))


def verify(docs: DataFrame, claim: Column | None = None) -> DataFrame:
    """Per document: leaf, subroot, root and the proof's digest as they were
    built, the root that follows from ``claim`` (``tampered()`` if not given)
    and whether that is the manifest's root."""
    found = build(docs, tampered() if claim is None else claim)
    root = F.lit(found.root).cast("string")
    subs = found.subroots.select(F.col("tree").alias("of"), F.lower(F.hex("digest")).alias("subroot"))
    got = proofs(found).join(F.broadcast(subs) if found.trees <= BROADCAST_LANGS else subs, F.col("tree") == F.col("of"))
    return got.select("doc_id", "leaf", "subroot", root.alias("root"), F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == root).alias("verified"))
