"""Document fingerprints as Merkle trees over paragraphs and sections.

Levels: document, sections, paragraphs, sentences. A paragraph is a line; a
section ends at a blank line or after a paragraph whose own digest says so
(one in ``SECTION_EVERY`` on average), so an insertion moves no later border.
Sentences under a paragraph end after ``. ! ? |`` or after
``SENTENCE_WORDS`` words. A leaf hashes its text; an inner node hashes its
children's digests and their number of characters.

The root's digest is the document's fingerprint and tests equality; ``write``
gives the whole tree as text and ``read`` takes it back. ``likeness`` walks
two trees from the root: children with equal digests match whole, the rest is
opened one level down and matched again; the result is the share of
characters in matched nodes. ``edited_branches`` gives the spans of the
branches that differ.

Next documents: rows are range-partitioned by descending ``doc_id`` and sorted
once, a streaming pass pairs each row with the following one, and the rows at
partition borders (two per partition) are paired in a second small job. The
text is shuffled once and no partition depends on the number of documents.

Edge cases: a null text is the empty text, whose tree is a root without
children (two of them have likeness 1, an empty and another text 0). Rows of
equal ``doc_id`` are ordered by text; null ids come last. A single row is its
own next document. A text of any length is split whole, in one row's memory.
Extra columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.llm.common import cut, ship, slices_by_bytes

SECTION_EVERY = 4
SENTENCE_WORDS = 8
_DIGEST = 8  # bytes of an inner digest; the root has twice as many
_SENTENCE = re.compile(r"(?:\S+\s+){0,%d}?\S*[.!?|]+\s*|(?:\S+\s*){1,%d}|\s+" % (SENTENCE_WORDS - 1, SENTENCE_WORDS))


_LINE = re.compile(r"[^\n]*\n|[^\n]+")


def _hash(data: bytes, size: int = _DIGEST) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


class Node:
    __slots__ = ("digest", "length", "children")

    def __init__(self, digest: str, length: int, children: list[Node]):
        self.digest, self.length, self.children = digest, length, children


def _leaf(text: str) -> Node:
    return Node(_hash(text.encode("utf-8", "surrogatepass")), len(text), [])


def _inner(kind: str, children: list[Node], size: int = _DIGEST) -> Node:
    names = kind + ";".join(f"{c.digest}:{c.length}" for c in children)
    return Node(_hash(names.encode(), size), sum(c.length for c in children), children)


def tree(text: str) -> Node:
    """The Merkle tree of a text; its leaves' texts join to the text."""
    sections: list[Node] = []
    here: list[Node] = []
    for line in _LINE.findall(text):
        if here and not line.strip():
            here.append(_inner("p", [_leaf(line)]))
            sections.append(_inner("s", here))
            here = []
            continue
        here.append(_inner("p", [_leaf(s) for s in _SENTENCE.findall(line)]))
        if int(here[-1].digest[:4], 16) % SECTION_EVERY == 0:
            sections.append(_inner("s", here))
            here = []
    if here:
        sections.append(_inner("s", here))
    return _inner("d", sections, 2 * _DIGEST)


def write(node: Node) -> str:
    """The tree as text; ``read`` gives it back."""
    inner = "".join(write(c) for c in node.children)
    return f"{node.digest}:{node.length}" + (f"({inner})" if inner else "") + ","


def read(fingerprint: str) -> Node:
    stack: list[list[Node]] = [[]]
    for digest, length, mark in re.findall(r"([0-9a-f]+):(\d+)([(,])|\),", fingerprint):
        if not digest:
            stack.pop()
            continue
        node = Node(digest, int(length), [])
        stack[-1].append(node)
        if mark == "(":
            stack.append(node.children)
    return stack[0][0]


def likeness(a: Node, b: Node) -> float:
    """Share of both texts' characters in matching nodes, 0 to 1."""
    if a.digest == b.digest:
        return 1.0
    if not a.length or not b.length:
        return 0.0
    matched, left, right = 0, [a], [b]
    while left and right:
        there = Counter(n.digest for n in right)
        left_open, taken = [], Counter()
        for n in left:
            if there[n.digest] > taken[n.digest]:
                taken[n.digest] += 1
                matched += n.length
            else:
                left_open += n.children
        right_open = []
        for n in right:
            if taken[n.digest]:
                taken[n.digest] -= 1
            else:
                right_open += n.children
        left, right = left_open, right_open
    return 2 * matched / (a.length + b.length)


def edited_branches(a: Node, b: Node) -> list[tuple[int, int]]:
    """Character spans ``(start, length)`` of ``b`` whose nodes ``a`` lacks,
    found by walking from the root; equal branches aren't opened."""
    known: set[str] = set()
    level = [a]
    while level:
        known.update(n.digest for n in level)
        level = [c for n in level for c in n.children]
    out: list[tuple[int, int]] = []

    def walk(n: Node, start: int) -> None:
        if n.digest in known:
            return
        if not n.children:
            out.append((start, n.length))
        for c in n.children:
            walk(c, start)
            start += c.length

    walk(b, 0)
    return out


def edited(text: str, following: str) -> str:
    """The last half replaced by as much of the following text's begin."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType()),
    T.StructField("edit_start", T.LongType()),
    T.StructField("edit_end", T.LongType()),
])
_VALUES = len(_ROW.fields) - 1
#: the streaming pass also returns each partition's first and last document
_PASS = T.StructType([*_ROW.fields, T.StructField("part", T.LongType()), T.StructField("edge", T.StringType()), T.StructField("text", T.StringType())])
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("edit_start", pa.int64()), ("edit_end", pa.int64()), ("part", pa.int64()), ("edge", pa.string()), ("text", pa.string()),
])


def _compare(doc_id, text: str, own: Node, following: str, after: Node) -> tuple:
    new = edited(text, following)
    other = tree(new)
    spans = edited_branches(own, other)
    where = (spans[0][0], sum(spans[-1])) if spans else (None, None)
    return (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own.digest, other.digest, likeness(own, other), likeness(own, after), *where)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: tuple | None = None
    for batch in slices_by_bytes(batches, "text", 4_000_000):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            here = (doc_id, text, tree(text))
            if held is None:
                rows.append((doc_id, *[None] * _VALUES, part, "first", text))
            else:
                rows.append((*_compare(*held, text, here[2]), part, None, None))
            held = here
        if rows:
            yield _batch(rows)
    if held is not None:
        yield _batch([(held[0], *[None] * _VALUES, part, "last", held[1])])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(list(_ARROW)[: _VALUES + 1])
    for batch in batches:
        for doc_id, text, following in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            row = _compare(doc_id, text, tree(text), following, tree(following))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, the likeness of
    its tree to the edited text's and to the next document's, and the first
    and last character of the branches in which the edited text differs
    (null if it doesn't)."""
    ship(docs.sparkSession)
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    dealt = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    passed = cut(dealt.mapInArrow(_stream, _PASS))
    # two rows per partition: pair each partition's last document with the first of the next one
    borders = passed.filter(F.col("edge").isNotNull())
    firsts = borders.filter("edge = 'first'").select("part")
    following = firsts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    heads = borders.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    tails = borders.filter("edge = 'last'").select("doc_id", "text", "part")
    closing = tails.join(following, "part").join(heads, "next_part").select("doc_id", "text", "following")
    return passed.filter(F.col("edge").isNull()).select(*_ROW.names).unionByName(closing.mapInArrow(_close, _ROW))
