"""Removal of repeated word windows, with a count-min prefilter.

Pass 1: every block counts the hashes of its word windows in a count-min
sketch (``DEPTH`` rows, one cell per byte of corpus text and row), written
sparsely. The sketches are merged cell by cell in shards of the cell range,
and each block learns which of its own cells hold two or more: an
overestimate of window counts, so no repeated window is lost.

Pass 2: only windows estimated as repeated are grouped exactly, by 128 bits
of hash from two independent families over the word sequence, again in shards.
Every block gets back a bit per such window.

Pass 3: each word covered by a repeated window is removed.

What travels: about 1.5 bytes per window and row in pass 1, 16 bytes per
estimated window in pass 2, one bit per key on the way back, and twice the
compressed text. Shards and blocks have a fixed size, so their number grows
with the corpus. A window within a block counts once with its multiplicity,
so a window that is everywhere adds one entry per block.

Edge cases: words are runs of ``[^\\x20\\x09-\\x0D]``; a null or empty text has
none, and texts shorter than a window lose nothing. Equal rows are documents of
their own, whose windows repeat. All columns stay; own columns whose name is
taken get a numbered one. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.llm.blocks import Rolling, by_shard, mix, open_block, pack, shards_for, texts_of, to_blocks, total_bytes, unpack
from sievekit.llm.common import ASCII_SPACE, cut, fresh

WINDOW = 35
DEPTH = 2
#: text bytes behind one shard, also the cells of a merged shard of a sketch row
SHARD_BYTES = 16_777_216
_EXACT = -1
_NOTES = "block long, row int, shard int, bits binary"

_SPACE = np.zeros(256, bool)
_SPACE[list(ASCII_SPACE)] = True
_TABLE = np.random.default_rng(35).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES, _ONE, _TWO = Rolling(0x9E3779B97F4A7C15), Rolling(0xD1342543DE82EF95), Rolling(0xA0761D6478BD642F)
#: multipliers of the sketch rows
_ROWS = np.random.default_rng(36).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_keys(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts: their document; of all windows: the index
    of the first word and two 64-bit hashes of the word sequence."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[raw]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    end = np.flatnonzero(space & ~np.r_[True, space[:-1]])
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    doc = np.searchsorted(np.cumsum(sizes), start, side="right")
    none = np.zeros(0, np.uint64)
    if len(start) < window:
        return doc, np.zeros(0, np.int64), none, none
    words = _BYTES.ranges(_TABLE[raw], start, end - start)
    first = np.flatnonzero(doc[window - 1 :] == doc[: len(doc) - window + 1])
    one = mix(_ONE.ranges(mix(words), slice(None), window)[first])
    two = mix(_TWO.ranges(mix(words ^ np.uint64(0x5851F42D4C957F2D)), slice(None), window)[first])
    return doc, first, one, two


def cells(one: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each window hash in a sketch row of ``2**bits`` cells."""
    return (one * _ROWS[row]) >> np.uint64(64 - bits)


class _Block:
    """All windows of a block."""

    def __init__(self, data: bytes, text: str, window: int):
        self.batches = open_block(data)
        self.texts = [texts_of(b, text) for b in self.batches]
        found = [window_keys(t, window) for t in self.texts]
        self.docs, self.firsts = [f[0] for f in found], [f[1] for f in found]
        self.one = np.concatenate([f[2] for f in found])
        self.two = np.concatenate([f[3] for f in found])

    def estimated(self, notes: dict[tuple[int, int], bytes], bits: int, depth: int, n_shards: int) -> np.ndarray:
        """Windows whose smallest cell holds two or more."""
        est = np.ones(len(self.one), bool)
        for row in range(depth):
            cell, back = np.unique(cells(self.one, row, bits), return_inverse=True)
            hot = _flags(cell >> np.uint64(bits - n_shards.bit_length() + 1), notes, row, n_shards)
            est &= hot[back]
        return est


def _flags(shard: np.ndarray, notes: dict[tuple[int, int], bytes], row: int, n_shards: int) -> np.ndarray:
    """The bits that came back for sorted keys, shard after shard."""
    out = np.zeros(len(shard), bool)
    for k, s in enumerate(by_shard(shard, n_shards)):
        if s.stop > s.start and (row, k) in notes:
            out[s] = np.unpackbits(np.frombuffer(notes[row, k], np.uint8), count=s.stop - s.start).astype(bool)
    return out


def _notes_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("block", "row", "shard", "bits"), cols, kinds)})


def _exact_order(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (one, two) pairs in order, their counts, and each row's pair."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    return a[at], b[at], np.diff(np.r_[at, len(a)]), back


def flag_windows(blocks: DataFrame, text: str, window: int, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int, int]:
    """Per block the bits of its sketch cells and of its exact keys, and the
    sizes (bits of a sketch row, shards) they are read with."""
    size = max(total_bytes(blocks), 1)
    n_shards = shards_for(size, shard_bytes)
    bits = n_shards.bit_length() - 1 + max(shard_bytes.bit_length() - 1, 4)
    shard_bits = n_shards.bit_length() - 1

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = _Block(data, text, window)
                rows = []
                for row in range(depth):
                    cell, count = np.unique(cells(own.one, row, bits), return_counts=True)
                    many = count > 1
                    for k, s in enumerate(by_shard(cell >> np.uint64(bits - shard_bits), n_shards)):
                        if s.stop > s.start:
                            at = cell[s] & np.uint64((1 << (bits - shard_bits)) - 1)
                            rows.append((block, row, k, pack(np.diff(at, prepend=np.uint64(0)).astype(np.uint32), np.packbits(many[s]))))
                yield from _notes_table(rows).to_batches()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        counter = np.zeros(1 << (bits - shard_bits), np.uint8)
        ids, blobs = table.column("block").to_pylist(), table.column("bits")
        row, shard = (k.as_py() for k in key)

        def read(blob) -> tuple[np.ndarray, np.ndarray]:
            step, many = unpack(blob.as_py())
            return np.cumsum(step, dtype=np.int64), np.unpackbits(many, count=len(step))

        for blob in blobs:
            at, many = read(blob)
            counter[at] = np.minimum(counter[at] + 1 + many, 2)
        return _notes_table([(b, row, shard, np.packbits(counter[read(blob)[0]] > 1).tobytes()) for b, blob in zip(ids, blobs)])

    marks = cut(blocks.select("block", "data").mapInArrow(sketch, _NOTES).groupBy("row", "shard").applyInArrow(merge, _NOTES))

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for block, data in zip(left.column("block").to_pylist(), left.column("data").to_pylist()):
            own = _Block(data, text, window)
            est = own.estimated(_read_notes(right), bits, depth, n_shards)
            one, two, count, _ = _exact_order(own.one[est], own.two[est])
            for k, s in enumerate(by_shard(one >> np.uint64(64 - shard_bits) if shard_bits else np.zeros(len(one), np.uint64), n_shards)):
                if s.stop > s.start:
                    rows.append((block, _EXACT, k, pack(one[s], two[s], np.packbits(count[s] > 1))))
        return _notes_table(rows)

    def group(key: tuple, table: pa.Table) -> pa.Table:
        blobs = [unpack(b.as_py()) for b in table.column("bits")]
        sizes = np.array([len(b[0]) for b in blobs])
        one, two = np.concatenate([b[0] for b in blobs]), np.concatenate([b[1] for b in blobs])
        many = np.concatenate([np.unpackbits(b[2], count=n) for b, n in zip(blobs, sizes)])
        _, _, count, back = _exact_order(one, two)
        total = count + np.bincount(back, weights=many, minlength=len(count))
        hot = np.split(total[back] > 1, np.cumsum(sizes)[:-1])
        return _notes_table([(b, _EXACT, key[0].as_py(), np.packbits(h).tobytes()) for b, h in zip(table.column("block").to_pylist(), hot)])

    exact = blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(candidates, _NOTES).groupBy("shard").applyInArrow(group, _NOTES)
    return marks.unionByName(exact), bits, n_shards


def _read_notes(table: pa.Table) -> dict[tuple[int, int], bytes]:
    cols = [table.column(c).to_pylist() for c in ("row", "shard", "bits")]
    return {(r, s): b for r, s, b in zip(*cols)}


def _remove(docs: DataFrame, text: str, window: int, depth: int, block_bytes: int, shard_bytes: int, digest: bool) -> DataFrame:
    others = [f for f in docs.schema.fields if not digest or f.name != text]
    names = [f.name for f in others]
    own = [T.StructField(fresh(names, "n_words"), T.LongType()), T.StructField(fresh(names, "n_removed"), T.LongType())]
    if digest:
        own.append(T.StructField(fresh(names, "kept_sha256"), T.StringType()))
    schema = T.StructType([*others, *own])
    blocks = to_blocks(docs, text, block_bytes)
    notes, bits, n_shards = flag_windows(blocks, text, window, depth, shard_bytes)
    shard_bits = n_shards.bit_length() - 1
    out_names = [f.name for f in schema.fields]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for data in left.column("data").to_pylist():
            block = _Block(data, text, window)
            known = _read_notes(right)
            est = block.estimated(known, bits, depth, n_shards)
            one, _, _, back = _exact_order(block.one[est], block.two[est])
            hot = _flags(one >> np.uint64(64 - shard_bits) if shard_bits else np.zeros(len(one), np.uint64), known, _EXACT, n_shards)
            repeated = np.zeros(len(block.one), bool)
            repeated[est] = hot[back]
            at = 0
            for batch, texts, doc, first in zip(block.batches, block.texts, block.docs, block.firsts):
                flags = repeated[at : at + len(first)]
                at += len(first)
                edge = np.zeros(len(doc) + window, np.int32)
                edge[first[flags]] += 1
                np.add.at(edge, first[flags] + window, -1)
                gone = np.cumsum(edge)[: len(doc)] > 0
                edges = np.searchsorted(doc, np.arange(len(texts) + 1))
                n_words, n_removed, kept = np.diff(edges), [], []
                for raw, a, b in zip(texts, edges, edges[1:]):
                    words = raw.split()
                    lost = gone[a:b]
                    if lost.any():
                        words = [w for w, x in zip(words, lost.tolist()) if not x]
                    n_removed.append(int(lost.sum()))
                    kept.append(b" ".join(words))
                cols = dict(zip(batch.schema.names, batch.columns))
                if digest:
                    cols.pop(text)
                else:  # texts that lose nothing stay as they are
                    cols[text] = pa.array([k.decode() if n else t for k, n, t in zip(kept, n_removed, cols[text].to_pylist())], pa.string())
                arrays = [*cols.values(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
                if digest:
                    arrays.append(pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))
                made.append(pa.RecordBatch.from_arrays(arrays, names=out_names))
        return pa.Table.from_batches(made)

    return blocks.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(finish, schema)


def dedup_windows(docs: DataFrame, text: str = "text", window: int = WINDOW, depth: int = DEPTH, block_bytes: int = 12_000_000, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All columns, the text without the words of repeated windows (the rest
    joined by single spaces; a text that loses nothing stays as it is),
    ``n_words`` and ``n_removed``."""
    return _remove(docs, text, window, depth, block_bytes, shard_bytes, False)


def dedup_digest(docs: DataFrame, text: str = "text", window: int = WINDOW, depth: int = DEPTH, block_bytes: int = 12_000_000, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """As ``dedup_windows``, with the SHA-256 of the kept words in place of
    the text."""
    return _remove(docs, text, window, depth, block_bytes, shard_bytes, True)
