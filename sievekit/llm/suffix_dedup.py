"""Removal of repeated byte strings with a sparse suffix array.

A string of ``LENGTH`` bytes that occurs twice contains the same *anchor* at
the same place in both: the position whose ``LENGTH // 2``-byte gram has the
smallest hash among all grams of the string. So only suffixes at anchors (about
one in a hundred positions) are sorted, and of those only the ones whose gram
occurs more than once:

1. Every block sends the hashes of its anchors' grams to shards by value and
   learns which of them repeat.
2. For these it sends the anchor with its context: the bytes that the strings
   belonging to this anchor reach to either side.
3. A shard sorts the contexts' right parts as suffixes by deep-shallow
   sorting: multikey quicksort over 8-byte characters to a shallow depth, then
   a blind trie for every group that is still tied. From this order, that of
   suffixes starting 1, 2, ... bytes further left is induced by a stable sort
   on the byte in front. Two neighbours in such an order with a common prefix
   of ``LENGTH`` bytes or more are a repeated string.
4. Blocks get the repeated spans back and remove them.

An anchor gram that occurs more than ``HOT`` times isn't gathered in one
shard as contexts: its strings are sent as hashes and grouped exactly, like the
grams, so no group is unbounded. Equal contexts of a block are sent once.

Edge cases: a null or empty text has no bytes; texts below ``LENGTH`` lose
nothing. Strings never cross rows; equal rows repeat each other. A removal may
cut a multi-byte character: digests are over bytes, and the text column drops
the cut character's remaining bytes. All columns stay; own columns whose name
is taken get a numbered one. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sievekit.llm.blocks import Rolling, by_shard, mix, open_block, pack, shards_for, texts_of, to_blocks, total_bytes, unpack
from sievekit.llm.common import cut, fresh

LENGTH = 400
SHARD_BYTES = 16_777_216
#: context shards per shard of keys: contexts are bytes, not hashes
CONTEXT_SHARDS = 8
#: occurrences of a gram from which its strings are grouped as hashes
HOT = 20_000
#: bytes that multikey quicksort looks at before blind tries take over
SHALLOW = 24
_ANCHORS, _STRINGS, _SPANS = 0, 1, 2
_NOTES = "block long, kind int, shard int, bits binary"

_TABLE = np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM, _STRING = Rolling(0xC2B2AE3D27D4EB4F), Rolling(0x9FB21C651E98DF25)


# ---------------------------------------------------------------- anchors


class _Slice:
    """The texts of one slice in one buffer, with their anchors."""

    def __init__(self, batch: pa.RecordBatch, text: str, length: int):
        self.batch, self.length = batch, length
        self.texts = texts_of(batch, text)
        raw = b"".join(self.texts)
        self.raw, self.bytes = raw, np.frombuffer(raw, np.uint8)
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.sizes = sizes
        self.position, self.low, self.high, self.key = self._anchors()

    def _anchors(self):
        """Anchor positions; the first and last start of the strings that
        belong to each; the hash of its gram."""
        n, length = len(self.bytes), self.length
        gram = length // 2
        empty = np.zeros(0, np.int64)
        starts = np.zeros(n + 1, np.int32)  # 1 where a whole string starts
        long = self.sizes >= length
        if not long.any():
            return empty, empty, empty, np.zeros(0, np.uint64)
        starts[self.begin[long]] += 1
        np.add.at(starts, self.begin[long] + self.sizes[long] - length + 1, -1)
        string = np.flatnonzero(np.cumsum(starts[:n]))
        h = mix(_GRAM.ranges(_TABLE[self.bytes], slice(None), gram))
        # the leftmost smallest of the grams of each string: hash above, position below
        value = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        width = length - gram + 1
        rows = -(-len(value) // width) + 1
        padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(value)] = value
        grid = padded.reshape(rows, width)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        of = (np.minimum(back[string], ahead[string + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        # an anchor's hash is small by choice: mixed again, keys spread evenly over the shards
        return of[new], string[new], string[np.r_[new[1:] - 1, len(of) - 1]], mix(h[of[new]] ^ np.uint64(0xD6E8FEB86659FD93))

    def context(self, k: int) -> bytes:
        return self.raw[self.low[k] : self.high[k] + self.length]


class _Block:
    def __init__(self, data: bytes, text: str, length: int):
        self.slices = [_Slice(b, text, length) for b in open_block(data)]
        self.key = np.concatenate([s.key for s in self.slices])
        self.keys, self.back, self.counts = np.unique(self.key, return_inverse=True, return_counts=True)
        self.length = length

    def marked(self, notes: dict[tuple[int, int], list[bytes]], n_shards: int) -> np.ndarray:
        """Per anchor 0 (its gram occurs once), 1 (again) or 2 (very often)."""
        out = np.zeros(len(self.keys), np.uint8)
        for k, s in enumerate(by_shard(_shard(self.keys, n_shards), n_shards)):
            for got in notes.get((_ANCHORS, k), []):
                out[s] = unpack(got)[0]
        return out[self.back]

    def strings(self, hot: np.ndarray):
        """Every string that belongs to the given anchors: slice, start, and
        two hashes."""
        at = 0
        for s in self.slices:
            pick = hot[at : at + len(s.key)]
            at += len(s.key)
            n = np.where(pick, s.high - s.low + 1, 0)
            start = np.repeat(s.low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            if len(start):
                one = mix(_GRAM.ranges(_TABLE[s.bytes], start, self.length))
                two = mix(_STRING.ranges(mix(_TABLE[s.bytes]), start, self.length))
            else:
                one = two = np.zeros(0, np.uint64)
            yield s, start, one, two


def _shard(key: np.ndarray, n_shards: int) -> np.ndarray:
    bits = n_shards.bit_length() - 1
    return key >> np.uint64(64 - bits) if bits else np.zeros(len(key), np.uint64)


# ---------------------------------------------------- deep-shallow sorting


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _characters(strings: list[bytes], depth: int) -> np.ndarray:
    """The 8 bytes of each string from ``depth`` as one character."""
    return np.frombuffer(b"".join([s[depth : depth + 8].ljust(8, b"\0") for s in strings]), ">u8").astype(np.uint64)


def multikey_quicksort(strings: list[bytes], shallow: int = SHALLOW) -> list[list[int]]:
    """Groups of string indices in order; the strings of a group agree on
    their first ``shallow`` bytes (or are shorter). Three-way partitioning on
    8-byte characters: a part is split around a pivot into smaller, equal and
    larger characters, and equal ones go on with the next character."""
    if shallow < 8:
        return [list(range(len(strings)))] if strings else []
    chars = np.stack([_characters(strings, d) for d in range(0, shallow, 8)]) if strings else np.zeros((shallow // 8, 0), np.uint64)
    out: list[list[int]] = []
    todo = [(np.arange(len(strings)), 0)]
    while todo:
        part, level = todo.pop()
        if len(part) <= 1 or level == len(chars):
            if len(part):
                out.append(part.tolist())
            continue
        x = chars[level][part]
        if len(part) <= 4096:  # small parts: all pivots at once
            order = np.argsort(x, kind="stable")
            part, x = part[order], x[order]
            edges = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True])
            todo += [(part[a:b], level + 1) for a, b in zip(edges[-2::-1], edges[:0:-1])]
            continue
        pivot = np.sort(x[:: max(1, len(x) // 31)])[len(x[:: max(1, len(x) // 31)]) // 2]
        todo.append((part[x > pivot], level))
        todo.append((part[x == pivot], level + 1))
        todo.append((part[x < pivot], level))
    return out


class BlindTrie:
    """Orders strings with long common prefixes. An inner node keeps only the
    depth at which its strings branch; an insertion goes down blindly, compares
    once with the leaf it meets, and branches where they differ."""

    def __init__(self, strings: list[bytes]):
        self._strings = strings
        self._root = None

    def insert(self, k: int) -> None:
        s = self._strings[k]
        if self._root is None:
            self._root = [k]
            return
        node, path = self._root, []
        while type(node) is tuple:  # (depth, children by next byte; -1: the string ends)
            depth, children = node
            path.append(node)
            c = s[depth] if len(s) > depth else -1
            node = children.get(c)
            if node is None:
                node = next(iter(children.values()))
        t = self._strings[node[0]]
        shared = common_prefix(s, t)
        if shared == len(s) == len(t):
            node.append(k)
            return
        c = s[shared] if len(s) > shared else -1
        parent, below = None, self._root
        for inner in path:
            if inner[0] >= shared:
                break
            parent = inner
            at = s[inner[0]] if len(s) > inner[0] else -1
            below = inner[1][at]
        if type(below) is tuple and below[0] == shared:
            below[1][c] = [k]
            return
        d = t[shared] if len(t) > shared else -1
        made = (shared, {d: below, c: [k]})
        if parent is None:
            self._root = made
        else:
            parent[1][s[parent[0]] if len(s) > parent[0] else -1] = made

    def order(self) -> list[int]:
        out, stack = [], [self._root]
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], np.ndarray]:
    """Sorted order of distinct strings, and the longest common prefix of
    each with the one before (0 across shallow groups)."""
    order: list[int] = []
    lcp: list[int] = []
    for group in multikey_quicksort(strings, shallow):
        if len(group) > 1:
            trie = BlindTrie(strings)
            for k in group:
                trie.insert(k)
            group = trie.order()
        order += group
        lcp.append(0)
        lcp += [common_prefix(strings[a], strings[b]) for a, b in zip(group, group[1:])]
    return order, np.array(lcp, np.int32)


class _RangeMin:
    def __init__(self, x: np.ndarray):
        self._rows = [x]
        w = 1
        while 2 * w <= len(x):
            p = self._rows[-1]
            self._rows.append(np.minimum(p[: len(p) - w], p[w:]))
            w *= 2

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum of ``x[a + 1 : b + 1]`` where ``a < b``."""
        out = np.full(len(a), np.iinfo(np.int32).max, np.int32)
        size = b - a
        level = np.zeros(len(a), np.int64)
        some = size > 0
        level[some] = np.floor(np.log2(size[some])).astype(np.int64)
        for k in np.unique(level[some]):
            m = some & (level == k)
            row = self._rows[k]
            out[m] = np.minimum(row[a[m] + 1], row[b[m] + 1 - (1 << int(k))])
        return out


def repeated_offsets(key: np.ndarray, left: list[bytes], right: list[bytes], many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For anchors with gram ``key``, the bytes ``left`` that may precede the
    anchor and ``right`` from it on: the smallest and the largest offset ``o``
    such that the string of ``o`` bytes before and ``length - o`` from the
    anchor occurs with another anchor too (largest below smallest: none).
    Entries marked ``many`` stand for several occurrences."""
    n = len(key)
    reach = np.array([len(x) for x in left], np.int64)
    least = length - np.array([len(x) for x in right], np.int64)
    low, high = np.full(n, length, np.int64), np.full(n, -1, np.int64)
    m = np.flatnonzero(many)
    low[m], high[m] = least[m], reach[m]
    distinct = {s: 0 for s in right}
    strings = list(distinct)
    order, lcp = deep_shallow(strings, min(SHALLOW, length // 16 * 8))  # a group agrees on its gram
    for rank, k in enumerate(order):
        distinct[strings[k]] = rank
    rank = np.array([distinct[s] for s in right], np.int64)
    size = np.array([len(s) for s in right], np.int64)
    prefix = _RangeMin(lcp)
    before = np.zeros((n, int(reach.max(initial=0)) + 1), np.uint8)
    for i, x in enumerate(left):  # the bytes to the left, nearest first
        before[i, : len(x)] = np.frombuffer(x[::-1], np.uint8)
    _, group = np.unique(key, return_inverse=True)
    live = np.lexsort((rank, group))
    group = group[live]
    for o in range(before.shape[1]):
        if o:
            on = reach[live] >= o
            live, group = live[on], group[on]
            spread = group * 256 + before[live, o - 1]
            by = np.argsort(spread, kind="stable")  # keeps the order of the suffixes behind
            live, spread = live[by], spread[by]
        else:
            spread = group
        if len(live) < 2:
            break
        same = spread[1:] == spread[:-1]
        a, b = rank[live[:-1]], rank[live[1:]]
        shared = np.where(a == b, np.minimum(size[live[:-1]], size[live[1:]]), prefix.between(a, b))
        hit = same & (shared >= length - o)
        both = np.r_[False, hit] | np.r_[hit, False]
        found = live[both]
        low[found] = np.minimum(low[found], o)
        high[found] = np.maximum(high[found], o)
        kin = np.r_[False, same] | np.r_[same, False]  # a suffix alone in its class stays alone
        live, spread = live[kin], spread[kin]
        group = np.cumsum(np.r_[0, spread[1:] != spread[:-1]]) if len(spread) else spread
    return low, high


# ------------------------------------------------------------------ spark


def _notes_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("block", "kind", "shard", "bits"), cols, kinds)})


def _read_notes(table: pa.Table) -> dict[tuple[int, int], list[bytes]]:
    out: dict[tuple[int, int], list[bytes]] = {}
    for kind, shard, bits in zip(*[table.column(c).to_pylist() for c in ("kind", "shard", "bits")]):
        out.setdefault((kind, shard), []).append(bits)
    return out


def _join_bytes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(p) for p in parts], np.uint32), np.frombuffer(b"".join(parts), np.uint8)


def _split_bytes(sizes: np.ndarray, data: np.ndarray) -> list[bytes]:
    raw, ends = data.tobytes(), np.cumsum(sizes, dtype=np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def repeated_spans(blocks: DataFrame, text: str, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> tuple[DataFrame, int]:
    """Per block the spans of repeated strings (kind ``_SPANS``) and what the
    strings of very frequent grams need (``_ANCHORS``, ``_STRINGS``)."""
    n_shards = shards_for(max(total_bytes(blocks), 1), shard_bytes)
    n_contexts = n_shards * CONTEXT_SHARDS

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = _Block(data, text, length)
                for k, s in enumerate(by_shard(_shard(own.keys, n_shards), n_shards)):
                    if s.stop > s.start:
                        rows.append((block, _ANCHORS, k, pack(own.keys[s], own.counts[s].astype(np.uint32))))
            yield from _notes_table(rows).to_batches()

    def frequent(key: tuple, table: pa.Table) -> pa.Table:
        blobs = [unpack(b.as_py()) for b in table.column("bits")]
        keys, back = np.unique(np.concatenate([b[0] for b in blobs]), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([b[1] for b in blobs]), minlength=len(keys))
        mark = (total > 1).astype(np.uint8) + (total > hot)
        per = np.split(mark[back].astype(np.uint8), np.cumsum([len(b[0]) for b in blobs])[:-1])
        return _notes_table([(b, _ANCHORS, key[0].as_py(), pack(m)) for b, m in zip(table.column("block").to_pylist(), per)])

    marks = cut(blocks.select("block", "data").mapInArrow(anchors, _NOTES).groupBy("shard").applyInArrow(frequent, _NOTES))

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, known = [], _read_notes(right)
        for block, data in zip(left.column("block").to_pylist(), left.column("data").to_pylist()):
            own = _Block(data, text, length)
            mark = own.marked(known, n_shards)
            # one entry per distinct context, with all its places in the block
            entry: dict[tuple, list[int]] = {}
            at, place = 0, 0
            for s in own.slices:
                for k in np.flatnonzero(mark[at : at + len(s.key)] == 1).tolist():
                    p = int(s.position[k])
                    entry.setdefault((int(s.key[k]), p - int(s.low[k]), s.context(k)), []).append(place + p)
                at += len(s.key)
                place += len(s.bytes)
            order = sorted(entry)
            key = np.array([e[0] for e in order], np.uint64)
            for k, cut_at in enumerate(by_shard(_shard(key, n_contexts), n_contexts)):
                some = order[cut_at]
                if some:
                    places = [entry[e] for e in some]
                    rows.append((block, _SPANS, k, pack(
                        key[cut_at], np.array([e[1] for e in some], np.uint16 if length < 1 << 16 else np.uint32), *_join_bytes([e[2] for e in some]),
                        np.array([len(p) for p in places], np.uint32), np.array([q for p in places for q in p], np.uint32),
                    )))
            found = [(one, two) for _, _, one, two in own.strings(mark == 2)]
            one, two = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            if len(one):
                one, two, many, _ = _pairs(one, two)
                for k, s in enumerate(by_shard(_shard(one, n_shards), n_shards)):
                    if s.stop > s.start:
                        rows.append((block, _STRINGS, k, pack(one[s], two[s], (many[s] > 1).astype(np.uint8))))
        return _notes_table(rows)

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        kind, shard = (k.as_py() for k in key)
        ids = table.column("block").to_pylist()
        blobs = [unpack(b.as_py()) for b in table.column("bits")]
        if kind == _STRINGS:
            one, two = (np.concatenate([b[i] for b in blobs]) for i in (0, 1))
            _, _, count, back = _pairs(one, two)
            total = count + np.bincount(back, weights=np.concatenate([b[2] for b in blobs]), minlength=len(count))
            per = np.split((total[back] > 1).astype(np.uint8), np.cumsum([len(b[0]) for b in blobs])[:-1])
            return _notes_table([(b, kind, shard, pack(m)) for b, m in zip(ids, per)])
        keys = np.concatenate([b[0] for b in blobs])
        reach = np.concatenate([b[1] for b in blobs]).astype(np.int64)
        many = np.concatenate([b[4] for b in blobs]) > 1  # b: keys, reach, sizes, bytes, number of places, places
        left, right = [], []
        for b in blobs:
            for r, c in zip(b[1].tolist(), _split_bytes(b[2], b[3])):
                left.append(c[:r])
                right.append(c[r:])
            del b[2:4]
        low, high = repeated_offsets(keys, left, right, many, length)
        rows, at = [], 0
        for block, b in zip(ids, blobs):
            n = len(b[0])
            o0, o1 = (np.repeat(x[at : at + n], b[2]) for x in (low, high))
            at += n
            ok = o1 >= o0
            if ok.any():
                places = b[3].astype(np.int64)[ok]
                rows.append((block, _SPANS, shard, pack(places - o1[ok], places - o0[ok] + length)))
        return _notes_table(rows)

    spans = blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(contexts, _NOTES).groupBy("kind", "shard").applyInArrow(settle, _NOTES)
    return marks.unionByName(spans), n_shards


def _pairs(one: np.ndarray, two: np.ndarray):
    """Distinct (one, two) pairs in order, their counts, and each row's pair."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    at = np.flatnonzero(new)
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    return a[at], b[at], np.diff(np.r_[at, len(a)]), back


def _removed(own: _Block, known: dict[tuple[int, int], list[bytes]], n_shards: int) -> Iterator[tuple[_Slice, np.ndarray]]:
    """Per slice, which of its bytes lie in a repeated string."""
    spans = [unpack(b) for (kind, _), bits in known.items() if kind == _SPANS for b in bits]
    begin = np.concatenate([s[0] for s in spans]) if spans else np.zeros(0, np.int64)
    end = np.concatenate([s[1] for s in spans]) if spans else np.zeros(0, np.int64)
    extra: list[tuple[np.ndarray, np.ndarray]] = []
    if any(kind == _STRINGS for kind, _ in known):
        found = list(own.strings(own.marked(known, n_shards) == 2))
        one, _, _, back = _pairs(np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found]))
        hit = np.zeros(len(one), bool)
        for k, s in enumerate(by_shard(_shard(one, n_shards), n_shards)):
            for got in known.get((_STRINGS, k), []):
                hit[s] = unpack(got)[0] > 0
        hit, at, place = hit[back], 0, 0
        for s, start, _, _ in found:
            first = start[hit[at : at + len(start)]] + place
            extra.append((first, first + own.length))
            at += len(start)
            place += len(s.bytes)
        begin, end = (np.concatenate([x, *[e[i] for e in extra]]) for i, x in enumerate((begin, end)))
    place = 0
    for s in own.slices:
        n = len(s.bytes)
        here = (begin >= place) & (begin < place + n)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, begin[here] - place, 1)
        np.add.at(edge, end[here] - place, -1)
        place += n
        yield s, np.cumsum(edge[:n]) > 0


def _remove(docs: DataFrame, text: str, length: int, block_bytes: int, shard_bytes: int, hot: int, digest: bool) -> DataFrame:
    others = [f for f in docs.schema.fields if not digest or f.name != text]
    names = [f.name for f in others]
    own_names = ("n_bytes", "n_removed", "n_spans")
    own = [T.StructField(fresh(names, c), T.LongType()) for c in own_names]
    if digest:
        own.append(T.StructField(fresh(names, "kept_sha256"), T.StringType()))
    schema = T.StructType([*others, *own])
    out_names = [f.name for f in schema.fields]
    blocks = to_blocks(docs, text, block_bytes)
    notes, n_shards = repeated_spans(blocks, text, length, shard_bytes, hot)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        made, known = [], _read_notes(right)
        for data in left.column("data").to_pylist():
            for s, gone in _removed(_Block(data, text, length), known, n_shards):
                n_removed, n_spans, kept = [], [], []
                for raw, a, n in zip(s.texts, s.begin.tolist(), s.sizes.tolist()):
                    lost = gone[a : a + n]
                    k = int(np.count_nonzero(lost))
                    n_removed.append(k)
                    n_spans.append(int(np.count_nonzero(lost[1:] & ~lost[:-1])) + int(lost[0]) if k else 0)
                    kept.append(s.bytes[a : a + n][~lost].tobytes() if k else raw)
                cols = dict(zip(s.batch.schema.names, s.batch.columns))
                if digest:
                    cols.pop(text)
                else:
                    cols[text] = pa.array([x.decode("utf-8", "ignore") if k else t for x, k, t in zip(kept, n_removed, cols[text].to_pylist())], pa.string())
                arrays = [*cols.values(), *[pa.array(v, pa.int64()) for v in (s.sizes, n_removed, n_spans)]]
                if digest:
                    arrays.append(pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))
                made.append(pa.RecordBatch.from_arrays(arrays, names=out_names))
        return pa.Table.from_batches(made)

    return blocks.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(finish, schema)


def dedup_strings(docs: DataFrame, text: str = "text", length: int = LENGTH, block_bytes: int = 12_000_000, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """All columns, the text without the bytes of repeated strings,
    ``n_bytes`` (before), ``n_removed`` and ``n_spans`` (removed runs)."""
    return _remove(docs, text, length, block_bytes, shard_bytes, hot, False)


def dedup_digest(docs: DataFrame, text: str = "text", length: int = LENGTH, block_bytes: int = 12_000_000, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """As ``dedup_strings``, with the SHA-256 of the kept bytes in place of
    the text."""
    return _remove(docs, text, length, block_bytes, shard_bytes, hot, True)
