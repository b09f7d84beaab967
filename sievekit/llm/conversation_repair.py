"""Conversation structure repair: cost DP, then prefix-doubling path ranking.

A conversation's rows, in order, are edited (Keep, Rerole, Delete, Insert) at
least cost into role initials ``(s?(ua)+)?``. The graph's nodes are (row, state)
with four states: start, after a system, a user, an assistant turn. Of all
cheapest edit sequences the one whose initials are least in ASCII order is wanted.

1. **Items.** Rows are told apart by a 128-bit digest of their text, so the
   texts stay where they are. Equal rows become one with a count; a row is a
   duplicate if its (role, text) came earlier in the conversation: a minimum by
   key, joined back. Items are range-partitioned on (conversation, order), so a
   conversation of any length lies in as many partitions as it needs.
2. **Segments.** Each partition is read as a stream and cut into segments of at
   most ``SEGMENT`` rows of one conversation: a byte a row (its type), the 4 x 4
   (min, +) cost matrix of the segment, and counts.
3. **Cost DP.** A conversation's segments are met last to first; a vector of
   four costs to the end is all that is carried. Inside a segment the costs
   of all its nodes come from (min, +) products over doubled spans.
4. **Path ranking.** Over the optimal arcs (cost of arc + cost to the end = cost
   to the end), nodes are ranked by the least audit string of length 1, 2, 4, ...:
   a node's rank at twice the length is that of the pair (its rank, the rank of
   the node it reaches), and its pointer is its pointer's pointer. The arc with
   the least (letter, rank of its target) is taken; the path from each of the
   four entry states is read off the doubled pointers.
5. **Repair.** Segments, then texts, of a conversation are met in order; the entry
   state chooses each segment's path, and the edits are applied to the texts
   while they stream by, into a running SHA-256.

No step holds a conversation's rows: steps 1 to 4 hold a segment, step 5 a
batch of texts and the audit itself (a byte a row, which the result has anyway).
Step 5 reads a conversation in one task, as a SHA-256 is a chain.

Edge cases: null conversation, turn, role and text count as one space (a null
conversation is a conversation of its own and comes back as null; null turns
come first and have no part in ``gaps``). Rows of one turn are ordered by role,
then by their text's digest; repeated rows are duplicates. An empty role has no
initial and can't be kept. A conversation that lost all its rows has an empty
repair. An empty table gives no rows. Texts of any length are hashed as they
pass. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import ship

#: rows of a segment, and about so many rows ranked at once
SEGMENT = 4_096
BATCH = 16_384
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: letters in ASCII order: their places are their ranks
LETTERS = b"DIKR"
#: costs above this mean: no way
FAR = 1 << 60

# states: 0 nothing yet, 1 after s, 2 after u, 3 after a
_NEXT = (2, 2, 3, 2)  # of an inserted or reroled turn: user, but assistant after user
_AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: inserts that end the conversation, by state
_TAIL = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
_TAIL_LETTERS = (b"", b"II", b"I", b"")

# an item's type: 0-3 initial s, u, a, other; + 4 truncated; 8 must be deleted
_TYPES = 9


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """arcs[type, letter] -> (cost, target state) for each state, where Insert
    stays before the item; and the (min, +) matrix of inserts then item."""
    cost = np.full((_TYPES, 4, 4), FAR, np.int64)  # type, letter, state
    to = np.zeros((_TYPES, 4, 4), np.int64)
    for kind in range(_TYPES):
        for s in range(4):
            cost[kind, 0, s], to[kind, 0, s] = DELETE, s
            cost[kind, 1, s], to[kind, 1, s] = INSERT, _NEXT[s]
            if kind == 8:
                continue
            extra = TRUNCATED if kind & 4 else 0
            after = _AFTER.get("sua?"[kind & 3], (None,) * 4)[s]
            if after is not None:
                cost[kind, 2, s], to[kind, 2, s] = KEEP + extra, after
            cost[kind, 3, s], to[kind, 3, s] = REROLE + extra, _NEXT[s]
    inserts = np.full((4, 4), FAR, np.int64)
    for s in range(4):
        at = s
        for n in range(4):
            inserts[s, at] = min(inserts[s, at], n * INSERT)
            at = _NEXT[at]
    through = np.full((_TYPES, 4, 4), FAR, np.int64)
    for kind in range(_TYPES):
        for letter in (0, 2, 3):
            for s in range(4):
                t = to[kind, letter, s]
                through[kind, s, t] = min(through[kind, s, t], cost[kind, letter, s])
    return cost, to, np.array([_times(inserts[None], m[None])[0] for m in through])


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) products of (n, r, 4) and (n, 4, 4) or (n, 4, 1)."""
    return np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(axis=2), FAR)


_ARC_COST, _ARC_TO, _THROUGH = None, None, None


def _load() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    global _ARC_COST, _ARC_TO, _THROUGH
    if _ARC_COST is None:
        _ARC_COST, _ARC_TO, _THROUGH = _tables()
    return _ARC_COST, _ARC_TO, _THROUGH


def _spans(kinds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(items, 4, 4): the cost matrix from each item to the end of its
    segment, from products over spans of doubled length."""
    m = _load()[2][kinds]
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(kinds)) - 1  # items after this one
    step = 1
    while step <= (left.max() if len(left) else 0):
        at = np.flatnonzero(left >= step)
        m[at] = _times(m[at], m[at + step])  # the right side is taken before anything is assigned
        step *= 2
    return m


def segment_costs(kinds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(segments, 4, 4) cost matrices of whole segments (none is empty)."""
    return _spans(kinds, sizes)[np.cumsum(sizes) - sizes]


def rank_paths(kinds: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> list[list[tuple[int, bytes]]]:
    """For each segment and entry state: (exit state, least audit) among the
    cheapest ways, given the costs ``ends`` (segments, 4) from its end on.

    Nodes are numbered four an item, then four sinks a segment."""
    arc_cost, arc_to, _ = _load()
    n, segs = len(kinds), len(sizes)
    seg = np.repeat(np.arange(segs), sizes)
    h = _times(_spans(kinds, sizes), ends[seg][:, :, None])[:, :, 0]  # (items, 4)
    total = np.concatenate([h.ravel(), ends.ravel()])
    state = np.tile(np.arange(4), n)
    item = np.repeat(np.arange(n), 4)
    last = np.zeros(n, bool)
    last[np.cumsum(sizes) - 1] = True
    nxt = np.where(last, n + seg, np.arange(n) + 1)  # the row block reached behind the item
    nodes = 4 * (n + segs)
    target = np.empty((4, 4 * n), np.int64)
    ok = np.empty((4, 4 * n), bool)
    for letter in range(4):
        to = arc_to[kinds[item], letter, state]
        target[letter] = 4 * (item if letter == 1 else nxt[item]) + to
        c = arc_cost[kinds[item], letter, state]
        ok[letter] = (c < FAR) & (c + total[target[letter]] == total[: 4 * n]) & (total[: 4 * n] < FAR)
    # length 1: the least letter of an optimal arc; sinks, and nodes without a way, end the string
    letter = np.where(ok.any(axis=0), ok.argmax(axis=0), -1)
    rank = np.concatenate([letter + 1, np.zeros(4 * segs, np.int64)])
    here = np.arange(nodes)
    step = here.copy()
    step[: 4 * n] = np.where(letter >= 0, target[np.maximum(letter, 0), np.arange(4 * n)], here[: 4 * n])
    jumps, reach = [step], step
    length = (step != here).astype(np.int64)  # letters of a path, up to its end
    while (reach[reach] != reach).any():  # audits of twice the length
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[reach], return_inverse=True)
        length = length + length[reach]
        reach = reach[reach]
        jumps.append(reach)
    # the arc of least (letter, rank of its target): a node's arcs have letters of their own, so the letter decides
    choice = np.where(ok, np.arange(4)[:, None] * (nodes + 1) + rank[target], np.iinfo(np.int64).max).min(axis=0)
    letter = np.where(ok.any(axis=0), choice // (nodes + 1), -1)
    marks = np.concatenate([np.frombuffer(LETTERS, np.uint8)[letter], np.zeros(4 * segs, np.uint8)])
    entry = ((4 * (np.cumsum(sizes) - sizes))[:, None] + np.arange(4)).ravel()  # four a segment
    audits: list[bytes] = [b""] * len(entry)
    width = np.ceil(np.log2(np.maximum(length[entry], 1))).astype(np.int64)  # paths of like length together
    for k in np.unique(width):
        rows = np.flatnonzero(width == k)
        path = entry[rows][:, None]
        for jump in jumps[:k]:  # the first 2^j nodes, then those 2^j further on
            path = np.concatenate([path, jump[path]], axis=1)
        text = marks[path]
        for r, row in zip(rows, text):
            audits[r] = row[: length[entry[r]]].tobytes()
    sink = 4 * (n + np.repeat(np.arange(segs), 4))
    exits = np.where(total[entry] < FAR, reach[entry] - sink, -1)
    return [[(int(exits[4 * s + e]), audits[4 * s + e] if exits[4 * s + e] >= 0 else b"") for e in range(4)] for s in range(segs)]


WS = " \t\n\x0b\x0c\r"
STOPS = ".!?"


def rows_of(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The four columns under fixed names; null role and text are a space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return table.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"),
                        F.lit(1).alias("n"))


def damage(rows: DataFrame) -> DataFrame:
    """Damages rows by ``crc32(conv:turn) % 20``: 0 drops the row (``n`` = 0),
    1 empties its text, 2 takes out ``[.!?]``, 3 repeats it (``n`` = 2), 4 makes
    its role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind <= 1, F.lit("")).when(kind == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(kind == 0, F.lit(0)).when(kind == 3, F.col("n") * 2).otherwise(F.col("n")).alias("n"))


def _digest() -> Column:
    return F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)


def items(rows: DataFrame) -> DataFrame:
    """One row per (conv, turn, role, text): its count ``n``, whether its first
    copy is a duplicate, and its type; the text is left behind."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(WS)), -1, 1)
    initial = F.substring("role", 1, 1)
    first = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    c = rows.where("n > 0").groupBy("conv", "turn", "role", _digest().alias("digest"), first.alias("initial"), (last == "").alias("blank"),
                                   (~last.isin(*STOPS)).alias("cut")).agg(F.sum("n").alias("n"))
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    firsts = c.groupBy(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("digest").alias("digest_")).agg(F.min(order).alias("least"))
    same = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_"))
    later = F.col("turn").isNotNull() & (~F.col("least.has") | F.coalesce(F.col("turn") > F.col("least.turn"), F.lit(False)))
    return c.join(firsts, same).select("conv", "turn", "role", "digest", "initial", "blank", "cut", "n", later.alias("later"))


_SEGMENT = [("pid", "int"), ("seq", "int"), ("kinds", "binary"), ("costs", "binary"), ("blank", "bigint"), ("duplicate", "bigint"), ("truncated", "bigint"),
            ("illegal", "bigint"), ("opens", "int"), ("closes", "int"), ("low", "bigint"), ("high", "bigint"), ("turns", "bigint")]
_LEGAL = {(0, 1), (1, 2), (2, 1)}


@dataclass
class _Segment:
    conv: object
    seq: int
    kinds: bytearray = field(default_factory=bytearray)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    opens: int = -1
    closes: int = -1
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def add(self, initial: int, kind: int, copies: int) -> None:
        if self.opens < 0:
            self.opens = initial
        elif (self.closes, initial) not in _LEGAL:
            self.illegal += 1
        self.illegal += copies - 1  # a role beside itself
        self.closes = initial
        self.kinds.extend(bytes([kind]) * copies)

    def see(self, turn: int | None) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn


def _cut_segments(conv_type: pa.DataType, segment: int):
    """Streams a range-sorted partition of items into segment rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[_Segment] = []
        cur: _Segment | None = None
        pid = 0

        def out() -> pa.RecordBatch:
            sizes = np.array([len(s.kinds) for s in ready], np.int64)
            costs = segment_costs(np.frombuffer(b"".join(bytes(s.kinds) for s in ready), np.uint8).astype(np.int64), sizes)
            cols = [pa.array([s.conv for s in ready], conv_type), pa.array([pid] * len(ready), pa.int32()), pa.array([s.seq for s in ready], pa.int32()),
                    pa.array([bytes(s.kinds) for s in ready], pa.binary()), pa.array([m.tobytes() for m in costs], pa.binary())]
            cols += [pa.array([getattr(s, n) for s in ready], pa.int32() if t == "int" else pa.int64()) for n, t in _SEGMENT[4:]]
            return pa.RecordBatch.from_arrays(cols, names=["conv", *[n for n, _ in _SEGMENT]])

        held = 0
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in b.schema.names}
            for conv, at, turn, initial, blank, ended, n, later in zip(*[cols[c] for c in ("conv", "pid", "turn", "initial", "blank", "cut", "n", "later")]):
                pid = at
                if cur is None or cur.conv != conv:
                    if cur is not None:
                        ready.append(cur)
                    cur = _Segment(conv, 0)
                forced = blank or later
                kind = 8 if forced else initial + (4 if ended else 0)
                while n:
                    room = segment - len(cur.kinds)
                    if not room:
                        ready.append(cur)
                        cur = _Segment(conv, cur.seq + 1)
                        continue
                    take = min(n, room) if forced else 1
                    cur.see(turn)
                    cur.add(initial, kind, take)
                    if blank:
                        cur.blank += take
                    elif forced:
                        cur.duplicate += take
                    elif ended:
                        cur.truncated += 1
                    n, held = n - take, held + take
                    forced, kind = True, 8  # further copies
                if held >= BATCH and ready:
                    yield out()
                    ready, held = [], len(cur.kinds)
        if cur is not None:
            ready.append(cur)
        if ready:
            yield out()

    return run


_PATHS = [("exits", "array<int>"), ("audits", "array<binary>"), ("cost", "bigint")]


def _rank_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams segments, each conversation's last one first; adds the cost
    from the start state, and exit and audit of each entry state."""
    conv, ends, seen = None, None, False
    for b in batches:
        convs = b.column("conv").to_pylist()
        kinds = [np.frombuffer(k, np.uint8).astype(np.int64) for k in b.column("kinds").to_pylist()]
        at = np.empty((len(convs), 4), np.int64)
        cost = []
        for i, (c, m) in enumerate(zip(convs, b.column("costs").to_pylist())):
            if not seen or c != conv:
                conv, seen, ends = c, True, _TAIL
            at[i] = ends
            ends = np.minimum((np.frombuffer(m, np.int64).reshape(4, 4) + ends).min(axis=1), FAR)
            cost.append(int(ends[0]))
        exits, audits, i = [], [], 0
        while i < len(convs):
            j, held = i, 0
            while j < len(convs) and (j == i or held + len(kinds[j]) <= BATCH):
                held, j = held + len(kinds[j]), j + 1
            for ways in rank_paths(np.concatenate(kinds[i:j]), np.array([len(k) for k in kinds[i:j]], np.int64), at[i:j]):
                exits.append([w[0] for w in ways])
                audits.append([w[1] for w in ways])
            i = j
        keep = [n for n in b.schema.names if n not in ("kinds", "costs")]
        yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], pa.array(exits, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.binary())),
                                          pa.array(cost, pa.int64())], names=[*keep, *[n for n, _ in _PATHS]])


class _Repair:
    """One conversation while its segments and then its texts stream by."""

    def __init__(self) -> None:
        self.state, self.audit, self.cost, self.at, self.sealed = 0, bytearray(), None, 0, False
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.closes = -1

    def segment(self, r: dict) -> None:
        if self.cost is None:
            self.cost = r["cost"]
        elif (self.closes, r["opens"]) not in _LEGAL:
            self.illegal += 1
        self.closes = r["closes"]
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + r[name])
        if r["turns"]:
            self.turns += r["turns"] - (r["low"] == self.high)
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]
        self.audit += r["audits"][self.state]
        self.state = r["exits"][self.state]

    def _seal(self) -> None:
        self.audit += _TAIL_LETTERS[self.state]
        self.sealed, self.state = True, 0

    def _new(self) -> str:
        self.state = _NEXT[self.state]
        return "assistant" if self.state == 3 else "user"

    def text(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the row's copies and of the turns inserted before them."""
        if not self.sealed:
            self._seal()
        for _ in range(copies):
            while self.audit[self.at] == 73:
                self.at += 1
                yield "I", self._new(), ""
            edit = chr(self.audit[self.at])
            self.at += 1
            if edit == "K":
                self.state = _AFTER[role[:1]][self.state]
                yield edit, role, text
            elif edit == "R":
                yield edit, self._new(), text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        if not self.sealed:
            self._seal()
        while self.at < len(self.audit):
            self.at += 1
            yield "I", self._new(), ""

    def numbers(self) -> list:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost or 0, self.audit.decode()]


def _walk(batches: Iterator[pa.RecordBatch], begin, row, end) -> Iterator:
    """Streams segments then texts of each conversation; ``begin()`` makes the
    state that ``row(state, edits)`` and ``end(conv, repair, state)`` get."""
    conv, cur, state = None, None, None
    for b in batches:
        names = b.schema.names
        for values in zip(*[b.column(c).to_pylist() for c in names]):
            r = dict(zip(names, values))
            if cur is None or r["conv"] != conv:
                if cur is not None:
                    yield from end(conv, cur, state)
                conv, cur, state = r["conv"], _Repair(), begin()
            if r["part"] == 0:
                cur.segment(r)
            elif r["n"]:
                yield from row(conv, state, cur.text(r["role"], r["text"], r["n"]))
    if cur is not None:
        yield from end(conv, cur, state)


def _plan(rows: DataFrame, segment: int) -> DataFrame:
    """Segments with their ranked paths, and the texts, a conversation's
    together: segments in order first, then texts in order."""
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema["conv"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = items(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())
    conv = f"conv {kind.simpleString()}, "
    segs = laid.select("conv", "pid", "turn", "initial", "blank", "cut", "n", "later").mapInArrow(
        _cut_segments(to_arrow_type(kind), segment), conv + ", ".join(f"{n} {t}" for n, t in _SEGMENT))
    back = segs.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.desc("pid"), F.desc("seq"))
    kept = [(n, t) for n, t in _SEGMENT if n not in ("kinds", "costs")] + _PATHS
    ranked = back.mapInArrow(_rank_segments, conv + ", ".join(f"{n} {t}" for n, t in kept))
    texts = rows.select("conv", F.lit(1).alias("part"), "turn", "role", F.when(F.col("n") > 0, F.col("text")).alias("text"), "n", _digest().alias("digest"))
    both = texts.unionByName(ranked.withColumn("part", F.lit(0)), allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions(
        F.asc_nulls_first("conv"), "part", "pid", "seq", F.asc_nulls_first("turn"), "role", "digest").drop("digest", "pid", "seq", "turn")


def repaired_rows(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, role, text); ``rows``
    as ``rows_of`` gives them."""
    kind = rows.schema["conv"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    of = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbered(conv, state, edits):
            for edit, role, text in edits:
                state[0] += 1
                yield conv, state[0], edit, role, text

        got = _walk(batches, lambda: [-1], numbered, lambda conv, cur, state: numbered(conv, state, cur.rest()))
        yield from _batches(got, [of, pa.int64(), pa.string(), pa.string(), pa.string()], ["conv_id", "place", "edit", "role", "text"])

    return _plan(rows, segment).mapInArrow(run, f"conv_id {kind.simpleString()}, place bigint, edit string, role string, text string")


def _batches(rows: Iterator[tuple], types: list, names: list[str], size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per conversation: faults, cost, audit and SHA-256 of the repaired
    ``role:text`` lines. ``rows`` as ``rows_of`` (or ``damage``) gives them."""
    kind = rows.schema["conv"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    of = to_arrow_type(kind)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def feed(conv, state, edits):
            for _, role, text in edits:
                state[0].update(f"{state[1]}{role}:{text}".encode("utf-8", "surrogatepass"))
                state[1] = "\n"
            return ()

        def end(conv, cur, state):
            feed(conv, state, cur.rest())
            yield (conv, *cur.numbers(), state[0].hexdigest())

        got = _walk(batches, lambda: [hashlib.sha256(), ""], feed, end)
        yield from _batches(got, [of, *[pa.int64()] * 6, pa.string(), pa.string()], ["conv_id", *counts, "audit", "repaired_sha256"])

    return _plan(rows, segment).mapInArrow(run, f"conv_id {kind.simpleString()}, " + "".join(f"{c} bigint, " for c in counts) + "audit string, repaired_sha256 string")
