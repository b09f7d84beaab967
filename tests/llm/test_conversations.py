"""Conversation repair against an exhaustive search over edit sequences."""

import hashlib
import random
import re
import sys
import zlib

import numpy as np
import pytest

from sievekit.llm.conversation_repair import damage, rank_paths, repair, repaired_rows, rows_of

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv int, n int, kind string, audit string"
WS = " \t\n\x0b\x0c\r"


def _damaged(rows):
    convs = {}
    for c, t, r, x in rows:
        kept = convs.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        kept += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    for kept in convs.values():
        kept.sort(key=lambda q: (q[0] is not None, q[0] or 0, q[1].encode(), hashlib.sha256(q[2].encode()).digest()[:16]))
    return convs


def _step(state, initial):
    return initial if (state, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")} else None


def _search(rows, faults):
    """(cost, audit, lines): least cost, then least audit, by trying every edit."""
    memo = {}

    def best(i, state, inserts):
        if (i, state, inserts) in memo:
            return memo[i, state, inserts]
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def go(cost, letter, line, j, to, n):
            rest = to is not None and best(j, to, n)
            if rest:
                ways.append((cost + rest[0], letter + rest[1], line + rest[2]))

        if inserts < 3:
            for role in ("user", "assistant"):
                go(5, "I", (role + ":",), i, _step(state, role[0]), inserts + 1)
        if i < len(rows):
            _, role, text = rows[i]
            go(2, "D", (), i + 1, state, 0)
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                go(more, "K", (f"{role}:{text}",), i + 1, _step(state, role[:1]), 0)
                for new in ("user", "assistant"):
                    go(more + 1, "R", (f"{new}:{text}",), i + 1, _step(state, new[0]), 0)
        memo[i, state, inserts] = min(ways, key=lambda w: w[:2]) if ways else None
        return memo[i, state, inserts]

    return best(0, "", 0)


def _brute(rows):
    out = {}
    for c, kept in _damaged(rows).items():
        seen, faults = set(), []
        for _, role, text in kept:
            end = text.rstrip(WS)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, lines = _search(kept, faults)
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "k", "a") for r in rows], SCHEMA)


def _got(df, **more):
    out = repair(damage(rows_of(df)), **more)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = out.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def _random_rows(seed, convs, longest):
    rnd = random.Random(seed)
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "unit"]
    texts = ["Yes.", "no", "Why?", "", " \t", None, "fine! \n", "é."]
    return [(c, None if rnd.random() < 0.05 else t, rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"t{c} {t}{rnd.choice('.,')}")
            for c in range(convs) for t in range(rnd.randint(1, longest))]


@pytest.mark.parametrize("segment", [1, 3, 4096])
def test_equals_search(spark, segment):
    rows = _random_rows(1, 150, 14)
    assert _got(_frame(spark, rows), segment=segment) == _brute(rows)


def test_long_conversation_in_many_partitions(spark):
    rnd = random.Random(2)
    # one conversation holds most rows
    rows = [(7, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", f"{t}.", f"{t}", ""])) for t in range(700)] + _random_rows(3, 6, 5)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        want = _brute(rows)
    finally:
        sys.setrecursionlimit(limit)
    assert _got(_frame(spark, rows), segment=50) == want


def test_odd_rows(spark):
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "gone."), (None, None, None, None), (None, 1, "user", "x."), (3, None, "user", "hi."), (3, None, "assistant", "ho.")]
    rows += [(4, 1, "user", "same.")] * 6 + [(4, 2, "user", "same."), (4, 2, "assistant", "x" * 200_000 + ".")]
    rows += [(5, t, "system", "s.") for t in range(4)] + [(6, -3, "user", "a."), (6, 9, "assistant", "b.")]
    got = _got(_frame(spark, rows), segment=2)
    assert got == _brute(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert _got(_frame(spark, [])) == {}


def test_rows_of_the_repair(spark):
    rows = _random_rows(4, 40, 9)
    df = damage(rows_of(_frame(spark, rows)))
    lines, want = {}, _brute(rows)
    for r in sorted(repaired_rows(df, segment=4).collect(), key=lambda r: r["place"]):
        lines.setdefault(r["conv_id"], []).append(r)
    for c, w in want.items():
        got = lines.get(c, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in got))
        assert [r["edit"] for r in got] == [e for e in w[6] if e != "D"]
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in got).encode()).hexdigest() == w[7]


def test_ranked_paths_of_many_segments_at_once():
    rnd = np.random.default_rng(3)
    sizes = np.array([1, 2, 700, 3, 64, 1, 65])
    kinds = rnd.integers(0, 9, sizes.sum())
    ends = rnd.integers(0, 12, (len(sizes), 4))
    together = rank_paths(kinds, sizes, ends)
    at = 0
    for s, n in enumerate(sizes):
        assert rank_paths(kinds[at : at + n], sizes[s : s + 1], ends[s : s + 1]) == together[s : s + 1]
        at += n
