"""Merkle manifest against a plain construction of the same trees."""

import hashlib
import zlib

import pytest

from sievekit.llm.merkle_manifest import build, climb, verify

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, tree int"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, low=False):
    doc_id, text, lang, source, n_chars = row[:5]
    if low and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def _tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def _ascend(levels, i, h):
    met = []
    for level in levels[:-1]:
        a, at = i // 8 * 8, i % 8
        run = level[a : a + 8]
        met += run[:at] + run[at + 1 :]
        h, i = _h(*run[:at], h, *run[at + 1 :]), i // 8
    return met, h


def _brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
    trees = [_tree([_leaf(r) for r in groups[lang]]) for lang in langs]
    top = _tree([t[-1][0] for t in trees])
    out = []
    for k, lang in enumerate(langs):
        for i, r in enumerate(groups[lang]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            one, h = _ascend(trees[k], i, _leaf(r, hit))
            two, h = _ascend(top, k, h)
            out.append((r[0], _leaf(r), trees[k][-1][0], top[-1][0], _h(*one, *two), h, h == top[-1][0]))
    return sorted(out, key=str)


def _got(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = verify(df)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def _row(i, lang, text="Some Text"):
    return (i, text, lang, f"s{i % 3}", None if i % 7 == 0 else i, "clash", i)


def test_equals_plain_trees(spark):
    rows = [_row(i, "en") for i in range(150)]  # three levels, last runs of fewer than eight
    rows += [_row(i, "zz") for i in range(200, 209)]  # nine leaves: a last run of one
    rows += [_row(i, f"l{i}") for i in range(300, 310)]  # languages of one document; two levels of subroots
    rows += [_row(i, None) for i in range(400, 403)] + [_row(500, ""), _row(501, "é")]
    rows += [(600, None, "en", None, None, None, None), (601, "", "en", "", 0, "", 0), (602, "Ab é\n" * 30_000, "en", "x", 9, "", 1)]
    rows += [(None, "A", "en", "s", 1, "", 1), (None, "B", "en", "s", 1, "", 1), (5, "other text of the same id", "en", "s", 1, "", 1)]
    rows += [_row(7, "en")] * 3  # repeated rows are leaves of their own
    want = _brute(rows)
    assert _got(spark, rows) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


@pytest.mark.parametrize("n", [1, 8])
def test_small_trees(spark, n):
    rows = [_row(i, "en") for i in range(n)]
    assert _got(spark, rows) == _brute(rows)


def test_empty_table(spark):
    assert _got(spark, []) == []


def test_climb_has_a_row_per_leaf_and_level(spark):
    found = build(spark.createDataFrame([_row(i, "ab"[i % 2]) for i in range(130)], SCHEMA))
    steps = climb(found).groupBy("tree", "position").max("step").collect()
    assert len(steps) == 130 and {r[2] for r in steps} == {4}  # 65 leaves: three levels, and the top
