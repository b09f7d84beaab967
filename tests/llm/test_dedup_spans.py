import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sievekit.llm import suffix_dedup, window_dedup


def brute_words(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, n=60, words=8):
    """Few distinct words and shared passages, so that much repeats."""
    rng = random.Random(seed)
    vocabulary = ["a", "b", "cc", "dé", "eee", "f"][: max(2, words)]
    shared = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 90))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 4))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    return rows


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("small", [{}, {"block_bytes": 500, "shard_bytes": 64}])
def test_windows_equal_brute_force(make, odd, small):
    docs = make([(i, t, "en") for i, t in random_rows(1)]).unionByName(odd)
    got = window_dedup.dedup_digest(docs.select("doc_id", "text"), window=7, **small).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_words(pairs(docs), 7)


def test_prefilter_loses_nothing_with_a_tiny_sketch(make):
    docs = make([(i, t, "en") for i, t in random_rows(2, 30)])
    got = window_dedup.dedup_digest(docs.select("doc_id", "text"), window=5, depth=1, block_bytes=300, shard_bytes=4).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_words(pairs(docs), 5)


def test_windows_keep_columns_and_text(odd, empty):
    out = window_dedup.dedup_windows(odd.withColumnRenamed("lang", "n_words"))
    assert out.columns == ["doc_id", "text", "n_words", "source", "n_chars", "n_words_1", "n_removed"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text is None and rows[4].text == "" and rows[4].n_removed == 60 and rows[5].text == "x y é"
    assert window_dedup.dedup_windows(empty).count() == 0


@pytest.mark.parametrize("options", [{}, {"block_bytes": 500, "shard_bytes": 64}, {"block_bytes": 500, "shard_bytes": 64, "hot": 2}])
def test_strings_equal_brute_force(make, odd, options):
    docs = make([(i, t, "en") for i, t in random_rows(3, 40, 3)]).unionByName(odd.where("doc_id IS NULL OR doc_id <> 8"))
    for length in (20, 64):
        got = suffix_dedup.dedup_digest(docs.select("doc_id", "text"), length=length, **options).collect()
        assert sorted([tuple(r) for r in got], key=str) == brute_bytes(pairs(docs), length)


def test_strings_in_a_run_of_one_letter(make):
    docs = make([(1, "x" * 900, "en"), (2, "ab" * 300, "en"), (3, "clean text", "en")])
    got = suffix_dedup.dedup_digest(docs.select("doc_id", "text")).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_bytes(pairs(docs), 400)


def test_strings_keep_columns_and_text(odd, empty):
    out = suffix_dedup.dedup_strings(odd.withColumnRenamed("lang", "n_spans"), length=100)
    assert out.columns == ["doc_id", "text", "n_spans", "source", "n_chars", "n_bytes", "n_removed", "n_spans_1"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text is None and rows[4].text == "" and rows[5].text == "x y é"
    assert suffix_dedup.dedup_strings(empty).count() == 0


def test_deep_shallow_sorts():
    rng = random.Random(5)
    for _ in range(60):
        strings = list({bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 50))) for _ in range(40)} | {b"a" * k for k in range(rng.randint(1, 70))})
        for shallow in (0, 8, 24):
            order, lcp = suffix_dedup.deep_shallow(strings, shallow)
            assert [strings[k] for k in order] == sorted(strings)
            for n, a, b in zip(lcp[1:], order, order[1:]):
                real = suffix_dedup.common_prefix(strings[a], strings[b])
                assert n == real or n == 0 and real < shallow


def test_multikey_quicksort_partitions_large_parts():
    rng = random.Random(6)
    strings = [rng.randbytes(rng.randint(0, 12)) for _ in range(9000)]
    groups = suffix_dedup.multikey_quicksort(strings, 16)
    flat = [strings[k].ljust(16, b"\0") for g in groups for k in g]
    assert flat == sorted(flat) and len(flat) == 9000
