"""Character counts and keyword flags of texts, a block of rows at a time.

``char_stats`` is an Arrow UDF: one pass over the bytes of a block of texts
counts every (row, character) pair with ``bincount``, so a text costs its
length, not length x distinct characters. Counts come back in the order in
which the characters first appear. Only ASCII sets and keywords are looked up.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: bytes of text that are counted together; a longer text is counted alone
BLOCK_BYTES = 1 << 20
#: cells of a (row, character) table per character read, beyond which pairs are sorted instead
DENSE = 8

SCHEMA = "counts array<int>, special int, digits int, upper int, kw_sql int, kw_xss int"
# letters outside ASCII whose lower case has an ASCII letter: İ and the Kelvin sign
_LOWER_TO_ASCII = ("İ".encode(), "K".encode())


def _blocks(ends: np.ndarray):
    """(first, last + 1) of runs of rows of ``BLOCK_BYTES`` at most, or of one longer row."""
    a, rows = 0, len(ends) - 1
    while a < rows:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK_BYTES, side="right")) - 1)
        yield a, b
        a = b


def _long_row(text: str, sets: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = Counter(text)
    sums = [[sum(counts[c] for c in chars)] for chars in sets]
    return np.fromiter(counts.values(), np.int64, len(counts)), np.array([len(counts)]), np.array(sums)


def _count(raw: bytes, at: np.ndarray, sets: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character counts of the rows ``raw[at[i]:at[i + 1]]`` one row after the
    other, the number of distinct characters a row, and per set and row the
    number of its characters."""
    rows = len(at) - 1
    if rows == 1 and len(raw) > BLOCK_BYTES:
        return _long_row(raw.decode(), sets)
    if raw.isascii():
        ids, chars = np.frombuffer(raw, np.uint8), np.arange(128)
    else:
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(begins)])[at]
        seen = np.zeros(int(codes.max()) + 1, bool)
        seen[codes] = True
        chars = np.flatnonzero(seen)
        ids = (np.cumsum(seen) - 1)[codes]
    width = len(chars)
    cell = np.repeat(np.arange(rows) * width, np.diff(at)) + ids
    if rows * width <= DENSE * len(cell):
        n = np.bincount(cell, minlength=rows * width)
        first = np.empty(rows * width, np.int64)
        first[cell[::-1]] = np.arange(len(cell) - 1, -1, -1)
        cells = np.flatnonzero(n)
        n, first = n[cells], first[cells]
    else:
        cells, first, n = np.unique(cell, return_index=True, return_counts=True)
    row, char = cells // width, cells % width
    sums = [np.bincount(row, n * np.isin(chars, [ord(c) for c in s])[char], rows) for s in sets]
    return n[np.argsort(first)], np.bincount(row, minlength=rows), np.array(sums)


def _contains_any(raw: bytes, at: np.ndarray, keywords: Sequence[bytes]) -> np.ndarray:
    """Per row whether it contains a keyword; ``raw`` is lower-cased."""
    found = np.zeros(len(at) - 1, bool)
    for k in keywords:
        p = raw.find(k)
        while p >= 0:
            i = int(np.searchsorted(at, p, side="right")) - 1
            inside = p + len(k) <= at[i + 1]  # else it begins in one row and ends in the next
            found[i] |= inside
            p = raw.find(k, int(at[i + 1]) if inside else p + 1)
    return found


def _ends(texts: Sequence[bytes]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def _block_stats(raw: bytes, at: np.ndarray, sets: Sequence[str], keywords: Sequence[Sequence[bytes]]):
    try:
        if not raw.isascii():
            raw.decode()
    except UnicodeDecodeError:  # bytes that are no UTF-8 count as replacement characters
        texts = [raw[a:b].decode(errors="replace").encode() for a, b in zip(at, at[1:])]
        raw, at = b"".join(texts), _ends(texts)
    counts, distinct, sums = _count(raw, at, sets)
    if any(c in raw for c in _LOWER_TO_ASCII):
        texts = [raw[a:b].decode().lower().encode() for a, b in zip(at, at[1:])]
        raw, at = b"".join(texts), _ends(texts)
    else:
        raw = raw.lower()  # of bytes: ASCII letters only
    return counts, distinct, sums, np.array([_contains_any(raw, at, ks) for ks in keywords])


def stats_of(texts: pa.Array, special: str, sql: Sequence[str], xss: Sequence[str]) -> pa.Array:
    """A struct of ``SCHEMA`` for every text (binary, UTF-8, not null)."""
    sets = (special, string.digits, string.ascii_uppercase)
    keywords = [[k.encode() for k in ks] for ks in (sql, xss)]
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    view = memoryview(data) if data is not None else memoryview(b"")
    none = (np.zeros(0, int), np.zeros(0, int), np.zeros((len(sets), 0)), np.zeros((len(keywords), 0)))
    parts = [none, *(_block_stats(bytes(view[ends[a] : ends[b]]), ends[a : b + 1] - ends[a], sets, keywords) for a, b in _blocks(ends))]
    counts, distinct, sums, flags = (np.concatenate(x, axis=-1) for x in zip(*parts))
    offsets = np.concatenate([[0], np.cumsum(distinct)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.astype(np.int32)))
    whole = [pa.array(x.astype(np.int32)) for x in (*sums, *flags)]
    return pa.StructArray.from_arrays([lists, *whole], ["counts", "special", "digits", "upper", "kw_sql", "kw_xss"])


@lru_cache(maxsize=None)
def _udf(special: str, sql: tuple[str, ...], xss: tuple[str, ...]):
    @F.arrow_udf(SCHEMA)
    def char_stats(texts: pa.Array) -> pa.Array:
        return stats_of(texts, special, sql, xss)

    return char_stats


def char_stats(text: Column, special: str, sql: Sequence[str], xss: Sequence[str]) -> Column:
    """``SCHEMA`` of a text column that is never null: counts of its distinct
    characters, how many are in ``special``, digits and upper-case letters of
    ASCII, and whether it contains a keyword in lower case."""
    return _udf(special, tuple(sql), tuple(xss))(text.cast("binary"))
