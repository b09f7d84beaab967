"""Packing by power-of-two decomposition.

Every document is cut into full sequences of ``max_len`` tokens and, for the
rest, the pieces of its binary expansion, longest first. Each piece is a
sequence of its own whose length is a power of two, so no sequence crosses
documents and none needs padding; pieces of one length form a bucket, from
which equal-shaped batches are drawn (``write_buckets``).

The whole operator is one narrow pass: no shuffle, no state beyond a bounded
word cache. Sequence ids are the bucket's exponent in the top bits and the
engine's partition-wise row id below, so the sequences of a bucket are
adjacent in id order and a retried task gives the same ids.

Edge cases: a null or empty text has the end token alone and gives one piece
of length 1. Repeated rows are packed each on its own. Every input column
except the text stays, so extra columns with clashing names survive (the
operator's own columns then get a numbered name). An empty table gives none.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.llm.common import fresh, ship, slices_by_bytes, tokenizer_file

MAX_LEN = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
#: bound of the word cache of one Python worker (entries)
CACHE_WORDS = 500_000
_EXPONENT_SHIFT = 59

#: where a byte-level vocabulary can be cut: a run without white space and the
#: one space before it, white space up to the last before a word, the rest
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python counts these as white space, the tokenizer doesn't
_ODD_SPACE = re.compile("[\x1c-\x1f]")

_ENCODERS: dict[str, Callable[[str], bytes]] = {}


def pieces_of(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: full ones, then the binary
    expansion of the rest, longest first. ``max_len`` is a power of two."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length() - 2, -1, -1) if rest >> b & 1]


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, the others follow from U+0100 upward."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in own}
    for k, b in enumerate(b for b in range(256) if b not in set(own)):
        table[chr(256 + k)] = b
    return table


def byte_encoder(tokenizer: str = TOKENIZER, cache_words: int = CACHE_WORDS) -> Callable[[str], bytes]:
    """Text to little-endian unsigned 32-bit ids, equal to the tokenizer
    file's own encoding without added special tokens.

    A byte-level vocabulary never merges across white space, but for a single
    space before a word. The text is cut there, and each distinct chunk is
    encoded once per worker while it stays in a bounded cache."""
    if tokenizer in _ENCODERS:
        return _ENCODERS[tokenizer]
    import tiktoken

    spec = json.load(open(tokenizer_file(tokenizer), encoding="utf-8"))
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in tok): i for tok, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {k: v for k, v in ranks.items() if v not in special.values()}
    import public_tokenizers

    codec = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    cache: dict[str, bytes] = {}
    older: dict[str, bytes] = {}
    raw = codec.encode_ordinary

    def whole(text: str) -> bytes:
        return np.asarray(codec.encode(text, allowed_special="all"), dtype="<u4").tobytes()

    def miss(chunk: str) -> bytes:
        ids = older.get(chunk)
        if ids is None:
            ids = array("I", raw(chunk)).tobytes()
            if len(chunk) > 32:
                return ids
        if len(cache) >= cache_words // 2:  # two generations: what was used lately stays
            older.clear()
            older.update(cache)
            cache.clear()
        cache[chunk] = ids
        return ids

    def encode(text: str) -> bytes:
        if _ODD_SPACE.search(text) or any(s in text for s in special):
            return whole(text)
        get = cache.get
        return b"".join([get(c) or miss(c) for c in _CHUNK.findall(text)])

    _ENCODERS[tokenizer] = encode
    return encode


def pack(
    docs: DataFrame,
    text: str = "text",
    tokenizer: str = TOKENIZER,
    max_len: int = MAX_LEN,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: the document's other columns, then ``start``,
    ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``
    (0, a piece is a whole sequence), and with ``with_ids`` the ids."""
    if max_len & (max_len - 1) or max_len < 1:
        raise ValueError("max_len is a power of two")
    ship(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in keep]
    own = {}
    for c, kind in (("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("ids", T.BinaryType())):
        if c != "ids" or with_ids:
            own[c] = T.StructField(fresh(names, c), kind)
    schema = T.StructType([*keep, *own.values()])
    docs = docs.select(*[docs[f"`{n}`"] for n in names], docs[f"`{text}`"].alias(fresh(names, "__text")))
    text_at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(tokenizer)
        tail = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in slices_by_bytes(batches, batch_text, 8_000_000):
            rows: list[int] = []
            start, length, crc, total, ids_of = [], [], [], [], []
            for r, value in enumerate(batch.column(text_at).to_pylist()):
                ids = (encode(value) if value else b"") + tail
                n = len(ids) // 4
                at = 0
                for size in pieces_of(n, max_len):
                    piece = ids[4 * at : 4 * (at + size)]
                    rows.append(r)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    if with_ids:
                        ids_of.append(piece)
                    at += size
            take = pa.array(rows, pa.int32())
            arrays = [batch.column(i).take(take) for i in range(text_at)]
            arrays += [pa.array(v, pa.int64()) for v in (start, length, crc, total)]
            if with_ids:
                arrays.append(pa.array(ids_of, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    batch_text = fresh(names, "__text")
    out = docs.mapInArrow(run, schema)
    exponent = F.log2(F.col(own["length"].name).cast("double")).cast("long")
    return out.withColumns({
        fresh(names, "sequence_id"): F.shiftleft(exponent, _EXPONENT_SHIFT) + F.monotonically_increasing_id(),
        fresh(names, "offset"): F.lit(0).cast("long"),
    })


def write_buckets(pieces: DataFrame, path: str, length: str = "length") -> None:
    """Write the pieces as Parquet, one folder per piece length, so that a
    reader draws batches of equal shape."""
    pieces.write.mode("overwrite").partitionBy(length).parquet(path)


def pack_digest(docs: DataFrame) -> DataFrame:
    return pack(docs.select("doc_id", "text"), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
