import hashlib
import os
import random
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievekit.llm import bpe_stream, pow2_packing
from sievekit.llm.common import tokenizer_file

os.environ["TOKENIZERS_PARALLELISM"] = "false"
tokenizers = pytest.importorskip("tokenizers")
HARD = [
    "", " ", "ΑΣ Σ ΣΑΣ", "İstanbul", "a<|endoftext|>b <|startoftext|>", "<|endoftext|", "é café", "a\x1cb c", "日本語 テスト",
    ":\U0003d000", "x" * 500, "ab" * 400, "'s's'll don't", "①²½", "ạ́", " a b　", "🙂👍🏽", "\x85x", "a  b", "\na", "a\r\nb", " \n", "don't 'S 's", "１２ ３",
]


@lru_cache
def library(name):
    return tokenizers.Tokenizer.from_file(tokenizer_file(name))


@pytest.fixture(scope="module")
def word():
    return library("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte():
    return library("byte_bpe_50k.json")


def decoded(text):
    c = bpe_stream.codec()
    machine = c.decoder()
    return "".join(machine.feed_bytes(b" ".join([y[1] for y in p if y[1]])) for p in c.chunks(text)) + machine.close()


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(st.characters(exclude_categories=["Cn", "Cs"]), max_size=60), st.text(alphabet="abceintoh 's.\n<|>", max_size=80), st.sampled_from(HARD)))
def test_encoders_equal_the_library(text):
    w, b = library("word_bpe_49k.json"), library("byte_bpe_50k.json")
    ids = w.encode(text, add_special_tokens=False).ids
    assert array("I", ids).tobytes() == bpe_stream.codec().encode(text)
    assert w.decode(ids, skip_special_tokens=False) == decoded(text)
    assert np.asarray(b.encode(text, add_special_tokens=False).ids, "<u4").tobytes() == (pow2_packing.byte_encoder()(text) if text else b"")


def test_stream_equals_whole_word_and_keeps_a_bounded_buffer():
    c, rng = bpe_stream.codec(), random.Random(1)
    m = c.merges
    real = m.buffer
    for _ in range(60):
        w = "".join(rng.choice("abcdehinorst"[: rng.randint(1, 12)]) for _ in range(rng.randint(1, 400))).encode()
        symbols = list(c._word(w))
        assert list(m.stream(iter(symbols))) == m.apply(symbols)
        m.buffer = 1  # emit as soon as the lookahead allows
        try:
            assert list(m.stream(iter(symbols[:120]))) == m.apply(symbols[:120])
        finally:
            m.buffer = real
    held = []

    def watched(n):
        for _ in range(n):
            held.append(1)
            yield c.inner[97]

    out = m.stream(watched(50_000))
    next(out)
    assert len(held) <= m.buffer


def test_lookahead_of_small_merge_lists():
    # b c merges before a b, so "ab" isn't certain before the symbol after b is seen
    m = bpe_stream.Merges({0: 1, 1: 1, 2: 1, 3: 2, 4: 2}, [(1, 2, 3), (0, 1, 4)])
    assert m.wait[4] == 1 and m.apply([0, 1, 2]) == [0, 3] and m.apply([0, 1]) == [4]


def test_decoder_holds_back_unfinished_characters():
    machine = bpe_stream.Decoder({0: "é".encode()[:1], 1: "é".encode()[1:]})
    assert machine.feed_bytes("é".encode()[:1]) == "" and machine.close() == "�"


def test_round_trip_decodes_its_ids():
    """The text's digest follows the ids, not the strings cached beside them."""
    c = bpe_stream.Codec()
    other, own = c.chunk("dog"), c.chunk("cat")
    c._young["cat"] = (other[0], own[1])
    n, ids, text = bpe_stream.digests(c, "a cat")
    want = c.encode("a dog")
    assert n == len(want) // 4 and ids == hashlib.sha256(want).hexdigest()
    machine = c.decoder()
    assert text == hashlib.sha256((machine.feed(array("I", want).tolist()) + machine.close()).encode()).hexdigest()


@pytest.mark.parametrize("text", [*HARD, "word é " * 5000])
def test_round_trip_digests(text, word):
    ids = word.encode(text, add_special_tokens=False).ids
    n, by_ids, by_text = bpe_stream.digests(bpe_stream.codec(), text)
    assert n == len(ids) and by_ids == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
    assert by_text == hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_decode_frames(odd, empty, word):
    out = bpe_stream.encode(odd.withColumnRenamed("lang", "ids"))
    assert out.columns == ["doc_id", "text", "ids", "source", "n_chars", "n_tokens", "ids_1"]
    rows = bpe_stream.decode(out, "ids_1").collect()
    for r in rows:
        ids = word.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.decoded == word.decode(ids, skip_special_tokens=False)
    assert bpe_stream.round_trip(empty.select("doc_id", "text")).count() == 0
    assert bpe_stream.round_trip(odd.select("doc_id", "text")).where("doc_id = 1").first().n_tokens == 0


def test_pieces():
    for n in range(1, 5000, 7):
        p = pow2_packing.pieces_of(n)
        assert sum(p) == n and all(x & (x - 1) == 0 and x <= 2048 for x in p) and p == sorted(p, reverse=True)
        assert len(p) == n // 2048 + bin(n % 2048).count("1")


def test_packing_equals_brute_force(odd, empty, byte, tmp_path):
    out = pow2_packing.pack(odd.withColumnRenamed("lang", "start"), max_len=64)
    assert out.columns == ["doc_id", "start", "source", "n_chars", "start_1", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"]
    rows = out.collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    got, want = [], []
    for r in rows:
        got.append((r.doc_id, r.start_1, r.length, r.ids_crc32, r.doc_tokens))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
    for r in odd.collect():
        ids = np.asarray([*byte.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for n in pow2_packing.pieces_of(len(ids), 64):
            want.append((r.doc_id, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
    assert sorted(got, key=str) == sorted(want, key=str)
    pow2_packing.write_buckets(out.select("ids", "length"), str(tmp_path / "b"))
    assert {p.name for p in (tmp_path / "b").glob("length=*")} == {f"length={n}" for n in {r.length for r in rows}}
    assert pow2_packing.pack(empty).count() == 0
