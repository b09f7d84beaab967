"""BPE encoding and decoding as streaming transducers.

**Encoder.** From the merge list we compute, per token, its *sufficient
lookahead*: how many further symbols must be seen before no continuation of
the text can change that token. A merge ``(u, v)`` can only be undone from the
right by an earlier merge that takes a right-edge part of ``v`` first, so

    wait(u, v) = max(wait of v's own merge,
                     max over earlier merges (v, c) of |c| + wait(v, c))

is a recurrence over the merges in order. The transducer buffers symbols,
runs the merges on the buffer, and emits the leading tokens whose wait lies
inside it. The buffer never exceeds ``2 * (longest wait + longest token)``
symbols, whatever the length of a word, so memory is constant.

**Decoder.** Token bytes go through an incremental UTF-8 state machine, which
holds back at most three bytes of an unfinished character. A vocabulary file
without a decoder joins the token strings with spaces, as its library does.

Most words are seen again and again: a worker keeps the transducer's output
for words in a bounded two-generation cache.

Edge cases: a null or empty text has no tokens and decodes to the empty text.
Strings of special tokens in a text become those tokens. Repeated rows give
equal results; all other columns stay, and an own column whose name is taken
gets a numbered one. An empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.llm.common import fresh, ship, slices_by_bytes, tokenizer_file

TOKENIZER = "word_bpe_49k.json"
#: bound of the word cache of one Python worker (entries, both generations)
CACHE_WORDS = 400_000
_NONE = 1 << 60

_SPACE = r"\p{White_Space}"
#: Python counts these as white space, Unicode doesn't
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _byte_alphabet() -> list[str]:
    """Printable stand-in of each byte: printable Latin-1 is itself, the
    other bytes follow from U+0100 upward."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Merges:
    """A merge list over integer token ids, with its sufficient lookahead."""

    def __init__(self, lengths: dict[int, int], merges: list[tuple[int, int, int]]):
        """``lengths``: symbols per token; ``merges``: (left, right, merged)."""
        self.pairs = {(a, b): (rank, c) for rank, (a, b, c) in reversed(list(enumerate(merges)))}
        self.length = lengths
        own: dict[int, int] = {}  # wait of the merge that makes a token
        then: dict[int, int] = {}  # most that a later merge of it with its right neighbour waits
        for a, b, c in merges:
            wait = max(own.get(b, 0), then.get(b, 0))
            own[c] = max(own.get(c, 0), wait)
            then[a] = max(then.get(a, 0), lengths[b] + wait)
        self.wait = {t: max(own.get(t, 0), then.get(t, 0)) for t in lengths}
        self.longest_wait = max(self.wait.values(), default=0)
        self.buffer = 2 * (self.longest_wait + max(lengths.values(), default=1))

    def apply(self, symbols: list[int]) -> list[int]:
        """All merges on a finite sequence: lowest rank first, then leftmost."""
        get = self.pairs.get
        nothing = (_NONE, -1)
        tokens = list(symbols)
        found = [get(p, nothing) for p in zip(tokens, tokens[1:])]
        while found:
            best = min(found)
            if best[0] == _NONE:
                break
            i = found.index(best)
            tokens[i] = best[1]
            del tokens[i + 1], found[i]
            if i:
                found[i - 1] = get((tokens[i - 1], best[1]), nothing)
            if i < len(found):
                found[i] = get((best[1], tokens[i + 1]), nothing)
        return tokens

    def stream(self, symbols: Iterator[int]) -> Iterator[int]:
        """Tokens of a sequence of any length, each emitted once no further
        symbol can change it."""
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if len(held) >= self.buffer:
                at = 0
                for t in self.apply(held):
                    if at + self.length[t] + self.wait[t] > len(held):
                        break
                    yield t
                    at += self.length[t]
                del held[:at]
        yield from self.apply(held)


class Codec:
    """Encoder and decoder of a BPE vocabulary file whose words end in a
    suffix mark (``</w>``) and whose symbols are bytes."""

    def __init__(self, tokenizer: str = TOKENIZER, cache_words: int = CACHE_WORDS):
        spec = json.load(open(tokenizer_file(tokenizer), encoding="utf-8"))
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        alphabet = _byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + end] for c in alphabet]
        size = {i: len(t[: -len(end)] if end and t.endswith(end) else t) for t, i in vocab.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(size, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = {i: t.encode() for t, i in (vocab | self.special).items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._words = regex.compile(pattern.replace(r"\s", _SPACE), regex.V0)
        self._gaps = regex.compile(_SPACE + "+")
        self._limit = cache_words // 2
        self._young: dict[str, tuple[bytes, bytes]] = {}
        self._old: dict[str, tuple[bytes, bytes]] = {}

    def _word(self, word: bytes) -> Iterator[int]:
        for b in word[:-1]:
            yield self.inner[b]
        yield self.last[word[-1]]

    def _split(self, text: str) -> list[str]:
        """The words of a chunk. Code points without a category in Python's
        Unicode tables are neither letters nor digits, whatever newer tables
        say."""
        if text.isascii():
            return self._words.findall(text)
        known = "".join([c if unicodedata.category(c) != "Cn" else "\ufffe" for c in text])
        return [text[m.start() : m.end()] for m in self._words.finditer(known)]

    def chunk(self, text: str) -> tuple[bytes, bytes]:
        """Ids and joined token strings of a text without white space."""
        known = self._old.get(text)
        if known is None:
            ids: list[int] = []
            words = (text,) if text.isalpha() and len(text) < 64 else self._split(text)
            for word in words:
                raw = word.encode()
                if len(raw) < self.merges.buffer:  # the stream would hold it whole
                    inner = self.inner
                    symbols = [inner[b] for b in raw]
                    symbols[-1] = self.last[raw[-1]]
                    ids += self.merges.apply(symbols)
                else:
                    ids += self.merges.stream(self._word(raw))
            token = self.token
            known = (array("I", ids).tobytes(), b" ".join([token[i] for i in ids]))
            if len(text) > 64:
                return known
        if len(self._young) >= self._limit:  # two generations: what was used lately stays
            self._old.clear()
            self._old.update(self._young)
            self._young.clear()
        self._young[text] = known
        return known

    def chunks(self, text: str) -> Iterator[list[tuple[bytes, bytes]]]:
        """Per stretch between special tokens, its chunks' outputs in order."""
        parts = self._special.split(text) if self._special and "<|" in text else [text]
        for part in parts:
            if part in self.special:
                i = self.special[part]
                yield [(array("I", [i]).tobytes(), self.token[i])]
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            words = self._gaps.split(part.lower()) if _ODD_SPACE.search(part) else part.lower().split()
            get, chunk = self._young.get, self.chunk
            yield [get(w) or chunk(w) for w in words if w]

    def encode(self, text: str) -> bytes:
        return b"".join(ids for part in self.chunks(text) for ids, _ in part)

    def decoder(self) -> Decoder:
        return Decoder(self.token)


class Decoder:
    """Incremental byte-to-text state machine: ``feed`` takes ids or the
    joined bytes of several tokens and returns the text that is certain."""

    def __init__(self, token: dict[int, bytes]):
        self._token = token
        self._utf8 = codecs.getincrementaldecoder("utf-8")(errors="replace")
        self._begun = False

    def feed_bytes(self, joined: bytes) -> str:
        if not joined:
            return ""
        if self._begun:
            joined = b" " + joined
        self._begun = True
        return self._utf8.decode(joined)

    def feed(self, ids: Iterable[int]) -> str:
        return self.feed_bytes(b" ".join(map(self._token.__getitem__, ids)))

    def close(self) -> str:
        return self._utf8.decode(b"", True)


_CODECS: dict[str, Codec] = {}


def codec(tokenizer: str = TOKENIZER) -> Codec:
    """The worker's codec of a vocabulary file, kept between tasks."""
    if tokenizer not in _CODECS:
        _CODECS[tokenizer] = Codec(tokenizer)
    return _CODECS[tokenizer]


def _map_text(docs: DataFrame, text: str, own: list[T.StructField], row: Callable[[str], tuple], keep_text: bool) -> DataFrame:
    """Append the columns that ``row`` makes from each text."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)
    names = docs.columns
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    own = [T.StructField(fresh([f.name for f in kept], f.name), f.dataType) for f in own]
    schema = T.StructType([*kept, *own])
    types = [T_TO_ARROW[type(f.dataType)] for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_by_bytes(batches, names[at], 8_000_000):
            made = [row(v or "") for v in batch.column(at).to_pylist()]
            arrays = [c for k, c in enumerate(batch.columns) if keep_text or k != at]
            arrays += [pa.array([m[k] for m in made], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


T_TO_ARROW = {T.LongType: pa.int64(), T.StringType: pa.string(), T.BinaryType: pa.binary()}


def encode(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """All columns, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit)."""

    def row(value: str) -> tuple:
        ids = codec(tokenizer).encode(value)
        return len(ids) // 4, ids

    return _map_text(docs, text, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())], row, True)


def decode(encoded: DataFrame, ids: str = "ids", tokenizer: str = TOKENIZER, out: str = "decoded") -> DataFrame:
    """All columns and the decoded text; null ids decode to the empty text."""
    ship(encoded.sparkSession)

    @F.pandas_udf("string")
    def run(column):
        import pandas as pd

        def one(raw: bytes | None) -> str:
            machine = codec(tokenizer).decoder()
            numbers = array("I", raw or b"")
            done = [machine.feed(numbers[k : k + 4096].tolist()) for k in range(0, len(numbers), 4096)]
            return "".join(done) + machine.close()

        return pd.Series([one(v) for v in column])

    return encoded.withColumn(fresh(encoded.columns, out), run(F.col(f"`{ids}`")))


def digests(c: Codec, text: str) -> tuple[int, str, str]:
    """Number of tokens, digest of the ids and digest of the text decoded
    from these ids."""
    ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
    machine = c.decoder()
    for part in c.chunks(text):
        for k in range(0, len(part), 4096):
            ids = b"".join([x[0] for x in part[k : k + 4096]])
            n += len(ids) // 4
            ids_hash.update(ids)
            text_hash.update(machine.feed(array("I", ids)).encode())
    text_hash.update(machine.close().encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def round_trip(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Encode and decode in one pass and return digests in place of the
    text: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""

    def row(value: str) -> tuple:
        return digests(codec(tokenizer), value)

    own = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _map_text(docs, text, own, row, False)
