"""Blocks: runs of documents that travel as one compressed row.

Operators that look at every position of a corpus work on blocks: about
``BLOCK_BYTES`` of text with all columns of its rows, as compressed Arrow
batches of at most ``SLICE_BYTES``. A block is small enough for one task and
large enough for vector arithmetic. Blocks are checkpointed once; later steps
send keys of their positions to shards by key value, learn there which keys
repeat, and get a bit per key back. So what crosses the network is a few bytes
per key, no task holds more than a shard or a block, and a key that is found
everywhere counts once per block.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import cut, ship, slices_by_bytes

SLICE_BYTES = 1_000_000
BLOCK_BYTES = 12_000_000
BLOCK_SCHEMA = "block long, n_bytes long, data binary"


def to_blocks(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Blocks of a table, checkpointed. A row whose text is longer than a
    slice is a slice of its own."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in held:
                    w.write_batch(b)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | nth], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue()], pa.binary())],
                names=["block", "n_bytes", "data"],
            )

        for piece in slices_by_bytes(batches, text, slice_bytes):
            n = int(pa.compute.sum(pa.compute.binary_length(piece.column(piece.schema.get_field_index(text)))).as_py() or 0)
            if held and size + n > block_bytes:
                yield block()
                nth, held, size = nth + 1, [], 0
            held.append(piece)
            size += n
        if held:
            yield block()

    return cut(docs.mapInArrow(run, BLOCK_SCHEMA))


def open_block(data: bytes) -> list[pa.RecordBatch]:
    with pa.ipc.open_stream(io.BytesIO(data)) as r:
        return list(r)


def texts_of(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """UTF-8 texts of a batch; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
    return [v or b"" for v in col.to_pylist()]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed row; bytes of equal weight lie together."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(struct.pack("<2sQ", a.dtype.str[1:].encode().ljust(2), len(a)))
        out.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 1, []
    for _ in range(raw[0]):
        kind, n = struct.unpack_from("<2sQ", raw, at)
        at += 10
        dtype = np.dtype("<" + kind.decode().strip())
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += n * dtype.itemsize
    return out


def by_shard(shard: np.ndarray, n_shards: int) -> list[slice]:
    """Slices of the runs of each shard; ``shard`` is sorted."""
    edges = np.searchsorted(shard, np.arange(n_shards + 1))
    return [slice(int(a), int(b)) for a, b in zip(edges, edges[1:])]


def shards_for(total_bytes: int, per_shard: int) -> int:
    """A power of two of shards, so that each has ``per_shard`` bytes of text
    or fewer behind it."""
    n = 1
    while n * per_shard < total_bytes:
        n *= 2
    return n


def total_bytes(blocks: DataFrame) -> int:
    return int(blocks.agg(F.sum("n_bytes")).first()[0] or 0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial hashes (modulo 2**64) of ranges, from prefix sums."""

    def __init__(self, base: int):
        self._base, self._inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            made = []
            for b in (self._base, self._inverse):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
            self._up, self._down = made
        return self._up[:n], self._down[:n]

    def ranges(self, values: np.ndarray, start: np.ndarray | slice, length: np.ndarray | int) -> np.ndarray:
        """Hash of ``values[s : s + length]`` for every start."""
        n = len(values)
        up, down = self._powers(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=prefix[1:])
        if isinstance(start, slice):
            return (prefix[length:] - prefix[: n + 1 - length]) * down[: n + 1 - length]
        return (prefix[start + length] - prefix[start]) * down[start]
