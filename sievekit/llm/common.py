"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sievekit.session import checkpoint_dir

#: code points that end a word: the six ASCII white-space characters
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so Python
    tasks can import it wherever the driver was started from."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="sievekit-ship-"), "sievekit_src.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def read_docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """One input table, as it is scanned (no repartition)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in ``spark.checkpoint.dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(names: list[str], wanted: str) -> str:
    """``wanted``, or the first ``wanted_k`` that no given column has
    (names compare without case, as Spark resolves them)."""
    taken = {n.lower() for n in names}
    if wanted.lower() not in taken:
        return wanted
    k = 1
    while f"{wanted}_{k}".lower() in taken:
        k += 1
    return f"{wanted}_{k}"


def split_words(text: bytes) -> list[bytes]:
    """The runs of ``[^\\x20\\x09-\\x0D]`` of a UTF-8 text (``bytes.split``
    cuts at exactly the six ASCII white-space bytes)."""
    return text.split()


def struct_of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def slices_by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose ``column`` holds at most ``limit``
    bytes (one row may exceed it), so a task works in bounded memory."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
            sizes = pa.compute.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            sizes = np.asarray([len(v or b"") for v in col.cast(pa.binary()).to_pylist()], dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + limit, side="right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


_PLACES = re.compile(r"^[A-Za-z0-9_.-]+$")


def tokenizer_file(name: str) -> str:
    """Path of an installed public tokenizer file; looked up where it is
    used, so every executor reads its own installation."""
    if not _PLACES.match(name):
        return name  # already a path
    import public_tokenizers

    return public_tokenizers.path(name)
