"""Splittable reading of CSV whose quoted fields hold newlines.

Spark's ``multiLine`` reader takes a file as a whole in one task. Here a file is
read by byte ranges, as plain text lines, like any splittable file:

1. **State pass.** A line break ends a record only outside quotes. Each range
   finds, for both possible states at its start (outside or inside a quoted
   field), the state at its end; a line without quotes changes nothing. One
   small row a range goes to the driver, which chains them: now it is known
   which ranges begin inside a quoted field, and where that record began.
2. **Record pass.** Each range joins its lines to records. The lines before its
   first record and after its last one are pieces of records that cross a
   border.
3. **Borders.** The pieces (two a range at most) are put together by the range
   in which their record began.

Records then go through Spark's own CSV parser. What a task holds is one record.
The header is the first record of each file. Line breaks are ``\\n`` or ``\\r\\n``;
in a file of the latter kind they become ``\\n`` in fields too, as the multi-line
reader has it. Empty lines between records are skipped.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prefix import ship

_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*')
RECORD, HEADER, PIECE, HEADER_PIECE = 0, 1, 2, 3


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Is the end of ``line`` inside a quoted field? A quote opens a field
    only as its first character; within one, a doubled quote is a quote."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside or line.startswith('"', at):
            at = _QUOTED.match(line, at if inside else at + 1).end()
            if at == len(line):
                return True
            inside = False
        at = line.find(sep, at) + 1
        if not at:
            return False


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """(file, start, lines) of each byte range, as the scan delivers them."""
    def rows():
        for b in batches:
            yield from zip(b.column("file").to_pylist(), b.column("start").to_pylist(), b.column("value").to_pylist())

    it = rows()
    held = next(it, None)
    while held is not None:
        key = held[:2]

        def lines():
            nonlocal held
            while held is not None and held[:2] == key:  # noqa: B023
                line = held[2]
                held = next(it, None)
                yield line

        yield (*key, lines())
        while held is not None and held[:2] == key:
            held = next(it, None)


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, start, lines in _ranges(batches):
        out, inn, cr, closed = False, True, None, False
        for line in lines:
            cr = line.endswith("\r") if cr is None else cr
            if '"' in line:
                out, inn = ends_inside(line, out), ends_inside(line, inn)
            closed |= not inn
        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start], pa.int64()), *[pa.array([bool(v)]) for v in (out, inn, closed, cr)]],
                                         names=["file", "start", "out", "inn", "closed", "cr"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the CSV files under ``path`` but for the headers, as
    text: (file, record)."""
    ship(spark)
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), "value")
    by_file: dict[str, list] = defaultdict(list)
    for r in lines.mapInArrow(_states, "file string, start bigint, out boolean, inn boolean, closed boolean, cr boolean").collect():  # a row a range
        by_file[r["file"]].append(r)
    began: dict[tuple[str, int], int] = {}  # ranges that begin inside a record: where that record began
    windows = set()
    for file, ranges in by_file.items():
        ranges.sort(key=lambda r: r["start"])
        if ranges[0]["cr"]:
            windows.add(file)
        inside, owner = False, 0
        for r in ranges:
            if inside:
                began[file, r["start"]] = owner
            if not inside or r["closed"]:  # a record that is open at the end began here
                owner = r["start"]
            inside = r["inn"] if inside else r["out"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    names = ["file", "kind", "owner", "start", "record"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for file, start, lines in _ranges(batches):
            inside = (file, start) in began
            piece, header = inside, start == 0
            part: list[str] = []
            for line in lines:
                part.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    text = "\n".join(part)
                    part = []
                    if piece:
                        rows.append((file, PIECE, began[file, start], start, text))
                        piece = False
                    elif text.strip("\r"):
                        rows.append((file, HEADER if header else RECORD, start, start, text))
                        header = False
                    size += len(text)
                    if size > 1_000_000 and rows:
                        yield batch(rows)
                        rows, size = [], 0
            if part:  # open at the range's end
                owner = began[file, start] if piece else start
                rows.append((file, HEADER_PIECE if header and not piece else PIECE, owner, start, "\n".join(part)))
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    parts = lines.mapInArrow(join, "file string, kind int, owner bigint, start bigint, record string")
    whole = parts.where(F.col("kind") == RECORD).select("file", "record")
    if began:
        whole = whole.unionByName(_bordering(parts))
    if windows:
        crlf = F.col("file").isin(list(windows)) if len(windows) < len(by_file) else F.lit(True)
        whole = whole.withColumn("record", F.when(crlf, F.regexp_replace(F.rtrim("record", F.lit("\r")), "\r\n", "\n")).otherwise(F.col("record")))
    return whole


def _bordering(parts: DataFrame) -> DataFrame:
    """Records that cross borders of ranges, put together from their pieces."""
    pieces = parts.where(F.col("kind") >= PIECE)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda p: p["record"]), "\n")
    return (pieces.groupBy("file", "owner").agg(F.max("kind").alias("kind"), text.alias("record"))
            .where(F.col("kind") == PIECE).select("file", "record"))


def read_csv_records(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Headed CSV with quoted multi-line fields (doubled quotes as escapes) as
    a table of ``schema``, read by as many tasks as the files have ranges."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    row = F.from_csv("record", ddl, {"quote": '"', "escape": '"', "sep": sep, "mode": "PERMISSIVE"})
    return read_records(spark, path).select(row.alias("r")).select("r.*")
