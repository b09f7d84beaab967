"""Live history (L1): each user's newest entries, kept as keyed state.

A stream of entries is grouped by user; the state of a user is the newest
``keep`` entries (time, id), so it stays bounded whatever arrives. An entry
that is already there (a replay) or older than all ``keep`` changes nothing; new
ones are put out and appended to the sink. A busy user's entries are dealt over
``salts`` states, so no task meets all of them, and ``history`` takes the newest
of these few lists. With ``idle``, a timer drops the state of users who have been
silent for that long. Its clock is a watermark on the time of arrival, not on the
entries' own time, so late entries aren't dropped. What such users had stays in
the sink.

A restart goes on from the checkpoint. Batches that run twice, replayed files
and expired state can only append an entry again, and ``history`` counts equal
entries once, so it always equals the newest ``keep`` of everything that came.
Entries without a time are the oldest; equal times go by id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import top_k_per_group

KEEP, SALTS = 50, 8
#: stands for a missing time
NO_TIME = -(1 << 62)
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}


def _millis(span: str) -> int:
    n, unit = re.fullmatch(r"(\d+) (second|minute|hour|day)s?", span).groups()
    return int(n) * _UNITS[unit] * 1000


def recent_entries(stream: DataFrame, user: str, entry: str, ts: str, keep: int = KEEP, salts: int = SALTS, idle: str | None = None) -> DataFrame:
    """The stream of entries that enter a user's newest ``keep``: (user, entry,
    ``ts_us``). ``ts`` is a timestamp, ``entry`` a whole number that names the
    row; ``idle`` is a span such as ``30 days``."""
    wait = _millis(idle) if idle else None
    kind = stream.schema[user].dataType.simpleString()
    micros = F.coalesce(F.unix_micros(F.col(ts)), F.lit(NO_TIME))
    if idle:
        stream = stream.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds")
    rows = stream.select(F.col(user).alias("user"), F.pmod(F.xxhash64(F.col(entry)), F.lit(salts)).cast("int").alias("salt"),
                         F.col(entry).cast("long").alias("entry"), micros.alias("ts_us"), *(["arrived"] if idle else []))

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        known = {i for _, i in held}
        best = sorted((-int(t), int(i)) for t, i in held)
        for part in parts:
            best = sorted({*best, *((-int(t), int(i)) for t, i in zip(part["ts_us"], part["entry"]))})[:keep]
        state.update(([-t for t, _ in best], [i for _, i in best]))
        if wait is not None:
            state.setTimeoutTimestamp(max(state.getCurrentProcessingTimeMs(), state.getCurrentWatermarkMs()) + wait)
        fresh = [(i, -t) for t, i in best if i not in known]
        if fresh:
            yield pd.DataFrame({"user": [key[0]] * len(fresh), "entry": [i for i, _ in fresh], "ts_us": [t for _, t in fresh]})

    return rows.groupBy("user", "salt").applyInPandasWithState(
        update, f"user {kind}, entry bigint, ts_us bigint", "ts array<bigint>, ids array<bigint>", "update",
        "EventTimeTimeout" if idle else "NoTimeout")


def history(sink: DataFrame, keep: int = KEEP) -> DataFrame:
    """Each user's newest ``keep`` entries from what ``recent_entries`` put
    out: (user, entry, ts_us, rank)."""
    rows = sink.select("user", "entry", "ts_us").distinct()
    t = top_k_per_group(rows, ["user"], [F.desc("ts_us"), F.asc("entry")], keep)
    return t.withColumn("ts_us", F.when(F.col("ts_us") != NO_TIME, F.col("ts_us")))
