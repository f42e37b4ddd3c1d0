"""Stateful operators on event streams, with batch forms of the same rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Accepted requests per window, and the window in seconds.
LIMIT, WINDOW = 5, 600


def _admit(times: list[int], taken: list[int], limit: int, window: int) -> tuple[list[bool], list[int]]:
    """Which times (microseconds, ascending) are accepted, and the accepted ones still in the window. Rejected ones don't count."""
    out = []
    for t in times:
        taken = [x for x in taken if x > t - window * 1_000_000]
        ok = len(taken) < limit
        if ok:
            taken.append(t)
        out.append(ok)
    return out, taken


def rate_limited(events: DataFrame, key: str, ts: str, id_column: str, limit: int = LIMIT, window: int = WINDOW) -> DataFrame:
    """key, id, accepted of a batch: at most `limit` accepted events of a key within `window` seconds before each.

    Whether one is accepted depends on those before, so a key's events are folded in order. A hot key isn't gathered: events
    are sorted within partitions of keys and folded while they stream by, with `limit` times as state. Null keys or times are left out.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, id_column)}
    rows = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, id_column, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    ordered = rows.repartition(key).sortWithinPartitions(key, "_t", id_column)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, taken = None, []
        for pdf in parts:
            ok = []
            for k, t in zip(pdf[key], pdf["_t"], strict=True):
                if k != current:
                    current, taken = k, []
                (one,), taken = _admit([t], taken, limit, window)
                ok.append(one)
            yield pd.DataFrame({key: pdf[key], id_column: pdf[id_column], "accepted": ok})

    return ordered.mapInPandas(fold, f"`{key}` {kinds[key]}, `{id_column}` {kinds[id_column]}, accepted boolean")


def rate_limited_stream(events: DataFrame, key: str, ts: str, id_column: str, limit: int = LIMIT, window: int = WINDOW) -> DataFrame:
    """The same on a stream: state is the accepted times within the window, dropped after a window without events.

    Events of one micro-batch are taken in order of time, then id; later batches as they come.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, id_column)}

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(parts)).sort_values(["_t", id_column])
        ok, taken = _admit(pdf["_t"].tolist(), taken, limit, window)
        state.update((taken,))
        state.setTimeoutDuration(window * 1000)
        yield pd.DataFrame({key: pdf[key], id_column: pdf[id_column], "accepted": ok})

    rows = events.select(key, id_column, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    return rows.groupBy(key).applyInPandasWithState(fold, f"`{key}` {kinds[key]}, `{id_column}` {kinds[id_column]}, accepted boolean", "taken array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest_progress(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """key, value: the last value of each key by time; of equal times the greatest value. Works on batches and in foreachBatch."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(ts, value)).alias(value))


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, key, n, total per window; on a stream, events later than `late` are dropped by the watermark."""
    on = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if on.isStreaming:
        on = on.withWatermark("_ts", late)
    return on.groupBy(F.window("_ts", size).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def upsert_stream(stream: DataFrame, path: str, keys: list[str], by: str, checkpoint: str):
    """Start a query that keeps `path` as the last delivery of each key: every micro-batch is merged into a new version.

    Versions lie in path/v=N; a reader takes the highest complete one. A batch that is run again writes the same version.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if n:
            rows = spark.read.parquet(f"{path}/v={n - 1}").unionByName(batch)
        values = [c for c in batch.columns if c not in (*keys, by)]
        last = rows.groupBy(*keys).agg(F.max(F.struct(by, *values)).alias("m"))
        last.select(*keys, "m.*").write.mode("overwrite").parquet(f"{path}/v={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
