"""Stateful rules, at rest and on a stream."""

import datetime as dt
import random

import pytest

from skarv.streaming.state import latest_progress, rate_limited, rate_limited_stream, upsert_stream, windowed_counts

T = dt.datetime(2026, 1, 1)
DDL = "id bigint, who string, ts timestamp, value double"


def brute(rows, limit, window):
    out, taken = {}, {}
    for i, who, ts, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        mine = [x for x in taken.get(who, []) if x > ts - dt.timedelta(seconds=window)]
        out[i] = len(mine) < limit
        taken[who] = mine + [ts] * out[i]
    return out


def events(n=120):
    rnd = random.Random(n)
    return [(i, rnd.choice("abc"), T + dt.timedelta(seconds=rnd.randint(0, 2000)), float(i)) for i in range(n)]


def test_limits_count_accepted_events_only(spark):
    rows = events()
    df = spark.createDataFrame([*rows, (999, None, T, 1.0), (998, "a", None, 1.0)], DDL)
    got = {r.id: r.accepted for r in rate_limited(df, "who", "ts", "id", 5, 600).collect()}
    assert got == brute(rows, 5, 600)
    assert rate_limited(df.limit(0), "who", "ts", "id").count() == 0


@pytest.fixture
def ending(spark):
    """A time-out in the state asks for batches without data for ever; without them a query over all that is there ends."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_stream_gives_the_same(spark, tmp_path, ending):
    rows = sorted(events(60), key=lambda r: r[2])
    src = f"{tmp_path}/in"
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(DDL).parquet(src)
        q = rate_limited_stream(stream, "who", "ts", "id", 5, 600).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert q.awaitTermination(60)
    got = {r.id: r.accepted for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == brute(rows, 5, 600)


def test_upsert_stream_keeps_the_last(spark, tmp_path):
    for n, part in enumerate(([(1, "a", T, 1.0), (2, "b", T, 1.0)], [(1, "a", T + dt.timedelta(1), 2.0), (2, "b", T - dt.timedelta(1), 9.0)])):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = upsert_stream(spark.readStream.schema(DDL).parquet(f"{tmp_path}/in"), f"{tmp_path}/t", ["id"], "ts", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    last = spark.read.parquet(f"{tmp_path}/t/v=1")
    assert {(r.id, r.value) for r in last.collect()} == {(1, 2.0), (2, 1.0)}


def test_progress_and_windows(spark):
    df = spark.createDataFrame([(1, "a", T, 1.0), (2, "a", T + dt.timedelta(1), 5.0), (3, "b", T, 2.0)], DDL)
    assert {(r.who, r.value) for r in latest_progress(df, "who", "ts", "value").collect()} == {("a", 5.0), ("b", 2.0)}
    assert windowed_counts(df, "ts", "who", "value").count() == 3
