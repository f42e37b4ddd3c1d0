"""Irregular readings onto a regular daily grid; gaps filled by low-rank factorisation (alternating least squares).

The matrix has one row per series and one column per day. A cell's estimate is the series' mean plus the product of a
series factor and a day factor of rank `rank`. Day factors are as many as there are days with enough readings, wherever in the calendar
they lie, and a DATE has 3.7 million at most, so they can be sent to every task; series are never gathered anywhere.
Observed cells keep their reading to the bit. Cells whose series or day has too few readings to tell its factors stay marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarv.functions.arrow import slices
from skarv.runtime import cut

#: Series whose grids a worker makes at a time.
ROWS = 500


def readings(df: DataFrame, keys: list[str], date: str, value: str, low: float, high: float | None) -> DataFrame:
    """One row per key and date that has a reading: a number from low to high. Rows without date are left out."""
    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (v >= low) & (v <= high if high is not None else v < float("inf"))
    return df.filter(F.col(date).isNotNull() & ok).select(*keys, F.col(date).alias("date"), v.alias("value"))


def _solve(outer: np.ndarray, right: np.ndarray, counts: np.ndarray, ridge: float) -> np.ndarray:
    k = right.shape[1]
    return np.linalg.solve(outer + (ridge * np.maximum(counts, 1))[:, None, None] * np.eye(k), right[:, :, None])[:, :, 0]


def _held_out(days: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """About a tenth of the cells, the same ones in every pass."""
    place = np.arange(len(days)) - np.repeat(starts, np.diff(np.append(starts, len(days))))
    mixed = (days.astype(np.uint64) * np.uint64(2654435761) + place.astype(np.uint64) * np.uint64(40503)) >> np.uint64(7)
    return mixed % np.uint64(10) == 0


def _series_step(days: np.ndarray, values: np.ndarray, starts: np.ndarray, factors: np.ndarray, ridge: float, scale: float, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(means, factors of series, residuals over scale, used cells) of packed series, from the cells in use; starts: where each begins."""
    counts = np.diff(np.append(starts, len(values)))
    used = np.add.reduceat(use.astype(np.int64), starts)
    means = np.add.reduceat(np.where(use, values, 0.0), starts) / np.maximum(used, 1)
    rest = (values - np.repeat(means, counts)) / scale
    v = factors[days] * use[:, None]
    outer = np.add.reduceat(v[:, :, None] * v[:, None, :], starts, axis=0)
    right = np.add.reduceat(v * rest[:, None], starts, axis=0)
    return means, _solve(outer, right, used, ridge), rest, used


def _index(days: np.ndarray, calendar: np.ndarray) -> np.ndarray:
    """Days as factor rows; those that aren't in the calendar have the last row, which is zero."""
    at = np.searchsorted(calendar, days)
    there = at < len(calendar)
    there[there] = calendar[at[there]] == days[there]
    return np.where(there, at, len(calendar))


def _packed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("cells")
    offsets = lists.offsets.to_numpy()
    cells = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    return cells.field("d").to_numpy(zero_copy_only=False), cells.field("v").to_numpy(zero_copy_only=False), (offsets[:-1] - offsets[0]).astype(np.int64)


def als_factors(packed: DataFrame, calendar: np.ndarray, rank: int, iterations: int, ridge: float, seed: int, min_support: int, scale: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(day factors, readings per day, trust) by alternating least squares; runs one job per iteration, one for trust, and one more
    iteration with all cells where the factors are to be believed. calendar: the days that get factors, in order.

    A job solves every series against the day factors and adds up the days' normal equations, first within a task, then over
    tasks; the driver gets a row for each day of 1 + rank + rank squared numbers. A tenth of the cells is held out: trust (0..1) is how far
    the factors' part of their residuals is to be believed, by least squares. Readings without a common shape get 0.
    """
    rng = np.random.default_rng(seed)
    n_days = len(calendar)
    t = (calendar - calendar[0])[:, None].astype(float) if n_days else np.zeros((0, 1))
    length = float(t[-1, 0]) + 1 if n_days else 1.0
    # smooth starting shapes: a trend and waves of a week, a month, a quarter
    waves = [(t - length / 2) / length] + [f(2 * np.pi * t / p) for p in (7.0, 30.4, 91.3, 365.25) for f in (np.sin, np.cos)]
    factors = np.hstack(waves)[:, :rank] + rng.normal(0, 0.05, (n_days, min(rank, len(waves))))
    factors = np.vstack([factors, np.zeros((1, factors.shape[1]))])  # the row of days outside
    support = np.zeros(n_days + 1, np.int64)
    k = factors.shape[1]

    def steps(batches: Iterator[pa.RecordBatch], factors: np.ndarray, hold: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
        """Days, residuals, series factors by cell, cells of well-read series within the calendar, held-out cells (none without hold)."""
        for batch in batches:
            if batch.num_rows:
                days, values, starts = _packed(batch)
                held = _held_out(days, starts) & hold
                days = _index(days, calendar)
                _, u, rest, used = _series_step(days, values, starts, factors, ridge, scale, ~held)
                counts = np.diff(np.append(starts, len(values)))
                yield days, rest, np.repeat(u, counts, axis=0), np.repeat(used >= min_support, counts) & (days < n_days), held

    def iterate(factors: np.ndarray, hold: bool = True) -> tuple[np.ndarray, np.ndarray] | None:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            outer, right, n, seen = np.zeros((n_days, k, k)), np.zeros((n_days, k)), np.zeros(n_days), np.zeros(n_days)
            for days, rest, each, fit, held in steps(batches, factors, hold):
                seen += np.bincount(days[fit], minlength=n_days)
                fit = fit & ~held
                d, r, each = days[fit], rest[fit], each[fit]
                n += np.bincount(d, minlength=n_days)
                for i in range(k):
                    right[:, i] += np.bincount(d, each[:, i] * r, minlength=n_days)
                    for j in range(k):
                        outer[:, i, j] += np.bincount(d, each[:, i] * each[:, j], minlength=n_days)
            hit = np.flatnonzero(seen)
            flat = np.hstack([seen[hit, None], n[hit, None], right[hit], outer[hit].reshape(len(hit), k * k)])
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(list(flat), pa.list_(pa.float64()))], ["d", "s"])

        rows = packed.mapInArrow(sums, "d int, s array<double>")
        got = rows.groupBy("d").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(2 + k + k * k)]).toPandas().to_numpy()
        if not len(got):
            return None
        at = got[:, 0].astype(int)
        found, support = np.zeros_like(factors), np.zeros(n_days + 1, np.int64)
        found[at] = _solve(got[:, 3 + k :].reshape(-1, k, k), got[:, 3 : 3 + k], got[:, 2], ridge)
        support[at] = got[:, 1]
        return found, support

    for _ in range(iterations):
        got = iterate(factors)
        if got is None:
            return factors, support, 0.0
        factors, support = got

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, own = 0.0, 0.0
        for days, rest, each, fit, held in steps(batches, factors):
            cell = fit & held
            guess = np.einsum("ij,ij->i", each[cell], factors[days[cell]])
            both, own = both + float(guess @ rest[cell]), own + float(guess @ guess)
        yield pa.RecordBatch.from_arrays([pa.array([both]), pa.array([own])], ["b", "o"])

    b, o = packed.mapInArrow(judge, "b double, o double").agg(F.sum("b"), F.sum("o")).first()
    trust = float(np.clip(b / o, 0.0, 1.0)) if o else 0.0
    last = iterate(factors, hold=False) if trust > 0 else None  # the held-out cells join in
    return (*(last or (factors, support)), trust)


def _variance(v: Column) -> Column:
    """Variance of a list of numbers with two or more; else null."""
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n > 1, F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) / n - mean * mean)


def regular_grid(readings: DataFrame, keys: list[str], low: float, high: float | None, rank: int = 3, iterations: int = 4, ridge: float = 0.05, min_series: int = 4, min_day: int = 3, seed: int = 7) -> DataFrame:
    """One row per series and day from its first to its last reading: keys, date, value, state.

    readings: keys, date, value – one row per series and date (see `readings`). state: observed (value is the reading),
    filled (an estimate, kept within low..high), unsupported (value null: the series has under min_series readings or the day
    under min_day series). A series with one reading gives one row; an empty table none. Null keys form series like any other.
    Runs a job to pack the series, two for their spread and days, one per iteration, one that
    weighs the factors on held-out cells and one for the last factors. A series' cells are packed into one row: at
    most one per calendar day. Estimates may differ in the last digits between runs, as sums
    are added in another order; dates and states don't.
    """
    packed = cut(readings.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.datediff("date", F.lit("1970-01-01")).alias("d"), F.col("value").alias("v")))).alias("cells")), "packed-series")
    spread = packed.agg(F.avg(_variance(F.col("cells.v")))).first()[0]
    often = packed.select(F.explode("cells.d").alias("d")).groupBy("d").agg(F.count("*").alias("n")).filter(F.col("n") >= min_day).select("d").toArrow()
    calendar = np.sort(often.column("d").to_numpy().astype(np.int64))
    out = f"{', '.join(f'`{k}` {packed.schema[k].dataType.simpleString()}' for k in keys)}, grid array<struct<date:date,value:double,state:string>>"
    scale = float(np.sqrt(spread)) if spread and spread > 0 else 1.0
    factors, support, trust = als_factors(packed, calendar, rank, iterations, ridge, seed, min_series, scale)
    top = np.inf if high is None else high

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            if not batch.num_rows:
                continue
            days, values, starts = _packed(batch)
            means, u, *_ = _series_step(_index(days, calendar), values, starts, factors, ridge, scale, np.ones(len(days), bool))
            ends = np.append(starts[1:], len(values))
            lengths = days[ends - 1] - days[starts] + 1
            offsets = np.append(0, np.cumsum(lengths))
            of = np.repeat(np.arange(len(starts)), lengths)
            grid = np.arange(offsets[-1]) - offsets[of] + days[starts][of]
            at = _index(grid, calendar)
            estimate = np.clip(means[of] + trust * scale * np.einsum("ij,ij->i", u[of], factors[at]), low, top)
            counts = ends - starts
            state = np.where((counts[of] >= min_series) & (support[at] >= min_day), 1, 2)
            cell = np.repeat(offsets[:-1] - days[starts], counts) + days
            estimate[cell], state[cell] = values, 0
            names = pa.DictionaryArray.from_arrays(pa.array(state, pa.int8()), pa.array(["observed", "filled", "unsupported"])).cast(pa.string())
            cells = pa.StructArray.from_arrays([pa.array(grid.astype(np.int32), pa.int32()).cast(pa.date32()), pa.array(estimate, mask=state == 2), names], ["date", "value", "state"])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells)], [*keys, "grid"])

    return packed.mapInArrow(fill, out).select(*keys, F.inline("grid"))


def missing_days(grid: DataFrame) -> Column:
    """Condition: the cell has no reading."""
    return F.col("state") != "observed"
