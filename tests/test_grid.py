"""p2 and p4: regular grids and rolling totals."""

import datetime as dt
import math
import random

import numpy as np

from skarv.operators.grid import readings, regular_grid
from skarv.operators.rolling import RollingState, rolling_totals

D0 = dt.date(2026, 1, 1)


def d(n):
    return D0 + dt.timedelta(days=n)


def grid(spark, rows, **k):
    df = spark.createDataFrame(rows, "s string, date date, value double, state string")  # state: a clashing name
    return regular_grid(readings(df, ["s"], "date", "value", k.pop("low", 0.0), k.get("high")), ["s"], 0.0, k.pop("high", None), **k).collect()


def test_observed_stay_and_gaps_are_marked(spark):
    rows = [("a", d(0), 5.0, "x"), ("a", d(3), 7.0, "x"), ("one", d(1), 1.0, "x"), ("a", None, 3.0, "x"), ("a", d(2), float("nan"), "x"), ("a", d(1), None, "x"), ("a", d(9), -1.0, "x"), (None, d(0), 2.0, "x"), (None, d(2), 2.0, "x")]
    got = {(r.s, r.date): (r.value, r.state) for r in grid(spark, rows)}
    assert got["a", d(0)] == (5.0, "observed") and got["a", d(3)] == (7.0, "observed")
    assert {k for k, v in got.items() if v[1] != "observed"} == {("a", d(1)), ("a", d(2)), (None, d(1))}
    assert all(v == (None, "unsupported") for k, v in got.items() if v[1] != "observed")
    assert len([k for k in got if k[0] == "one"]) == 1


def test_empty(spark):
    assert grid(spark, []) == []


def test_low_rank_cells_are_found_again(spark):
    rnd = np.random.default_rng(5)
    days, series = 60, 60
    shape = np.stack([np.sin(np.arange(days) / 5), np.arange(days) / days])
    full = 12 + rnd.normal(0, 2, (series, 2)) @ shape
    rows, hidden = [], {}
    for s in range(series):
        for t in range(days):
            if t in (0, days - 1) or rnd.random() < 0.7:
                rows.append((f"s{s}", d(t), float(full[s, t]), "x"))
            else:
                hidden[f"s{s}", d(t)] = full[s, t]
    got = {(r.s, r.date): r for r in grid(spark, rows, rank=2, iterations=8, ridge=0.01)}
    assert all(got[k].state == "filled" for k in hidden)
    error = math.sqrt(np.mean([(got[k].value - v) ** 2 for k, v in hidden.items()]))
    by_mean = math.sqrt(np.mean([(np.mean([r[2] for r in rows if r[0] == k[0]]) - v) ** 2 for k, v in list(hidden.items())[:200]]))
    assert error < 0.5 * by_mean
    assert all(got[r[0], r[1]].value == r[2] for r in rows)


def test_values_stay_in_range(spark):
    rows = [(f"s{i}", d(t), 1.0 if t % 2 else 0.0, "x") for i in range(6) for t in range(12) if (i + t) % 3]
    assert all(r.value is None or 0 <= r.value <= 1 for r in grid(spark, rows, high=1.0))


def brute(rows, windows=(7, 30)):
    out, series = {}, {}
    for s, date, v in rows:
        if date is not None:
            series.setdefault(s, {})[date] = v or 0
    for s, cells in series.items():
        t = min(cells)
        while t <= max(cells):
            out[s, t] = tuple(sum(v for q, v in cells.items() if t - dt.timedelta(days=w) < q <= t) for w in windows)
            t += dt.timedelta(days=1)
    return out


def test_rolling_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(s, d(t), rnd.choice([None, 0, 3, 8])) for s in ("a", "b", None) for t in range(70) if rnd.random() < 0.3] + [("c", None, 4), ("one", d(5), 2)]
    df = spark.createDataFrame(rows, "s string, date date, n bigint")
    got = {(r.s, r.date): (r.n_sum_7, r.n_sum_30) for r in rolling_totals(df, ["s"], ["n"]).collect()}
    assert got == brute(rows)
    one = rolling_totals(df, ["s"], ["n"]).filter("s = 'one'").first()
    assert one.n_avg_7 == 2 / 7 and one.n_avg_30 == 2 / 30
    assert rolling_totals(df.limit(0), ["s"], ["n"]).count() == 0


def test_state_carries_on_over_skipped_days_and_corrects(spark, tmp_path):
    rnd = random.Random(2)
    schema = "s string, date date, n bigint, k string"
    frame = lambda rs: spark.createDataFrame([(*r, "clash") for r in rs], schema)
    state = RollingState(spark, f"file://{tmp_path}/state", ["s"], ["n"], (2, 5))
    cells = {}
    got = lambda: {(r.s, r.date): (r.n_sum_2, r.n_sum_5) for r in state.totals().collect()}
    for days in ([0, 1], [2], [9, 10], [30]):  # the 3rd to 8th, and 11th to 29th, are skipped
        rows = [(s, d(t), rnd.randint(1, 9)) for t in days for s in ("a", "b", None) if rnd.random() < 0.8]
        state.advance(frame([*rows, ("a", None, 7)]))
        cells |= {r[:2]: r[2] for r in rows}
        assert got() == brute([(*k, v) for k, v in cells.items()], (2, 5))
    rows = [("b", d(2), 50), (None, d(9), 0), ("a", d(-3), 4), ("a", d(30), 1), ("unknown", d(0), 1)]
    last = {s: max(t for q, t in cells if q == s) for s in ("a", "b", None)}
    state.correct(frame(rows))
    cells |= {r[:2]: r[2] for r in rows if r[0] in last and r[1] <= last[r[0]]}
    assert got() == brute([(*k, v) for k, v in cells.items()], (2, 5))
    state.advance(frame([("b", d(32), 3), ("new", d(31), 2)]))
    cells |= {("b", d(32)): 3, ("new", d(31)): 2}
    assert got() == brute([(*k, v) for k, v in cells.items()], (2, 5))
    at = {r.s: (r.n_sum_2, r.n_avg_5) for r in state.as_of(str(d(33))).collect()}
    assert at["b"] == (3, sum(v for (s, t), v in cells.items() if s == "b" and t > d(28)) / 5) and at["new"] == (0, 2 / 5)


def test_state_carried_after_a_skipped_day(spark, tmp_path):
    state = RollingState(spark, f"file://{tmp_path}/state", ["s"], ["n"])
    for t, n in ((0, 5), (2, 1)):
        state.advance(spark.createDataFrame([("a", d(t), n)], "s string, date date, n bigint"))
    assert [(r.n_sum_7, r.n_sum_30) for r in state.totals().orderBy("date").collect()] == [(5, 5), (5, 5), (6, 6)]


def test_rolling_ignores_other_columns_and_repeated_names(spark):
    df = spark.createDataFrame([("a", d(0), 1, "x", 5), ("a", d(2), 2, "y", 6)], "s string, date date, n bigint, _next string, _of int")
    got = rolling_totals(df, ["s"], ["n"], (2,))
    assert got.columns == ["s", "date", "n_sum_2", "n_avg_2"]
    assert [r.n_sum_2 for r in got.orderBy("date").collect()] == [1, 1, 2]


def test_dates_that_are_far_off(spark):
    rows = [(f"s{i}", d(t), float(i + t), "x") for i in range(5) for t in range(0, 20, 2)] + [("far", dt.date(1, 1, 1), 1.0, "x"), ("far", dt.date(1, 1, 3), 2.0, "x"), ("late", dt.date(9999, 12, 31), 3.0, "x")]
    got = {(r.s, r.date): r.state for r in grid(spark, rows)}
    assert got["far", dt.date(1, 1, 2)] == "unsupported" and got["late", dt.date(9999, 12, 31)] == "observed"
    assert got["s1", d(0)] == "observed" and len(got) == 5 * 19 + 3 + 1
    far = [(f"t{i}", dt.date(9000, 1, 1) + dt.timedelta(days=t), float(i + t), "x") for i in range(5) for t in range(12) if t in (0, 11) or (i + t) % 5]
    got = {(r.s, r.date): r.state for r in grid(spark, rows + far)}
    assert {v for (s, _), v in got.items() if s[0] == "t"} == {"observed", "filled"}  # days 7,000 years off have factors of their own


def test_readings_without_a_common_shape_are_filled_by_the_mean(spark):
    rnd = np.random.default_rng(11)
    rows = [(f"s{i}", d(t), float(10 + rnd.normal()), "x") for i in range(40) for t in range(60) if t in (0, 59) or rnd.random() < 0.8]
    got = grid(spark, rows)
    means = {f"s{i}": np.mean([r[2] for r in rows if r[0] == f"s{i}"]) for i in range(40)}
    off = [r.value - means[r.s] for r in got if r.state == "filled"]
    assert np.sqrt(np.mean(np.square(off))) < 0.3
