"""Rolling totals over trailing periods, as a daily state that is carried forward.

The state of a series on a day is, for each window, yesterday's total plus the day's arrivals minus the amounts of the day that
expires. In batch (`rolling_totals`) that recurrence is a running sum over signed events: an amount enters on its day and
leaves `w` days later. `RollingState` carries it from delivery to delivery and recomputes only the days that a correction reaches.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarv.runtime import read_pointer, write_pointer


def rolling_totals(daily: DataFrame, keys: list[str], metrics: list[str], windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """keys, date and METRIC_sum_W, METRIC_avg_W for every day from a series' first to its last dated row.

    daily: keys, date, metrics – one row per series and date. Null metrics count as 0; rows without date are ignored; days
    without rows count as 0, also those before the first row (an average is the total divided by W). Null keys form series
    like any other. Integer metrics give exact BIGINT totals. An empty table gives no rows.

    A series has at most one row per day, so a window's group is bounded by the calendar; it is the only shuffle.
    """
    rows = daily.filter(F.col("date").isNotNull())
    zero = [F.coalesce(F.col(m), F.lit(0)).alias(m) for m in metrics]
    order = Window.partitionBy(*keys).orderBy("date")
    rows = rows.select(*keys, "date", *zero).withColumn("_next", F.lead("date").over(order))
    # each row stands for its day and the empty days up to the next row
    last = F.coalesce(F.date_sub("_next", 1), F.col("date"))
    dense = rows.select(*keys, F.col("date").alias("_of"), *metrics, F.explode(F.sequence("date", last)).alias("date"))
    arrived = [F.when(F.col("date") == F.col("_of"), F.col(m)).otherwise(F.lit(0)).alias(m) for m in metrics]
    dense = dense.select(*keys, "date", *arrived)
    carried = order.rowsBetween(Window.unboundedPreceding, 0)
    state = dense.select(*keys, "date", *[F.sum(m).over(carried).alias(m) for m in metrics])
    # the grid has no gaps: the total up to `w` days ago is `w` rows back
    sums = {(m, w): F.col(m) - F.coalesce(F.lag(m, w).over(order), F.lit(0)) for m in metrics for w in windows}
    out = [c for (m, w), s in sums.items() for c in (s.alias(f"{m}_sum_{w}"), (s / F.lit(w)).alias(f"{m}_avg_{w}"))]
    return state.select(*keys, "date", *out)


class RollingState:
    """Versioned daily state under `path`, carried from delivery to delivery.

    state/v=N has one row per series as of its last dated day: its totals and the amounts that have still to expire, at most one for each
    of the `max(windows)` days. totals/v=N has the days that version N computed. `advance` joins the state with new days:
    a day's total is the day's before plus what arrived minus what expired, over skipped days too. `correct` recomputes the days
    that corrected amounts reach, no others. path/CURRENT names the version in force and is written last.

    Null keys form series like any other, null metrics count as 0, rows without date are ignored.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], metrics: list[str], windows: tuple[int, ...] = (7, 30)):
        self.spark, self.path, self.keys, self.metrics, self.windows = spark, path.rstrip("/"), keys, metrics, windows
        self.sums = [f"{m}_sum_{w}" for m in metrics for w in windows]

    def _versions(self) -> list[str]:
        """The versions in force: a for days added, c for days corrected."""
        return (read_pointer(self.spark, f"{self.path}/CURRENT") or "").split()

    def _write(self, kind: str, totals: DataFrame, state: DataFrame) -> None:
        done = self._versions()
        n = len(done) + 1
        write = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/v={n}")
        with ThreadPoolExecutor(2) as both:  # two jobs that don't wait for one another
            for job in [both.submit(write, totals, "totals"), both.submit(write, state, "state")]:
                job.result()
        write_pointer(self.spark, f"{self.path}/CURRENT", " ".join([*done, kind]))

    def state(self) -> DataFrame | None:
        """k (the keys), first, last, recent and METRIC_sum_W of each series as of its last dated day; None before the first delivery."""
        n = len(self._versions())
        return self.spark.read.parquet(f"{self.path}/state/v={n}") if n else None

    def _totals(self) -> DataFrame:
        kinds = self._versions()
        read = [self.spark.read.parquet(f"{self.path}/totals/v={n}").withColumn("v", F.lit(n)) for n in range(1, len(kinds) + 1)]
        rows = reduce(DataFrame.unionByName, read)
        if "c" not in kinds:
            return rows.drop("v")
        over = reduce(DataFrame.unionByName, [r.select("k", "date", "v") for r, kind in zip(read, kinds) if kind == "c"])
        over = over.groupBy("k", "date").agg(F.max("v").alias("_over"))
        return rows.join(over, ["k", "date"], "left").filter(F.col("v") >= F.coalesce("_over", "v")).drop("v", "_over")

    def totals(self) -> DataFrame:
        """keys, date, METRIC_sum_W and METRIC_avg_W of every day from a series' first to its last dated day."""
        out = [c for m in self.metrics for w in self.windows for c in (F.col(f"{m}_sum_{w}"), (F.col(f"{m}_sum_{w}") / F.lit(w)).alias(f"{m}_avg_{w}"))]
        return self._totals().select(*[F.col("k")[k].alias(k) for k in self.keys], "date", *out)

    def as_of(self, day: str) -> DataFrame:
        """keys and METRIC_sum_W, METRIC_avg_W as of `day`, also of series without activity since; those that end after it are left out."""
        until = F.lit(day).cast("date")
        rows = self.state().filter(F.col("last") <= until)
        sums = {f"{m}_sum_{w}": self._recent_sum(m, w, until) for m in self.metrics for w in self.windows}
        out = [c for m in self.metrics for w in self.windows for c in (F.col(f"{m}_sum_{w}"), (F.col(f"{m}_sum_{w}") / F.lit(w)).alias(f"{m}_avg_{w}"))]
        return rows.withColumns(sums).select(*[F.col("k")[k].alias(k) for k in self.keys], *out)

    @staticmethod
    def _recent_sum(metric: str, window: int, until: Column) -> Column:
        amounts = F.filter("recent", lambda x: x["date"] > F.date_sub(until, window))
        return F.aggregate(amounts, F.lit(0).cast("bigint"), lambda a, x: a + x[metric])

    def _rows(self, arrivals: DataFrame) -> DataFrame:
        amounts = [F.sum(F.coalesce(F.col(m), F.lit(0)).cast("bigint")).alias(m) for m in self.metrics]
        return arrivals.filter(F.col("date").isNotNull()).groupBy(F.struct(*self.keys).alias("k"), "date").agg(*amounts)

    def _with_state(self, rows: DataFrame) -> DataFrame:
        """State rows from dated amounts (k, date, metrics): of each series the last day, what has still to expire, and its totals."""
        kept = rows.groupBy("k").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.sort_array(F.collect_list(F.struct("date", *self.metrics))).alias("recent"))
        kept = kept.withColumn("recent", F.filter("recent", lambda x: x["date"] > F.date_sub("last", max(self.windows))))
        return kept.withColumns({f"{m}_sum_{w}": self._recent_sum(m, w, F.col("last")) for m in self.metrics for w in self.windows})

    def advance(self, arrivals: DataFrame) -> None:
        """Add days to the state: keys, date, metrics, each series' days after its last; several days and skipped days at once, as they come.

        Rows of a series and day add up. Days up to a series' last are corrections (`correct`) and refused here.
        """
        fresh, before = self._rows(arrivals), self.state()
        zero = {n: F.lit(0).cast("bigint") for n in self.sums}
        if before is None:
            rows = fresh.withColumns({"since": F.lit(None).cast("date"), **zero})
            state = self._with_state(fresh)
        else:
            known = before.select("k", F.col("last").alias("since"))
            fresh = fresh.join(known, "k", "left").withColumns(zero)
            late = F.raise_error(F.lit("days up to the last of a series are corrections"))
            fresh = fresh.withColumn("date", F.when(F.col("since").isNull() | (F.col("date") > F.col("since")), F.col("date")).otherwise(late.cast("date")))
            met = before.join(fresh.select("k").distinct(), "k", "left_semi")
            carried = met.select("k", "first", F.col("last").alias("since"), *self.sums, F.inline("recent"))
            # yesterday's totals enter on the last day of the state
            carried = carried.withColumns({n: F.when(F.col("date") == F.col("since"), F.col(n)).otherwise(F.lit(0)) for n in self.sums})
            rows = fresh.unionByName(carried.drop("first"))
            both = self._with_state(rows).join(before.select("k", F.col("first").alias("_first")), "k", "left")
            state = both.withColumn("first", F.coalesce("_first", "first")).drop("_first")
            state = state.unionByName(before.join(fresh.select("k").distinct(), "k", "left_anti"))
        order = Window.partitionBy("k").orderBy("date")
        last = F.coalesce(F.date_sub(F.lead("date").over(order), 1), F.col("date"))
        dense = rows.withColumn("_last", last).select("k", F.col("date").alias("_of"), "since", *self.metrics, *self.sums, F.explode(F.sequence("date", "_last")).alias("date"))
        here = F.col("date") == F.col("_of")
        dense = dense.select("k", "since", "date", *[F.when(here, F.col(c)).otherwise(F.lit(0)).alias(c) for c in (*self.metrics, *self.sums)])
        new = F.col("since").isNull() | (F.col("date") > F.col("since"))
        steps = {f"{m}_sum_{w}": F.when(new, F.col(m) - F.coalesce(F.lag(m, w).over(order), F.lit(0))).otherwise(F.col(f"{m}_sum_{w}")) for m in self.metrics for w in self.windows}
        stepped = dense.select("k", "since", "date", *self.metrics, *[c.alias(n) for n, c in steps.items()])
        carry = order.rowsBetween(Window.unboundedPreceding, 0)
        totals = stepped.select("k", "since", "date", *self.metrics, *[F.sum(n).over(carry).alias(n) for n in self.sums]).filter(new).drop("since")
        self._write("a", totals, state)

    def correct(self, rows: DataFrame) -> None:
        """Replace the amounts of days: keys, date, metrics of series that the state has, up to their last days.

        Only the days that a corrected amount reaches are computed again, `max(windows)` for each; days before a series' first are added.
        Rows of other series and of later days are ignored.
        """
        before, longest = self.state(), max(self.windows)
        known = self._rows(rows).join(before.select("k", "first", "last"), "k").filter(F.col("date") <= F.col("last"))
        touched = known.groupBy("k").agg(F.min("date").alias("date"), F.first("first").alias("first"))
        days = self._totals().join(touched.select("k"), "k", "left_semi").select("k", "date", *self.metrics, *self.sums, F.lit(False).alias("added"))
        zero = [F.lit(0).cast("bigint").alias(n) for n in (*self.metrics, *self.sums)]
        earlier = touched.filter("date < first").select("k", F.explode(F.sequence("date", F.date_sub("first", 1))).alias("date"), *zero, F.lit(True).alias("added"))
        now = known.select("k", "date", *[F.col(m).alias(f"_{m}") for m in self.metrics], F.lit(1).alias("_hit"))
        met = days.unionByName(earlier).join(now, ["k", "date"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
        met = met.withColumns({f"_{m}": F.when(F.col("_hit") == 1, F.col(f"_{m}") - F.col(m)).otherwise(F.lit(0)) for m in self.metrics})
        # what was corrected up to a day, less what was up to `w` days before: the days of a series have no gaps
        order = Window.partitionBy("k").orderBy("date")
        carry = order.rowsBetween(Window.unboundedPreceding, 0)
        run = met.withColumns({f"{c}_run": F.sum(c).over(carry) for c in ("_hit", *(f"_{m}" for m in self.metrics))})
        within = lambda c, w: F.col(f"{c}_run") - F.coalesce(F.lag(f"{c}_run", w).over(order), F.lit(0))
        again = run.withColumns({"_reached": within("_hit", longest), **{f"_{m}_{w}": within(f"_{m}", w) for m in self.metrics for w in self.windows}})
        again = again.filter((F.col("_reached") > 0) | F.col("added"))
        again = again.select("k", "date", *[(F.col(m) + F.col(f"_{m}")).alias(m) for m in self.metrics], *[(F.col(f"{m}_sum_{w}") + F.col(f"_{m}_{w}")).alias(f"{m}_sum_{w}") for m in self.metrics for w in self.windows])
        # the states of corrected series, from their recent amounts and the new ones
        recent = before.join(touched.select("k"), "k", "left_semi").select("k", F.inline("recent")).join(known.select("k", "date"), ["k", "date"], "left_anti")
        state = self._with_state(recent.unionByName(known.select("k", "date", *self.metrics))).join(before.select("k", F.col("first").alias("_first")), "k").withColumn("first", F.least("first", "_first")).drop("_first")
        self._write("c", again, state.unionByName(before.join(touched.select("k"), "k", "left_anti")))
