"""Audit runs: counting rows, listings, history, comparison and heartbeat rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarv.functions.text import round1
from skarv.functions.urls import url_col
from skarv.operators.shred import Plan, relation, shred
from skarv.sources.tables import latest

COLUMNS = ["target_url", "status", "request_json", "error_message", "created_at", "started_at", "heartbeat_at", "completed_at"]


def runs(audit_runs: DataFrame, columns: list[str] = COLUMNS) -> DataFrame:
    """id and columns of each run's counting row."""
    return latest(audit_runs.filter(F.col("id").isNotNull()), ["id"], columns)


def mode() -> Column:
    """page or domain (also where the request says nothing)."""
    return F.coalesce(F.try_variant_get(F.try_parse_json("request_json"), "$.mode", "string"), F.lit("domain"))


def newest(audit_runs: DataFrame, n: int = 20) -> DataFrame:
    """The n runs created last; ties by id. A report's length, not a bound on the data: it is a top-k, sorted in each task first."""
    return runs(audit_runs).orderBy(F.desc("created_at"), "id").limit(n)


def queued(audit_runs: DataFrame) -> DataFrame:
    """Queued runs in the order in which they were created; ties by id."""
    return runs(audit_runs).filter(F.col("status") == "queued").orderBy("created_at", "id")


def stale(audit_runs: DataFrame, as_of: str, minutes: int = 10) -> DataFrame:
    """Running runs without a heartbeat for `minutes`."""
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES")
    return runs(audit_runs).filter((F.col("status") == "running") & (F.col("heartbeat_at").isNull() | (F.col("heartbeat_at").cast("timestamp") < limit)))


def recover(audit_runs: DataFrame, as_of: str, minutes: int = 10) -> DataFrame:
    """All runs, with the stale ones failed."""
    all_ = runs(audit_runs)
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES")
    dead = (F.col("status") == "running") & (F.col("heartbeat_at").isNull() | (F.col("heartbeat_at").cast("timestamp") < limit))
    return all_.withColumns({"error_message": F.when(dead, "no heartbeat").otherwise(F.col("error_message")), "status": F.when(dead, "failed").otherwise(F.col("status"))})


def history(audit_runs: DataFrame) -> DataFrame:
    """run_id, target, seq, prev_run_id of completed runs, each target's in order of completion."""
    done = runs(audit_runs).filter(F.col("status") == "completed").withColumn("target", url_col(F.col("target_url")))
    order = Window.partitionBy("target").orderBy(F.col("completed_at").asc_nulls_first(), "id")
    return done.select(F.col("id").alias("run_id"), "target", "completed_at", F.row_number().over(order).alias("seq"), F.lag("id").over(order).alias("prev_run_id"))


def summary_scores(audit_runs: DataFrame) -> DataFrame:
    """run_id, score_id, score of summary_json's category scores, as a relation."""
    plan = Plan({"summary_json": "summary"}, ["summary.categoryScores"])
    rows = shred(audit_runs, "id", plan, by="ingested_at", with_values=True).withColumnRenamed("id", "run_id")
    return relation(rows, "run_id", "summary.categoryScores", {"id": "string", "score": "double"}).select("run_id", F.col("id").alias("score_id"), "score")


def score_changes(audit_runs: DataFrame) -> DataFrame:
    """run_id, score_id, score, before, change: each score against the run before of the same target (0 where it had none)."""
    scores = summary_scores(audit_runs).groupBy("run_id", "score_id").agg(F.max("score").alias("score"))
    chain = history(audit_runs).select("run_id", "prev_run_id")
    now = scores.join(chain, "run_id")
    prev = scores.select(F.col("run_id").alias("prev_run_id"), "score_id", F.col("score").alias("before"))
    both = now.join(prev, ["prev_run_id", "score_id"], "left")
    change = F.when(F.col("prev_run_id").isNull(), 0.0).otherwise(round1(F.col("score") - F.coalesce("before", F.lit(0.0))))
    return both.select("run_id", "score_id", "score", "before", change.alias("change"))


def latest_report_with(audit_runs: DataFrame) -> DataFrame:
    """page_url, run_id: of each page the newest completed run whose report has it."""
    from skarv.operators.audits import audit_index

    snapshots, pages = audit_index(audit_runs)
    seen = pages.join(snapshots, "snapshot").select(F.col("snapshot").alias("run_id"), "at", F.explode("pages.page_url").alias("page_url"))
    return seen.groupBy("page_url").agg(F.max_by("run_id", F.struct("at", "run_id")).alias("run_id"))


def week_start(day: Column) -> Column:
    """Monday of a date's week."""
    return F.to_date(F.date_trunc("week", day))


def progress_percent(phase: Column, done: Column, target: Column) -> Column:
    """Percent shown for a phase of a run; while crawling it follows the pages."""
    share = F.least(F.lit(1.0), F.when(target > 0, done / target).otherwise(0.0))
    steps = {"queued": 0, "discovering": 5, "rendering": 72, "competitors": 80, "analyzing": 92, "completed": 100}
    c = F.when(phase == "crawling", 10 + F.floor(share * 58 + 0.5))
    for name, value in steps.items():
        c = c.when(phase == name, value)
    return c.otherwise(0)
