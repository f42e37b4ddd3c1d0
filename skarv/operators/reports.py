"""The lists of audit reports and summaries as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarv.operators.shred import Plan, schema_graph, shred

#: The lists of report_json and summary_json that become relations.
RELATIONS = [
    "categoryScores",
    "providerScores",
    "providerScores.blockers",
    "issues",
    "issues.affectedUrls",
    "recommendations",
    "pages",
    "pages.schema.rawItems",
    "topicClusters",
    "topicClusters.pages",
    "pageSuggestions",
    "pageSuggestions.searchInsights.topQueries",
    "pageSuggestions.searchInsights.topQueries.missingTerms",
    "implementationPacks",
    "implementationPacks.patchBlocks",
    "implementationPacks.predictedImpact.categories",
    "competitiveContext.competitors",
    "competitiveContext.competitors.clusters",
    "competitiveContext.gaps",
    "summary.categoryScores",
    "summary.providerScores",
]
COLUMNS = {"report_json": "", "summary_json": "summary"}
#: The relations of the two JSON records themselves, for what they have once.
ROOTS = {"report_json": "report", "summary_json": "summary"}


def report_graphs(audit_runs: DataFrame) -> dict[str, tuple[list[str], list[str]]]:
    """By JSON column all paths and the repeated ones; runs a job for each column. What comes to the driver is the schema."""
    found = {}
    for column in COLUMNS:
        rows = schema_graph(audit_runs, column).select("path", "repeated").collect()
        found[column] = ([r.path for r in rows], [r.path for r in rows if r.repeated])
    return found


def report_plan(audit_runs: DataFrame) -> Plan:
    """A plan for all that reports and summaries hold. RELATIONS count as repeated, whether a list was seen there or not."""
    graphs = report_graphs(audit_runs)
    for column, prefix in COLUMNS.items():
        own = [r.removeprefix("summary.") for r in RELATIONS if r.startswith("summary.") == bool(prefix)]
        graphs[column] = (graphs[column][0], sorted({*graphs[column][1], *own}))
    return Plan.infer(graphs, COLUMNS, ROOTS)


def report_tables(audit_runs: DataFrame) -> DataFrame:
    """run_id, rel, elem_path, parent_rel, parent_path, table_name, value of all that reports and summaries hold: every repeated path has
    a relation, and what a record has once is in its row of `report` or `summary` (elem_path "")."""
    return shred(audit_runs, "id", report_plan(audit_runs), by="ingested_at", with_values=True).withColumnRenamed("id", "run_id")


def report_elements(audit_runs: DataFrame, with_values: bool = False) -> DataFrame:
    """run_id, rel, elem_path, parent_rel, parent_path(, table_name, value) of the lists named in RELATIONS, in each run's counting row.

    The schema graph tells which of them there are at all; the others are not looked for.
    """
    graphs = report_graphs(audit_runs)
    there = {f"{COLUMNS[c]}.{p}" if COLUMNS[c] else p for c, (paths, _) in graphs.items() for p in paths}
    plan = Plan(COLUMNS, [r for r in RELATIONS if r in there])
    return shred(audit_runs, "id", plan, by="ingested_at", with_values=with_values).withColumnRenamed("id", "run_id")


def run_table(audit_runs: DataFrame) -> DataFrame:
    """The record table: run_id with its scalar columns, the parent of all relations with parent_path ""."""
    from skarv.sources.tables import latest

    kept = ["target_url", "status", "error_message", "created_at", "started_at", "heartbeat_at", "completed_at"]
    return latest(audit_runs.filter(F.col("id").isNotNull()), [F.col("id").alias("run_id")], kept)
