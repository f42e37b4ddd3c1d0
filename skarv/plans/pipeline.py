"""Queries of the general data-pipeline operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarv.operators.audits import audit_changes, audit_field_changes
from skarv.operators.grid import missing_days
from skarv.operators.metrics import READINGS, page_grid, page_rolling
from skarv.operators.reports import RELATIONS, report_elements, report_tables, run_table
from skarv.operators.shred import relation
from skarv.plans.pages import url_sql
from skarv.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return audit_changes(table(spark, d, "audit_runs")).select("run_id", "page_url", "change_kind")


def p1_fields(spark: SparkSession, d: str) -> DataFrame:
    return audit_field_changes(table(spark, d, "audit_runs"))


def _grids(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [page_grid(spark, d, n).withColumn("series_table", F.lit(n)) for n in READINGS])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    gaps = _grids(spark, d).filter(missing_days(None))
    return gaps.select("series_table", "domain", "page", F.date_format("date", "yyyy-MM-dd").alias("missing_date"))


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d).select("series_table", "domain", "page", "date", "value", "state")


def p4_rolling(spark: SparkSession, d: str) -> DataFrame:
    return page_rolling(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return report_elements(table(spark, d, "audit_runs")).select("run_id", "rel", "elem_path")


def p7_tables(spark: SparkSession, d: str) -> DataFrame:
    return report_tables(table(spark, d, "audit_runs"))


def _flat(spark: SparkSession, d: str, name: str, columns: dict[str, str]) -> DataFrame:
    rows = relation(report_tables(table(spark, d, "audit_runs")), "run_id", name, columns)
    return rows.withColumnsRenamed({c: c.replace(".", "_").lower() for c in columns})


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    """The table that the category scores of reports and of summaries share."""
    return _flat(spark, d, "categoryScores", {"id": "string", "label": "string", "weight": "double", "score": "double"})


def p7_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages of reports, with columns of the objects that a page has once."""
    return _flat(spark, d, "pages", {"url": "string", "statusCode": "int", "clickDepth": "int", "schema.itemCount": "int", "rendering.renderingModel": "string"})


def p7_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The patch blocks of implementation packs, tied to their packs."""
    return _flat(spark, d, "implementationPacks.patchBlocks", {"id": "string", "label": "string", "content": "string"})


def p7_runs(spark: SparkSession, d: str) -> DataFrame:
    return run_table(table(spark, d, "audit_runs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_fields, p2_found, p2_grid, p4_rolling, p7_found, p7_tables, p7_scores, p7_pages, p7_blocks, p7_runs)}


def _json(column: str) -> str:
    """A JSON column's value in SQL: a JSON string stands for the JSON in it; null where it can't be parsed."""
    inner = f"json_extract_string({column}, '$')"
    return f"CASE WHEN NOT json_valid({column}) THEN NULL WHEN json_type({column}) = 'VARCHAR' THEN CASE WHEN json_valid({inner}) THEN CAST({inner} AS JSON) END ELSE CAST({column} AS JSON) END"


def _elements(value: str) -> str:
    """The elements of a JSON value that is a list, one thing in place of a list, or nothing."""
    return f"CASE WHEN {value} IS NULL OR json_type({value}) = 'NULL' THEN [] WHEN json_type({value}) = 'ARRAY' THEN json_extract({value}, '$[*]') ELSE [{value}] END"


_RUNS = (
    f"runs AS (SELECT id, target_url, status, completed_at, {_json('request_json')} AS request, {_json('report_json')} AS report, {_json('summary_json')} AS summary "
    "FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM audit_runs WHERE id IS NOT NULL) WHERE rn = 1)"
)


def _relations(last: str | None = None) -> str:
    """One CTE per relation, each from the rows of the nearest relation above it. last: a query over them instead of their union."""
    ctes, parts = [], []
    for n, rel in enumerate(RELATIONS):
        above = max((m for m, r in enumerate(RELATIONS) if rel.startswith(r + ".")), key=lambda m: len(RELATIONS[m]), default=None)
        if above is None:
            root = "summary" if rel.startswith("summary.") else "report"
            name = rel.removeprefix("summary.")
            base = f"SELECT id, '' AS above, json_extract({root}, '$.{name}') AS v FROM runs"
        else:
            below = rel[len(RELATIONS[above]) + 1 :]
            base = f"SELECT id, path || '/' AS above, json_extract(v, '$.{below}') AS v FROM r{above}"
        ctes.append(f"e{n} AS (SELECT id, above, {_elements('v')} AS items FROM ({base}))")
        ctes.append(f"r{n} AS (SELECT id, above || i AS path, v FROM (SELECT id, above, generate_subscripts(items, 1) - 1 AS i, unnest(items) AS v FROM e{n}) WHERE json_type(v) <> 'NULL')")
        parts.append(f"SELECT id AS run_id, '{rel}' AS rel, path AS elem_path FROM r{n}")
    return f"WITH {_RUNS}, {', '.join(ctes)} " + (last or " UNION ALL ".join(parts))


def _flat_sql(names: list[str], columns: dict[str, str]) -> str:
    """One flat table over some relations; columns: path to type."""
    get = lambda p, t: f"json_extract_string(v, '$.{p}')" if t == "VARCHAR" else f"CAST(json_extract(v, '$.{p}') AS {t})"
    each = ", ".join(f"{get(p, t)} AS {p.replace('.', '_').lower()}" for p, t in columns.items())
    parts = []
    for name in names:
        above = max((r for r in RELATIONS if name.startswith(r + ".")), key=len, default="summary" if name.startswith("summary.") else "report")
        parts.append(f"SELECT id AS run_id, '{name}' AS rel, path AS elem_path, '{above}' AS parent_rel, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent_path, {each} FROM r{RELATIONS.index(name)}")
    return _relations(" UNION ALL ".join(parts))


def _folded(value: str) -> str:
    return f"coalesce(trim(regexp_replace({value}, '\\s+', ' ', 'g')), '')"


def _one_text(field: str) -> str:
    return _folded(f"json_extract_string(p, '$.{field}')")


def _many_texts(field: str) -> str:
    items = _elements(f"json_extract(p, '$.{field}')")
    text = _folded("json_extract_string(x, '$')")
    return f"list_filter(list_transform({items}, lambda x: {text}), lambda x: x <> '')"


def _field_changes() -> str:
    """Old and new values of the fields of changed pages, from the same pages and chain as the changes."""
    names = ("title", "metaDescription", "h1", "headings", "firstParagraph", "bodyText", "statusCode", "canonicalUrl", "noindex")
    texts = {n: f"array_to_string({_many_texts(n)}, chr(31))" if n == "headings" else _one_text(n) for n in names}
    texts["schema_types"] = f"array_to_string(list_sort(list_distinct({_many_texts('schema.types')})), chr(31))"
    fields = "{" + ", ".join(f"'{n}': {t}" for n, t in texts.items()) + "}"
    head = _changes().partition("new AS (")[0]
    start, rest = head.split("u AS (SELECT id, ", 1)
    head = start + f"u AS (SELECT id, {rest.partition(' AS url, ')[0]} AS url, {fields} AS k, i FROM p" + rest.split(" AS k, i FROM p", 1)[1]
    each = ", ".join(f"{{'field': '{n}', 'old_value': o.k.{n}, 'new_value': n.k.{n}}}" for n in texts)
    return (
        f"{head.rstrip().rstrip(',')} SELECT run_id, page_url, v.field AS field, v.old_value AS old_value, v.new_value AS new_value FROM ("
        f"SELECT c.id AS run_id, n.url AS page_url, unnest([{each}]) AS v FROM chain c JOIN g n ON n.id = c.id JOIN g o ON o.id = c.prev AND o.url = n.url) WHERE v.old_value <> v.new_value"
    )


def _changes() -> str:
    plain = [_one_text(f) for f in ("title", "metaDescription", "h1", "firstParagraph", "bodyText", "statusCode", "canonicalUrl", "noindex")]
    fields = " || chr(1) || ".join([*plain, f"array_to_string({_many_texts('headings')}, chr(2))", f"array_to_string(list_sort(list_distinct({_many_texts('schema.types')})), chr(2))"])
    pages = _elements("json_extract(report, '$.pages')")
    address = url_sql("json_extract_string(p, '$.url')")
    return (
        f"WITH {_RUNS}, snaps AS (SELECT id, {url_sql('target_url')} AS target, completed_at, report FROM runs WHERE status = 'completed' AND coalesce(json_extract_string(request, '$.mode'), 'domain') IN ('domain', '') AND json_type(report) = 'OBJECT'), "
        "chain AS (SELECT id, lag(id) OVER (PARTITION BY target ORDER BY completed_at, id) AS prev FROM snaps), "
        f"p AS (SELECT id, generate_subscripts(items, 1) AS i, unnest(items) AS p FROM (SELECT id, {pages} AS items FROM snaps)), "
        f"u AS (SELECT id, {address} AS url, {fields} AS k, i FROM p WHERE json_type(json_extract(p, '$.url')) = 'VARCHAR'), "
        "g AS (SELECT id, url, arg_min(k, i) AS k FROM u GROUP BY id, url), "
        "new AS (SELECT c.id, g.url, g.k FROM chain c JOIN g ON g.id = c.id WHERE c.prev IS NOT NULL), old AS (SELECT c.id, g.url, g.k FROM chain c JOIN g ON g.id = c.prev) "
        "SELECT coalesce(n.id, o.id) AS run_id, coalesce(n.url, o.url) AS page_url, CASE WHEN o.url IS NULL THEN 'added' WHEN n.url IS NULL THEN 'removed' ELSE 'changed' END AS change_kind "
        "FROM new n FULL JOIN old o ON n.id = o.id AND n.url = o.url WHERE o.url IS NULL OR n.url IS NULL OR n.k <> o.k"
    )


SQL: dict[str, str] = {"p1_found": _changes(), "p1_fields": _field_changes(), "p7_found": _relations()}
SQL["p7_scores"] = _flat_sql(["categoryScores", "summary.categoryScores"], {"id": "VARCHAR", "label": "VARCHAR", "weight": "DOUBLE", "score": "DOUBLE"})
SQL["p7_pages"] = _flat_sql(["pages"], {"url": "VARCHAR", "statusCode": "INT", "clickDepth": "INT", "schema.itemCount": "INT", "rendering.renderingModel": "VARCHAR"})
SQL["p7_blocks"] = _flat_sql(["implementationPacks.patchBlocks"], {"id": "VARCHAR", "label": "VARCHAR", "content": "VARCHAR"})
SQL["p7_runs"] = f"WITH {_RUNS.replace('status, completed_at,', 'status, error_message, created_at, started_at, heartbeat_at, completed_at,')} SELECT id AS run_id, target_url, status, error_message, created_at, started_at, heartbeat_at, completed_at FROM runs"


def latest_report_sql() -> str:
    """Of each page the last run whose report has it."""
    head = _changes().partition("new AS (")[0].replace("lag(id) OVER (PARTITION BY target ORDER BY completed_at, id) AS prev", "completed_at AS seq")
    return head.rstrip(", ") + " SELECT g.url AS page_url, max({'s': c.seq, 'i': c.id}).i AS run_id FROM g JOIN chain c ON c.id = g.id GROUP BY g.url"


def score_changes_sql() -> str:
    """Category scores of summaries against the run before of the same target."""
    return (
        f"WITH {_RUNS}, x AS (SELECT id, unnest({_elements('j')}) AS v FROM (SELECT id, json_extract(summary, '$.categoryScores') AS j FROM runs)), "
        "s AS (SELECT id AS run_id, json_extract_string(v, '$.id') AS score_id, max(CAST(json_extract(v, '$.score') AS DOUBLE)) AS score FROM x WHERE json_type(v) = 'OBJECT' GROUP BY ALL), "
        f"c AS (SELECT id AS run_id, lag(id) OVER (PARTITION BY {url_sql('target_url')} ORDER BY completed_at, id) AS prev FROM runs WHERE status = 'completed') "
        "SELECT s.run_id, s.score_id, s.score, p.score AS before, CASE WHEN c.prev IS NULL THEN 0 ELSE round(s.score - coalesce(p.score, 0), 1) END AS change FROM s JOIN c USING (run_id) LEFT JOIN s p ON p.run_id = c.prev AND p.score_id = s.score_id"
    )
