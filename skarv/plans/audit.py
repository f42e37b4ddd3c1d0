"""Queries over whole audits: what reports hold, what pages need, pages as HTML and back; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarv.functions import text as T
from skarv.functions.keywords import brands, keywords
from skarv.functions.unicode import slugs
from skarv.functions.urls import host_col, url_col
from skarv.operators import insights as I
from skarv.operators import pages as P
from skarv.operators import records as R
from skarv.operators import runs as U
from skarv.operators import search as S
from skarv.operators.reports import RELATIONS, report_elements
from skarv.operators.shred import relation
from skarv.plans.metrics import AS_OF as METRICS_AS_OF
from skarv.plans.metrics import FOUND, RUNS, _windows
from skarv.plans.pages import AS_OF, FLAGS_SQL, METRICS, PAGES, _providers_sql, url_sql
from skarv.plans.pages import SQL as PAGE_SQL
from skarv.plans.pipeline import _RUNS, _relations
from skarv.sources.html import html_pages
from skarv.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _snap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_snapshots")


_LIKELY = "coalesce(answer_first_signals.direct_answer_likelihood, 0)"
_NEEDS = {
    "title-length": "NOT coalesce(length(title), 0) BETWEEN 35 AND 60",
    "description-length": "NOT coalesce(length(meta_description), 0) BETWEEN 120 AND 160",
    "no-schema": "NOT coalesce(len(schema.types) > 0, false)",
    "schema-mismatch": "coalesce(len(schema.types) > 0, false) AND NOT coalesce(schema.matches_visible_content, false)",
    "late-answer": f"{_LIKELY} < 70",
}


@query(
    f"WITH {PAGES}, n AS (SELECT run_id, crawl_seq, concat_ws(' ', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _NEEDS.items())}) AS needs, {' + '.join(f'(CASE WHEN {c} THEN {I.NEEDS[n]} ELSE 0 END)' for n, c in _NEEDS.items())} AS points FROM pages WHERE {FLAGS_SQL['eligible']}) "
    "SELECT run_id, crawl_seq, needs, CAST(points AS INT) AS points, CAST(rank_no AS INT) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY points DESC, crawl_seq) AS rank_no FROM n) WHERE rank_no <= 15"
)
def page_needs(spark: SparkSession, d: str) -> DataFrame:
    return I.page_needs(_snap(spark, d))


_ORDER = "CASE score_id " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(P.PROVIDERS)) + " END"


@query(
    f"WITH {PAGES}, {METRICS}, b AS (SELECT run_id, score_id, score FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, {_ORDER}) AS r FROM ({_providers_sql('metrics')})) WHERE r = 1), "
    f"i AS ({PAGE_SQL['site_issues']}), g AS (SELECT run_id, arg_min(issue, place) AS first_issue, count(*) AS issues FROM i GROUP BY run_id) "
    "SELECT run_id, eligible, b.score_id AS strongest, b.score AS strongest_score, first_issue, coalesce(issues, 0) AS issues FROM metrics JOIN b USING (run_id) LEFT JOIN g USING (run_id)"
)
def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    return I.run_summaries(P.site_metrics(_snap(spark, d), AS_OF))


def _text(path: str) -> str:
    return f"json_extract_string(v, '$.{path}')"


_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def fold_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'))"


def strip_sql(x: str) -> str:
    return fold_sql(f"regexp_replace(regexp_replace({x}, '\\[[^\\]]*\\]', ' ', 'g'), '\\{{\\{{[^}}]*\\}}\\}}', ' ', 'g')")


def _cut_sql(t: str, most: int, least: int, end: str) -> str:
    head = f"left({t}, {most})"
    at = f"(CASE WHEN strpos(reverse({head}), ' ') = 0 THEN -1 ELSE length({head}) - strpos(reverse({head}), ' ') END)"
    return f"CASE WHEN length({t}) <= {most} THEN {t} ELSE trim(CASE WHEN {at} > {least} THEN left({head}, {at}) ELSE {head} END){end} END"


def excerpt_sql(x: str, most: int, least: int = 80) -> str:
    return _cut_sql(strip_sql(x), most, least, " || '...'")


@query(_relations(f"SELECT id AS run_id, path AS elem_path, {excerpt_sql(_text('bodyText'), 320)} AS body_text, length({_text('bodyText')}) AS was FROM r{RELATIONS.index('pages')}"))
def compact_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages of stored reports with their texts cut to an excerpt, as reports are kept."""
    rows = relation(report_elements(table(spark, d, "audit_runs"), with_values=True), "run_id", "pages", {"bodyText": "string"})
    return rows.select("run_id", "elem_path", T.excerpt(F.col("bodyText"), 320).alias("body_text"), F.length("bodyText").cast("long").alias("was"))


_CLUSTERS, _OWN = RELATIONS.index("competitiveContext.competitors.clusters"), RELATIONS.index("topicClusters")


@query(_relations(f"SELECT DISTINCT id AS run_id, json_extract_string(v, '$') AS cluster FROM r{_CLUSTERS} EXCEPT SELECT id, {_text('name')} FROM r{_OWN}"))
def competitor_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Topic clusters of an audit's competitors that the audited site lacks."""
    rows = report_elements(table(spark, d, "audit_runs"), with_values=True)
    theirs = relation(rows, "run_id", "competitiveContext.competitors.clusters", {"value": "string"}).withColumnRenamed("value", "name")
    return I.missing_clusters(relation(rows, "run_id", "topicClusters", {"name": "string"}), theirs)


_RIVALS, _PAGES = RELATIONS.index("competitiveContext.competitors"), RELATIONS.index("pages")


@query(
    _relations(
        f"SELECT t.id AS run_id, own, round(others, 1) AS others FROM (SELECT id, avg(CAST(json_extract(v, '$.pages') AS DOUBLE)) AS others FROM r{_RIVALS} GROUP BY id) t JOIN (SELECT id, count(*) AS own FROM r{_PAGES} GROUP BY id) o ON o.id = t.id WHERE others > own + 8"
    )
)
def competitor_pages(spark: SparkSession, d: str) -> DataFrame:
    """Audits whose competitors have more pages on average than the report has, by more than 8."""
    rows = report_elements(table(spark, d, "audit_runs"), with_values=True)
    theirs = relation(rows, "run_id", "competitiveContext.competitors", {"pages": "double"}).groupBy("run_id").agg(F.avg("pages").alias("others"))
    own = rows.filter("rel = 'pages'").groupBy("run_id").agg(F.count("*").alias("own"))
    return own.join(theirs, "run_id").filter(F.col("others") > F.col("own") + 8).select("run_id", "own", T.round1(F.col("others")).alias("others"))


def _escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def html_rows(page_snapshots: DataFrame) -> DataFrame:
    """run_id, crawl_seq, page, url, html: crawled pages as the HTML documents that they may have been."""
    pages = P.counting(page_snapshots, ["url", "title", "meta_description", "h1", "headings", "body_text", "internal_links", "external_links", "author", "publisher", "canonical_url", "robots_meta", "date_published"])
    none = F.array().cast("array<string>")
    z = lambda c: _escaped(F.coalesce(F.col(c), F.lit("")))
    each = lambda c, before, after: F.array_join(F.transform(c, lambda x: F.concat(F.lit(before), _escaped(F.coalesce(x, F.lit(""))), F.lit(after))), "")
    meta = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<meta {name} content="'), z(c), F.lit('">'))).otherwise("")
    lines = F.filter(F.split(F.coalesce("body_text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    html = F.concat(
        F.lit("<!doctype html><html><head><title>"), z("title"), F.lit("</title>"), meta('name="description"', "meta_description"), meta('name="author"', "author"), meta('property="og:site_name"', "publisher"),
        F.when(F.col("date_published").isNotNull(), F.concat(F.lit('<meta property="article:published_time" content="'), F.date_format("date_published", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('">'))).otherwise(""),
        F.lit('<meta name="robots" content="'), _escaped(F.array_join(F.coalesce("robots_meta", none), ", ")), F.lit('">'), F.when(F.col("canonical_url").isNotNull(), F.concat(F.lit('<link rel="canonical" href="'), z("canonical_url"), F.lit('">'))).otherwise(""),
        F.lit("</head><body><h1>"), z("h1"), F.lit("</h1>"), each(F.coalesce("headings", none), "<h2>", "</h2>"), each(lines, "<p>", "</p>"),
        each(F.coalesce("internal_links", none), '<a href="', '">x</a>'), each(F.coalesce("external_links", none), '<a href="', '">x</a>'), F.lit("</body></html>"),
    )
    return pages.filter(F.col("url").isNotNull()).select("run_id", "crawl_seq", F.struct("run_id", "crawl_seq").alias("page"), F.trim("url").alias("url"), html.alias("html"))


_LINES = f"list_filter(list_transform(string_split(coalesce(body_text, ''), chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '')"
_HEADS = f"list_distinct(list_filter(list_transform(list_concat([coalesce(h1, '')], coalesce(headings, [])), lambda x: {fold_sql('x')}), lambda x: x <> ''))"


@query(
    f"WITH {PAGES} SELECT run_id, crawl_seq, {fold_sql("coalesce(title, '')")} AS title, {fold_sql("coalesce(h1, '')")} AS h1, CAST(len({_HEADS}) AS INT) AS headings, coalesce({_LINES}[1], '') AS first_paragraph, CAST(len({_LINES}) AS INT) AS paragraphs, "
    f"CAST(len(list_distinct(list_transform(coalesce(internal_links, []), lambda x: {url_sql('x')}))) AS INT) AS internal_links, nullif(trim(author), '') AS author, nullif(trim(publisher), '') AS publisher, strftime(date_published, '%Y-%m-%dT%H:%M:%S.000Z') AS published, "
    "coalesce(len(list_filter(robots_meta, lambda x: contains(lower(x), 'noindex'))) > 0, false) AS noindex FROM pages WHERE url IS NOT NULL"
)
def html_documents(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as HTML and read again."""
    rows = html_pages(html_rows(_snap(spark, d)), "page")
    return rows.select("page.run_id", "page.crawl_seq", "title", "h1", F.size("headings").alias("headings"), "first_paragraph", F.col("paragraph_count").alias("paragraphs"), F.size("internal_links").alias("internal_links"), "author", "publisher", F.col("date_published").alias("published"), "noindex")



def _relation(spark: SparkSession, d: str, name: str, columns: dict[str, str]) -> DataFrame:
    return relation(report_elements(table(spark, d, "audit_runs"), with_values=True), "run_id", name, columns)


def _number(path: str) -> str:
    return f"CAST(json_extract(v, '$.{path}') AS DOUBLE)"


_MODE = "CASE WHEN json_valid(request_json) THEN json_extract_string(request_json, '$.mode') END"


@query(f"WITH {RUNS}, n AS (SELECT id, created_at, {_MODE} AS mode FROM runs ORDER BY created_at DESC, id LIMIT 20) SELECT id, created_at FROM n WHERE mode = 'page'")
def page_mode_runs(spark: SparkSession, d: str) -> DataFrame:
    """Of the 20 newest runs those of one page; the listing's length comes first, as in a page of a list."""
    return U.newest(table(spark, d, "audit_runs")).filter(U.mode() == "page").select("id", "created_at")


@query(f"WITH {RUNS}, t AS (SELECT id, created_at, {url_sql('target_url')} AS target FROM runs WHERE target_url IS NOT NULL AND created_at IS NOT NULL) SELECT target, arg_min(id, {{'a': created_at, 'b': id}}) AS id, min(created_at) AS created_at FROM t GROUP BY target")
def first_runs(spark: SparkSession, d: str) -> DataFrame:
    """The first run of every target."""
    rows = U.runs(table(spark, d, "audit_runs")).filter(F.col("target_url").isNotNull() & F.col("created_at").isNotNull())
    return R.unique_first(rows.select(url_col(F.col("target_url")).alias("target"), "id", "created_at"), ["target"], ["created_at", "id"])


_IMPACT = RELATIONS.index("implementationPacks.predictedImpact.categories")


@query(
    _relations(
        f"SELECT run_id, parent_path, category, gain, CAST(rank_no AS INT) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY run_id, parent_path ORDER BY gain DESC, category) AS rank_no FROM (SELECT id AS run_id, regexp_replace(path, '/[^/]*$', '') AS parent_path, {_text('id')} AS category, CAST(round(CAST({_number('after')} - {_number('before')} AS DECIMAL(18, 9)), 1) AS DOUBLE) AS gain FROM r{_IMPACT}) WHERE gain > 0) WHERE rank_no <= 4"
    )
)
def top_gains(spark: SparkSession, d: str) -> DataFrame:
    """The four categories of each implementation pack that would gain most."""
    rows = _relation(spark, d, "implementationPacks.predictedImpact.categories", {"id": "string", "before": "double", "after": "double"})
    gains = rows.select("run_id", "parent_path", F.col("id").alias("category"), T.round1(F.col("after") - F.col("before")).alias("gain")).filter("gain > 0")
    return R.first_per_group(gains, ["run_id", "parent_path"], [F.desc("gain"), F.col("category")], 4)


_TARGETS = f"{_RUNS}, s AS (SELECT id, {url_sql('target_url')} AS target, completed_at, json_extract(summary, '$.totalScore') AS a, json_extract(summary, '$.totalPages') AS b FROM runs WHERE status = 'completed' AND json_type(summary) = 'OBJECT' AND target_url IS NOT NULL)"


@query(f"WITH {_TARGETS}, u AS (SELECT target, completed_at, id, 'totalScore' AS name, CAST(a AS DOUBLE) AS value FROM s UNION ALL SELECT target, completed_at, id, 'totalPages', CAST(b AS DOUBLE) FROM s) SELECT * FROM u WHERE value IS NOT NULL")
def score_series(spark: SparkSession, d: str) -> DataFrame:
    """Total score and number of pages of every target over its runs, without nulls."""
    from skarv.operators.shred import Plan, shred

    runs = table(spark, d, "audit_runs")
    rows = shred(runs, "id", Plan({"summary_json": ""}, [], {"summary_json": "summary"}), by="ingested_at", with_values=True)
    totals = relation(rows, "id", "summary", {"totalScore": "double", "totalPages": "double"}).select("id", "totalScore", "totalPages")
    done = U.runs(runs).filter((F.col("status") == "completed") & F.col("target_url").isNotNull()).select("id", url_col(F.col("target_url")).alias("target"), "completed_at")
    return R.series(done.join(totals, "id"), ["target", "id"], "completed_at", ["totalScore", "totalPages"])


_SUGGESTED, _CLUSTER, _MEMBERS, _ISSUES = (RELATIONS.index(n) for n in ("pageSuggestions", "topicClusters", "topicClusters.pages", "issues"))


@query(_relations(f"SELECT s.id AS run_id, s.path AS elem_path, p.path AS page_path, json_extract_string(s.v, '$.intent') AS intent, json_extract_string(p.v, '$.title') AS title FROM r{_SUGGESTED} s JOIN r{_PAGES} p ON p.id = s.id AND json_extract_string(p.v, '$.url') = json_extract_string(s.v, '$.url')"))
def suggested_pages(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions with the pages they are for; those whose page isn't in the report drop out."""
    rows = report_elements(table(spark, d, "audit_runs"), with_values=True)
    suggestions = relation(rows, "run_id", "pageSuggestions", {"url": "string", "intent": "string"}).select("run_id", "elem_path", "url", "intent")
    pages = relation(rows, "run_id", "pages", {"url": "string", "title": "string"}).select("run_id", F.col("elem_path").alias("page_path"), "url", "title")
    return suggestions.join(pages, ["run_id", "url"]).drop("url")


@query(
    _relations(
        f"SELECT c.id AS run_id, json_extract_string(c.v, '$.name') AS name, coalesce(n, 0) AS pages, CAST(row_number() OVER (PARTITION BY c.id ORDER BY coalesce(n, 0) DESC, CAST(json_extract(c.v, '$.score') AS DOUBLE) DESC NULLS LAST, CAST(c.path AS INT)) AS INT) AS rank_no "
        f"FROM r{_CLUSTER} c LEFT JOIN (SELECT id, regexp_replace(path, '/[^/]*$', '') AS above, count(*) AS n FROM r{_MEMBERS} GROUP BY ALL) m ON m.id = c.id AND m.above = c.path"
    )
)
def cluster_order(spark: SparkSession, d: str) -> DataFrame:
    """The topic clusters of a report: the largest first, then by score, then as they came."""
    rows = report_elements(table(spark, d, "audit_runs"), with_values=True)
    sizes = rows.filter("rel = 'topicClusters.pages'").groupBy("run_id", F.col("parent_path").alias("elem_path")).agg(F.count("*").alias("n"))
    found = relation(rows, "run_id", "topicClusters", {"name": "string", "score": "double"}).join(sizes, ["run_id", "elem_path"], "left").withColumn("pages", F.coalesce("n", F.lit(0)))
    ranked = R.first_per_group(found, ["run_id"], [F.desc("pages"), F.desc_nulls_last("score"), F.col("elem_path").cast("int")], 2**31 - 1)
    return ranked.select("run_id", "name", "pages", "rank_no")


@query(_relations(f"SELECT id AS run_id, 'issues' AS rel, path AS elem_path, {_text('id')} AS what FROM r{_ISSUES} WHERE CAST(path AS INT) < 3 UNION ALL SELECT id, 'pages', path, {_text('url')} FROM r{_PAGES} WHERE CAST(path AS INT) < 12"))
def report_heads(spark: SparkSession, d: str) -> DataFrame:
    """What a report shows first: three issues and twelve pages."""
    rows = report_elements(table(spark, d, "audit_runs"), with_values=True)
    first = lambda rel, key, n: relation(rows, "run_id", rel, {key: "string"}).filter(F.col("elem_path").cast("int") < n).select("run_id", "rel", "elem_path", F.col(key).alias("what"))
    return first("issues", "id", 3).unionByName(first("pages", "url", 12))


_RULE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(S.KINDS)) + " END"


@query(f"WITH {FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {_RULE}, subject) AS r FROM found) SELECT domain, count(*) AS opportunity_count, max(kind) FILTER (WHERE r = 1) AS first_kind FROM r WHERE r <= 100 GROUP BY domain")
def opportunity_headers(spark: SparkSession, d: str) -> DataFrame:
    """The header of each domain's snapshot of opportunities: how many of them, at most 100 in the order of the rules."""
    rule = F.array_position(F.array(*[F.lit(k) for k in S.KINDS]), F.col("kind"))
    headers, items = R.snapshot_of(S.opportunities(*_windows(spark, d), METRICS_AS_OF), [rule, F.col("subject")])
    return headers.join(items.filter("rank_no = 1").select("domain", F.col("kind").alias("first_kind")), "domain")


@query()  # words are decomposed, which SQL can't
def page_keywords(spark: SparkSession, d: str) -> DataFrame:
    pages = P.counting(_snap(spark, d), ["url", "path", "h1", "title", "publisher", "author", "schema"])
    host = host_col(F.col("url"))
    return pages.select(*P.KEYS, keywords("path", "h1", "title").alias("keyword"), brands("publisher", "author", "h1", F.col("schema.types"), host).alias("brand"), slugs("title").alias("slug"))


_LISTED = "CASE WHEN len(h) = 0 THEN '' WHEN len(h) = 1 THEN h[1] ELSE array_to_string(h[1:len(h) - 1], ', ') || ' og ' || h[len(h)] END"
SQL["text_excerpts"] = (
    f"WITH {PAGES} SELECT run_id, crawl_seq, {excerpt_sql('body_text', 320)} AS excerpt, {_cut_sql(fold_sql('body_text'), 155, 20, '')} AS short, array_to_string(string_split_regex(first_paragraph, '\\.\\s+')[1:2], '. ') AS opening, "
    f"(SELECT {_LISTED} FROM (SELECT coalesce(headings, [])[1:3] AS h)) AS listed FROM pages"
)
