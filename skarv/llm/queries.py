"""Queries of the training-text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarv.functions.urls import domain_key, page_key, query_key
from skarv.llm.boilerplate import boilerplate, main_content
from skarv.llm.leaks import leaks
from skarv.llm.repeats import field_name, line_counts, page_lines, repeats, without_repeats
from skarv.llm.stuffing import stuffed_pages
from skarv.llm.tokens import encode_corpus
from skarv.llm.topn import top_n
from skarv.plans.metrics import counting_sql
from skarv.plans.pages import url_sql
from skarv.runtime import cut
from skarv.sources.tables import latest_value, table


def query_totals(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, names): g1, g2, query, impressions of the counting rows, and g1, g2, domain, page.

    Null impressions count as 0, blank queries are left out. Groups travel as two 64-bit hashes of domain and page, not as texts;
    the names are joined to the result only.
    """
    domain, page = domain_key(F.col("domain")), page_key(F.col("page"))
    known = [F.coalesce(c, F.lit("\0")) for c in (domain, page)]
    group = [F.xxhash64(*known).alias("g1"), F.xxhash64(F.lit(1), *known).alias("g2")]
    names = rows.select(*group, domain.alias("domain"), page.alias("page")).distinct()
    keyed = rows.select(*group, "date", query_key(F.col("query")).alias("query"), "impressions", "ingested_at")
    counting = latest_value(keyed.filter(F.col("query") != ""), ["g1", "g2", "query", "date"], "impressions")
    return counting.groupBy("g1", "g2", "query").agg(F.sum(F.coalesce("impressions", F.lit(0))).alias("impressions")), names


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    totals, names = query_totals(table(spark, d, "gsc_page_query_daily"))
    top = top_n(cut(totals, "query-totals"), ["g1", "g2"], "impressions", ["query"], 10)
    return top.join(names, ["g1", "g2"]).select("domain", "page", "query", "rank_no")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate(table(spark, d, "page_snapshots"), table(spark, d, "audit_runs"))


def p3_main(spark: SparkSession, d: str) -> DataFrame:
    return main_content(table(spark, d, "page_snapshots"), table(spark, d, "audit_runs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats(table(spark, d, "page_snapshots"), table(spark, d, "audit_runs"))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_repeats(table(spark, d, "page_snapshots"), table(spark, d, "audit_runs"))


def p5_lines(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of a site are on how many pages, in how many clusters of equal documents, on how many dates."""
    counts = line_counts(page_lines(table(spark, d, "page_snapshots"), table(spark, d, "audit_runs")))
    return counts.groupBy("site", field_name(F.col("f")).alias("field_name"), "pages", "clusters", "days").agg(F.count("*").alias("line_count"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffed_pages(table(spark, d, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_main, p5_found, p5_clean, p5_lines, p6_found, p8_ids, p9_found, p10_found)}
_LINES = (
    "runs AS (SELECT id, lower(regexp_extract(trim(target_url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS site FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM audit_runs) WHERE rn = 1), "
    f"p AS (SELECT run_id, crawl_seq, site, {url_sql('url')} AS url, CAST(date_published AS DATE) AS day, body_text, headings FROM (SELECT *, row_number() OVER (PARTITION BY run_id, crawl_seq ORDER BY ingested_at DESC) AS rn2 FROM page_snapshots) q JOIN runs ON runs.id = q.run_id WHERE rn2 = 1 AND site <> ''), "
    "f AS (SELECT run_id, crawl_seq, site, url, day, 'body_text' AS field_name, string_split(body_text, chr(10)) AS lines FROM p UNION ALL SELECT run_id, crawl_seq, site, url, day, 'headings', headings FROM p), "
    r"l AS (SELECT run_id, crawl_seq, site, url, day, field_name, generate_subscripts(lines, 1) - 1 AS line_no, regexp_replace(lower(unnest(lines)), '[^\p{L}]+', '', 'g') AS k FROM f), "
    "c AS (SELECT site, field_name, k FROM l WHERE k <> '' GROUP BY ALL HAVING count(DISTINCT url) >= 8)"
)
SQL: dict[str, str] = {
    "p5_found": f"WITH {_LINES} SELECT run_id, crawl_seq, field_name, CAST(line_no AS INT) AS line_no FROM l JOIN c USING (site, field_name, k)",
    "p6_found": f"WITH {counting_sql('gsc_page_query_daily')}, t AS (SELECT domain, page, query, sum(coalesce(impressions, 0)) AS n FROM c_gsc_page_query_daily GROUP BY ALL) "
    "SELECT domain, page, query, CAST(rank_no AS INT) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY domain, page ORDER BY n DESC, query) AS rank_no FROM t) WHERE rank_no <= 10",
}
SQL["p5_clean"] = (
    f"WITH {_LINES}, bad AS (SELECT DISTINCT run_id, crawl_seq, field_name, line_no FROM l JOIN c USING (site, field_name, k)), "
    "s AS (SELECT run_id, crawl_seq, string_split(body_text, chr(10)) AS b, headings AS h FROM (SELECT *, row_number() OVER (PARTITION BY run_id, crawl_seq ORDER BY ingested_at DESC) AS rn FROM page_snapshots) WHERE rn = 1), "
    "g AS (SELECT run_id, crawl_seq, list(line_no) FILTER (WHERE field_name = 'body_text') AS x, list(line_no) FILTER (WHERE field_name = 'headings') AS y FROM bad GROUP BY ALL) "
    "SELECT run_id, crawl_seq, array_to_string(list_filter(b, lambda v, i: NOT list_contains(coalesce(x, []), i - 1)), chr(10)) AS body_text, list_filter(h, lambda v, i: NOT list_contains(coalesce(y, []), i - 1)) AS headings FROM s LEFT JOIN g USING (run_id, crawl_seq)"
)
# a document is its two lists of letters; crawls of a page are one page, in the cluster of its least known one
SQL["p5_lines"] = (
    f"WITH {_LINES}, x AS (SELECT run_id, crawl_seq, list(k ORDER BY line_no) FILTER (WHERE field_name = 'body_text') AS b, list(k ORDER BY line_no) FILTER (WHERE field_name = 'headings') AS h FROM l GROUP BY ALL), "
    "y AS (SELECT l.site, l.field_name, l.k, l.url, l.day, dense_rank() OVER (ORDER BY b, h) AS doc FROM l JOIN x USING (run_id, crawl_seq)), "
    "z AS (SELECT site, field_name, k, url, min(doc) AS doc, min(day) AS day FROM y WHERE k <> '' GROUP BY ALL), "
    "v AS (SELECT site, field_name, k, doc, count(*) AS n, min(day) AS day FROM z GROUP BY ALL), "
    "w AS (SELECT site, field_name, k, CAST(sum(n) AS BIGINT) AS pages, count(*) AS clusters, CAST(count(DISTINCT day) AS INT) AS days FROM v GROUP BY ALL) "
    "SELECT site, field_name, pages, clusters, days, count(*) AS line_count FROM w GROUP BY ALL"
)
