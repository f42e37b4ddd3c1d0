"""Queries over crawled pages and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarv.functions import labels as B
from skarv.functions import text as T
from skarv.functions.urls import host_col, url_col
from skarv.operators import clusters as C
from skarv.operators import insights as I
from skarv.operators import pages as P
from skarv.sources.tables import table

AS_OF = "2026-07-01 00:00:00"

#: Counting rows in SQL.
PAGES = "pages AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, crawl_seq ORDER BY ingested_at DESC) AS rn FROM page_snapshots) WHERE rn = 1)"
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


FLAGS_SQL = {
    "eligible": "NOT coalesce(blocked_by_robots, false) AND NOT coalesce(noindex, false) AND coalesce(contains(content_type, 'text/html'), false) AND (status_code IS NULL OR status_code < 400)",
    "cluster_eligible": "NOT coalesce(blocked_by_robots, false) AND NOT coalesce(noindex, false) AND coalesce(contains(content_type, 'text/html'), false) AND coalesce(word_count > 80, false)",
    "render_eligible": "NOT coalesce(blocked_by_robots, false) AND coalesce(contains(content_type, 'text/html'), false) AND (status_code IS NULL OR status_code < 400)",
    "broken": "coalesce(status_code >= 400, false)",
    "orphan": "coalesce(discovered_from <> 'seed' AND inbound_links = 0, false)",
    "deep": "coalesce(click_depth >= 4, false)",
    "snippet_restricted": "coalesce(snippet_directives.no_snippet, false) OR coalesce(snippet_directives.data_no_snippet, false) OR coalesce(snippet_directives.max_snippet = 0, false)",
    "schema_mismatch": "coalesce(schema.item_count > 0, false) AND NOT coalesce(schema.matches_visible_content, false)",
    "render_heavy": "coalesce(rendering.rendering_model = 'csr', false) OR coalesce(rendering.render_delta_ratio > 1.8, false)",
    "dated": "date_modified IS NOT NULL OR date_published IS NOT NULL",
    "cited": "coalesce(author <> '', false) OR coalesce(publisher <> '', false) OR coalesce(len(external_links) > 0, false)",
    "titled": "coalesce(length(title) >= 15, false)",
    "described": "coalesce(length(meta_description) >= 50, false)",
    "canonical": "coalesce(canonical_url <> '', false)",
    "alt_ok": "coalesce(image_count = 0, false) OR coalesce(images_without_alt = 0, false)",
    "transcribed": "coalesce(has_transcript_signals, false) OR coalesce(image_count = 0, false)",
    "transparent": "coalesce(author <> '', false) OR coalesce(publisher <> '', false) OR coalesce(has_about_link, false) OR coalesce(has_contact_link, false)",
}


@query(f"WITH {PAGES} SELECT run_id, crawl_seq, " + ", ".join(f"CAST(({v}) AS INT) AS {k}" for k, v in FLAGS_SQL.items()) + " FROM pages")
def page_flags(spark: SparkSession, d: str) -> DataFrame:
    return P.page_flags(_snap(spark, d))


EDGES = "edges AS (SELECT run_id, crawl_seq, url AS src, generate_subscripts(internal_links, 1) - 1 AS pos, unnest(internal_links) AS dst FROM pages)"


@query(f"WITH {PAGES}, {EDGES} SELECT run_id, crawl_seq, src, CAST(pos AS INT) AS pos, dst FROM edges")
def link_edges(spark: SparkSession, d: str) -> DataFrame:
    return P.edges(_snap(spark, d))


@query(f"WITH {PAGES}, {EDGES}, n AS (SELECT run_id, dst, count(*) AS n FROM edges GROUP BY ALL) SELECT p.run_id, p.crawl_seq, p.url, coalesce(n.n, 0) AS inbound FROM pages p LEFT JOIN n ON n.run_id = p.run_id AND n.dst = p.url")
def inbound_links(spark: SparkSession, d: str) -> DataFrame:
    return P.inbound(_snap(spark, d))


@query(
    f"WITH {PAGES}, {EDGES}, bad AS (SELECT DISTINCT run_id, url FROM pages WHERE status_code >= 400) "
    "SELECT e.run_id, e.crawl_seq, string_agg(e.dst, ' ' ORDER BY e.pos) AS broken FROM edges e JOIN bad ON bad.run_id = e.run_id AND bad.url = e.dst GROUP BY ALL"
)
def broken_links(spark: SparkSession, d: str) -> DataFrame:
    return P.broken_links(_snap(spark, d))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_SHARES = {"schema_coverage": "coalesce(schema.item_count > 0, false)", **{f"{k}_share": FLAGS_SQL[k] for k in ("dated", "cited", "titled", "described", "canonical", "alt_ok", "transcribed", "transparent")}}
METRICS = (
    f"f AS (SELECT *, ({FLAGS_SQL['eligible']}) AS e, coalesce(date_modified, date_published) AS stamp FROM pages), "
    "metrics AS (SELECT run_id, count(*) AS pages, CAST(count_if(e) AS BIGINT) AS eligible, "
    + ", ".join(f"CAST(count_if(({FLAGS_SQL[v]}){'' if k == 'broken' else ' AND e'}) AS BIGINT) AS {k}" for k, v in {"broken": "broken", "orphans": "orphan", "deep": "deep", "restricted": "snippet_restricted", "mismatch": "schema_mismatch", "render_heavy": "render_heavy"}.items())
    + ", CAST(count_if(e AND coalesce(faq_count > 0, false)) AS BIGINT) AS faq_pages, CAST(count_if(coalesce(blocked_by_robots, false)) AS BIGINT) AS blocked, CAST(count_if(coalesce(noindex, false)) AS BIGINT) AS noindex, greatest(0, coalesce(max(click_depth) FILTER (WHERE e), 0)) AS max_depth, "
    "coalesce(avg(CASE WHEN e THEN coalesce(answer_first_signals.direct_answer_likelihood, 0) END), 0) AS answer_first, "
    f"coalesce(avg(CASE WHEN e AND stamp IS NOT NULL THEN 100 - least(100.0, greatest(0.0, greatest(0.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(stamp)) / 86400000000.0) / 365 * 100)) END), 0) AS freshness, "
    + ", ".join(f"CASE WHEN count_if(e) = 0 THEN 0.0 ELSE count_if(e AND ({v})) * 100.0 / count_if(e) END AS {k}" for k, v in _SHARES.items())
    + ", "
    + ", ".join(f"CAST(count_if(list_contains(robots_evaluation.blocked_providers, '{p}')) AS BIGINT) AS blocked_{p}" for p in P.PROVIDERS)
    + " FROM f GROUP BY run_id)"
)
_DOUBLES = ["answer_first", "freshness", *_SHARES]


@query(f"WITH {PAGES}, {METRICS} SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _DOUBLES)}) FROM metrics")
def site_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(P.site_metrics(_snap(spark, d), AS_OF))


def metrics_sql(source: str, name: str) -> str:
    """The CTEs of site metrics over another table of pages."""
    text = METRICS.replace("f AS (", f"f_{name} AS (", 1).replace("FROM pages)", f"FROM {source})", 1)
    return text.replace("metrics AS (", f"{name} AS (", 1).replace("FROM f GROUP", f"FROM f_{name} GROUP", 1)


def one_decimal(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(18, 9)), 1) AS DOUBLE)"


_FAQ, _ELIGIBLE = "CASE WHEN faq_pages > 0 THEN {} ELSE 0 END", "CAST({} AS DOUBLE) * 100 / greatest(eligible, 1)"
#: The site scores of an audit without topic clusters, over a row of metrics.
SCORES_SQL = {
    "crawlabilityIndexation": f"100 - blocked * 4 - noindex * 3 - broken * 5 - {one_decimal(_ELIGIBLE.format('orphans') + ' * 0.7')}",
    "renderingAiAccessibility": f"100 - {one_decimal(_ELIGIBLE.format('render_heavy') + ' * 1.1')} - (CASE WHEN max_depth > 5 THEN 8 ELSE 0 END)",
    "answerFirstContent": f"answer_first * 0.8 + {_FAQ.format(12)}",
    "citationAuthorityEntitySignals": "cited_share * 0.55 + transparent_share * 0.45",
    "schemaSemanticSearch": "schema_coverage * 0.75 + (CASE WHEN mismatch = 0 THEN 15 ELSE 0 END) - mismatch * 4",
    "internalLinking": f"100 - {one_decimal(_ELIGIBLE.format('orphans') + ' * 0.8')} - {one_decimal(_ELIGIBLE.format('deep') + ' * 0.4')}",
    "searchIntentTopicClusters": "8",
    "zeroClickAiOverviews": f"answer_first * 0.5 + schema_coverage * 0.2 + (CASE WHEN restricted > 0 THEN -20 ELSE 15 END) + {_FAQ.format(15)}",
    "contentFreshness": "dated_share * 0.4 + freshness * 0.6",
    "technicalOptimization": "titled_share * 0.25 + described_share * 0.2 + canonical_share * 0.2 + alt_ok_share * 0.2 + transcribed_share * 0.15",
}


def _score(k: str) -> str:
    return one_decimal(f"least(100.0, greatest(0.0, CAST({SCORES_SQL[k]} AS DOUBLE)))")


def scores_sql(metrics: str) -> str:
    return " UNION ALL ".join(f"SELECT run_id, '{k}' AS score_id, {_score(k)} AS score, {P.WEIGHTS[k]} AS weight FROM {metrics}" for k in SCORES_SQL)


def totals_sql(scores: str) -> str:
    return f"SELECT run_id, {one_decimal('CAST(sum(CAST(round(score * 10) AS BIGINT) * weight) AS DOUBLE) / sum(weight) / 10')} AS total FROM {scores} GROUP BY run_id"


@query(f"WITH {PAGES}, {METRICS} {scores_sql('metrics')}")
def page_mode_scores(spark: SparkSession, d: str) -> DataFrame:
    """The scores of every run as of an audit without topic clusters."""
    return P.site_scores(P.site_metrics(_snap(spark, d), AS_OF))


@query()  # topic clusters are led by crawl order: SQL has no such fold
def site_scores(spark: SparkSession, d: str) -> DataFrame:
    return P.site_scores(P.site_metrics(_snap(spark, d), AS_OF), C.topic_clusters(_snap(spark, d)))


@query()
def provider_scores(spark: SparkSession, d: str) -> DataFrame:
    return P.provider_scores(P.site_metrics(_snap(spark, d), AS_OF))


@query(f"WITH {PAGES}, {METRICS}, scores AS ({scores_sql('metrics')}) {totals_sql('scores')}")
def total_scores(spark: SparkSession, d: str) -> DataFrame:
    return P.total_score(P.site_scores(P.site_metrics(_snap(spark, d), AS_OF)))


@query()
def answer_quality(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(P.page_answers(_snap(spark, d)))


INTENT = (
    "CASE WHEN regexp_matches(hay, 'buy|pricing|price|bestill|kjøp|kontakt salg|demo|book|start now|registrer') THEN 'transactional' "
    "WHEN regexp_matches(hay, 'vs|compare|comparison|alternatives|beste|review|top|why us|case study') THEN 'commercial investigation' "
    "WHEN regexp_matches(hay, 'login|signin|logg inn|dashboard|account|konto|home') THEN 'navigational' ELSE 'informational' END AS intent"
)
HAY = "hay AS (SELECT run_id, crawl_seq, lower(coalesce(path, '') || ' ' || coalesce(title, '') || ' ' || coalesce(h1, '') || ' ' || coalesce(meta_description, '')) AS hay FROM pages)"


@query(f"WITH {PAGES}, {HAY} SELECT run_id, crawl_seq, {INTENT} FROM hay")
def page_intents(spark: SparkSession, d: str) -> DataFrame:
    return P.page_intents(_snap(spark, d))


@query(
    f"WITH {PAGES}, {HAY}, i AS (SELECT run_id, crawl_seq, {INTENT} FROM hay), c AS (SELECT run_id, intent, count(*) AS pages, min(crawl_seq) AS first FROM i GROUP BY ALL) "
    "SELECT run_id, intent, pages FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pages DESC, first) AS r FROM c) WHERE r = 1"
)
def run_intents(spark: SparkSession, d: str) -> DataFrame:
    return P.run_intents(_snap(spark, d))


PRIORITY = (
    "(CASE WHEN t < 200 THEN 40 WHEN t < 500 THEN 20 WHEN t < 1000 THEN 5 ELSE 0 END) + (CASE WHEN s > 10 THEN 30 WHEN s > 5 THEN 15 WHEN s > 3 THEN 5 ELSE 0 END) + "
    "(CASE WHEN p IN ('', '/') THEN 40 WHEN regexp_matches(p, '^/(blog|articles?|posts?|nyheter|innlegg)/[^/]+$') THEN 35 "
    "WHEN regexp_matches(p, '^/(produkt|product|tjeneste|service|solutions?|losning|losninger)') THEN 30 WHEN regexp_matches(p, '^/(kategori|category|topics?|tema)') THEN 20 "
    "WHEN regexp_matches(p, '^/(pris|pricing|price|cost)') THEN 25 ELSE 0 END) + "
    "(CASE WHEN regexp_matches(p, '^/(om|about|kontakt|contact|personvern|privacy|vilkar|terms|404|sitemap)') THEN -40 ELSE 0 END) + (CASE WHEN t > 2000 THEN -30 ELSE 0 END) + (CASE WHEN s = 0 THEN -20 ELSE 0 END)"
)


@query(
    f"WITH {PAGES}, c AS (SELECT run_id, crawl_seq, coalesce(rendering.raw_text_length, 0) AS t, coalesce(script_count, 0) AS s, coalesce(path, '') AS p FROM pages WHERE {FLAGS_SQL['render_eligible']}), "
    f"q AS (SELECT run_id, crawl_seq, {PRIORITY} AS priority FROM c) SELECT run_id, crawl_seq, CAST(priority AS INT) AS priority, CAST(rank_no AS INT) AS rank_no "
    "FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY priority DESC, crawl_seq) AS rank_no FROM q) WHERE rank_no <= 10"
)
def render_candidates(spark: SparkSession, d: str) -> DataFrame:
    return P.render_candidates(_snap(spark, d))


@query()
def page_trust(spark: SparkSession, d: str) -> DataFrame:
    return P.page_trust(_snap(spark, d))


@query()
def run_trust(spark: SparkSession, d: str) -> DataFrame:
    return P.run_trust(_snap(spark, d))


@query()
def trust_gaps(spark: SparkSession, d: str) -> DataFrame:
    return P.trust_gaps(_snap(spark, d))


@query(
    f"WITH {PAGES}, t AS (SELECT run_id, crawl_seq, coalesce(rendering.raw_text_length, 0) AS a, coalesce(rendering.rendered_text_length, 0) AS b, coalesce(script_count, 0) AS s FROM pages) "
    "SELECT run_id, crawl_seq, CASE WHEN a > 1500 THEN 'ssr' WHEN a > 400 OR s <= 5 THEN 'hybrid' WHEN s > 5 AND a < 300 THEN 'csr' ELSE 'unknown' END AS guessed, "
    "CASE WHEN b > a * 2.2 AND a < 400 THEN 'csr' WHEN b > a * 1.2 THEN 'hybrid' ELSE 'ssr' END AS seen, round(CASE WHEN a > 0 THEN CAST(b AS DOUBLE) / a WHEN b > 0 THEN 10 ELSE 1 END, 6) AS ratio FROM t"
)
def rendering_models(spark: SparkSession, d: str) -> DataFrame:
    pages = P.counting(_snap(spark, d), ["rendering", "script_count"])
    raw, seen, scripts = (F.coalesce(c, F.lit(0)) for c in ("rendering.raw_text_length", "rendering.rendered_text_length", "script_count"))
    return pages.select(*P.KEYS, P.rendering_model(raw, scripts).alias("guessed"), P.rendered_model(raw, seen).alias("seen"), F.round(P.render_ratio(raw, seen).cast("double"), 6).alias("ratio"))


def url_sql(u: str) -> str:
    """A URL's normal form in SQL."""
    part = lambda pattern: f"regexp_extract(trim({u}), '{pattern}', 1)"
    scheme, host = f"lower({part('^([A-Za-z][A-Za-z0-9+.-]*)://')})", f"lower({part('^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)')})"
    path, port, rest = part("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"), part("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*:([0-9]+)"), part(r"^[^?#]*(\?[^#]*)")
    return (
        f"{scheme} || '://' || {host} || (CASE WHEN {port} = '' OR ({scheme} = 'https' AND {port} = '443') OR ({scheme} = 'http' AND {port} = '80') THEN '' ELSE ':' || {port} END) || "
        f"(CASE WHEN {path} IN ('', '/') THEN '/' WHEN {rest} = '' AND right({path}, 1) = '/' THEN left({path}, length({path}) - 1) ELSE {path} END) || {rest}"
    )


_HOST = r"lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = "regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(f"WITH {PAGES} SELECT run_id, crawl_seq, {url_sql('url')} AS url, {_HOST} AS host, CASE WHEN {_PATH} IN ('', '/') THEN {_HOST} ELSE {_HOST} || {_PATH} END AS shown FROM pages WHERE url IS NOT NULL")
def url_forms(spark: SparkSession, d: str) -> DataFrame:
    pages = P.counting(_snap(spark, d), ["url"]).filter(F.col("url").isNotNull())
    u = F.trim("url")
    return pages.select(*P.KEYS, url_col(F.col("url")).alias("url"), host_col(u).alias("host"), T.human_path(u).alias("shown"))


@query(
    f"WITH {PAGES}, t AS (SELECT run_id, crawl_seq, coalesce(title, '') AS t, coalesce(h1, '') AS h, coalesce(headings, []) AS hs, coalesce(path, '') AS p, coalesce(url, '') AS u FROM pages) "
    r"SELECT run_id, crawl_seq, trim(regexp_replace(t, '\s+', ' ', 'g')) AS folded, trim(regexp_replace(regexp_replace(trim(regexp_replace(h, '\s+', ' ', 'g')), '[|:–-].*$', ''), '\s+$', '')) AS heading, "
    "upper(left(h, 1)) || substring(h, 2) AS upper_first, left(sha1(u), 12) AS hash, "
    "array_to_string(hs[1:3], ', ') || (CASE WHEN len(hs) > 3 THEN ' +' || (len(hs) - 3) ELSE '' END) AS listed, array_to_string(list_filter(string_split_regex(p, '[-_/]'), lambda w: length(w) > 2), ' ') AS words FROM t"
)
def text_forms(spark: SparkSession, d: str) -> DataFrame:
    pages = P.counting(_snap(spark, d), ["title", "h1", "headings", "path", "url"])
    z = lambda c: F.coalesce(c, F.lit(""))
    hs = F.coalesce("headings", F.array().cast("array<string>"))
    return pages.select(
        *P.KEYS,
        T.fold_space(z("title")).alias("folded"),
        T.clean_heading(z("h1")).alias("heading"),
        T.first_upper(z("h1")).alias("upper_first"),
        T.short_hash(z("url")).alias("hash"),
        T.list_summary(hs).alias("listed"),
        F.array_join(T.slug_words(z("path")), " ").alias("words"),
    )


@query()
def text_excerpts(spark: SparkSession, d: str) -> DataFrame:
    pages = P.counting(_snap(spark, d), ["first_paragraph", "body_text", "headings"])
    body = F.col("body_text")
    return pages.select(*P.KEYS, T.excerpt(body, 320).alias("excerpt"), T.trim_to(body, 155).alias("short"), T.opening_sentences(F.col("first_paragraph")).alias("opening"), T.list_sentence(F.coalesce("headings", F.array().cast("array<string>"))).alias("listed"))


# term statistics and clusters
TOKENS = (
    f"{PAGES}, docs AS (SELECT run_id, crawl_seq, regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(h1, '')), '[^a-z0-9\\s-]', ' ', 'g') AS t FROM pages WHERE {FLAGS_SQL['cluster_eligible']}), "
    "tok AS (SELECT run_id, crawl_seq, token FROM (SELECT run_id, crawl_seq, unnest(string_split_regex(t, '\\s+')) AS token FROM docs) WHERE length(token) > 2)"
)


@query(
    f"WITH {TOKENS}, tf AS (SELECT run_id, crawl_seq, token, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT run_id, token, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT run_id, count(*) AS n FROM docs GROUP BY ALL), "
    "len AS (SELECT run_id, crawl_seq, sum(tf) AS len FROM tf GROUP BY ALL) SELECT tf.run_id, tf.crawl_seq, tf.token, tf.tf, df.df, round(CAST(tf.tf AS DOUBLE) / CAST(len.len AS DOUBLE) * (ln((1.0 + n.n) / (1.0 + df.df)) + 1), 6) AS weight "
    "FROM tf JOIN df USING (run_id, token) JOIN n USING (run_id) JOIN len USING (run_id, crawl_seq)"
)
def term_weights(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.term_weights(C.ascii_documents(_snap(spark, d))))


@query()
def topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    return C.topic_clusters(_snap(spark, d))


@query()
def topic_members(spark: SparkSession, d: str) -> DataFrame:
    return C.members(C.documents(_snap(spark, d)))


# findings
_ISSUES = {
    "rendering-csr": "render_heavy > 0",
    "schema-mismatch": "mismatch > 0",
    "orphan-pages": "orphans > 0",
    "snippet-controls": "restricted > 0",
    "answer-first": "answer_first < 60",
    "trust-signals": "transparent_share < 50",
    "freshness": "dated_share < 50",
    "indexnow-readiness": "true",
    "technical-metadata": f"{_score('technicalOptimization')} < 70",
}
_RULES_SQL = " UNION ALL ".join(
    f"SELECT run_id, {n} AS n, '{k}' AS issue, '{I.ISSUES[k][0]}' AS category, '{I.ISSUES[k][1]}' AS priority, '{I.ISSUES[k][2]}' AS providers, '{I.ISSUES[k][3]}' AS effort, '{I.ISSUES[k][4]}' AS impact FROM metrics WHERE {c}" for n, (k, c) in enumerate(_ISSUES.items())
)


@query(
    f"WITH {PAGES}, {METRICS}, r AS ({_RULES_SQL}) SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, n) - 1 AS INT) AS place, issue, category, priority, providers, effort, impact FROM r"
)
def site_issues(spark: SparkSession, d: str) -> DataFrame:
    return I.site_issues(P.site_metrics(_snap(spark, d), AS_OF))


_WEAK = f"({FLAGS_SQL['eligible']}) AND "
_RULES = {
    "rendering-csr": FLAGS_SQL["render_heavy"],
    "schema-mismatch": FLAGS_SQL["schema_mismatch"],
    "orphan-pages": FLAGS_SQL["orphan"],
    "snippet-controls": FLAGS_SQL["snippet_restricted"],
    "answer-first": "coalesce(answer_first_signals.direct_answer_likelihood, 0) < 55",
    "trust-signals": f"NOT ({FLAGS_SQL['transparent']})",
    "freshness": "date_modified IS NULL AND date_published IS NULL",
    "technical-metadata": f"NOT (({FLAGS_SQL['titled']}) AND ({FLAGS_SQL['described']}) AND ({FLAGS_SQL['canonical']}) AND ({FLAGS_SQL['alt_ok']}))",
}


@query(f"WITH {PAGES}, x AS (" + " UNION ALL ".join(f"SELECT run_id, crawl_seq, '{k}' AS issue, url FROM pages WHERE {_WEAK} ({v})" for k, v in _RULES.items()) + ") SELECT run_id, issue, count(*) AS pages, array_to_string(list(url ORDER BY crawl_seq)[1:8], ' ') AS first_urls FROM x GROUP BY run_id, issue")
def affected_pages(spark: SparkSession, d: str) -> DataFrame:
    return I.affected_pages(_snap(spark, d))


@query(
    f"WITH {PAGES}, p AS (SELECT run_id, crawl_seq, coalesce(path, '') AS p FROM pages) SELECT run_id, crawl_seq, CASE WHEN p IN ('', '/') THEN 'home' WHEN regexp_matches(p, '(?i)kontakt|contact') THEN 'contact' WHEN regexp_matches(p, '(?i)om-oss|about|om-') THEN 'about' "
    "WHEN regexp_matches(p, '(?i)meny|menu|mat|food|drikke|drink') THEN 'menu' WHEN regexp_matches(p, '(?i)reservasjon|bestill|booking|book|reserver') THEN 'booking' WHEN regexp_matches(p, '(?i)arrangement|event|fest|julebord|bryllup|selskap') THEN 'event' "
    "WHEN regexp_matches(p, '(?i)kart|finn-oss|veibeskrivelse|adresse|location') THEN 'location' WHEN regexp_matches(p, '(?i)galleri|bilder|foto|gallery') THEN 'gallery' WHEN regexp_matches(p, '(?i)nyheter|blogg|news|aktuelt') THEN 'news' ELSE 'generic' END AS kind FROM p"
)
def path_kinds(spark: SparkSession, d: str) -> DataFrame:
    return P.counting(_snap(spark, d), ["path"]).select(*P.KEYS, I.path_kind(F.coalesce("path", F.lit(""))).alias("kind"))


@query()
def query_coverage(spark: SparkSession, d: str) -> DataFrame:
    from skarv.operators.search import top_queries, upserted

    return I.query_coverage(_snap(spark, d), top_queries(upserted(spark, d, "gsc_page_query_daily")))


@query()
def what_if(spark: SparkSession, d: str) -> DataFrame:
    return I.what_if(_snap(spark, d), AS_OF)


@query()
def page_impact(spark: SparkSession, d: str) -> DataFrame:
    return I.page_impact(_snap(spark, d), AS_OF)


@query()
def issue_lists(spark: SparkSession, d: str) -> DataFrame:
    return I.markdown_lists(I.affected_pages(_snap(spark, d)), "run_id", "issue", "first_urls")


# SQL of the text scores
def _answers() -> str:
    words = ", ".join(f"'{w}'" for w in P.QUESTION_WORDS)
    starts = " OR ".join(f"starts_with(h, '{w}')" for w in P.QUESTION_WORDS)
    definition = r"regexp_matches(o, '(?i)\b(er|betyr|defineres som|means|is|refers to|stands for)\b')"
    boilerplate = P.BOILERPLATE_WORDS.removeprefix("(?iu)")
    return (
        f"WITH {PAGES}, a AS (SELECT run_id, crawl_seq, trim(coalesce(first_paragraph, '')) AS o, lower(coalesce(h1, '')) AS h, lower(headings[1]) AS g, left(coalesce(body_text, ''), 500) AS b FROM pages), "
        rf"w AS (SELECT *, len(list_filter(string_split_regex(o, '\s+'), lambda x: length(x) > 2)) AS n, list_filter(string_split_regex(regexp_replace(h, '[?!.,]', '', 'g'), '\s+'), lambda x: length(x) > 2 AND x NOT IN ({words}))[1:3] AS topic, "
        f"({starts} OR suffix(h, '?') OR coalesce(suffix(g, '?'), false)) AS asks, length(o) > 20 AND {definition} AS defines, "
        rf"regexp_matches(o, '(?i)\d+[.,]?\d*\s*({'|'.join(P.UNITS)}|\bår\b|\b({'|'.join(P.WORD_UNITS)})\b)|\b\d{{2,}}\b') AS numbers, "
        r"regexp_matches(b, '(^|\s)([-•*]|\d+[.)])\s') AS listed FROM a), "
        "r AS (SELECT *, CASE WHEN len(topic) > 0 THEN CAST(len(list_filter(topic, lambda x: contains(lower(o), x))) AS DOUBLE) / len(topic) ELSE 0 END AS ratio, "
        r"CAST(CASE WHEN length(o) < 40 THEN 0 WHEN regexp_matches(lower(o), '^(it|this|that|these|those|den|det|dette|disse|de|her|here)\b') THEN 0.2 "
        f"WHEN regexp_matches(o, '(?i){boilerplate}') THEN 0.1 ELSE least(1.0, (CASE WHEN length(o) BETWEEN 60 AND 350 THEN 0.4 WHEN length(o) > 350 THEN 0.2 ELSE 0.3 END) + (CASE WHEN n >= 5 THEN 0.6 WHEN n >= 3 THEN 0.3 ELSE 0 END)) END AS DOUBLE) AS standalone FROM w), "
        f"q AS (SELECT *, CAST(CASE WHEN NOT asks THEN 0.5 WHEN len(topic) = 0 THEN 0.4 WHEN ratio >= 0.6 AND {definition} THEN 1 WHEN ratio >= 0.4 THEN 0.7 WHEN ratio >= 0.2 THEN 0.4 ELSE 0.1 END AS DOUBLE) AS question FROM r) "
        "SELECT run_id, crawl_seq, defines, numbers, round(standalone, 6) AS standalone, round(question, 6) AS question, listed, CAST(least(100, floor((CASE WHEN defines THEN 28 ELSE 0 END) + (CASE WHEN numbers THEN 18 ELSE 0 END) + standalone * 20 + question * 20 + (CASE WHEN listed THEN 14 ELSE 0 END) + 0.5)) AS INT) AS score FROM q"
    )


def _trust() -> str:
    cited = " OR ".join(f"contains(x, '{a}')" for a in P.AUTHORITIES)
    person = r"(?i)\b(jeg\s+(testet|prøvde|erfarte|opplevde|brukte|anbefaler)|vi\s+(testet|prøvde|erfarte|brukte|anbefaler|har|opplevde)|i\s+(tested|tried|experienced|used|recommend|found|noticed|learned)|we\s+(tested|tried|found|used|recommend|experienced))\b"
    signals = {
        "first_person": f"regexp_matches(coalesce(body_text, ''), '{person}')",
        "examples": r"coalesce(word_count > 200, false) AND regexp_matches(coalesce(body_text, ''), '(?i)\b(\d{4}|\d+\s*(kr|%|prosent|timer|uker|måneder))')",
        "media": "coalesce(image_count > 0 AND images_without_alt < image_count, false) OR coalesce(has_transcript_signals, false)",
        "byline": "coalesce(author <> '', false)",
        "citations": f"len(list_filter(coalesce(external_links, []), lambda x: coalesce({cited}, false))) > 0",
        "terminology": r"len(regexp_extract_all(coalesce(body_text, ''), '\b[A-Za-z0-9_]{9,}\b')) >= 5",
        "about": "coalesce(has_about_link, false)",
        "organization": "coalesce(list_contains(schema.types, 'Organization') OR list_contains(schema.types, 'LocalBusiness'), false)",
        "breadcrumb": "coalesce(list_contains(schema.types, 'BreadcrumbList'), false)",
        "contact": "coalesce(has_contact_link, false)",
        "privacy": r"len(list_filter(list_concat(coalesce(external_links, []), coalesce(internal_links, [])), lambda x: coalesce(regexp_matches(x, '(?i)person(vern|data)|privacy\s*policy|cookie\s*(policy|settings)|gdpr|informasjonskapsler'), false))) > 0",
        "https": "coalesce(starts_with(url, 'https://'), false)",
        "canonical": "coalesce(canonical_url <> '', false)",
        "published": "date_published IS NOT NULL",
        "modified": "date_modified IS NOT NULL",
    }
    depth = "CAST(floor(least(40.0, CAST(coalesce(word_count, 0) AS DOUBLE) / 1000 * 40) + least(20.0, CAST(coalesce(len(headings), 0) AS DOUBLE) / 5 * 20) + least(20.0, CAST(coalesce(list_count, 0) + coalesce(table_count, 0) * 2 AS DOUBLE) / 5 * 20) + least(20.0, coalesce(faq_count, 0) * 10.0) + 0.5) AS BIGINT)"
    extra = {"expertise": " + CAST(depth AS DOUBLE) * CAST(0.3 AS DOUBLE)", "authority": " + least(30, coalesce(inbound_links, 0) * 3)"}
    groups = []
    for name, (weight, points) in P.TRUST_POINTS.items():
        total = " + ".join(f"{s} * {p}" for s, p in points.items()) + extra.get(name, "")
        groups.append(f"least(100, {total}) * CAST({weight} AS DOUBLE)")
    cols = ", ".join(f"CAST(({v}) AS INT) AS {k}" for k, v in signals.items())
    return f"trust AS (SELECT * EXCLUDE (inbound_links), CAST(least(100, floor({' + '.join(groups)} + 0.5)) AS INT) AS composite FROM (SELECT run_id, crawl_seq, inbound_links, {depth} AS depth, {cols} FROM pages))"


_SIGNALS = [s for _, points in P.TRUST_POINTS.values() for s in points]
SQL["answer_quality"] = _answers()
SQL["page_trust"] = f"WITH {PAGES}, {_trust()} SELECT * FROM trust"
_share = "CAST(floor(avg(CASE WHEN {} THEN 100.0 ELSE 0.0 END) + 0.5) AS BIGINT)"
SQL["run_trust"] = (
    f"WITH {PAGES}, {_trust()} SELECT run_id, count(*) AS pages, CAST(floor(avg(composite) + 0.5) AS BIGINT) AS average, {_share.format('byline = 1')} AS author_share, {_share.format('citations = 1')} AS citation_share, "
    f"{_share.format('https = 1 AND canonical = 1 AND contact = 1')} AS trust_share FROM trust GROUP BY run_id"
)
SQL["trust_gaps"] = (
    f"WITH {PAGES}, {_trust()}, gaps AS (" + " UNION ALL ".join(f"SELECT run_id, '{s}' AS gap FROM trust WHERE {s} = 0" for s in _SIGNALS) + "), n AS (SELECT run_id, gap, count(*) AS pages FROM gaps GROUP BY ALL) "
    "SELECT run_id, gap, pages, CAST(rank_no AS INT) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pages DESC, gap) AS rank_no FROM n) WHERE rank_no <= 3"
)


@query(
    f"WITH {PAGES} SELECT run_id, crawl_seq, coalesce(CASE WHEN trim(publisher) <> '' THEN trim(publisher) END, CASE WHEN trim(author) <> '' THEN trim(author) END, upper(left(b, 1)) || substring(b, 2)) AS brand, "
    f"CASE WHEN stamp IS NOT NULL THEN round(greatest(0.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(stamp)) / 86400000000.0), 6) END AS age, "
    "CASE WHEN regexp_matches(hay, 'pris|priser|bestill|booking|book|reservasjon|kontakt') THEN 'transactional' WHEN regexp_matches(hay, 'vs|beste|alternativ|sammenlign|review|hva bør du velge') THEN 'commercial investigation' ELSE 'informational' END AS intent, "
    "CASE WHEN level >= 4 THEN 'critical' WHEN level >= 3 THEN 'high' WHEN level >= 2 THEN 'medium' ELSE 'low' END AS priority, outside "
    f"FROM (SELECT *, regexp_extract(regexp_replace({_HOST}, '^www\\.', ''), '^([^.]+)', 1) AS b, coalesce(date_modified, date_published) AS stamp, lower(coalesce(path, '') || ' ' || coalesce(title, '')) AS hay, coalesce(click_depth, 0) AS level, "
    "len(list_filter(coalesce(internal_links, []), lambda x: lower(regexp_extract(x, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) <> lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)))) AS outside FROM pages WHERE url IS NOT NULL)"
)
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    pages = P.counting(_snap(spark, d), ["url", "publisher", "author", "date_modified", "date_published", "path", "title", "click_depth", "internal_links"]).filter(F.col("url").isNotNull())
    links = F.coalesce("internal_links", F.array().cast("array<string>"))
    return pages.select(
        *P.KEYS,
        B.brand_name(F.col("publisher"), F.col("author"), F.col("url")).alias("brand"),
        F.round(B.days_since(F.coalesce("date_modified", "date_published"), AS_OF), 6).alias("age"),
        B.search_intent(F.coalesce("path", F.lit("")), F.coalesce("title", F.lit(""))).alias("intent"),
        B.priority(F.coalesce("click_depth", F.lit(0))).alias("priority"),
        F.size(F.filter(links, lambda x: ~B.same_host(x, F.col("url")))).cast("long").alias("outside"),
    )


_PROVIDERS = {
    "openai": "blocked_openai * 4 + greatest(0.0, 70 - answer_first) * 0.45 + restricted * 3 - transparent_share * 0.08",
    "google": "blocked_google * 2 + noindex * 3 + render_heavy * 4 + mismatch * 4 - schema_coverage * 0.05",
    "bing": "blocked_bing * 4 + restricted * 3 + 8 - schema_coverage * 0.04",
    "perplexity": "blocked_perplexity * 4 + greatest(0.0, 65 - answer_first) * 0.40 + (CASE WHEN cited_share < 60 THEN 8 ELSE 0 END) - cited_share * 0.05",
    "citation": "greatest(0.0, 65 - answer_first) * 0.35 + restricted * 2 - transparent_share * 0.05",
}
SQL["provider_scores"] = f"WITH {PAGES}, {METRICS} " + " UNION ALL ".join(f"SELECT run_id, '{p}' AS provider, round(least(100.0, greatest(0.0, CAST(100 - ({x}) AS DOUBLE))), 1) AS score FROM metrics" for p, x in _PROVIDERS.items())
SQL["issue_lists"] = f"SELECT run_id, string_agg('## ' || issue || chr(10) || '- ' || replace(first_urls, ' ', chr(10) || '- '), chr(10) || chr(10) ORDER BY issue) AS text FROM ({SQL['affected_pages']}) GROUP BY run_id"


def _rewritten(condition: str, run: str, where: str) -> str:
    """Pages as rewritten where the condition holds; run: their run_id."""
    return (
        f"SELECT * REPLACE ({run} AS run_id, {{'direct_answer_likelihood': CASE WHEN {condition} THEN 92 ELSE answer_first_signals.direct_answer_likelihood END}} AS answer_first_signals, CASE WHEN {condition} THEN greatest(coalesce(faq_count, 0), 1) ELSE faq_count END AS faq_count, "
        f"CASE WHEN {condition} AND date_modified IS NULL AND date_published IS NULL THEN TIMESTAMP '{AS_OF}' ELSE date_modified END AS date_modified) FROM pages WHERE {where}"
    )


def _providers_sql(metrics: str) -> str:
    return " UNION ALL ".join(f"SELECT run_id, '{p}' AS score_id, {one_decimal(f'least(100.0, greatest(0.0, CAST(100 - ({x}) AS DOUBLE)))')} AS score FROM {metrics}" for p, x in _PROVIDERS.items())


def _side(metrics: str) -> str:
    return f"SELECT run_id, score_id, score FROM ({scores_sql(metrics)}) UNION ALL {_providers_sql(metrics)}"


SQL["provider_scores"] = f"WITH {PAGES}, {METRICS} SELECT run_id, score_id AS provider, score FROM ({_providers_sql('metrics')})"
SQL["what_if"] = (
    f"WITH {PAGES}, better AS ({_rewritten('coalesce(answer_first_signals.direct_answer_likelihood, 0) < 55', 'run_id', 'true')}), {METRICS}, {metrics_sql('better', 'later')}, a AS ({_side('metrics')}), b AS ({_side('later')}) "
    f"SELECT run_id, score_id, a.score AS before, b.score AS after, {one_decimal('b.score - a.score')} AS change FROM a JOIN b USING (run_id, score_id)"
)
_ALONE = "run_id || '#' || CAST(crawl_seq AS VARCHAR)"
SQL["page_impact"] = (
    f"WITH {PAGES}, single AS ({_rewritten('true', _ALONE, FLAGS_SQL['eligible'])}), {METRICS}, {metrics_sql('single', 'alone')}, a AS ({scores_sql('metrics')}), ta AS ({totals_sql('a')}), b AS ({scores_sql('alone')}), tb AS ({totals_sql('b')}), "
    f"c AS (SELECT p.run_id, p.crawl_seq, ta.total AS before, tb.total AS after, {one_decimal('tb.total - ta.total')} AS change FROM pages p JOIN ta ON ta.run_id = p.run_id JOIN tb ON tb.run_id = p.run_id || '#' || CAST(p.crawl_seq AS VARCHAR) WHERE {FLAGS_SQL['eligible']}) "
    "SELECT * REPLACE (CAST(rank_no AS INT) AS rank_no) FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY change DESC, crawl_seq) AS rank_no FROM c) WHERE rank_no <= 5"
)
