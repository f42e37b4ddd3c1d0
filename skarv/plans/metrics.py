"""Queries over the daily metric tables and audit runs, and their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarv.operators import runs as R
from skarv.operators import search as S
from skarv.plans.pages import _rounded
from skarv.plans.pipeline import latest_report_sql, score_changes_sql
from skarv.sources.tables import table

#: The 28 days that the windowed queries look at.
AS_OF, SINCE = "2026-04-30", "2026-04-02"

KEYS_SQL = {
    "domain": "lower(trim(domain))",
    "page": "CASE WHEN page = '/' THEN page ELSE regexp_replace(page, '/$', '') END",
    "query": r"trim(regexp_replace(lower(query), '\s+', ' ', 'g'))",
    "date": "date",
}


DOUBLES = ("ctr", "position", "bounce_rate")


def counting_sql(name: str, since: str | None = None, until: str | None = None) -> str:
    """A CTE with the counting rows of a daily table."""
    keys, values = S.TABLES[name]
    where = "date IS NOT NULL" + (f" AND date >= DATE '{since}'" if since else "") + (f" AND date <= DATE '{until}'" if until else "")
    k = ", ".join(f"{KEYS_SQL[c]} AS {c}" for c in keys)
    blank = " AND query IS NOT NULL AND query <> ''" if "query" in keys else ""
    return f"{name}_k AS (SELECT {k}, {', '.join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" if c in DOUBLES else c for c in values)}, ingested_at FROM {name} WHERE {where}), c_{name} AS (SELECT * EXCLUDE (rn, ingested_at) FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY ingested_at DESC) AS rn FROM {name}_k) WHERE rn = 1{blank})"


PAGE, QUERY, LANDING = (counting_sql(n, SINCE, AS_OF) for n in ("gsc_page_daily", "gsc_page_query_daily", "ga4_landing_page_daily"))
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


def _upsert(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return S.upserted(spark, d, name)

    run.__name__ = f"upsert_{name}"
    keys, values = S.TABLES[name]
    query(f"WITH {counting_sql(name)} SELECT {', '.join(keys + values)} FROM c_{name}")(run)


for _name in S.TABLES:
    _upsert(_name)


@query(f"WITH {PAGE} SELECT * FROM c_gsc_page_daily")
def metric_window(spark: SparkSession, d: str) -> DataFrame:
    return S.upserted(spark, d, "gsc_page_daily", SINCE, AS_OF)


PAGE_TOTALS = "SELECT domain, page, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, round(avg(ctr), 9) AS ctr, round(avg(position), 9) AS position, count(*) AS days FROM c_gsc_page_daily GROUP BY ALL"


@query(f"WITH {PAGE} {PAGE_TOTALS}")
def page_totals(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.page_totals(S.upserted(spark, d, "gsc_page_daily", SINCE, AS_OF)), 9)


QUERY_TOTALS = "SELECT domain, page, query, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, round(avg(ctr), 9) AS ctr, round(avg(position), 9) AS position FROM c_gsc_page_query_daily GROUP BY ALL"


@query(f"WITH {QUERY} {QUERY_TOTALS}")
def query_totals(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.query_totals(S.upserted(spark, d, "gsc_page_query_daily", SINCE, AS_OF)), 9)


@query(f"WITH {LANDING} SELECT domain, page, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(conversions) AS BIGINT) AS conversions, round(avg(bounce_rate), 9) AS bounce_rate, count(*) AS days FROM c_ga4_landing_page_daily GROUP BY ALL")
def landing_totals(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.landing_totals(S.upserted(spark, d, "ga4_landing_page_daily", SINCE, AS_OF)), 9)


@query(f"WITH {QUERY}, t AS ({QUERY_TOTALS}) SELECT * REPLACE (CAST(rank_no AS INT) AS rank_no) FROM (SELECT *, row_number() OVER (PARTITION BY domain, page ORDER BY impressions DESC NULLS LAST, query) AS rank_no FROM t) WHERE rank_no <= 5")
def top_queries(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.top_queries(S.upserted(spark, d, "gsc_page_query_daily", SINCE, AS_OF)), 9)


_RECENT, _BEFORE = f"date >= DATE '{AS_OF}' - 14", f"date >= DATE '{AS_OF}' - 28 AND date < DATE '{AS_OF}' - 14"
TREND = f"SELECT domain, page, CAST(coalesce(sum(clicks) FILTER (WHERE {_RECENT}), 0) AS BIGINT) AS recent, CAST(coalesce(sum(clicks) FILTER (WHERE {_BEFORE}), 0) AS BIGINT) AS before, count(*) FILTER (WHERE {_RECENT}) AS recent_rows FROM c_gsc_page_daily GROUP BY ALL"


@query(f"WITH {PAGE} {TREND}")
def page_trend(spark: SparkSession, d: str) -> DataFrame:
    return S.page_trend(S.upserted(spark, d, "gsc_page_daily", SINCE, AS_OF), AS_OF)


GAPS = (
    "pairs AS (SELECT * FROM (" + QUERY_TOTALS + ") WHERE coalesce(clicks, 0) = 0 AND impressions >= {pair}), "
    "gaps AS (SELECT domain, query, CAST(sum(impressions) AS BIGINT) AS impressions, max({{'i': impressions, 'p': page, 'q': position}}) AS b FROM pairs GROUP BY ALL HAVING sum(impressions) >= {least})"
)


@query(f"WITH {QUERY}, {GAPS.format(pair=10, least=20)} SELECT domain, query, impressions, b.p AS page, b.q AS position FROM gaps")
def uncovered_queries(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.uncovered_queries(S.upserted(spark, d, "gsc_page_query_daily", SINCE, AS_OF), 10, 20), 9)


@query(
    f"WITH {PAGE}, {QUERY}, {LANDING}, s AS (SELECT domain, page, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions FROM c_gsc_page_daily GROUP BY ALL), "
    "l AS (SELECT domain, page, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(conversions) AS BIGINT) AS conversions FROM c_ga4_landing_page_daily GROUP BY ALL), "
    f"t AS (SELECT *, row_number() OVER (PARTITION BY domain, page ORDER BY impressions DESC NULLS LAST, query) AS r FROM ({QUERY_TOTALS})), q AS (SELECT domain, page, string_agg(query, ', ' ORDER BY r) AS queries FROM t WHERE r <= 5 GROUP BY ALL) "
    "SELECT * FROM s FULL JOIN l USING (domain, page) LEFT JOIN q USING (domain, page)"
)
def page_overview(spark: SparkSession, d: str) -> DataFrame:
    return S.page_overview(*_windows(spark, d))


def _windows(spark: SparkSession, d: str) -> list[DataFrame]:
    return [S.upserted(spark, d, n, SINCE, AS_OF) for n in ("gsc_page_daily", "gsc_page_query_daily", "ga4_landing_page_daily")]


FOUND = (
    f"{PAGE}, {QUERY}, {LANDING}, pt AS ({PAGE_TOTALS}), tr AS ({TREND}), {GAPS.format(pair=50, least=100)}, lt AS (SELECT domain, page, sum(sessions) AS sessions, sum(conversions) AS conversions FROM c_ga4_landing_page_daily GROUP BY ALL), found AS ("
    "SELECT domain, 'high-impressions-low-ctr' AS kind, page AS subject, CASE WHEN impressions >= 5000 THEN 4 WHEN impressions >= 2000 THEN 3 ELSE 2 END AS level, CAST(impressions AS DOUBLE) AS measure FROM pt WHERE impressions >= 500 AND ctr < 0.03 AND position <= 10 UNION ALL "
    "SELECT domain, 'near-page-one', page, CASE WHEN position <= 15 THEN 3 ELSE 2 END, CAST(impressions AS DOUBLE) FROM pt WHERE position >= 11 AND position <= 20 AND impressions >= 100 UNION ALL "
    "SELECT domain, 'traffic-down', page, CASE WHEN recent * 2 <= before THEN 4 ELSE 3 END, CAST(before - recent AS DOUBLE) FROM tr WHERE recent_rows > 0 AND before >= 50 AND recent < before * 0.7 UNION ALL "
    "SELECT domain, 'high-traffic-low-conversion', page, CASE WHEN sessions >= 1000 THEN 4 ELSE 3 END, CAST(sessions AS DOUBLE) FROM lt WHERE sessions >= 200 AND conversions < sessions * 0.01 UNION ALL "
    "SELECT domain, 'query-gap', query, CASE WHEN impressions >= 500 THEN 3 ELSE 2 END, CAST(impressions AS DOUBLE) FROM gaps)"
)


@query(f"WITH {FOUND} SELECT * FROM found")
def opportunities(spark: SparkSession, d: str) -> DataFrame:
    return S.opportunities(*_windows(spark, d), AS_OF)


@query(f"WITH {FOUND} SELECT kind, level, count(*) AS n, CAST(sum(measure) AS DOUBLE) AS measure FROM found GROUP BY ALL")
def opportunity_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.opportunities(*_windows(spark, d), AS_OF).groupBy("kind", "level").agg(F.count("*").alias("n"), F.sum("measure").alias("measure"))


@query(
    f"WITH {FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY level DESC, measure DESC, kind, subject) AS r FROM found) "
    "SELECT domain, string_agg(r || '. [' || kind || '] ' || subject, chr(10) ORDER BY r) AS lines FROM r WHERE r <= 10 GROUP BY domain"
)
def digest_lines(spark: SparkSession, d: str) -> DataFrame:
    return S.digest_lines(S.opportunities(*_windows(spark, d), AS_OF))


# audit runs
RUNS = "runs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM audit_runs WHERE id IS NOT NULL) WHERE rn = 1)"
_RUN = "id, target_url, status, created_at, heartbeat_at, completed_at"
NOW = "2026-04-01 00:00:00"


def _runs(df: DataFrame) -> DataFrame:
    return df.select(*_RUN.split(", "))


@query(f"WITH {RUNS} SELECT {_RUN} FROM runs ORDER BY created_at DESC, id LIMIT 20")
def newest_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(R.newest(table(spark, d, "audit_runs")))


@query(f"WITH {RUNS} SELECT {_RUN} FROM runs WHERE status = 'queued'")
def queued_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(R.queued(table(spark, d, "audit_runs")))


_STALE = f"status = 'running' AND (heartbeat_at IS NULL OR heartbeat_at < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE)"


@query(f"WITH {RUNS} SELECT {_RUN} FROM runs WHERE {_STALE}")
def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(R.stale(table(spark, d, "audit_runs"), NOW))


@query(f"WITH {RUNS} SELECT id, CASE WHEN {_STALE} THEN 'failed' ELSE status END AS status, CASE WHEN {_STALE} THEN 'no heartbeat' ELSE error_message END AS error_message FROM runs")
def recovered_runs(spark: SparkSession, d: str) -> DataFrame:
    return R.recover(table(spark, d, "audit_runs"), NOW).select("id", "status", "error_message")


@query(
    f"WITH {RUNS}, t AS (SELECT id, completed_at, regexp_extract(trim(target_url), '^(https?)', 1) || '://' || lower(regexp_extract(trim(target_url), '^[a-zA-Z]+://([^/?#:]*)', 1)) AS h, regexp_extract(trim(target_url), '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p FROM runs WHERE status = 'completed'), "
    "n AS (SELECT id, completed_at, h || CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/$', '') END AS target FROM t) "
    "SELECT id AS run_id, target, completed_at, CAST(row_number() OVER w AS INT) AS seq, lag(id) OVER w AS prev_run_id FROM n WINDOW w AS (PARTITION BY target ORDER BY completed_at, id)"
)
def run_history(spark: SparkSession, d: str) -> DataFrame:
    return R.history(table(spark, d, "audit_runs"))


@query()
def score_changes(spark: SparkSession, d: str) -> DataFrame:
    return R.score_changes(table(spark, d, "audit_runs"))


@query()
def latest_report(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_report_with(table(spark, d, "audit_runs"))


@query(f"WITH {RUNS} SELECT CAST(date_trunc('week', created_at) AS DATE) AS week, status, count(*) AS n FROM runs GROUP BY ALL")
def runs_per_week(spark: SparkSession, d: str) -> DataFrame:
    return R.runs(table(spark, d, "audit_runs")).groupBy(R.week_start(F.col("created_at")).alias("week"), "status").agg(F.count("*").alias("n"))


# rolling totals and missing days in SQL
def _rolling(name: str, metrics: list[str]) -> str:
    m = ", ".join(f"CAST(coalesce({x}, 0) AS BIGINT) AS {x}" for x in metrics)
    grid = f"g_{name} AS (SELECT domain, page, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM c_{name} GROUP BY domain, page)"
    day = f"d_{name} AS (SELECT g.domain, g.page, g.date, {', '.join(f'coalesce(c.{x}, 0) AS {x}' for x in metrics)} FROM g_{name} g LEFT JOIN c_{name} c ON c.domain = g.domain AND c.page = g.page AND c.date = g.date)"
    w = lambda x, n: f"sum({x}) OVER (PARTITION BY domain, page ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    cols = ", ".join(f"CAST({w(x, n)} AS BIGINT) AS {x}_sum_{n}, CAST({w(x, n)} AS DOUBLE) / {n} AS {x}_avg_{n}" for x in metrics for n in (7, 30))
    return f"{counting_sql(name)}, {grid}, {day}, r_{name} AS (SELECT domain, page, date, {cols} FROM d_{name})", m and f"SELECT '{name}' AS series_table, * FROM r_{name}"


_g, _gs = _rolling("gsc_page_daily", ["clicks", "impressions"])
_l, _ls = _rolling("ga4_landing_page_daily", ["sessions"])
SQL["p4_rolling"] = f"WITH {_g}, {_l} {_gs} UNION ALL BY NAME {_ls}"


def _missing(name: str, value: str, low: str, high: str) -> str:
    ok = f"{value} IS NOT NULL AND NOT isnan({value}) AND {value} >= {low}" + (f" AND {value} <= {high}" if high else f" AND {value} < 'infinity'::DOUBLE")
    return (
        f"SELECT '{name}' AS series_table, domain, page, strftime(day, '%Y-%m-%d') AS missing_date FROM (SELECT domain, page, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS day FROM c_{name} WHERE {ok} GROUP BY domain, page) g "
        f"WHERE NOT EXISTS (SELECT 1 FROM c_{name} c WHERE c.domain = g.domain AND c.page = g.page AND c.date = g.day AND {ok.replace(value, 'c.' + value)})"
    )


SQL["p2_found"] = f"WITH {counting_sql('gsc_page_daily')}, {counting_sql('ga4_landing_page_daily')} " + _missing("gsc_page_daily", "position", "1", "") + " UNION ALL " + _missing("ga4_landing_page_daily", "bounce_rate", "0", "1")
SQL["latest_report"] = latest_report_sql()
SQL["score_changes"] = score_changes_sql()
