"""Page scores, clusters, metrics and text on small fixtures with hand-made results."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skarv.functions import labels
from skarv.functions import text as T
from skarv.functions.unicode import slug_of, tokens_of
from skarv.operators import clusters, insights, pages, runs, search

T0 = dt.datetime(2026, 1, 1)
PAGE = """url string, path string, discovered_from string, status_code int, content_type string, canonical_url string, title string, meta_description string, h1 string, headings array<string>,
first_paragraph string, body_text string, script_count int, word_count int, list_count int, table_count int, faq_count int, internal_links array<string>, external_links array<string>, inbound_links int, click_depth int,
schema struct<types: array<string>, item_count: int, matches_visible_content: boolean, raw_items: string>, images_without_alt int, image_count int, has_transcript_signals boolean, author string, publisher string,
has_about_link boolean, has_contact_link boolean, date_published timestamp_ntz, date_modified timestamp_ntz, snippet_directives struct<no_snippet: boolean, max_snippet: int, data_no_snippet: boolean>,
robots_evaluation struct<general_allowed: boolean, blocked_providers: array<string>, blocked_agents: array<string>>, blocked_by_robots boolean, noindex boolean,
rendering struct<raw_text_length: int, rendered_text_length: int, render_delta_ratio: double, rendering_model: string, extracted_text_preview: string, errors: array<string>>,
answer_first_signals struct<concise_opening: boolean, has_faq: boolean, has_table: boolean, has_list: boolean, direct_answer_likelihood: int>, run_id string, crawl_seq bigint, ingested_at timestamp_ntz"""

BASE = {
    "url": "https://s.example/", "path": "/", "discovered_from": "seed", "status_code": 200, "content_type": "text/html", "canonical_url": "https://s.example/", "title": "A title of some length", "meta_description": "d" * 60,
    "h1": "What is a garden?", "headings": ["What is a garden?"], "first_paragraph": "A garden is a piece of land near a house where 12 kinds of plants and 30 flowers grow well.", "body_text": "Text with 2026 in it. " * 60,
    "script_count": 2, "word_count": 300, "list_count": 1, "table_count": 1, "faq_count": 1, "internal_links": ["https://s.example/"], "external_links": ["https://a.gov/"], "inbound_links": 2, "click_depth": 1,
    "schema": {"types": ["Organization"], "item_count": 2, "matches_visible_content": True, "raw_items": None}, "images_without_alt": 0, "image_count": 1, "has_transcript_signals": True, "author": "A", "publisher": "P", "has_about_link": True,
    "has_contact_link": True, "date_published": T0, "date_modified": T0, "snippet_directives": {"no_snippet": False, "max_snippet": None, "data_no_snippet": False}, "robots_evaluation": {"general_allowed": True, "blocked_providers": [], "blocked_agents": []},
    "blocked_by_robots": False, "noindex": False, "rendering": {"raw_text_length": 1500, "rendered_text_length": 1600, "render_delta_ratio": 1.07, "rendering_model": "ssr", "extracted_text_preview": "", "errors": []},
    "answer_first_signals": {"concise_opening": True, "has_faq": True, "has_table": True, "has_list": True, "direct_answer_likelihood": 90}, "run_id": "r", "crawl_seq": 0, "ingested_at": T0,
}


@pytest.fixture
def make(spark):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(PAGE)
    return lambda *rows: spark.createDataFrame([tuple((BASE | {"crawl_seq": i} | r)[f.name] for f in schema) for i, r in enumerate(rows)], schema)


def test_site_scores_of_one_good_page(make):
    m = pages.site_metrics(make({}), "2026-01-31")
    row = m.first()
    assert (row.pages, row.eligible, row.answer_first, row.schema_coverage) == (1, 1, 90.0, 100.0)
    assert row.freshness == pytest.approx(100 - 30 / 365 * 100)
    scores = pages.site_scores(m, clusters.topic_clusters(make({})))
    want = {
        "crawlabilityIndexation": 100.0, "renderingAiAccessibility": 100.0, "answerFirstContent": 84.0, "citationAuthorityEntitySignals": 100.0, "schemaSemanticSearch": 90.0,
        "internalLinking": 100.0, "zeroClickAiOverviews": 95.0, "contentFreshness": 95.1, "technicalOptimization": 100.0, "searchIntentTopicClusters": 33.2,
    }
    assert {r.score_id: r.score for r in scores.collect()} == want
    assert pages.total_score(scores).first().total == 89.8
    providers = {r.provider: r.score for r in pages.provider_scores(m).collect()}
    assert providers == {"openai": 100.0, "google": 100.0, "bing": 96.0, "perplexity": 100.0, "citation": 100.0}
    assert {r.score_id: r.score for r in pages.site_scores(m).collect()} == want | {"searchIntentTopicClusters": 8.0}


def test_findings(make, spark):
    weak = {"answer_first_signals": BASE["answer_first_signals"] | {"direct_answer_likelihood": 10}, "date_published": None, "date_modified": None, "title": "x"}
    df = make(*[weak | {"url": f"https://s.example/{i}"} for i in range(10)], {})
    got = {r.issue: r for r in insights.affected_pages(df).collect()}
    assert {k: v.pages for k, v in got.items()} == {"answer-first": 10, "freshness": 10, "technical-metadata": 10}
    assert got["freshness"].first_urls.split(" ") == [f"https://s.example/{i}" for i in range(8)]
    assert insights.markdown_lists(insights.affected_pages(df), "run_id", "issue", "first_urls").first().text.startswith("## answer-first\n- https://s.example/0")
    after = {r.score_id: (r.before, r.after, r.change) for r in insights.what_if(df, "2026-01-31").collect()}
    assert set(after) == {*pages.WEIGHTS, *pages.PROVIDERS}
    assert after["answerFirstContent"][1] > after["answerFirstContent"][0] and after["contentFreshness"][1] > after["contentFreshness"][0] and after["internalLinking"][2] == 0
    best = insights.page_impact(df, "2026-01-31").orderBy("rank_no").collect()
    assert len(best) == 5 and [r.change for r in best] == sorted((r.change for r in best), reverse=True) and best[0].crawl_seq == 10


def test_all_issues_in_order(make):
    """A bad page brings every issue, ordered by priority; a good one only that the site doesn't announce changes."""
    bad = {
        "answer_first_signals": BASE["answer_first_signals"] | {"direct_answer_likelihood": 10}, "date_published": None, "date_modified": None, "title": "x", "meta_description": "", "canonical_url": None, "images_without_alt": 1,
        "author": None, "publisher": None, "has_about_link": False, "has_contact_link": False, "discovered_from": "sitemap", "inbound_links": 0, "schema": BASE["schema"] | {"matches_visible_content": False},
        "rendering": BASE["rendering"] | {"rendering_model": "csr"}, "snippet_directives": {"no_snippet": True, "max_snippet": None, "data_no_snippet": False}, "has_transcript_signals": False,
    }
    rows = insights.site_issues(pages.site_metrics(make(bad), "2026-01-31")).orderBy("place").collect()
    assert [r.issue for r in rows] == ["rendering-csr", "schema-mismatch", "orphan-pages", "answer-first", "snippet-controls", "trust-signals", "freshness", "technical-metadata", "indexnow-readiness"]
    assert [r.priority for r in rows] == ["critical"] + ["high"] * 3 + ["medium"] * 4 + ["low"]
    assert {r.issue: r.pages for r in insights.affected_pages(make(bad)).collect()} == {r.issue: 1 for r in rows if r.issue != "indexnow-readiness"}
    good = pages.site_metrics(make({}), "2026-01-31")
    assert [r.issue for r in insights.site_issues(good).collect()] == ["indexnow-readiness"] and insights.site_issues(good, "verified").count() == 0


def test_gaps_to_competitors(make, spark):
    weak = {"answer_first_signals": BASE["answer_first_signals"] | {"direct_answer_likelihood": 10}, "schema": BASE["schema"] | {"item_count": 0}, "date_published": None, "date_modified": None}
    rows = [weak | {"run_id": "own", "crawl_seq": 0}] + [{"run_id": r, "crawl_seq": i} for r in ("a", "b") for i in range(12)] + [weak | {"run_id": "other", "crawl_seq": 0}]
    metrics = pages.site_metrics(make(*rows), "2026-01-31")
    rivals = spark.createDataFrame([("own", "a"), ("own", "b"), ("a", "own"), ("other", "lost")], "run_id string, rival_run_id string")
    got = {(r.run_id, r.gap): (r.own, r.others) for r in insights.site_gaps(metrics, rivals).collect()}
    assert got == {("own", "schema-gap"): (0.0, 100.0), ("own", "answer-first-gap"): (10.0, 90.0), ("own", "freshness-gap"): (0.0, 91.8), ("own", "coverage-gap"): (1.0, 12.0)}
    names = lambda *rs: spark.createDataFrame(rs, "run_id string, name string")
    lost = insights.missing_clusters(names(("own", "boats"), ("b", "roofs")), names(("own", "boats"), ("own", "roofs"), ("own", "roofs")))
    assert [tuple(r) for r in lost.collect()] == [("own", "roofs")]


def test_numbers_of_an_opening(spark):
    from skarv.operators.pages import NUMBERS

    cases = {"3år siden": True, "3 år siden": False, "B12 vitamin": False, "12 vitaminer": True, "5 % off": True, "3months": False, "3 months": True, "1,5 prosent": True, "i 2026": True, "no 7": False}
    df = spark.createDataFrame(list(cases.items()), "t string, want boolean")
    assert [r.t for r in df.filter(F.col("t").rlike(NUMBERS) != F.col("want")).collect()] == []


def test_small_functions(spark):
    assert insights.axis_labels(3) == [0, 1, 2] and insights.axis_labels(10) == [0, 2, 5, 7, 9]
    row = spark.createDataFrame([("1.2.3.4, 5.6.7.8", None, 80.0)], "f string, e string, s double").select(insights.client_key(F.col("f")).alias("a"), insights.client_key(F.col("e")).alias("b"), insights.band(F.col("s")).alias("c"), insights.path_kind(F.lit("/Kontakt")).alias("d")).first()
    assert tuple(row) == ("1.2.3.4", "unknown", "strong", "contact")


def test_no_eligible_page_and_nulls(make):
    nulls = {k: None for k in BASE if k not in ("run_id", "crawl_seq", "ingested_at")}
    m = pages.site_metrics(make(nulls, {"noindex": True}), "2026-01-31").first()
    assert (m.pages, m.eligible, m.answer_first, m.schema_coverage, m.max_depth) == (2, 0, 0.0, 0.0, 0)
    flags = pages.page_flags(make(nulls)).first().asDict()
    assert [k for k, v in flags.items() if v == 1] == []
    for op in (pages.page_answers, pages.page_trust, pages.page_intents, pages.render_candidates, pages.inbound, pages.broken_links, clusters.topic_clusters):
        op(make(nulls)).collect()


def test_answers(make):
    rows = {r.crawl_seq: r for r in pages.page_answers(make({}, {"first_paragraph": "This page is about it, and 12 other things we like to talk about."}, {"first_paragraph": "", "h1": "Title", "headings": []})).collect()}
    assert (rows[0].defines, rows[0].numbers, rows[0].standalone, rows[0].question) == (True, True, 1.0, 1.0) and rows[0].score == 86
    assert rows[1].standalone == 0.2 and rows[2].score == 10


def test_links(make):
    u = "https://s.example"
    df = make({"internal_links": [u + "/2", u + "/1", u + "/1", u + "/lost"]}, {"url": u + "/1", "status_code": 404, "internal_links": [u + "/1"]}, {"url": u + "/2", "internal_links": None})
    assert {r.url: r.inbound for r in pages.inbound(df).collect()} == {u + "/": 0, u + "/1": 3, u + "/2": 1}
    assert {r.crawl_seq: r.broken for r in pages.broken_links(df).collect()} == {0: f"{u}/1 {u}/1", 1: u + "/1"}


def test_trust_and_rendering(make):
    rows = pages.page_trust(make({}, {"author": None, "external_links": []}))
    got = {r.crawl_seq: r for r in rows.collect()}
    assert got[0].byline == 1 and got[1].byline == 0 and got[0].composite > got[1].composite
    run = pages.run_trust(make({}, {"author": ""})).first()
    assert (run.pages, run.author_share, run.trust_share) == (2, 50, 100)
    first = pages.trust_gaps(make({}, {"author": ""})).orderBy("rank_no").first()
    assert first.pages == 2
    assert [r.crawl_seq for r in pages.render_candidates(make({"path": "/om"}, {}, {"path": "/blog/x"}), 2).orderBy("rank_no").collect()] == [1, 2]


def test_clusters_follow_crawl_order(make):
    same = {"title": "boat hire harbour", "h1": "boat hire", "first_paragraph": "boats", "headings": ["harbour boats"], "internal_links": []}
    other = {"title": "yoga class studio", "h1": "yoga", "first_paragraph": "breathing", "headings": ["studio class"], "internal_links": []}
    got = {(r.leader, r.size, r.name) for r in clusters.topic_clusters(make(same, other, same, same | {"word_count": 80})).collect()}
    assert got == {(0, 2, "boat / hire"), (1, 1, "yoga / class")}


def brute_clusters(words):
    """Leaders and mean positive cosines, pair by pair."""
    df = Counter(w for page in words for w in set(page))
    vectors = [{w: c / len(page) * (math.log((1 + len(words)) / (1 + df[w])) + 1) for w, c in Counter(page).items()} for page in words]
    cosine = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items()) / (math.hypot(*a.values()) * math.hypot(*b.values())) if a and b else 0.0
    leader = {}
    for i, v in enumerate(vectors):
        if i not in leader:
            leader |= {j: i for j in range(i, len(words)) if j not in leader and (j == i or cosine(v, vectors[j]) >= 0.18)}
    means = {}
    for s in set(leader.values()):
        rows = [i for i in range(len(words)) if leader[i] == s]
        sims = [c for k, i in enumerate(rows) for j in rows[k + 1 :] if (c := cosine(vectors[i], vectors[j])) > 0]
        means[s] = sum(sims) / len(sims) if sims else 0.0
    return [leader[i] for i in range(len(words))], means


def test_clusters_against_brute_force():
    rnd = random.Random(8)
    for _ in range(20):
        words = [[f"w{min(rnd.randrange(60), rnd.randrange(60))}" for _ in range(rnd.randint(0, 12))] for _ in range(40)]
        at, ids, unit, names = clusters._vectors(words)
        leader, means = brute_clusters(words)
        got = clusters._lead(at, ids, unit, len(names)).tolist()
        assert got == leader
        for s, mean in means.items():
            assert clusters._mean_similarity([i for i in range(40) if got[i] == s], at, ids, unit) == pytest.approx(mean, abs=1e-9)


def test_clusters_of_a_very_large_audit(spark):
    rows = spark.range(30_000).select(F.lit("r").alias("run_id"), F.col("id").alias("crawl_seq"), F.expr("array('site', concat('topic', id % 40), concat('sub', id % 40), concat('page', id), 'service')").alias("words"))
    got = clusters.members(rows).groupBy("leader").count().collect()
    assert {r.leader: r["count"] for r in got} == {i: 750 for i in range(40)}


def test_metric_rules(spark):
    page = spark.createDataFrame([("d", dt.date(2026, 4, 20), "/low", 5, 600, 0.01, 5.0), ("d", dt.date(2026, 4, 5), "/down", 60, 10, 0.5, 1.0), ("d", dt.date(2026, 4, 20), "/down", 20, 10, 0.5, 1.0), ("d", dt.date(2026, 4, 20), "/near", 0, 100, 0.0, 15.0)], "domain string, date date, page string, clicks bigint, impressions bigint, ctr double, position double")
    queries = spark.createDataFrame([("d", dt.date(2026, 4, 20), "/a", "gap", 0, 60, 0.0, 9.0), ("d", dt.date(2026, 4, 20), "/b", "gap", 0, 50, 0.0, 8.0), ("d", dt.date(2026, 4, 20), "/c", "gap", 0, 49, 0.0, 8.0), ("d", dt.date(2026, 4, 20), "/c", "ok", 1, 900, 0.0, 8.0)], "domain string, date date, page string, query string, clicks bigint, impressions bigint, ctr double, position double")
    landing = spark.createDataFrame([("d", dt.date(2026, 4, 20), "/sell", 1000, 9, 0.5), ("d", dt.date(2026, 4, 20), "/fine", 1000, 10, 0.5)], "domain string, date date, page string, sessions bigint, conversions bigint, bounce_rate double")
    got = {(r.kind, r.subject, r.level, r.measure) for r in search.opportunities(page, queries, landing, "2026-04-30").collect()}
    assert got == {("high-impressions-low-ctr", "/low", 2, 600.0), ("traffic-down", "/down", 4, 40.0), ("near-page-one", "/near", 3, 100.0), ("high-traffic-low-conversion", "/sell", 4, 1000.0), ("query-gap", "gap", 2, 110.0)}
    gap = search.uncovered_queries(queries).first()
    assert (gap.page, gap.position) == ("/a", 9.0)
    assert search.digest_lines(search.opportunities(page, queries, landing, "2026-04-30")).first().lines.startswith("1. [high-traffic-low-conversion] /sell")


def test_merges(spark):
    ddl = "k string, v int, created int"
    old, new = spark.createDataFrame([("a", 1, 10), (None, 2, 20)], ddl), spark.createDataFrame([("a", 5, 99), ("b", 6, 99), (None, None, 1)], ddl)
    assert {tuple(r) for r in search.merge(old, new, ["k"], ["created"]).collect()} == {("a", 5, 10), ("b", 6, 99), (None, None, 20)}
    assert search.insert_absent(old.filter("k is not null"), new.filter("k is not null"), ["k"]).count() == 2
    ids = search.with_ids(spark.createDataFrame([(7,)], "id bigint"), spark.createDataFrame([("x",), ("y",)], "n string"), "id", ["n"])
    assert [r.id for r in ids.orderBy("n").collect()] == [8, 9]


def test_text(spark):
    def one(expr, *values):
        df = spark.createDataFrame([values], ", ".join(f"c{i} {'array<string>' if isinstance(v, list) else 'string'}" for i, v in enumerate(values)))
        return df.select(expr.alias("x")).first().x

    c = F.col("c0")
    assert one(T.strip_shortcodes(c), " a [b c] {{d}}  e ") == "a e"
    assert one(T.excerpt(c, 20, 5), "one two three four five six") == "one two three four..."
    assert one(T.excerpt(c, 20, 5), "x" * 30) == "x" * 20 + "..."
    assert one(T.trim_to(c, 10, 2), "one  two three") == "one two"
    assert one(T.first_upper(c), "åpen DAG") == "Åpen DAG"
    assert one(T.clean_heading(c), " Boat  hire – Oslo | x") == "Boat hire"
    assert one(T.decode_entities(c), "&amp;lt; &quot;") == '< "'
    assert one(T.list_summary(c), ["a", "b", "c", "d"]) == "a, b, c +1" and one(T.list_summary(c), []) == ""
    assert one(T.list_sentence(c), ["a", "b", "c", "d"]) == "a, b og c" and one(T.list_sentence(c), ["a"]) == "a"
    assert one(T.human_path(c), "https://A.example/") == "a.example" and one(T.human_path(c), "https://a.example/x?y") == "a.example/x"
    assert one(T.tolerant_path(c), "a.example/x") == "/x" and one(T.tolerant_path(c), "a.example") == "/"
    assert one(T.opening_sentences(c), "A. B. C.") == "A. B"
    assert one(T.ascii_slug(c), " A b_c! ") == "a-b-c"
    assert slug_of(" Ål og ærlig_Tale ") == "al-og-rlig-tale" and slug_of(None) is None
    assert tokens_of("Måler åpningstider, ny-tt") == ["ler", "pningstider", "ny-tt"]
    assert one(search.on_brand(c, F.array(F.lit("acme")), F.array(F.lit("boats"))), "boat hire") and not one(search.on_brand(c, F.array(F.lit("acme")), F.array(F.lit("xy"))), "boat hire")
    assert one(runs.progress_percent(c, F.lit(5), F.lit(10)), "crawling") == 39 and one(runs.progress_percent(c, F.lit(5), F.lit(0)), "completed") == 100


def test_labels(spark):
    df = spark.createDataFrame([("2026-01-02 03:04:05", "20260102", "no date", 20.0, 40, "https://www.acme.example/")], "a string, b string, c string, e double, p int, u string")
    row = df.select(
        labels.iso_stamp(F.col("a")).alias("a"), labels.iso_stamp(F.col("b")).alias("b"), labels.iso_stamp(F.col("c")).alias("c"), labels.seconds_left(F.col("e"), F.col("p")).alias("s"),
        labels.clamp_days(F.lit(3)).alias("d"), labels.clamp_days(F.lit(None).cast("int")).alias("n"), labels.brand_name(F.lit(" "), F.lit(None), F.col("u")).alias("brand"), labels.same_host(F.col("u"), F.lit("https://acme.example/")).alias("h"),
    ).first()
    assert tuple(row) == ("2026-01-02T03:04:05.000Z", "2026-01-02T00:00:00.000Z", None, 30, 7, 90, "Acme", False)
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    assert labels.where_all(rows, k="a", v=None).count() == 1 and labels.where_all(rows).count() == 2
