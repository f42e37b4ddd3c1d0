"""Crawled pages: filters, link graph, page scores and site aggregates as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarv.functions.text import LEFT, RIGHT, average, clamp, percent, round1
from skarv.sources.tables import latest

KEYS = ["run_id", "crawl_seq"]


def counting(page_snapshots: DataFrame, columns: list[str]) -> DataFrame:
    """run_id, crawl_seq and `columns` of each page's counting row."""
    return latest(page_snapshots, KEYS, columns)


def yes(c: Column) -> Column:
    """Null as false."""
    return F.coalesce(c, F.lit(False))


def _html() -> Column:
    return yes(F.col("content_type").contains("text/html"))


def flags() -> dict[str, Column]:
    """Page predicates by name."""
    open_ = ~yes(F.col("blocked_by_robots"))
    indexed = ~yes(F.col("noindex"))
    status_ok = F.col("status_code").isNull() | (F.col("status_code") < 400)
    snip = F.col("snippet_directives")
    return {
        "eligible": open_ & indexed & _html() & status_ok,
        "cluster_eligible": open_ & indexed & _html() & yes(F.col("word_count") > 80),
        "render_eligible": open_ & _html() & status_ok,
        "broken": yes(F.col("status_code") >= 400),
        "orphan": yes((F.col("discovered_from") != "seed") & (F.col("inbound_links") == 0)),
        "deep": yes(F.col("click_depth") >= 4),
        "snippet_restricted": yes(snip["no_snippet"]) | yes(snip["data_no_snippet"]) | yes(snip["max_snippet"] == 0),
        "schema_mismatch": yes(F.col("schema.item_count") > 0) & ~yes(F.col("schema.matches_visible_content")),
        "render_heavy": yes(F.col("rendering.rendering_model") == "csr") | yes(F.col("rendering.render_delta_ratio") > 1.8),
        "dated": F.col("date_modified").isNotNull() | F.col("date_published").isNotNull(),
        "cited": yes(F.col("author") != "") | yes(F.col("publisher") != "") | yes(F.size("external_links") > 0),
        "titled": yes(F.length("title") >= 15),
        "described": yes(F.length("meta_description") >= 50),
        "canonical": yes(F.col("canonical_url") != ""),
        "alt_ok": yes(F.col("image_count") == 0) | yes(F.col("images_without_alt") == 0),
        "transcribed": yes(F.col("has_transcript_signals")) | yes(F.col("image_count") == 0),
        "transparent": yes(F.col("author") != "") | yes(F.col("publisher") != "") | yes(F.col("has_about_link")) | yes(F.col("has_contact_link")),
    }


FLAG_COLUMNS = [
    "content_type", "blocked_by_robots", "noindex", "status_code", "snippet_directives", "word_count", "discovered_from", "inbound_links", "click_depth",
    "schema", "rendering", "date_modified", "date_published", "author", "publisher", "external_links", "title", "meta_description", "canonical_url",
    "image_count", "images_without_alt", "has_transcript_signals", "has_about_link", "has_contact_link", "faq_count", "answer_first_signals",
    "robots_evaluation",
]


def page_flags(page_snapshots: DataFrame) -> DataFrame:
    """run_id, crawl_seq and every predicate as 0 or 1."""
    return counting(page_snapshots, FLAG_COLUMNS).select(*KEYS, *[c.cast("int").alias(n) for n, c in flags().items()])


def edges(page_snapshots: DataFrame) -> DataFrame:
    """run_id, crawl_seq, src, pos, dst: one row per internal link, in page order."""
    pages = counting(page_snapshots, ["url", "internal_links"])
    return pages.select(*KEYS, F.col("url").alias("src"), F.posexplode("internal_links").alias("pos", "dst"))


def inbound(page_snapshots: DataFrame) -> DataFrame:
    """run_id, crawl_seq, url, inbound: links of the run's pages to each page; 0 for none. Links to pages that weren't crawled drop out."""
    counts = edges(page_snapshots).groupBy("run_id", F.col("dst").alias("url")).agg(F.count("*").alias("n"))
    pages = counting(page_snapshots, ["url"])
    return pages.join(counts, ["run_id", "url"], "left").select(*KEYS, "url", F.coalesce("n", F.lit(0)).alias("inbound"))


def broken_links(page_snapshots: DataFrame) -> DataFrame:
    """run_id, crawl_seq, broken: links to pages of the run with status 400 or more, in link order; pages without are left out."""
    bad = counting(page_snapshots, ["url", "status_code"]).filter(F.col("status_code") >= 400).select("run_id", F.col("url").alias("dst")).distinct()
    hit = edges(page_snapshots).join(bad, ["run_id", "dst"])
    # a page's links are bounded by the page
    return hit.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]), " ").alias("broken"))


def site_metrics(page_snapshots: DataFrame, as_of: str) -> DataFrame:
    """One row per run: conditional counts over all pages and shares over eligible pages, in one aggregate.

    as_of: the clock that freshness counts from (a page a year old or older has none).
    """
    f = flags()
    pages = counting(page_snapshots, FLAG_COLUMNS)
    on = pages.select("run_id", "blocked_by_robots", "noindex", "faq_count", "click_depth", "date_modified", "date_published", "answer_first_signals", "schema", "robots_evaluation", *[c.alias(n) for n, c in f.items()])
    e = F.col("eligible")
    n = F.count_if(e)
    share = {k: percent(F.count_if(e & c), n) for k, c in {"schema_coverage": yes(F.col("schema.item_count") > 0), **{f"{k}_share": F.col(k) for k in ("dated", "cited", "titled", "described", "canonical", "alt_ok", "transcribed", "transparent")}}.items()}
    stamp = F.coalesce("date_modified", "date_published").cast("timestamp")
    days = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(stamp)) / 86_400_000_000)
    fresh = F.when(e & F.col("dated"), 100 - clamp(days / 365 * 100))
    blocked = {p: F.count_if(F.array_contains("robots_evaluation.blocked_providers", p)).alias(f"blocked_{p}") for p in PROVIDERS}
    return on.groupBy("run_id").agg(
        F.count("*").alias("pages"),
        n.alias("eligible"),
        *[F.count_if(c).alias(k) for k, c in {"broken": F.col("broken"), "orphans": F.col("orphan") & e, "deep": F.col("deep") & e, "restricted": F.col("snippet_restricted") & e, "mismatch": F.col("schema_mismatch") & e, "render_heavy": F.col("render_heavy") & e}.items()],
        F.count_if(F.col("eligible") & yes(F.col("faq_count") > 0)).alias("faq_pages"),
        F.count_if(yes(F.col("blocked_by_robots"))).alias("blocked"),
        F.count_if(yes(F.col("noindex"))).alias("noindex"),
        F.greatest(F.lit(0), F.coalesce(F.max(F.when(e, F.col("click_depth"))), F.lit(0))).alias("max_depth"),
        F.coalesce(F.avg(F.when(e, F.coalesce("answer_first_signals.direct_answer_likelihood", F.lit(0)))), F.lit(0.0)).alias("answer_first"),
        average(fresh).alias("freshness"),
        *[c.alias(k) for k, c in share.items()],
        *blocked.values(),
    )


#: Providers in their order, and the site scores in theirs with their weights (they add up to 100).
PROVIDERS = ["openai", "google", "bing", "perplexity", "citation"]
WEIGHTS = {
    "crawlabilityIndexation": 16,
    "renderingAiAccessibility": 14,
    "answerFirstContent": 12,
    "citationAuthorityEntitySignals": 10,
    "schemaSemanticSearch": 10,
    "internalLinking": 10,
    "searchIntentTopicClusters": 10,
    "zeroClickAiOverviews": 8,
    "contentFreshness": 5,
    "technicalOptimization": 5,
}


def score_columns() -> dict[str, Column]:
    """The site scores (0..100, one decimal) over a row of site metrics and cluster statistics, in the order of WEIGHTS."""
    m = F.col
    n = F.greatest(m("eligible"), F.lit(1))
    pct = lambda c: percent(m(c), n)
    any_faq = m("faq_pages") > 0
    wanted = F.greatest(F.lit(3), F.floor(n / 10))
    scores = {
        "crawlabilityIndexation": 100 - m("blocked") * 4 - m("noindex") * 3 - m("broken") * 5 - round1(pct("orphans") * 0.7),
        "renderingAiAccessibility": 100 - round1(pct("render_heavy") * 1.1) - F.when(m("max_depth") > 5, 8).otherwise(0),
        "answerFirstContent": m("answer_first") * 0.8 + F.when(any_faq, 12).otherwise(0),
        "citationAuthorityEntitySignals": m("cited_share") * 0.55 + m("transparent_share") * 0.45,
        "schemaSemanticSearch": m("schema_coverage") * 0.75 + F.when(m("mismatch") == 0, 15).otherwise(0) - m("mismatch") * 4,
        "internalLinking": 100 - round1(pct("orphans") * 0.8) - round1(pct("deep") * 0.4),
        "searchIntentTopicClusters": F.least(F.lit(1.0), m("n_clusters") / wanted) * 62 + F.least(F.lit(1.0), m("n_intents") / 4) * 30 - F.least(F.lit(20), m("n_single") * 3) + 8,
        "zeroClickAiOverviews": m("answer_first") * 0.5 + m("schema_coverage") * 0.2 + F.when(m("restricted") > 0, -20).otherwise(15) + F.when(any_faq, 15).otherwise(0),
        "contentFreshness": m("dated_share") * 0.4 + m("freshness") * 0.6,
        "technicalOptimization": m("titled_share") * 0.25 + m("described_share") * 0.2 + m("canonical_share") * 0.2 + m("alt_ok_share") * 0.2 + m("transcribed_share") * 0.15,
    }
    return {k: round1(clamp(scores[k].cast("double"))) for k in WEIGHTS}


def with_clusters(metrics: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """metrics with n_clusters, n_intents, n_single of each run's topic clusters; 0 without clusters (an audit of one page has none)."""
    names = ["n_clusters", "n_intents", "n_single"]
    if clusters is None:
        return metrics.withColumns({n: F.lit(0) for n in names})
    stats = clusters.groupBy("run_id").agg(F.count("*").alias("n_clusters"), F.countDistinct("intent").alias("n_intents"), F.count_if(F.col("size") == 1).alias("n_single"))
    return metrics.join(stats, "run_id", "left").fillna(0, names)


def site_scores(metrics: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """run_id, score_id, score, weight: the site scores in long form.

    clusters: run_id, leader, size, intent (see `clusters.topic_clusters`); without them the runs count as audits of one page.
    """
    long = F.array(*[F.struct(F.lit(k).alias("score_id"), c.alias("score"), F.lit(WEIGHTS[k]).alias("weight")) for k, c in score_columns().items()])
    return with_clusters(metrics, clusters).select("run_id", F.inline(long))


def total_score(scores: DataFrame) -> DataFrame:
    """run_id, total: the weighted mean of the scores, one decimal."""
    tenths = F.sum(F.round(F.col("score") * 10).cast("long") * F.col("weight"))  # whole numbers add up alike in any order
    return scores.groupBy("run_id").agg(round1(tenths / F.sum("weight") / 10).alias("total"))


def provider_scores(metrics: DataFrame, verified: bool = False) -> DataFrame:
    """run_id, provider, score (0..100, one decimal). verified: the site announces changes by IndexNow."""
    m = F.col
    weak = lambda limit: F.greatest(F.lit(0.0), limit - m("answer_first"))
    lost = {
        "openai": m("blocked_openai") * 4 + weak(70) * 0.45 + m("restricted") * 3 - m("transparent_share") * 0.08,
        "google": m("blocked_google") * 2 + m("noindex") * 3 + m("render_heavy") * 4 + m("mismatch") * 4 - m("schema_coverage") * 0.05,
        "bing": m("blocked_bing") * 4 + m("restricted") * 3 + F.lit(0 if verified else 8) - m("schema_coverage") * 0.04,
        "perplexity": m("blocked_perplexity") * 4 + weak(65) * 0.40 + F.when(m("cited_share") < 60, 8).otherwise(0) - m("cited_share") * 0.05,
        "citation": weak(65) * 0.35 + m("restricted") * 2 - m("transparent_share") * 0.05,
    }
    return metrics.select("run_id", F.inline(F.array(*[F.struct(F.lit(p).alias("provider"), round1(clamp((100 - x).cast("double"))).alias("score")) for p, x in lost.items()])))


#: Words and patterns of the answer check.
QUESTION_WORDS = ["hva", "hvem", "hvordan", "hvorfor", "når", "where", "what", "who", "how", "why", "when", "which"]
BOILERPLATE_WORDS = r"(?iu)velkommen til|les mer om|kontakt oss|her finner du|på denne siden|vi tilbyr|thank you for visiting|this (page|site|website) (is|contains|provides)|cookie|privacy policy|all rights reserved"
UNITS = ["%", "kr", "nok", "usd", "eur", "gbp", "prosent", "percent", "million", "billion", "milliard"]
WORD_UNITS = ["months?", "days?", "weeks?"]
#: Digits before a unit (a year right behind them, months, days and weeks as words of their own), or two digits or more by themselves.
NUMBERS = rf"(?iu)\d+[.,]?\d*\s*({'|'.join(UNITS)}|(?<=[A-Za-z0-9_])år{RIGHT}|{LEFT}({'|'.join(WORD_UNITS)}){RIGHT})|{LEFT}\d{{2,}}{RIGHT}"
DEFINITION = f"(?iu){LEFT}(er|betyr|defineres som|means|is|refers to|stands for){RIGHT}"


def answer_quality() -> Column:
    """0..100 for how directly a page's first paragraph answers: struct of definition, standalone, question and score parts."""
    opening = F.trim(F.coalesce("first_paragraph", F.lit("")))
    low = F.lower(opening)
    n = F.length(opening)
    # fixed values: units, pronouns, lengths and points
    defines = (n > 20) & opening.rlike(DEFINITION)
    numbers = opening.rlike(NUMBERS)
    size_part = F.when((n >= 60) & (n <= 350), 0.4).when(n > 350, 0.2).otherwise(0.3)
    long_words = F.size(F.filter(F.split(opening, r"\s+"), lambda w: F.length(w) > 2))
    word_part = F.when(long_words >= 5, 0.6).when(long_words >= 3, 0.3).otherwise(0.0)
    pronoun = low.rlike(f"^(it|this|that|these|those|den|det|dette|disse|de|her|here){RIGHT}")
    alone = F.when(n < 40, 0.0).when(pronoun, 0.2).when(opening.rlike(BOILERPLATE_WORDS), 0.1).otherwise(F.least(F.lit(1.0), size_part + word_part))
    h1 = F.lower(F.coalesce("h1", F.lit("")))
    starts = reduce(lambda a, b: a | b, [h1.startswith(w) for w in QUESTION_WORDS])
    asks = starts | h1.endswith("?") | yes(F.lower(F.get("headings", F.lit(0))).endswith("?"))
    topic = F.slice(F.filter(F.split(F.regexp_replace(h1, "[?!.,]", ""), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(QUESTION_WORDS)), 1, 3)
    hits = F.size(F.filter(topic, lambda w: F.contains(low, w)))
    ratio = F.when(F.size(topic) > 0, hits / F.size(topic)).otherwise(0.0)
    fits = F.when(~asks, 0.5).when(F.size(topic) == 0, 0.4).when((ratio >= 0.6) & opening.rlike(DEFINITION), 1.0).when(ratio >= 0.4, 0.7).when(ratio >= 0.2, 0.4).otherwise(0.1)
    listed = F.substring(F.coalesce("body_text", F.lit("")), 1, 500).rlike(r"(^|\s)([-•*]|\d+[.)])\s")
    points = F.when(defines, 28).otherwise(0) + F.when(numbers, 18).otherwise(0) + alone * 20 + fits * 20 + F.when(listed, 14).otherwise(0)
    return F.struct(defines.alias("defines"), numbers.alias("numbers"), alone.alias("standalone"), fits.alias("question"), listed.alias("listed"), F.least(F.lit(100), F.floor(points + 0.5)).cast("int").alias("score"))


def page_answers(page_snapshots: DataFrame) -> DataFrame:
    """run_id, crawl_seq and the parts of `answer_quality`."""
    pages = counting(page_snapshots, ["first_paragraph", "h1", "headings", "body_text"])
    return pages.select(*KEYS, answer_quality().alias("a")).select(*KEYS, "a.*")


def intent(path: str = "path") -> Column:
    """Search intent of a page by words in path, title, h1 and description; the first match counts."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(path, F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("h1", F.lit("")), F.coalesce("meta_description", F.lit(""))))
    # fixed values: words by intent
    return (
        F.when(hay.rlike("buy|pricing|price|bestill|kjøp|kontakt salg|demo|book|start now|registrer"), "transactional")
        .when(hay.rlike("vs|compare|comparison|alternatives|beste|review|top|why us|case study"), "commercial investigation")
        .when(hay.rlike("login|signin|logg inn|dashboard|account|konto|home"), "navigational")
        .otherwise("informational")
    )


def page_intents(page_snapshots: DataFrame) -> DataFrame:
    """run_id, crawl_seq, intent."""
    return counting(page_snapshots, ["path", "title", "h1", "meta_description"]).select(*KEYS, intent().alias("intent"))


def run_intents(page_snapshots: DataFrame) -> DataFrame:
    """run_id, intent, pages: the most frequent intent of a run; of equal counts the one seen first."""
    one = page_intents(page_snapshots).groupBy("run_id", "intent").agg(F.count("*").alias("pages"), F.min("crawl_seq").alias("first"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("pages"), "first"))
    return one.withColumn("r", rank).filter("r = 1").select("run_id", "intent", "pages")


def render_priority() -> Column:
    """How much a page gains from rendering: little text and many scripts, weighted by the kind of path."""
    text, scripts, path = F.coalesce("rendering.raw_text_length", F.lit(0)), F.coalesce("script_count", F.lit(0)), F.coalesce("path", F.lit(""))
    # fixed values: points by text length, scripts and kind of path
    little = F.when(text < 200, 40).when(text < 500, 20).when(text < 1000, 5).otherwise(0)
    many = F.when(scripts > 10, 30).when(scripts > 5, 15).when(scripts > 3, 5).otherwise(0)
    kind = (
        F.when(path.isin("", "/"), 40)
        .when(path.rlike("^/(blog|articles?|posts?|nyheter|innlegg)/[^/]+$"), 35)
        .when(path.rlike("^/(produkt|product|tjeneste|service|solutions?|losning|losninger)"), 30)
        .when(path.rlike("^/(kategori|category|topics?|tema)"), 20)
        .when(path.rlike("^/(pris|pricing|price|cost)"), 25)
        .otherwise(0)
    )
    static = F.when(path.rlike("^/(om|about|kontakt|contact|personvern|privacy|vilkar|terms|404|sitemap)"), -40).otherwise(0)
    return little + many + kind + static + F.when(text > 2000, -30).otherwise(0) + F.when(scripts == 0, -20).otherwise(0)


def render_candidates(page_snapshots: DataFrame, budget: int = 10) -> DataFrame:
    """run_id, crawl_seq, priority, rank_no of the `budget` pages of each run that gain most from rendering; ties in crawl order."""
    pages = counting(page_snapshots, ["content_type", "blocked_by_robots", "status_code", "rendering", "script_count", "path"])
    status_ok = F.col("status_code").isNull() | (F.col("status_code") < 400)
    fit = pages.filter(~yes(F.col("blocked_by_robots")) & _html() & status_ok).select(*KEYS, render_priority().alias("priority"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("priority"), "crawl_seq"))
    return fit.withColumn("rank_no", rank).filter(F.col("rank_no") <= budget)


def rendering_model(text: Column, scripts: Column) -> Column:
    """Guess before rendering, from text length and scripts."""
    return F.when(text > 1500, "ssr").when((text > 400) | (scripts <= 5), "hybrid").when((scripts > 5) & (text < 300), "csr").otherwise("unknown")


def rendered_model(raw: Column, rendered: Column) -> Column:
    """After rendering: csr if the text grew much from little, hybrid if it grew, else ssr."""
    return F.when((rendered > raw * 2.2) & (raw < 400), "csr").when(rendered > raw * 1.2, "hybrid").otherwise("ssr")


def render_ratio(raw: Column, rendered: Column) -> Column:
    """rendered / raw; 10 or 1 where raw is 0, with or without rendered text."""
    return F.when(raw > 0, rendered / raw).when(rendered > 0, 10.0).otherwise(1.0)


#: Link parts of authoritative sources.
AUTHORITIES = [".gov", ".edu", ".org", "wikipedia.org", "scholar.google", "pubmed", "ncbi.nlm.nih.gov", "ssb.no", "regjeringen.no", "lovdata.no", "who.int", "nature.com", "sciencedirect"]


def trust_signals() -> dict[str, Column]:
    """Signals of experience, expertise, authority and trust on a page, by name."""
    links = F.coalesce("external_links", F.array().cast("array<string>"))
    every = F.concat(links, F.coalesce("internal_links", F.array().cast("array<string>")))
    body = F.coalesce("body_text", F.lit(""))
    cited = F.exists(links, lambda x: reduce(lambda a, b: a | b, [x.contains(a) for a in AUTHORITIES]))
    # fixed values: first-person phrases, units of examples, words of privacy links
    person = f"(?iu){LEFT}(jeg\\s+(testet|prøvde|erfarte|opplevde|brukte|anbefaler)|vi\\s+(testet|prøvde|erfarte|brukte|anbefaler|har|opplevde)|i\\s+(tested|tried|experienced|used|recommend|found|noticed|learned)|we\\s+(tested|tried|found|used|recommend|experienced)){RIGHT}"
    types = F.coalesce("schema.types", F.array().cast("array<string>"))
    has = lambda *t: reduce(lambda a, b: a | b, [yes(F.array_contains(types, x)) for x in t])
    return {
        "first_person": body.rlike(person),
        "examples": yes(F.col("word_count") > 200) & body.rlike(r"(?i)(?<![A-Za-z0-9_])(\d{4}|\d+\s*(kr|%|prosent|timer|uker|måneder))"),
        "media": yes((F.col("image_count") > 0) & (F.col("images_without_alt") < F.col("image_count"))) | yes(F.col("has_transcript_signals")),
        "byline": yes(F.col("author") != ""),
        "citations": yes(cited),
        "terminology": F.size(F.regexp_extract_all(body, F.lit(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{9,}(?![A-Za-z0-9_])"), F.lit(0))) >= 5,
        "about": yes(F.col("has_about_link")),
        "organization": has("Organization", "LocalBusiness"),
        "breadcrumb": has("BreadcrumbList"),
        "contact": yes(F.col("has_contact_link")),
        "privacy": yes(F.exists(every, lambda x: x.rlike(r"(?i)person(vern|data)|privacy\s*policy|cookie\s*(policy|settings)|gdpr|informasjonskapsler"))),
        "https": yes(F.col("url").startswith("https://")),
        "canonical": yes(F.col("canonical_url") != ""),
        "published": F.col("date_published").isNotNull(),
        "modified": F.col("date_modified").isNotNull(),
    }


TRUST_COLUMNS = ["external_links", "internal_links", "body_text", "word_count", "image_count", "images_without_alt", "has_transcript_signals", "author", "has_about_link", "schema", "has_contact_link", "url", "canonical_url", "date_published", "date_modified", "headings", "list_count", "table_count", "faq_count", "inbound_links"]


def content_depth() -> Column:
    """0..100 by length, headings, lists and tables, and questions."""
    z = lambda c: F.coalesce(c, F.lit(0))
    parts = [F.least(F.lit(40.0), z("word_count") / 1000 * 40), F.least(F.lit(20.0), z(F.size("headings")) / 5 * 20), F.least(F.lit(20.0), (z("list_count") + z("table_count") * 2) / 5 * 20), F.least(F.lit(20.0), z("faq_count") * 10.0)]
    return F.floor(reduce(lambda a, b: a + b, parts) + 0.5)


#: The weight of each signal within its group, and the groups' weights.
TRUST_POINTS = {
    "experience": (0.25, {"first_person": 40, "examples": 35, "media": 25}),
    "expertise": (0.30, {"byline": 30, "citations": 25, "terminology": 15}),
    "authority": (0.25, {"about": 25, "organization": 30, "breadcrumb": 15}),
    "trust": (0.20, {"contact": 20, "privacy": 20, "https": 20, "canonical": 15, "published": 10, "modified": 15}),
}


def page_trust(page_snapshots: DataFrame) -> DataFrame:
    """run_id, crawl_seq, every signal as 0 or 1, depth and composite (0..100)."""
    pages = counting(page_snapshots, TRUST_COLUMNS).select(*KEYS, "inbound_links", content_depth().alias("depth"), *[c.cast("int").alias(n) for n, c in trust_signals().items()])
    extra = {"expertise": F.col("depth") * 0.3, "authority": F.least(F.lit(30), F.coalesce("inbound_links", F.lit(0)) * 3)}
    groups = []
    for name, (weight, points) in TRUST_POINTS.items():
        group = reduce(lambda a, b: a + b, [F.col(s) * p for s, p in points.items()], extra.get(name, F.lit(0)))
        groups.append((F.least(F.lit(100), group) if name != "experience" else group) * weight)
    composite = F.least(F.lit(100), F.floor(reduce(lambda a, b: a + b, groups) + 0.5)).cast("int")
    return pages.withColumn("composite", composite).drop("inbound_links")


def run_trust(page_snapshots: DataFrame) -> DataFrame:
    """Per run: pages, mean composite and the shares of pages with author, citations and basic trust, rounded."""
    rows = page_trust(page_snapshots)
    whole = lambda c: F.floor(c + 0.5).cast("long")
    share = lambda c: whole(F.avg(F.when(c, 100.0).otherwise(0.0)))
    return rows.groupBy("run_id").agg(
        F.count("*").alias("pages"),
        whole(F.avg("composite")).alias("average"),
        share(F.col("byline") == 1).alias("author_share"),
        share(F.col("citations") == 1).alias("citation_share"),
        share((F.col("https") == 1) & (F.col("canonical") == 1) & (F.col("contact") == 1)).alias("trust_share"),
    )


def trust_gaps(page_snapshots: DataFrame, most: int = 3) -> DataFrame:
    """run_id, gap, pages, rank_no: the signals that most pages of a run lack; ties by name."""
    rows = page_trust(page_snapshots)
    signals = [s for _, p in TRUST_POINTS.values() for s in p]
    lacks = rows.select("run_id", F.explode(F.array_compact(F.array(*[F.when(F.col(s) == 0, F.lit(s)) for s in signals]))).alias("gap"))
    counts = lacks.groupBy("run_id", "gap").agg(F.count("*").alias("pages"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("pages"), "gap"))
    return counts.withColumn("rank_no", rank).filter(F.col("rank_no") <= most)
