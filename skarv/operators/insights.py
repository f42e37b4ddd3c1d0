"""What page scores and metrics say together: findings, gaps between sites, coverage of queries, what-if projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarv.functions.text import round1
from skarv.functions.unicode import tokens
from skarv.operators.pages import FLAG_COLUMNS, KEYS, PROVIDERS, counting, flags, provider_scores, score_columns, site_metrics, site_scores, total_score, yes
from skarv.runtime import cut


#: Issues in the order of their rules, with score, priority, providers, and the effort and impact of mending them.
ISSUES = {
    "rendering-csr": ("renderingAiAccessibility", "critical", "openai google bing perplexity citation", "Strategiske endringer", "Høy"),
    "schema-mismatch": ("schemaSemanticSearch", "high", "google bing perplexity", "Middels innsats", "Høy"),
    "orphan-pages": ("internalLinking", "high", "google bing openai citation", "Middels innsats", "Middels"),
    "snippet-controls": ("zeroClickAiOverviews", "medium", "google bing openai perplexity citation", "Quick wins", "Middels"),
    "answer-first": ("answerFirstContent", "high", "openai google bing perplexity citation", "Quick wins", "Høy"),
    "trust-signals": ("citationAuthorityEntitySignals", "medium", "openai google bing perplexity citation", "Quick wins", "Middels"),
    "freshness": ("contentFreshness", "medium", "google bing openai perplexity", "Quick wins", "Middels"),
    "indexnow-readiness": ("technicalOptimization", "low", "bing", "Middels innsats", "Lav"),
    "technical-metadata": ("technicalOptimization", "medium", "google bing openai citation", "Quick wins", "Middels"),
}
PRIORITIES = ["critical", "high", "medium", "low"]


def site_issues(metrics: DataFrame, index_now: str = "unknown", least_answer: float = 60, least_share: float = 50, least_technical: float = 70) -> DataFrame:
    """run_id, place, issue, category, priority, providers, effort, impact: rules over site metrics, each a condition of one row.

    place: 0.. within the run, by priority, then in the order of the rules. index_now: verified, not-detected or unknown.
    """
    m = F.col
    rules = {
        "rendering-csr": m("render_heavy") > 0,
        "schema-mismatch": m("mismatch") > 0,
        "orphan-pages": m("orphans") > 0,
        "snippet-controls": m("restricted") > 0,
        "answer-first": m("answer_first") < least_answer,
        "trust-signals": m("transparent_share") < least_share,
        "freshness": m("dated_share") < least_share,
        "indexnow-readiness": F.lit(index_now != "verified"),
        "technical-metadata": score_columns()["technicalOptimization"] < least_technical,
    }
    fields = ("issue", "category", "priority", "providers", "effort", "impact")
    made = lambda n: F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, (n, *ISSUES[n]))])
    ordered = sorted(ISSUES, key=lambda n: PRIORITIES.index(ISSUES[n][1]))
    found = F.array_compact(F.array(*[F.when(rules[n], made(n)) for n in ordered]))
    return metrics.select("run_id", F.posexplode(found).alias("place", "x")).select("run_id", "place", "x.*")


def affected_pages(page_snapshots: DataFrame, most: int = 8) -> DataFrame:
    """run_id, issue, pages, first_urls: how many eligible pages an issue affects, and the first `most` of them in crawl order.

    A window keeps the first ones, so no list grows with the site.
    """
    f = flags()
    rules = {
        "rendering-csr": f["render_heavy"],
        "schema-mismatch": f["schema_mismatch"],
        "orphan-pages": f["orphan"],
        "snippet-controls": f["snippet_restricted"],
        "answer-first": F.coalesce("answer_first_signals.direct_answer_likelihood", F.lit(0)) < 55,
        "trust-signals": ~f["transparent"],
        "freshness": ~f["dated"],
        "technical-metadata": ~(f["titled"] & f["described"] & f["canonical"] & f["alt_ok"]),
    }
    pages = counting(page_snapshots, [*FLAG_COLUMNS, "url"]).filter(f["eligible"])
    hit = pages.select(*KEYS, "url", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("issue"))
    counts = hit.groupBy("run_id", "issue").agg(F.count("*").alias("pages"))
    rank = F.row_number().over(Window.partitionBy("run_id", "issue").orderBy("crawl_seq"))
    first = hit.withColumn("r", rank).filter(F.col("r") <= most).groupBy("run_id", "issue").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "url"))), lambda x: x["url"]), " ").alias("first_urls"))
    return counts.join(first, ["run_id", "issue"])


#: Words in a path by kind; the first match counts.
PATH_KINDS = {
    "contact": "kontakt|contact",
    "about": "om-oss|about|om-",
    "menu": "meny|menu|mat|food|drikke|drink",
    "booking": "reservasjon|bestill|booking|book|reserver",
    "event": "arrangement|event|fest|julebord|bryllup|selskap",
    "location": "kart|finn-oss|veibeskrivelse|adresse|location",
    "gallery": "galleri|bilder|foto|gallery",
    "news": "nyheter|blogg|news|aktuelt",
}


def path_kind(path: Column) -> Column:
    """Kind of a page by its path."""
    kind = F.when(path.isin("", "/"), "home")
    for name, words in PATH_KINDS.items():
        kind = kind.when(path.rlike(f"(?i){words}"), name)
    return kind.otherwise("generic")


def query_coverage(page_snapshots: DataFrame, queries: DataFrame) -> DataFrame:
    """domain, page, query, matched, missing, covered: which words of a page's queries its newest snapshot holds.

    queries: domain, page, query (a few per page). covered: half of the words or more, at least one, are there. Pages meet their
    queries by domain and path; pages without query or the other way round drop out.
    """
    from skarv.functions.urls import domain_key, page_key

    columns = ["domain", "path", "title", "h1", "meta_description", "headings", "first_paragraph"]
    pages = counting(page_snapshots, [*columns, "ingested_at"]).select("run_id", "crawl_seq", domain_key(F.col("domain")).alias("domain"), page_key(F.col("path")).alias("page"), F.concat_ws(" ", "title", "h1", "meta_description", F.array_join(F.coalesce("headings", F.array().cast("array<string>")), " "), "first_paragraph").alias("text"), "ingested_at")
    newest = pages.groupBy("domain", "page").agg(F.max_by("text", F.struct("ingested_at", "run_id", "crawl_seq")).alias("text"))
    both = queries.select("domain", "page", "query").join(newest.withColumn("words", tokens("text")), ["domain", "page"]).withColumn("q", F.array_distinct(tokens("query")))
    matched, missing = F.array_intersect("q", "words"), F.array_except("q", "words")
    covered = F.size(matched) >= F.greatest(F.lit(1), F.ceil(F.size("q") / 2))
    return both.select("domain", "page", "query", F.array_join(matched, " ").alias("matched"), F.array_join(missing, " ").alias("missing"), covered.alias("covered"))


#: By gap the metric compared and the margin by which the others have to be ahead.
GAPS = {"schema-gap": ("schema_coverage", 10.0), "freshness-gap": ("freshness", 10.0), "answer-first-gap": ("answer_first", 8.0), "coverage-gap": ("eligible", 8.0)}


def site_gaps(metrics: DataFrame, rivals: DataFrame) -> DataFrame:
    """run_id, gap, own, others: where a run's site lies behind the mean of its competitors' sites by a margin.

    rivals: run_id, rival_run_id – the runs of the competitors' sites. Their metrics are rounded to one decimal before the mean is taken.
    Runs without competitors have no gaps.
    """
    metrics = cut(metrics, "site-metrics")
    names = [n for n, _ in GAPS.values()]
    theirs = metrics.select(F.col("run_id").alias("rival_run_id"), *[round1(F.col(n).cast("double")).alias(n) for n in names])
    means = rivals.join(theirs, "rival_run_id").groupBy("run_id").agg(*[F.avg(n).alias(f"_{n}") for n in names])
    each = F.array(*[F.struct(F.lit(g).alias("gap"), F.col(n).cast("double").alias("own"), F.col(f"_{n}").alias("others"), F.lit(margin).alias("margin")) for g, (n, margin) in GAPS.items()])
    rows = metrics.join(means, "run_id").select("run_id", F.inline(each)).filter(F.col("others") > F.col("own") + F.col("margin"))
    return rows.select("run_id", "gap", round1(F.col("own")).alias("own"), round1(F.col("others")).alias("others"))


def missing_clusters(own: DataFrame, theirs: DataFrame) -> DataFrame:
    """run_id, cluster: the distinct clusters (run_id, name) of an audit's competitors that the audited site doesn't have."""
    return theirs.select("run_id", F.col("name").alias("cluster")).distinct().join(own.select("run_id", F.col("name").alias("cluster")), ["run_id", "cluster"], "left_anti")


def rewritten(page_snapshots: DataFrame, as_of: str, weak_only: bool = True) -> DataFrame:
    """Snapshots as if every weak page (answer likelihood under 55), or every page, had been rewritten well.

    The rewrite is a projection: likelihood 92, a list, a question, dates where there were none.
    """
    weak = F.coalesce("answer_first_signals.direct_answer_likelihood", F.lit(0)) < 55 if weak_only else F.lit(True)
    signals = page_snapshots.schema["answer_first_signals"].dataType
    better = F.struct(*[(F.lit(92).cast(f.dataType) if f.name == "direct_answer_likelihood" else F.col(f"answer_first_signals.{f.name}")).alias(f.name) for f in signals.fields])
    stamp = page_snapshots.schema["date_modified"].dataType
    return page_snapshots.withColumns(
        {
            "answer_first_signals": F.when(weak, better).otherwise(F.col("answer_first_signals")),
            "faq_count": F.when(weak, F.greatest(F.coalesce("faq_count", F.lit(0)), F.lit(1))).otherwise(F.col("faq_count")),
            "list_count": F.when(weak, F.greatest(F.coalesce("list_count", F.lit(0)), F.lit(1))).otherwise(F.col("list_count")),
            "date_modified": F.when(weak & F.col("date_modified").isNull() & F.col("date_published").isNull(), F.lit(as_of).cast(stamp)).otherwise(F.col("date_modified")),
        }
    )


def what_if(page_snapshots: DataFrame, as_of: str) -> DataFrame:
    """run_id, score_id, before, after, change: all site scores and provider scores if every weak page were rewritten well.

    Everything after the rewrite is the same aggregate over the same site. Topic clusters don't come into it, as a rewrite changes none.
    """
    sides = []
    for name, pages in (("before", page_snapshots), ("after", rewritten(page_snapshots, as_of))):
        metrics = cut(site_metrics(pages, as_of), f"metrics-{name}")
        scores = site_scores(metrics).select("run_id", "score_id", F.col("score").alias(name))
        sides.append(scores.unionByName(provider_scores(metrics).select("run_id", F.col("provider").alias("score_id"), F.col("score").alias(name))))
    both = sides[0].join(sides[1], ["run_id", "score_id"])
    return both.select("run_id", "score_id", "before", "after", round1(F.col("after") - F.col("before")).alias("change"))


def page_impact(page_snapshots: DataFrame, as_of: str, n: int = 5) -> DataFrame:
    """run_id, crawl_seq, before, after, change, rank_no: the n pages of each run that would score most above the site if rewritten.

    before: the site's total score; after: the total of the rewritten page alone, each page as a site of its own. Ties by crawl order.
    """
    alone = F.concat_ws("#", "run_id", F.col("crawl_seq").cast("string"))
    before = total_score(site_scores(site_metrics(page_snapshots, as_of))).select("run_id", F.col("total").alias("before"))
    own = counting(page_snapshots, [*FLAG_COLUMNS, "list_count"]).filter(flags()["eligible"])
    names = own.select(*KEYS, alone.alias("page"))
    single = rewritten(own.withColumns({"run_id": alone, "ingested_at": F.lit(0)}), as_of, weak_only=False)
    after = total_score(site_scores(site_metrics(single, as_of))).select(F.col("run_id").alias("page"), F.col("total").alias("after"))
    both = names.join(after, "page").join(before, "run_id")
    change = round1(F.col("after") - F.col("before"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("change"), "crawl_seq"))
    rows = both.select(*KEYS, "before", "after", change.alias("change")).withColumn("rank_no", rank)
    return rows.filter(F.col("rank_no") <= n)


def markdown_lists(rows: DataFrame, key: str, heading: str, item: str) -> DataFrame:
    """key, text: a heading for each group and its items as list lines, groups and items in order. Groups of a key are few."""
    line = F.concat(F.lit("## "), F.col(heading), F.lit("\n- "), F.regexp_replace(item, " ", "\n- "))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(heading, line.alias("line")))), lambda x: x["line"]), "\n\n").alias("text"))


def axis_labels(n: int, most: int = 5) -> list[int]:
    """Positions of at most `most` evenly spaced labels among n points."""
    if n <= most:
        return list(range(n))
    return sorted({int(i / (most - 1) * (n - 1) + 0.5) for i in range(most)})


def client_key(forwarded: Column) -> Column:
    """The first address of a forwarding header, or `unknown`."""
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.when(yes(first != ""), first).otherwise("unknown")


def band(score: Column, strong: float = 80, fair: float = 60) -> Column:
    """strong, fair or weak."""
    return F.when(score >= strong, "strong").when(score >= fair, "fair").otherwise("weak")


#: What a page needs, with the points that each need counts.
NEEDS = {"title-length": 3, "description-length": 3, "no-schema": 3, "schema-mismatch": 0, "late-answer": 4}


def page_needs(page_snapshots: DataFrame, most: int = 15) -> DataFrame:
    """run_id, crawl_seq, needs, points, rank_no: what every eligible page lacks, the first `most` of each run by points.

    A title has 35 to 60 characters, a description 120 to 160; a page has structured data that matches what it shows, and an answer
    likelihood of 70 or more. Ties by crawl order.
    """
    long = lambda c, low, high: ~F.coalesce(F.length(c), F.lit(0)).between(low, high)
    typed = yes(F.size("schema.types") > 0)
    rules = {
        "title-length": long("title", 35, 60),
        "description-length": long("meta_description", 120, 160),
        "no-schema": ~typed,
        "schema-mismatch": typed & ~yes(F.col("schema.matches_visible_content")),
        "late-answer": F.coalesce("answer_first_signals.direct_answer_likelihood", F.lit(0)) < 70,
    }
    pages = counting(page_snapshots, FLAG_COLUMNS).filter(flags()["eligible"])
    points = sum((F.when(c, NEEDS[n]).otherwise(0) for n, c in rules.items()), F.lit(0))
    rows = pages.select(*KEYS, F.concat_ws(" ", *[F.when(c, F.lit(n)) for n, c in rules.items()]).alias("needs"), points.alias("points"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("points"), "crawl_seq"))
    return rows.withColumn("rank_no", rank).filter(F.col("rank_no") <= most)


def run_summaries(metrics: DataFrame, index_now: str = "unknown") -> DataFrame:
    """run_id, eligible, strongest, strongest_score, first_issue, issues: what an audit's summary is made of.

    strongest: the provider with the highest score, of equal ones the first of PROVIDERS; first_issue: by priority, then rule.
    """
    place = F.array_position(F.array(*[F.lit(p) for p in PROVIDERS]), F.col("provider"))
    best = provider_scores(metrics).groupBy("run_id").agg(F.max(F.struct("score", -place, "provider")).alias("b"))
    found = site_issues(metrics, index_now).groupBy("run_id").agg(F.min_by("issue", "place").alias("first_issue"), F.count("*").alias("issues"))
    rows = metrics.select("run_id", "eligible").join(best, "run_id").join(found, "run_id", "left")
    return rows.select("run_id", "eligible", F.col("b.provider").alias("strongest"), F.col("b.score").alias("strongest_score"), "first_issue", F.coalesce("issues", F.lit(0)).alias("issues"))
