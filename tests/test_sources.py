"""Robots rules, sitemaps, crawls, HTML and requests."""

import pytest
from pyspark.sql import functions as F

from skarv.sources import crawl, html, requests, robots

FILE = """# comment
User-agent: GPTBot
User-agent: bingbot
Disallow: /private # stays
Allow: /private/open
Disallow:

User-agent: *
Disallow: /*.pdf$
Disallow: /tmp
Allow: /tmp
Sitemap: https://a.example/sitemap.xml
"""


def test_robots(spark):
    files = spark.createDataFrame([("a.example", FILE), ("b.example", None), ("c.example", "Disallow: /x")], "host string, content string")
    table = robots.rules(files)
    got = {(r.group_no, r.agent, r.kind, r.pattern) for r in table.collect()}
    assert (1, "gptbot", "allow", "/private/open") in got and (1, "bingbot", "disallow", "/private # stays") in got and len(got) == 7
    assert [r.url for r in robots.sitemaps(files).collect()] == ["https://a.example/sitemap.xml"]
    paths = spark.createDataFrame([("a.example", p) for p in ("/tmp/x", "/f.pdf", "/f.pdf?x", "/private/open/1", "/private # stays", "/")] + [("z.example", "/")], "host string, path string")
    every = {(r.host, r.path): r.allowed for r in robots.allowed(paths, table, "SomeBot").collect()}
    assert every["a.example", "/tmp/x"] and not every["a.example", "/f.pdf"] and every["a.example", "/f.pdf?x"] and every["z.example", "/"]
    gpt = {r.path: r.allowed for r in robots.allowed(paths, table, "GPTBot/1.0").collect()}
    assert gpt["/f.pdf"] and gpt["/private/open/1"] and not gpt["/private # stays"]
    blocks = {r.path: (r.general_allowed, r.blocked_providers) for r in robots.provider_blocks(paths.filter("host = 'a.example'"), table, robots.PROVIDER_AGENTS).collect()}
    assert blocks["/private # stays"] == (True, ["openai", "bing"]) and blocks["/f.pdf"] == (False, ["openai", "google", "perplexity", "citation"])


def test_sitemaps_and_crawl(spark):
    loc = lambda *u: "".join(f"<url><loc> {x} </loc></url>" for x in u)
    files = spark.createDataFrame([("m.xml", loc("n.xml", "p&amp;1")), ("n.xml", loc("m.xml", "p2", "p2")), ("other.xml", loc("p3"))], "url string, content string")
    seeds = spark.createDataFrame([("m.xml",)], "url string")
    assert sorted(r.url for r in crawl.sitemap_urls(seeds, files).collect()) == ["p&1", "p2"]
    deep = spark.createDataFrame([(f"s{i}.xml", f"<loc>s{i + 1}.xml</loc><loc>s0.xml</loc><loc>p{i}</loc>") for i in range(25)], "url string, content string")
    assert crawl.sitemap_urls(spark.createDataFrame([("s0.xml",)], "url string"), deep).count() == 25
    h = "https://a.example"
    links = spark.createDataFrame([(h, h + "/1"), (h + "/", h + "/2/"), (h + "/1", h + "/2#x"), (h + "/2", h + "/3"), (h + "/2", h + "/pic.jpg"), (h + "/2", "https://b.example/"), (h + "/9", h + "/8")], "src string, dst string")
    got = {r.url: r.depth for r in crawl.crawl(spark.createDataFrame([(h,)], "url string"), links).collect()}
    assert got == {h + "/": 0, h + "/1": 1, h + "/2": 1, h + "/3": 2}


def test_crawl_follows_long_chains(spark):
    h = "https://a.example"
    pages = [f"{h}/{i}" for i in range(26)]
    links = spark.createDataFrame([*zip(pages, pages[1:]), (pages[-1], pages[0]), (pages[22], pages[2])], "src string, dst string")
    got = {r.url: r.depth for r in crawl.crawl(spark.createDataFrame([(pages[0],)], "url string"), links).collect()}
    assert got == {p: i for i, p in enumerate(pages)}


PAGE = """<html><head><title> A  page </title><meta name="description" content="About"><meta name=robots content="noindex, max-snippet:20">
<link rel="canonical" href="/c"><script type="application/ld+json">[{"@type": ["FAQPage", "X"]}, 3]</script><script>var p = "</p>";</script></head>
<body><h1>Head <b>line</b></h1><p>First: one<p>Second<ul><li>a: b</ul><a href="/in/">i</a><a href="https://Out.example/#x">o</a><a href="#top">t</a><a href="mailto:x@y">m</a>
<img src=x><img src=y alt="z"><table><tr><td>1</table></body>"""


def test_html(spark):
    row = html.read_html("https://a.example/p", PAGE)
    assert row["title"] == "A page" and row["h1"] == "Head line" and row["headings"] == ["Head line"]
    assert row["first_paragraph"] == "First: one" and row["paragraph_count"] == 2 and row["definition_like_blocks"] == 2
    assert row["noindex"] and row["max_snippet"] == 20 and row["canonical_url"] == "https://a.example/c"
    assert row["internal_links"] == ["https://a.example/in"] and row["external_links"] == ["https://out.example/"]
    assert row["schema_types"] == ["FAQPage", "X"] and row["faq_count"] == 1 and row["image_count"] == 2 and row["images_without_alt"] == 1
    df = spark.createDataFrame([(1, None, None), (2, "https://a.example/", PAGE), (3, "u", "<p" * 50)], "k int, url string, html string")
    assert html.html_pages(df, "k").count() == 3


def test_requests():
    ok = requests.check_request({"targetUrl": "https://A.example", "maxPages": 500})
    assert ok["targetUrl"] == "https://a.example/" and ok["maxPages"] == 500 and ok["mode"] == "domain"
    one = requests.check_request({"targetUrl": "https://a.example/x", "mode": "page", "competitorUrls": ["https://b.example"]})
    assert one["maxPages"] == 1 and one["competitorUrls"] == []
    for bad in ({"targetUrl": "ftp://a"}, {"targetUrl": "https://a", "maxPages": 9}, {"targetUrl": "https://a", "country": "NOR"}, {"targetUrl": "https://a", "mode": "x"}, {"targetUrl": "https://a", "competitorUrls": ["x"]}):
        with pytest.raises(ValueError):
            requests.check_request(bad)


def test_latest_counts(spark):
    from skarv.sources.tables import latest, latest_value

    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, 4), ("b", 7, None), (None, 9, 1), (None, 8, 2)], "k string, v int, ingested_at int")
    got = {(r.k, r.v) for r in latest(df, ["k"], ["v"]).collect()}
    assert got == {("a", 2), ("b", 7), (None, 8)}
    stamped = df.withColumn("ingested_at", F.timestamp_seconds("ingested_at"))
    assert {(r.k, r.v) for r in latest_value(stamped, ["k"], "v").collect()} == got


FULL = """<html><head><title>T</title><meta property="article:published_time" content="2026-01-02"><script type="application/ld+json">{"@type": "Article", "headline": "A headline of the page", "author": {"name": "Ann"}, "publisher": "Firm", "dateModified": "no date"}</script></head>
<body><h1>A headline of the page</h1><p>[gallery id=3] Opening {{x}} line of text that is long enough to be a concise opening here.</p><time datetime="2026-02-03T04:05:06+02:00">x</time><ul><li>a</ul><table></table>
<video><track kind="captions"></video><a href="/om-oss">Who</a><a href="/x">Kontakt</a></body></html>"""


def test_html_fields_of_a_full_page():
    row = html.read_html("https://a.example/p", FULL, "noindex, max-snippet:5")
    assert row["first_paragraph"].startswith("Opening line") and "gallery" not in row["body_text"] and row["concise_opening"]
    assert (row["author"], row["publisher"], row["schema_visible"]) == ("Ann", "Firm", True)
    assert (row["date_published"], row["date_modified"]) == ("2026-01-02T00:00:00.000Z", "2026-02-03T02:05:06.000Z")
    assert row["has_about_link"] and row["has_contact_link"] and row["has_transcript_signals"] and row["has_table"] and row["has_list"] and not row["has_faq"]
    assert row["noindex"] and row["max_snippet"] == 5 and row["robots_meta"] == [] and row["raw_text_length"] == len(row["body_text"])
    other = html.read_html("https://a.example/", '<meta name="author" content=""><script type="application/ld+json">{"name": "Something else entirely", "author": "Bo"}</script><p>x<a rel="author" href=/bo>By Bo</a></p><p>utskrift')
    assert other["author"] is None and not other["schema_visible"] and other["has_transcript_signals"] and not other["has_about_link"]
    assert html.read_html("https://a.example/", '<a rel="author" href=/>By <b>Bo</b></a><p>x')["author"] == "By Bo"
    assert html.probe([{"a": {"b": " "}}, {"a": {"b": "c"}}], "a.b", "a") == "c" and html.probe([], "a") is None


def test_blocked_pages_have_an_empty_row(spark):
    df = spark.createDataFrame([(1, FULL, True, None), (2, FULL, None, "nosnippet")], "k int, html string, blocked boolean, h string").withColumn("url", F.lit("https://a.example/"))
    rows = {r.k: r for r in html.html_pages(df, "k", header="h", blocked="blocked").collect()}
    assert (rows[1].title, rows[1].raw_html_bytes, rows[1].word_count, rows[1].schema_visible) == ("", 0, 0, True)
    assert rows[2].no_snippet and rows[2].raw_html_bytes == len(FULL)
