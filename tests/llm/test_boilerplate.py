"""p3: main content of pages."""

import datetime as dt
import random

from skarv.llm import boilerplate as module
from skarv.llm.boilerplate import boilerplate, is_sentence, main_content, shape

T = dt.datetime(2026, 1, 1)
PAGE = "run_id string, crawl_seq bigint, ingested_at timestamp_ntz, url string, body_text string, headings array<string>, h1 string, title string, first_paragraph string, hs string, site string"
RUN = "id string, target_url string, ingested_at timestamp_ntz"
WORDS = "garden roof boat snow floor window kitchen stage yoga cake venue event copy tooth dog plumbing cabin house bicycle language".split()


def site(s, rnd, n=12):
    """Pages of a site with frames, and the line numbers that are no main content."""
    pages, truth = [], {}
    titles = [f"{rnd.choice(WORDS).title()} in Place{s}{i} | Firm{s}" for i in range(n)]
    for i in range(n):
        own = []
        for _ in range(3):
            own.append(f"About {rnd.choice(WORDS)} number {rnd.randint(1, 999)} {rnd.choice(WORDS)}{i}")
            own.append(f"We look after {rnd.choice(WORDS)} and {rnd.choice(WORDS)}{i}{rnd.randint(0, 99)} all year, and people in the town know us well by now.")
            own.append(f"- Visit {rnd.choice(WORDS)}{rnd.randint(0, 30)}")
        h1 = f"Main heading {i} of {rnd.choice(WORDS)}"
        head = ["Skip to content", "Menu", f"Home > {titles[i]}"]
        byline = [f"Written by Name{rnd.randint(0, 3)} Other{rnd.randint(0, 3)}"] if rnd.random() < 0.5 else []
        tail = ["Share this page", "Most read", titles[(i + 1) % n], titles[(i + 5) % n], f"© 2026 Firm{s}. All rights reserved"]
        mid = ["Sign up for our newsletter"] if rnd.random() < 0.6 else []
        lines = head + [h1] + byline + own[:1] + own[1:5] + mid + own[5:] + [""] + tail
        bad = set(range(3)) | ({4} if byline else set()) | {lines.index(x) for x in mid} | set(range(len(lines) - 5, len(lines)))
        first = own[1] if rnd.random() < 0.8 else head[0]
        if byline and first == own[1]:
            lines[5], lines[6] = lines[6], lines[5]  # a paragraph follows the byline
        pages.append((f"r{s}", i, T, f"https://s{s}.example/{i}", "\n".join(lines), [h1, *own[::3]], h1, titles[i], first, "clash", "clash"))
        truth[f"r{s}", i] = bad | ({-1} if first == head[0] else set())
    return pages, truth


def test_frames_bylines_links_and_prompts_go(spark):
    rnd = random.Random(4)
    pages, truth = [], {}
    for s in range(12):
        p, t = site(s, rnd)
        pages += p
        truth |= t
    runs = [(f"r{s}", f"https://s{s}.example/", T) for s in range(12)]
    df = spark.createDataFrame(pages + pages[:5], PAGE)
    got = {(r.run_id, r.crawl_seq, r.line_no) for r in boilerplate(df, spark.createDataFrame(runs, RUN)).collect()}
    want = {(*k, n) for k, v in truth.items() for n in v}
    assert len(got & want) / len(want) > 0.97
    assert len(got & want) / len(got) > 0.97


def test_pages_without_main_heading_nulls_and_late_rows(spark):
    rows = [
        ("r", 0, T, "https://s.example/", "Menu\n\nFooter", [], "Gone", "T", "Menu", "", ""),
        ("r", 1, T, None, None, None, None, None, "Text", "", ""),
        ("r", 2, T, "https://s.example/2", "", None, "", None, None, "", ""),
        ("r", 3, T, "https://s.example/3", "Old", None, "Old", None, None, "", ""),
        ("r", 3, T + dt.timedelta(1), "https://s.example/3", "Head\nThis is the only sentence of the page.", ["Head"], "Head", "Head", "This is the only sentence of the page.", "", ""),
        (None, None, None, None, None, None, None, None, None, None, None),
    ]
    df, runs = spark.createDataFrame(rows, PAGE), spark.createDataFrame([], RUN)
    got = {(r.run_id, r.crawl_seq, r.line_no) for r in boilerplate(df, runs).collect()}
    assert got == {("r", 0, 0), ("r", 0, 2), ("r", 0, -1), ("r", 1, -1)}
    text = {r.crawl_seq: r.main_text for r in main_content(df, runs).collect()}
    assert text[0] == "" and text[1] == "" and text[3] == "Head\nThis is the only sentence of the page."
    assert boilerplate(df.limit(0), runs).count() == 0


def test_long_page(spark):
    body = "Head\n" + "\n".join(f"This is line number {i} of a page that is very long indeed." for i in range(20_000))
    df = spark.createDataFrame([("r", 0, T, "https://s.example/", body, ["Head"], "Head", "Head", None, "", "")], PAGE)
    assert boilerplate(df, spark.createDataFrame([], RUN)).count() == 0


def test_shapes_and_sentences():
    assert shape("  – Fadebebu har flyttet til Dibonlund !") == "C har flyttet til C"
    assert shape("IN CAPITALS") == ""
    assert is_sentence("We hear from you within two days.") and not is_sentence("Sign up for our newsletter !")


def test_shapes_below_the_share_of_pages_count(spark, monkeypatch):
    rnd = random.Random(5)
    pages = [p for s in range(6) for p in site(s, rnd)[0]]
    df, runs = spark.createDataFrame(pages, PAGE), spark.createDataFrame([(f"r{s}", f"https://s{s}.example/", T) for s in range(6)], RUN)
    lines = lambda: {(r.run_id, r.crawl_seq, r.line_no) for r in boilerplate(df, runs).collect()}
    want = lines()
    monkeypatch.setattr(module, "SHAPE_SHARE", 2.0)  # as in a corpus so large that no shape is on its share of the pages
    assert lines() == want


def test_frame_of_a_small_site_only(spark):
    frame = "By going on you let zebrafirm keep what it has to remember."
    rows = []
    for i in range(4):
        own = [f"We look after {WORDS[4 * i + j]} number {i}{j} in the {WORDS[j]} all year." for j in range(2)]
        rows.append(("r", i, T, f"https://s.example/{i}", "\n".join([f"Head {i} a", own[0], frame, own[1]]), [f"Head {i} a"], f"Head {i} a", f"Title {i}", None, "", ""))
    got = {(r.crawl_seq, r.line_no) for r in boilerplate(spark.createDataFrame(rows, PAGE), spark.createDataFrame([("r", "https://s.example/", T)], RUN)).collect()}
    assert got == {(i, 2) for i in range(4)}


def test_long_notices_in_the_body(spark):
    notice = "We keep small text files so that the pages work, and by reading on here you let us and our partners remember " + "what you look at, how long you stay, where you came from and which of the offers you liked, " * 2 + "until you say no."
    assert len(notice) > 200
    rows, runs = [], []
    for s in range(2):
        for i in range(6):
            own = [f"We look after {WORDS[i]} number {s}{i}{j} in the {WORDS[j]} all year, " + f"and {WORDS[i + j]} in every season of it, " * 6 + "as people know." for j in range(2)]
            rows.append((f"r{s}", i, T, f"https://s{s}.example/{i}", "\n".join([f"Head {i} a", own[0], notice, own[1]]), [f"Head {i} a"], f"Head {i} a", f"Title {i}", None, "", ""))
        runs.append((f"r{s}", f"https://s{s}.example/", T))
    got = {(r.run_id, r.crawl_seq, r.line_no) for r in boilerplate(spark.createDataFrame(rows, PAGE), spark.createDataFrame(runs, RUN)).collect()}
    assert got == {(f"r{s}", i, 2) for s in range(2) for i in range(6)}
