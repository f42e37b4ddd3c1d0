"""Page boilerplate, found with a site style tree over the lines of crawled pages.

The DOMs of a site are merged into one tree. Pages come as lines, so the tree has four levels: site, region (before the
main heading, after it), presentation (a line's shape: capitalised words, numbers and marks masked) and content (its letters).

* Content nodes: a line that stands on n of a site's m pages is spread over them with entropy log_m(n); its importance is
  1 - log_m(n). A site is the normalised target of the pages' runs: all runs of a target are merged, and a directory host with
  many sites has one tree for each, so no tree is larger than its site.
* Presentation nodes: over the whole corpus, how important the contents under a shape are on average, and how often nothing of
  the main body follows it (its end weight).

A branch is dropped where its importance is low: everything before the main heading, everything on pages without one, unimportant
contents under shapes that are unimportant as a whole, shapes that only end pages, and links to other pages of
the site (their titles, alone or after a few words).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarv.functions.arrow import slices
from skarv.functions.urls import url_col
from skarv.llm.pages import counting_pages, page_url
from skarv.runtime import cut
from skarv.sources.tables import latest

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LEAD = re.compile(r"^[\W_]+")
_QUOTES = "\"'”»’)"
_STOPS = frozenset(".!?…")
_FACT = re.compile(r"^[^:.!?]{3,60}: [^:,.!?|]{1,40}$")
#: Shapes on this share of pages go to every worker, at most twice 3334 times a page's lines; the others are joined from a table.
SHAPE_SHARE = 0.0003
#: A shape has a node if it stands on so many pages, whatever the size of the corpus.
EVIDENCE = 5
#: Pages that are Python objects at a time in a worker.
ROWS = 500
#: Longer lines are paragraphs and not kept in the caches.
LONG = 200
#: A content node is unimportant up to this importance (a fifth of a site's 20 pages).
LOW = 0.55
#: A shape is unimportant if its contents' mean importance is under this.
SHAPE_LOW = 0.5
#: A shape ends pages if nothing of the main body follows it in this share of cases.
END = 0.85


def letters_hash(text: str | None) -> int:
    """Signed 64-bit hash of the letters of a text, lower-cased; 0 if it has none."""
    return 0 if not text else _short_hash(text) if len(text) <= LONG else _hash(text)


def _hash(text: str) -> int:
    letters = _NOT_LETTERS.sub("", text.lower())
    if not letters:
        return 0
    h = xxhash.xxh64_intdigest(letters)
    return h - (1 << 64) if h >> 63 else h


#: Short lines come again on the pages of a site.
_short_hash = lru_cache(1 << 14)(_hash)


def plain(line: str) -> str:
    """Without marks in front and decoration behind."""
    text = line.strip()
    if text.endswith(" !"):
        text = text.rstrip("! ")
    return text if text[:1].isalnum() else _LEAD.sub("", text)


_SHAPE = re.compile(r"[^\W\d_]+|\d+|[:,|?()%@/·•–»]")


def shape(line: str) -> str:
    """Capitalised words as C (runs as one), numbers as #, other words as they are; lines in capitals have none."""
    text = plain(line)
    if text.isupper() and len(text) > 3:
        return ""
    out: list[str] = []
    last = ""
    for w in _SHAPE.findall(text):
        if w.isdigit():
            w = "#"
        elif w[0].isupper():
            w = "C"
        if w != last or w not in "C#":
            out.append(w)
            last = w
    return " ".join(out)


def branch(shape: str) -> str:
    """The node above a shape: its first four words and marks."""
    return "^" + " ".join(shape.split(" ")[:4])


def is_sentence(line: str) -> bool:
    """Ends as a sentence and has the length of one."""
    text = line.strip()
    if text.endswith(" !"):
        text = text.rstrip("! ")
    return text.rstrip(_QUOTES)[-1:] in _STOPS and text.count(" ") >= 4


@lru_cache(1 << 14)
def _link_probes(line: str) -> tuple[int, ...]:
    """Hashes of what a short line says from a capital after its first one to five words: perhaps another page's title."""
    text = plain(line)
    words = text.split()
    return tuple(h for k in range(1, min(6, len(words) - 1)) if (words[k][0].isupper() or not words[k][0].isalnum()) and (h := letters_hash(" ".join(words[k:]))))


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of each page's lines, and those to ask the tree for: all lines after the main heading."""
    for batch in slices(batches, ROWS):
        col = {n: batch.column(n).to_pylist() for n in ("body_text", "headings", "h1", "title", "first_paragraph")}
        hs, ask, probes, heads, h1, title, fp = [], [], [], [], [], [], []
        for body, hd, one, tt, first in zip(*col.values(), strict=True):
            lines = body.split("\n") if body is not None else []
            hs.append([letters_hash(x) for x in lines])
            h1.append(letters_hash(one))
            heads.append([letters_hash(x) for x in hd or []])
            title.append(letters_hash(tt))
            fp.append(letters_hash(first))
            start = hs[-1].index(h1[-1]) if h1[-1] and h1[-1] in hs[-1] else len(lines)
            after = range(start + 1, len(lines))
            ask.append(sorted({h for i in after if (h := hs[-1][i])}))
            probes.append(sorted({p for i in after if lines[i].strip() and not is_sentence(lines[i]) for p in _link_probes(lines[i])} - set(ask[-1])))
        ints = pa.list_(pa.int64())
        made = [pa.array(hs, ints), pa.array(ask, ints), pa.array(probes, ints), pa.array(heads, ints), pa.array(h1, pa.int64()), pa.array(title, pa.int64()), pa.array(fp, pa.int64())]
        keep = ["run_id", "crawl_seq", "ingested_at", "url", "body_text", "first_paragraph"]
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + made, [*keep, "hs", "ask", "probes", "heads", "h1", "title", "fp"])


def _tree(pages: DataFrame) -> DataFrame:
    """site, h, imp, link: the content nodes that matter – on three pages or more, or titles of pages."""
    lines = pages.select("site", "url", F.explode("ask").alias("h"), F.lit(1).alias("l"), F.lit(0).alias("t"))
    titles = pages.select("site", "url", F.col("title").alias("h"), F.lit(0).alias("l"), F.lit(1).alias("t")).filter(F.col("h") != 0)
    once = lines.unionByName(titles).groupBy("site", "h", "url").agg(F.max("l").alias("l"), F.max("t").alias("t"))
    counts = once.groupBy("site", "h").agg(F.sum("l").alias("n"), F.max("t").alias("t"))
    sizes = pages.groupBy("site", "url").agg(F.lit(1).alias("one")).groupBy("site").agg(F.count("*").alias("m"))
    kept = counts.filter((F.col("n") >= 3) | (F.col("t") > 0))
    importance = F.when((F.col("n") >= 3) & (F.col("m") > 1), 1 - F.log("n") / F.log("m")).otherwise(1.0)
    return kept.join(sizes, "site").select("site", "h", importance.cast("float").alias("imp"), (F.col("t") > 0).alias("link"))


def _with_nodes(pages: DataFrame) -> DataFrame:
    """pages with nodes: the content nodes of its own lines and probes, as h, imp, link."""
    keys = ["page", "crawl_seq"]
    asked = pages.select(*keys, "site", F.explode(F.concat("ask", "probes")).alias("h"))
    # the tree is nearly as large as what is asked, so it isn't salted: AQE splits the lines of a hot site, as the pages are grouped anew
    hit = asked.join(_tree(pages), ["site", "h"])
    per_page = hit.groupBy(*keys).agg(F.collect_list(F.struct("h", "imp", "link")).alias("nodes"))
    return pages.join(per_page, keys, "left").drop("ask", "probes", "url", "site", "page")


class _Page:
    """One page's lines with what the tree says of them."""

    def __init__(self, body: str | None, hs: list[int], heads: list[int], h1: int, title: int, node: dict[int, tuple[float, bool]]):
        self.lines = body.split("\n") if body is not None else []
        self.hs, self.h1 = hs or [], h1
        self.node = node
        self.links = {h for h, x in node.items() if x[1]}
        self.start = next((i for i, h in enumerate(self.hs) if h and h == h1), None)
        self.own_title = title
        self.heads = {h for h in heads or [] if h and node.get(h, (1.0,))[0] > 0.35}
        self.times = Counter(self.hs)
        self.rows = [i for i, x in enumerate(self.lines) if x.strip()]

    def importance(self, i: int) -> float:
        return self.node.get(self.hs[i], (1.0, False))[0]

    def is_anchor(self, i: int) -> bool:
        """Surely of the main body: an own heading or a sentence that the site doesn't repeat."""
        return self.hs[i] in self.heads or is_sentence(self.lines[i]) and self.importance(i) > LOW

    def is_link(self, i: int) -> bool:
        """A title of a page of this site, alone or after a few words."""
        h = self.hs[i]
        if h in self.heads or h == self.h1 or is_sentence(self.lines[i]):
            return False
        return h in self.links or bool(self.links) and not self.links.isdisjoint(_link_probes(self.lines[i]))


def _lists(column: pa.Array, names: tuple[str, ...]) -> list[list]:
    """Where each row's structs begin and end, then their fields, all rows one after the other."""
    flat = column.flatten()
    ends = [0, *pa.compute.cumulative_sum(pa.compute.fill_null(column.value_lengths(), 0)).to_pylist()]
    return [ends, *(flat.field(n).to_pylist() for n in names)]


def _pages(batch: pa.RecordBatch) -> Iterator[_Page]:
    ends, h, imp, link = _lists(batch.column("nodes"), ("h", "imp", "link"))
    names = ("body_text", "hs", "heads", "h1", "title")
    for i, values in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
        a, b = ends[i], ends[i + 1]
        yield _Page(*values, dict(zip(h[a:b], zip(imp[a:b], link[a:b]))))


#: What is known of a line by itself, as bits: see _facts.
SENTENCE, OWN, LINK, FACT, LATE, FIRST, NEW_SHAPE, NEW_BRANCH = (1 << i for i in range(8))


def _name_hash(name: str) -> int:
    h = xxhash.xxh64_intdigest(name)
    return h - (1 << 64) if h >> 63 else h


#: The shape of lines in capitals.
CAPITALS = _name_hash("")


def _long_forms(line: str) -> tuple[int, int]:
    """Hashes of a line's shape and of the branch above it, 0 if there is none."""
    form = shape(line)
    return _name_hash(form), _name_hash(branch(form)) if form else 0


_forms = lru_cache(1 << 14)(_long_forms)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What judging a page takes besides the shapes: no texts, one small record for each line after the main heading.

    noise: lines that are none of the main body whatever their shape; first: lines that are the first paragraph, text: it isn't
    blank, found: the page has its main heading; lines: number, shape, branch, importance and bits.
    """
    for batch in slices(batches, ROWS):
        noise, where, text, has, offsets = [], [], [], [], [0]
        cols: list[list] = [[], [], [], [], []]
        fps, texts = batch.column("fp").to_pylist(), batch.column("first_paragraph").to_pylist()
        for page, fp, first in zip(_pages(batch), fps, texts, strict=True):
            text.append(bool(first and first.strip()))
            has.append(page.start is not None)
            where.append([i for i in page.rows if page.hs[i] == fp] if text[-1] else [])
            noise.append(page.rows if page.start is None else [i for i in page.rows if i < page.start])
            after = [] if page.start is None else [i for i in page.rows if i > page.start]
            last = max((i for i in after if page.is_anchor(i)), default=page.start)
            here = set()
            for k, i in enumerate(after):
                line, imp = page.lines[i], page.importance(i)
                bits = LATE * (i > last) | FIRST * (k == 0)
                if is_sentence(line):
                    bits |= SENTENCE
                # rows of a table are the page's own, as frames don't repeat within a page
                bits |= OWN * (page.hs[i] in page.heads or (page.times[page.hs[i]] >= 3 and imp > LOW))
                bits |= LINK * page.is_link(i) | FACT * bool(_FACT.match(plain(line)))
                f, b = _forms(line) if len(line) <= LONG else _long_forms(line)
                bits |= NEW_SHAPE * (f not in here) | NEW_BRANCH * (b not in here)
                here |= {f, b}
                for c, x in zip(cols, (i, f, b, imp, bits)):
                    c.append(x)
            offsets.append(len(cols[0]))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float32(), pa.int32())
        lines = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["i", "f", "b", "imp", "bits"])
        made = [pa.array(noise, pa.list_(pa.int32())), pa.array(where, pa.list_(pa.int32())), pa.array(text, pa.bool_()), pa.array(has, pa.bool_()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines)]
        yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("crawl_seq"), *made], ["run_id", "crawl_seq", "noise", "first", "text", "found", "lines"])


def _shape_table(facts: DataFrame) -> DataFrame:
    """f, mean, ends, pages of the shapes and branches on EVIDENCE pages or more: mean importance and end weight."""
    each = facts.select(F.inline("lines"))
    has = lambda bit: (F.col("bits").bitwiseAND(F.lit(bit)) != 0).cast("int")
    both = F.array(F.struct(F.col("f"), has(NEW_SHAPE).alias("new")), F.struct(F.col("b").alias("f"), has(NEW_BRANCH).alias("new")))
    rows = each.select("imp", has(LATE).alias("late"), F.inline(both)).filter("f <> 0")
    sums = rows.groupBy("f").agg(F.avg(F.col("imp").cast("double")).alias("mean"), F.avg("late").alias("ends"), F.sum("new").alias("pages"))
    return sums.filter(F.col("pages") >= EVIDENCE)


def _rare_shapes(facts: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """page, crawl_seq, rare: of each page the shapes under `least` pages that its judgement may turn on, as f, mean, ends.

    Those are of lines that the site repeats, that nothing of the main body follows or that are in capitals. Commoner shapes
    don't take part, so no key of the join has more than its share of the pages.
    """
    lines = facts.select(F.xxhash64("run_id", "crawl_seq").alias("page"), "crawl_seq", F.inline("lines"))
    open_ = lines.filter((F.col("imp") <= LOW) | (F.col("bits").bitwiseAND(F.lit(LATE)) != 0) | (F.col("f") == CAPITALS))
    asked = open_.select("page", "crawl_seq", F.explode(F.array("f", "b")).alias("f")).filter("f <> 0").distinct()
    hit = asked.join(table.filter(F.col("pages") < least).select("f", "mean", "ends"), "f")
    return hit.groupBy("page", "crawl_seq").agg(F.collect_list(F.struct("f", "mean", "ends")).alias("rare"))


def noise_lines(lines: list[tuple[int, int, int, float, int]], shapes: dict[int, tuple[float, float]], rare: dict[int, tuple[float, float]]) -> list[int]:
    """Numbers of the lines after the main heading that aren't main content. shapes, rare: mean importance and end weight.

    A line whose shape and branch are too rare to have either is judged by its own importance in its site.
    """
    noise: list[int] = []
    tail = False
    for i, f, b, imp, bits in lines:
        sentence, late, link = bits & SENTENCE, bits & LATE, bits & LINK
        own = shapes.get(f) or rare.get(f)
        mean, ends = own or shapes.get(b) or rare.get(b) or (imp, 0.0)
        if bits & OWN:
            tail = False
            continue
        if bits & FIRST and not sentence and not link:
            bad = True  # between the main heading and its first paragraph: who wrote it, and when
        elif link:
            bad = True
        elif bits & FACT and ends < END:
            bad = False  # a fact on all pages of a site is still one of the page's own rows
        elif ends >= END and late:
            bad = True
        elif mean < SHAPE_LOW and (imp <= LOW or f == CAPITALS):  # capitals are a shape by themselves
            bad = True
        elif imp <= LOW and late and ends > 0.6:
            bad = True
        elif tail and late and not sentence:
            # after the end has begun only shapes that live in main bodies count
            bad = not (own and mean > 0.6 and ends < 0.6)
        else:
            bad = False
        if bad:
            noise.append(i)
            tail = tail or bool(late)
    return noise


def boilerplate(page_snapshots: DataFrame, audit_runs: DataFrame) -> DataFrame:
    """run_id, crawl_seq, line_no of what isn't main content; line_no -1 stands for first_paragraph.

    Lines of body_text are split at newlines and counted from 0, blank ones too; blank lines are never given. Pages without
    their main heading (h1) in the text have no main content. first_paragraph is not main if it is such a line, or if the page
    has no main content; null or blank ones give no row. Null body gives only first_paragraph's row. Pages delivered twice count
    once; a page whose run is unknown has its run as site; an empty table gives no rows.
    Runs jobs: pages with line hashes are written once, then small records of their lines and the
    shapes on EVIDENCE pages or more; common shapes are gathered by the driver (at most 1/SHAPE_SHARE times the mean number of
    lines), all others joined to the pages that need them.
    """
    found, _ = _analysed(page_snapshots, audit_runs)
    return found


def _analysed(page_snapshots: DataFrame, audit_runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    kind = page_snapshots.schema["ingested_at"].dataType.simpleString()
    seq = page_snapshots.schema["crawl_seq"].dataType.simpleString()
    src = page_snapshots.select("run_id", "crawl_seq", "ingested_at", F.xxhash64(page_url()).alias("url"), "body_text", "headings", "h1", "title", "first_paragraph")
    made = "hs array<bigint>, ask array<bigint>, probes array<bigint>, heads array<bigint>, h1 bigint, title bigint, fp bigint"
    hashed = src.mapInArrow(_prepare, f"run_id string, crawl_seq {seq}, ingested_at {kind}, url bigint, body_text string, first_paragraph string, {made}")
    names = ["url", "body_text", "first_paragraph", "hs", "ask", "probes", "heads", "h1", "title", "fp"]
    sites = latest(audit_runs.filter(F.col("id").isNotNull()), [F.col("id").alias("run_id")], ["target_url"])
    sites = sites.select("run_id", F.xxhash64(url_col(F.col("target_url"))).alias("site"))
    counted = counting_pages(hashed, {n: F.col(n) for n in names}).join(sites, "run_id", "left")
    site = F.coalesce("site", F.xxhash64("run_id"))
    pages = cut(counted.withColumns({"site": site, "page": F.xxhash64("run_id", "crawl_seq")}), "boilerplate-pages")
    kinds = f"run_id string, crawl_seq {seq}, noise array<int>, first array<int>, text boolean, found boolean, lines array<struct<i:int,f:bigint,b:bigint,imp:float,bits:int>>"
    facts = cut(_with_nodes(pages).mapInArrow(_facts, kinds), "boilerplate-facts")
    table = cut(_shape_table(facts), "boilerplate-shapes")
    least = max(EVIDENCE, SHAPE_SHARE * facts.count())
    shapes = {r["f"]: (r["mean"], r["ends"]) for r in table.filter(F.col("pages") >= least).collect()}
    keyed = facts.withColumn("page", F.xxhash64("run_id", "crawl_seq"))
    known = keyed.join(_rare_shapes(facts, table, least), ["page", "crawl_seq"], "left").drop("page")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            out = []
            ends, *flat = _lists(batch.column("lines"), ("i", "f", "b", "imp", "bits"))
            rare_ends, rare_f, *rare_flat = _lists(batch.column("rare"), ("f", "mean", "ends"))
            names = ("noise", "first", "text", "found")
            for k, (noise, first, text, found) in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
                a, b = ends[k], ends[k + 1]
                c, d = rare_ends[k], rare_ends[k + 1]
                rare = dict(zip(rare_f[c:d], zip(*(x[c:d] for x in rare_flat))))
                noise = noise + noise_lines(list(zip(*(x[a:b] for x in flat))), shapes, rare)
                if text and (not found or first and set(first) <= set(noise)):
                    noise = [-1, *noise]
                out.append(noise)
            yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("crawl_seq"), pa.array(out, pa.list_(pa.int32()))], ["run_id", "crawl_seq", "noise"])

    judged = known.mapInArrow(judge, f"run_id string, crawl_seq {seq}, noise array<int>")
    return judged.select("run_id", "crawl_seq", F.explode("noise").alias("line_no")), pages


def main_content(page_snapshots: DataFrame, audit_runs: DataFrame) -> DataFrame:
    """run_id, crawl_seq, main_text: the main lines of every page in order, blank lines left out; "" where there are none."""
    found, pages = _analysed(page_snapshots, audit_runs)
    noise = found.groupBy("run_id", "crawl_seq").agg(F.collect_set("line_no").alias("bad"))
    both = pages.select("run_id", "crawl_seq", "body_text").join(noise, ["run_id", "crawl_seq"], "left")
    kept = F.filter(F.split("body_text", "\n"), lambda x, i: ~F.array_contains(F.coalesce("bad", F.array().cast("array<int>")), i) & (F.trim(x) != ""))
    return both.select("run_id", "crawl_seq", F.coalesce(F.array_join(kept, "\n"), F.lit("")).alias("main_text"))
