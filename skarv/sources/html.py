"""HTML documents into page rows: one pass of the standard parser, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarv.functions.jsonio import as_list, parse
from skarv.functions.unicode import tokens_of
from skarv.functions.urls import normalize_url

_SKIP = {"script", "style", "noscript", "template"}
_BLOCKS = {"p", "div", "ul", "ol", "li", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "main", "nav", "blockquote", "form", "dl", "pre", "hr"}


_SHORTCODE = re.compile(r"\[[^\]]*\]|\{\{[^}]*\}\}")


def _fold(text: str) -> str:
    return " ".join(text.split())


def _plain(text: str) -> str:
    """Without shortcodes, white space folded."""
    return _fold(_SHORTCODE.sub(" ", text)) if "[" in text or "{{" in text else _fold(text)


def _stamp(text: str | None) -> str | None:
    """A date or time as ISO in UTC, None where it is none. Without a zone it counts as UTC."""
    try:
        t = datetime.fromisoformat((text or "").strip())
    except ValueError:
        return None
    t = t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)
    return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03}Z"


def probe(items: list[dict], *paths: str) -> str | None:
    """The first text that isn't blank at one of the dotted paths, item by item."""
    for item in items:
        for path in paths:
            at: object = item
            for part in path.split("."):
                at = at.get(part) if isinstance(at, dict) else None
            if isinstance(at, str) and at.strip():
                return at.strip()
    return None


def _visible(items: list[dict], text: str) -> bool:
    """Whether a name, headline or description of the items (ten characters at least, the first 80 of them) is in the text, or none has any."""
    said = [v.lower().strip() for x in items for k in ("name", "headline", "description") if isinstance(v := x.get(k), str)]
    text = text.lower()
    return not said or any(len(v) > 10 and v[:80] in text for v in said)


class _Reader(HTMLParser):
    """Collects what a page row needs. An open paragraph ends at the next block tag; unknown and unclosed tags are harmless."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url = url
        self.title = self.h1 = None
        self.description = self.author = self.publisher = self.canonical = self.published = self.modified = None
        self.headings: list[str] = []
        self.paragraphs: list[str] = []
        self.links: list[str] = []
        self.anchors: list[list[str]] = []
        self.by_line: list[str] | None = None
        self.times: list[str] = []
        self.captions = False
        self.robots: list[str] = []
        self.json_ld: list[str] = []
        self.counts = dict.fromkeys(("list", "table", "script", "image", "no_alt", "faq", "definition"), 0)
        self.body: list[str] = []
        self.open: dict[str, list[str]] = {}
        self.skip = 0
        self.ld = False
        self.no_snippet_data = False

    def _close(self, tag: str) -> None:
        text = self.open.pop(tag, None)
        if text is None or tag == "a":
            return
        text = _plain("".join(text)) if tag == "p" else _fold("".join(text))
        if tag == "title" and self.title is None:
            self.title = text
        elif tag == "p" and text:
            self.paragraphs.append(text)
            self.counts["definition"] += ":" in text
        elif tag == "li":
            self.counts["definition"] += ":" in text
        elif tag in ("h1", "h2", "h3"):
            if tag == "h1" and self.h1 is None:
                self.h1 = text
            if text and text not in self.headings:
                self.headings.append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        self.no_snippet_data |= "data-nosnippet" in a
        if tag in _BLOCKS and "p" in self.open:
            self._close("p")
        if tag in ("title", "p", "li", "h1", "h2", "h3"):
            self._close(tag)
            self.open[tag] = []
        if tag in _BLOCKS or tag == "br":
            self.body.append(" ")
        if tag in _SKIP:
            self.skip += 1
            if tag == "script":
                self.counts["script"] += 1
                self.ld = a.get("type", "").lower() == "application/ld+json"
                if self.ld:
                    self.json_ld.append("")
        elif tag in ("ul", "ol"):
            self.counts["list"] += 1
        elif tag == "dl":
            self.counts["definition"] += 1
        elif tag == "table":
            self.counts["table"] += 1
        elif tag == "img":
            self.counts["image"] += 1
            self.counts["no_alt"] += not a.get("alt", "").strip()
        elif tag == "a" and "href" in a:
            self.links.append(a["href"].strip())
            self.anchors.append([a["href"]])
            self.open["a"] = self.anchors[-1]
        elif tag == "track":
            self.captions |= a.get("kind") in ("captions", "subtitles")
        elif tag == "time" and "datetime" in a:
            self.times.append(a["datetime"])
        elif tag == "link" and a.get("rel", "").lower() == "canonical" and self.canonical is None:
            self.canonical = a.get("href")
        elif tag == "meta":
            name, content = (a.get("name") or a.get("property") or "").lower(), a.get("content", "")
            if name == "description" and self.description is None:
                self.description = content.strip()
            elif name in ("robots", "googlebot", "bingbot"):
                self.robots += [x.strip().lower() for x in content.split(",") if x.strip()]
            elif name == "author" and self.author is None:
                self.author = content.strip()
            elif name == "og:site_name" and self.publisher is None:
                self.publisher = content.strip()
            elif name == "article:published_time" and self.published is None:
                self.published = content.strip() or None
            elif name == "article:modified_time" and self.modified is None:
                self.modified = content.strip() or None
        if a.get("rel") == "author" and self.by_line is None:
            self.by_line = self.open["author"] = []
            self.author_tag = tag
        if "faqpage" in a.get("itemtype", "").lower() or a.get("itemtype", "").lower().endswith("/question"):
            self.counts["faq"] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
            self.ld = False
        elif tag in self.open:
            self._close(tag)
        if "author" in self.open and tag == self.author_tag:
            del self.open["author"]
        if tag in _BLOCKS:
            self.body.append(" ")

    def handle_data(self, data: str) -> None:
        if self.ld and self.skip:
            self.json_ld[-1] += data
        elif not self.skip:
            for text in self.open.values():
                text.append(data)
            if "title" not in self.open:
                self.body.append(data)

    def row(self, header: str | None = None) -> dict:
        self.open.pop("author", None)
        for tag in list(self.open):
            self._close(tag)
        body = _plain("".join(self.body))
        directives = [*self.robots, *(x.strip().lower() for x in (header or "").split(",") if x.strip())]
        items = [x for t in self.json_ld for x in as_list(parse(t)) if isinstance(x, dict)]
        types = list(dict.fromkeys(str(t) for x in items for t in as_list(x.get("@type"))))
        host = (urlsplit(self.url).hostname or "").lower()
        inner, outer = [], []
        for href in self.links:
            if not href or href.startswith(("#", "mailto:", "tel:")):
                continue
            try:
                full = urljoin(self.url, href)
                to = (urlsplit(full).hostname or "").lower()
            except ValueError:
                continue
            (inner if to == host else outer).append(normalize_url(full))
        said = ["".join(x).lower() for x in self.anchors]
        faq = max(self.counts["faq"], int("FAQPage" in types))
        opening = self.paragraphs[0] if self.paragraphs else ""
        first, last = (self.times[0], self.times[-1]) if self.times else (None, None)
        author = self.author if self.author is not None else _fold("".join(self.by_line)) if self.by_line is not None else probe(items, "author.name", "author")
        publisher = self.publisher if self.publisher is not None else probe(items, "publisher.name", "publisher")
        snippet = next((d.split(":", 1)[1] for d in directives if d.startswith("max-snippet") and ":" in d), None)
        return {
            "url": self.url, "title": self.title or "", "meta_description": self.description or "", "h1": self.h1 or "", "headings": self.headings, "first_paragraph": self.paragraphs[0] if self.paragraphs else "",
            "paragraph_count": len(self.paragraphs), "body_text": body, "word_count": len(tokens_of(body)), "list_count": self.counts["list"], "table_count": self.counts["table"], "script_count": self.counts["script"],
            "faq_count": faq, "definition_like_blocks": self.counts["definition"], "image_count": self.counts["image"], "images_without_alt": self.counts["no_alt"],
            "canonical_url": urljoin(self.url, self.canonical) if self.canonical else None, "robots_meta": self.robots, "noindex": any("noindex" in d for d in directives), "no_snippet": any("nosnippet" in d for d in directives),
            "max_snippet": int(snippet) if snippet and snippet.strip().lstrip("-").isdigit() else None, "data_no_snippet": self.no_snippet_data, "internal_links": list(dict.fromkeys(inner)), "external_links": list(dict.fromkeys(outer)),
            "schema_types": types, "schema_items": len(items), "schema_raw": json.dumps(items, ensure_ascii=False), "schema_visible": _visible(items, f"{self.title or ''} {self.h1 or ''} {body}"), "author": author or None, "publisher": publisher or None,
            "date_published": _stamp(self.published) or _stamp(first) or _stamp(probe(items, "datePublished")), "date_modified": _stamp(self.modified) or _stamp(last) or _stamp(probe(items, "dateModified")),
            "has_transcript_signals": self.captions or "transcript" in body.lower() or "utskrift" in body.lower(), "has_about_link": any("about" in x or "om" in x for x in said), "has_contact_link": any("contact" in x or "kontakt" in x for x in said),
            "concise_opening": 60 <= len(opening) <= 350, "has_faq": faq > 0, "has_table": self.counts["table"] > 0, "has_list": self.counts["list"] > 0, "raw_text_length": len(body), "text_preview": body[:300],
        }


_INTS = ("paragraph_count", "word_count", "list_count", "table_count", "script_count", "faq_count", "definition_like_blocks", "image_count", "images_without_alt", "max_snippet", "schema_items", "raw_text_length")
_BOOLS = ("noindex", "no_snippet", "data_no_snippet", "schema_visible", "has_transcript_signals", "has_about_link", "has_contact_link", "concise_opening", "has_faq", "has_table", "has_list")
_LISTS = ("headings", "robots_meta", "internal_links", "external_links", "schema_types")


def read_html(url: str, html: str, header: str | None = None) -> dict:
    """One page row from its HTML and its robots header. Broken markup never fails."""
    reader = _Reader(url)
    reader.feed(html)
    reader.close()
    return reader.row(header)


_NAMES = list(read_html("https://a.example/", ""))
DDL = ", ".join(f"{n} " + ("int" if n in _INTS else "boolean" if n in _BOOLS else "array<string>" if n in _LISTS else "string") for n in _NAMES)


def html_pages(df: DataFrame, key: str, url: str = "url", html: str = "html", header: str | None = None, blocked: str | None = None) -> DataFrame:
    """key and the page row of every document; null HTML counts as empty, a null URL as https://unknown.invalid/.

    header: a column with the robots header, whose directives join those of the page. blocked: a column that says that robots rules keep
    the page from being read; its row is that of an empty document, whatever its HTML.

    raw_html_bytes is the UTF-8 length. A map over rows; nothing is shuffled.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    if blocked:
        text = F.when(F.coalesce(F.col(blocked), F.lit(False)), "").otherwise(text)
    src = df.select(F.col(key).alias(key), F.coalesce(F.col(url), F.lit("https://unknown.invalid/")).alias("_u"), text.alias("_h"), F.octet_length(text).alias("raw_html_bytes"), (F.col(header) if header else F.lit(None)).cast("string").alias("_r"))
    types = [pa.int32() if n in _INTS else pa.bool_() if n in _BOOLS else pa.list_(pa.string()) if n in _LISTS else pa.string() for n in _NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read_html(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("_u", "_h", "_r")), strict=True)]
            arrays = [pa.array([r[n] for r in rows], t) for n, t in zip(_NAMES, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("raw_html_bytes"), *arrays], [key, "raw_html_bytes", *_NAMES])

    return src.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, raw_html_bytes int, {DDL}")
