"""Keyword-stuffed, link-list and tag-list pages: phrases counted over hosts, joined with list density.

A text is cut into chunks, at line ends and at sentence ends. A chunk is dense if it is no sentence but a run of words with few
function words, a link or a tag line, or if it says the same words over and over. Phrase shingles (two neighbouring words, and each
content word) of dense chunks are exploded over all documents and counted over distinct hosts. A dense chunk counts as
stuffed if enough of its words lie in phrases that other hosts carry too or that its own page repeats. A page is found if more
than half of its words are stuffed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarv.functions.urls import host_col
from skarv.llm.words import folded
from skarv.runtime import cut

#: Function words of Norwegian, Swedish, Danish and English, as in usual stop-word filters for web text.
FUNCTION_WORDS = frozenset(
    """
    og i på til av er som med for å den det en et de vi har ikke kan skal fra men når hos der om eller seg sin sine vil bør ble
    blir var at så du dere deg oss nå før etter mellom under over alle noen mer enn hvor hva hvordan slik derfor også bare ved
    att är för inte vid ett från mest utan och eller men när hur vad
    the of and to in is that for on with as are was by at from it be this you we our or an a has have not but when which who their
    its they will can would so than yet if more all no out up only between there what how your
    """.split()
)
_WORD = re.compile(r"[^\W_]+")
_SPLIT = re.compile(r"(?<=[^\d\s][.!?…])\s+|\n+")
_SEPARATOR = re.compile(r"[,;|·•/>]|\s[–-]\s")
_END = re.compile(r"[.!?…][\"'”»’)\]]*\s*$")
_URL = re.compile(r"https?://|www\.|href=|<meta ", re.I)
_TAG = re.compile(r"(?:^|\s)#\w")
#: Fewest hosts of a phrase that counts as replicated.
HOSTS = 3
#: Share of a page's words that must be stuffed.
SHARE = 0.5


def _h(phrase: str) -> int:
    h = xxhash.xxh64_intdigest(phrase)
    return h - (1 << 64) if h >> 63 else h


class Chunk:
    """A stretch of text: its words, and whether it is dense."""

    __slots__ = ("words", "ends", "link", "span", "dense", "loose")

    def __init__(self, text: str):
        self.words = words = _WORD.findall(text)
        n = len(words)
        self.ends = bool(_END.search(text))
        self.link = "http" in text and bool(_URL.search(text)) or "www." in text or "<meta" in text or "#" in text and len(_TAG.findall(text)) >= 3
        self.span = self._repeated() if n >= 6 and n - len(set(words)) >= 2 else None
        self.dense, self.loose = self.link or self.span is not None, False
        if not self.dense and n:
            function = sum(w in FUNCTION_WORDS for w in words) / n
            self.dense = function < (0.05 if self.ends else 0.25)
            if self.dense and n > 12 and 4 * len(_SEPARATOR.findall(text)) < n:
                # a long run without items has to say words again and be made of replicated phrases nearly all the way
                self.loose = True
                self.dense = len(set(words)) <= 0.8 * n

    def _repeated(self) -> tuple[int, int] | None:
        """From the first to the last of content words that are said three times or more, if those are 30 % of the words in between."""
        often = {w for w, c in Counter(self.words).items() if c >= 3 and not w.isdigit() and w not in FUNCTION_WORDS and len(w) > 2}
        if not often:
            return None
        at = [i for i, w in enumerate(self.words) if w in often]
        first, last = at[0], at[-1] + 1
        return (first, last) if len(at) >= 0.3 * (last - first) else None

    def phrases(self) -> list[str]:
        """Pairs of neighbouring words that aren't both function words, and content words."""
        w = self.words
        pairs = [f"{a} {b}" for a, b in zip(w, w[1:]) if a not in FUNCTION_WORDS or b not in FUNCTION_WORDS]
        return pairs + [a for a in w if a not in FUNCTION_WORDS and not a.isdigit()]


def chunks(text: str) -> list[Chunk]:
    return [c for part in _SPLIT.split(folded(text)) if part and (c := Chunk(part)).words]


def _short_lines(parts: list[Chunk]) -> None:
    """Eight or more short lines that are no sentences and begin alike (read more on …) are a list, whatever words they have."""
    heads = Counter(" ".join(c.words[:2]) for c in parts if not c.ends and 2 <= len(c.words) <= 9)
    if sum(heads.values()) < 8:
        return
    for c in parts:
        if not c.ends and 2 <= len(c.words) <= 9 and heads[" ".join(c.words[:2])] >= 3:
            c.dense = True


def stuffed_share(parts: list[Chunk], replicated: set[int]) -> float:
    """Share of the words that lie in dense chunks made of replicated or repeated phrases. replicated: hashes of phrases."""
    total = sum(len(c.words) for c in parts)
    if not total:
        return 0.0
    own = Counter(p for c in parts if c.dense for p in c.phrases())
    stuffed = 0
    for c in parts:
        if not c.dense:
            continue
        n = len(c.words)
        known = [False] * n
        for i, w in enumerate(c.words):
            if w in FUNCTION_WORDS or w.isdigit():
                continue
            known[i] = own[w] >= 3 or _h(w) in replicated
        for i in range(n - 1):
            pair = f"{c.words[i]} {c.words[i + 1]}"
            if own.get(pair, 0) >= 3 or _h(pair) in replicated:
                known[i] = known[i + 1] = True
        if c.span is not None and c.ends:
            first, last = c.span
            stuffed += last - first
        elif c.link or sum(known) >= (0.6 if c.loose else 0.3) * n:
            stuffed += n
    return stuffed / total


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct phrases in dense chunks, and whether it may be found. Texts without dense chunks give no row."""
    for batch in batches:
        take, out, may, texts = [], [], [], []
        for i, text in enumerate(batch.column("t").to_pylist()):
            if not text:
                continue
            parts = chunks(text)
            _short_lines(parts)
            found = {_h(p) for c in parts if c.dense for p in c.phrases()}
            if not found:
                continue
            total = sum(len(c.words) for c in parts)
            dense = sum((c.span[1] - c.span[0]) if c.span and c.ends else len(c.words) for c in parts if c.dense)
            take.append(i)
            out.append(sorted(found))
            may.append(total >= 5 and dense > SHARE * total)
            texts.append(text if may[-1] else None)
        idx = pa.array(take, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("k").take(idx), batch.column("host").take(idx), pa.array(out, pa.list_(pa.int64())), pa.array(may, pa.bool_()), pa.array(texts, pa.string())], ["k", "host", "p", "may", "t"])


def stuffed_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", url: str = "url", source: str = "source", hosts: int = HOSTS, share: float = SHARE) -> DataFrame:
    """key, stuffed: pages of which more than `share` of the words are stuffed, with that share.

    The host is that of `url`, else `source`, else none (all such documents together count as one host). Null, empty and blank
    texts, and texts under five words, are never found; repeated keys count once, with the greatest share; other columns are
    ignored; an empty table gives no rows. Every document's phrases are counted; only pages that are dense by more than `share`
    of their words are looked at again. Writes the phrases and those pages' texts once.
    """
    kind = docs.schema[key].dataType.simpleString()
    host = F.coalesce(host_col(F.col(url)), F.lower(F.trim(F.col(source))), F.lit(""))
    src = docs.select(F.col(key).alias("k"), F.xxhash64(host).alias("host"), F.col(text).cast("string").alias("t")).filter(F.col("t").isNotNull())
    first = cut(src.mapInArrow(_first, f"k {kind}, host long, p array<bigint>, may boolean, t string"), "dense-phrases")
    each = first.select("host", F.explode("p").alias("p"))
    often = each.groupBy("p", "host").agg(F.lit(1).alias("one")).groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") >= hosts).select("p")
    maybe = first.filter("may")
    asked = maybe.select(F.xxhash64("t").alias("id"), F.explode("p").alias("p")).distinct()
    known = asked.join(often, "p").groupBy("id").agg(F.collect_list("p").alias("known"))
    pages = maybe.select("k", "t", F.xxhash64("t").alias("id")).join(known, "id", "left")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = []
            for t, known in zip(batch.column("t").to_pylist(), batch.column("known").to_pylist(), strict=True):
                parts = chunks(t)
                _short_lines(parts)
                shares.append(stuffed_share(parts, set(known or [])))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(shares, pa.float64())], ["k", "stuffed"])

    judged = pages.select("k", "t", "known").mapInArrow(judge, f"k {kind}, stuffed double")
    found = judged.filter(F.col("stuffed") > share)
    return found.groupBy(F.col("k").alias(key)).agg(F.max("stuffed").alias("stuffed"))
