"""Keywords and brands of pages: plain Python for Arrow workers, and columns made from it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarv.functions.unicode import tokens_of

#: Parts of a path that say nothing of a page's subject.
GENERIC_PARTS = ["index", "home", "page", "start", "om", "about", "kontakt", "contact", "privacy", "vilkar", "blogg", "blog"]
#: Ends of titles that say nothing.
GENERIC_TITLES = ["hjem", "home", "velkommen", "welcome", "start", "nyheter", "news"]
_TAIL = re.compile(r"\s+[|\-–:].*$", re.S)
_NORDIC = re.compile("[æøåÆØÅ]")


def head_of(text: str | None) -> str:
    """A heading without what follows a spaced separator."""
    return _TAIL.sub("", (text or "").strip()).strip()


def _joined(text: str) -> str:
    return " ".join(tokens_of(text))


def subject_of_path(path: str | None) -> str | None:
    """The last telling part of a path in words, first letter in upper case; None where no part tells anything."""
    parts = [p for p in (path or "").split("/") if len(p) > 3 and not p.isdigit() and not any(g in p for g in GENERIC_PARTS)]
    if not parts:
        return None
    words = re.sub(r"\.\w+$", "", re.sub(r"[-_]", " ", parts[-1]))
    return words[0].upper() + words[1:] if 3 < len(words) < 55 else None


def keyword_of(path: str | None, h1: str | None, title: str | None, shown: str | None = None) -> str:
    """What a page is about, as it would be searched for.

    The subject of its path, written as heading or title write it if they hold its words; else what follows a separator in the main
    heading (at most seven words); else what precedes one in the title; else heading or title without their tails; else `shown`.
    """
    h1, title = (h1 or "").strip(), (title or "").strip()
    subject = subject_of_path(path)
    if subject:
        wanted = _joined(subject)
        return next((c for c in map(head_of, filter(None, (h1, title))) if wanted in _joined(c)), subject)
    after = re.search(r"\s*[-–|]\s*(.{4,55})$", h1)
    if after and len(after[1].strip().split(" ")) <= 7:
        return after[1].strip()
    return head_of(h1 or title) or shown or ""


def visible_keyword(primary: str, others: list[str | None]) -> str:
    """The first of the others that is the same in words, or holds it and is written with æ, ø or å; else primary."""
    wanted = _joined(primary)
    for other in map(head_of, others):
        words = _joined(other)
        if words and words == wanted or other and _NORDIC.search(other) and wanted in words:
            return other
    return primary


def brand_tokens(brand: str | None, domain: str | None) -> list[str]:
    """Words longer than two characters of a brand and its domain, without a leading www, each once."""
    found = (t.removeprefix("www") for t in tokens_of(f"{brand or ''} {domain or ''}"))
    return list(dict.fromkeys(t for t in found if len(t) > 2))


def supporting_word(keyword: str, missing: list[str], matched: list[str]) -> str | None:
    """The first word, of the missing ones before the matched, that the keyword doesn't hold."""
    return next((w for w in [*missing, *matched] if w.lower() not in keyword.lower()), None)


def brand_of(publisher: str | None, author: str | None, h1: str | None, types: list[str] | None, host: str | None) -> str:
    """Publisher, else author, else what precedes a separator in the main heading of a page about an organisation or person, else the host's first label."""
    if publisher or author:
        return publisher or author
    before = re.match(r"(.{2,40}?)\s*[-–|]", (h1 or "").strip())
    if before and {"Organization", "LocalBusiness", "Person", "Corporation"} & set(types or ()):
        return before[1].strip()
    label = (host or "").removeprefix("www.").split(".")[0]
    return label[:1].upper() + label[1:]


@F.pandas_udf(T.StringType())
def keywords(path: pd.Series, h1: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([keyword_of(*x) for x in zip(path, h1, title)])


@F.pandas_udf(T.StringType())
def brands(publisher: pd.Series, author: pd.Series, h1: pd.Series, types: pd.Series, host: pd.Series) -> pd.Series:
    return pd.Series([brand_of(p, a, h, None if t is None else list(t), u) for p, a, h, t, u in zip(publisher, author, h1, types, host)])
