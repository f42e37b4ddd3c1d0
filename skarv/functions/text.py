"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers understand it.
SPACE = r"[\s   -     　﻿]"
#: Word edges of ASCII words, the same in every engine.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def fold_space(c: Column) -> Column:
    """White-space runs as one space, none outside."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def strip_shortcodes(c: Column) -> Column:
    """Without [..] and {{..}}, white space folded."""
    return fold_space(F.regexp_replace(F.regexp_replace(c, r"\[[^\]]*\]", " "), r"\{\{[^}]*\}\}", " "))


def _last_space(c: Column) -> Column:
    """1-based position of the last space, 0 if there is none."""
    r = F.instr(F.reverse(c), " ")
    return F.when(r == 0, 0).otherwise(F.length(c) - r + 1)


def excerpt(c: Column, most: int = 220, least: int = 80) -> Column:
    """The text without shortcodes; if longer than `most`, cut at the last space (if one lies after `least`) and `...` added."""
    text = strip_shortcodes(c)
    head = F.substring(text, 1, most)
    at = _last_space(head) - 1
    cut = F.when(at > least, head.substr(F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.trim(cut), F.lit("...")))


def trim_to(c: Column, most: int, least: int = 20) -> Column:
    """White space folded; if longer than `most`, cut at the last space after `least`, else hard."""
    text = fold_space(c)
    head = F.substring(text, 1, most)
    at = _last_space(head) - 1
    return F.when(F.length(text) <= most, text).otherwise(F.trim(F.when(at > least, head.substr(F.lit(1), at)).otherwise(head)))


def first_upper(c: Column) -> Column:
    """First character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def clean_heading(c: Column) -> Column:
    """White space folded and everything from the first `|`, `:`, `–` or `-` cut off."""
    return F.trim(F.regexp_replace(fold_space(c), r"[|:–-].*$", ""))


def decode_entities(c: Column) -> Column:
    """The five XML entities, &amp; first."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def list_summary(items: Column, most: int = 3) -> Column:
    """The first `most` items joined by `, `, then ` +k` for the rest; "" for none."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(n <= most, head).otherwise(F.concat(head, F.lit(" +"), (n - most).cast("string")))


def list_sentence(items: Column, last: str = " og ", most: int = 3) -> Column:
    """The first `most` items as `a, b og c`; "" for none."""
    few = F.slice(items, 1, most)
    n = F.size(few)
    return F.when(n <= 1, F.array_join(few, "")).otherwise(F.concat(F.array_join(F.slice(few, F.lit(1), n - 1), ", "), F.lit(last), F.element_at(few, -1)))


def human_path(url: Column) -> Column:
    """Host alone for a root path, else host and path."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path.isin("", "/"), host).otherwise(F.concat(host, path))


def tolerant_path(url: Column) -> Column:
    """Path of a URL, with or without scheme; `/` if there is none."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def slug_words(path: Column) -> Column:
    """Words of a path, split at `-`, `_` and `/`, longer than two characters."""
    return F.filter(F.split(path, "[-_/]"), lambda w: F.length(w) > 2)


def ascii_tokens(c: Column) -> Column:
    """Lower-case words of letters, digits and inner hyphens longer than two characters; for text without combining marks."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s-]", " "), r"\s+"), lambda w: F.length(w) > 2)


def opening_sentences(c: Column, n: int = 2) -> Column:
    """The first `n` parts between `. `."""
    return F.array_join(F.slice(F.split(c, r"\.\s+"), 1, n), ". ")


def short_hash(c: Column) -> Column:
    """The first 12 hexadecimal digits of the SHA-1."""
    return F.substring(F.sha1(c), 1, 12)


def ascii_slug(c: Column) -> Column:
    """Lower case; only word characters, white space and hyphens kept; runs of white space, `_` and `-` as one `-`, none at the edges.

    For text that is already decomposed or plain; `slugs` in `functions.unicode` decomposes first.
    """
    text = F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"[\s_-]+", "-"), "^-+|-+$", "")


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def round1(c: Column) -> Column:
    """One decimal, half up; null, NaN and infinite as 0.

    What is within half of 1e-9 of a half counts as one, so that the order in which a mean was added up makes no difference.
    """
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(ok, F.round(F.round(c, 9), 1)).otherwise(0.0)


def percent(part: Column, total: Column) -> Column:
    """part of total in percent, 0 if total is 0."""
    return F.when(total == 0, 0.0).otherwise(part / total * 100)


def average(c: Column) -> Column:
    """Mean, 0 without rows."""
    return F.coalesce(F.avg(c), F.lit(0.0))
