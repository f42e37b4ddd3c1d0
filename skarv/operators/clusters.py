"""Topic clusters of a run's pages: TF-IDF vectors, then leaders in crawl order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarv.functions.text import clamp, round1
from skarv.functions.unicode import tokens
from skarv.operators.pages import KEYS, counting, flags, intent

#: Least cosine to a cluster's first page.
THRESHOLD = 0.18
_COLUMNS = ["content_type", "blocked_by_robots", "noindex", "status_code", "word_count", "title", "h1", "first_paragraph", "headings", "internal_links"]


def _eligible(page_snapshots: DataFrame, extra: list[str]) -> DataFrame:
    columns = list(dict.fromkeys([*_COLUMNS, *extra]))
    return counting(page_snapshots, columns).filter(flags()["cluster_eligible"])


def ascii_documents(page_snapshots: DataFrame) -> DataFrame:
    """run_id, crawl_seq, words: title and main heading, other than ASCII letters, digits and hyphens taken as spaces."""
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("h1", F.lit(""))))
    words = F.filter(F.split(F.regexp_replace(text, r"[^a-z0-9\s-]", " "), r"\s+"), lambda w: F.length(w) > 2)
    return _eligible(page_snapshots, []).select(*KEYS, words.alias("words"))


def documents(page_snapshots: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """run_id, crawl_seq, words, and other columns if asked for: title, main heading, first paragraph, headings and internal links, decomposed."""
    part = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat_ws(" ", part("title"), part("h1"), part("first_paragraph"), F.array_join(F.coalesce("headings", F.array().cast("array<string>")), " "), F.array_join(F.coalesce("internal_links", F.array().cast("array<string>")), " "))
    pages = _eligible(page_snapshots, ["path", "meta_description", "faq_count"] if extra else [])
    return pages.select(*KEYS, tokens(text).alias("words"), *[c.alias(n) for n, c in (extra or {}).items()])


def term_weights(docs: DataFrame) -> DataFrame:
    """run_id, crawl_seq, token, tf, df, weight: tf / words of the page * (ln((1+N)/(1+df)) + 1), N the run's pages."""
    n = docs.groupBy("run_id").agg(F.count("*").alias("n"))
    tf = docs.select(*KEYS, F.size("words").alias("len"), F.explode("words").alias("token")).groupBy(*KEYS, "len", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("run_id", "token").agg(F.count("*").alias("df"))
    both = tf.join(df, ["run_id", "token"]).join(n, "run_id")
    weight = F.col("tf") / F.col("len") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1)
    return both.select(*KEYS, "token", "tf", "df", weight.alias("weight"))


def _vectors(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(where each page's entries begin, tokens as numbers in order of first use, unit weights, the tokens) of TF-IDF vectors."""
    number: dict[str, int] = {}
    starts, tokens, counts = [0], [], []
    for page in words:
        tf = Counter(number.setdefault(w, len(number)) for w in page)
        tokens += tf
        counts += [c / len(page) for c in tf.values()]
        starts.append(len(tokens))
    ids, weights, at = np.array(tokens, np.int64), np.array(counts, float), np.array(starts)
    df = np.bincount(ids, minlength=len(number))
    weights *= np.log((1.0 + len(words)) / (1.0 + df[ids])) + 1
    of = np.repeat(np.arange(len(words)), np.diff(at))
    norm = np.sqrt(np.bincount(of, weights * weights, minlength=len(words)))
    return at, ids, weights / np.maximum(norm[of], 1e-300), list(number)


def _lead(at: np.ndarray, ids: np.ndarray, unit: np.ndarray, n_tokens: int) -> np.ndarray:
    """By page the page that leads its cluster: the first one near enough that no earlier one leads; pages in crawl order."""
    n = len(at) - 1
    order = np.argsort(ids, kind="stable")
    of = np.repeat(np.arange(n), np.diff(at))[order]
    posted, begin = unit[order], np.append(0, np.cumsum(np.bincount(ids, minlength=n_tokens)))
    leader = np.full(n, -1)
    for seed in range(n):
        if leader[seed] >= 0:
            continue
        leader[seed] = seed
        dots = np.zeros(n)
        for k in range(at[seed], at[seed + 1]):
            a, b = begin[ids[k]], begin[ids[k] + 1]
            a += np.searchsorted(of[a:b], seed + 1)  # pages before the seed have their leaders
            dots[of[a:b]] += unit[k] * posted[a:b]
        leader[(dots >= THRESHOLD) & (leader < 0)] = seed
    return leader


def _mean_similarity(rows: list[int], at: np.ndarray, ids: np.ndarray, unit: np.ndarray) -> float:
    """Mean positive cosine of a cluster's pairs, without making the pairs: the square of the sum of unit vectors less their own.

    Pairs without a common token have no cosine. They are counted page by page, by sets of bits, unless a token is on all pages.
    """
    m = len(rows)
    if m < 2:
        return 0.0
    parts = [slice(at[i], at[i + 1]) for i in rows]
    tokens, mine = np.concatenate([ids[p] for p in parts]), np.concatenate([unit[p] for p in parts])
    names, place = np.unique(tokens, return_inverse=True)
    total = np.bincount(place, mine)
    products = max(0.0, (float(total @ total) - float(mine @ mine)) / 2)
    if np.bincount(place).max() == m:
        return products / (m * (m - 1) / 2)
    page = np.repeat(np.arange(m), [p.stop - p.start for p in parts])
    width = (m + 7) // 8
    shared = 0
    step = max(1, 64_000_000 // width)  # the bits of so many tokens at a time
    seen = np.zeros((m, width), np.uint8) if len(names) > step else None
    for low in range(0, len(names), step):
        here = (place >= low) & (place < low + step)
        bits = np.zeros((min(step, len(names) - low), width), np.uint8)
        np.bitwise_or.at(bits, (place[here] - low, page[here] >> 3), (1 << (page[here] & 7)).astype(np.uint8))
        ends = np.searchsorted(page[here], np.arange(m + 1))
        own = place[here] - low
        for i in range(m):
            rows_of = own[ends[i] : ends[i + 1]]
            union = np.bitwise_or.reduce(bits[rows_of], axis=0) if len(rows_of) else np.zeros(width, np.uint8)
            if seen is not None:
                seen[i] |= union
            else:
                shared += int(np.unpackbits(union).sum()) - 1
    if seen is not None:
        shared = int(sum(int(np.unpackbits(r).sum()) - 1 for r in seen))
    return products / (shared / 2) if shared > 0 else 0.0


def _grouped(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, Callable[[list[int]], float]]:
    pdf = pdf.sort_values("crawl_seq", kind="stable").reset_index(drop=True)
    at, ids, unit, names = _vectors([list(w) for w in pdf.words])
    return pdf, _lead(at, ids, unit, len(names)), lambda rows: _mean_similarity(rows, at, ids, unit)


def _by_leader(leader: np.ndarray) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, s in enumerate(leader.tolist()):
        groups.setdefault(s, []).append(i)
    return groups


def _members(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, leader, _ = _grouped(pdf)
    return pd.DataFrame({"run_id": pdf.run_id, "crawl_seq": pdf.crawl_seq, "leader": pdf.crawl_seq.to_numpy()[leader]})


def _described(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, leader, similarity = _grouped(pdf)
    out = []
    for s, rows in _by_leader(leader).items():
        # counters keep the order of first use, and the most common of equal ones come in that order
        common = Counter(w for i in rows for w in dict.fromkeys(pdf.words[i]) if len(w) > 3)
        name = " / ".join(w for w, _ in common.most_common(2)) or None
        kind = Counter(pdf.intent[i] for i in rows).most_common(1)[0][0]
        out.append((pdf.run_id[s], pdf.crawl_seq[s], len(rows), name, kind, similarity(rows), any(pdf.faq[i] for i in rows)))
    return pd.DataFrame(out, columns=["run_id", "leader", "size", "name", "intent", "similarity", "faq"])


def members(docs: DataFrame) -> DataFrame:
    """run_id, crawl_seq, leader (crawl_seq of the cluster's first page) of documents (run_id, crawl_seq, words).

    Which page leads depends on all pages before it, so an audit's words meet in one task, as arrays of numbers; time goes with
    the number of clusters times the entries of their leaders' tokens. Audits of tens of thousands of pages are no trouble.
    """
    kind = docs.schema["crawl_seq"].dataType.simpleString()
    return docs.select(*KEYS, "words").groupBy("run_id").applyInPandas(_members, f"run_id string, crawl_seq {kind}, leader {kind}")


def topic_clusters(page_snapshots: DataFrame) -> DataFrame:
    """run_id, leader, size, name, intent, similarity, score: one row per cluster.

    name: the two words longer than three characters that most of its pages have, of equal ones the first seen; intent: its
    pages' most frequent, of equal ones that of the earliest page; similarity: mean positive cosine of its pairs; score: 40 + 16 a page +
    30 times the similarity, 8 more with questions. Words are the only thing that is shuffled, once.
    """
    docs = documents(page_snapshots, {"intent": intent(), "faq": F.coalesce(F.col("faq_count") > 0, F.lit(False))})
    kind = docs.schema["crawl_seq"].dataType.simpleString()
    rows = docs.groupBy("run_id").applyInPandas(_described, f"run_id string, leader {kind}, size long, name string, intent string, similarity double, faq boolean")
    score = round1(clamp(40 + F.col("size") * 16 + F.col("similarity") * 30 + F.when(F.col("faq"), 8).otherwise(0)))
    return rows.select("run_id", "leader", "size", "name", "intent", F.round("similarity", 6).alias("similarity"), score.alias("score"))
