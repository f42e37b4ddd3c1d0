"""Evaluation texts leaking into training text: q-gram filtering in diagonal bands, then banded alignment, then words.

Items and documents are folded to lines of words. If a document holds a passage of an item with at most `edits` edits, passage
and document share at least L - q + 1 - q*edits character q-grams whose positions differ by nearly the same amount: they lie in
one of the overlapping diagonal bands (the q-gram lemma). It is used twice:

* over all items at once, in one pass over the documents: a bit set of bounded size holds the q-grams of all items; areas of a document
  whose q-grams are dense enough in it are kept, the rest of the text is done with;
* for pairs: an area meets the items that share one of their rarest q-grams – of every passage the q*edits + 1 rarest, so at
  least one survives – and the pair's bands are counted; bands that reach the bound are aligned within the band.

A last check asks for `run` consecutive words. Items live in tables like documents: however many there are, the documents are read
once and nothing but the bit set goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarv.functions.arrow import slices
from skarv.llm.words import words_line
from skarv.runtime import cut

#: The bit set has eight bits for every q-gram of an item, at least 2^16 and at most 2^29 (64 MB).
BITS = (16, 29)
#: Parts of a q-gram that many areas share.
SALTS = 16
#: Rows that are Python objects at a time in a worker.
ROWS = 200
#: Item characters that are aligned at a time.
_BLOCK = 1 << 15


def _codes(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)


def _qhash(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q codes (q a power of two), by doubling."""
    h, width, a = codes.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    if len(codes) < q:
        return h[:0]
    while width < q:
        h = h[:-width] * np.uint64(a) + h[width:]
        a = a * a % 2**64
        width *= 2
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _passages(line: str, run: int) -> list[tuple[int, int]]:
    """From and to of every `run` consecutive words."""
    words = line.split(" ")
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    return [(int(starts[i]), int(starts[i + run]) - 1) for i in range(len(words) - run + 1)]


def lemma(length: int, q: int, edits: int) -> int:
    """The fewest q-grams that a passage of that length shares after so many edits."""
    return max(1, length - q + 1 - q * edits)


def rarest(line: str, counts: np.ndarray, run: int, q: int, edits: int) -> list[int]:
    """Positions of q-grams such that every passage has its q*edits + 1 rarest among them (all it has, if those are fewer)."""
    chosen: set[int] = set()
    want = q * edits + 1
    for a, b in _passages(line, run):
        at = np.arange(a, max(a, b - q + 1))
        order = np.lexsort((at, counts[at]))
        chosen.update(at[order[:want]].tolist())
    return sorted(chosen)


def dense_areas(hit: np.ndarray, width: int, least: int) -> list[tuple[int, int]]:
    """From and to (exclusive) of the merged windows of `width` positions that hold at least `least` hits."""
    n = len(hit)
    if not n:
        return []
    width = min(width, n)
    total = np.concatenate([[0], np.cumsum(hit)])
    good = np.flatnonzero(total[width:] - total[:-width] >= least)
    if not len(good):
        return []
    breaks = np.flatnonzero(np.diff(good) > width)
    first, last = np.append(0, breaks + 1), np.append(breaks, len(good) - 1)
    return [(int(good[a]), int(good[b]) + width) for a, b in zip(first, last)]


def aligned(item: np.ndarray, doc: np.ndarray, low: int, high: int, edits: int, need: int) -> bool:
    """Whether some stretch of `need` item codes aligns with doc within diagonals low..high (doc minus item position).

    best[d, i] is the longest stretch that ends at item position i on diagonal d with so many edits, in item codes. Within a run
    of equal codes it grows by one a step, so each level is a running maximum over runs, all diagonals at once.
    """
    need = max(1, need)
    first, last = max(0, -high), min(len(item), len(doc) - low)
    d = np.arange(low, high + 1)[:, None]
    for at in range(first, last, _BLOCK):
        i = np.arange(max(first, at - need - edits - 1), min(last, at + _BLOCK))
        if len(i) < need:
            continue
        j = i + d
        inside = (j >= 0) & (j < len(doc))
        same = inside & (doc[np.where(inside, j, 0)] == item[i])
        segment = np.cumsum(~same, axis=1)
        shift = len(i) + 2 * need + 2
        steps = np.arange(len(i))
        best = None
        for e in range(edits + 1):
            if best is None:
                entry = np.where(same, 1, 0)
            else:
                before = np.pad(best[:, :-1], ((0, 0), (1, 0)))
                entry = np.where(inside, before + 1, 0)  # another code
                entry[:-1] = np.maximum(entry[:-1], before[1:] + 1)  # an item code without partner
                entry[1:] = np.maximum(entry[1:], best[:-1])  # a document code without partner
                entry = np.where(inside, np.maximum(entry, best), 0)
            grown = np.maximum.accumulate(entry - steps + segment * shift, axis=1) - segment * shift + steps
            best = np.minimum(grown, need)
            if best.max() >= need:
                return True
    return False


def bands(item: np.ndarray, doc: np.ndarray, q: int, edits: int, least: int) -> list[tuple[int, int]]:
    """The diagonal bands (low, high) with at least `least` shared q-grams. Neighbouring bands overlap by half."""
    a, b = _qhash(item, q), _qhash(doc, q)
    order = np.argsort(a, kind="stable")
    left, right = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    n = right - left
    where = np.repeat(np.arange(len(b)), n)
    post = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    band = max(4, 2 * (edits + 1))
    diagonal = (where - order[post]) // band
    keys, count = np.unique(np.concatenate([diagonal, diagonal - 1]), return_counts=True)
    return [(int(k) * band, int(k) * band + 2 * band - 1) for k in keys[count >= least]]


def shared_words(line: str, area: str, run: int, q: int, edits: int) -> int:
    """Consecutive words of the item's line in the area, 0 if there are under `run`: bands, alignment, then whole words."""
    passages = _passages(line, run)
    shortest = min(b - a for a, b in passages)
    item, doc = _codes(line), _codes(area)
    found: set[str] = set()
    for low, high in bands(item, doc, q, edits, lemma(shortest, q, edits)):
        if aligned(item, doc, low, high, edits, shortest):
            first = max(0, low - 1)
            text = area[first : high + len(line) + 2]
            text = (" " if not first else "") + text + " " * (high + len(line) + 2 >= len(area))
            found.update(p for a, b in passages if f" {(p := line[a:b])} " in text)
    return run + len(found) - 1 if found else 0


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _id(line: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))).view(np.int64))


def _item_tables(items: DataFrame, key: str, text: str, run: int, q: int, edits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines: item key, i, line, length of its shortest passage; grams: i, pos, h of all q-grams; chosen: i, h of the rarest of every passage)."""
    kind = items.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            lines = [words_line(t) for t in batch.column(1).to_pylist()]
            keep = [n for n, s in enumerate(lines) if s and s.count(" ") >= run - 1]
            got = [lines[n] for n in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), pa.array(map(_id, got), pa.int64()), pa.array(got, pa.string()), pa.array([min(b - a for a, b in _passages(s, run)) for s in got], pa.int64())], ["k", "i", "line", "shortest"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            for i, line in zip(*(batch.column(c).to_pylist() for c in ("i", "line"))):
                h = _signed(_qhash(_codes(line), q))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i)), pa.array(np.arange(len(h))), pa.array(h)], ["i", "pos", "h"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            for i, line, rare in zip(*(batch.column(c).to_pylist() for c in ("i", "line", "often"))):
                h = _signed(_qhash(_codes(line), q))
                counts = np.ones(len(h), np.int64)
                for r in rare or ():
                    counts[r["pos"]] = r["n"]
                got = np.unique(h[rarest(line, counts, run, q, edits)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), i)), pa.array(got)], ["i", "h"])

    src = items.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).filter(F.col("t").isNotNull())
    lines = cut(src.mapInArrow(fold, f"k {kind}, i bigint, line string, shortest bigint"), "leak-items")
    unique = lines.select("i", "line").dropDuplicates(["i"])
    grams = cut(unique.mapInArrow(expand, "i bigint, pos bigint, h bigint"), "leak-grams")
    often = grams.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    per_item = grams.join(often, "h").groupBy("i").agg(F.collect_list(F.struct("pos", "n")).alias("often"))
    chosen = unique.join(per_item, "i", "left").mapInArrow(choose, "i bigint, h bigint")
    return lines, grams, cut(chosen, "leak-rarest")


def _bit_set(grams: DataFrame, bits: int) -> np.ndarray:
    """The set of hashes as 2^bits bits, by their first `bits` bits; at most 2^(bits-6) rows come to the driver."""
    place = F.shiftrightunsigned("h", 64 - bits)
    words = grams.groupBy(F.shiftrightunsigned(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("b"))
    got = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint64)


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", run: int = 12, q: int = 16, edits: int = 1) -> DataFrame:
    """doc_key, item_key, words: each document with each item of which it holds `run` or more consecutive words.

    words: distinct runs of `run` words found in one area, plus run - 1 (the length of the passage if it is one). Case, punctuation,
    white space, invisible characters and Unicode composition or compatibility forms make no difference. Null and empty texts, and
    items under `run` words, give no rows; repeated ids give the greatest `words`; other columns are ignored; an empty table on
    either side gives no rows. edits: edits that filter and alignment let pass; the words decide in the end.

    Documents are read once, all of their text. Equal areas, and items of equal words, are compared once. What is shuffled is areas
    and items, no documents.
    """
    spark = docs.sparkSession
    lines, grams, chosen = _item_tables(items, item_key, text, run, q, edits)
    n, shortest = grams.count(), lines.agg(F.min("shortest")).first()[0] or 0
    bits = int(min(max(BITS[0], np.ceil(np.log2(8 * max(n, 1)))), BITS[1]))
    bit_set = spark.sparkContext.broadcast(_bit_set(grams, bits))
    doc_kind = docs.schema[doc_key].dataType.simpleString()
    width, least = shortest - q + 1, lemma(shortest, q, edits)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bit_set.value
        for batch in slices(batches, ROWS):
            take, ids, areas, hashes = [], [], [], []
            for k, t in enumerate(batch.column("t").to_pylist()):
                line = words_line(t)
                h = _qhash(_codes(line), q)
                place = h >> np.uint64(64 - bits)
                hit = (known[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)
                for a, b in dense_areas(hit.astype(bool), width, least):
                    own = np.unique(_signed(h[a:b][hit[a:b] > 0]))
                    # whole words, and as many more as edits may have moved
                    first, last = line.rfind(" ", 0, max(0, a - edits)) + 1, line.find(" ", b + q - 1 + edits)
                    area = line[first : last if last >= 0 else len(line)]
                    take.append(k)
                    ids.append(_id(area))
                    areas.append(area)
                    hashes.append(own)
            kinds = [pa.array(ids, pa.int64()), pa.array(areas, pa.string()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(take, pa.int32())), *kinds], ["k", "a", "area", "h"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            words = [shared_words(s, t, run, q, edits) for s, t in zip(*(batch.column(c).to_pylist() for c in ("line", "area")))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("i"), pa.array(words, pa.int32())], ["a", "i", "words"])

    src = docs.select(F.col(doc_key).alias("k"), F.col(text).cast("string").alias("t")).filter(F.col("t").isNotNull() & (F.col("t") != ""))
    areas = cut(src.mapInArrow(find, f"k {doc_kind}, a bigint, area string, h array<bigint>"), "leak-areas")
    once = areas.select("a", "area", "h").dropDuplicates(["a"])
    parts = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = once.select("a", F.explode("h").alias("h"), F.pmod("a", F.lit(SALTS)).cast("int").alias("part"))
    pairs = asked.join(parts, ["h", "part"]).select("a", "i").distinct()
    texts = pairs.join(once.select("a", "area"), "a").join(lines.select("i", "line").dropDuplicates(["i"]), "i")
    sure = texts.select("a", "i", "line", "area").mapInArrow(verify, "a bigint, i bigint, words int").filter("words > 0")
    hits = areas.select("k", "a").join(sure, "a").join(lines.select(F.col("k").alias("item"), "i"), "i")
    return hits.groupBy(F.col("k").alias(doc_key), F.col("item").alias(item_key)).agg(F.max("words").alias("words"))
