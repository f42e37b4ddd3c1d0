"""p9: evaluation texts in documents."""

import random
import unicodedata

import pytest

import skarv.llm.leaks as L
from skarv.llm.words import words_line

DOC, ITEM = "doc_id bigint, text string, words string, item_id string", "item_id bigint, text string, lang string"


def found(spark, docs, items, **k):
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], DOC)
    it = spark.createDataFrame([(i, t, "x") for i, t in items], ITEM)
    return {(r.doc_id, r.item_id) for r in L.leaks(df, it, **k).collect()}


def brute(docs, items, run=12):
    grams = [(i, " ".join(w[k : k + run])) for i, t in items for w in [words_line(t).split()] for k in range(len(w) - run + 1)]
    return {(d, i) for d, t in docs for line in [f" {words_line(t)} "] for i, g in grams if f" {g} " in line}


ITEM_TEXT = "Which of the 31 checks in the Korlordu method must farafu finish before hobarrel can be counted as passed in Kyfepa now"


def test_forms_make_no_difference(spark):
    w = ITEM_TEXT.split()
    twelve = w[3:15]
    docs = [
        (1, "before " + " ".join(twelve) + " after"),
        (2, "before " + " ".join(twelve[:11]) + " after"),
        (3, " ** ".join(x.upper() for x in twelve)),
        (4, "​".join(" ".join(twelve))),
        (5, unicodedata.normalize("NFKD", " ".join(twelve))),
        (6, " ".join("".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in x) for x in twelve)),
        (7, " ".join(twelve[:6] + ["other"] + twelve[6:])),
        (8, "x" + " ".join(twelve)),
        (9, None),
        (10, ""),
        (11, "\n".join(twelve)),
        (12, "lorem ipsum " * 50_000 + " ".join(twelve) + " dolor" * 50_000),
        (1, "before " + " ".join(twelve) + " after"),
    ]
    assert found(spark, docs, [(7, ITEM_TEXT), (8, "too short to be found"), (9, None), (10, "")]) == {(i, 7) for i in (1, 3, 4, 5, 6, 11, 12)}


def test_empty_tables(spark):
    assert found(spark, [], [(1, ITEM_TEXT)]) == set()
    assert found(spark, [(1, ITEM_TEXT)], []) == set()


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_random_against_brute_force(spark, edits):
    rnd = random.Random(edits)
    vocabulary = ["".join(rnd.choice("abcdeæå") for _ in range(rnd.randint(3, 8))) for _ in range(60)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(10, 30)))) for i in range(12)]
    docs = []
    for d in range(40):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.7:
            w = rnd.choice(items)[1].split()
            k = rnd.randint(0, len(w))
            piece = w[k : k + rnd.randint(8, 20)]
            if rnd.random() < 0.4 and piece:
                piece[rnd.randrange(len(piece))] = "changed"
            words[5:5] = piece
        docs.append((d, rnd.choice([" ", ", ", "\n"]).join(words)))
    assert found(spark, docs, items, edits=edits) == brute(docs, items)


def test_short_texts_that_fold_to_many_words(spark):
    text = "\ufdfa" * 6  # each folds to four words
    assert found(spark, [(1, text)], [(1, unicodedata.normalize("NFKC", text))]) == {(1, 1)}
    assert found(spark, [(1, "a b c d e f g h i j k l")], [(1, "a b c d e f g h i j k l")]) == {(1, 1)}


def test_many_items_share_their_words(spark):
    """Items of one template: their common q-grams are no candidates as long as each passage has rarer ones."""
    items = [(i, f"How many of the checks in the method that {'x' * (i + 3)}{i} wrote must be passed before a page counts as ready") for i in range(60)]
    docs = [(i, f"Lorem {items[i][1]} ipsum") for i in range(0, 60, 7)] + [(100, "checks in the method that nobody wrote must be passed before a page counts as")]
    assert found(spark, docs, items) == brute(docs, items)


def test_rarest_keep_some_of_every_passage():
    line, q = "aa bb cc dd ee ff gg hh ii jj kk ll mm", 4
    counts = L.np.arange(len(line))[::-1]
    for edits in (0, 1):
        got = L.rarest(line, counts, 12, q, edits)
        for a, b in L._passages(line, 12):
            assert sum(a <= p <= b - q for p in got) >= q * edits + 1


def align(item, doc, *rest):
    return L.aligned(L._codes(item), L._codes(doc), *rest)


def brute_align(item, doc, low, high, edits, need):
    """Longest stretch of the item on diagonals low..high with at most `edits` edits, cell by cell."""
    best = {}
    for i in range(len(item)):
        for d in range(low, high + 1):
            j = i + d
            if not 0 <= j < len(doc):
                continue
            for e in range(edits + 1):
                v = best.get((i - 1, d, e), 0) + 1 if item[i] == doc[j] else 0
                if e:
                    v = max(v, best.get((i - 1, d, e - 1), 0) + 1, best.get((i - 1, d + 1, e - 1), 0) + 1, best.get((i, d - 1, e - 1), 0), best.get((i, d, e - 1), 0))
                best[i, d, e] = v
    return max(best.values(), default=0) >= need


def test_alignment_counts_edits():
    item = "abcdefghijklmnopqrstuvwxyz"
    assert align(item, "..cdefghijkl..", -4, 4, 0, 10)
    assert not align(item, "..cdefgXhijkl..", -4, 4, 0, 10)
    assert align(item, "..cdefgXhijkl..", -4, 4, 1, 10)
    assert align(item, "..cdefhijklm..", -4, 4, 1, 10)
    assert not align(item, "..cdefXXhijkl..", -1, 1, 1, 10)


def test_alignment_against_brute_force(monkeypatch):
    rnd = random.Random(3)
    for k in range(300):
        monkeypatch.setattr(L, "_BLOCK", rnd.choice([4, 1 << 15]))
        item, doc = ("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 25))) for _ in range(2))
        low = rnd.randint(-8, 4)
        args = (low, low + rnd.randint(0, 7), rnd.randint(0, 2), rnd.randint(1, 12))
        assert align(item, doc, *args) == brute_align(item, doc, *args), (item, doc, args)
