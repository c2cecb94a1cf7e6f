"""Leaks: exact edit distances, recall, and cases."""

import random

import numpy as np
import pytest

from cohortgeo.llm import decontaminate as D


def item(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6))) for _ in range(n))


def edited(r, text, rate):
    w = text.split()
    for _ in range(int(rate * len(w))):
        j, what = r.randrange(len(w)), r.randrange(3)
        if what == 0:
            w[j] = f"new{r.randrange(10**6)}"
        elif what == 1 and len(w) > 1:
            w.pop(j)
        else:
            w.insert(j, f"more{r.randrange(10**6)}")
    return " ".join(w)


def symbols_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    symbols, begin = D.words(data, np.array([0, len(data)]))
    return symbols, begin, len(symbols) - np.arange(len(symbols))


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_verification_is_exact():
    r = random.Random(1)
    texts = [item(r, n) for n in (1, 3, 7, 15, 30)]
    index = D.Index(list(enumerate(texts)))
    for text in texts:
        for rate in (0, 0.1, 0.2, 0.3):
            symbols, _, room = symbols_of("x y z " + edited(r, text, rate) + " q r s")
            for k in range(len(texts)):
                window = np.arange(len(symbols))
                got = index.verify(symbols, room, window, np.full(len(symbols), k))
                for p in window:
                    want = 1 - plain_distance(list(index.words[k]), list(symbols[p : p + 2 * len(index.words[k]) + 2])) / len(index.words[k])
                    if want >= 0.8 - 1e-9 or got[p] >= 0.8 - 1e-9:
                        assert got[p] == pytest.approx(want)


def test_recall():
    r = random.Random(2)
    items = [(i, item(r, r.randint(12, 60))) for i in range(150)]
    index = D.Index(items)
    for rate, least in ((0, 1.0), (0.05, 0.98), (0.1, D.TARGET)):
        hits = 0
        for i, text in items:
            symbols, _, room = symbols_of(item(r, 20) + " " + edited(r, text, rate) + " " + item(r, 20))
            window, found = index.candidates(symbols, room)
            similar = index.verify(symbols, room, window, found)
            hits += bool((similar[found == i] >= 0.8 - 1e-12).any())
        assert hits >= least * len(items), rate


@pytest.mark.parametrize("n", [5, 6, 8, 11, 12, 15, 24, 60, 150, 300])
def test_recall_at_the_least_similarity(n):
    r = random.Random(n)
    items = [(i, item(r, n)) for i in range(100 if n < 300 else 30)]
    index = D.Index(items)
    hits = 0
    for i, text in items:
        symbols, _, room = symbols_of(item(r, 20) + " " + edited(r, text, 0.2 + 1e-9) + " " + item(r, 20))
        window, found = index.candidates(symbols, room)
        hits += bool((index.verify(symbols, room, window, found)[found == i] >= 0.8 - 1e-12).any())
    assert hits >= D.TARGET * len(items)


def test_words_stop_at_bounds():
    data = np.frombuffer(b"abc defghi", np.uint8)
    whole, _ = D.words(data, np.array([0, 10]))
    cut, begin = D.words(data, np.array([0, 6, 10]))
    assert len(whole) == 2 and begin.tolist() == [0, 4, 6] and cut[0] == whole[0] and cut[1] != whole[1]
    upper, _ = D.words(np.frombuffer(b"ABC, DefGHI!", np.uint8), np.array([0, 12]))
    assert (upper == whole).all()


def test_rows(spark, monkeypatch):
    r = random.Random(3)
    a, b = item(r, 25), item(r, 40)
    items = spark.createDataFrame([(1, a), (2, b), (3, None), (4, "..."), (5, a)], "item_id long, text string")
    monkeypatch.setattr(D, "PIECE", 2000)
    long = " ".join(item(r, 50) for _ in range(60)) + " " + b + " " + item(r, 900)
    rows = [(10, f"{item(r, 9)}\n{a.upper()}, {item(r, 9)}"), (11, item(r, 200)), (12, None), (13, ""), (14, long), (14, long), (None, b), (15, a[: len(a) // 2])]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, similarity string")
    got = sorted((x["doc_id"] or 0, x["item_id"]) for x in D.leaks(docs, items).collect())
    assert got == [(0, 2), (10, 1), (10, 5), (14, 2), (14, 2)]
    marked = {x["doc_id"]: x["n_leaks"] for x in D.mark_leaks(docs, items, docs.columns).collect()}
    assert marked == {10: 2, 11: 0, 12: 0, 13: 0, 14: 1, None: 1, 15: 0}
    assert D.leaks(docs.limit(0), items).count() == 0 and D.leaks(docs, items.limit(0)).count() == 0
    monkeypatch.setattr(D, "ITEMS", 2)  # several blocks of items
    assert sorted((x["doc_id"] or 0, x["item_id"]) for x in D.leaks(docs, items).collect()) == got
    assert {x["doc_id"]: x["n_leaks"] for x in D.mark_leaks(docs, items, docs.columns).collect()} == marked


def test_of_windows_alike_the_first_is_told(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, f"one two {item} three four {item} five", 9), (1, item, 9), (2, "one two", 9)], "doc_id long, text string, similarity int")
    items = spark.createDataFrame([(5, item), (5, item)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["similarity"], r["first_byte"]) for r in D.leaks(docs, items).collect())
    assert set(got) == {(1, 5, 1.0, 0), (1, 5, 1.0, 8)} and len(got) in (2, 4)
    assert D.leaks(docs, items.limit(0)).count() == 0 and D.leaks(docs.limit(0), items).count() == 0
    with pytest.raises(ValueError):
        D.leaks(docs, items.withColumnRenamed("item_id", "doc_id"), item_col="doc_id")
