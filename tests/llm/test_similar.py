"""Groups against all pairs by exact Jaccard similarity, planted near copies at 0.8, 0.85 and 0.9."""

import random

import numpy as np

import corpus_pipeline
from cohortgeo.llm import similar as M


def sets(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def text(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def copy(r, base, low, high):
    """A copy of a similarity from low to under high, by words changed at random."""
    while True:
        w = base.split()
        while jaccard(base, " ".join(w)) >= high:
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        if jaccard(base, " ".join(w)) >= low:
            return " ".join(w)


def test_planted_copies(spark):
    r, rows = random.Random(5), []
    for low, high, begin in ((0.8, 0.83, 0), (0.85, 0.88, 1000), (0.9, 0.93, 2000), (0.7, 0.79, 3000)):
        for i in range(100):
            base = text(r, r.choice((150, 300, 600)))
            rows += [(begin + 2 * i, base, "en", "s", 1), (begin + 2 * i + 1, copy(r, base, low, high), "en", "s", 1)]
    short = text(r, 60)
    rows += [(4000, short, "en", "s", 1), (4001, " ".join([*short.split()[:30], "changed", *short.split()[31:]]), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = {x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept >= {i for i, *_ in rows if i % 2 == 0 or 3000 <= i < 4000}
    missed = {begin: sum(begin <= i < begin + 1000 and i % 2 for i in kept) for begin in (0, 1000, 2000)}
    assert missed[0] <= 5 and missed[1000] <= 2 and missed[2000] == 0


def test_layout_keeps_its_recall():
    for n in (0, 10**3, 10**7, 10**10):
        half, segments = M.layout(n)
        p, width = M.differs(0.8), len(segments[0])
        meet = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
        assert (1 - meet) ** len(segments) <= 1 - M.RECALL and 2**width >= n / 4
        assert len(np.unique(np.concatenate(segments))) == width * len(segments) and segments[-1][-1] < 128 * half
        assert all(s[-1] < 64 * half or s[0] >= 64 * half for s in segments)


def test_wide_is_the_majority_of_bits(monkeypatch):
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 1 << 63, n, np.uint64)) for n in (0, 1, 5, 300, 40)]
    want = M.wide(sets, 4)
    for s, row in zip(sets, want):
        for k in range(4):
            h = M._mixed(s, k)
            assert int(row[k]) == sum(1 << j for j in range(64) if 2 * int((h >> np.uint64(j) & np.uint64(1)).sum()) > len(s))
    monkeypatch.setattr(M, "GROUP", 7)
    assert (M.wide(sets, 4) == want).all()


def test_groups():
    r = random.Random(6)
    base = text(r, 200)
    texts = [base, text(r, 200)]
    for _ in range(6):  # a chain, each like the one before
        texts.append(copy(r, texts[-1] if len(texts) > 2 else base, 0.8, 0.9))
    texts += [copy(r, base, 0.7, 0.9) for _ in range(20)]
    r.shuffle(texts)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = M.groups([M.shingles(np.frombuffer(t.encode(), np.uint8)) for t in texts])
    assert got.tolist() == [find(i) for i in range(len(texts))]


def test_rows(spark):
    rows = [(9, "short text"), (4, "Short  TEXT"), (None, "short text"), (30, None), (31, " "), (None, "alone here"), (50, "z " * 3000), (51, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["doc_id"], x["component_id"]) for x in M.near_copies(docs).collect()}
    assert got == {(9, 4), (4, 4), (None, 4), (30, 30), (31, 30), (None, None), (50, 50), (51, 51)}
    assert M.near_copies(docs.limit(0)).count() == 0


def test_large_components_are_linked_alike(spark, monkeypatch):
    """Chains, a dense group and outliers of one component, in one task and over all."""
    r = random.Random(9)
    base = text(r, 120)
    texts = [base] + [copy(r, base, 0.6, 0.95) for _ in range(60)]
    for _ in range(10):
        texts.append(copy(r, texts[-1], 0.75, 0.9))
    docs = [M.shingles(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    rows = [(7, i, s.tobytes()) for i, s in enumerate(docs)] + [(8, 1000 + i, s.tobytes()) for i, s in enumerate(docs[:3])]
    sets = spark.createDataFrame([(c, fp, bytearray(s)) for c, fp, s in rows], "component long, fp long, set binary").repartition(4)

    def partition(heads):
        by = {}
        for x in heads:
            by.setdefault(x["head"], set()).add(x["fp"])
        return sorted(map(sorted, by.values()))

    want = partition(M._heads(sets).collect())
    assert 1 < len(want) < len(rows)
    for pivots, block in ((3, 2), (32, 256), (10**6, 1)):
        monkeypatch.setattr(M, "LARGE", 2)
        monkeypatch.setattr(M, "PIVOTS", pivots)
        monkeypatch.setattr(M, "BLOCK", block)
        assert partition(M._heads(sets).collect()) == want
