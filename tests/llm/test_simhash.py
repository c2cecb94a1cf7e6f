"""Fingerprints by their definition, links against all pairs."""

import random
import re

import numpy as np
import xxhash

from cohortgeo.llm import simhash as S


def plain(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def hexed(text):
    return f"{plain(text):016x}"


def components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(monkeypatch):
    r = random.Random(1)
    texts = ["", "   \n", "One", "one TWO three", "a b c d", "ÀÉ x y z \x0b w", "a " * 500] + [" ".join(r.choice("abcdef") * r.randint(1, 3) for _ in range(r.randint(1, 90))) for _ in range(60)]
    monkeypatch.setattr(S, "GROUP", 50)  # groups must not change a sum
    raw = [t.encode() for t in texts]
    got = S.fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert got.tolist() == [plain(t) for t in texts]


def cluster(r):
    base = [r.getrandbits(64) for _ in range(12)]
    out = list(base)
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(r.randint(1, 6)):
                x ^= 1 << r.randrange(64)
            out.append(x)
    chain = r.getrandbits(64)
    for _ in range(30):
        for _ in range(4):
            chain ^= 1 << r.randrange(64)
        out.append(chain)
    return sorted(set(out))


def test_covers():
    r = random.Random(3)
    for n, joined in ((1000, 1), (10**7, 2), (10**9, 3)):
        for bits in (2, 4, 5):
            segments = S.cover(n, bits)
            for _ in range(300):
                x = sum(1 << j for j in r.sample(range(64), bits))
                assert any(sum(x >> int(j) & 1 for j in places) <= 1 for places in segments)
    assert [len(S.cover(n)) for n in (1000, 10**7, 10**9)] == [3, 10, 20]


def test_links(spark, monkeypatch):
    fps = cluster(random.Random(2))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    for run, n in ((256, len(fps)), (2, len(fps)), (256, 10**7), (256, 10**9)):  # long runs are walked, short ones compared; each cover
        monkeypatch.setattr(S, "SHORT_RUN", run)
        monkeypatch.setattr(S, "ENTRIES", 10**12)
        found = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), n).collect()
        for u, v in found:
            assert u != v
        parent = {x: x for x in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in found:
            parent[find(u)] = find(v)
        mine = {}
        for x in signed:
            mine.setdefault(find(x), []).append(x)
        want = {}
        for x, c in zip(signed, components(fps)):
            want.setdefault(c, []).append(x)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_long_and_short_runs_alike(monkeypatch):
    r = np.random.default_rng(1)
    fps = np.array(cluster(random.Random(7)), np.uint64)
    parts = list(S.entries(fps[:, None], S.cover(len(fps))))
    key, exact, row = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    node = fps.view(np.int64)[row]
    order = r.permutation(len(key))
    stars = []
    for run in (256, 2):
        monkeypatch.setattr(S, "SHORT_RUN", run)
        stars.append(S.linked(key[order], exact[order], node[order], fps[row][order][:, None]))
    assert (stars[0] == stars[1]).all()


def test_rows(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(1000)}" for _ in range(300)]
    rows = [(i, " ".join(words)) for i in (9, 4, 4)] + [(20, " ".join([*words[:-1], "changed"])), (30, None), (31, ""), (32, " \t"), (40, "short text"), (41, "Short TEXT"), (None, "alone here now and then"), (None, "short text"), (50, "z " * 3000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fingerprint string").repartition(4)
    got = sorted(((x["doc_id"] is None, x["doc_id"] or 0, x["fingerprint"], x["component_id"]) for x in S.near_duplicates(docs).collect()), key=str)
    fps = [plain(t) for _, t in rows]
    comp = components(fps)
    least = {c: min((d for (d, _), k in zip(rows, comp) if k == c and d is not None), default=None) for c in set(comp)}
    want = sorted(((d is None, d or 0, f"{f:016x}", least[c]) for (d, _), f, c in zip(rows, fps, comp)), key=str)
    assert got == want
    assert S.near_duplicates(docs.limit(0)).count() == 0
