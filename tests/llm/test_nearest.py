"""Neighbours: recall against brute force, ties and cases."""

import numpy as np
import pytest

from cohortgeo.llm import nearest as N


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")


def brute(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = np.round(x @ x[i], 12)
        s[i] = -np.inf
        order = np.lexsort((ids, -s))[:k]
        out[int(ids[i])] = ids[order[np.isfinite(s[order])]].tolist()
    return out


def test_chi_square():
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(200_000, 8)) ** 2).sum(1)
    for q in (2.0, 7.0, 15.0):
        assert N.chi_square(np.array([q]))[0] == pytest.approx((x <= q).mean(), abs=0.005)


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, monkeypatch, scale):
    monkeypatch.setattr(N, "BLOCK_ROWS", 700)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 40)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 24))[rng.integers(0, 30, 2000)] + 0.4 * rng.normal(size=(2000, 24))
    x = x * rng.uniform(0.2, 3, (2000, 1)) if scale else x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(2000)
    got = {}
    for r in N.neighbours(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), lambda c: c % 20 == 0, k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]))
    want = brute(ids, x, 20, 20)
    assert set(got) == set(want) and all(sorted(z[0] for z in v) == list(range(1, 21)) for v in got.values())
    hits = sum(len({z[1] for z in got[q]} & set(w)) for q, w in want.items())
    assert hits >= 0.9 * 20 * len(want)


def test_few_points_are_verified():
    """Clustered vectors: the stopping test holds long before all are seen."""
    rng = np.random.default_rng(2)
    x = 20 * rng.normal(size=(100, 16))[rng.integers(0, 100, 8000)] + rng.normal(size=(8000, 16))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    N.search(np.arange(8000), np.arange(8000), x, np.arange(100), x[:100], 1.0)
    assert N.search.verified < 0.5 * 100 * 8000


def test_cells_that_the_test_rules_out_are_not_visited(spark, monkeypatch):
    """Far clusters: in the upper tree most queries need few cells; recall holds."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(3)
    x = 20 * rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sent, put = [], N.materialize

    def seen(df):
        out = put(df)
        if "kth" in out.columns:
            sent.append(out.count())
        return out

    monkeypatch.setattr(N, "materialize", seen)
    got = {}
    for r in N.neighbours(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), lambda c: c % 20 == 0, k=10).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(np.arange(3000), x, 20, 10)
    assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) >= 0.9 * 10 * len(want)
    assert sent[0] == 150 and sum(sent) < 0.6 * 150 * 32


def test_lengths_are_searched_apart(spark):
    rows = [(i, [1.0, float(i)], 0) for i in range(5)] + [(20 + i, [1.0, 0.0, float(i)], 0) for i in range(3)]
    got = {}
    for r in N.neighbours(frame(spark, rows), lambda c: c % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got == {0: {1, 2, 3, 4}, 20: {21, 22}}


def test_large_cells_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 20)
    rows = [(i, [1.0, 2.0], 0) for i in range(300)] + [(1000 + i, [float(i), 1.0], 0) for i in range(5)]
    got = {}
    for r in N.neighbours(frame(spark, rows), lambda c: c % 20 == 0, k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got[0]) == [(1, 1004, 6.0), (2, 1, 5.0), (3, 2, 5.0)]
    assert [x[2] for x in sorted(got[20])] == [6.0, 5.0, 5.0]


def test_ties_and_cases(spark):
    same = [1.0, 0.0, 0.0]
    rows = [(i, same, 1) for i in range(1, 60)] + [(0, same, 1), (100, [0.0, 2.0, 0.0], 1), (101, [0.0, 1.0, 0.0], 1), (120, [0.0, 0.0, -1.0], 1)]
    rows += [(140, None, 1), (160, [0.0, 0.0, 0.0], 1), (180, [1.0, None, 0.0], 1), (200, [float("nan"), 1.0, 1.0], 1), (220, [float("inf"), 1.0, 1.0], 1), (240, [1.0], 1), (None, same, 1), (101, [0.0, 3.0, 0.0], 1)]
    got = {}
    for r in N.neighbours(frame(spark, rows), lambda c: c % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 100, 120}
    assert [z[1] for z in sorted(got[0])] == list(range(1, 21)) and [z[1] for z in sorted(got[20])] == list(range(20))
    assert sorted(got[100])[:2] == [(1, 101, 6.0), (2, 101, 2.0)] and len(got[100]) == 20  # rows that share an id are rows of their own
    assert N.neighbours(frame(spark, []), lambda c: c % 20 == 0).count() == 0
    few = N.neighbours(frame(spark, rows[:3] + rows[59:60]), lambda c: c % 20 == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1), (2, 2), (3, 3)]
