"""Removed passages against a dictionary of all 50-byte strings; the transform against sorting."""

import hashlib
import os
import random
import subprocess
import sys

import numpy as np
import pytest

from cohortgeo.llm import suffix_dedup as S


def test_transform_is_the_sorted_suffixes():
    r = random.Random(3)
    for alphabet in (b"ab\xfe", b"a", bytes(range(1, 255))):
        reads = [bytes(r.choice(alphabet) for _ in range(r.randint(1, 20))) for _ in range(30)]
        reads += reads[:5]
        length = np.array([len(x) for x in reads])
        grid = np.zeros((len(reads), length.max()), np.uint8)
        for i, x in enumerate(reads):
            grid[i, : len(x)] = np.frombuffer(x, np.uint8) + 1
        bwt, lcp, name = S.transform(grid, length)
        suffix = [reads[n >> 8][len(reads[n >> 8]) - (n & 255) :] for n in name]
        assert suffix == sorted(suffix) and sorted(name) == sorted((i << 8) | k for i, x in enumerate(reads) for k in range(len(x) + 1))
        for i in range(len(suffix)):
            x, k = reads[name[i] >> 8], name[i] & 255
            assert bwt[i] == (x[len(x) - k - 1] + 1 if k < len(x) else 0)
            if i:
                a, b = suffix[i - 1], suffix[i]
                assert lcp[i] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


def test_anchors_follow_content():
    r = np.random.default_rng(0)
    a, b = r.integers(97, 110, 300, np.uint8), r.integers(97, 110, 200, np.uint8)
    a[100:170] = b[40:110]
    assert (S.anchors(a)[100:121] == S.anchors(b)[40:61]).all()
    assert len(S.anchors(a[:49])) == 0


def plain(rows):
    first = {}
    for d, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        cut = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            least = first[raw[p : p + 50]]
            if least is not None and (d is None or least < d):
                cut[p : p + 50] = True
        kept = bytes(c for c, x in zip(raw, cut) if not x)
        out.append((d, len(raw), int(cut.sum()), int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgéñ") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, other = text(30), text(12)
    out = [(i, text(r.randint(1, 60))) for i in range(40)]
    out += [(100 + i, f"{text(5)} {shared} {text(5)}") for i in range(25)] + [(200 + i, out[3][1]) for i in range(5)]
    out += [(300, None), (301, ""), (302, "x" * 49), (303, "x" * 50), (304, "x" * 400), (305, "ab" * 200), (306, "ab" * 30), (307, shared[:49]), (308, other + shared[3:] + other), (309, other)]
    out += [(310, "repeated row " + text(20))] * 2 + [(None, shared), (50, shared + shared)]
    return out


@pytest.mark.parametrize("block, bucket, split", [(4 << 20, 1 << 20, 48), (700, 5, 1), (2000, 20, 4), (700, 1 << 20, 2)])
def test_rows(spark, monkeypatch, block, bucket, split):
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    monkeypatch.setattr(S, "BUCKET_HASHES", bucket)
    monkeypatch.setattr(S, "ROW_HASHES", 1)
    monkeypatch.setattr(S, "SPLIT_READS", split)
    monkeypatch.setattr(S, "CHUNK", 300)
    table = rows()
    docs = spark.createDataFrame([(d, t, 1) for d, t in table], "doc_id long, text string, n_bytes int").repartition(3)
    got = S.repeated_spans(docs, removed_text=True).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted((tuple(x)[:5] for x in got), key=key) == sorted(plain(table), key=key)
    assert all(hashlib.sha256(x["kept"]).hexdigest() == x["kept_sha256"] for x in got)


def test_places_do_not_depend_on_the_order_of_rows():
    table = [(d, t) for d, t in rows() if d is not None]
    kinds = {"id": S.pa.int64(), "text": S.pa.string()}
    make = lambda x: S.Block(S.pa.table({n: S.pa.array([r[i] for r in x], k) for i, (n, k) in enumerate(kinds.items())}))
    first = make(table)
    for seed in range(5):
        random.Random(seed).shuffle(table)
        other = make(table)
        assert (first.data == other.data).all() and first.given.equals(other.given)
        assert all((a == b).all() for a, b in zip(first.runs(), other.runs()))


@pytest.mark.parametrize("chunk", [1, 77, 1 << 20])
def test_runs_cover_all_strings(monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    table = [(d, t) for d, t in rows() if d is not None][-30:]
    block = S.Block(S.pa.table({"id": S.pa.array([d for d, _ in table], S.pa.int64()), "text": S.pa.array([t for _, t in table], S.pa.string())}))
    start, count, doc, key = block.runs()
    found = sorted((int(d), int(s) + k - int(block.offsets[d])) for s, c, d in zip(start, count, doc) for k in range(c))
    size = np.diff(block.offsets)
    assert found == [(d, i) for d in range(len(size)) for i in range(max(size[d] - S.SPAN + 1, 0))]
    assert (S.anchors(block.data)[start] == key).all()


CLUSTER = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from cohortgeo.llm import suffix_dedup as S
from cohortgeo.session import with_package
import test_suffix_dedup as T
spark = with_package(SparkSession.builder.master("local-cluster[3,1,1024]").config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false")
    .config("spark.executor.memory", "1g").config("spark.checkpoint.dir", {folder!r}).getOrCreate())
S.BLOCK_BYTES, S.BUCKET_HASHES, S.ROW_HASHES = 4000, 100, 1
table = T.rows() * 3
table = [(d if d is None else d + 1000 * (i // len(T.rows())), t) for i, (d, t) in enumerate(table)]
docs = spark.createDataFrame(table, "doc_id long, text string").repartition(12)
key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
for _ in range(2):
    got = sorted((tuple(x) for x in S.repeated_spans(docs).collect()), key=key)
    want = sorted(T.plain(table), key=key)
    assert got == want, sum(a != b for a, b in zip(got, want))
print("equal")
spark.stop()
"""


def test_several_executors(tmp_path):
    """Shuffled rows come in another order from several executors than in local mode."""
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(os.path.dirname(here))
    env = os.environ | {"PYTHONPATH": os.pathsep.join([root, here])}
    got = subprocess.run([sys.executable, "-c", CLUSTER.format(root=root, folder=str(tmp_path))], env=env, capture_output=True, text=True, timeout=600)
    assert got.stdout.strip().endswith("equal"), got.stderr[-3000:]


def test_empty(spark):
    assert S.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
