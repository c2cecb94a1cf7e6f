"""Packing: ids by the library, gapless places, few sequences, cases."""

import os
import random
import zlib

import numpy as np
import pytest

from cohortgeo.llm import packing as K

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoder_is_the_library(library):
    encode, r = K.encoder(), random.Random(1)
    texts = ["", "<|endoftext|>", "a <|endoftext|>b<|endo", "日本 é  ñ\n\n x", "'s 'LL we'll"] + ["".join(r.choice("etaoin ETA'\n\t.,;01é日<|>") for _ in range(r.randint(0, 150))) for _ in range(300)]
    for t in texts:
        assert list(encode(t)) == library(t), t


def test_best_fit():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 101, 3000)
    where, offset, fill = K.best_fit(sizes, 100)
    assert fill.max() <= 100 and (np.bincount(where, sizes) == fill).all()
    # No packing takes fewer: items over a half are apart, and items of k and more have only the room beside those of at most 100 - k.
    bound = 0
    for k in range(51):
        alone, half, small = sizes > 100 - k, (sizes > 50) & (sizes <= 100 - k), (sizes <= 50) & (sizes >= k)
        room = 100 * half.sum() - sizes[half].sum()
        bound = max(bound, alone.sum() + half.sum() + max(0, -(-(sizes[small].sum() - room) // 100)))
    assert len(fill) <= bound + 2
    for b in range(len(fill)):
        mine = np.flatnonzero(where == b)
        mine = mine[np.argsort(offset[mine])]
        assert (offset[mine] == np.cumsum(sizes[mine]) - sizes[mine]).all()
    assert (fill <= 50).sum() <= 1


def check(rows, got, length, library):
    by = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append(x)
    for seq in by.values():
        seq.sort(key=lambda x: x["offset"])
        assert [x["offset"] for x in seq] == (np.cumsum([x["length"] for x in seq]) - [x["length"] for x in seq]).tolist()
        assert sum(x["length"] for x in seq) <= length
    want = []
    for d, t in rows:
        ids = np.array([*library(t or ""), 0], "<u4")
        first = len(ids) % length or length
        cuts = [0, *range(first, len(ids) + 1, length)] if len(ids) > length else [0, len(ids)]
        want += [(d or -1, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((x["doc_id"] or -1, x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == sorted(want)
    return len(by)


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_rows(spark, library, parts):
    r = random.Random(3)
    rows = [(i, "word " * r.randint(0, 90)) for i in range(300)] + [(400, None), (401, ""), (402, "x y " * 800), (402, "x y " * 800), (None, "no id"), (403, "ab " * 63), (404, "<|endoftext|>")]
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, offset int").repartition(parts)
    got = K.pack_documents(docs, length=64).collect()
    n = check(rows, got, 64, library)
    assert n <= 1.05 * sum(x["length"] for x in got) / 64 + 2


def test_tree_merges_underfull_bins(spark, library):
    """Small documents, one to a partition: only the tree can bring them together."""
    rows = [(i, "a b c") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(60)
    got = K.pack_documents(docs, length=64).collect()
    assert check(rows, got, 64, library) <= 5


@pytest.mark.parametrize("low, high", [(1, 64), (20, 40), (33, 64), (1, 20)])
def test_bins_that_stay_behind_lose_no_sequence(spark, monkeypatch, low, high):
    """As many sequences as if all bins went up the tree, on very uneven partitions."""
    r = np.random.default_rng(low + high)
    sizes = [r.integers(low, high + 1, n) for n in (900, 1, 2, 40, 1, 300, 3, 1, 1, 5, 700, 2, 1, 1, 60, 1, 1, 8, 1, 2)]
    bins = [((p << 32) + b, int(f)) for p, s in enumerate(sizes) for b, f in enumerate(K.best_fit(s, 64)[2])]
    left = {}
    for up in (9, 64, 10**9):
        monkeypatch.setattr(K, "UP", up)
        monkeypatch.setattr(K, "NEARLY", 0)
        by_part = [[b for b in bins if b[0] >> 32 == p] for p in range(len(sizes))]
        open_ = [x for mine in by_part for x, ok in zip(mine, K._roomiest(np.array([f for _, f in mine]), 64)) if ok]
        moved = K.merge_bins(spark.createDataFrame(open_, "bin long, fill long"), 64).collect()
        left[up] = len(bins) - sum(x["bin"] != x["sequence_id"] for x in moved)
    assert left[9] == left[64] == left[10**9]


def test_empty(spark):
    assert K.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        K.pack_documents(spark.createDataFrame([], "doc_id long, text string"), length=0)
