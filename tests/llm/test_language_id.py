"""PPM code lengths against a plain reading of the definition, and held-out accuracy."""

import math
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cohortgeo.llm import language_id as L

DATA = "/root/testdata/sf0.01"


def plain_length(sample, language, text, order):
    seen = defaultdict(lambda: defaultdict(int))
    for x, t in sample:
        if x == language:
            for i in range(len(t)):
                for k in range(min(order, i) + 1):
                    seen[t[i - k : i]][t[i]] += 1
    bits = 0.0
    for i in range(len(text)):
        for k in range(min(order, i), -1, -1):
            c = seen.get(text[i - k : i])
            if c is None:
                continue
            total, distinct = sum(c.values()), len(c)
            if text[i] in c:
                bits -= math.log2(c[text[i]] / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


def test_code_lengths(monkeypatch):
    sample = [("a", b"the cat sat on the mat and the hat"), ("b", "le chat est là sur le tapis".encode()), ("a", b"then they sat"), ("b", b"")]
    texts = [b"", b"the", b"le chat sat on \xff\x00 the tapis", "là".encode(), b"zzz qqq", b"the cat sat " * 40]
    monkeypatch.setattr(L, "PIECE", 37)  # pieces must not change a length
    for order in (1, 4):
        trees = L.ContextTrees(sample, order)
        offsets = np.cumsum([0, *map(len, texts)])
        got = trees.lengths(np.frombuffer(b"".join(texts), np.uint8), offsets)
        want = [[plain_length(sample, x, t, order) for x in trees.languages] for t in texts]
        assert np.allclose(got, want, rtol=1e-5, atol=1e-4)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_cases(spark):
    rows = [(i, "the cat and the hat", "en", 1) for i in range(12)] + [(100 + i, "le chat et le chapeau", "fr", 1) for i in range(12)]
    rows += [(200, None, "en", 1), (201, "", None, 1), (202, "123 --- 456 ½ ²", "fr", 1), (203, "the hat", None, 1), (203, "the hat", None, 1), (None, "le chapeau " * 5000, None, 1)]
    docs = documents(spark, rows)
    model = L.train(docs)
    got = {}
    for r in L.identify(docs, model, ["doc_id", "text"]).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i in (200, 201, 202):
        assert (got[i][0]["lang_pred"], got[i][0]["score"]) == ("und", 0.0)
    assert [r["lang_pred"] for r in got[203]] == ["en", "en"]
    assert got[None][0]["lang_pred"] == "fr" and 0 <= got[None][0]["score"] <= 1
    assert L.identify(docs.limit(0), model, ["doc_id", "text"]).count() == 0
    with pytest.raises(ValueError):
        L.identify(docs, model, ["doc_id", "text", "score"])
    nothing = L.train(docs.where("false"))
    assert {r["lang_pred"] for r in L.identify(docs, nothing, ["doc_id", "text"]).collect()} == {"und"}


def test_training_sees_no_held_out_row(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = documents(spark, [(i, f"secret{i} text", "en", 0) if i in ids else (i, "plain text", "en", 0) for i in range(400)])
    assert all(b"secret" not in t for _, t in L.training_sample(docs, "doc_id", "text", "lang"))
    one = next(i for i in range(9) if i not in ids)
    repeated = documents(spark, [(one, "one row", "en", 0)] * 3000 + [(one, f"text {i}", "en", 0) for i in range(3000)])
    found = L.training_sample(repeated, "doc_id", "text", "lang", per_label=40)
    assert 20 < len(found) <= 40 and len(set(found)) == len(found)
    held = {r["doc_id"] for r in docs.where(L.held_out(docs["doc_id"])).collect()}
    assert held == set(ids)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables aren't here")
def test_held_out_accuracy(spark):
    got = L.op1_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98


def test_languages_with_long_texts_only_are_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "CHARS_PER_DOCUMENT", 50)
    rows = [(i, "the cat and the hat " * 20, "en", 0) for i in range(12)] + [(100 + i, "le chat et le chapeau", "fr", 0) for i in range(12)]
    sample = L.training_sample(documents(spark, rows), "doc_id", "text", "lang")
    assert {x for x, _ in sample} == {"en", "fr"} and max(len(t) for _, t in sample) == 50
    assert len({t for x, t in sample if x == "en"}) > 1  # excerpts begin at several places
