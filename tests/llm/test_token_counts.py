"""Counts at every prefix against the tokenizers library."""

import os
import random

import pytest

from cohortgeo.llm import token_counts as C

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


TEXTS = [
    "", " ", "a  b \n\n c  ", "<|endoftext|>x  <|endoftext|>  y<|endo", "it's we'll  don't 12 34.5  ", "日本語テキスト 混ぜ é  ñ   z", "a" * 60 + "     " + "=" * 20, "\t\t x \r\n",
    "Thstorti token = \"04dbebab91\" thhantou", "é" * 30, "   mixed​ blanks", "emoji 👩‍👩‍👧 end",
]


def test_every_prefix(library):
    counter = C.PrefixCounts()
    for text in TEXTS:
        table = C.TextTable(counter, text)
        for i in range(len(text) + 1):
            assert table.tokens(i) == library(text[:i]), (text, i)
        assert table.tokens() == library(text)


def test_random_texts(library):
    counter, r = C.PrefixCounts(), random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("etaoin shrdlu ETA'  \n\t.,;0123é日<|>") for _ in range(r.randint(0, 120)))
        assert C.TextTable(counter, text).tokens() == library(text)


CASES = ["it're I've we'll 're''ve !'re", "a!<|endoftext|>b !  <|endoftext|>  !<|endoftext|><|endoftext|>'re", "x\x1c\x1dy  \u3000z\x85q", "", "<|endoftext|>"]


def test_every_prefix_and_budget_of_mixed_texts(library):
    counter, r = C.PrefixCounts(), random.Random(2)
    parts = ["e", "t", "a", "'re", "'", "  ", "\n", "!", "12", "é", "<|endoftext|>", "<|", "日", " "]
    for text in CASES + TEXTS + ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(150)]:
        table = C.TextTable(counter, text)
        counts = [library(text[:i]) for i in range(len(text) + 1)]
        assert [table.tokens(i) for i in range(len(text) + 1)] == counts, text
        for limit in range(max(counts) + 2):
            assert table.longest_prefix(limit) == max(i for i, c in enumerate(counts) if c <= limit), (text, limit)


def test_tables_encode_nothing_again(library, monkeypatch):
    counter = C.PrefixCounts()
    text = "The quick  brown foxes' 12,345 jumps\n\n over lazy dögs. " * 3 + "x" * 200
    table = C.TextTable(counter, text)
    want = [library(text[:i]) for i in range(len(text) + 1)]
    [table.tokens(i) for i in range(len(text) + 1)]
    monkeypatch.setattr(C.PrefixCounts, "at", None)  # whatever is asked now is stored
    assert [table.tokens(i) for i in range(len(text) + 1)] == want


def test_longest_prefix(library):
    text = "The quick brown foxes jumped over 12 lazy dogs. " * 20
    table = C.TextTable(C.PrefixCounts(), text)
    for limit in (0, 1, 17, 100, 10_000):
        n = table.longest_prefix(limit)
        assert library(text[:n]) <= limit and (n == len(text) or table.before[-1] > limit)


def test_caches_that_start_anew(library, monkeypatch):
    monkeypatch.setattr(C, "KEPT_WORDS", 3)
    monkeypatch.setattr(C, "KEPT_PAIRS", 2)
    counter = C.PrefixCounts()
    for text in TEXTS:
        assert sum(counter.counts(text)) == library(text)


def test_rows(spark, library):
    rows = [(1, None, 5), (2, "", 5), (3, "word " * 600, 5), (3, "word " * 600, 5), (None, "<|endoftext|>", 5), (4, "x" * 20_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in C.count_tokens(docs, ["doc_id", "text"]).collect())
    want = sorted((i or 0, len((t or "").encode()), library(t or ""), library(t or "") > 512) for i, t, _ in rows)
    assert got == want
    fit = {r["doc_id"]: r["fit_chars"] for r in C.count_tokens(docs, ["doc_id", "text"], limit=100).collect()}
    assert fit[1] == fit[2] == 0 and library(("word " * 600)[: fit[3]]) <= 100 < library(("word " * 600)[: fit[3] + 1])
    assert library("x" * fit[4]) <= 100 and all(library("x" * n) > 100 for n in range(fit[4] + 1, fit[4] + 40))
    assert C.count_tokens(docs.limit(0), ["doc_id", "text"]).count() == 0
    with pytest.raises(ValueError):
        C.count_tokens(docs.withColumnRenamed("extra", "n_tokens"), ["text", "n_tokens"])
