"""Base spans against plain regular expressions; the field on made-up lines; cases."""

import hashlib
import random
import re

import numpy as np

from cohortgeo.llm import pii as P


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


CASES = [
    "", "@", "a@b", "a@b.c", "a@b.c@d.e", "x..y@a-b.c-d.e..f", "a@@b.c", "é@b.c", "éa@b.cé", "a@b.c.d@e.f", "@a@b.c", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.3.004", "1234.5.6.7.8", "9.9.9",
    "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "0000000000000000", "41111111111111111111", "+1 (256) 555-4229", "+12", "+1234567", "+12345678", "++1 555 555 5555", "+1 ) 2", "+1-1+2 22222222",
    "a.b%c+d-e_f@mail.example.com, 10.0.0.1; +44 20 7946 0958 4539 1488 0343 6467",
]


def test_base():
    r = random.Random(2)
    cases = CASES + ["".join(r.choice("0123456789.@ -+()ab%é\n") for _ in range(r.randint(1, 80))) for _ in range(4000)]
    for text in cases:
        assert P.base_spans(text) == plain(text), text


def test_base_is_linear():
    import time

    began = time.perf_counter()
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "+1" + " " * 200_000):
        P.base_spans(text)
    assert time.perf_counter() - began < 10


def test_field_labels_held_out_lines():
    f = P.field()
    right = total = 0
    for text, want in P.labelled_lines(200, seed=99):
        w = P.Words(np.frombuffer(text.encode(), np.uint8))
        got = [P.STATES[s] for s in f.decode(f.features(w), np.array([len(want)]))]
        right += sum(a == b for a, b in zip(got, want))
        total += len(want)
    assert right / total > 0.99


def test_viterbi_is_the_best_path():
    """Against all paths, for lines of a few words."""
    from itertools import product

    f = P.field()
    k = len(P.STATES)
    for text in ("pay 4111 1111 1111", "+1 (256)", "x 1.2.3.4 y", "a@b.c"):
        w = P.Words(np.frombuffer(text.encode(), np.uint8))
        feats, n = f.features(w), len(w.begin)
        none = len(f.weights[0]) - 1
        around = np.concatenate([np.full((1, 3), none), feats, np.full((1, 3), none)])
        e = sum(f.weights[p][around[p : p + n]].sum(1) for p in range(3))
        e[0] += f.start
        best = max(product(range(k), repeat=n), key=lambda path: sum(e[i, s] for i, s in enumerate(path)) + sum(f.step[a, b] for a, b in zip(path, path[1:])))
        assert tuple(f.decode(feats, np.array([n]))) == best


def test_added_spans():
    f = P.field()
    texts = ["foo bar +1### (256)*** 555-4229$$$ baz", "", "no data here", "Licensed under the Apache License, Version 2.0.", "été 4444%%% 3333%%% 2222*** 1111&&& fin"]
    raw = [t.encode() for t in texts]
    found = f.spans(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    spans = [P.all_spans(t, P.base_spans(t), s, b) for t, s, b in zip(texts, found, raw)]
    assert [[(k, t[s:e]) for k, s, e in x] for t, x in zip(texts, spans)] == [[("phone", "+1### (256)*** 555-4229")], [], [], [], [("card", "4444%%% 3333%%% 2222*** 1111")]]


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "write to ab.12@mail3.example.com or +1 (256) 555-4229 é"), (3, "write to ab.12@mail3.example.com or +1 (256) 555-4229 é"), (4, "word " * 30_000 + "1.2.3.4"), (None, "4111111111111111")]
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, other int")
    got = P.find_pii(docs, docs.columns, redact=True).collect()
    for r in got:
        base = plain(r["text"] or "")
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(x[0] == k for x in base) for k in P.KINDS]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
        assert not plain(r["redacted"])
    assert {r["redacted"] for r in got if r["doc_id"] == 3} == {"write to [EMAIL] or [PHONE] é"}
    assert P.find_pii(docs.limit(0), ["doc_id", "text"]).count() == 0
