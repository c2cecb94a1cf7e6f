"""Canonical forms, and the query's SQL."""

import os
import re

import duckdb
import pytest

from cohortgeo.llm import licenses as Z
from cohortgeo.llm.license_texts import KNOWN


def test_forms(spark):
    text = dict(reversed(KNOWN))
    mit = text["MIT"]
    head, _, body = mit.partition("Permission")
    body = f"Permission{body}".upper().replace(" ", "\n  ", 40)  # the body's lines may break anywhere, a holder's line is one line
    changed = re.sub(r"Copyright.*", "COPYRIGHT (C) 2019-2024, Some One <a@b.c>\nCopyright 2020 Other\nAll rights reserved.", head) + body
    rows = [
        (1, mit), (2, changed), (3, mit.replace("license", "licence").replace('"', "''")), (4, mit + " More."), (5, None), (6, ""), (7, " ... "), (8, "Copyright 2020 X"), (9, mit[:-30]), (10, mit),
        (11, "# " + text["Apache-2.0-line"] + "\n"), (12, text["BSD-3-Clause"].replace("copyright holder", "copyright owner")), (None, text["ISC"]), (13, "word " * 50_000),
    ]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, other string")
    got = {r["doc_id"]: r["license"] for r in Z.scan(docs, ["doc_id"]).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None, 7: None, 8: None, 9: None, 10: "MIT", 11: "Apache-2.0-line", 12: "BSD-3-Clause", None: "ISC", 13: None}
    assert Z.scan(docs.limit(0), ["doc_id"]).count() == 0
    con = duckdb.connect()
    table = docs.toPandas()
    con.register("documents", table)
    want = {(r[0], r[1], r[2]) for r in con.execute(Z.oracle()).fetchall()}
    assert {(r["doc_id"], r["digest"], r["license"]) for r in Z.scan(docs, ["doc_id"]).collect() if r["doc_id"]} == {w for w in want if w[0] is not None and w[0] == w[0]}


def test_known_texts_are_apart(spark):
    rows = spark.createDataFrame(list(KNOWN), "license string, text string")
    found = Z.scan(rows.withColumnRenamed("license", "own"), ["own"]).collect()
    assert all(r["own"] == r["license"] for r in found)


WHOLE = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.exists(f"{WHOLE}/Apache-2.0"), reason="no licence files here")
def test_whole_licence_files(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0-Perl"}
    rows = [(n, open(f"{WHOLE}/{f}", encoding="utf-8").read()) for f, n in files.items() if os.path.exists(f"{WHOLE}/{f}")]
    rows += [(n, t.upper().replace("\n", "\r\n\n")) for n, t in rows] + [(None, t[:-200]) for _, t in rows]
    found = Z.scan(spark.createDataFrame(rows, "own string, text string"), ["own"]).collect()
    assert all(r["own"] == r["license"] for r in found) and len(found) == len(rows)


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = Z.scan(docs, ["doc_id"])._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
