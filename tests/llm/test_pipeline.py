"""The pipeline's stages on planted documents, and the registered queries."""

import os
import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def clean(r, n=60):
    return " ".join("".join(r.choice("bcdfglmnrst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture
def tables(spark, tmp_path):
    r = random.Random(8)
    item = clean(r, 30)
    rows = [(i, clean(r), "en" if i % 3 else None) for i in range(40)]
    rows += [(100, rows[4][1], "en"), (101, rows[4][1].rsplit(" ", 1)[0] + " other", "en"), (102, rows[4][1], "en"), (110, None, "en"), (111, "12 34", "en"), (112, clean(r, 20) + " " + item + " " + clean(r, 20), "en")]
    rows += [(120, clean(r, 30) + " write ab.12@mail3.example.com or +1 (256) 555-4229 " + clean(r, 30), "en"), (130, "long " + clean(r, 5000), "en"), (130, "long " + clean(r, 10), "en")]
    docs = spark.createDataFrame([(d, t, x, "s", len(t or "")) for d, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), dict((d, t) for d, t, _ in rows[:40])


def test_stages(spark, tables):
    folder, plain = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, folder)
        assert docs.columns == columns and docs.schema == before.schema
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert set(seen["language_id"]) == {*plain, 100, 101, 102, 112, 120, 130} and all(r["lang"] for r in seen["language_id"].values())
    assert set(seen["near_duplicates"]) >= {*plain, 112, 120, 130} and not set(seen["near_duplicates"]) & {100, 102}
    assert 112 not in seen["decontamination"] and set(plain) <= set(seen["decontamination"])
    last = seen["personal_data"]
    assert re.search(r"write \[EMAIL\] or \[PHONE\] ", last[120]["text"]) and last[120]["n_chars"] == len(last[120]["text"])
    assert all(last[i]["text"] == t for i, t in plain.items())
    packed = pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == set(last)


def test_clashing_columns_nulls_and_empty_tables(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = {c: docs["source"] for c in ("score", "lang_pred", "bits_per_byte", "fp", "fingerprint", "component_id", "n_leaks", "more", "spans", "redacted", "n_email", "id", "b", "a.b", "__c0")}
    wide = docs.withColumns(extra)
    for name, stage in pipeline.STAGES[:-1]:
        plain, got = stage(spark, docs, folder), stage(spark, wide, folder)
        assert got.columns == wide.columns
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in plain.collect()), name
    assert pipeline.STAGES[-1][1](spark, wide, folder).count() >= docs.count()
    empty, nulls = docs.limit(0), spark.createDataFrame([(None,) * 5] * 3, docs.schema)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
    left = [stage(spark, nulls, folder).count() for _, stage in pipeline.STAGES]
    assert left == [0, 1, 3, 3, 3]


def test_names_and_order():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables aren't here")
@pytest.mark.parametrize("n", range(1, 11))
def test_queries_run(spark, n):
    import __spark_entry__ as e

    name = next(q for q in e.queries() if q.startswith(f"op{n}_"))
    rows = e.queries()[name](spark, DATA).collect()
    whole = {5: 25 * 20, 8: 50}.get(n)
    assert len(rows) == whole if whole else len(rows) >= (1 if n == 4 else 200)
