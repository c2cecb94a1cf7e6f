"""A training corpus from `documents`, stage by stage: run(spark, sf_dir).

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns that they got.
Rows are written as Parquet to the shared folder between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortgeo.llm import decontaminate, language_id, packing, pii, similar
from cohortgeo.sources.shared import materialize

#: A prediction of less is no prediction.
LEAST_SCORE = 0.5


class _Placed:
    """The table with its columns named by place, so that no column of it, whatever its name, meets one that an operator makes."""

    def __init__(self, docs: DataFrame):
        self.given = docs.columns
        self.names = [f"__c{i}" for i in range(len(self.given))]
        self.docs = docs.toDF(*self.names)

    def __getitem__(self, name: str) -> str:
        return self.names[self.given.index(name)]

    def back(self, out: DataFrame) -> DataFrame:
        return out.select(*self.names).toDF(*self.given)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go whose text is null or has no letter, or whose language isn't told (score under LEAST_SCORE); a null `lang` is filled in.
    Without any labelled row no language is known, and all rows go."""
    t = _Placed(docs)
    model = language_id.train(t.docs, t["doc_id"], t["text"], t["lang"])
    found = language_id.identify(t.docs, model, t.names, t["text"])
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return t.back(kept.withColumn(t["lang"], F.coalesce(t["lang"], "lang_pred")))


#: Marks of so many rows are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _without(docs: DataFrame, marks: DataFrame, on: list, how: str) -> DataFrame:
    """docs joined with the marks of rows, which are in the shared folder; no text leaves its place unless the marks are very many."""
    return docs.join(F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks, on, how)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates share 0.8 or more of their shingles of five words. Of each group of them the document of the smallest id stays; of rows equal in id and text, one. Rows of one id and
    different texts stay together if any of them is the first of its group. Rows without an id stay if no document with an id is in a group
    of theirs or of others without one; of equal ones among them, one. An empty table stays empty."""
    t = _Placed(docs)
    i = F.col(t["doc_id"])
    marked = materialize(similar.near_copies(t.docs, t["doc_id"], t["text"]).toDF("id", "mark", "component"))
    first = marked.where(F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("first")).distinct()
    gone = materialize(marked.join(first, F.col("id").eqNullSafe(F.col("first")), "left_anti").select("id", "mark").distinct())
    again = materialize(marked.groupBy("id", "mark").count().where("count > 1").select("id", "mark"))
    rows = t.docs.withColumn("__mark", F.xxhash64(t["doc_id"], t["text"]))
    same = [F.col("__mark") == F.col("mark"), i.eqNullSafe(F.col("id"))]
    left = _without(rows, gone, same, "left_anti")
    once = _without(left, again, same, "left_anti")
    repeated = _without(left, again, same, "left_semi").dropDuplicates([t["doc_id"], t["text"]])
    return t.back(once.unionByName(repeated))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; a null text holds none."""
    t = _Placed(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return t.back(decontaminate.mark_leaks(t.docs, benchmark, t.names, t["text"]).where("n_leaks = 0"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind; all documents stay, n_chars is counted anew where the text changed. Null texts
    stay null."""
    t = _Placed(docs)
    found = pii.find_pii(t.docs, t.names, t["text"], redact=True)
    changed = F.col("spans") != ""
    n = F.length("redacted").cast(t.docs.schema[t["n_chars"]].dataType)
    return t.back(
        found.withColumns({t["n_chars"]: F.when(changed, n).otherwise(F.col(t["n_chars"])), t["text"]: F.when(changed, F.col("redacted")).otherwise(F.col(t["text"]))})
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document and its place in a sequence; a null text is the one id that closes a document."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: Byte trees, random walks and fields are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
