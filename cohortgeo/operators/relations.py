"""Joins and searches with conditions: one-to-one joins, shared file names, numeric order, backoff, constrained search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortgeo.functions import vectors as V
from cohortgeo.operators.motion import running_count
from cohortgeo.operators.validation import ManifestError


def one_to_one(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """The inner join of all parts; a part whose key is null or repeated raises."""
    out = None
    for name, part in parts.items():
        if not part.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
            raise ManifestError(f"{key} of {name} must be there and unique")
        out = part if out is None else out.join(part, key)
    return out


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def common_names(left: DataFrame, right: DataFrame, path: str = "path") -> DataFrame:
    """(name) of the files that stand under both roots, whatever their folders."""
    return left.select(file_name(F.col(path)).alias("name")).intersect(right.select(file_name(F.col(path)).alias("name")))


def numeric_positions(files: DataFrame, path: str = "path") -> DataFrame:
    """O3: `number`, the last digits of a file's name without its suffix, and `position`, how many distinct numbers are smaller: 2 comes
    before 10. Names without a digit go."""
    stem = F.regexp_replace(file_name(F.col(path)), r"\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"(\d+)\D*$", 1)
    numbered = files.withColumn("number", F.when(digits != "", digits.cast("decimal(38,0)"))).where("number is not null")
    places = running_count(numbered.select("number").distinct().withColumn("__n", F.lit(1)), "number", "__n")
    return numbered.join(places.select("number", F.col("before").cast("long").alias("position")), "number")


def backoff_baseline(train: DataFrame, rows: DataFrame, levels: list[list[str]], label: str) -> DataFrame:
    """The most frequent training label (ties: the smallest) of the first level that training has for a row, at last of all rows."""
    out, picks = rows, []
    for k, keys in enumerate([*levels, []]):
        counts = train.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("__n"))
        top = F.min(F.struct((-F.col("__n")).alias("n"), F.col(label).alias("y")))
        best = counts.groupBy(*keys).agg(top.alias("__t")).select(*keys, F.col("__t.y").alias(f"__p{k}"))
        out = out.join(best, keys, "left") if keys else out.crossJoin(F.broadcast(best))  # one row
        picks.append(f"__p{k}")
    return out.withColumn("predicted", F.coalesce(*picks)).drop(*picks)


def constrained_search(queries: DataFrame, gallery: DataFrame, on: list[str], key: str, vector: str, k: int) -> DataFrame:
    """Of the gallery rows that share a query's columns `on`, the k of largest inner product, ties to the smaller key: the constraint
    first, as an equi-join, then the exact ranking. A query never meets itself."""
    q = queries.select(*on, F.col(key).alias("query_id"), V.doubles(F.col(vector)).alias("q"))
    g = gallery.select(*on, F.col(key).alias("match_id"), V.doubles(F.col(vector)).alias("g"))
    scored = q.join(g, on).where("query_id <> match_id").select("query_id", "match_id", V.dot(F.col("q"), F.col("g")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def metadata_filter(rows: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Rows whose columns lie in [low, high]; None leaves an end open, null fails."""
    for name, (low, high) in bounds.items():
        rows = rows if low is None else rows.where(F.col(name) >= F.lit(low))
        rows = rows if high is None else rows.where(F.col(name) <= F.lit(high))
    return rows
