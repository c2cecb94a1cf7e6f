"""Nested group means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GROUP, TRANSITION, ANCHOR = "dependency_group_id", "transition_id", "anchor_observation_id"


def _clean(value: Column) -> Column:
    """NaN is no value: means skip it."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def _levels(frame: DataFrame, values: dict[str, Column], by: list[str], keys: tuple[str, str, str]) -> DataFrame:
    """Means of groups: row -> anchor -> transition -> group, all values in one pass.

    Rows are summed in the map tasks before they are dealt by anchor, and each further level's exchange moves what map tasks have summed
    of the level before: a group that holds most rows is dealt as its anchors, and no exchange but the first sees rows.
    """
    group, transition, anchor = keys
    rows = frame.select(*by, *[F.col(k).alias(f"__{i}") for i, k in enumerate((group, transition, anchor))], *[_clean(v).alias(n) for n, v in values.items()])
    # A map-side sum first: it makes every anchor a few rows, however many rows it has.
    sums = rows.groupBy(*by, "__0", "__1", "__2").agg(
        F.count("*").alias("__rows"), *[F.sum(n).alias(f"{n}__s") for n in values], *[F.count(n).alias(f"{n}__n") for n in values]
    )
    anchors = sums.select(*by, "__0", "__1", "__2", "__rows", *[F.expr(f"try_divide({n}__s, {n}__n)").alias(n) for n in values])
    transitions = anchors.groupBy(*by, "__0", "__1").agg(*[F.avg(n).alias(n) for n in values], F.count("*").alias("__anchors"), F.sum("__rows").alias("__rows"))
    return transitions.groupBy(*by, "__0").agg(
        *[F.avg(n).alias(n) for n in values], F.count("*").alias("__transitions"), F.sum("__anchors").alias("__anchors"), F.sum("__rows").alias("__rows")
    )


def group_means(frame: DataFrame, values: dict[str, Column], keys=(GROUP, TRANSITION, ANCHOR)) -> DataFrame:
    """dependency_group_id and each value's mean in it: the unit of all inference."""
    return _levels(frame, values, [], keys).select(F.col("__0").alias(keys[0]), *values)


def nested_mean(frame: DataFrame, values: dict[str, Column], by: list[str] = [], keys=(GROUP, TRANSITION, ANCHOR)) -> DataFrame:  # noqa: B006
    """A1: the mean over groups of nested means, with counts of groups, transitions, anchors and rows; a row for each `by`.

    Null keys are groups of their own, NaN and null values are skipped. A column that is missing raises; so does `require_rows`
    on a frame without rows.
    """
    if missing := sorted({*keys, *by} - set(frame.columns)):
        raise ValueError(f"missing estimator columns: {missing}")
    out = _levels(frame, values, by, keys).groupBy(*by) if by else _levels(frame, values, by, keys)
    return out.agg(
        *[F.avg(n).alias(n) for n in values],
        F.count("*").alias("groups"),
        F.coalesce(F.sum("__transitions"), F.lit(0)).alias("transitions"),
        F.coalesce(F.sum("__anchors"), F.lit(0)).alias("anchors"),
        F.coalesce(F.sum("__rows"), F.lit(0)).alias("rows"),
    )


def require_rows(frame: DataFrame) -> DataFrame:
    if frame.isEmpty():
        raise ValueError("cannot estimate from zero rows")
    return frame
