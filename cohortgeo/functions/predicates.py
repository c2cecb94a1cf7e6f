"""Scalar predicates (P1-P3, P6, P9-P11) and label parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def is_null(frame: DataFrame, name: str) -> Column:
    """Null, or NaN for floating types; a container is never null for holding nulls."""
    c = F.col(name)
    return c.isNull() | F.isnan(c) if isinstance(frame.schema[name].dataType, (T.FloatType, T.DoubleType)) else c.isNull()


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def safe_relative_path(c: Column) -> Column:
    """A non-empty relative POSIX path without a drive, a backslash or a `..` part; null is not one."""
    ok = (c != "") & ~c.contains("\\") & ~c.rlike("^[A-Za-z]:") & ~c.startswith("/") & ~F.array_contains(F.split(c, "/"), "..")
    return F.coalesce(ok, F.lit(False))


def dataset_root(path: Column, name: str) -> Column:
    """The nearest folder called `name` that a path lies in, or is; null if there is none."""
    found = F.regexp_extract(path, rf"^((?:.*/)?\Q{name}\E)(?:/.*)?$", 1)
    return F.when(found != "", found)


def is_generic_label(c: Column) -> Column:
    """A label that says nothing: empty, before, after, pre, post, state 3, unknown, n/a. Null is the text None and isn't generic."""
    return F.coalesce(c.cast("string").rlike(r"(?i)^(before|after|pre|post|state[_ -]?\d+|unknown|n/?a)?$"), F.lit(False))


def subset_filter(frame: DataFrame, query: str | None) -> DataFrame:
    """Only `mask_available=true` or `=false`; a null flag matches neither; any other text raises."""
    if query is None:
        return frame
    key, _, value = query.partition("=")
    if key.strip().lower() != "mask_available" or value.strip().lower() not in ("true", "false"):
        raise ValueError(f"unsupported subset: {query!r}")
    return frame.where(F.col("mask_available") == F.lit(value.strip().lower() == "true"))


def csv_values(text: str) -> list[str]:
    """P9."""
    return [part.strip() for part in text.split(",") if part.strip()]


def prefix(frame: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in the stated order; n must be positive and the result not empty."""
    if n <= 0:
        raise ValueError("limit must be positive")
    out = frame.orderBy(order).limit(n)
    if out.isEmpty():
        raise ValueError("no row is left")
    return out


def provenance_complete(frame: DataFrame, columns: list[str]) -> bool:
    """All columns are there and no row has a null in any of them."""
    if set(columns) - set(frame.columns):
        return False
    return frame.where(" or ".join(f"`{c}` is null" for c in columns)).isEmpty()


def multilabel(frame: DataFrame, name: str) -> Column:
    """Labels of a column in order, repeats kept: an array's non-empty members, a JSON array in text, or text split at `;`."""
    c = F.col(name)
    if isinstance(frame.schema[name].dataType, T.ArrayType):
        return F.array_sort(F.filter(F.coalesce(c.cast("array<string>"), F.array()), lambda x: x.isNotNull() & (F.trim(x) != "")))
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    parsed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    parts = F.transform(F.split(text, ";"), lambda x: F.trim(x))
    return F.array_sort(F.filter(F.coalesce(parsed, parts), lambda x: x.isNotNull() & (x != "")))


def motion_matched(signed: Column, severity: Column, quality: list[Column], signed_caliper: float, severity_caliper: float) -> Column:
    """Both mismatches within their calipers and all three quality flags true; null counts as false."""
    if len(quality) != 3:
        raise ValueError("quality flags must be those of anchor, nuisance and state")
    ok = (signed <= signed_caliper) & (severity <= severity_caliper) & quality[0] & quality[1] & quality[2]
    return F.coalesce(ok, F.lit(False))
