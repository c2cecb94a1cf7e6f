"""Staged, fail-closed contracts (V1-V7, P10)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortgeo.functions.predicates import is_finite, is_generic_label, is_null, safe_relative_path

#: Column names of the staged tables.
CURATED = (
    "observation_id dataset_revision source_video_id physical_object_id object_category_manual state_family state_label stable_segment_id transition_id media_relpath "
    "media_type start_frame end_frame sampled_frame_indices fps state_observable identity_verified box_annotation_relpath mask_annotation_relpath mask_available "
    "coordinate_space nuisance_tags review_status media_sha256 perceptual_hash duplicate_group_id verified_asset_group_id"
).split()
ANALYSIS = [*CURATED, *"dependency_group_id split motion_backend_id motion_feature_schema_version motion_feature_vector_scaled motion_quality_pass".split()]
NOT_NULL = "observation_id source_video_id physical_object_id object_category_manual state_family state_label stable_segment_id transition_id perceptual_hash duplicate_group_id".split()


class ManifestError(ValueError):
    """A table broke its contract."""


@dataclass(frozen=True)
class Rule:
    name: str
    message: str  # with {n}
    violated: Column


def _bad(requirement: Column) -> Column:
    """Null fails a requirement."""
    return ~F.coalesce(requirement, F.lit(False))


def curated_rules(frame: DataFrame, require_boxes: bool = True) -> list[Rule]:
    """V2's rules in order, each a condition on a row."""
    c, rules = F.col, []
    add = lambda name, message, violated: rules.append(Rule(name, message, F.coalesce(violated, F.lit(False))))
    boolean = lambda n: isinstance(frame.schema[n].dataType, T.BooleanType)
    null = lambda n: is_null(frame, n)
    for n in NOT_NULL:
        add(f"null_{n}", f"{{n}} rows have null {n}", null(n))
    add("generic_state_label", "{n} rows have generic/empty state labels", is_generic_label(c("state_label")))
    for n in ("state_observable", "identity_verified", "mask_available"):
        add(f"non_boolean_{n}", f"{{n}} rows have non-boolean {n}", c(n).isNull() if boolean(n) else F.lit(True))
    for n in ("state_observable", "identity_verified"):
        add(f"not_{n}", f"{{n}} rows fail {n}=true", _bad(c(n)) if boolean(n) else F.lit(True))
    add("not_reviewed", "{n} rows are not approved/adjudicated", _bad(c("review_status").isin("approved", "adjudicated")))
    add("media_type", "{n} rows have invalid media_type", _bad(c("media_type").isin("image", "video")))
    add("no_nuisance_tags", "{n} rows lack nuisance_tags", null("nuisance_tags"))
    if require_boxes:
        add("no_boxes", "{n} rows lack aligned boxes", null("box_annotation_relpath"))
    for n in ("media_relpath", "box_annotation_relpath"):
        add(f"unsafe_{n}", f"{{n}} rows have unsafe/non-POSIX {n}", c(n).isNotNull() & ~safe_relative_path(c(n)))
    add("unsafe_mask", "{n} rows have unsafe mask paths", c("mask_annotation_relpath").isNotNull() & ~safe_relative_path(c("mask_annotation_relpath")))
    add("mask_without_path", "{n} rows declare a mask without a path", c("mask_annotation_relpath").isNull() & (c("mask_available") if boolean("mask_available") else F.lit(False)))
    add("no_coordinate_space", "{n} rows lack coordinate_space", null("coordinate_space"))
    add("frame_interval", "{n} rows have invalid frame intervals", (c("start_frame") < 0) | (c("end_frame") < c("start_frame")))
    fps = c("fps").try_cast("double")
    add("fps", "{n} rows have invalid fps", _bad(is_finite(fps) & (fps > 0)))
    add("media_sha256", "{n} rows have invalid media_sha256", _bad(c("media_sha256").cast("string").rlike("^[0-9a-fA-F]{64}$")))
    s = c("sampled_frame_indices")
    if isinstance(frame.schema["sampled_frame_indices"].dataType, T.ArrayType):
        sound = (F.size(s) == 16) & (F.array_sort(F.array_distinct(s)) == s) & F.forall(s, lambda v: (v >= c("start_frame")) & (v <= c("end_frame")))
    else:
        sound = F.lit(False)
    add("samples", "{n} rows have invalid 16-frame samples", _bad(sound))
    return rules


def duplicate_rows(frame: DataFrame, key: str) -> DataFrame:
    """V1: one row, n: the rows whose key is another row's too (all of them; null equals null)."""
    return frame.groupBy(key).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))


def violations(frame: DataFrame, rules: list[Rule], key: str = "observation_id") -> DataFrame:
    """(rule, n) of all rules, those not broken with 0: one aggregation for all row rules, one more for repeated keys."""
    counts = frame.agg(*[F.count_if(r.violated).alias(r.name) for r in rules])
    long = counts.select(F.inline(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("n")) for r in rules])))
    return duplicate_rows(frame, key).select(F.lit(f"duplicate_{key}").alias("rule"), "n").unionByName(long)


def _missing(frame: DataFrame, columns: Iterable[str]) -> list[str]:
    return [f"missing required column: {n}" for n in sorted(set(columns) - set(frame.columns))]


def validate_curated(frame: DataFrame, require_boxes: bool = True, key: str = "observation_id") -> list[str]:
    """V2: all messages; missing columns end the check before any job runs."""
    if errors := _missing(frame, CURATED):
        return errors
    rules = curated_rules(frame, require_boxes)
    found = {r["rule"]: r["n"] for r in violations(frame, rules, key).collect()}
    out = [f"{found[f'duplicate_{key}']} rows have duplicate {key}"] if found[f"duplicate_{key}"] else []
    return out + [r.message.format(n=found[r.name]) for r in rules if found[r.name]]


def validate_analysis(frame: DataFrame, extra: bool = False) -> list[str]:
    """V3. extra: also the scaled vector and the quality flag, which the stage's columns promise."""
    if errors := _missing(frame, ANALYSIS):
        return errors
    out = validate_curated(frame)
    names = ["dependency_group_id", "motion_backend_id", "motion_feature_schema_version"]
    names += ["motion_feature_vector_scaled", "motion_quality_pass"] if extra else []
    row = frame.agg(F.count_if(_bad(F.col("split").isin("train", "validation", "test"))).alias("split"), *[F.count_if(is_null(frame, n)).alias(n) for n in names]).first()
    out += ["split must be train, validation, or test"] if row["split"] else []
    return out + [f"{row[n]} rows have null {n}" for n in names if row[n]]


def validate_feature_inputs(frame: DataFrame, allowed: Iterable[str], forbidden: Iterable[str] = (), key: str = "observation_id") -> list[str]:
    """V4, P10: a closed set of columns, then repeated ids."""
    allowed, columns = set(allowed), set(frame.columns)
    out = [f"forbidden feature-input column: {c}" for c in sorted(columns & set(forbidden))]
    out += [f"unexpected feature-input column: {c}" for c in sorted(columns - allowed)]
    out += [f"missing feature-input column: {c}" for c in sorted(allowed - columns)]
    n = duplicate_rows(frame, key).first()["n"] if key in columns else 0
    return out + ([f"{n} rows have duplicate {key}"] if n else [])


def raise_on_errors(errors: Iterable[str], context: str) -> None:
    """V5."""
    if errors := list(errors):
        raise ManifestError("\n".join([f"{context} failed closed:", *(f"  - {e}" for e in errors)]))
