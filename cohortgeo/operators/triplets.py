"""Triplet candidates, feature gathering and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortgeo.functions import vectors as V


def with_norm(features: DataFrame, vector: str = "embedding") -> DataFrame:
    """The vector as doubles and its norm, made once per observation and not once per use."""
    return features.withColumn("v", V.doubles(F.col(vector))).withColumn("n", V.checked_norm(F.col("v")))


def gather(triplets: DataFrame, features: DataFrame, key: str = "observation_id", roles=("anchor", "nuisance", "state")) -> DataFrame:
    """The triplet with v and n of each role, by one equi-join per role."""
    out = triplets
    for role in roles:
        side = features.select(F.col(key).alias(f"{role}_observation_id"), F.col("v").alias(f"{role}_v"), F.col("n").alias(f"{role}_n"))
        out = out.join(side, f"{role}_observation_id")
    return out


def distances(gathered: DataFrame) -> DataFrame:
    """Z3: d_n and d_s."""
    d = lambda role: V.cosine_distance(F.col("anchor_v"), F.col(f"{role}_v"), F.col("anchor_n"), F.col(f"{role}_n"))
    kept = [c for c in gathered.columns if not c.endswith(("_v", "_n"))]
    return gathered.select(*kept, d("nuisance").alias("d_n"), d("state").alias("d_s"))


def candidate_triplets(obs: DataFrame, max_gap: float | None = 2.0) -> DataFrame:
    """For each object, (anchor, nuisance, state) with the anchor's label on the nuisance and another on the state, windows that
    don't overlap, and temporal gaps that match within `max_gap` frames (None: any).

    obs: observation_id, physical_object_id, state_label, start_frame, end_frame. Equi-joins on the object; with max_gap the state is
    looked up by its gap's bucket, so a long track isn't joined with all pairs of its own pairs.
    """
    o = obs.select("observation_id", "physical_object_id", "state_label", "start_frame", "end_frame", ((F.col("start_frame") + F.col("end_frame")) / 2).alias("mid"))
    role = lambda r: o.select("physical_object_id", *[F.col(c).alias(f"{r}_{c}") for c in o.columns if c != "physical_object_id"])
    apart = lambda a, b: (F.col(f"{a}_end_frame") < F.col(f"{b}_start_frame")) | (F.col(f"{b}_end_frame") < F.col(f"{a}_start_frame"))
    gap = lambda b: F.abs(F.col("anchor_mid") - F.col(f"{b}_mid"))
    pairs = role("anchor").join(role("nuisance"), "physical_object_id").where(
        (F.col("anchor_observation_id") != F.col("nuisance_observation_id")) & (F.col("anchor_state_label") == F.col("nuisance_state_label")) & apart("anchor", "nuisance")
    )
    other = role("anchor").join(role("state"), "physical_object_id").where((F.col("anchor_state_label") != F.col("state_state_label")) & apart("anchor", "state"))
    keys = ["physical_object_id", "anchor_observation_id"]
    left = pairs.select(*keys, "nuisance_observation_id", gap("nuisance").alias("gap_n"), "nuisance_start_frame", "nuisance_end_frame")
    right = other.select(*keys, "state_observation_id", gap("state").alias("gap_s"), "state_start_frame", "state_end_frame")
    if max_gap is None:
        joined = left.join(right, keys)
    else:
        width = F.lit(float(max(max_gap, 1.0)))
        left = left.withColumn("cell", F.floor(F.col("gap_n") / width))
        right = right.withColumn("cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("gap_s") / width) + k)))
        joined = left.join(right, [*keys, "cell"]).where(F.abs(F.col("gap_n") - F.col("gap_s")) <= max_gap)
    return joined.where(apart("nuisance", "state")).select(
        "physical_object_id", "anchor_observation_id", "nuisance_observation_id", "state_observation_id", F.abs(F.col("gap_n") - F.col("gap_s")).alias("gap_mismatch")
    )


def eligibility(triplets: DataFrame, base: dict[str, str], confirmatory: dict[str, str] | None = None) -> DataFrame:
    """`eligible_base` is the conjunction of the named SQL conditions, null as false; `confirmatory_eligible` of these and of those of the
    confirmatory analysis."""
    every = lambda c: F.expr(" and ".join(f"coalesce({x}, false)" for x in c.values()) or "true")
    out = triplets.withColumn("eligible_base", every(base))
    return out if confirmatory is None else out.withColumn("confirmatory_eligible", F.col("eligible_base") & every(confirmatory))
