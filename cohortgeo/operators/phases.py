"""Two-phase observations, reason-coded exclusions and directional triplets (C3: J1-J4, A3-A5, O1, O2)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from cohortgeo.functions import boxes as B

PRE, CONTACT = "pre_contact", "contact"
KEYS = ["sequence_id", "asset_proxy_id"]


def contact_annotations(annotations: DataFrame) -> DataFrame:
    """Object annotations (category 2) with `contacting`: whether their image has a hand (category 1) in contact. Missing is -1."""
    a = annotations.withColumns({"c": F.coalesce(F.col("category_id").try_cast("int"), F.lit(-1)), "touch": F.coalesce(F.col("isincontact").try_cast("int"), F.lit(-1))})
    hands = a.where("c = 1 and touch = 1").select("image_id").distinct().withColumn("contacting", F.lit(True))
    return a.where("c = 2").join(hands, "image_id", "left").withColumn("contacting", F.coalesce("contacting", F.lit(False))).drop("c", "touch")


def attach_images(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotation with its image; an annotation whose image is missing raises."""
    lost = annotations.join(images, annotations.image_id == images.id, "left_anti").limit(1).collect()
    if lost:
        raise KeyError(lost[0]["image_id"])
    return annotations.join(images.withColumnRenamed("id", "image_id"), "image_id")


def reasons(rows: DataFrame, least_mass: float = 1.0, crop: int = B.CROP) -> DataFrame:
    """Adds box (in the crop), mass and `reason`: the first of no_positive_contacting_hand, missing_media, box_outside_encoder_crop,
    box_below_minimum_token_mass that holds, else null. rows: phase, contacting, media_present, x, y, w, h, image_width, image_height."""
    if crop <= 0 or least_mass <= 0:
        raise ValueError("crop size and minimum mass must be positive")
    g = B.crop_geometry(F.col("image_height"), F.col("image_width"), crop)
    boxed = rows.withColumn("box", B.transform_box(*[F.col(c).cast("double") for c in "xywh"], g)).withColumn("mass", B.token_mass(F.col("box")))
    reason = (
        F.when((F.col("phase") == CONTACT) & ~F.col("contacting"), "no_positive_contacting_hand")
        .when(~F.col("media_present"), "missing_media")
        .when(F.col("box").isNull(), "box_outside_encoder_crop")
        .when(F.col("mass") < least_mass, "box_below_minimum_token_mass")
    )
    return boxed.withColumn("reason", reason)


@dataclass(frozen=True)
class PhaseResult:
    observations: DataFrame
    triplets: DataFrame
    exclusions: DataFrame
    conflicts: DataFrame


def build(rows: DataFrame, least: int = 2, canonicalize: bool = False) -> PhaseResult:
    """rows: observation_id, phase, sequence_id, asset_proxy_id, frame_id, media_sha256, and reason (null: usable).

    Hashes that stand under both phases go, then (sequence, asset) keys without `least` observations in each phase. Each key that stays
    gives two triplets, anchored in either phase, of its first two observations of the anchor's phase and the first of the other.
    canonicalize: of the observations of one hash and phase only the first stays (the reference asks for it and doesn't do it).
    """
    if least < 2:
        raise ValueError("triplets need two observations per phase")
    usable = rows.where(F.col("reason").isNull()).drop("reason")
    if canonicalize:
        first = Window.partitionBy("media_sha256", "phase").orderBy("frame_id", "observation_id")
        usable = usable.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    # Equal hashes: two bits per hash, by partial aggregation, and not a set of phases.
    phases = usable.groupBy("media_sha256").agg(F.min("phase").alias("a"), F.max("phase").alias("b"))
    conflicts = phases.where("a <> b").select("media_sha256")
    marked = usable.join(conflicts.withColumn("conflict", F.lit(True)), "media_sha256", "left")
    clean = marked.where("conflict is null").drop("conflict")
    support = clean.groupBy(*KEYS).agg(F.count_if(F.col("phase") == PRE).alias("n_pre"), F.count_if(F.col("phase") == CONTACT).alias("n_contact"))
    eligible = support.where((F.col("n_pre") >= least) & (F.col("n_contact") >= least)).select(*KEYS)
    judged = clean.join(eligible.withColumn("enough", F.lit(True)), KEYS, "left")
    kept = judged.where("enough").drop("enough")
    why = lambda frame, reason: frame.select("phase", "sequence_id", "frame_id", F.lit(reason).alias("reason") if isinstance(reason, str) else reason)
    exclusions = (
        why(rows.where(F.col("reason").isNotNull()), F.col("reason"))
        .unionByName(why(marked.where("conflict"), "cross_phase_exact_duplicate"))
        .unionByName(why(judged.where("enough is null"), "insufficient_phase_support"))
    )
    return PhaseResult(kept, triplets(kept), exclusions, conflicts)


def triplets(kept: DataFrame) -> DataFrame:
    """O2: two triplets per key, ties in frame by observation id."""
    order = Window.partitionBy(*KEYS, "phase").orderBy("frame_id", "observation_id")
    ranked = kept.select(*KEYS, "phase", "observation_id", F.row_number().over(order).alias("rn")).where("rn <= 2")
    at = lambda phase, rn: F.max(F.when((F.col("phase") == phase) & (F.col("rn") == rn), F.col("observation_id")))
    wide = ranked.groupBy(*KEYS).agg(at(PRE, 1).alias("p1"), at(PRE, 2).alias("p2"), at(CONTACT, 1).alias("c1"), at(CONTACT, 2).alias("c2"))
    def side(name: str, a: str, n: str, s: str, anchor: str, target: str):
        return F.struct(
            F.concat_ws("_", F.lit("proxy"), F.col("sequence_id"), F.col("asset_proxy_id"), F.lit(f"{name}_anchor")).alias("triplet_id"),
            F.col(a).alias("anchor_observation_id"), F.col(n).alias("nuisance_observation_id"), F.col(s).alias("state_observation_id"),
            F.lit(anchor).alias("anchor_phase"), F.lit(target).alias("state_target"),
        )
    two = F.array(side("pre", "p1", "p2", "c1", PRE, CONTACT), side("contact", "c1", "c2", "p1", CONTACT, PRE))
    return wide.select(*KEYS, F.explode(two).alias("t")).select("t.*", *KEYS, F.lit("interaction_phase_proxy_not_physical_state").alias("interpretation"))


def summary(result: PhaseResult) -> DataFrame:
    """A5, K9: (kind, name, n) counts of observations by phase, triplets, keys and exclusions by reason."""
    count = lambda frame, kind, name: frame.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return (
        count(result.observations, "phase", F.col("phase"))
        .unionByName(count(result.exclusions, "exclusion", F.col("reason")))
        .unionByName(result.triplets.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("triplets").alias("name"), "n"))
        .unionByName(result.observations.agg(F.count_distinct(*KEYS).alias("n")).select(F.lit("total").alias("kind"), F.lit("eligible_keys").alias("name"), "n"))
        .unionByName(result.conflicts.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("conflict_hashes").alias("name"), "n"))
    )
