"""Runs of frame labels, windows and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SAMPLES, WINDOW = 16, 30


def label_runs(frames: DataFrame, sequence: str = "sequence_id", frame: str = "frame", label: str = "label") -> DataFrame:
    """Maximal runs of equal labels: sequence, run_index (over all runs), label, start, end (inclusive), length.

    Only run starts are numbered: a frame whose label isn't that of the frame before. Null is a label like any other.
    """
    w = Window.partitionBy(sequence).orderBy(frame)
    before = F.lag(label).over(w)
    starts = frames.select(sequence, frame, label, (~F.col(label).eqNullSafe(before) | F.lag(frame).over(w).isNull()).alias("new"), F.max(frame).over(Window.partitionBy(sequence)).alias("last"))
    runs = starts.where("new")
    return runs.select(
        F.col(sequence),
        (F.row_number().over(w) - 1).alias("run_index"),
        F.col(label),
        F.col(frame).alias("start"),
        F.coalesce(F.lead(frame).over(w) - 1, F.col("last")).alias("end"),
    ).withColumn("length", F.col("end") - F.col("start") + 1)


def centred_windows(runs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The middle `window` frames of every run that has as many."""
    start = F.col("start") + F.floor((F.col("length") - window) / 2).cast("long")
    return runs.where(F.col("length") >= window).select("*", start.alias("start_frame"), (start + window - 1).alias("end_frame"))


def sampled_frames(start: Column, window: int = WINDOW) -> Column:
    """16 of 30 frames, both ends among them; other windows raise, as the rule is made for 30."""
    if window != WINDOW:
        raise ValueError(f"sampling is defined for windows of {WINDOW} frames")
    return F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: start + F.rint(i * (WINDOW - 1) / (SAMPLES - 1)).cast("long"))


def candidates(windows: DataFrame, revision: str, coordinate_space: str = "source") -> DataFrame:
    """Curation candidates: windows with what a curator has to fill in left null."""
    null = lambda kind: F.lit(None).cast(kind)
    return windows.select(
        F.concat_ws("_", F.col("sequence_id").cast("string"), F.concat(F.lit("run"), F.col("run_index"))).alias("observation_id"),
        F.lit(revision).alias("dataset_revision"),
        F.col("sequence_id").cast("string").alias("source_video_id"),
        null("string").alias("physical_object_id"),
        null("string").alias("state_label"),
        F.concat_ws(".", F.col("sequence_id").cast("string"), F.concat(F.lit("run"), F.col("run_index"))).alias("stable_segment_id"),
        "start_frame",
        "end_frame",
        sampled_frames(F.col("start_frame")).alias("sampled_frame_indices"),
        F.lit(30.0).alias("fps"),
        F.lit(False).alias("state_observable"),
        F.lit(False).alias("identity_verified"),
        F.lit(coordinate_space).alias("coordinate_space"),
        F.array().cast("array<string>").alias("nuisance_tags"),
        F.lit("pending").alias("review_status"),
        F.col("label").alias("weak_label"),
        F.lit(True).alias("candidate_only"),
    )


def alignment(videos: DataFrame, labels: DataFrame, sequence: str = "sequence_id") -> DataFrame:
    """videos(sequence, sample_count) against counted label lines; a video without labels has 0 lines."""
    lines = labels.groupBy(sequence).agg(F.count("*").alias("lines"))
    return videos.join(lines, sequence, "left").select(sequence, "sample_count", F.coalesce("lines", F.lit(0)).alias("lines")).withColumn("aligned", F.col("lines") == F.col("sample_count"))


def temporal_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over union of two inclusive frame ranges."""
    both = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0) + 1)
    return both / ((a1 - a0 + 1) + (b1 - b0 + 1) - both)


def chunks(events: DataFrame, ts: str, length: str = "4 seconds", stride: str = "3 seconds") -> DataFrame:
    """Rows by sliding windows."""
    return events.select("*", F.window(ts, length, stride).alias("chunk"))


def horizons(rows: DataFrame, sequence: str, order: str, steps=(1, 2, 4, 8)) -> DataFrame:
    """Each row with the row that is h places later in its sequence, for every h: (.., horizon, target order)."""
    w = Window.partitionBy(sequence).orderBy(order)
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead(order, h).over(w).alias("target")) for h in steps])
    looked = rows.select("*", ahead.alias("__ahead"))
    return looked.select(*rows.columns, F.inline("__ahead")).where("target is not null")


def kappa(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Cohen's kappa of two raters, from the confusion table."""
    cells = pairs.groupBy(F.col(left).alias("l"), F.col(right).alias("r")).count()
    total = cells.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("l").eqNullSafe(F.col("r")), F.col("count")).otherwise(0)).alias("same"))
    a = cells.groupBy("l").agg(F.sum("count").alias("a"))
    b = cells.groupBy("r").agg(F.sum("count").alias("b"))
    chance = a.join(b, a.l.eqNullSafe(b.r)).agg(F.coalesce(F.sum(F.col("a").cast("double") * F.col("b")), F.lit(0.0)).alias("c"))
    po, pe = F.col("same") / F.col("n"), F.col("c") / (F.col("n") * F.col("n"))
    return total.crossJoin(chance).select(po.alias("agreement"), pe.alias("chance"), ((po - pe) / (1 - pe)).alias("kappa"))


def krippendorff(ratings: DataFrame, unit: str, value: str) -> DataFrame:
    """Nominal alpha over any number of ratings per unit; units with one rating don't count, null ratings neither."""
    cells = ratings.where(F.col(value).isNotNull()).groupBy(F.col(unit).alias("u"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    units = cells.groupBy("u").agg(F.sum("n").alias("m")).where("m > 1")
    used = cells.join(units, "u")
    seen = used.agg(F.sum((F.col("m") - F.col("n")) * F.col("n") / (F.col("m") - 1)).alias("o"), F.sum("n").alias("t"))
    values = used.groupBy("v").agg(F.sum("n").alias("c")).agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("sq"))
    t = F.col("t").cast("double")
    return seen.crossJoin(values).select((1 - (F.col("o") / t) / ((t * t - F.col("sq")) / (t * (t - 1)))).alias("alpha"), F.col("t").alias("ratings"))  # one row each


def around(rows: DataFrame, ts: str, centres: DataFrame, centre: str, delta: float) -> DataFrame:
    """Rows within `delta` of each centre, by cells of that width: an equi-join on three cells and not a join of all with all."""
    cells = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col(centre) / delta) + k)
    wide = centres.withColumn("__cell", F.explode(cells))
    return rows.withColumn("__cell", F.floor(F.col(ts) / delta)).join(wide, "__cell").where(F.abs(F.col(ts) - F.col(centre)) <= delta).drop("__cell")
