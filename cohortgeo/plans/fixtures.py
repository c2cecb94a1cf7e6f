"""Views of the test tables in the engine's terms, as DataFrames and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortgeo.functions import boxes as B
from cohortgeo.operators import triplets as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature cache: observation_id, label, v, n."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("observation_id"), "label", "embedding")
    return T.with_norm(e)


def trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets: the next vector of the label is the nuisance, the next id of another label the state."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    n = e.agg(F.count("*").alias("n"))
    a = e.withColumn("nid", F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id"))).where("nid is not null").crossJoin(F.broadcast(n))  # one row
    s = e.select(F.col("vec_id").alias("sid"), F.col("label").alias("slabel"))
    joined = a.withColumn("sid", (F.col("vec_id") + 1) % F.col("n")).join(s, "sid").where("slabel <> label")
    return joined.select(
        F.col("vec_id").alias("anchor_observation_id"), F.col("nid").alias("nuisance_observation_id"), F.col("sid").alias("state_observation_id"),
        F.col("label").alias("dependency_group_id"), (F.col("vec_id") % 7).alias("transition_id"),
    )


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.distances(T.gather(trip(spark, sf_dir), feat(spark, sf_dir)))


FEAT = "feat as (select vec_id observation_id, label, embedding::double[] v from embeddings)"
TRIP = """e0 as (select vec_id, label, lead(vec_id) over (partition by label order by vec_id) nid from embeddings),
n0 as (select count(*) n from embeddings),
trip as (select a.vec_id anchor_observation_id, a.nid nuisance_observation_id, s.vec_id state_observation_id, a.label dependency_group_id, a.vec_id % 7 transition_id
         from e0 a cross join n0 join e0 s on s.vec_id = (a.vec_id + 1) % n0.n and s.label <> a.label where a.nid is not null)"""
DIST = f"""{FEAT}, {TRIP},
dist as (select t.*, list_cosine_distance(a.v, b.v) d_n, list_cosine_distance(a.v, s.v) d_s
         from trip t join feat a on a.observation_id = t.anchor_observation_id join feat b on b.observation_id = t.nuisance_observation_id
         join feat s on s.observation_id = t.state_observation_id)"""


def nested_sql(values: dict[str, str], by: str = "") -> str:
    """CTEs nested_a, nested_t, nested_g over `dist` (or a table x): means of means."""
    b = f"{by}, " if by else ""
    mean = ", ".join(f"avg({n}) {n}" for n in values)
    return f"""rows_ as (select {b}dependency_group_id g, transition_id t, anchor_observation_id a, {", ".join(f"{v} as {n}" for n, v in values.items())} from x),
na as (select {b}g, t, a, {mean}, count(*) r from rows_ group by {b}g, t, a),
nt as (select {b}g, t, {mean}, count(*) a, sum(r) r from na group by {b}g, t),
ng as (select {b}g, {mean}, count(*) t, sum(a) a, sum(r) r from nt group by {b}g),
nested as (select {b}{mean}, count(*) groups, sum(t)::bigint transitions, sum(a)::bigint anchors, sum(r)::bigint as rows from ng {"group by " + by if by else ""})"""


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion descriptors: four coordinates and a constant one."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("observation_id"), F.concat(F.slice(F.col("embedding").cast("array<double>"), 1, 4), F.array(F.lit(1.0))).alias("m"), (F.col("vec_id") % 11 != 0).alias("quality"))


MOTION = "motion as (select vec_id observation_id, list_append(embedding[1:4]::double[], 1.0::double) m, vec_id % 11 <> 0 quality from embeddings)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("sequence_id"), F.col("event_type").alias("label"), (F.row_number().over(w) - 1).alias("frame"))


FRAMES = "frames as (select user_id sequence_id, event_type label, row_number() over (partition by user_id order by ts, event_id) - 1 frame from events)"


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-phase observations with boxes and reasons left to the operator."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(
        F.col("event_id").cast("string").alias("observation_id"), F.col("user_id").cast("string").alias("sequence_id"), (k % 5).cast("string").alias("asset_proxy_id"),
        (F.row_number().over(w) - 1).alias("frame_id"), F.when(F.col("event_type") == "view", "pre_contact").when(F.col("event_type") == "purchase", "contact").alias("phase"),
        F.sha2(F.concat_ws("-", F.col("user_id").cast("string"), k.cast("string")), 256).alias("media_sha256"),
    )
    return rows.where("phase is not null").withColumn("reason", F.lit(None).cast("string"))


PHASES = """ph as (select event_id::varchar observation_id, user_id::varchar sequence_id, ((json_extract(props,'$.k')::bigint) % 5)::varchar asset_proxy_id,
  row_number() over (partition by user_id order by ts, event_id) - 1 frame_id,
  case event_type when 'view' then 'pre_contact' when 'purchase' then 'contact' end phase,
  sha256(user_id::varchar || '-' || (json_extract(props,'$.k')::bigint)::varchar) media_sha256 from events),
phase as (select * from ph where phase is not null),
conf as (select media_sha256 from phase group by 1 having count(distinct phase) > 1),
clean as (select * from phase where media_sha256 not in (select media_sha256 from conf)),
elig as (select sequence_id, asset_proxy_id from clean group by 1, 2 having count(*) filter (phase = 'pre_contact') >= 2 and count(*) filter (phase = 'contact') >= 2),
kept as (select c.* from clean c join elig using (sequence_id, asset_proxy_id))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        p.alias("id"), (p * 37 % 1240).cast("double").alias("x"), (p * 53 % 690).cast("double").alias("y"), (F.col("p_size") * 4).cast("double").alias("w"), (F.col("p_size") * 3).cast("double").alias("h")
    )
    g = B.crop_geometry(F.lit(720), F.lit(1280))
    return rows.withColumn("box", B.transform_box(*[F.col(c) for c in "xywh"], g)).withColumn("mass", B.token_mass(F.col("box")))


BOXES = """b0 as (select p_partkey id, ((p_partkey*37)%1240)::double x, ((p_partkey*53)%690)::double y, (p_size*4)::double w, (p_size*3)::double h from part),
b1 as (select id, w, h, greatest(0.0::double, least(384.0::double, x * (778.0::double/1280.0) - 197.0)) x0, greatest(0.0::double, least(384.0::double, y * (438.0::double/720.0) - 27.0)) y0,
  greatest(0.0::double, least(384.0::double, (x + w) * (778.0::double/1280.0) - 197.0)) x1, greatest(0.0::double, least(384.0::double, (y + h) * (438.0::double/720.0) - 27.0)) y1 from b0),
box as (select id, x0 x, y0 y, x1 - x0 w, y1 - y0 h, w > 0 and h > 0 and x1 > x0 and y1 > y0 inside from b1),
mass as (select *, case when inside then (ceil(x + w) - floor(x)) * (ceil(y + h) - floor(y)) / 256.0::double end mass from box)"""


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i, F.sha2("text", 256).alias("h"), F.when(i % 3 == 0, F.floor(i / 6)).alias("v"), F.when(i % 5 == 0, F.concat("lang", (i % 40).cast("string"))).alias("a"), F.col("lang")
    )


DEPS = "deps as (select doc_id, sha256(text) h, case when doc_id%3=0 then doc_id//6 end v, case when doc_id%5=0 then lang||(doc_id%40) end a, lang from documents)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as curated observations: some rules hold, others are broken at known ids."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    i = F.col("doc_id")
    null = F.lit(None).cast("string")
    text = lambda p: F.concat(F.lit(p), i.cast("string"))
    return d.select(
        F.when(i % 97 == 5, F.lit("o1")).otherwise(text("o")).alias("observation_id"), F.lit("rev").alias("dataset_revision"), F.when(i % 31 != 0, F.col("source")).alias("source_video_id"),
        text("p").alias("physical_object_id"), F.lit("door").alias("object_category_manual"), F.lit("open_closed").alias("state_family"),
        F.when(i % 17 == 0, "before").when(i % 19 == 0, "State-3").otherwise(F.col("lang")).alias("state_label"), text("s").alias("stable_segment_id"), F.when(i % 23 != 0, text("t")).alias("transition_id"),
        F.when(i % 29 == 0, F.lit("C:\\data\\v.mp4")).when(i % 37 == 0, F.lit("../v.mp4")).otherwise(F.concat(F.lit("data/"), i.cast("string"), F.lit(".mp4"))).alias("media_relpath"),
        F.when(i % 41 == 0, "audio").otherwise("video").alias("media_type"), (i % 50 - 1).alias("start_frame"), (i % 50 + 28).alias("end_frame"),
        F.when(i % 13 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.transform(F.array(*map(F.lit, (0, 2, 4, 6, 8, 10, 12, 14, 15, 17, 19, 21, 23, 25, 27, 29))), lambda k: (k + i % 50 - 1).cast("int"))).alias("sampled_frame_indices"),
        F.when(i % 43 == 0, F.lit(0.0)).otherwise(F.lit(30.0)).alias("fps"), (i % 47 != 0).alias("state_observable"), F.when(i % 53 != 0, F.lit(True)).alias("identity_verified"),
        F.when(i % 59 != 0, F.lit("annotations/b.json")).alias("box_annotation_relpath"), F.when(i % 2 == 0, F.lit("annotations/m.json")).alias("mask_annotation_relpath"), (i % 4 < 2).alias("mask_available"),
        F.when(i % 61 != 0, F.lit("source")).alias("coordinate_space"), F.array(F.lit("viewpoint")).alias("nuisance_tags"), F.when(i % 7 == 0, "pending").otherwise("approved").alias("review_status"),
        F.when(i % 67 == 0, F.lit("xyz")).otherwise(F.sha2(i.cast("string"), 256)).alias("media_sha256"), text("ph").alias("perceptual_hash"), text("dup").alias("duplicate_group_id"), null.alias("verified_asset_group_id"),
        F.when(i % 20 < 14, "train").when(i % 20 < 17, "validation").otherwise("test").alias("split"), i.alias("doc_id"),
    )


#: Rows that break each rule of the observations above, as conditions on doc_id.
OBSERVATION_RULES = {
    "null_observation_id": "false", "null_source_video_id": "doc_id%31=0", "null_physical_object_id": "false", "null_object_category_manual": "false", "null_state_family": "false",
    "null_state_label": "doc_id%17<>0 and doc_id%19<>0 and lang is null", "null_stable_segment_id": "false", "null_transition_id": "doc_id%23=0", "null_perceptual_hash": "false", "null_duplicate_group_id": "false",
    "generic_state_label": "doc_id%17=0 or doc_id%19=0", "non_boolean_state_observable": "false", "non_boolean_identity_verified": "doc_id%53=0", "non_boolean_mask_available": "false",
    "not_state_observable": "doc_id%47=0", "not_identity_verified": "doc_id%53=0", "not_reviewed": "doc_id%7=0", "media_type": "doc_id%41=0", "no_nuisance_tags": "false", "no_boxes": "doc_id%59=0",
    "unsafe_media_relpath": "doc_id%29=0 or doc_id%37=0", "unsafe_box_annotation_relpath": "false", "unsafe_mask": "false", "mask_without_path": "doc_id%4=1", "no_coordinate_space": "doc_id%61=0",
    "frame_interval": "doc_id%50=0", "fps": "doc_id%43=0", "media_sha256": "doc_id%67=0", "samples": "doc_id%13=0",
}
