"""Queries of sources, sinks, contracts, controls and losses, each with its SQL. Files that a query reads are written to the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortgeo.functions import predicates as P, vectors as V
from cohortgeo.operators import evaluation, inference, linalg, motion, nested, phases, pooling, predict, relations, triplets, validation
from cohortgeo.plans import fixtures as X
from cohortgeo.plans.catalogue import _GRID, _MISMATCH, _PREDICTED, _SCORE, _control_distances, _mismatch, _role_pairs, _score
from cohortgeo.plans.registry import query, r9
from cohortgeo.sources import release, store, tables
from cohortgeo.sources.shared import shared_folder


def _place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}-{name}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


# ---- tables and documents


@query("select s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) s_acctbal from supplier")
def table_csv(spark, sf_dir):
    path = _place(spark, "supplier.csv")
    X.table(spark, sf_dir, "supplier").write.csv(path, header=True)
    t = tables.read_table(spark, path)
    return t.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"), F.round("s_acctbal", 2).alias("s_acctbal"))


@query("select n_nationkey, n_name, n_regionkey from nation")
def table_parquet(spark, sf_dir):
    path = _place(spark, "nation.parquet")
    X.table(spark, sf_dir, "nation").write.parquet(path)
    return tables.read_table(spark, path)


#: Annotation documents of 100 parts each: images (every seventh listed twice), hands and objects, boxes and outlines of several kinds.
COCO = """part0 as (select p_partkey p, p_partkey // 100 doc, p_size s from part),
img as (select p, p::varchar id, 'v' || (p % 9) || '_' || p || '.jpg' file_name from part0),
ann as (select p, 'o' || p id, p::varchar image_id, '2' category_id, ((p*37)%1240)::double x, ((p*53)%690)::double y, (s*4)::double w, (s*3)::double h, p % 4 outline, null::varchar contact from part0
  union all select p, 'h' || p, (case when p % 13 = 0 then 'gone' || p else p::varchar end), '1', 1, 1, case when p % 17 = 0 then 0 else 5 end, 5, 0, (p % 2)::varchar from part0 where p % 3 <> 0)"""


def _coco(spark, sf_dir) -> str:
    p = F.col("p_partkey")
    d = lambda c: c.cast("double")
    outline = F.when(p % 4 == 0, F.expr("array(array(0D,0D,9D,0D,9D,9D))")).when(p % 4 == 1, F.expr("array(array(0D,0D,9D,0D))")).when(
        p % 4 == 2, F.expr("array(array(0D,0D,9D,0D,9D,9D), array(1D,1D))")
    ).otherwise(F.expr("cast(array() as array<array<double>>)"))
    key = p.cast("string")
    image = F.struct(key.alias("id"), F.concat(F.lit("v"), (p % 9).cast("string"), F.lit("_"), key, F.lit(".jpg")).alias("file_name"), F.lit(1280.0).alias("width"), F.lit(720.0).alias("height"))
    old = F.struct(key.alias("id"), F.lit("old.jpg").alias("file_name"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"))
    thing = F.struct(
        F.concat(F.lit("o"), key).alias("id"), key.alias("image_id"), F.lit("2").alias("category_id"), F.array(d(p * 37 % 1240), d(p * 53 % 690), d(F.col("p_size") * 4), d(F.col("p_size") * 3)).alias("bbox"),
        outline.alias("segmentation"), F.lit(None).cast("string").alias("isincontact"),
    )
    hand = F.struct(
        F.concat(F.lit("h"), key).alias("id"), F.when(p % 13 == 0, F.concat(F.lit("gone"), key)).otherwise(key).alias("image_id"), F.lit("1").alias("category_id"),
        F.array(F.lit(1.0), F.lit(1.0), F.when(p % 17 == 0, 0.0).otherwise(5.0), F.lit(5.0)).alias("bbox"), F.expr("array(array(0D,0D,9D,0D,9D,9D))").alias("segmentation"), (p % 2).cast("string").alias("isincontact"),
    )
    rows = X.table(spark, sf_dir, "part").select(
        F.floor(p / 100).alias("doc"), F.when(p % 7 == 0, F.array(old, image)).otherwise(F.array(image)).alias("i"), F.when(p % 3 != 0, F.array(thing, hand)).otherwise(F.array(thing)).alias("a")
    )
    docs = rows.groupBy("doc").agg(  # 100 parts at most
        F.to_json(F.struct(F.flatten(F.collect_list("i")).alias("images"), F.flatten(F.collect_list("a")).alias("annotations"))).alias("value")
    )
    path = _place(spark, "coco")
    docs.select("value").write.text(path)
    return path


@query(f"with {COCO} select id, file_name from img")
def coco_images(spark, sf_dir):
    return tables.read_coco(spark, _coco(spark, sf_dir), lines=True)[0].select("id", "file_name")


@query(f"with {COCO} select id, image_id, category_id, x, y, w, h, case outline when 0 then 1 when 2 then 1 else 0 end polygons from ann")
def coco_annotations(spark, sf_dir):
    a = tables.read_coco(spark, _coco(spark, sf_dir), lines=True)[1]
    return a.select("id", "image_id", "category_id", *[F.col("bbox")[i].alias(c) for i, c in enumerate("xywh")], F.size("polygons").alias("polygons"))


@query(
    f"""with {COCO} select (select count(*) + (select count(*) from part0 where p % 7 = 0) from img)::bigint images, count(*) annotations, count(distinct category_id) categories,
count(*) filter (not (w > 0 and h > 0)) bad_boxes, (count(*) filter (category_id = '2' and outline in (1, 2)))::bigint bad_components, count(*) filter (category_id = '2' and outline = 1) no_valid_component,
count(*) filter (image_id not in (select id from img)) missing_images from ann"""
)
def coco_counts(spark, sf_dir):
    return tables.coco_summary(spark, _coco(spark, sf_dir), lines=True)


@query(f"with {COCO}, hand as (select distinct image_id from ann where category_id = '1' and contact = '1') select a.id, i.file_name, h.image_id is not null contacting from ann a join img i on i.id = a.image_id left join hand h on h.image_id = a.image_id where category_id = '2'")
def contact_annotations(spark, sf_dir):
    images, annotations = tables.read_coco(spark, _coco(spark, sf_dir), lines=True)
    return phases.attach_images(phases.contact_annotations(annotations), images.select("id", "file_name")).select("id", "file_name", "contacting")


_REASONS = f"""{COCO}, {X.BOXES}, hand as (select distinct image_id from ann where category_id = '1' and contact = '1'),
why as (select m.id, case when m.id % 2 = 0 then 'contact' else 'pre_contact' end phase, h.image_id is not null contacting, m.id % 11 <> 0 present, m.inside, m.mass from mass m left join hand h on h.image_id = m.id::varchar),
reason as (select id, phase, case when phase = 'contact' and not contacting then 'no_positive_contacting_hand' when not present then 'missing_media' when not inside then 'box_outside_encoder_crop'
  when mass < 1 then 'box_below_minimum_token_mass' end reason from why)"""


def _reasons(spark, sf_dir) -> DataFrame:
    images, annotations = tables.read_coco(spark, _coco(spark, sf_dir), lines=True)
    found = phases.attach_images(phases.contact_annotations(annotations), images)
    i = F.substring("id", 2, 18).cast("long")
    rows = found.select(
        i.alias("id"), "contacting", (i % 11 != 0).alias("media_present"), F.when(i % 2 == 0, "contact").otherwise("pre_contact").alias("phase"), F.col("height").alias("image_height"), F.col("width").alias("image_width"),
        *[F.col("bbox")[k].alias(c) for k, c in enumerate("xywh")],
    )
    return phases.reasons(rows)


@query(f"with {_REASONS} select * from reason")
def phase_reasons(spark, sf_dir):
    return _reasons(spark, sf_dir).select("id", "phase", "reason")


_BUILT = f"""{_REASONS}, r as (select *, (id // 40)::varchar s, (id % 2)::varchar dup from reason), ok as (select * from r where reason is null),
c as (select s from ok group by s having count(*) filter (phase = 'pre_contact') >= 2 and count(*) filter (phase = 'contact') >= 2)"""


@query(f"with {_BUILT} select reason, count(*) n from (select reason from r where reason is not null union all select 'insufficient_phase_support' from ok anti join c using (s)) group by 1 union all select 'kept', count(*) from ok semi join c using (s)")
def phase_exclusion_reasons(spark, sf_dir):
    rows = _reasons(spark, sf_dir)
    i = F.col("id")
    shaped = rows.select(
        i.cast("string").alias("observation_id"), "phase", F.floor(i / 40).cast("string").alias("sequence_id"), F.lit("a").alias("asset_proxy_id"), i.alias("frame_id"), F.sha2(i.cast("string"), 256).alias("media_sha256"), "reason"
    )
    built = phases.build(shaped)
    why = built.exclusions.groupBy("reason").agg(F.count("*").alias("n"))
    return why.unionByName(built.observations.agg(F.count("*").alias("n")).select(F.lit("kept").alias("reason"), "n"))


@query("select 'rev' || n_regionkey revision, count(*) files from nation group by 1")
def metadata_revision_counts(spark, sf_dir):
    n = X.table(spark, sf_dir, "nation")
    head = n.select("n_nationkey", F.lit(0).alias("line"), F.concat(F.lit(" rev"), "n_regionkey").alias("value"))
    files = head.unionByName(n.select("n_nationkey", F.lit(1).alias("line"), F.col("n_name").alias("value")))
    path = _place(spark, "metadata")
    files.repartition("n_nationkey").sortWithinPartitions("n_nationkey", "line").select("n_nationkey", "value").write.partitionBy("n_nationkey").text(path)
    return tables.metadata_revisions(spark, [path])


_ANNOTATED = """a as (select n_nationkey k, case n_nationkey % 3 when 0 then 'obs' || n_nationkey end observation_id, case n_nationkey % 3 when 2 then 2 else 1 end boxes, case n_nationkey % 3 when 0 then 1 else 0 end polygons from nation)"""


@query(f"with {_ANNOTATED} select k, observation_id, boxes, polygons from a")
def annotation_files(spark, sf_dir):
    n = X.table(spark, sf_dir, "nation").select("n_nationkey")
    k = F.col("n_nationkey")
    value = F.when(k % 3 == 0, F.concat(F.lit('{"observations": {"obs'), k.cast("string"), F.lit('": {"boxes_xywh": [[1,2,3,4]], "polygons_by_frame": [[[0,0,9,0,9,9]]]}}}'))).when(
        k % 3 == 1, F.lit('{"boxes_xywh": [[1,2,3,4]]}')
    ).otherwise(F.lit("[[1,2,3,4],[5,6,7,8]]"))
    path = _place(spark, "annotations")
    n.select("n_nationkey", value.alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = tables.read_annotations(spark, path)
    return found.select(
        F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("k"), "observation_id", F.size("boxes_xywh").alias("boxes"), F.coalesce(F.size("polygons_by_frame"), F.lit(0)).alias("polygons")
    ).withColumn("polygons", F.greatest("polygons", F.lit(0)))


@query("select p_partkey id, case when p_partkey % 2 = 0 then p_partkey::double else 7.0::double end first from part")
def observation_boxes(spark, sf_dir):
    p = F.col("p_partkey")
    own = F.when(p % 2 == 0, F.array(p.cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    return X.table(spark, sf_dir, "part").select(p.alias("id"), tables.boxes_of(own, F.array(F.array(*map(F.lit, (7.0, 1.0, 2.0, 3.0)))), 1)[0][0].alias("first"))


@query("select 'v' || doc_id || '.jpg' as name from documents where doc_id % 6 = 0")
def common_files(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    root = lambda name, every: d.where(F.col("doc_id") % every == 0).select(F.concat(F.lit(f"{name}/f"), (F.col("doc_id") % 5).cast("string"), F.lit("/v"), "doc_id", F.lit(".jpg")).alias("path"))
    return relations.common_names(root("/a", 2), root("/b", 3))


@query("select 'x/clip' || doc_id || '.mp4' path, doc_id::bigint number, rank() over (order by doc_id) - 1 as position from documents")
def numeric_file_order(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select(F.concat(F.lit("x/clip"), "doc_id", F.lit(".mp4")).alias("path"))
    return relations.numeric_positions(d).select("path", F.col("number").cast("long").alias("number"), "position")


@query("select doc_id, case when doc_id % 3 = 0 then '/d/set/a/set' when doc_id % 3 = 1 then '/d/set' end root from documents")
def dataset_roots(spark, sf_dir):
    i = F.col("doc_id")
    path = F.when(i % 3 == 0, "/d/set/a/set/x/f.jpg").when(i % 3 == 1, "/d/set/b/settle/f.jpg").otherwise("/d/reset/f.jpg")
    return X.table(spark, sf_dir, "documents").select("doc_id", P.dataset_root(path, "set").alias("root"))


# ---- stores and contracts


def _runs(spark, sf_dir) -> tuple[str, DataFrame]:
    """Two runs of two pools in a catalog: all vectors, and those of even ids."""
    e = X.table(spark, sf_dir, "embeddings")
    catalog = _place(spark, "catalog")
    for run, part in (("first", e), ("second", e.where("vec_id % 2 = 0"))):
        rows = part.select(F.col("vec_id").alias("row_index"), F.concat(F.lit("o"), "vec_id").alias("observation_id"), F.explode(F.array(F.lit("box"), F.lit("full"))).alias("pool"), F.col("embedding").alias("features"))
        made = store.write_run(rows, _place(spark, f"{run}-features"), run, f"emb-{run}", 11)
        found = store.append_catalog(spark, catalog, made)
    return catalog, found


@query(
    """select 'emb-' || run || '/layer11/' || pool || '/none/all' feature_key, run run_id, pool, 11 layer, n as rows, (select len(embedding) from embeddings limit 1)::int dimension
from (select 'first' run, count(*) n from embeddings union all select 'second', count(*) from embeddings where vec_id % 2 = 0), (select unnest(['box', 'full']) pool)"""
)
def feature_catalog(spark, sf_dir):
    return _runs(spark, sf_dir)[1].select("feature_key", "run_id", "pool", "layer", "rows", "dimension")


@query("select vec_id row_index, 'o' || vec_id observation_id, round(embedding[1]::double, 9) + 0.0 as first from embeddings where vec_id % 2 = 0")
def feature_load(spark, sf_dir):
    catalog, _ = _runs(spark, sf_dir)
    f = store.load_feature(spark, catalog, "emb-second/layer11/full/none/all")
    return f.select("row_index", "observation_id", r9(F.col("features")[0].cast("double")).alias("first"))


@query("select 'emb-first/layer11/' || pool || '/none/all' feature_key, pool = 'full' ok from (select unnest(['box', 'full']) pool) union all select 'emb-second/layer11/' || pool || '/none/all', true from (select unnest(['box', 'full']) pool)")
def catalog_sanity(spark, sf_dir):
    """A pool of the first run gets rows that its digest doesn't know."""
    catalog, rows = _runs(spark, sf_dir)
    path = rows.where("run_id = 'first'").first()["features_path"]
    store.load_path(spark, path).where("pool = 'box' and row_index < 3").write.mode("append").partitionBy("pool").parquet(path)
    return store.sanity(spark, catalog).select("feature_key", "ok")


_ADDED = {"split": "doc_id % 9 = 0", "dependency_group_id": "doc_id % 8 = 0", "motion_backend_id": "doc_id % 6 = 0", "motion_feature_schema_version": "false"}


@query(
    "with k as (select "
    + ", ".join(f"count(*) filter ({c}) {n}" for n, c in _ADDED.items())
    + " from documents) select 'split must be train, validation, or test' message from k where split > 0"
    + "".join(f" union all select {n} || ' rows have null {n}' from k where {n} > 0" for n in list(_ADDED)[1:])
)
def analysis_contract(spark, sf_dir):
    """What the analysis stage asks for beyond the curated one."""
    o = X.observations(spark, sf_dir)
    i = F.col("doc_id")
    given = o.withColumns(
        {
            "split": F.when(i % 9 == 0, "dev").otherwise(F.col("split")), "dependency_group_id": F.when(i % 8 != 0, "g"), "motion_backend_id": F.when(i % 6 != 0, "m"), "motion_feature_schema_version": F.lit("v"),
            "motion_feature_vector_scaled": F.array(F.lit(0.0)), "motion_quality_pass": F.lit(True),
        }
    )
    curated = set(validation.validate_curated(given))
    return spark.createDataFrame([(m,) for m in validation.validate_analysis(given) if m not in curated], "message string")


@query("select unnest(['forbidden feature-input column: split', 'unexpected feature-input column: split', 'missing feature-input column: fps']) message union all select n || ' rows have duplicate observation_id' from (select coalesce(sum(c), 0)::bigint n from (select count(*) c from documents where doc_id % 97 = 5) where c > 1) where n > 0")
def feature_input_contract(spark, sf_dir):
    o = X.observations(spark, sf_dir).where("observation_id <> concat('o', doc_id)").select("observation_id", "split")
    return spark.createDataFrame([(m,) for m in validation.validate_feature_inputs(o, ["observation_id", "fps"], ["split"])], "message string")


@query("select media_type, count(*) n from (select case when doc_id%41=0 then 'audio' else 'video' end media_type from documents) group by 1")
def media_type_counts(spark, sf_dir):
    return X.observations(spark, sf_dir).groupBy("media_type").agg(F.count("*").alias("n"))


@query("select doc_id, case when doc_id % 20 < 14 then 'train' when doc_id % 20 < 17 then 'validation' else 'test' end split, round(n_chars / 100.0, 9) speed, lang from documents")
def curated_join(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    parts = {
        "curated": d.select("doc_id", "lang"),
        "splits": d.select("doc_id", F.when(i % 20 < 14, "train").when(i % 20 < 17, "validation").otherwise("test").alias("split")),
        "motion": d.select("doc_id", r9(F.col("n_chars") / 100.0).alias("speed")),
    }
    return relations.one_to_one(parts, "doc_id").select("doc_id", "split", "speed", "lang")


@query("select doc_id from documents where doc_id % 4 = 1")
def subset_rows(spark, sf_dir):
    i = F.col("doc_id")
    d = X.table(spark, sf_dir, "documents").withColumn("mask_available", F.when(i % 4 == 0, True).when(i % 4 == 1, False))
    return P.subset_filter(d, " Mask_Available = FALSE ").select("doc_id")


@query("select doc_id from documents order by doc_id limit 100")
def prefix_rows(spark, sf_dir):
    """The first 100 rows in order: the limit is the feature."""
    return P.prefix(X.table(spark, sf_dir, "documents"), "doc_id", 100).select("doc_id")


@query("select 'all' as columns, false complete union all select 'ids', true union all select 'absent', false")
def provenance(spark, sf_dir):
    o = X.observations(spark, sf_dir)
    asked = {"all": ["observation_id", "transition_id"], "ids": ["observation_id", "media_sha256"], "absent": ["observation_id", "none"]}
    return spark.createDataFrame([(n, P.provenance_complete(o, c)) for n, c in asked.items()], "columns string, complete boolean")


@query("select doc_id, array_to_string(list_sort(list_filter(list_transform(string_split(coalesce(lang, '') || '; ' || coalesce(source, '') || ';;', ';'), lambda x: trim(x)), lambda x: x <> '')), '|') labels from documents")
def multilabel_parse(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").withColumn("t", F.concat(F.coalesce("lang", F.lit("")), F.lit("; "), F.coalesce("source", F.lit("")), F.lit(";;")))
    return d.select("doc_id", F.concat_ws("|", P.multilabel(d, "t")).alias("labels"))


@query("select doc_id, n from (select doc_id, count(*) n from (select doc_id % 400 doc_id from documents) group by 1) where n > 1 union all select -1, count(*) from documents where doc_id % 250 = 7")
def relational_keys(spark, sf_dir):
    """Repeated and null values of a primary key."""
    i = F.col("doc_id")
    d = X.table(spark, sf_dir, "documents")
    keys = d.select((i % 400).alias("doc_id")).unionByName(d.where(i % 250 == 7).select(F.lit(None).cast("long").alias("doc_id")))
    return predict.key_violations(keys, "doc_id").select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.col("count").alias("n"))


@query("select 'selected' status, true used union all select 'skipped', false")
def component_resolution(spark, sf_dir):
    return spark.createDataFrame([("selected", release.resolve_component(True, False)), ("skipped", release.resolve_component(False, True))], "status string, used boolean")


@query("select doc_id, sha256('[\"a' || doc_id || '\",\"b\"]') digest from documents")
def ordered_id_digests(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", store.order_hash(F.array(F.concat(F.lit("a"), "doc_id"), F.lit("b"))).alias("digest"))


# ---- motion, roles and gates


@query(f"with {X.MOTION} select observation_id, m[1] between -0.2 and 0.2 and m[2] between -0.1 and 0.3 passed from motion")
def motion_quality(spark, sf_dir):
    m = X.motion(spark, sf_dir).select("observation_id", F.col("m")[0].alias("speed"), F.col("m")[1].alias("area"))
    return m.select("observation_id", motion.quality_pass({"speed": (-0.2, 0.2), "area": (-0.1, 0.3)}).alias("passed"))


@query(
    f"""with {_MISMATCH} select anchor_observation_id, coalesce(d_n >= 0 and d_s >= 0 and transition_id <> 3, false) eligible_base,
coalesce(d_n >= 0 and d_s >= 0 and transition_id <> 3, false) and coalesce(signed <= 0.5 and severity <= 0.25 and quality, false) confirmatory_eligible from mis"""
)
def triplet_eligibility(spark, sf_dir):
    m = _mismatch(spark, sf_dir)
    base = {"distances": "d_n >= 0 and d_s >= 0", "transition": "transition_id <> 3"}
    return triplets.eligibility(m, base, {"signed": "signed <= 0.5", "severity": "severity <= 0.25", "quality": "quality"}).select("anchor_observation_id", "eligible_base", "confirmatory_eligible")


_PAIRS = f"{X.DIST}, p as (select anchor_observation_id id, dependency_group_id g, 0 y, d_n d from dist union all select anchor_observation_id, dependency_group_id, 1, d_s from dist)"


@query(f"with {_PAIRS} select g dependency_group_id, count(*) filter (md5('3-0-' || g)[1] < '8') flipped, count(*) as rows from p group by 1")
def role_permutation(spark, sf_dir):
    return motion.permute_roles(_role_pairs(spark, sf_dir), seed=3).groupBy("dependency_group_id").agg(F.count_if(F.col("permuted") != F.col("label")).alias("flipped"), F.count("*").alias("rows"))


@query(
    f"""with {_PAIRS}, k as (select *, rank() over (order by d) + (count(*) over (partition by d) - 1) / 2.0 r from p),
s as (select g, sum(r) filter (y = 0) r0, sum(r) filter (y = 1) r1, count(*) filter (y = 1) n from k group by 1),
v as (select b, sum(case when b > 0 and md5('20260820-' || b || '-' || g)[1] < '8' then r0 else r1 end) t, sum(n) n from s, (select unnest(range(1000)) b) group by 1),
a as (select b, (t - n * (n + 1) / 2.0) / (n * n) a from v), o as (select a o from a where b = 0)
select round(o, 9) auroc, count(*) replicates, count(*) filter (a >= o - 1e-12) at_least, round((count(*) filter (a >= o - 1e-12) + 1) / (count(*) + 1.0), 9) p_value from a, o where b > 0 group by o"""
)
def role_permutation_test(spark, sf_dir):
    t = inference.permutation_test(_role_pairs(spark, sf_dir), "d")
    return t.select(r9("auroc").alias("auroc"), "replicates", "at_least", r9("p_value").alias("p_value"))


@query()
def motion_role_model(spark, sf_dir):
    """The logistic role model, fitted on two thirds of the groups, and its AUROC on the rest."""
    d, m = X.distances(spark, sf_dir), X.motion(spark, sf_dir).select(F.col("observation_id").alias("k"), "m")
    pairs = None
    for label, role in ((0, "nuisance"), (1, "state")):
        side = d.select("dependency_group_id", F.col("anchor_observation_id").alias("ka"), F.col(f"{role}_observation_id").alias("kb"), F.lit(label).alias("label"))
        pairs = side if pairs is None else pairs.unionByName(side)
    both = pairs.join(m.toDF("ka", "a"), "ka").join(m.toDF("kb", "b"), "kb")
    scored = inference.role_model(both.where("dependency_group_id % 3 <> 0"), both.where("dependency_group_id % 3 = 0"), "a", "b")
    return motion.auroc(scored, "probability", "label")


@query()
def paired_gate(spark, sf_dir):
    """The paired gain of the margin over its half, by whole groups."""
    g = nested.group_means(X.distances(spark, sf_dir), {"margin": V.normalized_margin(F.col("d_n"), F.col("d_s"))})
    return inference.paired_gate(g.withColumn("margin", F.col("margin") / 2), g, "margin", -0.02, replicates=200)


@query(f"with {_MISMATCH}, x as (select * from mis), {X.nested_sql({'sns': _SCORE})} select 'sns_headroom' gate, round(sns, 9) as value, sns < 0.9 passes, false blocked from nested union all select 'coverage', 1.0, true, not (sns < 0.9) from nested")
def gate_ladder(spark, sf_dir):
    d = nested.nested_mean(X.distances(spark, sf_dir), {"sns": _score()}).first()
    return evaluation.gates({"sns_headroom": (d["sns"], "<", 0.9), "coverage": (1.0, ">=", 0.5)}, spark).select("gate", r9("value").alias("value"), "passes", "blocked")


@query(
    f"""with {_MISMATCH}, grid as (select a, b from (select unnest([0.1, 0.25, 0.5, 1.0])::double a) cross join (select unnest([0.1, 0.25, 0.5, 1.0])::double b))
select a signed_caliper, b severity_caliper, round(avg((signed <= a and severity <= b and quality)::int), 9) + 0.0 coverage from mis cross join grid group by 1, 2"""
)
def caliper_coverage(spark, sf_dir):
    return motion.caliper_grid(_mismatch(spark, sf_dir), _GRID).select("signed_caliper", "severity_caliper", r9("coverage").alias("coverage"))


# ---- controls, baselines, losses and searches


@query(
    f"""with {X.FEAT}, m as (select d, avg(x) m from (select unnest(v) x, generate_subscripts(v, 1) d from feat) group by 1), mm as (select list(m order by d) m from m),
c as (select observation_id, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) v from feat, mm)
select a.observation_id, round(list_cosine_distance(a.v, b.v), 6) + 0.0 distance from c a join c b on b.observation_id = a.observation_id + 1"""
)
def center_distances(spark, sf_dir):
    return _control_distances(spark, sf_dir, linalg.center_control(linalg.moments(X.table(spark, sf_dir, "embeddings"), "embedding")).apply)


@query(
    f"""with {X.BOXES}, f as (select id, k, x + k x, y, w, h from box, (select unnest(range(16)) k) where inside and x + w + 15 <= 384 and id % 10 = 0),
c as (select id, k // 2 t, i, j, greatest(0, least(ceil(x + w), (j + 1) * 16) - greatest(floor(x), j * 16)) * greatest(0, least(ceil(y + h), (i + 1) * 16) - greatest(floor(y), i * 16)) / 256.0::double o
from f, (select unnest(range(24)) i), (select unnest(range(24)) j))
select id, t::bigint t, i::int i, j::int j, round(sum(o) / 2, 9) occupancy from c group by 1, 2, 3, 4 having sum(o) > 0"""
)
def box_occupancy_tubelets(spark, sf_dir):
    """Boxes that move one pixel a frame over 16 frames, those of every tenth part: the video observations of this fixture."""
    b = X.boxes(spark, sf_dir).where("box is not null and box.x + box.w + 15 <= 384 and id % 10 = 0")
    moved = F.struct((F.col("box.x") + F.col("k")).alias("x"), F.col("box.y").alias("y"), F.col("box.w").alias("w"), F.col("box.h").alias("h"))
    frames = b.select(F.col("id").alias("observation_id"), "box", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k")).select("observation_id", F.col("k").alias("frame"), moved.alias("box"))
    return pooling.box_occupancy(frames).where("occupancy > 0").select(F.col("observation_id").alias("id"), "t", "i", "j", r9("occupancy").alias("occupancy"))


@query(
    f"""with {X.FEAT}, w as (select label, v, (observation_id % 5) / 4.0::double o, (observation_id % 3) / 2.0::double k from feat), l as (select label, o, k, unnest(v) x, generate_subscripts(v, 1) - 1 d from w)
select label, d::int d, round(sum(o * x) / (sum(o) + 1e-8), 9) + 0.0 box, round(sum(k * x) / (sum(k) + 1e-8), 9) + 0.0 mask, round(avg(x), 9) + 0.0 as full, round(sum((1 - o) * x) / (sum(1 - o) + 1e-8), 9) + 0.0 context from l group by 1, 2"""
)
def observation_pools(spark, sf_dir):
    i = F.col("observation_id")
    tokens = X.feat(spark, sf_dir).select("label", "v", ((i % 5) / 4.0).alias("occupancy"), ((i % 3) / 2.0).alias("mask_occupancy"))
    p = pooling.region_pools(tokens, "label", "v", mask="mask_occupancy")
    pools = ("box", "mask", "full", "context")
    return p.select("label", F.posexplode(F.arrays_zip(*pools)).alias("d", "p")).select("label", "d", *[r9(F.col(f"p.{c}")).alias(c) for c in pools])


@query(
    f"""with {_PREDICTED}, b0 as (select d.source s, d.lang g, l.quality y, d.doc_id from labels l join documents d using (doc_id)), t as (select * from b0 where doc_id % 2 = 0 and y is not null),
a as (select s, g, y from (select s, g, y, count(*) n from t group by 1, 2, 3) qualify row_number() over (partition by s, g order by n desc, y) = 1),
b as (select s, y from (select s, y, count(*) n from t group by 1, 2) qualify row_number() over (partition by s order by n desc, y) = 1),
c as (select y from (select y, count(*) n from t group by 1) order by n desc, y limit 1)
select b0.doc_id, coalesce(a.y, b.y, c.y) predicted from b0 left join a on a.s = b0.s and a.g = b0.g left join b on b.s = b0.s cross join c"""
)
def backoff_baseline(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    rows = X.table(spark, sf_dir, "labels").join(d, "doc_id")
    return relations.backoff_baseline(rows.where("doc_id % 2 = 0"), rows, [["source", "lang"], ["source"]], "quality").select("doc_id", "predicted")


@query(
    f"""with {X.FEAT}, s as (select q.observation_id query_id, g.observation_id match_id, list_inner_product(q.v, g.v) score from feat q join feat g on g.label = q.label and g.observation_id <> q.observation_id
where q.observation_id % 50 = 0 and g.observation_id between 10 and 400)
select query_id, match_id, row_number() over (partition by query_id order by score desc, match_id)::int as rank, round(score, 9) + 0.0 score from s qualify rank <= 5"""
)
def constrained_search(spark, sf_dir):
    """Queries are ids divisible by 50; the range of ids of the gallery is the constraint of the feature."""
    e = X.table(spark, sf_dir, "embeddings")
    found = relations.constrained_search(e.where("vec_id % 50 = 0"), relations.metadata_filter(e, {"vec_id": (10, 400)}), ["label"], "vec_id", "embedding", 5)
    return found.select("query_id", "match_id", "rank", r9("score").alias("score"))


@query(f"with {X.DIST} select round(avg(greatest(0.0::double, 0.2 + d_n - d_s)), 9) loss, count(*) as rows from dist")
def identity_loss(spark, sf_dir):
    return predict.identity_loss(X.distances(spark, sf_dir), "d_n", "d_s", 0.2).withColumn("loss", r9("loss"))


@query("with k as (select doc_id, (n_chars % 97 + 1) / 100.0::double p, quality y from labels join documents using (doc_id)) select round(avg(-ln(case when y = 1 then p else 1 - p end)), 9) loss, count(*) as rows from k where y is not null")
def direction_loss(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 97 + 1) / 100.0).alias("p"))
    rows = X.table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("z", F.array(1 - F.col("p"), F.col("p")))
    return predict.cross_entropy(rows, "z", "quality").withColumn("loss", r9("loss"))


@query(
    f"""with {X.FEAT}, l as (select observation_id o, unnest(v) x, generate_subscripts(v, 1) d from feat), m as (select d, avg(x) m from l group by 1), c as (select o, d, x - m x from l join m using (d)),
k as (select a.d i, b.d j, sum(a.x * b.x) / (select count(*) from feat) v from c a join c b on a.o = b.o and a.d <> b.d group by 1, 2)
select round(sum(v * v) / (select count(*) from m), 9) loss, (select count(*) from m) dimensions from k"""
)
def covariance_loss(spark, sf_dir):
    loss, d = predict.covariance_loss(linalg.moments(X.table(spark, sf_dir, "embeddings"), "embedding"))
    return spark.createDataFrame([(round(loss, 9), d)], "loss double, dimensions long")


@query(
    f"""with {X.FEAT}, c as (select q.observation_id qk, g.observation_id gk, q.label = g.label own, round(list_cosine_similarity(q.v, g.v), 12) c from feat q join feat g on q.observation_id % 3 = g.observation_id % 3
where q.observation_id % 50 = 0 and abs(q.observation_id - g.observation_id) > 6),
b as (select qk, c, gk from c where own qualify row_number() over (partition by qk order by c desc, gk) = 1)
select c.qk vec_id, count(*) filter (c.c > b.c or (c.c = b.c and c.gk < b.gk)) + 1 as rank from c join b on b.qk = c.qk group by 1"""
)
def matched_retrieval(spark, sf_dir):
    """Queries are ids divisible by 50; frames of ids that differ by 6 or less overlap."""
    i = F.col("vec_id")
    e = X.table(spark, sf_dir, "embeddings").withColumns({"context": i % 3, "first": i * 2, "last": i * 2 + 12})
    return evaluation.matched_retrieval(e.where("vec_id % 50 = 0"), e, ["context"], "vec_id", "embedding", "label", "first", "last")


@query(
    f"""with {X.FRAMES}, r as (select sequence_id, ((frame * 31) % 17) / 4.0::double v, (frame % 5)::double w from frames),
k as (select *, sum(w) over (partition by sequence_id order by v range between unbounded preceding and current row) run, sum(w) over (partition by sequence_id) total from r where w > 0),
q as (select sequence_id, min(v) filter (run >= 0.9 * total - 1e-12) quantile from k group by 1)
select s.sequence_id, quantile, coalesce(quantile < 3.9, false) valid from (select distinct sequence_id from frames) s left join q using (sequence_id)"""
)
def registration_bound(spark, sf_dir):
    f = F.col("frame")
    rows = X.frames(spark, sf_dir).select("sequence_id", ((f * 31 % 17) / 4.0).alias("v"), (f % 5).cast("double").alias("w"))
    return motion.registration_bound(rows, "sequence_id", "v", "w", 3.9)


@query()
def linear_ar_horizons(spark, sf_dir):
    """Fitted on even labels, told on all."""
    e = X.table(spark, sf_dir, "embeddings")
    model = predict.fit_linear_ar(e.where("label % 2 = 0"), "label", "vec_id", "embedding")
    return predict.linear_ar(e, "label", "vec_id", "embedding", model).withColumn("cosine", r9("cosine"))


@query(f"with {_PREDICTED}, k as (select least(floor(((n_chars % 97) / 97.0) * 10), 9)::int bin, (n_chars % 97) / 97.0::double p, quality::double y from labels join documents using (doc_id)), b as (select bin, avg(p) c, avg(y) f, count(*) n from k group by 1) select round(sum(abs(c - f) * n) / sum(n), 9) ece from b")
def expected_calibration_error(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 97) / 97.0).alias("p"))
    c = evaluation.calibration(X.table(spark, sf_dir, "labels").join(d, "doc_id"), "p", "quality")
    return evaluation.expected_calibration_error(c).withColumn("ece", r9("ece"))


def _ipf_sql(rounds: int = 20) -> str:
    """Alternate scaling of the cells' weights, a step for each round and side."""
    steps = ["c0 as (select source, lang, count(*)::double n, 1.0::double w from documents group by 1, 2)", "k as (select sum(n) t, count(distinct source) source, count(distinct lang) lang from c0)"]
    for i, side in enumerate(("source", "lang") * rounds):
        steps.append(f"c{i + 1} as (select c.source, c.lang, n, w * (k.t / k.{side}) / sum(w * n) over (partition by c.{side}) w from c{i} c, k)")
    return f"with {', '.join(steps)} select source, lang, round(w, 9) + 0.0 weight from c{2 * rounds}"


@query(_ipf_sql())
def ipf_weights(spark, sf_dir):
    return evaluation.ipf_weights(X.table(spark, sf_dir, "documents").select("source", "lang"), "source", "lang").withColumn("weight", r9("weight"))
