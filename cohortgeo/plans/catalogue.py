"""Every query of the engine's own operators, with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortgeo.functions import vectors as V
from cohortgeo.operators import components, evaluation, inference, linalg, motion, nested, phases, pooling, predict, segments, splits, training, triplets, validation
from cohortgeo.plans import fixtures as X
from cohortgeo.plans.registry import oracle_sql, queries, query, r9  # noqa: F401
from cohortgeo.sources import release, store

# ---- vectors and triplets


@query(f"with {X.FEAT} select observation_id, round(sqrt(list_inner_product(v, v)), 9) + 0.0 as norm, round(v[1] / sqrt(list_inner_product(v, v)), 9) + 0.0 as first from feat")
def l2_normalize(spark, sf_dir):
    f = X.feat(spark, sf_dir)
    unit = V.l2_normalize(F.col("v"), F.col("n"))
    return f.select("observation_id", r9("n").alias("norm"), r9(unit[0]).alias("first"))


@query(f"with {X.FEAT} select a.observation_id left_id, b.observation_id right_id, round(list_cosine_distance(a.v, b.v), 9) + 0.0 distance from feat a join feat b on b.observation_id = a.observation_id + 1")
def cosine_distance_pairs(spark, sf_dir):
    f = X.feat(spark, sf_dir)
    a = f.select(F.col("observation_id").alias("left_id"), F.col("v").alias("a"), F.col("n").alias("na"), (F.col("observation_id") + 1).alias("right_id"))
    b = f.select(F.col("observation_id").alias("right_id"), F.col("v").alias("b"), F.col("n").alias("nb"))
    return a.join(b, "right_id").select("left_id", "right_id", r9(V.cosine_distance(F.col("a"), F.col("b"), F.col("na"), F.col("nb"))).alias("distance"))


@query(f"with {X.DIST} select anchor_observation_id, nuisance_observation_id, state_observation_id, round(d_n, 9) + 0.0 d_n, round(d_s, 9) + 0.0 d_s from dist")
def triplet_distances(spark, sf_dir):
    d = X.distances(spark, sf_dir)
    return d.select("anchor_observation_id", "nuisance_observation_id", "state_observation_id", r9("d_n").alias("d_n"), r9("d_s").alias("d_s"))


@query(f"with {X.DIST} select anchor_observation_id, round((d_s - d_n) / (d_s + d_n + 1e-8), 9) + 0.0 margin from dist")
def normalized_margin(spark, sf_dir):
    d = X.distances(spark, sf_dir)
    return d.select("anchor_observation_id", r9(V.normalized_margin(F.col("d_n"), F.col("d_s"))).alias("margin"))


_SCORE = "case when d_s - d_n > 1e-6 then 1.0::double when abs(d_s - d_n) <= 1e-6 then 0.5::double else 0.0::double end"


def _score():
    return V.state_score(F.col("d_n"), F.col("d_s"))


@query(f"with {X.DIST}, x as (select * from dist), {X.nested_sql({'sns': _SCORE})} select round(sns, 9) sns, groups, transitions, anchors, rows from nested")
def sns_all(spark, sf_dir):
    return nested.nested_mean(X.distances(spark, sf_dir), {"sns": _score()}).withColumn("sns", r9("sns"))


@query(
    f"""with {X.DIST}, x as (select * from dist), {X.nested_sql({"strict": "(d_s > d_n)::int::double", "ties": "(abs(d_s - d_n) <= 1e-6)::int::double"})}
select round(strict, 9) strict, round(ties, 9) + 0.0 ties, groups, transitions, anchors, rows from nested"""
)
def sns_strict_tie_rate(spark, sf_dir):
    n, s = F.col("d_n"), F.col("d_s")
    values = {"strict": (s > n).cast("double"), "ties": (F.abs(s - n) <= 1e-6).cast("double")}
    return nested.nested_mean(X.distances(spark, sf_dir), values).withColumns({"strict": r9("strict"), "ties": r9("ties")})


@query(f"with {X.DIST}, x as (select * from dist), {X.nested_sql({'margin': '(d_s - d_n) / (d_s + d_n + 1e-8)'})} select round(margin, 9) + 0.0 margin, groups, transitions, anchors, rows from nested")
def margin_nested(spark, sf_dir):
    return nested.nested_mean(X.distances(spark, sf_dir), {"margin": V.normalized_margin(F.col("d_n"), F.col("d_s"))}).withColumn("margin", r9("margin"))


@query(
    f"""with {X.DIST}, x as (select *, (transition_id % 2)::varchar parity from dist union all select *, 'all' from dist), {X.nested_sql({"sns": _SCORE}, "parity")}
select parity, round(sns, 9) sns, groups, transitions, anchors, rows from nested"""
)
def sns_by_label(spark, sf_dir):
    """Breakdown by a label, and the total, in one pass."""
    d = X.distances(spark, sf_dir)
    both = d.withColumn("parity", F.explode(F.array((F.col("transition_id") % 2).cast("string"), F.lit("all"))))
    return nested.nested_mean(both, {"sns": _score()}, by=["parity"]).withColumn("sns", r9("sns"))


@query(f"with {X.DIST}, m as (select unnest([0.05, 0.1, 0.2])::double margin) select margin, round(avg(greatest(0.0::double, margin + d_n - d_s)), 9) loss, count(*) as rows from dist cross join m group by 1")
def margin_triplet_loss_grid(spark, sf_dir):
    losses = F.array(*[F.struct(F.lit(m).alias("margin"), F.avg(V.hinge(F.col("d_n"), F.col("d_s"), m)).alias("loss"), F.count("*").alias("rows")) for m in (0.05, 0.1, 0.2)])
    return X.distances(spark, sf_dir).agg(losses.alias("l")).select(F.inline("l")).withColumn("loss", r9("loss"))


@query()
def bootstrap_ci(spark, sf_dir):
    groups = nested.group_means(X.distances(spark, sf_dir), {"sns": _score()})
    return inference.group_bootstrap(groups, "sns", 500)


# ---- motion

_SCALER = f"""{X.MOTION}, long as (select observation_id, unnest(m) x, generate_subscripts(m, 1) - 1 dim from motion),
scaler as (select dim, quantile_cont(x, 0.5) median, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) iqr, max(x) - min(x) span, count(*) n from long group by 1)"""


@query(f"with {_SCALER} select dim::int dim, round(median, 9) + 0.0 median, round(iqr, 9) + 0.0 iqr, round(span, 9) + 0.0 span, round(greatest(iqr, 1e-6), 9) denominator, span > 0 active, n from scaler")
def motion_scaler_fit(spark, sf_dir):
    t = motion.scaler_table(X.motion(spark, sf_dir), "m")
    return t.withColumns({c: r9(c) for c in ("median", "iqr", "span", "denominator")})


@query(
    f"""with {_SCALER} select observation_id, dim::int dim, round(((x - median) / greatest(iqr, 1e-6))::float::double, 5) + 0.0 scaled
from long join scaler using (dim) where span > 0"""
)
def motion_scaled(spark, sf_dir):
    m = X.motion(spark, sf_dir)
    scaler = motion.fit_scaler(m, "m")
    return m.select("observation_id", F.posexplode(scaler.transform(F.col("m"))).alias("dim", "x")).select("observation_id", "dim", (F.round(F.col("x").cast("double"), 5) + 0.0).alias("scaled"))


_MISMATCH = f"""{X.DIST}, {X.MOTION},
mm as (select d.*, a.m am, b.m bm, s.m sm, a.quality and b.quality and s.quality quality from dist d join motion a on a.observation_id = d.anchor_observation_id
       join motion b on b.observation_id = d.nuisance_observation_id join motion s on s.observation_id = d.state_observation_id),
mis as (select * exclude (am, bm, sm), list_distance(bm, sm) signed,
        sqrt(list_sum(list_transform(list_zip(am, bm, sm), lambda z: pow(abs(z[2] - z[1]) - abs(z[3] - z[1]), 2)))) severity,
        (list_distance(am, bm) + list_distance(am, sm)) / 2.0 level from mm)"""


def _mismatch(spark, sf_dir) -> DataFrame:
    out, m = X.distances(spark, sf_dir), X.motion(spark, sf_dir)
    for role in ("anchor", "nuisance", "state"):
        out = out.join(m.select(F.col("observation_id").alias(f"{role}_observation_id"), F.col("m").alias(f"{role}_m"), F.col("quality").alias(f"{role}_q")), f"{role}_observation_id")
    signed, severity, level = motion.triplet_mismatch(F.col("anchor_m"), F.col("nuisance_m"), F.col("state_m"))
    return out.withColumns({"signed": signed, "severity": severity, "level": level, "quality": F.col("anchor_q") & F.col("nuisance_q") & F.col("state_q")})


@query(f"with {_MISMATCH} select anchor_observation_id, round(signed, 9) + 0.0 signed, round(severity, 9) + 0.0 severity, round(level, 9) + 0.0 level, quality from mis")
def motion_mismatch(spark, sf_dir):
    return _mismatch(spark, sf_dir).select("anchor_observation_id", r9("signed").alias("signed"), r9("severity").alias("severity"), r9("level").alias("level"), "quality")


@query(
    f"""with {_MISMATCH}, x as (select * from mis where signed <= 0.5 and severity <= 0.25 and quality), {X.nested_sql({"sns": _SCORE})}
select round(sns, 9) sns, groups, transitions, anchors, rows from nested"""
)
def motion_matched_sns(spark, sf_dir):
    from cohortgeo.functions.predicates import motion_matched

    m = _mismatch(spark, sf_dir)
    ok = motion_matched(F.col("signed"), F.col("severity"), [F.col(f"{r}_q") for r in ("anchor", "nuisance", "state")], 0.5, 0.25)
    return nested.nested_mean(m.where(ok), {"sns": _score()}).withColumn("sns", r9("sns"))


_GRID = [(a, b) for a in (0.1, 0.25, 0.5, 1.0) for b in (0.1, 0.25, 0.5, 1.0)]


@query(
    f"""with {_MISMATCH}, grid as (select a, b from (select unnest([0.1, 0.25, 0.5, 1.0])::double a) cross join (select unnest([0.1, 0.25, 0.5, 1.0])::double b)),
cov as (select a signed_caliper, b severity_caliper, avg((signed <= a and severity <= b and quality)::int) coverage from mis cross join grid group by 1, 2)
select signed_caliper, severity_caliper, round(coverage, 9) coverage from cov where coverage >= 0.3 order by signed_caliper + severity_caliper, signed_caliper limit 1"""
)
def caliper_selection(spark, sf_dir):
    grid = motion.caliper_grid(_mismatch(spark, sf_dir), _GRID)
    return motion.select_caliper(grid, 0.3).withColumn("coverage", r9("coverage"))


def _role_pairs(spark, sf_dir) -> DataFrame:
    d = X.distances(spark, sf_dir)
    roles = F.array(F.struct(F.lit(0).alias("label"), F.col("d_n").alias("d")), F.struct(F.lit(1).alias("label"), F.col("d_s").alias("d")))
    return d.select(F.col("anchor_observation_id").alias("pair_id"), "dependency_group_id", F.explode(roles).alias("r")).select("pair_id", "dependency_group_id", "r.*")


@query(f"with {X.DIST} select count(*) * 2 as rows, count(*) pairs, 0::bigint bad_pairs from dist")
def role_permutation_pairs_valid(spark, sf_dir):
    p = _role_pairs(spark, sf_dir)
    bad = motion.pair_violations(p).agg(F.count("*").alias("bad_pairs"))
    return p.agg(F.count("*").alias("rows"), F.count_distinct("pair_id").alias("pairs")).crossJoin(bad)  # one row each


@query(
    f"""with {X.DIST}, p as (select 0 y, d_n d from dist union all select 1, d_s from dist),
k as (select y, rank() over (order by d) + (count(*) over (partition by d) - 1) / 2.0 r from p)
select round((sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1) * count(*) filter (y = 0)), 9) auroc,
count(*) filter (y = 1) positives, count(*) filter (y = 0) negatives from k"""
)
def auroc_rank(spark, sf_dir):
    return motion.auroc(_role_pairs(spark, sf_dir), "d", "label").withColumn("auroc", r9("auroc"))


# ---- frames

_RUNS = f"""{X.FRAMES}, marked as (select *, case when label is distinct from lag(label) over w or lag(frame) over w is null then 1 else 0 end new from frames window w as (partition by sequence_id order by frame)),
islands as (select *, sum(new) over (partition by sequence_id order by frame) - 1 run_index from marked),
runs as (select sequence_id, run_index::int run_index, min(label) label, min(frame) start, max(frame) "end", count(*) length from islands group by 1, 2)"""


@query(f'with {_RUNS} select sequence_id, run_index, label, start, "end", length from runs')
def label_runs(spark, sf_dir):
    return segments.label_runs(X.frames(spark, sf_dir)).select("sequence_id", "run_index", "label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("length").cast("long").alias("length"))


@query(f"with {_RUNS} select sequence_id, run_index, label, start + (length - 3) // 2 start_frame, start + (length - 3) // 2 + 2 end_frame from runs where length >= 3")
def centred_windows(spark, sf_dir):
    w = segments.centred_windows(segments.label_runs(X.frames(spark, sf_dir)), 3)
    return w.select("sequence_id", "run_index", "label", F.col("start_frame").cast("long").alias("start_frame"), F.col("end_frame").cast("long").alias("end_frame"))


@query(f"with {_RUNS} select sequence_id, run_index, i::int i, start + round_even(i * 29 / 15.0, 0)::bigint frame from runs, (select unnest(range(16)) i) where length >= 4")
def sampled_frames(spark, sf_dir):
    r = segments.label_runs(X.frames(spark, sf_dir)).where("length >= 4")
    return r.select("sequence_id", "run_index", F.posexplode(segments.sampled_frames(F.col("start").cast("long"))).alias("i", "frame"))


@query(
    f"""with {X.FRAMES}, videos as (select user_id sequence_id, count(*) + (user_id % 4 = 0)::int sample_count from events group by 1 union all select -1, 5),
lines as (select sequence_id, count(*) lines from frames where sequence_id % 5 <> 0 group by 1)
select sequence_id, sample_count::bigint sample_count, coalesce(lines, 0) lines, coalesce(lines, 0) = sample_count aligned from videos left join lines using (sequence_id)"""
)
def frame_label_alignment(spark, sf_dir):
    f = X.frames(spark, sf_dir)
    videos = f.groupBy("sequence_id").agg((F.count("*") + (F.col("sequence_id") % 4 == 0).cast("long")).alias("sample_count")).unionByName(spark.sql("select -1L sequence_id, 5L sample_count"))
    return segments.alignment(videos, f.where("sequence_id % 5 <> 0"))


@query(
    f"""with {_RUNS}, p as (select a.sequence_id, a.run_index, greatest(0, least(a."end", b."end") - greatest(a.start, b.start) + 1) i, a.length l, b.length m
from (select sequence_id, run_index, start, "end" + 2 "end", length + 2 length from runs) a join runs b on b.sequence_id = a.sequence_id and b.run_index = a.run_index + 1)
select sequence_id, run_index, round(i / (l + m - i), 9) iou from p"""
)
def temporal_iou(spark, sf_dir):
    r = segments.label_runs(X.frames(spark, sf_dir))
    a = r.select("sequence_id", "run_index", F.col("start").alias("s"), (F.col("end") + 2).alias("e"), (F.col("run_index") + 1).alias("next"))
    b = r.select("sequence_id", F.col("run_index").alias("next"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    return a.join(b, ["sequence_id", "next"]).select("sequence_id", "run_index", r9(segments.temporal_iou(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))).alias("iou"))


@query(
    """with k as (select event_type, value, (epoch_us(ts) // 3000000 - j) * 3 start_s, epoch_us(ts) / 1e6 t from events, (select unnest(range(2)) j))
select event_type, start_s::bigint start_s, count(*) n, round(sum(value), 6) total from k where t < start_s + 4 group by 1, 2"""
)
def chunks(spark, sf_dir):
    c = segments.chunks(X.table(spark, sf_dir, "events"), "ts")
    start = (F.unix_micros(F.col("chunk.start").cast("timestamp")) / 1_000_000).cast("long")
    return c.select("event_type", start.alias("start_s"), "value").groupBy("event_type", "start_s").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(
    f"""with {X.FRAMES} select sequence_id, frame::bigint frame, horizon::int horizon, target::bigint target from (
select *, lead(frame, horizon) over (partition by sequence_id, horizon order by frame) target from frames, (select unnest([1, 2, 4, 8]) horizon)) where target is not null"""
)
def prediction_horizons(spark, sf_dir):
    h = segments.horizons(X.frames(spark, sf_dir), "sequence_id", "frame")
    return h.select("sequence_id", F.col("frame").cast("long").alias("frame"), "horizon", F.col("target").cast("long").alias("target"))


@query(
    f"""with {X.FRAMES}, p as (select label l, lead(label) over (partition by sequence_id order by frame) r from frames),
q as (select * from p where r is not null), n as (select count(*) n, count(*) filter (l = r) same from q),
a as (select l, count(*) c from q group by 1), b as (select r, count(*) c from q group by 1), e as (select sum(a.c::double * b.c) e from a join b on a.l = b.r)
select round(same / n, 9) agreement, round(e / (n * n), 9) chance, round((same / n - e / (n * n)) / (1 - e / (n * n)), 9) + 0.0 kappa from n, e"""
)
def rater_agreement(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("sequence_id").orderBy("frame")
    p = X.frames(spark, sf_dir).select(F.col("label").alias("a"), F.lead("label").over(w).alias("b")).where("b is not null")
    k = segments.kappa(p, "a", "b")
    return k.select(*[r9(c).alias(c) for c in k.columns])


# ---- phases


@query(f"with {X.PHASES} select observation_id, sequence_id, asset_proxy_id, frame_id, phase from kept")
def phase_observations(spark, sf_dir):
    return phases.build(X.phases(spark, sf_dir)).observations.select("observation_id", "sequence_id", "asset_proxy_id", F.col("frame_id").cast("long").alias("frame_id"), "phase")


@query(
    f"""with {X.PHASES} select phase, sequence_id, frame_id, 'cross_phase_exact_duplicate' reason from phase where media_sha256 in (select media_sha256 from conf)
union all select phase, sequence_id, frame_id, 'insufficient_phase_support' from clean anti join elig using (sequence_id, asset_proxy_id)"""
)
def phase_exclusions(spark, sf_dir):
    return phases.build(X.phases(spark, sf_dir)).exclusions.withColumn("frame_id", F.col("frame_id").cast("long"))


_TRIPLETS = """o as (select *, row_number() over (partition by sequence_id, asset_proxy_id, phase order by frame_id, observation_id) rn from kept),
w as (select sequence_id, asset_proxy_id, max(observation_id) filter (phase = 'pre_contact' and rn = 1) p1, max(observation_id) filter (phase = 'pre_contact' and rn = 2) p2,
  max(observation_id) filter (phase = 'contact' and rn = 1) c1, max(observation_id) filter (phase = 'contact' and rn = 2) c2 from o group by 1, 2),
trips as (select 'proxy_' || sequence_id || '_' || asset_proxy_id || '_pre_anchor' triplet_id, p1 anchor_observation_id, p2 nuisance_observation_id, c1 state_observation_id, 'pre_contact' anchor_phase from w
  union all select 'proxy_' || sequence_id || '_' || asset_proxy_id || '_contact_anchor', c1, c2, p1, 'contact' from w)"""


@query(f"with {X.PHASES}, {_TRIPLETS} select * from trips")
def phase_triplets(spark, sf_dir):
    return phases.build(X.phases(spark, sf_dir)).triplets.select("triplet_id", "anchor_observation_id", "nuisance_observation_id", "state_observation_id", "anchor_phase")


@query(
    f"""with {X.PHASES}, {_TRIPLETS} select 'phase' kind, phase as name, count(*) n from kept group by 2
union all select 'exclusion', 'cross_phase_exact_duplicate', count(*) from phase where media_sha256 in (select media_sha256 from conf)
union all select 'exclusion', 'insufficient_phase_support', count(*) from clean anti join elig using (sequence_id, asset_proxy_id)
union all select 'total', 'triplets', count(*) from trips union all select 'total', 'eligible_keys', count(*) from elig union all select 'total', 'conflict_hashes', count(*) from conf"""
)
def phase_summary(spark, sf_dir):
    return phases.summary(phases.build(X.phases(spark, sf_dir)))


@query("select sha256(user_id::varchar) sha, count(*) as rows, count(distinct event_type) kinds from events group by 1 having count(*) > 1")
def hash_duplicates(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    g = e.groupBy(F.sha2(F.col("user_id").cast("string"), 256).alias("sha")).agg(F.count("*").alias("rows"), F.count_distinct("event_type").alias("kinds"))
    return g.where("rows > 1")


# ---- boxes and pools


@query(f"with {X.BOXES} select id, round(x, 9) + 0.0 x, round(y, 9) + 0.0 y, round(w, 9) w, round(h, 9) h from box where inside")
def box_transform(spark, sf_dir):
    return X.boxes(spark, sf_dir).where("box is not null").select("id", *[r9(F.col(f"box.{c}")).alias(c) for c in "xywh"])


@query(f"with {X.BOXES} select id, mass, case when not inside then 'box_outside_encoder_crop' when mass < 1 then 'box_below_minimum_token_mass' end reason from mass")
def box_token_mass(spark, sf_dir):
    reason = F.when(F.col("box").isNull(), "box_outside_encoder_crop").when(F.col("mass") < 1, "box_below_minimum_token_mass")
    return X.boxes(spark, sf_dir).select("id", "mass", reason.alias("reason"))


@query(
    f"""with {X.BOXES}, c as (select id, i, j, greatest(0, least(ceil(x + w), (j + 1) * 16) - greatest(floor(x), j * 16)) * greatest(0, least(ceil(y + h), (i + 1) * 16) - greatest(floor(y), i * 16)) / 256.0::double o
from box, (select unnest(range(24)) i), (select unnest(range(24)) j) where inside)
select id, 0::bigint t, i::int i, j::int j, round(o, 9) occupancy from c where o > 0"""
)
def box_occupancy_cells(spark, sf_dir):
    b = X.boxes(spark, sf_dir).select(F.col("id").alias("observation_id"), F.lit(0).alias("frame"), "box")
    return pooling.box_occupancy(b, tubelet=1).where("occupancy > 0").select(F.col("observation_id").alias("id"), "t", "i", "j", r9("occupancy").alias("occupancy"))


@query(
    f"""with {X.FEAT}, w as (select label, v, (observation_id % 5) / 4.0::double o from feat), l as (select label, o, unnest(v) x, generate_subscripts(v, 1) - 1 d from w)
select label, d::int d, round(sum(o * x) / (sum(o) + 1e-8), 9) + 0.0 box, round(avg(x), 9) + 0.0 as full, round(sum((1 - o) * x) / (sum(1 - o) + 1e-8), 9) + 0.0 context from l group by 1, 2"""
)
def region_pool(spark, sf_dir):
    tokens = X.feat(spark, sf_dir).select("label", "v", ((F.col("observation_id") % 5) / 4.0).alias("occupancy"))
    p = pooling.region_pools(tokens, "label", "v")
    return p.select("label", F.posexplode(F.arrays_zip("box", "full", "context")).alias("d", "p")).select("label", "d", *[r9(F.col(f"p.{c}")).alias(c) for c in ("box", "full", "context")])


# ---- groups and splits


@query(
    f"""with recursive {X.DEPS}, k as (select doc_id, 'h' f, h val from deps union all select doc_id, 'v', v::varchar from deps where v is not null),
m as (select f, val, min(doc_id) o from k group by 1, 2), e as (select distinct k.doc_id a, m.o b from k join m using (f, val) where k.doc_id <> m.o),
s as (select a, b from e union all select b, a from e),
r(doc_id, o) as (select doc_id, doc_id from deps union select s.a, r.o from r join s on s.b = r.doc_id)
select doc_id, 'dep_' || min(o::varchar) dependency_group_id from r group by 1"""
)
def dependency_groups(spark, sf_dir):
    d = X.deps(spark, sf_dir)
    return components.dependency_groups(d, ["h", "v"], "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "dependency_group_id")


def _grouped(spark, sf_dir) -> DataFrame:
    d = X.deps(spark, sf_dir)
    g = components.dependency_groups(d, ["h", "v"], "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "dependency_group_id")
    return d.join(g, "doc_id").select(F.col("doc_id").alias("observation_id"), "dependency_group_id", "lang")


@query()
def split_assignment(spark, sf_dir):
    return splits.assign_splits(_grouped(spark, sf_dir), stratify=["lang"]).mapping


@query("select count(*) as rows, 0::bigint groups_in_two_splits, 0::bigint rows_without_split from documents")
def split_integrity(spark, sf_dir):
    m = splits.assign_splits(_grouped(spark, sf_dir), stratify=["lang"]).mapping
    bad = splits.split_violations(m).agg(F.count("*").alias("groups_in_two_splits"))
    return m.agg(F.count("*").alias("rows"), F.count_if(F.col("split").isNull()).alias("rows_without_split")).crossJoin(bad)  # one row each


# ---- contracts, release, catalog


@query(
    "with dup as (select case when doc_id%97=5 then 'o1' else 'o' || doc_id end k from documents) select 'duplicate_observation_id' as rule, coalesce(sum(c), 0)::bigint n from (select count(*) c from dup group by k having count(*) > 1)\n"
    + "\n".join(f"union all select '{r}', count(*) filter ({c}) from documents" for r, c in X.OBSERVATION_RULES.items())
)
def manifest_violations(spark, sf_dir):
    o = X.observations(spark, sf_dir)
    return validation.violations(o, validation.curated_rules(o))


_INPUTS = ["observation_id", "media_relpath", "media_type", "start_frame", "end_frame", "fps", "media_sha256"]


@query(
    """select case when doc_id%97=5 then 'o1' else 'o' || doc_id end observation_id, case when doc_id%29=0 then 'C:\\data\\v.mp4' when doc_id%37=0 then '../v.mp4' else 'data/' || doc_id || '.mp4' end media_relpath,
case when doc_id%41=0 then 'audio' else 'video' end media_type, doc_id%50-1 start_frame, doc_id%50+28 end_frame, case when doc_id%43=0 then 0.0::double else 30.0::double end fps,
case when doc_id%67=0 then 'xyz' else sha256(doc_id::varchar) end media_sha256 from documents"""
)
def feature_input_redaction(spark, sf_dir):
    o = X.observations(spark, sf_dir)
    t = o.select(F.col("observation_id").alias("triplet_id"), "split")
    return release.views(o, t, _INPUTS)["feature_inputs"][0]


@query("select 'o' || doc_id observation_id, case when doc_id%20<14 then 'train' else 'validation' end split from documents where doc_id%20<17 and doc_id%97<>5 union all select 'o1', case when doc_id%20<14 then 'train' else 'validation' end from documents where doc_id%20<17 and doc_id%97=5")
def release_trainval(spark, sf_dir):
    o = X.observations(spark, sf_dir)
    return release.views(o, o.select(F.col("observation_id").alias("triplet_id"), "split"), _INPUTS)["analysis_trainval"][0].select("observation_id", "split")


@query(
    """select 'analysis_trainval' as name, (count(*) filter (doc_id%20<17))::varchar as rows from documents union all select 'feature_inputs', count(*)::varchar from documents
union all select 'triplets_trainval', (count(*) filter (doc_id%20<17))::varchar from documents union all select 'sealed_test_targets', 'sealed' union all select 'sealed_test_triplets', 'sealed'"""
)
def release_sealed_counts(spark, sf_dir):
    o = X.observations(spark, sf_dir)
    made = release.views(o, o.select(F.col("observation_id").alias("triplet_id"), "split"), _INPUTS)
    out = None
    for name, (frame, sealed) in made.items():
        row = spark.range(1).select(F.lit("sealed").alias("rows")) if sealed else frame.agg(F.count("*").cast("string").alias("rows"))
        row = row.select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("select 'known_key' kind, 'emb/layer11/' || label || '/none/all' as value from embeddings where label < 4 group by label union all select 'known_run', 'run' || label from embeddings where label < 4 group by label")
def catalog_conflicts(spark, sf_dir):
    labels = X.table(spark, sf_dir, "embeddings").select("label").distinct()
    rows = labels.select(F.concat(F.lit("emb/layer11/"), F.col("label"), F.lit("/none/all")).alias("feature_key"), F.concat(F.lit("run"), F.col("label")).alias("run_id"), "label")
    return store.conflicts(rows.where("label < 4"), rows)


# ---- linear algebra and diagnostics


@query(
    f"""with {X.FEAT}, l as (select observation_id o, unnest(v) x, generate_subscripts(v, 1) - 1 d from feat), m as (select d, avg(x) m from l group by 1),
c as (select o, d, x - m x from l join m using (d)) select a.d::bigint i, b.d::bigint j, round(sum(a.x * b.x) / (select count(*) from feat), 9) + 0.0 cov from c a join c b on a.o = b.o and a.d <= b.d group by 1, 2"""
)
def covariance_moments(spark, sf_dir):
    t = linalg.covariance_table(X.table(spark, sf_dir, "embeddings"), "embedding")
    return t.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r9("cov").alias("cov"))


@query()
def effective_rank(spark, sf_dir):
    m = linalg.moments(X.table(spark, sf_dir, "embeddings"), "embedding")
    return spark.createDataFrame([(linalg.effective_rank(m), m.n)], "effective_rank double, rows long")


@query(
    f"""with {X.FEAT}, l as (select observation_id o, unnest(v) x, generate_subscripts(v, 1) d from feat), m as (select d, avg(x) m from l group by 1), c as (select o, d, x - m x from l join m using (d)),
k as (select a.d i, b.d j, sum(a.x * b.x) / (select count(*) from feat) v from c a join c b on a.o = b.o group by 1, 2)
select round(pow(sum(v) filter (i = j), 2) / sum(v * v), 6) participation_ratio, (select count(*) from feat) as rows from k"""
)
def participation_ratio(spark, sf_dir):
    m = linalg.moments(X.table(spark, sf_dir, "embeddings"), "embedding")
    return spark.createDataFrame([(round(linalg.participation_ratio(m), 6), m.n)], "participation_ratio double, rows long")


def _control_distances(spark, sf_dir, control) -> DataFrame:
    f = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("observation_id"), F.col("embedding").cast("array<double>").alias("v"))
    g = linalg.map_vectors(f, "v", control)
    a = g.select("observation_id", F.col("v").alias("a"), (F.col("observation_id") + 1).alias("next"))
    b = g.select(F.col("observation_id").alias("next"), F.col("v").alias("b"))
    return a.join(b, "next").select("observation_id", (F.round(1 - V.dot(F.col("a"), F.col("b")), 6) + 0.0).alias("distance"))


@query(
    f"""with {X.FEAT}, m as (select d, avg(x) m from (select unnest(v) x, generate_subscripts(v, 1) d from feat) group by 1), mm as (select list(m order by d) m from m),
c as (select observation_id, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) v from feat, mm)
select a.observation_id, round(list_cosine_distance(a.v, b.v), 6) + 0.0 distance from c a join c b on b.observation_id = a.observation_id + 1"""
)
def pca_distances(spark, sf_dir):
    """All dimensions kept: a rotation of the centred vectors, whose cosine distances SQL can find."""
    e = X.table(spark, sf_dir, "embeddings")
    return _control_distances(spark, sf_dir, linalg.PcaControl.fit(e, "embedding", 64).apply)


@query()
def whiten_distances(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings")
    return _control_distances(spark, sf_dir, linalg.PcaControl.fit(e, "embedding", 32, whiten=True, shrinkage_relative=0.01).apply)


@query()
def random_projection_distances(spark, sf_dir):
    return _control_distances(spark, sf_dir, linalg.Projection(linalg.random_projection(64, 16, 4)))


@query()
def readout_residual(spark, sf_dir):
    return _control_distances(spark, sf_dir, linalg.Readout("residual_bottleneck", 64, 16))


@query(f"with {X.FEAT}, u as (select list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) u from feat), s as (select sum(x) s, count(*) n from (select unnest(u) x, generate_subscripts(u, 1) d from u) group by d) select round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1.0)), 9) + 0.0 mean_cosine, max(n) as rows from s")
def mean_offdiag_cosine(spark, sf_dir):
    return linalg.mean_offdiagonal_cosine(X.table(spark, sf_dir, "embeddings"), "embedding").withColumn("mean_cosine", r9("mean_cosine"))


@query(f"with {X.FEAT}, l as (select label, unnest(v) x, generate_subscripts(v, 1) d from feat) select label, round(sum(v), 9) variance, max(n) as rows from (select label, d, var_pop(x) v, count(*) n from l group by 1, 2) group by 1")
def within_label_variance(spark, sf_dir):
    return linalg.within_label_variance(X.table(spark, sf_dir, "embeddings"), "embedding", "label").withColumn("variance", r9("variance"))


@query(
    f"""with {X.FEAT}, p as (select a.observation_id q, b.observation_id g, a.label = b.label own, round(list_cosine_similarity(a.v, b.v), 12) s from feat a join feat b on a.observation_id <> b.observation_id),
r as (select q, own, row_number() over (partition by q order by s desc, g) k from p), k as (select q, min(k) filter (own) k from r group by 1)
select round(avg((k <= 1)::int), 9) recall_1, round(avg((k <= 5)::int), 9) recall_5, round(avg(1.0 / k), 9) mrr, count(*) queries from k where k is not null"""
)
def retrieval_recall(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings")
    s = evaluation.retrieval_summary(evaluation.retrieval_ranks(e, e, "vec_id", "embedding", "label"))
    return s.select(r9("recall_1").alias("recall_1"), r9("recall_5").alias("recall_5"), r9("mrr").alias("mrr"), "queries")


_PREDICTED = "p0 as (select d.source g, l.quality y, case when d.n_chars > 1000 then 1 else 0 end p from labels l join documents d using (doc_id))"


def _predictions(spark, sf_dir) -> DataFrame:
    d = X.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("g"), "n_chars")
    lab = X.table(spark, sf_dir, "labels")
    return lab.join(d, "doc_id").select("g", F.col("quality").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("p"))


@query(
    f"""with {_PREDICTED}, t as (select g, y c, count(*) t, count(*) filter (y = p) hit from p0 group by 1, 2), s as (select g, p c, count(*) s from p0 group by 1, 2),
per as (select g, avg(hit / t) ba, avg(2 * hit / (t + coalesce(s, 0))) f1, sum(hit) / sum(t) acc from t left join s using (g, c) group by 1)
select round(avg(ba), 9) balanced_accuracy, round(avg(f1), 9) macro_f1, round(avg(acc), 9) accuracy, count(*) groups from per"""
)
def balanced_accuracy_group_macro(spark, sf_dir):
    m = evaluation.group_macro(_predictions(spark, sf_dir), "g", "y", "p")
    return m.select(*[r9(c).alias(c) for c in ("balanced_accuracy", "macro_f1", "accuracy")], "groups")


@query(f"with {_PREDICTED} select y, round(avg((y = p)::int), 9) recall, count(*) as rows from p0 group by 1")
def class_recall(spark, sf_dir):
    return evaluation.class_recall(_predictions(spark, sf_dir), "y", "p").withColumn("recall", r9("recall"))


@query(
    f"""with {_PREDICTED}, c as (select g, y, count(*) n from p0 where y is not null group by 1, 2), b as (select g, y from c qualify row_number() over (partition by g order by n desc, y) = 1)
select p0.g, p0.y, b.y predicted, count(*) n from p0 join b using (g) group by 1, 2, 3"""
)
def prior_baseline(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    return evaluation.prior_baseline(p, p, ["g"], "y").groupBy("g", "y", "predicted").agg(F.count("*").alias("n"))


@query(
    f"""with {X.DIST}, k as (select rank() over (order by d_n) + (count(*) over (partition by d_n) - 1) / 2.0 a, rank() over (order by d_s) + (count(*) over (partition by d_s) - 1) / 2.0 b from dist)
select round(corr(a, b), 9) + 0.0 spearman, count(*) as rows from k"""
)
def distance_spearman(spark, sf_dir):
    d = X.distances(spark, sf_dir)
    return evaluation.spearman(d, "d_n", "d_s").withColumn("spearman", r9("spearman"))


@query(
    f"""with {X.FEAT}, p as (select list_cosine_similarity(a.v, list_transform(a.v, lambda x, i: x + 0.01 * i)) c from feat a)
select round(avg(c), 9) mean_cosine, count(*) as rows, avg(c) > 0.999 degenerate from p"""
)
def pool_agreement(spark, sf_dir):
    f = X.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    moved = f.withColumn("v", F.transform("v", lambda x, i: x + F.lit(0.01) * (i + 1)))
    return evaluation.pool_agreement(f, moved, "vec_id", "v").withColumn("mean_cosine", r9("mean_cosine"))


def _redundancy_sql() -> str:
    steps = [f"{X.FEAT}, t1 as (select label, observation_id id, (observation_id % 13) / 13.0::double q, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) v, 0.0::double near from feat)"]
    for k in range(1, 6):
        steps.append(f"b{k} as materialized (select label, id, v, q - 0.5 * near gain from t{k} qualify row_number() over (partition by label order by q - 0.5 * near desc, id) = 1)")
        near = "list_inner_product(t.v, b.v)"
        steps.append(f"t{k + 1} as materialized (select t.label, t.id, q, t.v, {near if k == 1 else f'greatest(near, {near})'} near from t{k} t join b{k} b using (label) where t.id <> b.id)")
    return f"with {', '.join(steps)} " + " union all ".join(f"select label, id vec_id, {k} as rank, round(gain, 9) + 0.0 gain from b{k}" for k in range(1, 6))


@query(_redundancy_sql())
def redundancy_selection(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").withColumn("quality", (F.col("vec_id") % 13) / 13.0)
    return evaluation.redundancy_selection(e, "label", "vec_id", "quality", "embedding", 0.5, 5).withColumn("gain", r9("gain"))


@query(
    f"""with {_RUNS}, o as (select sequence_id || '_' || run_index id, sequence_id obj, label y, start s, "end" e, (start + "end") / 2.0 mid from runs)
select a.obj::varchar physical_object_id, a.id anchor_observation_id, n.id nuisance_observation_id, s.id state_observation_id, round(abs(abs(a.mid - n.mid) - abs(a.mid - s.mid)), 6) gap_mismatch
from o a join o n on a.obj = n.obj and a.id <> n.id and a.y = n.y and (a.e < n.s or n.e < a.s) join o s on a.obj = s.obj and a.y <> s.y and (a.e < s.s or s.e < a.s)
where (n.e < s.s or s.e < n.s) and abs(abs(a.mid - n.mid) - abs(a.mid - s.mid)) <= 2"""
)
def candidate_triplets(spark, sf_dir):
    return _candidate_triplets(segments.label_runs(X.frames(spark, sf_dir)))


def _candidate_triplets(runs):
    from cohortgeo.operators.triplets import candidate_triplets as run

    o = runs.select(
        F.concat_ws("_", F.col("sequence_id").cast("string"), F.col("run_index").cast("string")).alias("observation_id"), F.col("sequence_id").cast("string").alias("physical_object_id"),
        F.col("label").alias("state_label"), F.col("start").cast("long").alias("start_frame"), F.col("end").cast("long").alias("end_frame"),
    )
    return run(o).withColumn("gap_mismatch", F.round("gap_mismatch", 6))


# ---- predictors, reports and losses


@query(
    f"""with {X.FEAT}, h as (select unnest([1, 2, 4, 8]) horizon), p as (select label, horizon, v, lead(v, horizon) over (partition by label, horizon order by observation_id) u from feat, h)
select horizon::int horizon, round(avg(list_cosine_similarity(v, u)), 9) + 0.0 cosine, count(*) as rows from p where u is not null group by 1"""
)
def copy_last_horizons(spark, sf_dir):
    return predict.copy_last(X.table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").withColumn("cosine", r9("cosine"))


@query(
    f"""with {_MISMATCH}, k as (select dependency_group_id::varchar g, (transition_id % 3)::varchar t, (signed <= 0.5 and severity <= 0.25 and quality)::int ok from mis)
select coalesce(g, 'all') g, coalesce(t, 'all') t, round(avg(ok), 9) coverage, count(*) as rows from k group by grouping sets ((g), (t), ())"""
)
def coverage_strata(spark, sf_dir):
    m = _mismatch(spark, sf_dir).select(F.col("dependency_group_id").cast("string").alias("g"), (F.col("transition_id") % 3).cast("string").alias("t"), "signed", "severity", "quality")
    c = predict.coverage(m, (F.col("signed") <= 0.5) & (F.col("severity") <= 0.25) & F.col("quality"), ["g", "t"])
    return c.select(F.coalesce("g", F.lit("all")).alias("g"), F.coalesce("t", F.lit("all")).alias("t"), r9("coverage").alias("coverage"), "rows")


@query(
    f"""with {X.FRAMES}, m as (select *, case when frame - lag(frame) over (partition by sequence_id order by frame) = 1 then 0 else 1 end nw from (select * from frames where frame % 40 <> 39)),
s as (select *, sum(nw) over (partition by sequence_id order by frame) - 1 segment from m)
select sequence_id, segment::bigint segment, count(*) steps from s group by 1, 2 having count(*) >= 17"""
)
def predictor_segments(spark, sf_dir):
    f = X.frames(spark, sf_dir).where("frame % 40 <> 39")
    return predict.usable_sequences(f, "sequence_id", "frame").groupBy("sequence_id", F.col("segment").cast("long").alias("segment")).agg(F.count("*").alias("steps"))


@query(
    f"""with {X.FEAT}, p as (select a.v a, b.v b, list_transform(a.v, lambda x, i: x + 0.01 * i) c, list_transform(b.v, lambda x, i: x + 0.01 * i) d from feat a join feat b on b.observation_id = a.observation_id + 1)
select round(avg(pow(list_cosine_similarity(c, d) - list_cosine_similarity(a, b), 2)), 9) loss, count(*) pairs from p"""
)
def geometry_loss(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    moved = lambda c: F.transform(c, lambda x, i: x + F.lit(0.01) * (i + 1))
    a = e.select((F.col("vec_id") + 1).alias("k"), F.col("v").alias("a"), moved("v").alias("c"))
    b = e.select(F.col("vec_id").alias("k"), F.col("v").alias("b"), moved("v").alias("d"))
    return predict.geometry_loss(a.join(b, "k"), ("a", "b"), ("c", "d")).withColumn("loss", r9("loss"))


@query(
    f"""with {X.DIST}, l as (select anchor_observation_id q, -d_n z, true p from dist union all select anchor_observation_id, -d_s, false from dist)
select round(avg(loss), 9) loss, count(*) queries from (select q, ln(sum(exp(z / 0.1))) - max(z / 0.1) filter (p) loss from l group by 1)"""
)
def contrastive_loss(spark, sf_dir):
    p = _role_pairs(spark, sf_dir).select(F.col("pair_id").alias("q"), (-F.col("d")).alias("z"), (F.col("label") == 0).alias("p"))
    return predict.info_nce(p, "q", "z", "p", 0.1).withColumn("loss", r9("loss"))


@query(f"with {X.FEAT}, l as (select unnest(v) x, generate_subscripts(v, 1) d from feat) select round(avg(greatest(0.0::double, 0.13 - s)), 9) + 0.0 loss, count(*) dimensions from (select d, stddev_pop(x) s from l group by 1)")
def variance_hinge(spark, sf_dir):
    return predict.variance_hinge(X.table(spark, sf_dir, "embeddings"), "embedding", 0.13).withColumn("loss", r9("loss"))


@query(
    f"""with {X.FEAT}, p as (select v, list_transform(v, lambda x, i: x + 0.01 * i) u from feat), r as (select list_distance(u, v) / sqrt(list_inner_product(v, v)) r from p)
select round(quantile_cont(r, 0.5), 9) median, round(quantile_cont(r, 0.95), 9) p95 from r"""
)
def residual_ratio(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v")).withColumn("u", F.transform("v", lambda x, i: x + F.lit(0.01) * (i + 1)))
    return evaluation.residual_ratio(e, "v", "u").select(r9("median").alias("median"), r9("p95").alias("p95"))


@query("select event_id, round(0.5 * coalesce(value, 0) + 0.25 * (user_id % 3) + 0.25 * coalesce(case when user_id % 2 = 0 then 1.0 end, 0), 6) + 0.0 as evidence from events")
def evidence_fusion(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").withColumns({"b": F.col("user_id") % 3, "c": F.when(F.col("user_id") % 2 == 0, 1.0)})
    return e.select("event_id", (F.round(evaluation.fused({"value": 0.5, "b": 0.25, "c": 0.25}), 6) + 0.0).alias("evidence"))


@query(
    """with k as (select doc_id, (n_chars % 100) / 100.0 s, (doc_id % 10) / 10.0 p from documents)
select doc_id, case when s >= 0.9 and p >= 0.9 then 'ordered_and_decodable' when s >= 0.9 then 'ordered_only' when p >= 0.9 then 'decodable_only' when s < 0.5 then 'inverted' else 'neither' end regime from k"""
)
def regime_table(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    return d.select("doc_id", evaluation.regime((F.col("n_chars") % 100) / 100.0, (F.col("doc_id") % 10) / 10.0).alias("regime"))


@query(
    """with k as (select source, doc_id, lang, row_number() over (partition by source order by doc_id) r, row_number() over (partition by source order by md5('5-' || doc_id), doc_id) h,
min(lang) over (partition by source) a, max(lang) over (partition by source) b from documents where source is not null)
select x.doc_id, x.lang, y.lang permuted from k x join k y on y.source = x.source and y.h = x.r where x.a <> x.b"""
)
def shuffled_label_blocks(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return evaluation.shuffled_blocks(d, ["source"], "lang", "doc_id", 5).select("doc_id", "lang", "permuted")


@query(
    f"""with {X.DIST}, p as (select 0 y, d_n d from dist union all select 1, d_s from dist), t as (select d, (select count(*) filter (y = 1 and p.d >= q.d) from p) tp, (select count(*) filter (y = 0 and p.d < q.d) from p) tn from (select distinct d from p) q),
n as (select count(*) filter (y = 1) p, count(*) filter (y = 0) n from p)
select round(d, 9) + 0.0 threshold, round((tp / n.p + tn / n.n) / 2, 9) balanced_accuracy from t, n order by balanced_accuracy desc, d limit 1"""
)
def best_threshold(spark, sf_dir):
    t = motion.best_threshold(_role_pairs(spark, sf_dir), "d", "label")
    return t.select(r9("threshold").alias("threshold"), r9("balanced_accuracy").alias("balanced_accuracy"))


@query(
    """with k as (select least(floor(((n_chars % 97) / 97.0) * 10), 9)::int bin, (n_chars % 97) / 97.0::double p, quality::double y from labels join documents using (doc_id))
select bin, round(avg(p), 9) confidence, round(avg(y), 9) frequency, count(*) as rows from k group by 1"""
)
def calibration_bins(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 97) / 97.0).alias("p"))
    c = evaluation.calibration(X.table(spark, sf_dir, "labels").join(d, "doc_id"), "p", "quality")
    return c.select("bin", r9("confidence").alias("confidence"), r9("frequency").alias("frequency"), "rows")


@query(
    """with r as (select user_id u, event_type v from events), c as (select u, v, count(*) n from r where v is not null group by 1, 2), m as (select u, sum(n) m from c group by 1 having sum(n) > 1),
k as (select c.*, m.m from c join m using (u)), o as (select sum((m - n) * n / (m - 1)) o, sum(n) t from k), q as (select sum(c::double * c) sq from (select v, sum(n) c from k group by 1))
select round(1 - (o / t) / ((t::double * t - sq) / (t::double * (t - 1))), 9) + 0.0 alpha, t::bigint ratings from o, q"""
)
def krippendorff_alpha(spark, sf_dir):
    return segments.krippendorff(X.table(spark, sf_dir, "events"), "user_id", "event_type").withColumn("alpha", r9("alpha"))


@query("with c as (select event_id, epoch_us(ts) / 1e6 t from events where event_id % 50 = 0) select c.event_id centre_id, count(*) n from c join events e on abs(epoch_us(e.ts) / 1e6 - c.t) <= 120 group by 1")
def temporal_expansion(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    centres = e.where("event_id % 50 = 0").select(F.col("event_id").alias("centre_id"), F.col("t").alias("c"))
    return segments.around(e, "t", centres, "c", 120.0).groupBy("centre_id").agg(F.count("*").alias("n"))


@query()
def linear_probe(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings")
    p = evaluation.linear_probe(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0"), "embedding", "label", iterations=30)
    return evaluation.group_macro(p.withColumn("g", F.col("vec_id") % 7), "g", "label", "predicted")


@query()
def trained_readout(spark, sf_dir):
    """A readout trained on two thirds of the groups, and the tie-aware score before and after on the others."""
    gathered = triplets.gather(X.trip(spark, sf_dir), X.feat(spark, sf_dir))
    metric, _ = training.fit(training.sample(gathered.where("dependency_group_id % 3 <> 0")), "positive_diagonal", steps=50, rate=0.01, batch=128)
    after = triplets.with_norm(linalg.readout(X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("observation_id"), "embedding"), "embedding", metric))
    score = lambda f, name: nested.nested_mean(triplets.distances(f.where("dependency_group_id % 3 = 0")), {"sns": _score()}).select(F.lit(name).alias("readout"), "sns", "groups", "rows")
    return score(gathered, "identity").unionByName(score(triplets.gather(X.trip(spark, sf_dir), after), "trained"))


_KINEMATICS = """boxes as (select user_id s, f, 1 - (f % 3) / 4.0::double v, ((f * 37) % 1240)::double x, ((f * 53) % 690)::double y, (10 + f % 7)::double w, (5 + f % 5)::double h
  from (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 f from events)),
st as (select s, (lead(f) over q - f) / 30.0::double dt, least(v, lead(v) over q) vv, sqrt(pow(lead(x + w / 2) over q - (x + w / 2), 2) + pow(lead(y + h / 2) over q - (y + h / 2), 2)) d from boxes window q as (partition by s order by f)),
k as (select s, dt * vv wt, d / dt speed from st where dt is not null and dt * vv > 0),
r as (select *, sum(wt) over (partition by s order by speed range between unbounded preceding and current row) run, sum(wt) over (partition by s) total from k)"""


@query(
    f"""with {_KINEMATICS} select s observation_id, round(sum(wt * speed) / sum(wt), 6) speed_mean, round(min(speed) filter (run >= 0.5 * total - 1e-12), 6) speed_q50,
round(min(speed) filter (run >= 0.9 * total - 1e-12), 6) speed_q90 from r group by 1"""
)
def motion_kinematics(spark, sf_dir):
    f = F.col("frame")
    b = X.frames(spark, sf_dir).select(
        F.col("sequence_id").alias("observation_id"), "frame", F.lit(30.0).alias("fps"), (1 - (f % 3) / 4.0).alias("v"), (f * 37 % 1240).cast("double").alias("x"), (f * 53 % 690).cast("double").alias("y"),
        (10 + f % 7).cast("double").alias("w"), (5 + f % 5).cast("double").alias("h"),
    )
    k = motion.kinematics(b)
    return k.select("observation_id", *[F.round(c, 6).alias(c) for c in ("speed_mean", "speed_q50", "speed_q90")])


@query()
def mlp_probe(spark, sf_dir):
    e = X.table(spark, sf_dir, "embeddings").withColumn("g", F.col("vec_id") % 7)
    probe = training.fit_probe(*training.probe_sample(e.where("vec_id % 5 <> 0"), "vec_id", "embedding", "label", "g"), hidden=32, steps=60)
    scored = linalg.map_vectors(e.where("vec_id % 5 = 0").select("g", "label", "embedding"), "embedding", probe, "z")
    predicted = scored.withColumn("predicted", (F.array_position("z", F.array_max("z")) - 1).cast("int"))
    return evaluation.group_macro(predicted, "g", "label", "predicted")
