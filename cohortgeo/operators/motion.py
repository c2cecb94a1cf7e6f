"""Motion controls."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortgeo.functions import vectors as V
from cohortgeo.sources.shared import materialize


@dataclass(frozen=True)
class MotionScaler:
    """M1: median, max(IQR, floor) and which dimensions vary."""

    median: list[float]
    denominator: list[float]
    active: list[bool]

    def transform(self, motion: Column) -> Column:
        """M2: (x - median) / denominator of the varying dimensions, as floats; a null, a non-finite value or another width raises."""
        k = len(self.median)
        bad = (F.size(motion) != k) | F.exists(motion, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        fields = [((motion[i] - self.median[i]) / self.denominator[i]).cast("float") for i in range(k) if self.active[i]]
        stop = F.raise_error(F.lit("null or non-finite motion coordinates, or another width, cannot be scaled")).cast("array<float>")
        return F.when(F.coalesce(bad, F.lit(True)), stop).otherwise(F.array(*fields))


def scaler_table(frame: DataFrame, motion: str, floor: float | list[float] = 1e-6, constant_tolerance: float = 0.0) -> DataFrame:
    """A row per dimension: dim, median, iqr, span, denominator, active. Percentiles are exact, by linear interpolation."""
    long = frame.select(F.posexplode(V.doubles(F.col(motion))).alias("dim", "x"))
    stats = exact_quantiles(long, ["dim"], "x", [0.25, 0.5, 0.75])
    floors = F.lit(float(floor)) if isinstance(floor, (int, float)) else F.array(*map(F.lit, floor))[F.col("dim")]
    iqr, span = F.col("q")[2] - F.col("q")[0], F.col("most") - F.col("least")
    return stats.select("dim", F.col("q")[1].alias("median"), iqr.alias("iqr"), span.alias("span"), F.greatest(iqr, floors).alias("denominator"), (span > constant_tolerance).alias("active"), "n")


def fit_scaler(frame: DataFrame, motion: str, floor: float | list[float] = 1e-6, constant_tolerance: float = 0.0) -> MotionScaler:
    """M1, on training rows; values must be complete and finite, rows at least two and one dimension not constant."""
    floors = [floor] if isinstance(floor, (int, float)) else floor
    if not all(np.isfinite(f) and f > 0 for f in floors):
        raise ValueError("native floors must be finite and positive")
    m = F.col(motion)
    bad = frame.agg(
        F.count_if(m.isNull() | F.exists(m, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("bad"),
        F.count_distinct(F.size(m)).alias("widths"),
        F.count("*").alias("n"),
    ).first()
    if bad["n"] < 2 or bad["widths"] != 1 or bad["bad"]:
        raise ValueError("motion values must be complete and finite, of one width, in at least two rows")
    rows = scaler_table(frame, motion, floor, constant_tolerance).orderBy("dim").collect()  # one row per dimension
    if not any(r["active"] for r in rows):
        raise ValueError("all train motion dimensions are constant")
    return MotionScaler([r["median"] for r in rows], [r["denominator"] for r in rows], [r["active"] for r in rows])


def triplet_mismatch(anchor: Column, nuisance: Column, state: Column) -> tuple[Column, Column, Column]:
    """M4: norm of the difference of signed changes, norm of the difference of their sizes, and the mean level of change."""
    sn, ss = V.signed_change(anchor, nuisance), V.signed_change(anchor, state)
    size = lambda v: F.transform(v, F.abs)
    return V.distance(sn, ss), V.distance(size(sn), size(ss)), (V.norm(sn) + V.norm(ss)) / 2.0


def caliper_grid(mismatch: DataFrame, grid: list[tuple[float, float]], quality: str = "quality") -> DataFrame:
    """Coverage of each (signed, severity) caliper pair, all in one pass over the rows."""
    hits = [
        F.struct(
            F.lit(a).alias("signed_caliper"),
            F.lit(b).alias("severity_caliper"),
            F.avg(F.coalesce((F.col("signed") <= a) & (F.col("severity") <= b) & F.col(quality), F.lit(False)).cast("double")).alias("coverage"),
        )
        for a, b in grid
    ]
    return mismatch.agg(F.array(*hits).alias("g")).select(F.inline("g"))


def select_caliper(coverage: DataFrame, least: float = 0.5) -> DataFrame:
    """The smallest caliper pair with enough coverage: by the sum of both, then the signed one."""
    return coverage.where(F.col("coverage") >= least).orderBy(F.col("signed_caliper") + F.col("severity_caliper"), "signed_caliper").limit(1)


def pair_violations(pairs: DataFrame, label: str = "label", pair: str = "pair_id", group: str = "dependency_group_id") -> DataFrame:
    """M6's checks: pairs that aren't exactly one role 0 and one role 1 of one group."""
    return (
        pairs.groupBy(pair)
        .agg(F.count("*").alias("n"), F.count_if(F.col(label) == 0).alias("zeros"), F.count_if(F.col(label) == 1).alias("ones"), F.count_distinct(group).alias("groups"))
        .where("n <> 2 or zeros <> 1 or ones <> 1 or groups <> 1")
    )


def coin(seed: int, replicate: Column, group: Column) -> Column:
    """M6: whether a group's labels are swapped in a replicate: the first bit of the MD5 of seed, replicate and group."""
    return F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), replicate.cast("string"), group.cast("string"))), 1, 1) < "8"


def permute_roles(pairs: DataFrame, seed: int, replicate: Column | int = 0, label: str = "label", group: str = "dependency_group_id") -> DataFrame:
    """M6: a coin for each group (and replicate) flips all its labels. The coin is a hash of seed, replicate and group, so it is the same
    wherever the row is and no list of groups is ever needed."""
    which = F.lit(replicate) if isinstance(replicate, int) else replicate
    return pairs.withColumn("permuted", F.when(coin(seed, which, F.col(group)), 1 - F.col(label)).otherwise(F.col(label)).cast("int"))


def auroc(frame: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties at their mean rank. Ranks come from counts by distinct score: the running count is
    over distinct scores, in partitions of their ranges, and not over rows in one task."""
    counts = frame.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    below = running_count(counts, "s", "n")
    return below.agg(
        F.expr("(sum(p * (before + (n + 1) / 2.0D)) - sum(p) * (sum(p) + 1) / 2.0D) / (sum(p) * (sum(n) - sum(p)))").alias("auroc"),
        F.sum("p").alias("positives"),
        F.expr("sum(n) - sum(p)").alias("negatives"),
    )


def best_threshold(frame: DataFrame, score: str, label: str) -> DataFrame:
    """The rule `score >= threshold` of greatest balanced accuracy (ties: the smallest threshold)."""
    counts = frame.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    below = running_count(counts, "s", "n").select("s", "n", "p", "before")
    positives = running_count(counts, "s", "p").select("s", F.col("before").alias("p_before"))
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))
    rates = below.join(positives, "s").crossJoin(F.broadcast(total))  # one row
    accuracy = ((F.col("all_p") - F.col("p_before")) / F.col("all_p") + (F.col("before") - F.col("p_before")) / (F.col("all_n") - F.col("all_p"))) / 2
    return rates.select(F.struct((-accuracy).alias("loss"), F.col("s")).alias("r")).agg(F.min("r").alias("r")).select(F.col("r.s").alias("threshold"), (-F.col("r.loss")).alias("balanced_accuracy"))


def running_count(counts: DataFrame, order: str, n: str, by: tuple[str, ...] = ()) -> DataFrame:
    """`before`: the sum of n over smaller values of `order` (distinct within `by`). Dealt by ranges; each range's total is a row, summed for all
    ranges before, so no window spans the whole table. Ranges come from a sample, so they are written down once and not made twice."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(counts.repartitionByRange(parts, *by, order).withColumn("__p", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "__p").agg(F.sum(n).alias("__t"))
    ahead = totals.withColumn("__a", F.sum("__t").over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).drop("__t")
    inner = Window.partitionBy(*by, "__p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return _beside(ranged.withColumn("__b", F.sum(n).over(inner)), ahead, by).withColumn("before", F.coalesce("__a", F.lit(0)) + F.coalesce("__b", F.lit(0))).drop("__p", "__a", "__b")


def _beside(rows: DataFrame, small: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """rows with what `small` says of their range (and `by`, null as a value): a row for each range if `by` is empty."""
    if not by:
        return rows.join(F.broadcast(small), "__p")
    names = {c: f"__k{i}" for i, c in enumerate(by)}
    right = small.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("__p").alias("__q"), "__a")
    same = F.col("__p") == F.col("__q")
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    return rows.join(right, same).drop(*names.values(), "__q")


def positions(rows: DataFrame, by: list[str], order: list, out: str) -> DataFrame:
    """`out`: the row's place (from 1) among the rows of its `by` in the given order, found by ranges: no task holds a whole `by`."""
    named = rows.withColumns({f"__o{i}": o for i, o in enumerate(order)})
    keys = [f"__o{i}" for i in range(len(order))]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(named.repartitionByRange(parts, *by, *keys).withColumn("__p", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "__p").agg(F.count("*").alias("__t"))
    ahead = totals.withColumn("__a", F.sum("__t").over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).drop("__t")
    inner = ranged.withColumn("__b", F.row_number().over(Window.partitionBy(*by, "__p").orderBy(*keys)))
    return _beside(inner, ahead, tuple(by)).withColumn(out, F.coalesce("__a", F.lit(0)) + F.col("__b")).drop("__p", "__a", "__b", *keys)


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, q, n, least, most): exact percentiles by linear interpolation, from running counts of distinct values by ranges; nulls are left
    out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    placed = running_count(counts, value, "__n", tuple(by))
    total = placed.groupBy(*by).agg(F.sum("__n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    joined = placed.join(F.broadcast(total) if not by else total, by) if by else placed.crossJoin(F.broadcast(total))  # one row
    at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("__n")), F.col(value)))
    marks = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    ends = joined.groupBy(*by, "n", "least", "most").agg(*[at(F.floor(m)).alias(f"__l{i}") for i, m in enumerate(marks)], *[at(F.ceil(m)).alias(f"__h{i}") for i, m in enumerate(marks)])
    q = F.array(*[F.col(f"__l{i}") + (m - F.floor(m)) * (F.col(f"__h{i}") - F.col(f"__l{i}")) for i, m in enumerate(marks)])
    return ends.select(*by, q.alias("q"), "n", "least", "most")


def kinematics(boxes: DataFrame, observation: str = "observation_id", frame: str = "frame", fps: str = "fps") -> DataFrame:
    """Of each observation, weighted means and Q50, Q90 of centroid speed and of the rates of log area and log aspect.

    boxes: observation, frame, fps, x, y, w, h, v (visibility). An interval's weight is its time times the least visibility. A weighted
    quantile is the least value whose running weight reaches q of the total (the reference leaves interpolation open).
    """
    w = Window.partitionBy(observation).orderBy(frame)
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    dt = (F.lead(frame).over(w) - F.col(frame)) / F.col(fps)
    nxt = lambda c: F.lead(c).over(w)
    steps = boxes.select(
        observation,
        dt.alias("dt"),
        (dt * F.least("v", nxt(F.col("v")))).alias("weight"),
        (F.sqrt(F.pow(nxt(cx) - cx, 2) + F.pow(nxt(cy) - cy, 2)) / dt).alias("speed"),
        ((F.log(nxt(F.col("w") * F.col("h"))) - F.log(F.col("w") * F.col("h"))) / dt).alias("area_rate"),
        ((F.log(nxt(F.col("w") / F.col("h"))) - F.log(F.col("w") / F.col("h"))) / dt).alias("aspect_rate"),
    ).where("dt is not null and weight > 0")
    out = None
    for name in ("speed", "area_rate", "aspect_rate"):
        by = Window.partitionBy(observation).orderBy(name)  # equal values together
        total = Window.partitionBy(observation)
        ranked = steps.withColumn("run", F.sum("weight").over(by)).withColumn("total", F.sum("weight").over(total))
        part = ranked.groupBy(observation).agg(
            (F.sum(F.col("weight") * F.col(name)) / F.sum("weight")).alias(f"{name}_mean"),
            F.min(F.when(F.col("run") >= 0.5 * F.col("total") - 1e-12, F.col(name))).alias(f"{name}_q50"),
            F.min(F.when(F.col("run") >= 0.9 * F.col("total") - 1e-12, F.col(name))).alias(f"{name}_q90"),
        )
        out = part if out is None else out.join(part, observation)
    return out


def registration_bound(rows: DataFrame, observation: str, residual: str, weight: str, bound: float, share: float = 0.9) -> DataFrame:
    """(observation, quantile, valid): the least residual of background registration whose running weight reaches the share of the
    observation's whole weight, and whether it is under the bound. Rows without a positive weight or a residual don't count; an observation
    without others is not valid."""
    counted = rows.where((F.col(weight) > 0) & F.col(residual).isNotNull())
    w = Window.partitionBy(observation)
    ranked = counted.withColumn("__run", F.sum(weight).over(w.orderBy(residual))).withColumn("__all", F.sum(weight).over(w))
    found = ranked.groupBy(observation).agg(F.min(F.when(F.col("__run") >= share * F.col("__all") - 1e-12, F.col(residual))).alias("quantile"))
    return rows.select(observation).distinct().join(found, observation, "left").withColumn("valid", F.coalesce(F.col("quantile") < bound, F.lit(False)))


def quality_pass(ranges: dict[str, tuple[float, float]]) -> Column:
    """Every component within its range; null fails."""
    ok = F.lit(True)
    for name, (low, high) in ranges.items():
        ok = ok & F.coalesce(F.col(name).between(low, high), F.lit(False))
    return ok
