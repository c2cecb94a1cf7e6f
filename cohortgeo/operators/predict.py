"""Predictor baselines, coverage reports and auxiliary losses."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortgeo.functions import vectors as V
from cohortgeo.operators.linalg import Moments, map_vectors, moments, variances

HORIZONS = (1, 2, 4, 8)
#: Shortest segment that a predictor of eight past steps and the longest horizon can use.
LEAST_STEPS = 17

STATE_TRANSITIONS = (
    "transition_id string, video_id string, object_instance_id string, object_name string, start_ts double, end_ts double, state_before string, state_after string, location_before string, "
    "location_after string, symbolic_confidence double, visual_validity double, before_chunk_id string, after_chunk_id string, transition_type string, feature_version string"
)
VISUAL_STATE_KEYS = (
    "key_id string, transition_id string, object_instance_id string, faiss_index_name string, faiss_vector_id long, key_type string, backbone string, adapter_version string, created_at timestamp"
)


def key_violations(frame: DataFrame, key: str) -> DataFrame:
    """Values of a primary key that are null or repeated."""
    return frame.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1))


def usable_sequences(rows: DataFrame, sequence: str, order: str, stride: int = 1, least: int = LEAST_STEPS) -> DataFrame:
    """Rows of maximal stretches of a fixed stride that are long enough, with `segment`."""
    w = Window.partitionBy(sequence).orderBy(order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) != stride).cast("int"), F.lit(1))
    marked = rows.withColumn("__new", new).withColumn("segment", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")
    return marked.withColumn("__n", F.count("*").over(Window.partitionBy(sequence, "segment"))).where(F.col("__n") >= least).drop("__n")


def copy_last(rows: DataFrame, sequence: str, order: str, vector: str, horizons=HORIZONS) -> DataFrame:
    """Per horizon, the mean cosine of a row to the row that many places later: the floor that any predictor has to beat."""
    w = Window.partitionBy(sequence).orderBy(order)
    base = rows.select(sequence, order, V.doubles(F.col(vector)).alias("v")).withColumn("n", V.checked_norm(F.col("v")))
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("v", h).over(w).alias("u"), F.lead("n", h).over(w).alias("m")) for h in horizons])
    pairs = base.select("v", "n", ahead.alias("a")).select("v", "n", F.inline("a")).where("u is not null")
    return pairs.groupBy("horizon").agg(F.avg(V.dot(F.col("v"), F.col("u")) / (F.col("n") * F.col("m"))).alias("cosine"), F.count("*").alias("rows"))


def coverage(rows: DataFrame, matched: Column, strata: list[str]) -> DataFrame:
    """Share of matched rows by each stratum column and in all, by grouping sets; null in a stratum column: all of it."""
    sets = [[F.col(s)] for s in strata] + [[]]
    marked = rows.withColumn("__m", F.coalesce(matched, F.lit(False)).cast("double"))
    return marked.groupingSets(sets, *[F.col(s) for s in strata]).agg(F.avg("__m").alias("coverage"), F.count("*").alias("rows"))


def geometry_loss(pairs: DataFrame, before: tuple[str, str], after: tuple[str, str]) -> DataFrame:
    """Mean squared difference of cosines before and after, over stated pairs."""
    cos = lambda a, b: V.dot(V.doubles(F.col(a)), V.doubles(F.col(b))) / (V.norm(V.doubles(F.col(a))) * V.norm(V.doubles(F.col(b))))
    return pairs.agg(F.avg(F.pow(cos(*after) - cos(*before), 2)).alias("loss"), F.count("*").alias("pairs"))


def info_nce(pairs: DataFrame, query: str, logit: str, positive: str, temperature: float = 0.1) -> DataFrame:
    """Mean over queries of -log softmax of the positive's logit."""
    z = F.col(logit) / temperature
    top = pairs.groupBy(query).agg(F.max(z).alias("top"))
    per = pairs.join(top, query).groupBy(query).agg(
        (F.log(F.sum(F.exp(z - F.col("top")))) + F.max("top") - F.max(F.when(F.col(positive), z))).alias("loss")
    )
    return per.agg(F.avg("loss").alias("loss"), F.count("*").alias("queries"))


def variance_hinge(rows: DataFrame, vector: str, gamma: float) -> DataFrame:
    """Mean over dimensions of max(0, gamma - standard deviation)."""
    return variances(rows, [], vector).agg(F.avg(F.greatest(F.lit(0.0), F.lit(gamma) - F.sqrt("v"))).alias("loss"), F.count("*").alias("dimensions"))


def covariance_loss(m: Moments) -> tuple[float, int]:
    """The squared covariances of different dimensions, summed and divided by the number of dimensions; that number."""
    c = m.covariance
    return float((c**2).sum() - (np.diag(c) ** 2).sum()) / len(c), len(c)


def identity_loss(rows: DataFrame, positive: str, negative: str, margin: float = 0.1) -> DataFrame:
    """Mean of max(0, margin + distance to the same object - distance to another)."""
    return rows.agg(F.avg(V.hinge(F.col(positive), F.col(negative), margin)).alias("loss"), F.count("*").alias("rows"))


def cross_entropy(rows: DataFrame, probabilities: str, label: str) -> DataFrame:
    """X19, the direction head's loss: mean of -log of the label's probability; labels are places in the array from 0, null ones are left
    out."""
    return rows.where(F.col(label).isNotNull()).agg(F.avg(-F.log(F.col(probabilities)[F.col(label).cast("int")])).alias("loss"), F.count("*").alias("rows"))


@dataclass(frozen=True)
class LinearAr:
    """The next change of a sequence as a linear map of the last, with an offset."""

    matrix: np.ndarray
    offset: np.ndarray


def _changes(rows: DataFrame, sequence: str, order: str, vector: str) -> DataFrame:
    """Each row's vector `v`, the change `c` that led to it and the change `x` after it."""
    w = Window.partitionBy(sequence).orderBy(order)
    base = rows.select(sequence, order, V.doubles(F.col(vector)).alias("v"))
    less = lambda a, b: F.zip_with(a, b, lambda p, q: p - q)
    return base.withColumns({"c": less(F.col("v"), F.lag("v").over(w)), "x": less(F.lead("v").over(w), F.col("v"))})


def fit_linear_ar(train: DataFrame, sequence: str, order: str, vector: str, penalty: float = 1e-6) -> LinearAr:
    """Least squares of each next change on the last one, from one Gram matrix that tasks add up; `penalty` (a share of the mean square
    of a coordinate) keeps it solvable where changes don't span the space."""
    steps = _changes(train, sequence, order, vector).where("c is not null and x is not null").select(F.concat("c", "x", F.array(F.lit(1.0))).alias("z"))
    m = moments(steps, "z")
    if m.n < 2:
        raise ValueError("a linear map needs two steps of three rows")
    d = len(m.total) // 2
    know = [*range(d), 2 * d]
    gram = m.gram[np.ix_(know, know)]
    ridge = np.diag([*[penalty * np.trace(gram[:d, :d]) / d] * d, 0.0])
    found = np.linalg.solve(gram + ridge, m.gram[np.ix_(know, range(d, 2 * d))])
    return LinearAr(found[:d].T, found[d])


def linear_ar(rows: DataFrame, sequence: str, order: str, vector: str, model: LinearAr, horizons=HORIZONS) -> DataFrame:
    """Per horizon h, the mean cosine of the row h places later to the row plus h predicted changes."""
    told = map_vectors(_changes(rows, sequence, order, vector).where("c is not null").drop("x"), "c", _Step(model))
    w = Window.partitionBy(sequence).orderBy(order)
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("v", h).over(w).alias("u")) for h in horizons])
    pairs = told.select("v", "c", ahead.alias("a")).select("v", "c", F.inline("a")).where("u is not null")
    guess = F.zip_with("v", F.transform("c", lambda x: x * F.col("horizon")), lambda p, q: p + q)
    made = pairs.select("horizon", "u", guess.alias("g"))
    return made.groupBy("horizon").agg(F.avg(V.dot(F.col("g"), F.col("u")) / (V.norm(F.col("g")) * V.norm(F.col("u")))).alias("cosine"), F.count("*").alias("rows"))


class _Step:
    def __init__(self, model: LinearAr):
        self.model = model

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.model.matrix.T + self.model.offset
