"""Resampling by dependency groups: permutation tests, role models and whole-group draws."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortgeo.functions import vectors as V
from cohortgeo.operators.evaluation import mean_ranks
from cohortgeo.operators.motion import coin

#: Groups that one task draws from.
GROUPS_A_TASK = 100_000


def permutation_test(pairs: DataFrame, score: str, label: str = "label", group: str = "dependency_group_id", replicates: int = 999, seed: int = 20260820) -> DataFrame:
    """(auroc, replicates, at_least, p_value) of a score of role pairs under swaps of whole groups.

    Swaps leave the scores and their ranks as they are, so a replicate's AUROC follows from rank sums of groups and labels: rows are
    ranked once, and what is multiplied by replicates is one row a group, summed where it stands. Each group has as many labels 0 as 1.
    """
    y = F.col(label)
    ranked = mean_ranks(pairs, score, "__r")
    sums = ranked.groupBy(F.col(group).alias("g")).agg(
        F.coalesce(F.sum(F.when(y == 0, F.col("__r"))), F.lit(0.0)).alias("r0"), F.coalesce(F.sum(F.when(y == 1, F.col("__r"))), F.lit(0.0)).alias("r1"), F.count_if(y == 1).alias("n")
    )
    draws = sums.select("g", "r0", "r1", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("replicate"))
    swapped = coin(seed, F.col("replicate"), F.col("g")) & (F.col("replicate") > 0)  # replicate 0: as it is
    per = draws.groupBy("replicate").agg(F.sum(F.when(swapped, F.col("r0")).otherwise(F.col("r1"))).alias("s"), F.sum("n").alias("n"))
    auroc = per.select("replicate", ((F.col("s") - F.col("n") * (F.col("n") + 1) / 2) / (F.col("n") * F.col("n"))).alias("a"))
    seen = auroc.where("replicate = 0").select(F.col("a").alias("auroc"))
    return auroc.where("replicate > 0").crossJoin(F.broadcast(seen)).groupBy("auroc").agg(  # one row
        F.count("*").alias("replicates"), F.count_if(F.col("a") >= F.col("auroc") - 1e-12).alias("at_least")
    ).withColumn("p_value", (F.col("at_least") + 1) / (F.col("replicates") + 1))


def role_features(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """`features`, the model's input for a pair of motion vectors: both, the signed change and its size."""
    change = V.signed_change(F.col(a), F.col(b))
    return pairs.withColumn("features", F.concat(F.col(a), F.col(b), change, F.transform(change, F.abs)))


def role_model(train: DataFrame, rows: DataFrame, a: str, b: str, label: str = "label", penalty: float = 1e-2, iterations: int = 50) -> DataFrame:
    """`rows` with `probability` of label 1 by a regularised logistic regression on role_features, fitted on `train`."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    shape = lambda f: role_features(f, a, b).withColumn("__x", array_to_vector("features")).withColumn("__y", F.col(label).cast("double"))
    model = LogisticRegression(featuresCol="__x", labelCol="__y", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__c", maxIter=iterations, regParam=penalty)
    made = model.fit(shape(train)).transform(shape(rows))
    return made.withColumn("probability", vector_to_array("__p")[1]).drop("__x", "__y", "__p", "__raw", "__c", "features")


def group_bootstrap(groups: DataFrame, value: str, replicates: int = 1000, seed: int = 20260820, level: float = 0.95, key: str = "dependency_group_id") -> DataFrame:
    """(estimate, low, high, groups, replicates): percentile interval of the mean over as many whole groups as there are, drawn with
    replacement.

    Groups lie in buckets by their key. How many of a replicate's draws fall into each bucket is drawn first, from the buckets' sizes; each
    bucket then draws that many of its own groups. Together this is one draw of all groups, and no task sees more than a bucket.
    """
    rows = groups.select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("x")).where("x is not null")
    n = rows.count()
    if not n:
        raise ValueError("an interval needs a group with a value")
    buckets = -(-n // GROUPS_A_TASK)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int"))
    size = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}  # a row for each 100,000 groups
    names = sorted(size)
    share = np.random.default_rng(seed).multinomial(n, np.array([size[b] for b in names]) / n, replicates)

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["k", "x"], kind="stable")
        x, b = frame["x"].to_numpy(), int(frame["bucket"].iloc[0])
        r = np.random.default_rng([seed, b])
        s = [x[r.integers(0, len(x), m)].sum() for m in share[:, names.index(b)].tolist()]
        return pd.DataFrame({"replicate": np.arange(replicates), "s": s})

    draws = rows.groupBy("bucket").applyInPandas(draw, "replicate int, s double").groupBy("replicate").agg((F.sum("s") / n).alias("m"))
    low = (1 - level) / 2
    interval = draws.agg(F.expr(f"percentile(m, array({low}, {1 - low}))").alias("q"), F.count("*").alias("replicates"))  # a value for each replicate
    return rows.agg(F.avg("x").alias("estimate"), F.count("*").alias("groups")).crossJoin(interval).select(
        "estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "groups", "replicates"
    )


def paired_gate(before: DataFrame, after: DataFrame, value: str, bound: float, key: str = "dependency_group_id", ratio: bool = False, **draws) -> DataFrame:
    """The interval of the paired difference (or ratio) of group values, and whether its lower end is at or above the bound."""
    both = before.select(key, F.col(value).alias("__b")).join(after.select(key, F.col(value).alias("__a")), key)
    delta = F.col("__a") / F.col("__b") if ratio else F.col("__a") - F.col("__b")
    return group_bootstrap(both.withColumn("__d", delta), "__d", key=key, **draws).withColumn("passes", F.col("low") >= bound)
