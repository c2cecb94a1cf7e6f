"""Retrieval, probes, preservation and gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortgeo.functions import vectors as V
from cohortgeo.operators.motion import exact_quantiles, positions, running_count
from cohortgeo.sources.shared import materialize

#: Gallery rows and queries of one cell.
CELL_ROWS, CELL_QUERIES = 20_000, 4_096


def retrieval_ranks(queries: DataFrame, gallery: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, rank) of the best gallery row of the query's label by cosine, other rows of equal cosine counted before it
    only if their key is smaller. A query never meets itself; one without any row of its label has no row here.

    Blocks of queries meet blocks of the gallery; a cell sends, per query, its best own-label match, and then the number of rows that
    beat the best of all cells.
    """
    n_g, n_q = gallery.count(), queries.count()
    g_blocks, q_blocks = -(-n_g // CELL_ROWS) or 1, -(-n_q // CELL_QUERIES) or 1
    deal = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
    shape = lambda frame: frame.select(F.col(key).cast("long").alias("k"), F.col(label).cast("long").alias("y"), F.col(vector).cast("array<double>").alias("v"))
    unit = lambda column: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(np.stack(column.to_numpy()))
    g = shape(gallery).withColumn("g", deal(F.col("k"), g_blocks, 1)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    q = shape(queries).withColumn("q", deal(F.col("k"), q_blocks, 2)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(g_blocks - 1))))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"k": [], "y": [], "s": [], "m": []})
        s = np.round(unit(left["v"]) @ unit(right["v"]).T, 12)
        own = (left["y"].to_numpy()[:, None] == right["y"].to_numpy()) & (left["k"].to_numpy()[:, None] != right["k"].to_numpy())
        s = np.where(own, s, -np.inf)
        top = s.max(1)
        name = np.where(s == top[:, None], right["k"].to_numpy(), np.iinfo(np.int64).max).min(1)
        ok = np.isfinite(top)
        return pd.DataFrame({"k": left["k"][ok], "y": left["y"][ok], "s": top[ok], "m": name[ok]})

    cells = q.groupBy("q", "g").cogroup(g.groupBy("q", "g")).applyInPandas(best, "k long, y long, s double, m long")
    target = cells.groupBy("k").agg(F.max(F.struct("s", (-F.col("m")).alias("m"))).alias("t")).select("k", F.col("t.s").alias("s"), (-F.col("t.m")).alias("m"))
    asked = q.join(target, "k")

    def ahead(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"k": [], "y": [], "n": []})
        s = np.round(unit(left["v"]) @ unit(right["v"]).T, 12)
        line, key_ = left["s"].to_numpy()[:, None], right["k"].to_numpy()
        n = (((s > line) | ((s == line) & (key_ < left["m"].to_numpy()[:, None]))) & (left["k"].to_numpy()[:, None] != key_)).sum(1)
        return pd.DataFrame({"k": left["k"], "y": left["y"], "n": n})

    counts = asked.groupBy("q", "g").cogroup(g.groupBy("q", "g")).applyInPandas(ahead, "k long, y long, n long")
    return counts.groupBy("k", "y").agg((F.sum("n") + 1).alias("rank")).select(F.col("k").alias(key), F.col("y").alias(label), "rank")


def matched_retrieval(queries: DataFrame, gallery: DataFrame, on: list[str], key: str, vector: str, label: str, start: str, end: str) -> DataFrame:
    """X15 with hard negatives: (key, rank) of a query's best own-label match among the gallery rows that share the columns `on` (source,
    category, state) and no frame with it; other rows of equal cosine are before it only if their key is smaller. Queries without such a match
    have no row. The stated queries meet all rows of their context."""
    side = lambda f, p: f.select(*on, *[F.col(c).alias(f"{p}{n}") for n, c in (("k", key), ("y", label), ("s", start), ("e", end))], V.doubles(F.col(vector)).alias(f"{p}v"))
    apart = (F.col("qe") < F.col("gs")) | (F.col("ge") < F.col("qs"))
    cos = V.dot(F.col("qv"), F.col("gv")) / (V.norm(F.col("qv")) * V.norm(F.col("gv")))
    scored = side(queries, "q").join(side(gallery, "g"), on).where((F.col("qk") != F.col("gk")) & apart).select("qk", "gk", (F.col("qy") == F.col("gy")).alias("own"), F.round(cos, 12).alias("c"))
    best = scored.where("own").groupBy("qk").agg(F.max(F.struct("c", (-F.col("gk")).alias("n"))).alias("b"))
    ahead = (F.col("c") > F.col("b.c")) | ((F.col("c") == F.col("b.c")) & (F.col("gk") < -F.col("b.n")))
    return scored.join(best, "qk").groupBy(F.col("qk").alias(key)).agg((F.count_if(ahead) + 1).alias("rank"))


def retrieval_summary(ranks: DataFrame) -> DataFrame:
    return ranks.agg(
        F.avg((F.col("rank") <= 1).cast("double")).alias("recall_1"), F.avg((F.col("rank") <= 5).cast("double")).alias("recall_5"),
        F.avg(1.0 / F.col("rank")).alias("mrr"), F.count("*").alias("queries"),
    )


def group_macro(predictions: DataFrame, group: str, label: str, predicted: str) -> DataFrame:
    """Means over groups of balanced accuracy (mean recall of the group's labels), macro F1 and accuracy."""
    cells = predictions.groupBy(F.col(group).alias("g"), F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    truth = cells.groupBy("g", F.col("y").alias("c")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy("g", F.col("p").alias("c")).agg(F.sum("n").alias("s"))
    both = truth.join(said, ["g", "c"], "left").select("g", "t", "hit", F.coalesce("s", F.lit(0)).alias("s"))
    per = both.groupBy("g").agg(
        F.avg(F.col("hit") / F.col("t")).alias("balanced_accuracy"), F.avg(2 * F.col("hit") / (F.col("t") + F.col("s"))).alias("macro_f1"), (F.sum("hit") / F.sum("t")).alias("accuracy")
    )
    return per.agg(*[F.avg(c).alias(c) for c in ("balanced_accuracy", "macro_f1", "accuracy")], F.count("*").alias("groups"))


def calibration(predictions: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """Per bin of equal width, rows, mean probability and share of label 1."""
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return predictions.groupBy(b.alias("bin")).agg(F.avg(probability).alias("confidence"), F.avg(F.col(label).cast("double")).alias("frequency"), F.count("*").alias("rows"))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.abs(F.col("confidence") - F.col("frequency")) * F.col("rows")) / F.sum("rows")).alias("ece"))


def linear_probe(train: DataFrame, rows: DataFrame, vector: str, label: str, weight: str | None = None, iterations: int = 100, penalty: float = 1e-4) -> DataFrame:
    """Multinomial logistic regression, with row weights; `rows` with `predicted`. Labels are whole numbers from 0."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    shape = lambda f: f.withColumn("__features", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("__label", F.col(label).cast("double"))
    model = LogisticRegression(featuresCol="__features", labelCol="__label", predictionCol="__predicted", rawPredictionCol="__raw", probabilityCol="__p", maxIter=iterations, regParam=penalty, family="multinomial")
    if weight:
        model = model.setWeightCol(weight)
    fitted = model.fit(shape(train))
    return fitted.transform(shape(rows)).withColumn("predicted", F.col("__predicted").cast("int")).drop("__features", "__label", "__raw", "__p", "__predicted")


def class_recall(predictions: DataFrame, label: str, predicted: str) -> DataFrame:
    return predictions.groupBy(label).agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("recall"), F.count("*").alias("rows"))


def prior_baseline(train: DataFrame, rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The most frequent training label of each key (ties: the smallest label), else of all."""
    counts = train.groupBy(*keys, label).agg(F.count("*").alias("n"))
    top = lambda frame, by: frame.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("y"))).alias("t")).select(*by, F.col("t.y").alias("y"))
    per = top(counts, keys).withColumnRenamed("y", "__own")
    whole = train.groupBy(label).agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("y"))).alias("t")).select(F.col("t.y").alias("__all"))
    return rows.join(per, keys, "left").crossJoin(F.broadcast(whole)).withColumn("predicted", F.coalesce("__own", "__all")).drop("__own", "__all")  # one row


def ipf_weights(rows: DataFrame, a: str, b: str, rounds: int = 20) -> DataFrame:
    """(a, b, weight) such that all values of `a` weigh alike in sum, and all of `b`: alternate scaling of the table of counts. The
    stopping rule is open in the reference; `rounds` is ours. The table has a row per pair of values."""
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    table = cells.toPandas()
    w = np.ones(len(table))
    i, j = pd.factorize(table[a])[0], pd.factorize(table[b])[0]
    n = table["n"].to_numpy(float)
    for _ in range(rounds):
        for code in (i, j):
            mass = np.bincount(code, w * n)
            w = w * (n.sum() / len(mass)) / mass[code]
    return rows.sparkSession.createDataFrame(table.assign(weight=w).drop(columns="n"))


def shuffled_blocks(segments: DataFrame, strata: list[str], label: str, key: str, seed: int) -> DataFrame:
    """Labels permuted among the segments of each stratum; strata with one label only are left out. The permutation pairs the
    stratum's order by a seeded hash with its order by key, as two places and one join: no task holds a stratum."""
    mixed = segments.groupBy(*strata).agg(F.min(label).alias("__a"), F.max(label).alias("__b")).where("__a <> __b").select(*strata)
    rows = segments.join(mixed, strata)
    by_key = positions(rows, strata, [F.col(key)], "__r")
    mark = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
    by_hash = positions(rows.select(*strata, key, F.col(label).alias("permuted")), strata, [mark, F.col(key)], "__r").drop(key)
    return by_key.join(by_hash, [*strata, "__r"]).drop("__r")


def mean_ranks(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Rank by value, ties at their mean."""
    counts = rows.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ranks = running_count(counts, "__v", "__n").select("__v", (F.col("before") + (F.col("__n") + 1) / 2).alias(out))
    return rows.join(ranks, rows[value] == ranks["__v"]).drop("__v")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of mean ranks."""
    return mean_ranks(mean_ranks(rows, x, "__rx"), y, "__ry").agg(F.corr("__rx", "__ry").alias("spearman"), F.count("*").alias("rows"))


def residual_ratio(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Median and p95 of |after - before| / |before|."""
    a, b = V.doubles(F.col(before)), V.doubles(F.col(after))
    q = exact_quantiles(rows.select((V.distance(b, a) / V.norm(a)).alias("r")), [], "r", [0.5, 0.95])
    return q.select(F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"))


def pool_agreement(left: DataFrame, right: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean cosine of the rows that both pools have, and whether it says that they are one pool (over 0.999)."""
    side = lambda f, n: f.select(key, V.doubles(F.col(vector)).alias(n))
    both = side(left, "a").join(side(right, "b"), key)
    cos = V.dot(F.col("a"), F.col("b")) / (V.norm(F.col("a")) * V.norm(F.col("b")))
    return both.agg(F.avg(cos).alias("mean_cosine"), F.count("*").alias("rows")).withColumn("degenerate", F.col("mean_cosine") > 0.999)


def fused(scores: dict[str, float]) -> Column:
    """Weighted evidence; a missing part counts 0."""
    out = F.lit(0.0)
    for name, weight in scores.items():
        out = out + F.lit(weight) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return out


def redundancy_selection(rows: DataFrame, group: str, key: str, quality: str, vector: str, penalty: float, k: int) -> DataFrame:
    """Of each group k rows, one by one, by quality less `penalty` times the greatest cosine to those taken; (.., rank, gain), ties to
    the smaller key.

    k rounds: the best row of each group is an aggregate, summed where rows stand, and goes back to its group's rows by a join, which
    adaptive execution may split. Each round is a table in the shared folder. No task holds a group.
    """
    v = V.doubles(F.col(vector))
    left = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(quality).cast("double").alias("q"), v.alias("x"), F.lit(0.0).alias("near"))
    left, out = left.withColumn("x", V.l2_normalize(F.col("x"), V.norm(F.col("x")))), None
    for rank in range(1, k + 1):
        gain = F.col("q") - F.lit(penalty) * F.col("near")
        best = materialize(left.groupBy("g").agg(F.min_by(F.struct("k", "x", gain.alias("gain")), F.struct((-gain).alias("a"), F.col("k").alias("b"))).alias("t")))
        taken = best.select(F.col("g").alias(group), F.col("t.k").alias(key), F.lit(rank).alias("rank"), F.col("t.gain").alias("gain"))
        out = taken if out is None else out.unionByName(taken)
        if rank < k:
            b = best.select(F.col("g").alias("__g"), F.col("t.k").alias("__k"), F.col("t.x").alias("__x"))
            near = V.dot(F.col("x"), F.col("__x"))
            rest = left.join(b, F.col("g").eqNullSafe(F.col("__g"))).where("k <> __k")
            left = materialize(rest.select("g", "k", "q", "x", (near if rank == 1 else F.greatest("near", near)).alias("near")))
    return out


def gates(values: dict[str, tuple[float, str, float]], spark) -> DataFrame:
    """(gate, value, passes) of named rules (value, one of <, <=, >=, >, bound); a gate after a failed one is `blocked`."""
    tests = {"<": float.__lt__, "<=": float.__le__, ">=": float.__ge__, ">": float.__gt__}
    rows, open_ = [], True
    for i, (name, (value, op, bound)) in enumerate(values.items()):
        ok = tests[op](float(value), float(bound))
        rows.append((i, name, float(value), op, float(bound), ok, not open_))
        open_ = open_ and ok
    return spark.createDataFrame(rows, "position int, gate string, value double, op string, bound double, passes boolean, blocked boolean")


def regime(score: Column, probe: Column, low: float = 0.5, high: float = 0.9) -> Column:
    """The rule table of ordering score against probe accuracy."""
    return F.when((score >= high) & (probe >= high), "ordered_and_decodable").when(score >= high, "ordered_only").when(probe >= high, "decodable_only").when(score < low, "inverted").otherwise("neither")

