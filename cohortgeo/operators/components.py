"""Connected components and dependency groups (G1, G2), as an iterative DataFrame algorithm.

Alternating large-star / small-star contraction: each round only moves edges towards the smallest label of a neighbourhood, so the
edge count never grows beyond its start, a hub of any degree is handled by a partial minimum, and the number of rounds is
logarithmic in practice. Each round is written to the shared checkpoint folder, so a lost executor recomputes one round only;
the round before is deleted then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from cohortgeo.sources.shared import discard, materialize

MAX_ROUNDS = 60
#: Edges that one task closes at once, without rounds over the cluster: a bound of its memory.
AT_ONCE = 1_000_000


def _afresh(least: DataFrame, *keys: str) -> DataFrame:
    """The same rows, with keys that the planner takes for new ones: the join then deals both its sides itself, and adaptive execution
    can split a hub's rows over tasks, which it can't where a side comes straight from an aggregation by the key."""
    return least.select(*[F.when(F.col("m").isNotNull(), F.col(k)).alias(k) for k in keys or ("u",)], "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the smallest label in the node's neighbourhood (itself included)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(_afresh(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(_afresh(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and an order-free sum of hashes. (Not by an Observation: once a session has one, plans that
    carry the session along can't be sent to executors.)"""
    out = materialize(edges)
    return out, tuple(out.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first())


def _closed(edges: DataFrame) -> DataFrame:
    """(node, component) of few edges, in one task: the smallest label goes over edges, then over labels, until none changes."""
    kind = edges.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        t = pa.Table.from_batches(found)
        nodes = pc.unique(pa.chunked_array([*t["u"].chunks, *t["v"].chunks]))
        nodes = nodes.take(pc.sort_indices(nodes))
        a, b = (pc.index_in(t[c], value_set=nodes).to_numpy().astype(np.int64) for c in ("u", "v"))
        label = np.arange(len(nodes))
        while True:
            old = label.copy()
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            np.minimum.at(label, old, label)
            label = label[label]
            if (label == old).all():
                break
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], names=["node", "component"])

    return edges.repartition(1).mapInArrow(run, T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(node, component) for every node of `edges`, component being the smallest node reachable.

    Up to AT_ONCE edges are closed in one task, more by rounds over the cluster; the result is the same.
    Self loops and rows with a null end make no edge; repeated edges count once. Nodes without an edge do not appear. An empty table
    gives an empty result. Raises if MAX_ROUNDS is not enough, rather than return an unfinished labelling.
    """
    edges = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = _written(edges)
    if before[0] <= AT_ONCE:
        return _closed(edges)
    for _ in range(MAX_ROUNDS):
        last = edges
        edges, now = _written(_small_star(_large_star(last)))
        discard(last)  # the new table stands by itself
        if now == before:
            roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def dependency_groups(frame: DataFrame, fields: list[str], observation_column: str = "observation_id") -> DataFrame:
    """Rows that share a non-null, non-blank value of any field are one group; (observation, dependency_group_id).

    Star edges only: each (field, value) links its observations to the smallest of them, n - 1 edges and never n squared. The group
    id is `dep_` and the smallest observation (as text). Duplicate or null observation ids raise ValueError.
    """
    ids = frame.select(F.col(observation_column).cast("string").alias("o"))
    bad = ids.groupBy("o").count().where("count > 1 or o is null").limit(1).count()
    if bad:
        raise ValueError(f"{observation_column} must be unique and not null")
    pairs = frame.select(
        F.col(observation_column).cast("string").alias("o"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("val")) for f in fields])).alias("k"),
    ).select("o", "k.f", "k.val").where("val is not null and trim(val) <> ''")
    least = pairs.groupBy("f", "val").agg(F.min("o").alias("m"), F.count("*").alias("n")).where("n > 1")
    edges = pairs.join(_afresh(least, "f", "val"), ["f", "val"]).where("o <> m").select(F.col("o").alias("u"), F.col("m").alias("v"))
    comp = connected_components(edges)
    return ids.join(comp, ids.o == comp.node, "left").select(
        F.col("o").alias(observation_column), F.concat(F.lit("dep_"), F.coalesce("component", "o")).alias("dependency_group_id")
    )
