"""5. Approximate nearest neighbours by stable projections in a kd-tree.

Largest inner product is least distance once every vector x is scaled by the greatest norm M and given one more coordinate,
sqrt(1 - |x|^2 / M^2), and every query is scaled to norm 1 with a 0 there. PROJECTIONS normal (2-stable) projections of that space are
indexed by a kd-tree. A query visits leaves in the order of their projected distance and verifies the exact inner products of what is in
them; the squared projected distance of a point at true distance d is d^2 times a chi-square of PROJECTIONS degrees, so once the next
leaf is at a projected distance r where the chi-square distribution at r^2 / d_k^2 passes CONFIDENCE (d_k: the k-th best so far), a
point nearer than d_k would have been seen with that probability, and the query stops.

The tree has two levels. Its upper one, split at the medians of a bounded sample, deals all rows to cells (and a large cell's rows by hash
to blocks of bounded size); their boxes are known to all. Each block's own tree is the lower one. A query goes to its nearest cell first, then
in rounds to the next few, each round's up to four times as far in its order of cells, and takes its best so far with it: the same test says,
before a round sends it, which cells it needs. So a row is copied only for as many chunks of queries as come to its cell, and the work grows
with the cells that the test asks for, not with all pairs. Equal vectors of a block are one point of its tree, with all their rows, so
a vector that very many rows share costs one verification.

Defined cases: vectors that are null, zero or that hold a null, NaN or infinity take no part; null ids neither. Vectors of another length than
the query's aren't its candidates: each length is searched by itself. Rows that share an id are rows of their own, each a candidate for the
other. Ties go to the smaller id. With fewer candidates all are returned. An empty table gives no row. Columns other than id and vector
aren't read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohortgeo.llm.common import bounded_batches
from cohortgeo.sources.shared import materialize

K, EVERY = 20, 20
PROJECTIONS, CONFIDENCE, SEED = 8, 0.95, 11
#: Rows of a block, queries of a chunk, vectors of a leaf, leaves verified between two tests.
BLOCK_ROWS, BLOCK_QUERIES, LEAF, LEAVES = 16_384, 4_096, 64, 4
#: Cells of the upper tree at most, and sampled rows for each.
CELLS, SAMPLED = 1024, 64


def chi_square(x: np.ndarray, degrees: int = PROJECTIONS) -> np.ndarray:
    """Distribution function for an even number of degrees."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for j in range(1, degrees // 2):
        term = term * half / j
        total = total + term
    return 1 - np.exp(-half) * total


class KdTree:
    """Leaves of about LEAF points, split at the median of the widest coordinate; points of a leaf lie together."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        todo, leaves = [(0, len(points))], []
        while todo:
            s, e = todo.pop()
            if e - s <= LEAF:
                leaves.append((s, e))
                continue
            part = points[self.order[s:e]]
            axis = int(np.ptp(part, axis=0).argmax())
            middle = (e - s) // 2
            self.order[s:e] = self.order[s:e][np.argpartition(part[:, axis], middle)]
            todo += [(s, s + middle), (s + middle, e)]
        leaves.sort()
        self.start = np.array([s for s, _ in leaves])
        self.stop = np.array([e for _, e in leaves])
        inside = points[self.order]
        self.low = np.minimum.reduceat(inside, self.start)
        self.high = np.maximum.reduceat(inside, self.start)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Least squared distance of each query to each leaf's box."""
        out = np.zeros((len(q), len(self.start)))
        for a in range(q.shape[1]):
            x = q[:, a, None]
            gap = np.maximum(np.maximum(self.low[:, a] - x, x - self.high[:, a]), 0)
            out += gap * gap
        return out


def planes_for(dimension: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dimension + 1, PROJECTIONS))


def project_rows(vectors: np.ndarray, greatest: float) -> np.ndarray:
    norms = np.einsum("ij,ij->i", vectors, vectors)
    return np.concatenate([vectors / greatest, np.sqrt(np.maximum(1 - norms / greatest**2, 0))[:, None]], 1) @ planes_for(vectors.shape[1])


def project_queries(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return np.concatenate([vectors / length[:, None], np.zeros((len(vectors), 1))], 1) @ planes_for(vectors.shape[1])


def stops(bound: np.ndarray, kth: np.ndarray, greatest: float, norms: np.ndarray) -> np.ndarray:
    """Whether a query whose k-th best inner product is kth needn't look where the projected distance is bound (squared)."""
    # |x' - q'|^2 = 2 - 2 <x, q> / (M |q|)
    known = np.isfinite(kth)
    far = np.maximum(2 - 2 * np.where(known, kth, 0.0) / (greatest * norms), 1e-12)
    return known & (chi_square(bound / far) >= CONFIDENCE)


def search(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, greatest: float, k: int = K, kth: np.ndarray | None = None):
    """(query, row, id, score) of the k nearest of each query among the rows of one block, its own row left out. kth: what each query
    has found before; less isn't asked for."""
    order = np.lexsort((rows, ids))
    ids, rows, vectors = ids[order], rows[order], np.ascontiguousarray(vectors[order])
    # Equal vectors are one point; their rows are in order, and no query needs more than k + 1 of them.
    _, first, of = np.unique(vectors.view(f"V{vectors.dtype.itemsize * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
    by = np.argsort(of, kind="stable")
    begin = np.searchsorted(of[by], np.arange(len(first) + 1))
    points = vectors[first].astype(np.float64)
    q = queries.astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", q, q))
    before = np.full(len(q), -np.inf) if kth is None else kth
    tree = KdTree(project_rows(points, greatest))
    points = points[tree.order]
    want = k + 1
    leaves, width = len(tree.start), int((tree.stop - tree.start).max())
    out = []
    verified = 0
    for at in range(0, len(q), 128):
        x, n, least = q[at : at + 128], length[at : at + 128], before[at : at + 128]
        bound = tree.bounds(project_queries(x))
        path = np.argsort(bound, axis=1, kind="stable")
        ahead = np.take_along_axis(bound, path, 1)
        score = np.full((len(x), want), -np.inf)
        found = np.full((len(x), want), -1)
        live = np.arange(len(x))
        for step in range(0, leaves, LEAVES):
            live = live[~stops(ahead[live, step], np.maximum(score[live, -1], least[live]), greatest, n[live])]
            if not len(live):
                break
            visit = path[live, step : step + LEAVES]
            place = tree.start[visit][:, :, None] + np.arange(width)
            real = place < tree.stop[visit][:, :, None]
            place = np.where(real, place, 0).reshape(len(live), -1)
            verified += int(real.sum())
            got = np.einsum("qd,qnd->qn", x[live], points[place])
            got = np.where(real.reshape(len(live), -1), got, -np.inf)
            both, name = np.concatenate([score[live], got], 1), np.concatenate([found[live], place], 1)
            top = np.argpartition(-both, want - 1, axis=1)[:, :want]
            best = np.take_along_axis(both, top, 1)
            rank = np.argsort(-best, axis=1, kind="stable")
            score[live], found[live] = np.take_along_axis(best, rank, 1), np.take_along_axis(np.take_along_axis(name, top, 1), rank, 1)
        for i in range(len(x)):
            ok = np.isfinite(score[i])
            distinct = tree.order[found[i][ok]]
            parts = [by[begin[d] : min(begin[d] + want, begin[d + 1])] for d in distinct]
            at_ = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            value = np.repeat(score[i][ok], [len(p) for p in parts])
            other = rows[at_] != query_rows[at + i]
            at_, value = at_[other], value[other]
            rank = np.lexsort((rows[at_], ids[at_], -value))[:k]
            out.append((np.full(len(rank), at + i), rows[at_][rank], ids[at_][rank], value[rank]))
    search.verified = verified  # for tests
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (none, none, none, np.zeros(0))


class Cells:
    """The upper tree: `depth` splits on every way, at medians of a sample; boxes of what lies in its cells."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.depth = max(math.ceil(math.log2(cells)), 0) if len(sample) else 0
        self.axis, self.cut = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth)
        todo = [(1, sample)]
        while todo:
            node, part = todo.pop()
            if node >= 1 << self.depth:
                continue
            if len(part):
                self.axis[node] = np.ptp(part, axis=0).argmax()
                self.cut[node] = np.median(part[:, self.axis[node]])
            left = part[:, self.axis[node]] < self.cut[node]
            todo += [(2 * node, part[left]), (2 * node + 1, part[~left])]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return node - (1 << self.depth)


def box_bounds(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for a in range(points.shape[1]):
        x = points[:, a, None]
        gap = np.maximum(np.maximum(low[:, a] - x, x - high[:, a]), 0)
        out += gap * gap
    return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def neighbours(rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, id, score: the k rows of largest inner product found for each row where `is_query`."""
    spark = rows.sparkSession
    bounded_batches(spark)
    v = F.col("v")
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = base.where(
        "id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    )
    whole = materialize(whole.withColumns({"q": is_query(F.col("id")), "d": F.size("v"), "row": F.monotonically_increasing_id()}))
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    lengths = whole.groupBy("d").agg(F.count("*").alias("n"), F.count_if("q").alias("q"), F.max(square).alias("m")).collect()  # a row for each length
    found = None
    for n in lengths:
        if n["q"]:
            part = _of_one_length(whole.where(F.col("d") == n["d"]), n["n"], math.sqrt(n["m"]) * (1 + 1e-12), k)
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def _of_one_length(whole: DataFrame, n: int, greatest: float, k: int) -> DataFrame:
    spark = whole.sparkSession
    kinds = "id long, row long, q boolean, v array<double>, p array<double>"

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = project_rows(_matrix(b.column(3)), greatest)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(p), pa.list_(pa.float64()))], names=["id", "row", "q", "v", "p"])

    placed = whole.select("id", "row", "q", "v").mapInArrow(project, kinds)
    cells = min(-(-n // BLOCK_ROWS), CELLS)
    sample = placed.select("p").orderBy(F.xxhash64("row")).limit(cells * SAMPLED).toArrow() if cells > 1 else None  # CELLS * SAMPLED rows at most
    tree = Cells(_matrix(sample["p"]) if sample is not None else np.zeros((0, PROJECTIONS)), cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.of(_matrix(b.column(4))), pa.int64())], names=[*b.schema.names, "cell"])

    dealt = materialize(placed.mapInArrow(deal, f"{kinds}, cell long"))
    ends = [f(F.col("p")[a]).alias(f"{s}{a}") for s, f in (("l", F.min), ("h", F.max)) for a in range(PROJECTIONS)]
    boxes = dealt.groupBy("cell").agg(F.count("*").alias("n"), *ends).orderBy("cell").collect()  # CELLS rows at most
    name = np.array([b["cell"] for b in boxes])
    low, high = (np.array([[b[f"{s}{a}"] for a in range(PROJECTIONS)] for b in boxes]) for s in "lh")
    blocks = {b["cell"]: -(-b["n"] // (2 * BLOCK_ROWS)) for b in boxes}
    split = spark.createDataFrame([(int(c), int(x)) for c, x in blocks.items()], "cell long, blocks int")
    data = dealt.join(F.broadcast(split), "cell").select("id", "row", "v", "cell", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"))  # CELLS rows

    def next_cells(begin: int, end: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x, kth = _matrix(b.column(2)), b.column(3).to_numpy(zero_copy_only=False)
                bound = box_bounds(project_queries(x), low, high)
                path = np.argsort(bound, axis=1, kind="stable")
                ahead = np.take_along_axis(bound, path, 1)
                norms = np.sqrt(np.einsum("ij,ij->i", x, x))
                to = min(end, len(name))
                going = np.stack([~stops(ahead[:, s], kth, greatest, norms) for s in range(begin, to)], 1)
                who, step = np.nonzero(going)
                picked = b.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(name[path[who, begin + step]], pa.int64())], names=["id", "row", "v", "kth", "cell"])

        return run

    def meet(t: pa.Table) -> pa.Table:
        q = t["q"].to_numpy(zero_copy_only=False).astype(bool)
        ids, rows, vectors = t["id"].to_numpy(), t["row"].to_numpy(), _matrix(t["v"])
        if q.any() and not q.all():
            who, row, name_, score = search(ids[~q], rows[~q], vectors[~q], rows[q], vectors[q], greatest, k, t["kth"].to_numpy()[q])
        else:
            who, row, name_, score = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        return pa.table({"asked": rows[q][who], "row": row, "id": name_, "score": score})

    asked = dealt.where("q").select("id", "row", "v")
    best_of = Window.partitionBy("asked").orderBy(F.desc("score"), "id", "row")
    lowest = F.lit(float("-inf"))
    best, begin, end = None, 0, 1
    while begin < len(name):
        state = asked.withColumn("kth", lowest)
        if best is not None:
            last = best.where(F.col("rank") == k).select(F.col("asked").alias("row"), F.col("score").alias("last"))
            state = asked.join(last, "row", "left").select("id", "row", "v", F.coalesce("last", lowest).alias("kth"))
        sent = materialize(state.mapInArrow(next_cells(begin, end), "id long, row long, v array<double>, kth double, cell long"))
        coming = sent.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("chunks"))  # CELLS rows at most
        if coming.isEmpty():
            break
        coming = F.broadcast(coming.join(split, "cell"))
        left = data.join(coming.select("cell", "chunks"), "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        right = sent.join(coming, "cell").withColumns(
            {"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "chunk": F.pmod(F.xxhash64(F.lit(2), "row"), F.col("chunks")).cast("int")}
        )
        shape = ("cell", "block", "chunk", "id", "row", "v")
        both = left.select(*shape, F.lit(False).alias("q"), lowest.alias("kth")).unionByName(right.select(*shape, F.lit(True).alias("q"), "kth"))
        new = both.groupBy("cell", "block", "chunk").applyInArrow(meet, "asked long, row long, id long, score double")
        new = new if best is None else new.unionByName(best.drop("rank"))
        best = materialize(new.withColumn("rank", F.row_number().over(best_of)).where(F.col("rank") <= k))
        begin, end = end, 4 * end
    names = dealt.where("q").select(F.col("row").alias("asked"), F.col("id").alias("query_id"))
    return best.join(names, "asked").select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op5_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % EVERY == 0)
