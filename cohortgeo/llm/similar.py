"""Near copies of a given Jaccard similarity of word shingles: SimHash fingerprints (6) wide enough for it, and exact verification.

A text is the set of XXH64 values of its shingles of five words. A bit of a fingerprint differs between two sets with the probability
arccos(2 J / (1 + J)) / pi, 0.15 at a similarity J of 0.8. So fingerprints have two halves of several words each, and each half several
segments; sets whose segment differs by at most one bit meet in the index of `simhash.py` (deletion variants, equality join). At 0.8 a
pair has no such segment with a probability of at most 1 - RECALL, at more similarity with less still. What meets in a segment of
one half is verified on words of the other half, where unlike sets never pass. What passes is joined to components of candidates, and
their exact Jaccard similarities decide. Up to LARGE sets come to one task, where a breadth-first walk compares each newly linked set with
the sets not yet linked, so a dense group costs its size and not its square. A larger component stays where its sets lie: each set is compared
with some PIVOTS of them; what these link is made into groups; and every set outside the largest group is compared with all sets of the
component, in blocks. So each pair is compared but for those within the largest group, which is linked already, and no task holds the
component. Equal sets are one entry, whatever their number.

Segments get longer with the number of rows, and more of them are taken, so that recall is the same and unlike sets meet seldom at every
size.

Defined cases: null and empty texts, and those without a word, are the empty set and equal; a text of one to four words is one shingle. Null
ids take part; component_id is the smallest non-null id of a group. Repeated rows stay rows. An empty table gives no row. Columns other
than id and text aren't read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cohortgeo.llm.common import bounded_batches, map_batches, utf8
from cohortgeo.llm.simhash import SEED, _normal, join_index
from cohortgeo.operators.components import connected_components
from cohortgeo.sources.shared import materialize

WORDS = 5
#: The least similarity of a link, as a fraction.
LEAST = (4, 5)
#: Share of pairs of the least similarity that meet, at least; bits of the shortest segment.
RECALL, WIDTH = 0.965, 18
#: Words of a half that are verified, and the share of their bits that may differ: 3 deviations above the mean at the least similarity.
CHECK, APART = 2, 0.25
#: Shingles whose bits are summed at once, and that are Python's at once.
GROUP, PART = 1 << 15, 1 << 16
#: Sets that a task holds together; pivots of a larger component in each of ROUNDS rounds, and sets of a block that meets all others.
LARGE, PIVOTS, ROUNDS, BLOCK = 2000, 32, 2, 256
#: Rows of pivots or blocks that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 2000
#: Bits of the map that tells which texts are read again.
MAP_BITS = 26


def differs(similarity: float) -> float:
    """The probability that a bit differs between sets of a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def layout(n: int) -> tuple[int, list[np.ndarray]]:
    """Words of a half, and bit places of the segments of both halves, for `n` rows."""
    width = max(WIDTH, math.ceil(math.log2(n + 1)) - 2)
    p = differs(LEAST[0] / LEAST[1])
    meet = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    each = math.ceil(math.log(1 - RECALL) / math.log(1 - meet) / 2)
    words = max(-(-each * width // 64), CHECK)
    return words, [np.arange(k * width, (k + 1) * width) + h * 64 * words for h in (0, 1) for k in range(each)]


def shingles(data: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The text's set, sorted."""
    text, begin, end = _normal(data)
    if not len(begin):
        return np.zeros(0, np.uint64)
    width = min(words, len(begin))
    digest = xxhash.xxh64_intdigest
    begin, end = begin[: len(begin) - width + 1], end[width - 1 :]
    out = np.zeros(len(begin), np.uint64)
    for at in range(0, len(begin), PART):
        out[at : at + PART] = [digest(text[b:e], SEED) for b, e in zip(begin[at : at + PART].tolist(), end[at : at + PART].tolist())]
    return np.unique(out)


def _mixed(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several hashes of a hash."""
    with np.errstate(over="ignore"):
        x = values + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide(sets: list[np.ndarray], words: int) -> np.ndarray:
    """A fingerprint of so many words of each set; zeros of the empty one."""
    ones, size = np.zeros((len(sets), 64 * words), np.int64), np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    for at in range(0, len(flat), GROUP):
        part, own = flat[at : at + GROUP], owner[at : at + GROUP]
        hashes = np.stack([_mixed(part, k) for k in range(words)], 1)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.uint64).reshape(len(sets), words)


def sketch(docs: DataFrame, keep: list[str], text_col: str, words: int, shingle: int = WORDS) -> DataFrame:
    """`keep` (which holds text_col), the digest of each row's set, and its fingerprint's words w0, w1, ..."""

    def work(batch: pa.RecordBatch) -> dict:
        data, offsets = utf8(batch.column(batch.schema.names.index(text_col)))
        sets = [shingles(data[offsets[i] : offsets[i + 1]], shingle) for i in range(len(offsets) - 1)]
        digest = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        got = wide(sets, words).view(np.int64)
        return {"fp": digest} | {f"w{k}": np.ascontiguousarray(got[:, k]) for k in range(words)}

    return map_batches(docs, keep, ", ".join(["fp long", *(f"w{k} long" for k in range(words))]), work)


def groups(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first of its group; groups are the components of links of LEAST similarity or more."""
    label = np.arange(len(sets))
    left = np.arange(len(sets))
    size = np.array([len(s) for s in sets])
    while len(left) > 1:
        first, left = int(left[0]), left[1:]
        todo = [first]
        while todo and len(left):
            x = todo.pop()
            like = (LEAST[0] * size[x] <= LEAST[1] * size[left]) & (LEAST[0] * size[left] <= LEAST[1] * size[x]) & (size[left] > 0)
            maybe = left[like]
            if not len(maybe):
                continue
            flat = np.concatenate([sets[i] for i in maybe])
            at = np.minimum(np.searchsorted(sets[x], flat), size[x] - 1)
            same = np.add.reduceat((sets[x][at] == flat).astype(np.int64), np.cumsum(size[maybe]) - size[maybe])
            found = maybe[LEAST[1] * same >= LEAST[0] * (size[x] + size[maybe] - same)]
            if len(found):
                label[found] = first
                todo += found.tolist()
                left = left[~np.isin(left, found)]
    return label


def _sets(base: DataFrame, picks: DataFrame, shingle: int) -> DataFrame:
    """(fp, set) of the texts of `base` whose pick is among `picks`, and of few others: a bit map of fixed size is broadcast, so that only
    these texts leave their place."""
    spark = base.sparkSession
    place = F.col("pick").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words_of = picks.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(pick & 63 as int))").alias("b"))
    got = words_of.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[got.column("w").to_numpy()] = got.column("b").to_numpy()
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(1).to_numpy() & ((1 << MAP_BITS) - 1)
            wanted = np.flatnonzero(shared.value[at >> 6] >> (at & 63) & 1)
            if len(wanted):
                data, offsets = utf8(b.column(0))
                made = [shingles(data[offsets[i] : offsets[i + 1]], shingle) for i in wanted.tolist()]
                digest = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in made], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(digest), b.column(1).take(pa.array(wanted)), pa.array([s.tobytes() for s in made], pa.binary())], names=["fp", "pick", "set"])
        pa.default_memory_pool().release_unused()

    bounded_batches(spark)
    return base.select("text", "pick").mapInArrow(run, "fp long, pick long, set binary")


def _linked(sets: DataFrame) -> DataFrame:
    """(fp, head) of (component, fp, set): each digest and the first of its group."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for c, fp, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                held.setdefault(c, []).append((fp, np.frombuffer(s.as_py(), np.uint64)))
        out = []
        for members in held.values():
            members.sort(key=lambda x: x[0])
            label = groups([s for _, s in members])
            out += [(members[i][0], members[k][0]) for i, k in enumerate(label.tolist())]
        held.clear()
        if out:
            fp, head = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(head)], names=["fp", "head"])
        pa.default_memory_pool().release_unused()

    return sets.select("component", "fp", "set").repartition(parts, "component").mapInArrow(run, "fp long, head long")


def _alike(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sets are like x."""
    size = np.array([len(s) for s in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(x, flat), max(len(x) - 1, 0))
    same = np.concatenate([[0], np.cumsum(x[at] == flat)])
    ends = np.cumsum(size)
    shared = same[ends] - same[ends - size]
    return LEAST[1] * shared >= LEAST[0] * (len(x) + size - shared)


def _against(members: DataFrame, few: DataFrame) -> DataFrame:
    """(u, v): links of the members (component, fp, set) with the sets that `few` (component, some: [(fp, set)]) has of their component."""
    side = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few  # a row holds some hundred sets at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = [], []
            for fp, mine, some in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                like = _alike(np.frombuffer(mine, np.uint64), [np.frombuffer(s["set"], np.uint64) for s in some])
                other = [s["fp"] for s, ok in zip(some, like) if ok and s["fp"] != fp]
                u += [fp] * len(other)
                v += other
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return members.join(side, "component").select("fp", "set", "some").mapInArrow(run, "u long, v long")


def _linked_large(sets: DataFrame) -> DataFrame:
    """(fp, head) of (component, fp, set) of large components."""
    size = sets.groupBy("component").agg(F.count("*").alias("n"))
    sets = sets.join(size, "component")
    entry = F.collect_list(F.struct("fp", "set")).alias("some")
    edges = None
    for k in range(ROUNDS):
        pivots = sets.where(F.pmod(F.xxhash64("fp", F.lit(k)), F.greatest(F.floor(F.col("n") / PIVOTS), F.lit(1))) == 0).groupBy("component").agg(entry)
        found = _against(sets, pivots)
        edges = found if edges is None else edges.unionByName(found)
    edges = materialize(edges)
    group = connected_components(edges)
    named = sets.join(group.select(F.col("node").alias("fp"), F.col("component").alias("g")), "fp", "left").select("component", "fp", "set", F.coalesce("g", "fp").alias("g"))
    named = materialize(named)
    count = named.groupBy("component", "g").agg(F.count("*").alias("n"))
    largest = count.groupBy("component").agg(F.max(F.struct("n", "g")).alias("t")).select("component", F.col("t.g").alias("largest"))
    rest = named.join(largest, "component").where("g <> largest")
    blocks = rest.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    some = rest.join(blocks, "component").groupBy("component", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("block")).agg(entry).select("component", "some")
    edges = edges.unionByName(materialize(_against(named, some)))
    head = connected_components(edges)
    return named.join(head.select(F.col("node").alias("fp"), F.col("component").alias("head")), "fp", "left").select("fp", F.coalesce("head", "fp").alias("head"))


def _heads(sets: DataFrame) -> DataFrame:
    """(fp, head): each digest of (component, fp, set) and the name of its group."""
    size = sets.groupBy("component").agg(F.count("*").alias("n"))
    big = materialize(size.where(F.col("n") > LARGE).select("component"))
    if big.isEmpty():
        return _linked(sets)
    known = F.broadcast(big) if big.count() <= BROADCAST_ROWS else big
    return _linked(sets.join(known, "component", "left_anti")).unionByName(_linked_large(sets.join(known, "component", "left_semi")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS) -> DataFrame:
    """id, pick (a hash of id and text) and component_id of each row."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("pick", F.xxhash64("id", "text"))
    n = base.count()
    half, segments = layout(n)
    names = [f"w{k}" for k in range(2 * half)]
    marked = materialize(sketch(base, ["id", "pick", "text"], "text", 2 * half, shingle).drop("text"))
    least = materialize(marked.groupBy("fp").agg(F.min("id").alias("least"), F.min("pick").alias("pick"), *(F.min(w).alias(w) for w in names)))
    rows = least.where(" or ".join(f"{w} <> 0" for w in names)).select("fp", *names)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # What meets in a segment of one half is verified on the other.
    checks = [names[half : half + CHECK] if places[0] < 64 * half else names[:CHECK] for places in segments]
    component = connected_components(join_index(rows.repartition(parts), n, segments, checks, int(APART * 64 * CHECK)))
    nodes = materialize(component.join(least.select("fp", "pick"), component.node == least.fp).select("component", "fp", "pick"))
    # Rows of equal id and text are picked alike.
    sets = materialize(_sets(base, nodes, shingle).join(nodes, ["fp", "pick"]).groupBy("component", "fp").agg(F.first("set").alias("set")))
    found = materialize(_heads(sets))
    members = found.join(least.select("fp", "least"), "fp")
    smallest = members.groupBy("head").agg(F.min("least").alias("smallest"))
    moved = members.join(smallest, "head").select("fp", "smallest")
    # As in op6: a key that the planner takes for a new one, so that adaptive execution splits the rows of very many equal texts.
    of = least.select("fp", "least").join(moved, "fp", "left").select(F.when(F.col("fp").isNotNull(), F.col("fp")).alias("fp"), F.coalesce("smallest", "least").alias("component_id"))
    return marked.select("id", "pick", "fp").join(of, "fp").select(F.col("id").alias(id_col), "pick", "component_id")
