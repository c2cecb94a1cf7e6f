"""6. SimHash near-duplicates by deletion-variant signatures.

Fingerprint: of all word shingles of a text (repeats included), bit j is 1 if it is set in over half of the shingles' XXH64 values.
Fingerprints of at most `bits` differing bits are linked. Cut into segments so few that one of such a pair differs by at most one bit
(three of 64 for four bits), each distinct fingerprint is indexed under every segment as it is and under every variant with one of the
segment's set bits deleted: of two segments that differ in one bit, the one with the bit set has a variant equal to the other as it is.
Equal keys meet, and pairs of which one is as it is are verified on all bits. Copies share a fingerprint and are one entry of the
index, whatever their number.

Keys of one segment are shared by chance by more and more fingerprints as these grow in number. So from some millions on segments are cut
finer and joined by twos or threes (10 pairs of 5, 20 triples of 6): of c segments together, out of bits + c - 1, some choice differs by
at most one bit as well, and its key is longer. Links are the same with each of these covers; a test holds each against all pairs.

Entries of a key meet in one Arrow partition, sorted. Short runs are compared in numpy; in a long run a breadth-first walk
compares each newly linked entry with the entries not yet linked, so a dense group costs its size and not its square. Out come star
edges (entry, smallest of its local component), at most one per entry and partition; components are then closed over all partitions.
A key's run is bounded by the distinct fingerprints that agree in all bits but one of a key, never by the number of documents.

`similar.py` makes wider fingerprints for shingles of a given similarity and joins them by the same index.

Defined cases: a null or empty text, or one without a word, has fingerprint zero and is linked like any other; a text of one to three
words is one shingle. Null ids take part; component_id is the smallest non-null id of the component. Repeated rows stay rows. An empty
table gives no row. Columns other than id and text aren't read, so their names can't clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cohortgeo.llm.common import map_batches, utf8
from cohortgeo.operators.components import connected_components
from cohortgeo.sources.shared import materialize

WORDS, SEED, BITS = 4, 42, 4
#: Texts are hashed in groups of so many shingles.
GROUP = 1 << 18
#: Runs of at most so many entries are compared pair by pair.
SHORT_RUN = 256
#: Entries that fingerprints without likeness are to have in a key, on average and at most.
BY_CHANCE = 32
#: Index entries that one partition is meant to hold.
ENTRIES = 2_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _normal(data: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's words in lower case with one space between them; where each begins and ends."""
    word = ~_SPACE[data]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return b"", begin, end
    keep = word.copy()
    keep[end[:-1]] = True  # one blank after each word but the last
    text = _LOWER[data]
    text[end[:-1]] = 32
    size = end - begin
    first = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    return text[keep].tobytes(), first, first + size


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The fingerprint of each text data[offsets[i]:offsets[i + 1]], as uint64."""
    ones = np.zeros((len(offsets) - 1, 64), np.int64)
    total = np.zeros(len(offsets) - 1, np.int64)
    hashes: list[int] = []
    owners: list[tuple[int, int]] = []
    digest = xxhash.xxh64_intdigest

    def flush() -> None:
        if not hashes:
            return
        # Bits in groups of eight: sums over each text of the bit matrix.
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bounds = np.cumsum([0, *(n for _, n in owners[:-1])])
        np.add.at(ones, [i for i, _ in owners], np.add.reduceat(bits, bounds, axis=0, dtype=np.int32))
        hashes.clear()
        owners.clear()

    for i in range(len(offsets) - 1):
        text, begin, end = _normal(data[offsets[i] : offsets[i + 1]])
        if not len(begin):
            continue
        width = min(words, len(begin))
        begin, end = begin[: len(begin) - width + 1].tolist(), end[width - 1 :].tolist()
        total[i] = len(begin)
        for at in range(0, len(begin), GROUP):
            part = [digest(text[b:e], SEED) for b, e in zip(begin[at : at + GROUP], end[at : at + GROUP])]
            hashes += part
            owners.append((i, len(part)))
            if len(hashes) >= GROUP:
                flush()
    flush()
    on = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(docs: DataFrame, keep: list[str], text_col: str = "text", words: int = WORDS) -> DataFrame:
    """`keep` (which holds text_col) and the fingerprint of each row, as a signed long."""

    def work(batch: pa.RecordBatch) -> dict:
        return {"fp": fingerprints(*utf8(batch.column(batch.schema.names.index(text_col))), words).view(np.int64)}

    return map_batches(docs, keep, "fp long", work)


def cover(n: int, bits: int = BITS, width: int = 64) -> list[np.ndarray]:
    """Bit places of each key's segment, for `n` fingerprints of `width` bits: of two that differ by at most `bits`, some segment differs by
    at most one."""
    for joined in (1, 2, 3):
        pieces = np.array_split(np.arange(width), bits // 2 + 1 if joined == 1 else bits + joined - 1)
        found = [np.concatenate(c) for c in itertools.combinations(pieces, joined)]
        short = min(map(len, found))
        if n * (1 + short / 2) <= BY_CHANCE << short:
            break
    return found


def entries(words: np.ndarray, segments: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(segment, key, as it is, row) of the index entries of fingerprints in the rows of `words`; a key is the segment's number and bits."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
    for s, places in enumerate(segments):
        here = bits[:, places].astype(np.int64)
        whole = (here << np.arange(len(places))).sum(1) | s << 48
        row, place = np.nonzero(here)
        key = np.concatenate([whole, whole[row] ^ (1 << place)])
        yield s, key, np.arange(len(key)) < len(words), np.concatenate([np.arange(len(words)), row])


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _walk(nodes: np.ndarray, words: np.ndarray, bits: int) -> tuple[list, list]:
    """Edges of a spanning forest of a long run."""
    left, a, b = np.arange(len(nodes)), [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = _differ(words[left], words[x]) <= bits
            found = left[near]
            if len(found):
                a.append(np.full(len(found), nodes[x]))
                b.append(nodes[found])
                todo += found.tolist()
                left = left[~near]
    return a, b


def linked(keys: np.ndarray, exact: np.ndarray, nodes: np.ndarray, words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Star edges (node, smallest of its component) among entries that share a key, one of them as it is, and whose words differ by at
    most `bits` bits."""
    order = np.lexsort((nodes, ~exact, keys))
    keys, exact, nodes, words = keys[order], exact[order], nodes[order], words[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([start, [len(keys)]]))
    long = size > SHORT_RUN
    a, b = [], []
    for s, n in zip(start[long].tolist(), size[long].tolist()):
        _, one = np.unique(nodes[s : s + n], return_index=True)
        x, y = _walk(nodes[s + one], words[s + one], bits)
        a += x
        b += y
    left = np.flatnonzero(exact & np.repeat(~long & (size > 1), size))
    stop = np.repeat(start + size, size)[left]
    for d in range(1, SHORT_RUN):
        more = left + d < stop
        if not more.all():
            left, stop = left[more], stop[more]
        if not len(left):
            break
        for at in range(0, len(left), 1 << 18):
            i = left[at : at + (1 << 18)]
            ok = i[_differ(words[i], words[i + d]) <= bits]
            a.append(nodes[ok])
            b.append(nodes[ok + d])
    if not a:
        return np.zeros((0, 2), np.int64)
    pairs = np.stack([np.concatenate(a), np.concatenate(b)], 1)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    nodes, ends = np.unique(pairs, return_inverse=True)
    ends = ends.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:  # smallest label over edges, then over labels
        old = label.copy()
        least = np.minimum(label[ends[:, 0]], label[ends[:, 1]])
        np.minimum.at(label, ends[:, 0], least)
        np.minimum.at(label, ends[:, 1], least)
        np.minimum.at(label, old, label)
        label = label[label]
        if (label == old).all():
            break
    star = np.stack([nodes, nodes[label]], 1)
    return star[star[:, 0] != star[:, 1]]


def join_index(distinct: DataFrame, n: int, segments: list[np.ndarray], checks: list[list[str]], bits: int) -> DataFrame:
    """(u, v): star edges among the `n` distinct rows (node, words...): of each pair that meets in segment s the words checks[s] (as many for
    each s) differ by at most `bits`."""
    names = distinct.columns[1:]
    takes = [[names.index(c) for c in check] for check in checks]
    room = [f"c{k}" for k in range(len(takes[0]))]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, words = b.column(0).to_numpy(), np.stack([c.to_numpy() for c in b.columns[1:]], 1)
            for s, key, exact, row in entries(words, segments):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(exact), pa.array(node[row]), *(pa.array(words[row, k]) for k in takes[s])], names=["key", "exact", "node", *room]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if got:
            key, exact, node, *words = (np.concatenate(x) for x in zip(*got))
            del got
            star = linked(key, exact, node, np.stack(words, 1).view(np.uint64), bits)  # popcounts want unsigned
            for at in range(0, len(star), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(star[at : at + 100_000, k]) for k in (0, 1)], names=["u", "v"])
            pa.default_memory_pool().release_unused()

    least = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(int(n * sum(1 + len(x) / 2 for x in segments)) // ENTRIES + 1, least)
    kinds = ", ".join(f"{c} long" for c in room)
    return distinct.mapInArrow(index, f"key long, exact boolean, node long, {kinds}").repartition(parts, "key").mapInArrow(run, "u long, v long")


def links(distinct: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """(u, v): star edges among `n` distinct fingerprints `fp`; their components are those of the links of at most `bits` bits."""
    segments = cover(n, bits)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.select("fp", F.col("fp").alias("word")).repartition(parts)
    return join_index(rows, n, segments, [["word"]] * len(segments), bits)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of each row."""
    marked = materialize(fingerprint(docs, [id_col, text_col], text_col, words).select(F.col(id_col).alias("id"), "fp"))
    least = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")))
    found = links(least.select("fp"), least.count())
    component = materialize(connected_components(found))
    # Smallest id of each component of two fingerprints or more; other fingerprints are their own.
    nodes = component.join(least, component.node == least.fp)
    smallest = nodes.groupBy("component").agg(F.min("least").alias("smallest"))
    moved = nodes.join(smallest, "component").select("fp", "smallest")
    # A key that the planner takes for a new one: the last join deals both its sides itself, and adaptive execution splits the rows of a
    # fingerprint that very many copies share.
    of = least.join(moved, "fp", "left").select(F.when(F.col("fp").isNotNull(), F.col("fp")).alias("fp"), F.coalesce("smallest", "least").alias("component_id"))
    return marked.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
