"""4. Benchmark decontamination by CGK embeddings.

Symbols are words: lower-case runs of letters and digits. The CGK random walk maps a string of symbols to a longer one: at step j it
emits the symbol under its pointer and moves the pointer on if a random bit of (j, symbol) is 1. Strings at a small edit distance walk
apart at an edit and soon meet again, so their embeddings are at a small Hamming distance. Bit-sampling LSH draws the embedding at a few
steps; in each of REPEATS repetitions, with a walk and steps of its own, a place of a document whose samples equal those of a short stretch
of an item is a seed. Each repetition takes another start of the stretch, so some stretch of an item of any length has few edits; places are
all words. Items of a like number of words share their sampled steps. The walk is lazy: after each sampled step only places that some item
still agrees with go on. Where the item is similar from some start that edits before the stretch allow, all those starts are candidates.
Candidates are verified by the edit distance between the item and the words from the window's start, its end free, by banded dynamic
programming: similarity is 1 - distance / words of the item, and LEAST or more is a leak.

A copied item agrees in every repetition. REPEATS is set for a recall of TARGET at the similarity LEAST for items of any number of words,
measured in a test.

Items are taken in blocks of ITEMS rows, whatever the benchmark's size: the broadcast is bounded, and each block is a pass over the
documents.

Defined cases: null or empty texts and items without a word match nothing. Repeated items each match. Texts of any length are read whole,
in pieces that overlap by the longest item. A null id is kept as it is. Repeated documents are rows of their own, each with its matches. Of
windows of one document that are equally like an item the first is told. An empty table, of documents or of items, gives no match (mark_leaks:
rows with none). Of the columns only id and text are read, and of kept ones (mark_leaks) a name that is made here raises ValueError; the id
columns of documents and items may not share a name, as the result has both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortgeo.llm.common import arrow_type, bounded_batches, map_batches, utf8

LEAST, TARGET = 0.8, 0.95
REPEATS, SEED = 10, 20_240
#: Sampled steps lie in a stretch of at most so many words of an item; its start is another in each repetition.
STRETCH, GOLDEN = 8, (5**0.5 - 1) / 2
#: Items of one block.
ITEMS = 20_000
#: Words of the smallest item of each class of sizes.
CLASSES = (1, 6, 12)
PIECE = 2 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_B = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol (32 bits) of each word, and its first byte. No word crosses one of `bounds`."""
    inside = _WORD[data]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = bounds[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut - 1]] if len(cut) else cut
    if len(cut):
        begin, end = np.sort(np.concatenate([begin, cut])), np.sort(np.concatenate([end, cut]))
    if not len(begin):
        return np.zeros(0, np.uint32), begin
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, begin)
    rank = np.arange(len(at)) - np.repeat(first, end - begin)
    with np.errstate(over="ignore"):
        mixed = (_LOWER[data[at]] + np.uint64(1)) * _powers(int(rank.max()) + 1)[rank]
        h = np.add.reduceat(mixed, first)
        h = (h ^ (h >> np.uint64(29))) * _M1
    return (h >> np.uint64(32)).astype(np.uint32), begin


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 4096), _B)]), dtype=np.uint64)
    return _POWERS


def _go(symbols: np.ndarray, step_salt: np.uint32) -> np.ndarray:
    """The random bit of a step for each symbol."""
    return ((symbols ^ step_salt) * np.uint32(0x9E3779B1)) >> np.uint32(31)


class Index:
    """Items' words, and for each repetition and class of sizes the sampled steps and the items' keys after each sample."""

    def __init__(self, items: list[tuple[object, str]], repeats: int = REPEATS, seed: int = SEED):
        raw = [t.encode() for _, t in items]
        self.ids = [i for i, _ in items]
        self.words = [words(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in raw]
        self.bytes = max(map(len, raw), default=0)
        self.size = np.array([len(w) for w in self.words])
        rng = np.random.default_rng(seed)
        steps = 2 * max(CLASSES)
        self.salts = rng.integers(0, 1 << 32, (repeats, steps), dtype=np.uint32)
        low = np.searchsorted(CLASSES, self.size, "right") - 1
        self.plans: list[list[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]] = []
        self.first: list[dict[int, np.ndarray]] = []  # per repetition and step, the first sample of each item
        for r in range(repeats):
            plan = []
            self.first.append({})
            for c in np.unique(low[low >= 0]):
                members = np.flatnonzero(low == c)
                stretch = max(1, min(2 * CLASSES[c] // 3, STRETCH))
                # Starts are dealt evenly over the item, the first at its first word.
                start = np.floor(r * GOLDEN % 1 * (self.size[members] - stretch + 1)).astype(np.int64)
                # A walk takes a step of one symbol in two on average and never more than one; at stretch * 1.25 it is inside the stretch.
                # A sample each of the middle and the last third of its steps: early ones are mostly the first word or the second again.
                most = int(1.25 * stretch)
                late = [int(rng.integers(max(1, most * k // 3), max(2, most * (k + 1) // 3))) for k in (1, 2)] if stretch > 1 else [0, 0]
                sampled = np.array([0, *late])
                keys, partial = self._item_keys(members, r, sampled, start)
                plan.append((sampled, partial, keys, members, start))
            self.plans.append(plan)

    def _item_keys(self, members: np.ndarray, r: int, sampled: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Keys of the members after the last sample, and sorted distinct keys after each."""
        key = np.zeros(len(members), np.uint64)
        out: list[np.ndarray] = []
        at, step = start, 0
        padded = np.zeros((len(members), int(self.size[members].max()) + 1), np.uint32)
        for i, m in enumerate(members):
            padded[i, : self.size[m]] = self.words[m]
        row = np.arange(len(members))
        for s in sampled:
            while step < s:
                at = np.minimum(at + _go(padded[row, at], self.salts[r, step]), self.size[members])
                step += 1
            key = _extend(key, padded[row, at])
            if not out:
                self.first[r].setdefault(int(s), np.zeros(len(self.ids), np.uint32))[members] = padded[row, at]
            out.append(np.unique(key))
        return key, out

    def candidates(self, symbols: np.ndarray, room: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs; a window is the place of its first word. room: words from each place to its document's end."""
        found: list[np.ndarray] = []
        padded = np.append(symbols, np.uint32(0))
        n = len(symbols)
        for r, plan in enumerate(self.plans):
            known = np.zeros(1 << 16, bool)  # places whose symbol some item has first, whatever the class of sizes
            for _, _, _, members, _ in plan:
                known[self.first[r][0][members] >> np.uint32(16)] = True
            hopeful = np.flatnonzero(known[symbols >> np.uint32(16)])
            for sampled, partial, keys, members, start in plan:
                step, window = 0, hopeful
                key = _extend(np.zeros(1, np.uint64), padded[window])
                keep = _member(key, partial[0])
                key, window = key[keep], window[keep]
                at = window
                for s, known in zip(sampled[1:], partial[1:]):
                    while step < s:
                        at = np.minimum(at + _go(padded[at], self.salts[r, step]), n)
                        step += 1
                    key = _extend(key, padded[at])
                    keep = _member(key, known)
                    at, key, window = at[keep], key[keep], window[keep]
                if not len(window):
                    continue
                order = np.argsort(keys, kind="stable")
                left, right = np.searchsorted(keys[order], key, "left"), np.searchsorted(keys[order], key, "right")
                many = right - left
                which = order[np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                window = np.repeat(window, many)
                found.append(np.stack([window - start[which], members[which], window + room[window]], 1))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self._windows(symbols, room, np.unique(np.concatenate(found), axis=0), least)

    def _windows(self, symbols: np.ndarray, room: np.ndarray, seeds: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of seeds (place of the item's first word if nothing before the stretch was edited, item, end of the document):
        each start that edits before the stretch allow, where the item is similar enough from some of them."""
        seeds = seeds[self.verify(symbols, room, seeds[:, 0], seeds[:, 1], least, seeds[:, 2]) >= least - 1e-9]
        band = np.floor((1 - least) * self.size[seeds[:, 1]] + 1e-9).astype(np.int64)
        many = 2 * band + 1
        window = np.repeat(seeds[:, 0] - band - np.cumsum(many) + many, many) + np.arange(many.sum())
        item, stop = np.repeat(seeds[:, 1], many), np.repeat(seeds[:, 2], many)
        at = np.clip(window, 0, len(symbols) - 1)
        inside = (window == at) & (at + room[at] == stop)  # in the same document
        both = np.unique(window[inside] * len(self.ids) + item[inside])
        return both // len(self.ids), both % len(self.ids)

    def verify(self, symbols: np.ndarray, room: np.ndarray, window: np.ndarray, item: np.ndarray, least: float = LEAST, ends: np.ndarray | None = None) -> np.ndarray:
        """Similarity of each candidate, exact where it is `least` or more, else less. With `ends` (of the documents) a bound from above: the
        best of any start that is at most as many words off as there may be edits, also before the document."""
        out = np.zeros(len(window))
        band_of = np.floor((1 - least) * self.size + 1e-9).astype(np.int64)
        enough = (room[window] if ends is None else ends - window + band_of[item]) >= self.size[item] - band_of[item]
        for size in np.unique(self.size[item[enough]]):
            n, band = int(size), int(np.floor((1 - least) * size + 1e-9))
            rows_all = np.flatnonzero(enough & (self.size[item] == size))
            for at in range(0, len(rows_all), 4096):
                rows = rows_all[at : at + 4096]
                x = np.stack([self.words[i] for i in item[rows]])
                w = window[rows]
                stop = w + room[w] if ends is None else ends[rows]
                width = 2 * band + 1
                big = n + 1
                # d[:, k]: distance of the item's first i words to the document's first i + k - band.
                j = np.arange(width) - band
                d = (np.where(j >= 0, j, big) if ends is None else np.zeros(width, np.int64))[None, :].repeat(len(rows), 0)
                lead = 0 if ends is None else width  # words before the window that may be read
                for i in range(1, n + 1):
                    place = w[:, None] + (i + j - 1)[None, :]
                    ok = (i + j + lead >= 1)[None, :] & (place < stop[:, None])
                    y = symbols[np.clip(place, 0, len(symbols) - 1)]
                    swap = np.where(ok, d + (y != x[:, i - 1 : i]), big)
                    drop = np.concatenate([d[:, 1:], np.full((len(rows), 1), big)], 1) + 1
                    drop = np.where((i + j + lead >= 0)[None, :] & (place < stop[:, None]) | (i + j == 0)[None, :], drop, big)
                    e = np.minimum(swap, drop)
                    # A word more of the document: least of e[k'] + (k - k') to the left.
                    e = np.minimum.accumulate(e - j, 1) + j
                    d = np.where((i + j + lead >= 0)[None, :] & ((place < stop[:, None]) | (i + j == 0)[None, :]), np.minimum(e, big), big)
                    if i % 3 == 0:  # distances never fall from row to row
                        near = d.min(1) <= band
                        if not near.all():
                            rows, x, w, stop, d = rows[near], x[near], w[near], stop[near], d[near]
                            if not len(rows):
                                break
                out[rows] = np.maximum(0, 1 - d.min(1) / n) if len(rows) else 0
        return out


def _extend(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (key ^ symbol.astype(np.uint64)) * _M2 + np.uint64(1)


def _member(key: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each key is known: a bitmap of 16 bits first, then exactly."""
    low = np.zeros(1 << 16, bool)
    low[(known >> np.uint64(40)) & np.uint64(0xFFFF)] = True
    maybe = low[(key >> np.uint64(40)) & np.uint64(0xFFFF)]
    at = np.flatnonzero(maybe)
    where = np.minimum(np.searchsorted(known, key[at]), len(known) - 1)
    maybe[at] = known[where] == key[at]
    return maybe


def _blocks(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[Index]:
    """Indexes of about ITEMS items each."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    blocks = -(-items.count() // ITEMS)
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        yield Index(sorted([(r["i"], r["t"]) for r in part.collect()], key=lambda x: (str(x[0]), x[1])))


def _best(index: Index, data: np.ndarray, offsets: np.ndarray, least: float) -> dict[tuple[int, int], tuple[float, int]]:
    """(text, item) -> similarity and first byte of the best window."""
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for first, last, pieces in _pieces(offsets, 2 * index.bytes + 64):
        starts = np.array([s - first for s, _, _ in pieces])
        symbols, begin = words(data[first:last], np.append(starts, last - first))
        if not len(symbols):
            continue
        owner = np.searchsorted(starts, begin, "right") - 1
        room = np.searchsorted(owner, owner, "right") - np.arange(len(symbols))
        window, item = index.candidates(symbols, room, least)
        similar = index.verify(symbols, room, window, item, least)
        for k in np.flatnonzero(similar >= least - 1e-12).tolist():
            doc = pieces[int(owner[window[k]])][2]
            key, value = (doc, int(item[k])), (float(similar[k]), int(begin[window[k]] + first - offsets[doc]))
            if key not in best or (value[0], -value[1]) > (best[key][0], -best[key][1]):
                best[key] = value
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """(id, item, similarity, first_byte): every item that a document holds, the best window of each."""
    spark = docs.sparkSession
    if id_col == item_col:
        raise ValueError(f"documents and items can't both be named by {id_col}")
    bounded_batches(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, similarity double, first_byte long"
    types = pa.schema([("id", arrow_type(kind)), ("item", arrow_type(item_kind)), ("similarity", pa.float64()), ("first_byte", pa.int64())])
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for index in _blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(index)  # ITEMS rows, about

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = sorted(_best(shared.value, *utf8(batch.column(1)), least).items())
                if rows:
                    columns = [
                        batch.column(0).take(pa.array([d for (d, _), _ in rows])),
                        pa.array([shared.value.ids[i] for (_, i), _ in rows], types.field("item").type),
                        pa.array([v[0] for _, v in rows]),
                        pa.array([v[1] for _, v in rows], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=types)

        found = base.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def mark_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """`keep` (which holds text_col) and n_leaks, the items that each row's text holds; no join, so null and repeated ids do no harm."""
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0).cast("long").alias("n_leaks"))
    for index in _blocks(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def work(batch: pa.RecordBatch, shared=shared) -> dict:
            column = batch.column(batch.schema.names.index(text_col))
            found = [d for d, _ in _best(shared.value, *utf8(column), least)]
            return {"more": np.bincount(np.array(found, np.int64), minlength=len(column))}

        out = map_batches(out, out.columns, "more long", work).withColumn("n_leaks", F.col("n_leaks") + F.col("more")).drop("more")
    return out


def _pieces(offsets: np.ndarray, overlap: int):
    """(first byte, last byte, [(start, end, text)]) of about PIECE bytes; a longer text is cut, with `overlap` bytes twice."""
    group, first = [], None
    for i in range(len(offsets) - 1):
        s, e = int(offsets[i]), int(offsets[i + 1])
        if e - s > PIECE:
            if group:
                yield first, group[-1][1], group
                group, first = [], None
            for at in range(s, e, PIECE):
                yield at, min(at + PIECE + overlap, e), [(at, min(at + PIECE + overlap, e), i)]
            continue
        if first is None:
            first = s
        group.append((s, e, i))
        if e - first >= PIECE:
            yield first, e, group
            group, first = [], None
    if group:
        yield first, group[-1][1], group


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
