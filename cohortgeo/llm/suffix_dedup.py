"""3. Exact repeated passages by column-wise construction of a collection's Burrows-Wheeler transform (BWT).

A byte is removed if a string of SPAN bytes that covers it also starts in a document with a smaller id. Every such string is looked at:

1. Anchors. Each string of SPAN bytes has one: the least hash of its substrings of GRAM bytes. Equal strings have equal anchors, so a
   string can repeat in another document only if its anchor does. Blocks of documents send the distinct hashes of their anchors, by hash,
   to buckets, and get back those that two documents hold.
2. Reads. Runs of strings with one such anchor are short reads (at most 2 * SPAN - GRAM bytes). They go to a bucket by their anchor, each
   distinct read of a block once with its least document id, however many documents of the block hold it. Strings of an anchor with very
   many distinct reads go one by one, by their own hash, so that no bucket holds them all.
3. BWT. A bucket's distinct reads are inserted column by column: each round adds one symbol of every read, from its end, into the BWT of
   all reads' suffixes and updates the common prefixes of neighbours by range minima. Where neighbours share SPAN bytes, their strings
   are equal; whether the least document id of such a run is below a block's own least goes back to that block, a bit for each string.
4. A block marks its strings (those of a read's least document by the bits, those of its other documents all) and takes out the bytes
   that they cover.

The method inserts whole documents and has as many rounds as the longest has symbols, each of them a pass over all files. Reads bound the
rounds by 2 * SPAN - GRAM whatever the longest text. A bucket's columns are read and written in sequence each round; they are arrays, not
files, as a bucket is bounded, and what passes between blocks and buckets goes through Spark's shuffle as packed arrays, a row for each
block and bucket. Blocks and buckets grow with the root of the input once the rows would hold less than ROW_HASHES hashes on average, so
the number of rows grows with the input and not with its square.

A block's rows are put in order of (id, text) before anything is said of places in it, so neither the order in which shuffled rows arrive
nor a task that runs again can move a mark to another document.

Defined cases: null or empty text has no bytes. Texts shorter than SPAN lose nothing. A repeated row (one id twice) is not before itself.
A null id is after all others. Texts of any length are read whole. An empty table gives no row. Columns other than id and text aren't
read, so their names can't clash; the id column may not be called like a column of the result (ValueError).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from cohortgeo.llm.common import arrow_type, bounded_batches, utf8

SPAN, GRAM = 50, 20
#: Bytes of text that a block, and hashes of anchors that a bucket, is meant to hold at least.
BLOCK_BYTES, BUCKET_HASHES = 24 << 20, 1 << 20
#: Rows from blocks to buckets are to hold so many hashes on average; blocks and buckets grow for it. An anchor is about BYTES_A_HASH bytes.
ROW_HASHES, BYTES_A_HASH = 512, 13
#: Bytes of text that a block or a bucket of a small input holds.
SMALLEST = 1 << 20
#: An anchor with so many distinct reads, summed over blocks, is split.
SPLIT_READS = 1 << 16
LAST = np.iinfo(np.int64).max
#: Bytes of text that a task packs together, bytes whose anchors are found at once, and reads that are meant to be transformed together
#: (they fit into a core's cache); those of one anchor always are.
PACK, CHUNK, TOGETHER = 24 << 20, 4 << 20, 1500
_B = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 18


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of each substring of `width` bytes, by doubling."""
    have, h = 1, data.astype(np.uint64) + np.uint64(1)
    out, done = None, 0
    while True:
        if width >> (have.bit_length() - 1) & 1:
            if out is None:
                out, done = h, have
            else:  # out: a substring of `done` bytes; h follows it
                n = len(data) - done - have + 1
                out, done = out[:n] * _power(have) + h[done : done + n], done + have
        if done == width:
            return _mix(out)
        h, have = h[:-have] * _power(have) + h[have:], 2 * have


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` values in a row."""
    have, out = 1, values
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray) -> np.ndarray:
    """The anchor of the SPAN bytes from each place."""
    n = max(len(data) - SPAN + 1, 0)
    out = np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, n, _PIECE):
            end = min(at + _PIECE, n)
            out[at:end] = _slide(_rolling(data[at : end + SPAN - 1], GRAM), SPAN - GRAM + 1)
    return out


class Block:
    """The documents of a block in order of (id, text), laid end to end, and the runs of their strings by anchor."""

    def __init__(self, rows: pa.Table):
        text = rows["text"].cast(pa.large_string())
        rows = pa.table({"id": rows["id"], "text": pc.fill_null(text, "")})
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_end"))
        self.given = rows["id"]
        self.ids = pc.fill_null(rows["id"].cast(pa.int64()), int(LAST)).to_numpy()
        self.data, self.offsets = utf8(rows["text"])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, strings, document, anchor) of each run of strings with one anchor, by start."""
        found = [self._runs(at, min(at + CHUNK, len(self.data) - SPAN + 1)) for at in range(0, len(self.data) - SPAN + 1, CHUNK)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0, np.uint64)
        return tuple(map(np.concatenate, zip(*found)))

    def _runs(self, at: int, end: int) -> tuple:
        """Of the strings that start from `at` to `end`."""
        anchor = anchors(self.data[at : end + SPAN - 1])
        owner = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(np.clip(self.offsets, at, end)))
        last = self.offsets[1:] - SPAN + 1  # a document's whole strings end here
        whole = np.arange(at, end) < last[owner]
        new = np.ones(end - at, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | ~whole[:-1]
        start = np.flatnonzero(new & whole)
        stop = np.minimum(np.append(start[1:], end - at), last[owner[start]] - at)
        width = SPAN - GRAM + 1  # a run of equal anchors that is longer (repetitive text) is cut
        pieces = -(-(stop - start) // width)
        which = np.repeat(np.arange(len(start)), pieces)
        first = start[which] + (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * width
        return first + at, np.minimum(stop[which] - first, width).astype(np.uint8), owner[first], anchor[first]

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors; for each, bit 7: two documents of the block hold it, other bits: the length in bits of its distinct reads' number."""
        start, count, doc, key = self.runs()
        if not len(key):
            return key, np.zeros(0, np.uint8)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], self.ids[doc[order]]  # ids go up
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        stop = np.append(first[1:], len(key))
        twice = doc[first] != doc[stop - 1]
        times = stop - first
        reads = np.ones(len(first), np.int64)
        again = np.repeat(times > 1, times)
        if again.any():
            with np.errstate(over="ignore"):
                own = _hash_at(self.data, start[order[again]]) * _B + count[order[again]]
            group = np.repeat(np.arange(len(first)), times)[again]
            by = np.lexsort((own, group))
            differs = np.concatenate([[True], (own[by][1:] != own[by][:-1]) | (group[by][1:] != group[by][:-1])])
            reads[times > 1] = np.bincount(group[by][differs], minlength=len(first))[times > 1]
        bits = np.frexp(reads.astype(np.float64))[1].astype(np.uint8)
        return key[first], bits | (twice.astype(np.uint8) << 7)

    def reads(self, known: list[tuple[int, np.ndarray, np.ndarray]], buckets: int) -> Iterator[tuple[int, "Reads"]]:
        """(bucket, its reads) by what buckets told of this block's anchors: (bucket, hashes of shared anchors, whether each is split).
        The same for the same block and answers, in whatever order these come."""
        start, count, doc, key = self.runs()
        tag = lambda bucket, short: short * np.uint64(buckets) + bucket
        told = np.concatenate([tag(np.uint64(p), k) for p, k, _ in known])
        many = np.concatenate([m for _, _, m in known])
        order = np.argsort(told)
        told, many = told[order], many[order]
        mine = tag(key % np.uint64(buckets), _long(np.ascontiguousarray(_short(key, buckets)).ravel()))
        at = np.minimum(np.searchsorted(told, mine), len(told) - 1)
        hit = told[at] == mine
        alone = hit & many[at]
        hit &= ~alone
        n = count[alone].astype(np.int64)
        one = np.repeat(start[alone], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        with np.errstate(over="ignore"):
            own = _hash_at(self.data, one)
        start, count = np.concatenate([start[hit], one]), np.concatenate([count[hit], np.ones(len(one), np.uint8)])
        doc, key = np.concatenate([doc[hit], np.repeat(doc[alone], n)]), np.concatenate([key[hit], own])
        by, parts = _by_bucket(key, buckets)
        for p, s, e in parts:
            yield p, Reads(self, *(x[by[s:e]] for x in (start, count, doc)))


def _hash_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    h = np.zeros(len(places), np.uint64)
    for k in range(SPAN):
        h = h * _B + data[places + k]
    return _mix(h)


class Reads:
    """Distinct reads of a block for one bucket, in order: bytes end to end, lengths and least ids; and each occurrence's read, place and id."""

    def __init__(self, block: Block, start: np.ndarray, count: np.ndarray, doc: np.ndarray):
        grid = _grid(block.data, start, count.astype(np.int64) + SPAN - 1)
        _, first, self.of = np.unique(_rows(grid), return_index=True, return_inverse=True)
        self.start, self.ids = start, block.ids[doc]
        self.length = grid[first, -1]
        self.bytes = grid[first][:, :-1][np.arange(grid.shape[1] - 1) < self.length[:, None]]
        self.least = np.full(len(first), LAST)
        np.minimum.at(self.least, self.of, self.ids)

    def gone(self, mask: np.ndarray) -> np.ndarray:
        """Places of the strings that a smaller id has, by the bits of each distinct read's strings for its least id."""
        every = ((1 << (self.length.astype(np.int64) - SPAN + 1)) - 1).astype(np.uint32)
        mask = np.where(self.ids > self.least[self.of], every[self.of], mask[self.of])
        out = []
        for at in range(0, len(mask), 1 << 16):
            read, step = np.nonzero((mask[at : at + (1 << 16), None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1))
            out.append(self.start[at + read] + step)
        return np.concatenate(out)


def _grid(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Reads as rows, padded with 0, and their lengths as the last column."""
    width = int(length.max())
    at = np.arange(width)
    grid = np.zeros((len(start), width + 1), np.uint8)
    grid[:, :width] = np.where(at < length[:, None], data[np.minimum(start[:, None] + at, len(data) - 1)], 0)
    grid[:, width] = length
    return grid


def _rows(grid: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(grid).view(f"V{grid.shape[1]}").ravel()


def transform(grid: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BWT, common prefixes with the suffix before, and read * 256 + length of each suffix, of reads in the rows of `grid`.

    Symbols are above 0. Each round inserts one symbol of each read, the last ones first. Rows 0 to reads - 1 are the empty suffixes; a
    suffix c + s stands in the order of all entries c of the BWT, which is a stable sort of its symbols. The place of a read's longest
    suffix is all that a round needs of it.
    """
    reads = len(lengths)
    bwt = np.zeros(reads, np.uint8)  # 0: nothing stands before it (yet)
    lcp = np.zeros(reads, np.uint8)
    live, row = np.arange(reads), np.arange(reads)
    for j in range(1, int(lengths.max()) + 1 if reads else 1):
        if (going := lengths[live] >= j).sum() < len(live):
            live, row = live[going], row[going]
        symbol = grid[live, lengths[live] - j]
        bwt[row] = symbol
        order = np.argsort(bwt, kind="stable")
        zeros = len(bwt) - int(np.count_nonzero(bwt))
        rank = np.empty(len(bwt), np.int32)
        rank[order] = np.arange(len(bwt), dtype=np.int32)
        by = np.argsort(row, kind="stable")  # in sequence
        live, row, symbol = live[by], row[by], symbol[by]
        k = rank[row].astype(np.int64)
        new = reads + k - zeros
        # Common prefixes: 1 + the least between the entries before and after with the same symbol.
        before, after = order[np.maximum(k - 1, 0)], order[np.minimum(k + 1, len(order) - 1)]
        up = _common(lcp, before, row, (k > 0) & (bwt[before] == symbol))
        down = _common(lcp, row, after, (k + 1 < len(order)) & (bwt[after] == symbol))
        old = np.ones(len(bwt) + len(live), bool)
        old[new] = False
        wide = np.zeros(len(old), np.uint8)
        wide[old] = bwt
        bwt = wide
        wide = np.zeros(len(old), np.uint8)
        wide[old] = lcp
        follows = new + 1 < len(old)
        wide[new[follows] + 1] = down[follows]
        wide[new] = up  # after `down`: where both rows are new, `up` of the lower one is the same minimum
        lcp = wide
        row = new
    # Walk from each empty suffix to the longer ones: the entry of a row says which symbol comes before, its rank where that suffix is.
    name = np.zeros(len(bwt), np.int64)
    order = np.argsort(bwt, kind="stable")
    longer = np.empty(len(bwt), np.int32)
    longer[order] = np.arange(len(bwt), dtype=np.int32)
    longer += reads - (len(bwt) - int(np.count_nonzero(bwt)))
    read, row = np.arange(reads), np.arange(reads)
    name[row] = read << 8
    for j in range(1, int(lengths.max()) + 1 if reads else 1):
        going = lengths[read] >= j
        read, row = read[going], longer[row[going]]
        name[row] = (read << 8) | j
    return bwt, lcp, name


def _common(lcp: np.ndarray, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """1 + the least of the common prefixes of rows a + 1 to b, where `same`, else 0; at most 255."""
    out = np.zeros(len(a), np.uint8)
    at = np.flatnonzero(same)
    if len(at):
        ends = np.stack([a[at] + 1, b[at] + 1], 1).ravel()
        out[at] = np.minimum(np.minimum.reduceat(np.append(lcp, np.uint8(255)), ends)[::2], 254) + 1
    return out


def least_ids(grid: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each read's strings of SPAN bytes, the least id of a read that holds an equal one; [read, start], LAST beyond the end."""
    _, lcp, name = transform(grid, lengths)
    read, size = name >> 8, name & 255
    run = np.flatnonzero(lcp < SPAN)
    least = np.minimum.reduceat(np.where(size >= SPAN, ids[read], LAST), run)
    least = np.repeat(least, np.diff(np.append(run, len(lcp))))
    out = np.full((len(lengths), grid.shape[1] - SPAN + 1), LAST)
    at = np.flatnonzero(size >= SPAN)
    out[read[at], lengths[read[at]] - size[at]] = least[at]
    return out


def _by_bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, list]:
    """Order by bucket, and (bucket, from, to) of those that are not empty."""
    where = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    found, first = np.unique(where[order], return_index=True)
    return order, list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]))


def _squeeze(values: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values if isinstance(values, bytes) else np.ascontiguousarray(values).tobytes())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (b, id, text) as compressed tables, one for each block and PACK bytes: what is shuffled is small."""
    held, size = [], 0

    def put():
        t = pa.Table.from_batches(held).combine_chunks()
        block = t["b"].to_numpy()
        order = np.argsort(block, kind="stable")
        t = t.take(pa.array(order)).select(["id", "text"])
        found, first = np.unique(block[order], return_index=True)
        blobs = []
        for s, e in zip(first, [*first[1:], len(order)]):
            sink = pa.BufferOutputStream()
            part = t.slice(s, e - s).combine_chunks()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(part)
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(blobs, pa.binary())], names=["b", "rows"])

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PACK:
            yield put()
            held, size = [], 0
    if held:
        yield put()


def _unpack(t: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(x)).read_all() for x in t["rows"].to_pylist()])


def _short(key: np.ndarray, buckets: int) -> np.ndarray:
    """40 bits of a key within its bucket, as rows of five bytes. Keys that are equal in these only cost a read that finds no partner."""
    return ((key // np.uint64(buckets)) & np.uint64((1 << 40) - 1)).view(np.uint8).reshape(-1, 8)[:, :5]


def _long(five: np.ndarray) -> np.ndarray:
    out = np.zeros((len(five) // 5, 8), np.uint8)
    out[:, :5] = five.reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _whole(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _table(rows: list[dict], kinds: str) -> pa.Table:
    types = {n: pa.int64() if t == "long" else pa.binary() for n, t in (x.split() for x in kinds.split(", "))}
    return pa.table({n: pa.array([r[n] for r in rows], t) for n, t in types.items()})


#: What goes from blocks to buckets and back, twice.
ANCHORS, SHARED = "bucket long, b long, keys binary, marks binary", "b long, bucket long, keys binary, many binary"
READS, GONE = "bucket long, b long, keys binary, many binary, bytes binary, length binary, least binary", "b long, bucket long, keys binary, many binary, mask binary"


def _told(answer: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, short hashes, whether each is split), by bucket."""
    out = []
    for p, keys, many in zip(answer["bucket"].to_pylist(), answer["keys"].to_pylist(), answer["many"].to_pylist()):
        k = _long(np.frombuffer(keys, np.uint8))
        out.append((p, k, np.unpackbits(np.frombuffer(many, np.uint8))[: len(k)].astype(bool)))
    return sorted(out, key=lambda x: x[0])


def find_shared(t: pa.Table, most: int = SPLIT_READS) -> pa.Table:
    """For each block of a bucket its anchors that two documents hold, and whether they are split."""
    keys = [_long(np.frombuffer(x, np.uint8)) for x in t["keys"].to_pylist()]
    flat, marks = np.concatenate(keys), np.concatenate([_whole(x, np.uint8) for x in t["marks"].to_pylist()])
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
    count = np.diff(np.append(first, len(flat)))
    hit, many = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    hit[order] = np.repeat((count > 1) | (np.maximum.reduceat(marks[order], first) > 127), count)
    many[order] = np.repeat(np.add.reduceat(1 << (marks[order] & 127).astype(np.int64), first) // 2 > most, count)
    out, end = [], 0
    for b, k in zip(t["b"].to_pylist(), keys):
        mine = slice(end, end := end + len(k))
        if (h := hit[mine]).any():
            five = k[h].view(np.uint8).reshape(-1, 8)[:, :5]
            out.append({"b": b, "bucket": t["bucket"][0].as_py(), "keys": five.tobytes(), "many": np.packbits(many[mine][h]).tobytes()})
    return _table(out, SHARED)


def compare(t: pa.Table) -> pa.Table:
    """For each block of a bucket, bits of its distinct reads: which of their strings an id below the read's least there has."""
    flat, length, own = (np.concatenate([_whole(x, k) for x in t[n].to_pylist()]) for n, k in (("bytes", np.uint8), ("length", np.uint8), ("least", np.int64)))
    sizes = [len(_whole(x, np.uint8)) for x in t["length"].to_pylist()]
    if not len(length):
        return t.select(["b", "bucket", "keys", "many"]).append_column("mask", pa.array([_squeeze(b"")] * t.num_rows, pa.binary()))
    length = length.astype(np.int64)
    offset = np.cumsum(length) - length
    # Equal reads, of whatever block, are one row; reads of one anchor stand together.
    grid = _grid(flat + np.uint8(1), offset, length)  # UTF-8 never holds 0xFF
    _, one, of = np.unique(_rows(grid), return_index=True, return_inverse=True)
    grid, length = grid[one][:, :-1], length[one]
    least = np.full(len(one), LAST)
    np.minimum.at(least, of, own)
    anchor = _anchor_of(grid)
    order = np.argsort(anchor, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
    cut = np.unique(first[np.searchsorted(first, np.arange(0, len(order), TOGETHER), "right") - 1])
    entry = np.argsort(place[of], kind="stable")
    bound = np.searchsorted(place[of][entry], np.append(cut, len(order)))
    mask = np.zeros(len(of), np.uint32)
    for i, rows in enumerate(np.split(order, cut[1:])):
        found = least_ids(grid[rows], length[rows], least[rows])
        mine = entry[bound[i] : bound[i + 1]]
        smaller = found[place[of[mine]] - cut[i]] < own[mine, None]
        mask[mine] = (smaller * (np.uint32(1) << np.arange(found.shape[1], dtype=np.uint32))).sum(1, dtype=np.uint32)
    parts = np.split(mask, np.cumsum(sizes)[:-1])
    return pa.table({n: t[n] for n in ("b", "bucket", "keys", "many")} | {"mask": pa.array([_squeeze(x) for x in parts], pa.binary())})


def _anchor_of(grid: np.ndarray) -> np.ndarray:
    """The anchor of each read's first string, of symbols that are one above their byte."""
    out = np.empty(len(grid), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grid), 1 << 14):
            part = np.ascontiguousarray(grid[at : at + (1 << 14), :SPAN] - np.uint8(1))
            h = _rolling(part.ravel(), GRAM)
            h = np.append(h, np.zeros(GRAM - 1, np.uint64)).reshape(len(part), SPAN)
            out[at : at + (1 << 14)] = h[:, : SPAN - GRAM + 1].min(1)
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_text: bool = False) -> DataFrame:
    """A row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, and with removed_text the bytes that are kept."""
    if id_col in RESULT:
        raise ValueError(f"a column called {id_col} is made here")
    bounded_batches(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)), F.count("*")).first()
    row_bytes = ROW_HASHES * BYTES_A_HASH
    block_bytes = max(BLOCK_BYTES, math.isqrt(size[0] * row_bytes))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = size[0] // min(SMALLEST, block_bytes)  # small inputs are dealt to all cores
    blocks = max(size[0] // block_bytes, size[1] // max(block_bytes // 80, 1), min(small, least)) + 1
    buckets = max(int(size[0] / max(BUCKET_HASHES * BYTES_A_HASH, size[0] * row_bytes / block_bytes)), min(small, 4 * least)) + 1
    most = SPLIT_READS
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = arrow_type(kind)
    base = docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.octet_length(text_col)), F.lit(blocks)).cast("long").alias("b"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
    )
    # Partitions grow with the input, so no task's share does.
    to_blocks = lambda df: df.repartition(max(blocks, least), "b").groupBy("b")
    to_buckets = lambda df: df.repartition(max(buckets, least), "bucket").groupBy("bucket")
    by_block = to_blocks(base.mapInArrow(_pack, "b long, rows binary"))

    def send_anchors(t: pa.Table) -> pa.Table:
        key, marks = Block(_unpack(t)).candidates()
        order, parts = _by_bucket(key, buckets)
        key, marks, b = key[order], marks[order], t["b"][0].as_py()
        return _table([{"bucket": p, "b": b, "keys": _short(key[s:e], buckets).tobytes(), "marks": _squeeze(marks[s:e])} for p, s, e in parts], ANCHORS)

    def send_reads(rows: pa.Table, answer: pa.Table) -> pa.Table:
        if not rows.num_rows or not answer.num_rows:
            return _table([], READS)
        b, told = rows["b"][0].as_py(), _told(answer)
        said = dict(zip(answer["bucket"].to_pylist(), zip(answer["keys"].to_pylist(), answer["many"].to_pylist())))
        out = []
        for p, r in Block(_unpack(rows)).reads(told, buckets):
            # Strings of a split anchor can go to a bucket that told nothing.
            keys, many = said.pop(p, (b"", b""))
            out.append({"bucket": p, "b": b, "keys": keys, "many": many, "bytes": _squeeze(r.bytes), "length": _squeeze(r.length), "least": _squeeze(r.least)})
        # A bucket all of whose anchors here are split gets no read by them; the block must hear of them again.
        none = dict.fromkeys(("bytes", "length", "least"), _squeeze(b""))
        return _table(out + [{"bucket": p, "b": b, "keys": k, "many": m} | none for p, (k, m) in said.items()], READS)

    def take_out(rows: pa.Table, answer: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"id": pa.array([], id_type)} | {k: pa.array([], t) for k, t in RESULT.items()})
        block = Block(_unpack(rows))
        marked = np.zeros(len(block.data) + SPAN, np.int32)
        if answer.num_rows:
            bits = dict(zip(answer["bucket"].to_pylist(), answer["mask"].to_pylist()))
            for p, r in block.reads(_told(answer), buckets):
                begin = r.gone(_whole(bits[p], np.uint32))
                np.add.at(marked, begin, 1)
                np.add.at(marked, begin + SPAN, -1)
        gone = np.cumsum(marked, out=marked)[: len(block.data)] > 0
        out: dict[str, list] = {k: [] for k in RESULT}
        for s, e in zip(block.offsets[:-1], block.offsets[1:]):
            cut, text = gone[s:e], block.data[s:e]
            kept = text[~cut].tobytes() if cut.any() else text.tobytes()
            spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if len(cut) else 0
            for k, v in zip(out, (len(cut), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if removed_text else b"")):
                out[k].append(v)
        return pa.table({"id": block.given} | {k: pa.array(v, RESULT[k]) for k, v in out.items()})

    shared = to_buckets(by_block.applyInArrow(send_anchors, ANCHORS)).applyInArrow(lambda t: find_shared(t, most), SHARED)
    gone = to_buckets(by_block.cogroup(to_blocks(shared)).applyInArrow(send_reads, READS)).applyInArrow(compare, GONE)
    result = by_block.cogroup(to_blocks(gone)).applyInArrow(take_out, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    result = result.withColumnRenamed("id", id_col)
    return result if removed_text else result.drop("kept")


RESULT = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: For DuckDB. Texts as hex, two digits a byte; starts of known strings make islands, and what is between islands is kept.
ORACLE = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n from documents),
g as (select doc_id, i, substr(h, (2 * i + 1)::int, {2 * SPAN}) s from (select doc_id, h, unnest(range(n - {SPAN - 1})) i from d where n >= {SPAN})),
m as (select s, min(doc_id) f, count(*) c from g group by s having count(*) > 1),
k as (select g.doc_id, g.i from g join m using (s) where m.f < g.doc_id),
e as (select doc_id, i, case when i - lag(i) over w > {SPAN} or lag(i) over w is null then 1 else 0 end nw from k window w as (partition by doc_id order by i)),
r as (select doc_id, min(i) a, max(i) + {SPAN} b from (select doc_id, i, sum(nw) over (partition by doc_id order by i) q from e) group by doc_id, q),
p as (select r.doc_id, a, b, substr(h, (2 * coalesce(lag(b) over w, 0) + 1)::int, (2 * (a - coalesce(lag(b) over w, 0)))::int) x from r join d using (doc_id) window w as (partition by r.doc_id order by a)),
u as (select doc_id, sum(b - a)::bigint removed, count(*) spans, max(b) tail, string_agg(x, '' order by a) kept from p group by doc_id)
select d.doc_id, d.n::bigint n_bytes, coalesce(removed, 0)::bigint n_removed, coalesce(spans, 0)::bigint n_spans,
  sha256(unhex(case when u.doc_id is null then h else kept || substr(h, (2 * tail + 1)::int) end)) kept_sha256
from d left join u using (doc_id)"""
