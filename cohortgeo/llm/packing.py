"""9. Best-fit packing of documents into sequences, hierarchically.

A document is its token ids and a closing 0. Only one longer than a sequence is cut: into whole sequences, with its rest as the first
piece. Whole pieces are sequences of their own; rests and short documents are packed. Every partition packs its own by best fit in
decreasing order, by a bit set of the free room in open bins (one step a piece), and emits its bins. Bins that are nearly full stay; of
the others the UP with most room go up a tree as items of their fill, in groups of FAN partitions, are packed by best fit again, and so on until one group is left. After best fit at most one bin of a group is
half empty or more; every merge needs such a bin. So of FAN groups at most FAN such bins look for room, and a bin that has room for one of
them is among the UP roomiest of its group unless UP others have at least as much: what stays behind could only have stood in for one
that went up, and the number of sequences is that of a tree that sends all bins up (a test holds both alike). No group of the
tree, the last one included, has more than FAN * UP bins, however many documents there are, and every bin that stays is a sequence.

Tokens are encoded once; the table of pieces is written to the shared folder, and packing works on lengths.

Defined cases: null or empty text is the one id 0. Repeated rows are packed once each; null ids too. Pieces of equal length are packed in the
order of their rows, and of bins with equal room the last one is taken; which of such pieces lands where says nothing. An empty table gives
no sequence. Columns other than id and text aren't read; the id column may not be called like a column of the result (ValueError).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cohortgeo.llm.common import arrow_type, bounded_batches
from cohortgeo.sources.shared import materialize

LENGTH, CLOSE = 2048, 0
#: Bins with at most so much room are nearly full.
NEARLY = 16
#: Partitions that one group of the tree takes together, and bins with most room that go up from a group; the rest are sequences.
FAN, UP = 8, 64


def encoder(path: str | None = None):
    """text -> ids, as the `tokenizers` library gives them for a byte-level BPE file without added tokens. tiktoken encodes with the same
    vocabulary, merges and special strings four times as fast; a test holds both against each other."""
    import tiktoken

    from cohortgeo.llm.token_counts import vocabulary

    ranks, pattern, special = vocabulary(path)
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    marks = tuple(special)

    def encode(text: str) -> np.ndarray:
        if any(m in text for m in marks):
            return np.array(coder.encode(text, allowed_special="all"), np.uint32)
        return coder.encode_to_numpy(text, disallowed_special=())

    return encode


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each item, its offset there, and the fill of each bin; best fit in decreasing order of size."""
    order = np.argsort(-sizes, kind="stable")
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    room: list[list[int]] = [[] for _ in range(length + 1)]  # bins by room
    some = 0  # bit r: a bin has room r
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            r, b = length, len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += size
        r -= size
        if r:
            room[r].append(b)
            some |= 1 << r
    return where, offset, np.array(fill, np.int64)


_ENCODERS: dict = {}


def pieces(docs: DataFrame, id_col: str, text_col: str, length: int, path: str | None) -> DataFrame:
    """Pieces of all documents, packed in each partition: id, piece, start, length, ids_crc32, bin, offset, fill of the bin.

    bin: partition << 32 and a number in it.
    """
    bounded_batches(docs.sparkSession)
    schema = docs.schema[id_col].dataType.simpleString()
    key_type = arrow_type(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = encoder(path)
        encode, part = _ENCODERS[path], TaskContext.get().partitionId()
        ids: list = []
        rows: list[tuple] = []  # row of ids, piece, start, length, crc
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.append(encode(text or ""), np.uint32(CLOSE)).astype("<u4")
                n = len(got)
                first = n % length or min(n, length)
                start = 0
                for k in range(1 + (n - first) // length):
                    size = first if k == 0 else length
                    rows.append((len(ids), k, start, size, zlib.crc32(got[start : start + size].tobytes())))
                    start += size
                ids.append(key)
        if not rows:
            return
        table = np.array(rows, np.int64)
        where, offset, fill = best_fit(table[:, 3], length)
        bins = (part << 32) + where
        up = _roomiest(fill, length)[where] & (offset == 0)
        out = {"piece": table[:, 1], "start": table[:, 2], "length": table[:, 3], "ids_crc32": table[:, 4], "bin": bins, "offset": offset, "fill": fill[where], "up": up}
        keys = pa.array(ids, key_type).take(pa.array(table[:, 0]))
        for at in range(0, len(table), 50_000):
            yield pa.RecordBatch.from_arrays([keys[at : at + 50_000], *[pa.array(v[at : at + 50_000]) for v in out.values()]], names=["id", *out])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {schema}, piece long, start long, length long, ids_crc32 long, bin long, offset long, fill long, up boolean"
    )


def _roomiest(fill: np.ndarray, length: int) -> np.ndarray:
    """Which bins go up: those with most room that aren't nearly full, UP at most."""
    up = np.zeros(len(fill), bool)
    order = np.argsort(fill, kind="stable")[:UP]
    up[order] = fill[order] <= length - NEARLY
    return up


def merge_bins(bins: DataFrame, length: int = LENGTH) -> DataFrame:
    """(bin, sequence_id, base): where bins that are merged go, from (bin, fill) of the bins that go up, by a tree of groups of FAN
    partitions."""
    spark = bins.sparkSession
    none = "bin long, sequence_id long, base long"
    open_ = materialize(bins.select("bin", "fill", F.shiftright("bin", 32).alias("g")))
    groups = open_.agg(F.max("g")).first()[0]
    found = None
    if groups is None:
        return spark.createDataFrame([], none)

    def pack(t: pa.Table) -> pa.Table:
        bins_, fills = t["bin"].to_numpy(), t["fill"].to_numpy()
        order = np.lexsort((bins_, -fills))
        bins_, fills = bins_[order], fills[order]
        where, offset, fill = best_fit(fills, length)
        # A merged bin carries the name of its first member.
        name = np.zeros(len(fill), np.int64)
        name[where[offset == 0]] = bins_[offset == 0]
        up = _roomiest(fill, length)[where] & (offset == 0)
        return pa.table({"bin": bins_, "sequence_id": name[where], "base": offset, "fill": fill[where], "g": np.full(len(bins_), t["g"][0].as_py()), "up": up})

    level = open_
    while True:
        groups = groups // FAN
        packed = materialize(level.withColumn("g", F.floor(F.col("g") / FAN).cast("long")).groupBy("g").applyInArrow(pack, f"{none}, fill long, g long, up boolean"))
        step = packed.where("bin <> sequence_id or base <> 0").select("bin", "sequence_id", "base")
        if found is None:
            found = step
        else:  # what was merged before goes along
            moved = step.select(F.col("bin").alias("from"), F.col("sequence_id").alias("to"), F.col("base").alias("more"))
            found = materialize(
                found.join(moved, found.sequence_id == moved["from"], "left")
                .select("bin", F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
                .unionByName(step)
            )
        if groups == 0:
            return found
        level = packed.where("up").select("bin", "fill", "g")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    if not 0 < length < 1 << 16:
        raise ValueError("length must be 1 to 65535")
    if id_col in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset"):
        raise ValueError(f"a column called {id_col} is made here")
    made = materialize(pieces(docs, id_col, text_col, length, path))
    moved = merge_bins(made.where("up").select("bin", "fill"), length)
    return made.join(moved, "bin", "left").select(
        F.col("id").alias(id_col),
        F.col("piece").cast("int").alias("piece"),
        "start",
        "length",
        "ids_crc32",
        F.coalesce("sequence_id", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
