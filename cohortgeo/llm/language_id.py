"""1. Language ID by prediction by partial matching (PPM).

Per language, a context tree over bytes holds how often each byte followed each context of 0 to ORDER bytes in the training texts.
The statistics are then frozen. A text's code length in a language is exact: at each byte the longest context that the tree knows is
taken; a byte it has seen there costs -log2(count / (total + distinct)), any other an escape of -log2(distinct / (total + distinct))
and then its cost in the next shorter context, down to 8 bits in the empty one (method C escapes, without exclusion). The language of
the shortest code is predicted; the score is its posterior probability under equal priors, 1 / sum(2^(best - length)).

As statistics are frozen, the cost of a byte depends on the ORDER bytes before it alone. The trees of all languages are merged into
one trie with a vector of costs at each node, and numpy walks it for all bytes of a batch at once.

Defined cases: a text that is null, empty or without a letter gives `und` and score 0. Ties go to the language first in order of
name. Every byte of a text of any length is scored. With no labelled row at all, every text is `und`. Repeated rows stay rows. An empty table
gives no row. Kept columns called lang_pred, score or bits_per_byte raise ValueError; others make no difference.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortgeo.llm.common import map_batches, utf8

#: Longest context, in bytes.
ORDER = 4
#: Training takes at most so many documents of each language, those of the least hash, and of each an excerpt of at most so many characters,
#: whose place follows from the hash. Prediction reads whole texts.
DOCS_PER_LANGUAGE, CHARS_PER_DOCUMENT = 300, 20_000
#: A text is scored in pieces of so many bytes, each after the ORDER bytes before it.
PIECE = 1 << 19


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that training never sees: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int = DOCS_PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """A bounded sample of labelled rows, the same at each run: of each label the rows of least hash, thinned by a threshold on the
    hash before they are ranked, so that no task gets all rows of a label. Of a long text an excerpt is taken; no row is left out for its
    length."""
    base = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    counts = {r[0]: r[1] for r in base.groupBy(label_col).count().collect()}
    if not counts:
        return []
    # Of id and text, so that rows which share an id have marks of their own; equal rows count once.
    mark = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 30))
    keep = None
    for label, n in counts.items():
        part = (F.col(label_col) == F.lit(label)) & (mark < int(min(1.0, 3 * per_label / n + 30 / n) * (1 << 30)))
        keep = part if keep is None else keep | part
    beyond = F.greatest(F.length(text_col) - CHARS_PER_DOCUMENT, F.lit(0))
    excerpt = F.substr(F.col(text_col), (F.pmod(mark, beyond + 1) + 1).cast("int"), F.lit(CHARS_PER_DOCUMENT))
    rows = (
        base.where(keep)
        .select(F.col(label_col).alias("label"), mark.alias("mark"), F.col(id_col).cast("string").alias("id"), excerpt.alias("text"))
        .distinct()
        .collect()
    )
    rows.sort(key=lambda r: (r.label, r.mark, r.id or "", r.text))
    out: list[tuple[str, bytes]] = []
    taken: dict[str, int] = {}
    for r in rows:
        taken[r.label] = taken.get(r.label, 0) + 1
        if taken[r.label] <= per_label:
            out.append((r.label, r.text.encode()))
    return out


class ContextTrees:
    """The merged context trees of all languages, with frozen costs in bits.

    code[byte]: symbol, 1 to A - 1; bytes that no training text holds share one symbol, as they cost the same anywhere; 0 separates texts.
    child[k][node * A + symbol]: node of depth k + 1, 0 if absent. cost[k][node]: of a (k)-gram's last byte after the others, for each
    language. escape[k][node]: what a language pays to leave this (k)-gram as a context, 0 if it doesn't know it.
    """

    def __init__(self, sample: list[tuple[str, bytes]], order: int = ORDER):
        self.languages = sorted({label for label, _ in sample})
        self.order = order
        if not self.languages:
            return
        seen = np.unique(np.frombuffer(b"".join(t for _, t in sample), np.uint8))
        self.code = np.full(256, len(seen) + 1, np.int64)
        self.code[seen] = np.arange(1, len(seen) + 1)
        self.size = a = len(seen) + 2
        langs = len(self.languages)
        coded = {}
        for x in self.languages:
            parts = []
            for y, t in sample:
                if y == x:
                    parts += [np.zeros(1, np.int64), self.code[np.frombuffer(t, np.uint8)]]
            coded[x] = np.concatenate(parts)
        self.child: list[np.ndarray] = []
        self.cost: list[np.ndarray] = [np.full((1, langs), 8.0)]  # depth 0: any byte, 8 bits
        self.escape: list[np.ndarray] = []
        walks = {x: np.zeros(len(v), np.int64) for x, v in coded.items()}  # node of the k-gram from each position
        alive = {x: np.ones(len(v), bool) for x, v in coded.items()}
        nodes = 1
        suffix = np.zeros(1, np.int64)  # of each node of depth k, the node of depth k - 1 without its first byte
        for k in range(1, order + 2):
            keys, per = [], {}
            for x, v in coded.items():
                n = len(v) - k + 1
                ok = alive[x][: max(n, 0)] & (v[k - 1 :] > 0) if n > 0 else np.zeros(0, bool)
                at = np.flatnonzero(ok)
                key = walks[x][at] * a + v[at + k - 1]
                per[x] = (at, key)
                keys.append(key)
            unique = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
            child = np.zeros(nodes * a, np.int32)
            child[unique] = np.arange(1, len(unique) + 1)
            counts = np.zeros((langs, len(unique) + 1))
            for i, (x, (at, key)) in enumerate(per.items()):
                node = child[key]
                counts[i] = np.bincount(node, minlength=len(unique) + 1)
                walks[x] = np.zeros(len(coded[x]), np.int64)
                walks[x][at] = node
                alive[x] = np.zeros(len(coded[x]), bool)
                alive[x][at] = True
            parent, symbol = unique // a, unique % a
            total = np.stack([np.bincount(parent, counts[i][1:], nodes) for i in range(langs)], 1)
            distinct = np.stack([np.bincount(parent, counts[i][1:] > 0, nodes) for i in range(langs)], 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            here = counts[:, 1:].T
            if k == 1:
                below, new_suffix = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
            else:
                new_suffix = self.child[k - 2][suffix[parent] * a + symbol].astype(np.int64)
                below = new_suffix
            with np.errstate(divide="ignore", invalid="ignore"):
                known = -np.log2(here / (total + distinct)[parent])
            cost = np.where(here > 0, known, escape[parent] + self.cost[k - 1][below])
            self.child.append(child)
            self.escape.append(escape.astype(np.float32))  # of contexts of length k - 1
            self.cost.append(np.vstack([np.zeros((1, langs)), cost]))
            suffix = np.concatenate([[0], new_suffix])
            nodes = len(unique) + 1
        self.cost = [x.astype(np.float32) for x in self.cost]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits that each text, data[offsets[i]:offsets[i + 1]], takes in each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        pieces = []  # (text, first byte, last byte), filled up to PIECE bytes
        size = 0
        for i in range(len(offsets) - 1):
            for start in range(offsets[i], offsets[i + 1], PIECE):
                end = min(start + PIECE, offsets[i + 1])
                pieces.append((i, max(offsets[i], start - self.order), start, end))
                size += end - start
                if size >= PIECE:
                    self._score(data, pieces, out)
                    pieces, size = [], 0
        if pieces:
            self._score(data, pieces, out)
        return out

    def _score(self, data: np.ndarray, pieces: list, out: np.ndarray) -> None:
        n = sum(e - w + 1 for _, w, _, e in pieces) + self.order
        symbols, counted = np.zeros(n, np.int64), np.zeros(n, bool)
        bounds, at = [], 0
        for _, warm, start, end in pieces:
            bounds.append(at)
            at += 1  # the separator
            symbols[at : at + end - warm] = self.code[data[warm:end]]
            counted[at + start - warm : at + end - warm] = True
            at += end - warm
        n = at
        symbols, counted = symbols[: n + self.order], counted[:n]
        a, walk = self.size, [np.zeros(n, np.int32)]
        for k in range(self.order + 1):
            nxt = self.child[k][walk[k].astype(np.int64) * a + symbols[k : n + k]]
            if k:
                nxt[walk[k] == 0] = 0  # the walk left the trie before
            walk.append(nxt)
        bits = np.zeros((n, len(self.languages)), np.float32)
        rest = np.flatnonzero(counted)
        for k in range(self.order + 1, 0, -1):  # the k-gram that ends at each position
            start = rest - (k - 1)
            node = np.where(start >= 0, walk[k][start], 0)
            found = node > 0
            hit = rest[found]
            bits[hit] += self.cost[k][node[found]]
            rest, start = rest[~found], start[~found]
            context = np.where(start >= 0, walk[k - 1][start], 0) if k > 1 else np.zeros(len(rest), np.int64)
            bits[rest] += self.escape[k - 1][context] if k == 1 else np.where((context > 0)[:, None], self.escape[k - 1][context], 0)
        bits[rest] += self.cost[0][0]
        sums = np.add.reduceat(bits.astype(np.float64), bounds)
        np.add.at(out, [i for i, *_ in pieces], sums)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", order: int = ORDER) -> ContextTrees:
    return ContextTrees(training_sample(docs, id_col, text_col, label_col), order)


def identify(docs: DataFrame, model: ContextTrees, keep: list[str], text_col: str = "text") -> DataFrame:
    """`keep` (which holds text_col) and lang_pred, score and bits_per_byte of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's bounds

    def work(batch: pa.RecordBatch) -> dict:
        trees = shared.value
        column = batch.column(batch.schema.names.index(text_col))
        if not trees.languages:
            return {"lang_pred": pa.array(["und"] * len(column), pa.string()), "score": np.zeros(len(column)), "bits_per_byte": np.zeros(len(column))}
        data, offsets = utf8(column)
        bits = trees.lengths(data, offsets)
        best = bits.argmin(1)
        least = bits.min(1)
        score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        letter = np.array([t is not None and any(map(str.isalpha, t)) for t in column.to_pylist()], bool)
        per = least / np.maximum(np.diff(offsets), 1)
        return {
            "lang_pred": pa.array([trees.languages[b] if ok else "und" for b, ok in zip(best, letter)], pa.string()),
            "score": np.where(letter, score, 0.0),
            "bits_per_byte": np.where(letter, per, 0.0),
        }

    return map_batches(docs, keep, "lang_pred string, score double, bits_per_byte double", work)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs), ["doc_id", "text"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
