"""7. Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features.

The base finds emails, IPv4 addresses, payment cards (Luhn) and international phone numbers by their patterns. The field labels the words
of each line with O, or the beginning or inside of a kind, from features of the word and of its neighbours: shape (letters x, digits d up
to four in a row, other marks as they are), which classes of characters it holds, and its number of digits. It is trained on a small
labelled table of made-up lines (`labelled_lines`) by gradient ascent on the conditional likelihood, and decoded by Viterbi for many
lines at once in numpy. Spans that it finds and that meet no base span are added; base spans always stay. It finds what the patterns
can't: numbers and addresses whose words carry noise marks between them.

A line without a digit or `@` can hold none of the kinds: it is all O by definition and isn't decoded.

Defined cases: null or empty text has no span. Offsets count code points, ends exclusive. Texts and lines of any length are read whole.
Spans of one kind never overlap; of those that begin alike the pattern's stands. Repeated rows stay rows, each with its spans. An empty table
gives no row. Kept columns that are called like a result raise ValueError; others make no difference.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortgeo.llm.common import map_batches, utf8

KINDS = ("email", "ip", "card", "phone")
_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that begins within a run of digits would begin at the run's start as well.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each `@`: the local part is the whole run before it, so no start is tried twice."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        end = None
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        last = end or at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


# ---- the field

STATES = ("O", "B-email", "I-email", "B-ip", "I-ip", "B-card", "I-card", "B-phone", "I-phone")
#: Classes of bytes: letters (any byte beyond ASCII is one), digits, and each other mark.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 120
_CLASS[48:58] = 100
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_FLAG = np.zeros(256, np.int64)
_FLAG[_CLASS == 120] = 1
_FLAG[100 - 52 : 58] = 2
_FLAG[[64]], _FLAG[[46]], _FLAG[[45]], _FLAG[[43]], _FLAG[[40, 41]] = 4, 8, 16, 32, 64
_FLAG[[*range(33, 40), 42, 44, 47, *range(58, 64), *range(91, 97), *range(123, 127)]] = 128
#: Bucket of a word's number of digits.
_COUNT = np.array([0, 1, 2, 3, 4, 5, 5, 5, 6, 6, 6, 6, 6, 7, 7, 7, 8, 8, 8, 8, 9])
_ODD, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Words:
    """The words of a buffer: where they are, their shapes' hashes, flags and counts of digits."""

    def __init__(self, data: np.ndarray):
        word = ~_BLANK[data]
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        n = len(self.begin)
        if not n:
            self.shape = np.zeros(0, np.uint64)
            self.flags = self.digits = np.zeros(0, np.int64)
            return
        kind = _CLASS[data]
        same = np.concatenate([[False], kind[1:] == kind[:-1]])
        keep = word & ~((kind == 120) & same)
        four = same.copy()  # a fifth digit in a row and all after it
        for _ in range(3):
            four = np.concatenate([[False], four[:-1]]) & same
        keep &= ~((kind == 100) & four)
        at = np.flatnonzero(keep)
        begin = np.searchsorted(at, self.begin)
        bits = np.bitwise_or.reduceat(_FLAG[data[at]], begin)
        self.flags = bits
        self.digits = np.add.reduceat(np.where(word, data - 48 < 10, False).astype(np.int64), self.begin)
        rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(at)]])))
        with np.errstate(over="ignore"):
            mixed = (kind[at].astype(np.uint64) + np.uint64(1)) * _powers(int(rank.max()) + 1)[rank]
            self.shape = np.add.reduceat(mixed, begin)


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1024), _ODD)]), dtype=np.uint64)
    return _POWERS


def labelled_lines(n: int = 240, seed: int = 7) -> list[tuple[str, list[str]]]:
    """The labelled table: made-up lines, words and their labels, the same at each call."""
    r = random.Random(seed)
    syllables = "an er ion la do ke mi sol tar ven qu est ou be ra li".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    noise = ("", "", "###", "***", "&&&", "$$$", "%%%", "!!")
    table = []
    for i in range(n):
        mark = r.choice(noise)
        deco = lambda w: w + (mark if mark else r.choice(["", "", "", ",", ".", ";"]))  # noqa: B023, E731
        line: list[tuple[str, str]] = []
        for _ in range(r.randint(2, 9)):
            w = word()
            line.append((deco(w.capitalize() if r.random() < 0.2 else w.upper() if r.random() < 0.1 else w), "O"))
        kind = i % 9
        if kind == 0:
            item = [(f"{word()}.{digits(2)}@mail{digits(1)}.{word()}.com", "B-email")]
        elif kind == 1:
            item = [(".".join(str(r.randint(0, 255)) for _ in range(4)), "B-ip")]
        elif kind == 2:
            item = [(digits(16), "B-card")]
        elif kind == 3:
            item = [(digits(4), "B-card"), *[(digits(4), "I-card") for _ in range(3)]]
        elif kind == 4:
            item = [(f"+{r.randint(1, 99)}", "B-phone"), (f"({digits(3)})", "I-phone"), (f"{digits(3)}-{digits(4)}", "I-phone")]
        elif kind == 5:
            item = [(r.choice(["version", "page", "in", "chapter"]), "O"), (r.choice([f"{digits(1)}.{digits(1)}", digits(1), f"19{digits(2)}", f"20{digits(2)}", f"{digits(2)}%"]), "O")]
        elif kind == 6:
            item = [("token", "O"), ("=", "O"), ('"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', "O")]
        elif kind == 7:
            item = [(f"{word()} | {word()} |".split()[j], "O") for j in range(4)]
        else:
            item = [(w, "O") for w in f"Licensed under the {word()} License, Version {digits(1)}.{digits(1)}".split()]
        if mark:
            item = [(w + mark, y) for w, y in item]
        at = r.randint(0, len(line))
        line[at:at] = item
        table.append((" ".join(w for w, _ in line), [y for _, y in line]))
    return table


class Field:
    """Weights by feature, place (before, at, after) and state, and of steps from state to state."""

    def __init__(self, table: list[tuple[str, list[str]]], rounds: int = 120, rate: float = 0.3, decay: float = 1e-3):
        words = [Words(np.frombuffer(t.encode(), np.uint8)) for t, _ in table]
        self.shapes = np.unique(np.concatenate([w.shape for w in words]))
        self.sizes = (len(self.shapes) + 1, 256, 10)
        n, k = sum(self.sizes) + 1, len(STATES)
        self.weights, self.step = np.zeros((3, n, k)), np.zeros((k, k))
        self.first = np.zeros(k)
        blocked = np.zeros((k, k))  # I follows B or I of its kind only
        for j, y in enumerate(STATES):
            if y[0] == "I":
                blocked[[i for i, x in enumerate(STATES) if x[2:] != y[2:]], j] = -1e4
        start = np.array([-1e4 if y[0] == "I" else 0.0 for y in STATES])
        lengths = [len(y) for _, y in table]
        width = max(lengths)
        feats = np.full((len(table), width + 2, 3), n - 1)  # n - 1: no word
        gold = np.zeros((len(table), width), int)
        real = np.zeros((len(table), width), bool)
        for i, (w, (_, y)) in enumerate(zip(words, table)):
            feats[i, 1 : len(y) + 1] = self.features(w)
            gold[i, : len(y)] = [STATES.index(x) for x in y]
            real[i, : len(y)] = True
        hot = np.eye(k)[gold] * real[..., None]
        square = np.zeros_like(self.weights), np.zeros_like(self.step)
        pair_gold = np.einsum("ntj,ntk->jk", hot[:, :-1], hot[:, 1:])
        for _ in range(rounds):
            e = sum(self.weights[p][feats[:, p : p + width]].sum(2) for p in range(3))
            e[:, 0] += start
            step = self.step + blocked
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0]
            for t in range(1, width):
                x = a[:, t - 1, :, None] + step
                m = x.max(1)
                a[:, t] = np.where(real[:, t, None], m + np.log(np.exp(x - m[:, None]).sum(1)) + e[:, t], a[:, t - 1])
            for t in range(width - 2, -1, -1):
                x = step + (e[:, t + 1] + b[:, t + 1])[:, None]
                m = x.max(2)
                b[:, t] = np.where(real[:, t + 1, None], m + np.log(np.exp(x - m[..., None]).sum(2)), 0)
            last = a[np.arange(len(table)), np.array(lengths) - 1]
            z = last.max(1) + np.log(np.exp(last - last.max(1, keepdims=True)).sum(1))
            p = np.exp(a + b - z[:, None, None]) * real[..., None]
            pair = np.zeros_like(self.step)
            for t in range(1, width):
                q = np.exp(a[:, t - 1, :, None] + step + (e[:, t] + b[:, t])[:, None] - z[:, None, None])
                pair += (q * real[:, t, None, None]).sum(0)
            grad = np.zeros_like(self.weights)
            for place in range(3):
                for f in range(3):
                    np.add.at(grad[place], feats[:, place : place + width, f], hot - p)
            for w, g, s in ((self.weights, grad, square[0]), (self.step, pair_gold - pair, square[1])):
                g = g - decay * len(table) * w
                s += g * g
                w += rate * g / (np.sqrt(s) + 1e-8)
        self.step += blocked
        self.start = start

    def features(self, w: Words) -> np.ndarray:
        """Rows of weights of each word: of its shape, its flags and its digits."""
        at = np.searchsorted(self.shapes, w.shape)
        at[at == len(self.shapes)] = 0
        shape = np.where(self.shapes[at] == w.shape, at + 1, 0)
        a, b, _ = self.sizes
        return np.stack([shape, a + w.flags, a + b + _COUNT[np.minimum(w.digits, 20)]], 1)

    def decode(self, feats: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best states of lines laid end to end; feats has the rows of each word."""
        k = len(STATES)
        none = len(self.weights[0]) - 1
        out = np.zeros(len(feats), np.int8)
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            size = max(2 * int(lengths[order[at]]), 16)  # lines up to twice as long go together
            group = order[at : at + np.searchsorted(lengths[order[at:]], size, "right")]
            group = group[: max(1, (1 << 18) // size)]
            at += len(group)
            n, width = lengths[group], int(lengths[group].max())
            where = first[group][:, None] + np.arange(width)
            real = np.arange(width) < n[:, None]
            f = np.where(real[..., None], feats[np.minimum(where, len(feats) - 1)], none)
            f = np.concatenate([np.full((len(group), 1, 3), none), f, np.full((len(group), 1, 3), none)], 1)
            score, back = None, np.zeros((width, len(group), k), np.int8)
            for t in range(width):
                e = sum(self.weights[p][f[:, t + p]].sum(1) for p in range(3))
                if score is None:
                    score = e + self.start
                    continue
                x = score[:, :, None] + self.step
                back[t] = x.argmax(1)
                score = np.where(real[:, t, None], x.max(1) + e, score)
            best = score.argmax(1)
            for t in range(width - 1, -1, -1):
                live = real[:, t]
                out[where[live, t]] = best[live]
                if t:
                    best = np.where(live, back[t][np.arange(len(group)), best], best)
        return out

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[str, int, int]]]:
        """(kind, first byte, last byte + 1) that the field finds in each text."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        # A blank between texts, so that no word crosses.
        n = len(offsets) - 1
        parted = np.insert(data, offsets[1:-1], 10) if n > 1 else data
        shift = offsets + np.arange(n + 1)
        shift[-1:] = offsets[-1] + max(n - 1, 0)
        w = Words(parted)
        if not len(w.begin):
            return out
        ends = np.concatenate([[0], np.cumsum(parted == 10)])  # line of each byte
        line = ends[w.begin]
        new = np.concatenate([[True], line[1:] != line[:-1]])
        start = np.flatnonzero(new)
        lengths = np.diff(np.concatenate([start, [len(line)]]))
        odd = np.logical_or.reduceat((w.flags & (2 | 4)) > 0, start)
        if not odd.any():
            return out
        pick = np.repeat(odd, lengths)
        index = np.flatnonzero(pick)
        small = Words.__new__(Words)
        small.shape, small.flags, small.digits = w.shape[index], w.flags[index], w.digits[index]
        state = self.decode(self.features(small), lengths[odd])
        i = 0
        found = np.flatnonzero(state > 0)
        while i < len(found):
            j, kind = found[i], STATES[state[found[i]]][2:]
            k = j + 1
            i += 1
            while i < len(found) and found[i] == k and STATES[state[k]] == f"I-{kind}":
                k += 1
                i += 1
            s, e = w.begin[index[j]], w.end[index[k - 1]]
            doc = int(np.searchsorted(shift, s, "right")) - 1
            out[doc].append((kind, int(s - shift[doc]), int(e - shift[doc])))
        return out


_TRIM_LEFT, _TRIM_RIGHT = re.compile(r"[^A-Za-z0-9+(]*"), re.compile(r"[^A-Za-z0-9)]*\Z")


def all_spans(text: str, base: list[tuple[str, int, int]], found: list[tuple[str, int, int]], raw: bytes) -> list[tuple[str, int, int]]:
    """Base spans, and those of the field (in bytes) that meet none of them, trimmed of marks at their ends."""
    out = list(base)
    for kind, s, e in found:
        s = len(raw[:s].decode())
        e = s + len(raw[len(text[:s].encode()) : e].decode())
        s += len(_TRIM_LEFT.match(text[s:e])[0])
        e -= len(_TRIM_RIGHT.search(text[s:e])[0])
        if s < e and all(e <= x or s >= y for _, x, y in base):
            out.append((kind, s, e))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


_FIELD: list[Field] = []


def field() -> Field:
    """The trained field; the labelled table and the training are fixed, so each process makes the same one, once."""
    if not _FIELD:
        _FIELD.append(Field(labelled_lines()))
    return _FIELD[0]


def find_pii(docs: DataFrame, keep: list[str], text_col: str = "text", redact: bool = False) -> DataFrame:
    """`keep` (which holds text_col) and counts and digest of base spans, all spans, and with `redact` the text with each span replaced
    by [KIND] (overlapping spans by the first of them)."""
    shared = docs.sparkSession.sparkContext.broadcast(field())

    def work(batch: pa.RecordBatch) -> dict:
        column = batch.column(batch.schema.names.index(text_col))
        data, offsets = utf8(column)
        added = shared.value.spans(data, offsets)
        out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": [], "redacted": []}
        for i, text in enumerate(column.to_pylist()):
            text = text or ""
            base = base_spans(text)
            spans = all_spans(text, base, added[i], data[offsets[i] : offsets[i + 1]].tobytes()) if added[i] else base
            for k in KINDS:
                out[f"n_{k}"].append(sum(x[0] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
            if redact:
                parts, at = [], 0
                for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                    if s >= at:
                        parts += [text[at:s], f"[{kind.upper()}]"]
                    at = max(at, e)
                out["redacted"].append("".join([*parts, text[at:]]) if spans else text)
        types = {"base_sha256": pa.string(), "spans": pa.string(), "redacted": pa.string()}
        return {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()}

    added = ", ".join([*(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"] + ["redacted string"] * redact)
    return map_batches(docs, keep, added, work)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "text"]).drop("text")
