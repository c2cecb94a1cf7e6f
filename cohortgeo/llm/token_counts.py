"""2. Token counts by prefix dynamic programming over a byte-pair vocabulary.

Within one pre-token (the tokenizer first cuts text by a pattern, and no token crosses a cut) the encoding of every prefix is known from
shorter prefixes: exactly one token t that ends at byte i follows the last token of the encoding of what is before it in a way that the
merges keep, so last[i] = t and count[i] = count[i - len(t)] + 1. Two tokens stand side by side if their joined bytes encode to just
those two; each pair is tried once and remembered. A worker stores the counts at all prefixes of each pre-token, a byte each, and a
text's table is its pre-tokens, how many tokens are before each, and these stored counts: the count at a prefix is the count before its
last pre-token plus a stored one. Truncation and budget questions read the table and encode nothing again.

Where a cut changes what is before it, the table holds the count as well: blanks at the end of a prefix are one pre-token, so each whole run
of blanks is stored like one; a prefix of `'re`, `'ve` or `'ll` is stored by its own pre-tokens. Only a cut inside a special string, which
is then no special string any more, cuts the few pre-tokens beside it anew.

The counts are those of the `tokenizers` library with its defaults: special strings inside a text count as one token. The vocabulary
file's path is a parameter.

Defined cases: null or empty text has no bytes and no tokens. Texts and pre-tokens of any length are counted whole. Repeated rows stay rows,
each with its counts. An empty table gives no row. Kept columns that are called like a result (n_bytes, n_tokens, over_limit, fit_chars)
raise ValueError; others make no difference.
"""

from __future__ import annotations

import os
from array import array
from bisect import bisect_left, bisect_right
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cohortgeo.llm.common import map_batches

#: Pre-tokens whose counts a worker keeps; beyond, it starts anew.
KEPT_WORDS, KEPT_PAIRS = 1_000_000, 1_000_000
#: A pre-token of more bytes isn't kept by a worker, only by a text's table. Counts of kept ones fit into a byte.
KEPT_BYTES = 64
_LAST = itemgetter(-1)
#: What the pattern takes for a blank.
_BLANK = frozenset(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))
LIMIT = 512


def vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str, dict[str, int]]:
    """Token bytes to ids, the pre-token pattern, and special strings, of a byte-level BPE file."""
    import json

    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        found = json.load(f)
    # The printable stand-ins of byte-level BPE: printable Latin-1 is itself, other bytes follow from 256 up.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {x["content"]: x["id"] for x in found["added_tokens"] if x["special"]}
    ranks = {bytes(map(byte.__getitem__, k)): v for k, v in found["model"]["vocab"].items() if k not in special}
    return ranks, public_tokenizers.PATTERN, special


class PrefixCounts(dict):
    """pre-token -> tokens of each of its byte prefixes from 0 on, filled as asked for."""

    def __init__(self, path: str | None = None):
        import tiktoken

        super().__init__()
        self.ranks, pattern, self.special = vocabulary(path)
        self.find = regex.compile(pattern).findall
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.longest = max(map(len, self.ranks))
        self.pair: dict[int, bool] = {}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.whole = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece

    def _beside(self, left: int, right: int) -> bool:
        """Whether the merges keep two tokens apart that stand side by side."""
        if len(self.pair) > KEPT_PAIRS:
            self.pair.clear()
        got = self.pair[left << 20 | right] = self.whole(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return got

    def at(self, word: bytes) -> list[int]:
        """Exact token count of every prefix of a pre-token, by length in bytes from 0."""
        ranks, pair = self.ranks, self.pair
        count, last = [0], [-1]
        for i in range(1, len(word) + 1):
            for start in range(max(0, i - self.longest), i):
                token = ranks.get(word[start:i])
                if token is not None:
                    if start == 0:
                        if self.whole(word[:i]) == [token] if i > 1 else True:
                            break
                        continue
                    before = last[start]
                    ok = pair.get(before << 20 | token)
                    if ok or (ok is None and self._beside(before, token)):
                        break
            count.append(count[start] + 1)
            last.append(token)
        return count

    def __missing__(self, word: str):
        if word in self.special:  # the pattern never gives one whole, as pieces() cuts them out first
            return bytes([0, 1])
        raw = word.encode()
        counts = self.at(raw)
        if raw[:1] == b"'" and len(raw) > 2:  # a prefix of 're is ' and r
            for i in range(1, len(raw)):
                if len(parts := self.find(raw[:i].decode(errors="ignore"))) > 1:
                    counts[i] = sum(self.at(p.encode())[-1] for p in parts)
        if len(raw) > KEPT_BYTES:
            return array("I", counts)
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = bytes(counts)
        return found

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special strings, which join to the text."""
        if self.cut is None or not (found := list(self.cut.finditer(text))):
            return self.find(text)
        out, at = [], 0
        for m in found:
            out += [*self.find(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.find(text[at:])

    def counts_of(self, parts: list[str]) -> list[int]:
        """Tokens of each piece."""
        return [*map(_LAST, map(self.__getitem__, parts))]

    def counts(self, text: str) -> list[int]:
        return self.counts_of(self.pieces(text))


class TextTable:
    """The counts at all prefixes of one text."""

    def __init__(self, counter: PrefixCounts, text: str, parts: list[str] | None = None, counts: list[int] | None = None):
        self.counter, self.text = counter, text
        self.parts = counter.pieces(text) if parts is None else parts
        self.starts = [0, *accumulate(map(len, self.parts))]
        self.before = [0, *accumulate(counter.counts_of(self.parts) if counts is None else counts)]
        self.long: dict[str, array] = {}

    def _stored(self, word: str):
        """The stored counts of a pre-token or a run of blanks; those that the worker doesn't keep stay in this table."""
        found = self.long.get(word)
        if found is None:
            found = self.counter[word]
            if isinstance(found, array):
                self.long[word] = found
        return found

    def _blanks(self, chars: int) -> int:
        """Where the run of blanks that holds the character before `chars` begins."""
        while chars and self.text[chars - 1] in _BLANK:
            chars -= 1
        return chars

    def _part(self, chars: int) -> tuple[int, int, str]:
        """What holds the character before `chars`, which isn't in a special string: where it begins, the tokens before it, and the pre-token
        or whole run of blanks."""
        if self.text[chars - 1] not in _BLANK:
            j = bisect_left(self.starts, chars) - 1
            return self.starts[j], self.before[j], self.parts[j]
        first = last = self._blanks(chars)  # a run of blanks begins with a pre-token
        while last < len(self.text) and self.text[last] in _BLANK:
            last += 1
        return first, self.before[bisect_left(self.starts, first)], self.text[first:last]

    def tokens(self, chars: int | None = None) -> int:
        """Tokens of the text's first `chars` characters (all, if None), as if they were a text of their own."""
        if chars is None or chars >= len(self.text):
            return self.before[-1]
        if chars <= 0:
            return 0
        j = bisect_left(self.starts, chars) - 1
        if self.parts[j] in self.counter.special:
            if self.starts[j + 1] == chars:
                return self.before[j + 1]
            # A special string that is cut joins what is before.
            while j and self.parts[j - 1] not in self.counter.special and not (self.parts[j - 1][-1] not in _BLANK and self.parts[j][0] in _BLANK):
                j -= 1
            return self.before[j] + sum(self.counter.counts(self.text[self.starts[j] : chars]))
        first, before, word = self._part(chars)
        return before + self._stored(word)[len(word[: chars - first].encode())]

    def longest_prefix(self, limit: int) -> int:
        """Most characters that take at most `limit` tokens."""
        if self.before[-1] <= limit:
            return len(self.text)
        # Beyond the run of blanks or the special string there, a prefix has more tokens than the whole pre-tokens before it.
        j = bisect_right(self.before, limit)
        while j < len(self.parts) and (self.parts[j] in self.counter.special or self.parts[j][0] in _BLANK or self.parts[j - 1] in self.counter.special):
            j += 1
        chars = self.starts[j]
        while chars:
            if self.parts[bisect_left(self.starts, chars) - 1] in self.counter.special:
                if self.tokens(chars) <= limit:
                    return chars
                chars -= 1
                continue
            first, before, word = self._part(chars)
            stored, ends = self._stored(word), [*accumulate(len(c.encode()) for c in word[: chars - first])]
            for k in range(len(ends), 0, -1):
                if before + stored[ends[k - 1]] <= limit:
                    return first + k
            chars = first
        return 0


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """`keep` (which holds text_col) and n_bytes, n_tokens, over_limit and fit_chars: the most characters from the start that take at most
    `limit` tokens."""
    state: list[PrefixCounts] = []

    def work(batch: pa.RecordBatch) -> dict:
        if not state:
            state.append(_counter(path))
        counter = state[0]
        n_bytes, n_tokens, fit = [], [], []
        for text in batch.column(batch.schema.names.index(text_col)).to_pylist():
            text = text or ""
            parts = counter.pieces(text)
            counts = counter.counts_of(parts)
            total = sum(counts)
            n_bytes.append(len(text.encode()))
            n_tokens.append(total)
            fit.append(len(text) if total <= limit else TextTable(counter, text, parts, counts).longest_prefix(limit))
        n_tokens = np.array(n_tokens, np.int64)
        return {"n_bytes": np.array(n_bytes, np.int64), "n_tokens": n_tokens, "over_limit": n_tokens > limit, "fit_chars": np.array(fit, np.int64)}

    return map_batches(docs, keep, "n_bytes long, n_tokens long, over_limit boolean, fit_chars long", work)


_COUNTERS: dict[str | None, PrefixCounts] = {}


def _counter(path: str | None) -> PrefixCounts:
    """One table of pre-tokens for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounts(path)
    return _COUNTERS[path]


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, ["doc_id", "text"]).drop("text")
