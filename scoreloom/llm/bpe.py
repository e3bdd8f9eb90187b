"""Operator 4: byte-level BPE by monoid tree reduction.

A text is cut in halves, anywhere, down to leaves of LEAF_CHARS, which the
library encodes. Two neighbours are joined by encoding anew a window around the
cut. The window grows until the tokens outside are proven stable:

* Its edges are match edges of the pattern in either side and in the joined
  text: a change from other characters to a blank, or between ASCII letters,
  digits and marks (not after an apostrophe, where a contraction may begin). No
  match spans such a change, what a match takes before one is settled by the
  characters up to it, and from one on matches depend on the text to the right
  alone, as the pattern has no look-behind.
* Where one run of ASCII letters reaches far to both sides of the cut, it is a
  single pre-token, and the window is one of its tokens: a token row is the
  encoding of its bytes if and only if every adjacent pair encodes to itself, so
  it is enough that the two pairs at the window's edges do.

A side that has no such edge is in the window as a whole. Decoding concatenates
bytes up the same tree; concatenation is associative, so nothing is repaired.

Rows: null text counts as empty; empty text has no ids and the digest of the
empty string; repeated rows and ties are encoded each on their own; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import tiktoken
from pyspark.sql import DataFrame, SparkSession

from . import common

LEAF_CHARS = 4096
#: Characters on either side of a cut that are searched for an edge at first.
REACH = 32
#: A run of letters that reaches so far on either side is joined by its tokens.
LONG_RUN = 512
LEAF_IDS = 1 << 15

#: White space as Unicode's White_Space property has it, and U+001C to U+001F, which are no edge either way.
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_MARK = r"!-/:-@\[-`{-~"
EDGE = re.compile(rf"(?<=[^{SPACE}])(?= )|(?<=[A-Za-z])(?=[0-9{_MARK}])|(?<=[0-9])(?=[A-Za-z{_MARK}])|(?<=[{_MARK}])(?=[0-9])|(?<=[!-&(-/:-@\[-`{{-~])(?=[A-Za-z])")
LETTERS = re.compile("[A-Za-z]*")


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, long_run: int = LONG_RUN):
        self.ranks, self.leaf_chars, self.long_run = ranks, max(4, leaf_chars), max(4, long_run)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.leaf = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.digits = {i: str(i) for i in self.bytes_of}
        self.joins = self.token_joins = 0

    # tokens of one pre-token

    def merged(self, raw: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties."""
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return [whole]
        parts, none = [raw[i : i + 1] for i in range(len(raw))], len(ranks)
        get = ranks.get
        pair = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pair and (best := min(pair)) < none:
            i = pair.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def agree(self, a: int, b: int) -> bool:
        return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int], before: int, after: int) -> list[int] | None:
        """Joins token rows within one pre-token, of which `before` and `after` bytes are in reach; None if that is too few."""
        size, k = self.bytes_of, 2
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            outside = left[max(0, a - 1) :], right[: b + 1]
            if sum(len(size[t]) for t in outside[0]) > before or sum(len(size[t]) for t in outside[1]) > after:
                return None
            # letters alone, so the library takes them as one pre-token
            window = self.leaf(b"".join(size[t] for t in left[a:] + right[:b]).decode("ascii"))
            if (a == 0 or self.agree(left[a - 1], window[0])) and (b == len(right) or self.agree(window[-1], right[b])):
                self.token_joins += 1
                return left[:a] + window + right[b:]
            k *= 2

    # texts

    def _before(self, text: str, start: int, cut: int) -> int:
        """Last edge between start and cut, or start."""
        reach = REACH
        while True:
            low = max(start, cut - reach)
            # an edge needs the character before it, and one of the left side after it
            last = low
            for m in EDGE.finditer(text, low + 1, cut):
                if m.start() < cut:
                    last = m.start()
            if last > low or low == start:
                return last
            reach *= 2

    def _after(self, text: str, cut: int, end: int) -> int:
        """First edge between cut and end, or end."""
        m = EDGE.search(text, cut + 1, end)
        return m.start() if m and m.start() < end else end

    def join(self, text: str, start: int, cut: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[start:end] from those of its two sides."""
        self.joins += 1
        reach = self.long_run
        if cut - start > reach and end - cut > reach and LETTERS.match(text, cut - reach, cut + reach).end() == cut + reach:
            # the first letter in reach may belong to a blank or a contraction before it
            low, high = cut - reach + 4, LETTERS.match(text, cut, end).end()
            if (done := self.join_tokens(left, right, cut - low, high - cut - 4)) is not None:
                return done
        a, b = self._before(text, start, cut), self._after(text, cut, end)
        size = self.bytes_of
        gone, i = len(text[a:cut].encode()), len(left)
        while gone > 0:
            i -= 1
            gone -= len(size[left[i]])
        here, j = len(text[cut:b].encode()), 0
        while here > 0:
            here -= len(size[right[j]])
            j += 1
        left[i:] = self.leaf(text[a:b])
        left += right[j:] if j else right
        return left

    def encode(self, text: str, start: int = 0, end: int | None = None) -> list[int]:
        end = len(text) if end is None else end
        if end - start <= self.leaf_chars:
            return self.leaf(text[start:end])
        cut = (start + end) // 2
        return self.join(text, start, cut, end, self.encode(text, start, cut), self.encode(text, cut, end))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def ranks_from(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def codec_for(path: str, pattern: str) -> Codec:
    """One a Python worker, so that its tasks share it."""
    return Codec(ranks_from(path), pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs."""

    def make() -> Callable[[str], tuple]:
        codec = codec_for(path, pattern)
        digits = codec.digits.__getitem__

        def one(text: str) -> tuple:
            ids = codec.encode(text)
            line = " ".join(map(digits, ids))
            return len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

        return one

    return common.map_rows(docs, ["doc_id"], make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
