"""Token ids of many texts at once: their distinct stretches are encoded, the rest is array work.

A change from other characters to white space is a match edge of the pattern
wherever it stands, so texts are cut there: before blanks, and before line
feeds. Arrow splits the texts and looks the stretches up; what is new is encoded
by the library and remembered, and ids are gathered to where they stand. A text
where a blank follows white space, or which holds a string that the encoder
treats by itself, is encoded whole; one where a line feed follows white space is
cut at blanks alone.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as Unicode's White_Space property has it, and what Python adds.
_SPACE = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: A stretch's first character where it isn't a blank.
_CUT = "\x00"
#: Stretches and ids remembered; over either, all are forgotten.
MOST, MOST_IDS = 1 << 20, 1 << 23
#: Bytes of text that are worked on at once; a longer text is cut.
SLICE = 1 << 22
_edge = re.compile(r"(?<=[!-~]) (?=[!-~])").search


class StretchEncoder:
    """encode: ids of a text; whole: the same for a text that can't be cut; special: strings that can't be cut."""

    def __init__(self, encode: Callable[[str], Sequence[int]], whole: Callable[[str], Sequence[int]] | None = None, special: Sequence[str] = ()):
        self.encode, self.whole, self.special = encode, whole or encode, (_CUT, *special)
        self.forget()

    def forget(self) -> None:
        none = pa.array([], pa.string()), np.zeros(0, np.int32)
        #: stretches and their numbers: those inside a text, without the blank before them, and those first in one
        self.inner, self.first = none, none
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int32)

    def numbers(self, texts: pa.Array, known: tuple[pa.Array, np.ndarray], before: str) -> tuple[np.ndarray, tuple[pa.Array, np.ndarray]]:
        """Number of each stretch; the known ones with those that are new."""
        coded = texts.dictionary_encode()
        # the known are looked up among those of the slice, which are fewer, so that no table of all known is made for each slice
        at, out = pc.index_in(known[0], value_set=coded.dictionary), np.full(len(coded.dictionary), -1, np.int32)
        out[at.drop_null().to_numpy()] = known[1][at.is_valid().to_numpy(zero_copy_only=False)]
        lacks = np.flatnonzero(out < 0)
        if not len(lacks):
            return out[coded.indices.to_numpy()], known
        new = coded.dictionary.take(pa.array(lacks))
        ids, sizes, encode = array("I"), [], self.encode
        for t in new.to_pylist():
            got = encode(t[1:] if t[:1] == _CUT else before + t) if t or before else ()
            sizes.append(len(got))
            ids.extend(got)
        numbers = np.arange(len(new), dtype=np.int32) + np.int32(len(self.ends) - 1)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int32)])
        self.ids = np.concatenate([self.ids, np.frombuffer(ids, np.uint32)])
        out[lacks] = numbers
        return out[coded.indices.to_numpy()], (pa.concat_arrays([known[0], new]), np.concatenate([known[1], numbers]))

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which texts are to be encoded whole; for the others the number of each stretch, and each text's first."""
        if len(self.ends) > MOST or len(self.ids) > MOST_IDS:
            self.forget()
        odd = pc.match_substring_regex(texts, _SPACE + " ")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        texts = pc.if_else(odd, "", texts)
        lines = pc.replace_substring(texts, "\n", f" {_CUT}\n")
        texts = pc.if_else(pc.match_substring_regex(texts, _SPACE + "\\n"), texts, lines)
        parts = pc.split_pattern(texts, " ")
        values, first = parts.flatten(), np.asarray(parts.offsets)[:-1].astype(np.int64)
        first -= first[0]
        number, self.inner = self.numbers(values, self.inner, " ")
        number[first], self.first = self.numbers(values.take(pa.array(first)), self.first, "")
        return odd.to_numpy(zero_copy_only=False), number, first

    def run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has. texts: without nulls."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd, number, first = self.places(texts)
        start = self.ends[number]
        size = self.ends[number + 1] - start
        at = np.repeat(start - (np.cumsum(size, dtype=np.int32) - size), size)
        at += np.arange(len(at), dtype=np.int32)
        flat, count = self.ids[at], np.add.reduceat(size, first, dtype=np.int64)
        if odd.any():
            own = np.split(flat, np.cumsum(count)[:-1])
            for i in np.flatnonzero(odd).tolist():
                own[i] = np.asarray(self.whole(texts[i].as_py()), np.uint32)
                count[i] = len(own[i])
            flat = np.concatenate(own)
        return flat, count

    def long(self, text: str) -> np.ndarray:
        """Ids of a text that is cut first, at blanks between ASCII characters."""
        if any(s in text for s in self.special):
            return np.asarray(self.whole(text), np.uint32)
        out, start = [], 0
        while start < len(text):
            edge = _edge(text, start + SLICE) if start + SLICE < len(text) else None
            end = edge.start() if edge else len(text)
            out.append(self.run(pa.array([text[start:end]]))[0])
            start = end
        return np.concatenate(out)

    def encoded(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number of the first row of a slice, ids of its texts in a row, and how many each has; null is empty."""
        texts = pc.fill_null(texts, "")
        total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + SLICE)))
            if last == first + 1 and total[first] - (total[first - 1] if first else 0) > SLICE:
                ids = self.long(texts[first].as_py())
                yield first, ids, np.array([len(ids)])
            else:
                yield first, *self.run(texts.slice(first, last - first))
            first = last
