"""Counts of one text that the quality rules and the quality classifier share."""

from __future__ import annotations

import numpy as np

#: Frequent words of four languages.
COMMON = {
    "en": "the of and to in a is that for it was on with as be by at this are from or an not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})
_PLACE = {w: i for i, w in enumerate(WORDS)}
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Classes of characters by UTF-8 byte; trailing bytes of a character count in none.
CLASSES = ("lower", "upper", "digit", "blank", "stop", "mark", "symbol", "control", "latin", "other")
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _chars, _name in (
    (range(97, 123), "lower"), (range(65, 91), "upper"), (range(48, 58), "digit"), ((9, 10, 11, 12, 13, 32), "blank"), (b".,", "stop"),
    (b"!?;:'\"()-_/@[]{}+=\\^`~", "mark"), (SYMBOLS, "symbol"), ([*range(0, 9), *range(14, 32), 127], "control"), (range(0xC2, 0xC6), "latin"), (range(0xC6, 0xF8), "other"),
):
    _CLASS[list(_chars)] = CLASSES.index(_name)
WINDOW = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def repeated_words(ids: np.ndarray) -> int:
    """Words in WINDOW-word windows found twice or more; ids: a number for each word."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    key = sum(x[i : i + n] * _ODD[i] for i in range(WINDOW))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


class Stats:
    """Counts of a text; words are what stands between blanks."""

    def __init__(self, text: str):
        raw = text.encode()
        words = raw.split()
        number: dict[bytes, int] = {}
        put = number.setdefault
        ids = np.array([put(w, len(number)) for w in words], np.int64)
        self.n_words, self.n_unique = len(words), len(number)
        self.classes = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]
        self.n_chars = int(self.classes.sum())
        self.word_chars = self.n_chars - int(self.classes[3])
        self.n_symbols = int(self.classes[6])
        seen: set[str] = set()
        self.n_lines = self.n_dup_lines = self.longest_line = 0
        for line in text.split("\n"):
            if line.strip(" \t\n\v\f\r"):
                self.n_lines += 1
                self.n_dup_lines += line in seen
                self.longest_line = max(self.longest_line, len(line))
                seen.add(line)
        self.n_repeat_words = repeated_words(ids)
        # frequent words in lower case, without marks around
        counts = np.bincount(ids, minlength=1).tolist()
        self.common = np.zeros(len(WORDS), np.int64)
        for w, n in zip(number, counts):
            if len(w) < 12 and (at := _PLACE.get(w.decode().strip(".,;:!?\"'()%&#*$|").lower())) is not None:
                self.common[at] += n
        self.most = max(counts) if words else 0
        self.longest_word = max(map(len, number), default=0)
