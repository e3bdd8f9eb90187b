"""Operator 13: groups of spelling variants, by full neighbourhood generation.

Words are counted over all texts. For every word all distinct deletions,
replacements and insertions over the observed alphabet are generated; those
that are words themselves are its near words, so no distance is ever computed.
A word's form is its most frequent near word, if that is ten times as frequent;
following forms gives the root that a group of variants shares.

A word of ten letters has some 1,500 neighbours, nearly all of them no words.
They are generated as numbers (sums of one mixed number for each letter and
place, so a neighbour's number takes one addition) and looked up in a bit filter
of the vocabulary; what passes becomes a string and is hash-joined to the
vocabulary, so a false pass of the filter costs a row and never a result. The
filter has a proven size: it covers SLICE_WORDS words at most, and a larger
vocabulary is taken in slices by hash, each with a filter of its own, generated
against in turn.

Long texts are worked on in pieces and long words in ranges of places. A frequent
word costs one row a task; a word's rows in the join are at most its neighbours.

Rows: null texts have no words; a null doc_id takes part in the deletion rule as
an empty string; repeated rows count each; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_LENGTH, LEAST_COUNT, FACTOR, DELETED = 7, 2, 10, 31
#: Code points of a text that are worked on at once; counted words that a task holds.
PIECE, HELD = 1 << 22, 1 << 19
#: Words under one filter, its bits a word and its probes: 2 to 3 false passes in 100,000.
SLICE_WORDS, BITS_A_WORD, PROBES = 1 << 25, 32, 6
#: Bits in a part of the filter; neighbours made at once; rows sent at once.
PART_BITS, AT_ONCE, ROWS = 1 << 20, 1 << 18, 1 << 14
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xBF58476D1CE4E5B9], np.uint64)
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
_LETTER = re.compile("[a-zA-ZÀ-ÿ]+")


def runs(text: str) -> Iterator[list[str]]:
    """Maximal runs of LEAST_LENGTH letters and more, A-Z in lower case; long texts in pieces that end beside a letter run."""
    start = 0
    while start < len(text):
        end = start + PIECE
        if end < len(text) and (rest := _LETTER.match(text, end)):
            end = rest.end()
        # bytes.lower() knows ASCII letters alone
        yield _RUN.findall(text[start:end].encode().lower().decode())
        start = end


def variant(run: str, h: int) -> str:
    """The run, without one letter where DELETED divides h."""
    if h % DELETED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words that occur LEAST_COUNT times and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), common.texts_of(batch)):
                before = zlib.crc32(f"{doc_id}:".encode())
                for found in runs(text):
                    for r, k in Counter(found).items():
                        w = variant(r, zlib.crc32(r.encode(), before))
                        if len(w) >= LEAST_LENGTH:
                            held[w] += k
                    if len(held) >= HELD:
                        yield sent()
        yield sent()

    given = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return given.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def mixed(letter: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for a letter (code point) at a place; a word's number is their sum."""
    x = (letter.astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which words have one length, and their letters: a row each."""
    length = np.array([len(w) for w in words])
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        letters = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32)
        yield at, letters.reshape(len(at), n)


def numbers(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for at, letters in by_length(words):
        out[at] = mixed(letters, np.arange(letters.shape[1])).sum(axis=1, dtype=np.uint64)
    return out


def slice_of(number: np.ndarray, slices: int) -> np.ndarray:
    return (number % np.uint64(slices)).astype(np.int64)


class WordFilter:
    """Bits that are set for the words of a slice; passes may be false, misses never."""

    def __init__(self, bits: int, parts: dict[int, bytes]):
        self.shift = np.uint64(64 - (bits - 1).bit_length())
        size = min(bits, PART_BITS) // 8
        whole = bytearray(bits // 8)
        for part, raw in parts.items():
            whole[part * size : part * size + len(raw)] = raw
        self.bits = np.frombuffer(bytes(whole), np.uint8)

    def probe(self, number: np.ndarray, k: int) -> np.ndarray:
        at = (number * _ODD[k]) >> self.shift
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0

    def passing(self, number: np.ndarray) -> np.ndarray:
        """Places in `number` (flattened) of what passes all probes."""
        flat = number.reshape(-1)
        at = np.flatnonzero(self.probe(flat, 0))
        for k in range(1, PROBES):
            at = at[self.probe(flat[at], k)]
        return at


def filter_bits(words: int) -> int:
    return 1 << max(16, (words * BITS_A_WORD - 1).bit_length())


def filters(words: DataFrame, count: int) -> Iterator[WordFilter]:
    """A filter for each slice of the vocabulary; each has at most SLICE_WORDS words (a little more by chance) and is built in parts."""
    slices = -(-count // SLICE_WORDS)
    bits = filter_bits(min(count, SLICE_WORDS))
    shift, part_bits = np.uint64(64 - (bits - 1).bit_length()), min(bits, PART_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = numbers(batch.column("word").to_pylist())
            of = slice_of(number, slices)
            for s in np.unique(of):
                at = np.unique(((number[of == s][:, None] * _ODD) >> shift).astype(np.int64))
                part, first = np.unique(at // part_bits, return_index=True)
                raw = [x.astype(np.uint32).tobytes() for x in np.split(at % part_bits, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), s)), pa.array(part), pa.array(raw, pa.binary())], ["slice", "part", "bits"])

    def join(t: pa.Table) -> pa.Table:
        flags = np.zeros(part_bits, bool)
        for raw in t["bits"]:
            flags[np.frombuffer(raw.as_buffer(), np.uint32)] = True
        return pa.table({"slice": t["slice"][:1], "part": t["part"][:1], "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    schema = "slice bigint, part bigint, bits binary"
    parts = words.select("word").mapInArrow(places, schema).groupBy("slice", "part").applyInArrow(join, schema)
    parts = common.written(parts, "word-filter") if slices > 1 else parts
    for s in range(slices):
        yield WordFilter(bits, {r["part"]: bytes(r["bits"]) for r in parts.where(F.col("slice") == s).collect()})


def neighbours(letters: np.ndarray, alphabet: np.ndarray, known: WordFilter) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of all distinct deletions, replacements and insertions of words of one length those that pass the filter:
    rows of the words, places, letters put there (0: none), and how many letters they take away.
    """
    rows, size = letters.shape
    place = np.arange(size)
    total = mixed(letters, place)
    before = np.zeros((rows, size + 1), np.uint64)
    np.cumsum(total, axis=1, out=before[:, 1:])
    # sums of what stands behind a place, moved by one
    left, right = (np.zeros((rows, size + 1), np.uint64) for _ in "ab")
    left[:, :-1] = np.cumsum(mixed(letters, place - 1)[:, ::-1], axis=1)[:, ::-1]
    right[:, :-1] = np.cumsum(mixed(letters, place + 1)[:, ::-1], axis=1)[:, ::-1]
    # of a stretch of one letter the last goes; a letter is put before another one or at the end, so that nothing comes twice
    at = known.passing(before[:, :-1] + left[:, 1:])
    row, i = np.divmod(at, size)
    keep = (i == size - 1) | (letters[row, i] != letters[row, np.minimum(i + 1, size - 1)])
    yield row[keep], i[keep], np.zeros(int(keep.sum()), np.uint32), 1
    for taken, base, last in ((1, before[:, -1:] - total, size), (0, before + right, size + 1)):
        step = max(1, AT_ONCE // (rows * len(alphabet)))
        for start in range(0, last, step):
            end = min(last, start + step)
            put = mixed(alphabet[None, :], np.arange(start, end)[:, None])
            at = known.passing(base[:, start:end, None] + put[None])
            row, i, a = np.unravel_index(at, (rows, end - start, len(alphabet)))
            i = i + start
            keep = (i == size) | (letters[row, np.minimum(i, size - 1)] != alphabet[a])
            yield row[keep], i[keep], alphabet[a[keep]], taken


def candidates(words: DataFrame, alphabet: np.ndarray, shared: Broadcast[WordFilter]) -> DataFrame:
    """word, near: neighbours that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[str], list[str]] = ([], [])

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in held], ["word", "near"])
            for x in held:
                x.clear()
            return out

        for batch in batches:
            given = batch.column("word").to_pylist()
            for at, letters in by_length(given):
                step = max(1, AT_ONCE // (letters.shape[1] * len(alphabet)))
                for start in range(0, len(at), step):
                    for found in neighbours(letters[start : start + step], alphabet, shared.value):
                        *columns, taken = found
                        for row, i, letter in zip(*(c.tolist() for c in columns)):
                            word = given[at[start + row]]
                            held[0].append(word)
                            held[1].append(word[:i] + (chr(letter) if letter else "") + word[i + taken :])
                            if len(held[0]) >= ROWS or len(word) > ROWS:
                                yield sent()
        yield sent()

    return words.select("word").mapInArrow(run, "word string, near string")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word, root for each (word, form); most: the greatest count of a word.

    Every step is to a word FACTOR times as frequent, so the number of steps is
    bounded by the counts; each round doubles the steps taken.
    """
    steps = max(1, math.floor(math.log(max(1, most / LEAST_COUNT), FACTOR) + 1e-9))
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range((steps - 1).bit_length()):
        now = common.written(now, "roots")
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return now


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    words = common.written(vocabulary(docs), "vocabulary")
    count, most = words.agg(F.count("*"), F.max("n")).first()
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter != ''").distinct().collect()
    alphabet = np.array(sorted(ord(r["letter"]) for r in letters), np.uint32)
    found = None
    for known in filters(words, count):
        shared = docs.sparkSession.sparkContext.broadcast(known)
        part = candidates(words, alphabet, shared)
        if count > SLICE_WORDS:
            # one filter at a time
            part = common.written(part, "neighbours")
            shared.destroy()
        found = part if found is None else found.union(part)
    if found is None:
        found = words.select("word", F.col("word").alias("near")).limit(0)
    near = found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    often = -F.col("best.less") >= FACTOR * F.col("n")
    facts = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")
    )
    facts = common.written(facts, "word-forms")
    rooted = facts.join(roots(facts.where("form is not null"), most or 1), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH RECURSIVE runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r AS key, r, count(*) AS k
    FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r
        FROM documents
    )
    WHERE length(r) >= 7 GROUP BY ALL
), bytes AS (
    SELECT r, k, hex(encode(key)) AS x, octet_length(encode(key)) AS size FROM runs
), hashed AS (
    SELECT r, k, xor(list_reduce(
        list_transform(range(0, 8 * size), lambda j: (CAST('0x' || substr(x, CAST(2 * (j // 8) + 1 AS INTEGER), 2) AS BIGINT) >> (j % 8)) & 1),
        lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), CAST(4294967295 AS BIGINT)), 4294967295) AS h
    FROM bytes
), made AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, CAST(h % length(r) AS INTEGER)) || substr(r, CAST(h % length(r) + 2 AS INTEGER)) ELSE r END AS word, k FROM hashed
), words AS (
    SELECT word, CAST(sum(k) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), cut AS (
    SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) t(i)
), holes AS (
    SELECT word, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS hole FROM words, unnest(range(1, length(word) + 1)) t(i)
), near AS (
    SELECT a.word, b.word AS near FROM holes a JOIN holes b ON a.hole = b.hole AND a.word != b.word
    UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM words)
    UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM words)
), ranked AS (
    SELECT near.word, near.near, w.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near,
        row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, encode(near.near)) AS place
    FROM near JOIN words w ON w.word = near.near
), facts AS (
    SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 10 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 10 * w.n THEN r.near_n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), steps AS (
    SELECT word, word AS at FROM facts
    UNION ALL SELECT s.word, f.form FROM steps s JOIN facts f ON f.word = s.at WHERE f.form IS NOT NULL
), ends AS (
    SELECT s.word, s.at AS root FROM steps s JOIN facts f ON f.word = s.at WHERE f.form IS NULL
)
SELECT f.word, f.form, e.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM facts f JOIN ends e ON e.word = f.word
"""
