"""Operator 5: secret scans with a randomness test battery, in SQL expressions only.

Base spans come from three expressions. The method adds runs of key characters
that look drawn at random. For each run an encoding is inferred (hex, base32,
one case with digits, base64) and three tests are made:

* chi-squared against a uniform alphabet: lower than ordinary text of that
  length would give;
* runs: the words that a reader would see (a separator, a capital, small
  letters; capitals; digits): more than ordinary names of that length have;
* lag-one serial correlation: what goes beyond a random string's counts against
  the run, so that ramps and counting sequences fall.

The null is "a name made of ordinary words": its letters and word length are
those of the table that is scanned (27 sums; PRIOR letters of common prose count
besides). The tests are put together (Stouffer, for tests that agree a little)
into a p-value, sharper with length by the formulas. False discoveries are held
under FDR within each stratum of encoding and length by Benjamini and Hochberg's
rule over counts of p-values in bins: at most STRATA * BINS rows come to the
driver, at any input size.

Nothing here is quadratic in the matches of a text: running sums are made in
log2(n) rounds over the whole array, overlaps are counted in sorted events, and
pieces are cut from blocks of bounded length.

Rows: null text counts as empty and has no spans; repeated rows are scanned
each on their own; an empty table gives an empty result; columns other than
doc_id and text are read by redact() alone, which hands them through, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The base expressions, in the order of the kinds; least characters, and of which group.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
#: What must be in a text for a base expression to match at all with enough characters; cheaper to look for.
NEEDS = {"assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]""", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Expressions whose matches are those of the above with enough characters (the runs are maximal).
EXACT = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
KEY = r"[A-Za-z0-9+/_-]{20,}={0,2}"
WORD = "[^A-Za-z0-9]?(?:[A-Z]?[a-z]+|[A-Z]+)|[0-9]+|[^A-Za-z0-9]"
FDR = 0.02
BINS, WIDTH = 400, 0.1
LENGTHS = (20, 28, 40, 56, 80)
#: Inferred encodings: expression and alphabet size, the first that fits.
ENCODINGS = (("^([0-9a-f]+|[0-9A-F]+)$", 16), ("^[A-Z2-7]+$", 32), ("^([a-z0-9]+|[A-Z0-9]+)$", 36), ("", 64))
STRATA = len(ENCODINGS) * (len(LENGTHS) + 1)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Common prose: sum of the squared shares of letters, letters in a word; and the letters that it counts for.
SQUARES, LENGTH, PRIOR = 0.066, 4.7, 10_000
#: Ordinary strings without word edges: share of word starts, in hex and in one case; excess of chi-squared in hex.
FLAT_HEX, FLAT, EXCESS_HEX = 0.12, 0.08, 0.9
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
BLOCK = 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sum, or maximum, of an array of whole numbers: rounds of doubling reach."""
    powers = F.array(*[F.lit(1 << k) for k in range(31)])

    def reach(done: Column, jump: Column) -> Column:
        return F.zip_with(done, F.slice(F.concat(F.array_repeat(F.lit(0), jump), done), F.lit(1), F.size(done)), join)

    return _let(values, lambda v: F.aggregate(F.filter(powers, lambda x: x < F.size(v)), v, reach))


def _sum(a: Column, b: Column) -> Column:
    return a + b


# spans


def _places(text: Column, pattern: str, group: int, least: int, token: bool = False) -> Column:
    """Array of (start, end), and the token, of matches whose group has at least `least` characters."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(hits, F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    own = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else sizes
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes, _sum)
    spans = F.arrays_zip(running(steps, _sum).alias("end"), sizes.alias("size"), own.alias("own"), *([hits.alias("token")] if token else []))
    kept = F.filter(spans, lambda s: s["own"] >= least)
    return F.transform(kept, lambda s: F.struct((s["end"] - s["size"]).alias("start"), s["end"].alias("end"), *([s["token"].alias("token")] if token else [])))


def _named(places: Column, rank: int, kind: str) -> Column:
    return F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Array of (start, rank, kind, end), sorted."""
    every = []
    for i, (kind, pattern, group, least) in enumerate(KINDS):
        found = F.when(text.rlike(NEEDS[kind]), _places(text, EXACT.get(kind, pattern), 0 if kind in EXACT else group, least)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        every.append(_named(found, i, kind))
    return F.array_sort(F.concat(*every))


def _before(events: Column, queries: Column) -> Column:
    """For each query how many events sort before it. Both: arrays of (at, tie)."""
    marked = F.concat(F.transform(events, lambda e: F.struct(e["at"].alias("at"), e["tie"].alias("tie"), F.lit(1).alias("n"))), F.transform(queries, lambda q: F.struct(q["at"].alias("at"), q["tie"].alias("tie"), F.lit(0).alias("n"))))

    def counted(both: Column) -> Column:
        pairs = F.arrays_zip(running(F.transform(both, lambda e: e["n"]), _sum).alias("sum"), F.transform(both, lambda e: e["n"]).alias("n"))
        return F.transform(F.filter(pairs, lambda p: p["n"] == 0), lambda p: p["sum"])

    return _let(F.array_sort(marked), counted)


def _at(spans: Column, place: str, tie: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s[place].alias("at"), F.lit(tie).alias("tie")))


def free(places: Column, base: Column) -> Column:
    """The places that no base span overlaps: as many base spans end before one as begin before its end."""
    begun, ended = _before(_at(base, "start", 1), _at(places, "end", 0)), _before(_at(base, "end", 0), _at(places, "start", 1))
    pairs = F.arrays_zip(places.alias("p"), begun.alias("begun"), ended.alias("ended"))
    return F.when((F.size(places) == 0) | (F.size(base) == 0), places).otherwise(F.transform(F.filter(pairs, lambda x: x["begun"] == x["ended"]), lambda x: x["p"]))


# tests


def _tests(x: Column) -> Column:
    """x: (start, end, token). The token's length, alphabet size, chi-squared sum, words after the first, lag-one correlation."""
    places = F.array(*[F.lit(float({"-": 62, "_": 63}.get(c, i))) for i, c in enumerate(ALPHABET)])

    def measured(token: Column) -> Column:
        n = F.length(token)
        size = F.when(token.rlike(ENCODINGS[0][0]), ENCODINGS[0][1])
        for pattern, k in ENCODINGS[1:-1]:
            size = size.when(token.rlike(pattern), k)
        size = size.otherwise(ENCODINGS[-1][1])
        counts = F.transform(F.array(*map(F.lit, ALPHABET)), lambda c: (n - F.length(F.replace(token, c, F.lit("")))).cast("double"))

        def with_counts(count: Column) -> Column:
            total = lambda values: F.aggregate(values, F.lit(0.0), _sum)
            chi = size / n * total(F.transform(count, lambda v: v * v)) - n
            mean = total(F.zip_with(count, places, lambda v, p: v * p)) / n

            def with_mean(m: Column) -> Column:
                spread = total(F.zip_with(count, places, lambda v, p: v * (p - m) * (p - m)))
                place = lambda c: F.instr(F.lit(ALPHABET[:64]), F.translate(c, "-_", "+/")).cast("double") - 1 - m
                lagged = lambda v: total(F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: a * b))
                blocks = F.regexp_extract_all(token, F.lit(f".{{2,{BLOCK}}}"), F.lit(0))
                lag = F.aggregate(blocks, F.lit(0.0), lambda a, b: a + _let(F.transform(F.split(b, ""), place), lagged))
                return F.struct(n.alias("n"), size.alias("k"), chi.alias("chi"), (F.regexp_count(token, F.lit(WORD)) - 1).alias("words"), F.when(spread > 0, lag / spread).otherwise(F.lit(1.0)).alias("serial"))

            return _let(mean, with_mean)

        return _let(counts, with_counts)

    return F.struct(x["start"].alias("start"), x["end"].alias("end"), _let(F.rtrim(x["token"], F.lit("=")), measured).alias("t"))


def candidates(text: Column, base: Column) -> Column:
    """Array of (start, end, t) of key-like runs outside the base spans."""
    places = F.when(text.rlike(KEY), _places(text, KEY, 0, 20, True)).otherwise(F.array().cast("array<struct<start:int,end:int,token:string>>"))
    return F.transform(_let(places, lambda p: free(p, base)), _tests)


def letter_sums(text: Column) -> Column:
    """Array of how often each letter stands in the text, in either case, and of its blanks and lines."""
    lower = F.translate(text, LETTERS.upper(), LETTERS)
    count = lambda t, c: (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("bigint")
    return _let(lower, lambda t: F.array(*[count(t, c) for c in LETTERS], F.length(t) - F.length(F.translate(t, " \n", "")) + 1))


def scanned(docs: DataFrame, base: str, keys: str, sums: str) -> DataFrame:
    """docs, with base spans, candidates and letter sums in columns of these names."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn(base, base_spans(text)).withColumn(keys, candidates(text, F.col(base))).withColumn(sums, letter_sums(text))


def null_of(found: DataFrame, sums: str) -> tuple[float, float]:
    """Of ordinary words in the table: sum of the squared shares of letters, and letters in a word."""
    *letters, words = [x or 0 for x in found.agg(*[F.sum(F.get(sums, F.lit(i))) for i in range(len(LETTERS) + 1)]).first()]
    n = sum(letters)
    squares = sum(x * x for x in letters) / n if n else 0.0
    length = n / words if words else 0.0
    share = n / (n + PRIOR)
    mixed = share * squares / max(n, 1) + (1 - share) * SQUARES, share * length + (1 - share) * LENGTH
    return min(max(mixed[0], 0.05), 0.12), min(max(mixed[1], 3.0), 12.0)


def judged(x: Column, null: tuple[float, float]) -> Column:
    """(start, end, stratum, slot): the bin of the p-value, -1 for one of a half and more. x: as from candidates()."""
    squares, length = null
    inside, edge = length / (length + 1), 1 / (length + 1)
    named = 64 * (inside**2 * squares + edge**2 * (1 + squares) / 2) - 1
    t = x["t"]
    n, k = t["n"].cast("double"), t["k"]
    excess = F.when(k == 16, EXCESS_HEX).when(k == 64, named).otherwise(k * squares - 1)
    share = F.when(k == 16, FLAT_HEX).when(k == 64, edge).otherwise(FLAT)
    # 1.3: names of one length differ more than draws of letters do; 2.4: variance of the sum of two z that agree a little
    chi_z = (k - 1 + n * excess - t["chi"]) / (1.3 * F.sqrt(2.0 * (k - 1) + 4 * n * excess))
    words_z = (t["words"] - (n - 1) * share) / F.sqrt((n - 1) * share * (1 - share))
    z = (chi_z + words_z) / math.sqrt(2.4) + F.least(F.lit(0.0), 3 - F.abs(t["serial"]) * F.sqrt(n))

    def binned(z: Column) -> Column:
        # -log10 of the upper tail of the normal distribution, by a closed form that is good for any z > 0
        tail = -(-z * z / 2 + F.log(1 - F.exp(-1.4 * z)) - F.log(1.135 * math.sqrt(2 * math.pi) * z)) / math.log(10)
        return F.when(z > 0.3, F.least(F.lit(BINS - 1), F.floor(tail / WIDTH).cast("int"))).otherwise(-1)

    kind = F.when(k == 16, 0).when(k == 32, 1).when(k == 36, 2).otherwise(3)
    stratum = kind * (len(LENGTHS) + 1) + F.size(F.filter(F.array(*map(F.lit, LENGTHS)), lambda v: v <= t["n"]))
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), stratum.alias("stratum"), _let(z, binned).alias("slot"))


def thresholds(found: DataFrame, keys: str, rate: float = FDR) -> dict[int, int]:
    """Least bin that is a discovery, by stratum. found: with judged() keys."""
    bins = found.select(F.explode(keys).alias("k")).groupBy("k.stratum", "k.slot").agg(F.count(F.lit(1)).alias("n")).collect()
    out: dict[int, int] = {}
    for stratum in {r["stratum"] for r in bins}:
        counts = {r["slot"]: r["n"] for r in bins if r["stratum"] == stratum}
        total, above = sum(counts.values()), 0
        for slot in sorted((s for s in counts if s >= 0), reverse=True):
            above += counts[slot]
            if 10 ** (-slot * WIDTH) <= rate * above / total:
                out[stratum] = slot
    return out


def with_spans(docs: DataFrame, every: str, base: str, *drop: str) -> DataFrame:
    """docs less the columns to drop, with base spans, and with base and added spans, as sorted arrays of (start, rank, kind, end)."""
    keys, sums = common.free_names([*docs.columns, every, base], "keys", "sums")
    found = common.written(scanned(docs, base, keys, sums).drop(*drop), "secret-scan")
    null = null_of(found, sums)
    found = found.withColumn(keys, F.transform(keys, lambda x: judged(x, null))).drop(sums)
    least = thresholds(found, keys)
    if not least:
        return found.withColumn(every, F.col(base)).drop(keys)
    cut = F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair])
    added = F.filter(keys, lambda k: (k["slot"] >= 0) & F.coalesce(k["slot"] >= F.try_element_at(cut, k["stratum"]), F.lit(False)))
    return found.withColumn(every, F.array_sort(F.concat(base, _named(added, len(KINDS), "random")))).drop(keys)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = with_spans(docs.select("doc_id", "text"), "every", "base", "text")
    size = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *[size("base", k[0]).alias(f"n_{k[0]}") for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"), size("every", "random").alias("n_random"))


def _without(text: Column, spans: Column, mark: str) -> Column:
    """The text with each span, overlapping ones as one, replaced by the mark."""

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        head = F.substring(F.coalesce(F.get(blocks, i), F.lit("")), a % BLOCK + 1, F.lit(BLOCK))
        last = F.substring(F.coalesce(F.get(blocks, j), F.lit("")), F.lit(1), b % BLOCK)
        inner = F.array_join(F.slice(blocks, i + 2, F.greatest(F.lit(0), j - i - 1)), "")
        return F.when(i == j, F.substring(F.coalesce(F.get(blocks, i), F.lit("")), a % BLOCK + 1, b - a)).otherwise(F.concat(head, inner, last))

    def pieces(blocks: Column, reach: Column) -> Column:
        edges = F.zip_with(spans, F.slice(F.concat(F.array(F.lit(0)), reach), F.lit(1), F.size(reach)), lambda s, at: F.struct(at.alias("a"), s["start"].alias("b")))
        parts = F.transform(edges, lambda e: F.when(e["b"] >= e["a"], F.concat(piece(blocks, e["a"], e["b"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), piece(blocks, F.element_at(reach, -1), F.length(text)))

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return _let(cut, lambda blocks: _let(reach, lambda r: pieces(blocks, r)))


def redact(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """docs with every span replaced by `mark`, overlapping ones as one; n_chars follows where there is one."""
    names = docs.columns
    every, base, clean = common.free_names(names, "every", "base", "clean")
    found = with_spans(docs, every, base)
    hit = F.size(every) > 0
    out = found.withColumn(clean, F.when(hit, _without(F.col("text"), F.col(every), mark)).otherwise(F.col("text")))
    changed = {"text": F.col(clean)}
    if "n_chars" in names:
        changed["n_chars"] = F.when(hit, F.length(clean).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return out.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in names])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
