"""Clusters of near copies larger than one task may search, against all pairs and in rows a member."""

import random

from scoreloom.llm import common, near_dedup


def cluster(rng, n, edits, page=120):
    """n copies of one page with 1 to so many words replaced."""
    first, out = [f"w{rng.randrange(5000)}" for _ in range(page)], []
    for _ in range(n):
        copy = list(first)
        for _ in range(rng.randint(1, edits)):
            copy[rng.randrange(page)] = f"n{rng.randrange(10**7)}"
        out.append(" ".join(copy))
    return out


def shingles(text):
    w = text.split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def least_of_components(texts):
    """First row of each component, by brute force over all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                i_, j_ = find(i), find(j)
                root[max(i_, j_)] = min(i_, j_)
    return sorted({find(i) for i in range(len(texts))})


def test_clusters_over_the_cap(spark):
    """Copies that only a chain of others links, two pages that share most words, rows linked to none."""
    rng = random.Random(7)
    texts = cluster(rng, 150, 5)
    near = texts[0].split()
    for i in range(0, 60, 4):
        near[i] = f"other{i}"
    for _ in range(80):
        copy = list(near)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(120)] = f"n{rng.randrange(10**7)}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    want = least_of_components(texts)
    assert 5 < len(want) < 150
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    kept = near_dedup.keep_one(docs, shingle=5, cap=12, similarity=near_dedup.SIMILARITY)
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_rows_a_member(spark):
    """What a cluster of linked copies writes grows with its rows, not with their pairs (rows that link to nothing may cost pairs of chunks)."""
    rng, asked = random.Random(8), {}
    for n in (400, 1600):
        rows = [(i, t) for i, t in enumerate(cluster(rng, n, 4, 300))]
        key = spark.createDataFrame(rows, "fp bigint, text string")
        make = lambda: lambda text: (near_dedup.np.unique(near_dedup.shingle_hashes(text, 5)).tobytes(),)
        sets = common.written(common.map_rows(key, ["fp"], make, "shingles binary"), "test-sets")
        hot = key.select("fp").selectExpr("1L AS g", "fp", "296L AS size", "1L AS central")
        left, far = near_dedup.star_rounds(hot, sets, 50, near_dedup.SIMILARITY)
        asked[n] = left.count() + far.count()
    assert asked[1600] <= 5 * asked[400] and asked[1600] <= 8 * 1600


def test_sets_are_sent_a_few_times(spark, monkeypatch):
    """A row is in dozens of groups, of which no two have the same rows; it is searched once, or 8 times in a cluster of up to 9 chunks."""
    rng, sent = random.Random(9), []
    texts = cluster(rng, 40, 4) + cluster(rng, 260, 9)
    search = near_dedup.searched

    def counted(rows, *rest):
        sent.append(rows.count())
        return search(rows, *rest)

    monkeypatch.setattr(near_dedup, "searched", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    kept = near_dedup.keep_one(docs, shingle=5, cap=50, similarity=near_dedup.SIMILARITY)
    want = least_of_components(texts)
    assert 5 < len(want) < 260
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert 40 <= sum(sent) <= 40 + 8 * 260


def test_joined_buckets_are_left(spark):
    """Buckets whose rows are in one component already aren't searched again."""
    rows = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12), (3, 20), (3, 21)], "g bigint, fp bigint")
    roots = spark.createDataFrame([(11, 10), (21, 19), (20, 19)], "u bigint, v bigint")
    assert sorted(map(tuple, near_dedup.unjoined(rows, roots).collect())) == [(2, 10), (2, 12)]
