"""Candidates of the pipeline's near dedup: wide SimHash, sampled bits, Gray index."""

import random

import numpy as np

from scoreloom.llm import near_dedup


def test_links_are_in_a_group(spark):
    """Every pair at 0.8 or over has a group in common, small sets too; in buckets over the cap as well."""
    rng = random.Random(5)
    texts = []
    for n in (8, 8, 8, 13, 19, 24, 60, 200):
        for _ in range(12):
            first = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            texts += [" ".join(first), " ".join([*first, "end"]), " ".join(first[max(1, n // 12) :])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    marked = near_dedup.shingle_sets(docs, ["doc_id"], 5).cache()
    of = {r.doc_id: (r.fp, set(near_dedup.shingle_hashes(texts[r.doc_id], 5).tolist())) for r in marked.collect()}
    linked = [(a, b) for a in of for b in range(a) if 5 * len(of[a][1] & of[b][1]) >= 4 * len(of[a][1] | of[b][1])]
    assert len(linked) > 100 and any(len(of[a][1]) == 5 for a, _ in linked)
    for cap in (near_dedup.CAP, 3):
        groups = {}
        for r in near_dedup.gray_groups(near_dedup.sampled_buckets(marked, len(texts)), cap).collect():
            groups.setdefault(r.fp, set()).add(r.g)
        assert all(of[a][0] == of[b][0] or groups.get(of[a][0], set()) & groups.get(of[b][0], set()) for a, b in linked)


def test_differing_bits():
    """Sets at 0.8 differ in FLIP of the bits at most, on average; others in half."""
    rng = np.random.default_rng(6)
    for both, own in ((4, (0, 1)), (8, (1, 1)), (8, (0, 2)), (12, (1, 2)), (12, (0, 3)), (120, (15, 15)), (120, (0, 30))):
        differ = []
        for _ in range(150):
            x = rng.integers(0, 1 << 63, both + sum(own), np.uint64)
            a, b = np.sort(x[: both + own[0]]), np.sort(np.concatenate([x[:both], x[both + own[0] :]]))
            differ.append(np.bitwise_count(near_dedup.wide_fingerprint(a) ^ near_dedup.wide_fingerprint(b)).sum() / (64 * (near_dedup.KEY_WORDS + near_dedup.CODE_WORDS)))
        assert np.mean(differ) < near_dedup.FLIP + 0.005
    apart = near_dedup.wide_fingerprint(np.sort(x)) ^ near_dedup.wide_fingerprint(rng.integers(0, 1 << 63, 150, np.uint64))
    assert 0.4 < np.bitwise_count(apart).sum() / 1216 < 0.6
