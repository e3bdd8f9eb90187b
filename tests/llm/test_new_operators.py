"""Toxicity, prefix tries and spelling variants against plain versions, over odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from scoreloom.llm import prefix_trie, spelling, toxicity

SF = "/root/testdata/sf0.01"


def table(rows):
    return sorted((tuple(r) for r in rows.collect()), key=str)


# -- spelling variants


def plain_variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, n_near = {}, {}
    for w, n in words.items():
        found = [v for v in words if near(w, v)]
        n_near[w] = len(found)
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def spelled_rows():
    rng = random.Random(7)
    bases = ["Überraschung", "misspelling", "aaaaaaaa", "×÷×÷×÷×÷", "ÀÉÎÕÜßÿÀ", "conversation", "x" * 900]
    text = []
    for b in bases:
        text += [b] * 240
        for _ in range(12):
            i, v = rng.randrange(len(b)), b
            v = rng.choice([v[:i] + v[i + 1 :], v[:i] + rng.choice("aeéxß") + v[i + 1 :], v[:i] + rng.choice("aeéxß") + v[i:]])
            text += [v] * rng.choice([2, 3, 20, 22])
            j = rng.randrange(len(v))
            text += [v[:j] + "q" + v[j:]] * 2
    rng.shuffle(text)
    rows = [(i, rng.choice([" ", "-", "1", "\n"]).join(text[i::9])) for i in range(9)]
    return rows + [(None, "Überraschung misspelling nulltext nulltext"), (20, None), (21, ""), (22, "short"), (23, "y" * 20_000 + " " + "y" * 20_000), (9, rows[3][1])]


@pytest.mark.parametrize("small", [False, True])
def test_spelling(spark, monkeypatch, small):
    if small:
        for name, value in (("PIECE", 50), ("HELD", 3), ("SLICE_WORDS", 20), ("AT_ONCE", 64), ("ROWS", 5), ("PART_BITS", 4096)):
            monkeypatch.setattr(spelling, name, value)
    rows = spelled_rows() if not small else [r for r in spelled_rows() if r[0] != 23]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id bigint, text string, n bigint, word string").repartition(3)
    want = plain_variants(rows)
    assert table(spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n")) == want
    assert any(w[1] and w[2] != w[1] for w in want), "some form has a form itself"
    assert table(spelling.variants(docs.limit(0))) == []


def test_all_neighbours_are_generated_once():
    """The generated neighbours of a word, with nothing filtered, are its full neighbourhood, each once."""

    class All:
        def passing(self, number):
            return np.arange(number.size)

    alphabet = "abc"
    for word in ("abcabca", "aaaaaaa", "aabbccc"):
        letters = np.array([[ord(c) for c in word]], np.uint32)
        got = []
        for row, at, put, taken in spelling.neighbours(letters, np.array([ord(c) for c in alphabet], np.uint32), All()):
            got += [word[:i] + (chr(x) if x else "") + word[i + taken :] for i, x in zip(at.tolist(), put.tolist())]
        cut = {word[:i] + word[i + 1 :] for i in range(len(word))}
        put = {word[:i] + a + word[i:] for i in range(len(word) + 1) for a in alphabet}
        changed = {word[:i] + a + word[i + 1 :] for i in range(len(word)) for a in alphabet} - {word}
        assert sorted(got) == sorted(cut | put | changed)


# -- prefix tries


def plain_nodes(rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            turns[conv_id].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode().split()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if built[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversation_rows():
    rng = random.Random(11)
    texts = ["hello", "a b c", "", None, "x\x1cy z", "line\nbreak é", "same words here"]
    rows = []
    for c in [*range(-25, 90), 10**12, 10**12 + 1]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 7])):
            rows.append((c, rng.choice([t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(texts[:3] if t < 2 else texts)))
    for c in range(200, 290):  # one conversation in many copies
        rows += [(c, t, "user", f"turn {t}") for t in range(6)]
    rows += [(300, t, "user", "deep") for t in range(400)] + [(301, t, "user", "deep") for t in range(390)]
    rows += [(301, 5, "user", "deep"), (None, 1, "user", "x"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def test_prefix_trie(spark):
    rows = conversation_rows()
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    given = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth bigint, `key` string").repartition(5)
    want = plain_nodes(rows)
    for heavy, forest in ((None, prefix_trie.FOREST), (1, 1), (3, 40)):
        assert table(prefix_trie.nodes_of(given, heavy, forest).select(columns)) == want
    assert prefix_trie.nodes_of(given.limit(0)).collect() == []
    nobody = spark.createDataFrame([(None, 1, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.nodes_of(nobody).collect() == []


def test_louds_bits():
    """Two trees: a(b, c(d)) and e."""
    key = np.array([[5, 0], [1, 0], [2, 0], [3, 0], [4, 0]])  # e a b c d
    parent = np.array([[0, 0], [0, 0], [1, 0], [1, 0], [3, 0]])
    tree = prefix_trie.Louds(np.array([0, 0, 1, 1, 2]), key, parent)
    assert tree.labels.tolist() == [1, 5, 2, 3, 4]
    assert "".join("01"[int(b)] for b in tree.bits) == "110" + "110" + "0" + "0" + "10" + "0"
    assert tree.parents().tolist() == [0, 0, 1, 1, 4]
    assert tree.children().tolist() == [2, 2, 0, 0, 1, 0]
    assert tree.rolled(np.ones((5, 1), int)).ravel().tolist() == [4, 1, 1, 2, 1]


# -- toxicity


def test_buckets_of_pieces(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abc é\n😀ÜX") for _ in range(3000))
    whole = toxicity.buckets_of(text)
    monkeypatch.setattr(toxicity, "PIECE", 64)
    assert toxicity.buckets_of(text).tolist() == whole.tolist()
    assert toxicity.buckets_of("AB\tc").tolist() == toxicity.buckets_of("ab c").tolist()
    assert [len(toxicity.buckets_of(t)) for t in ("", "ab", "abc", "abcd")] == [0, 0, 1, 3]


def test_ratios():
    """By hand: 3 of 4 toxic rows and 1 of 8 others have the bucket."""
    got = toxicity.ratios(np.array([3.0, 0.0]), np.array([1.0, 0.0]), 4, 8)
    assert np.allclose(got, [np.log((4 / 6) / (2 / 10)), np.log((1 / 6) / (1 / 10))])


def test_toxicity_held_out(spark):
    """On labelled rows that were not fitted: texts with insults are found, labels of clean ones kept."""
    docs, labels = (spark.read.parquet(f"{SF.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.op11_toxicity(spark, SF.replace("0.01", "0.1")).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").toPandas()
    clean, toxic = found[found.toxic == 0], found[found.toxic == 1]
    assert len(toxic) > 50 and (clean.predicted == 0).mean() > 0.99
    # the rest of the toxic labels are on texts without any of the words that toxic texts have
    assert (toxic.predicted == 1).mean() > 0.5
    order = found.score.rank()
    auc = (order[found.toxic == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean))
    assert auc > 0.75


def test_toxicity_odd_rows(spark):
    rng = random.Random(2)
    words = [f"w{i}ord" for i in range(60)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, some(30) + (" you idiot moron" if i % 3 == 0 else "")) for i in range(300)]
    odd = [(None, None), (None, "idiot"), (900, ""), (901, None), (902, "x"), (903, some(40_000)), (904, "IDIOT\tMoron you idiot moron"), (5, "other text of a known id"), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, 0.5, 1, "k") for r in rows + odd], "doc_id bigint, text string, score double, toxic int, bucket string").repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(None, 1, 1), (7, 0, None), (8, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = toxicity.classify(docs, toxicity.train(docs, labels))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == len(rows + odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in found if r.doc_id is not None and r.doc_id < 300 and r.doc_id != 5)
    assert {r.predicted for r in found if r.doc_id == 904} == {1} and {r.predicted for r in found if r.doc_id == 903} == {0}
    same = toxicity.classify(docs, toxicity.train(docs.repartition(7), labels.repartition(2)))
    assert np.allclose([r[2] for r in table(got)], [r[2] for r in table(same)], atol=1e-9)
    assert {r.score for r in toxicity.classify(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.5}
    assert {r.predicted for r in toxicity.classify(docs, toxicity.train(docs, labels.where("toxic = 1"))).collect()} == {1}
    assert toxicity.classify(docs.limit(0), toxicity.train(docs.limit(0), labels)).collect() == []
