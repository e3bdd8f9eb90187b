"""The pipeline's stages over the smallest tables and over odd rows."""

import os

import duckdb
import pytest

import corpus_pipeline
from scoreloom.llm import catalog

from .test_operators import EXTRA, SF, odd_rows


def test_run(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = documents
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == documents.columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0.6 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_against_plain_stages(spark):
    """All stages in a row against plain Python over all pairs of documents."""
    import re

    import numpy as np
    import public_tokenizers as P
    import tiktoken

    from scoreloom.llm import bpe, packing, quality_model, secret_scan

    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_model.train(documents, labels)
    texts = {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
    score = model.score(np.array([quality_model.features(t) for t in texts.values()]))
    texts = {d: t for (d, t), s in zip(texts.items(), score) if s >= 0.5}
    best = {}
    for d, t in texts.items():
        key = re.sub("[\\x20\\x09-\\x0D]", "", t)
        best[key] = min(best.get(key, (1, 0)), (-len(t), d))
    texts = {d: texts[d] for _, d in best.values()}
    sets = {}
    for d, t in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()
        sets[d] = {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())
    root = {d: d for d in sets}
    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[:i]:
            if sets[x] == sets[y] or 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                low, high = sorted((root[x], root[y]))
                root = {d: low if r == high else r for d, r in root.items()}
    texts = {d: t for d, t in texts.items() if root[d] == d}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for r in secret_scan.scan(frame).collect():
        out, at = [], 0
        for start, end in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in r.spans.split(",") if x)):
            if start >= at:
                out.append(texts[r.doc_id][at:start] + "<SECRET>")
            at = max(at, end)
        texts[r.doc_id] = "".join(out) + texts[r.doc_id][at:]
    ranks = bpe.ranks_from(P.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = {}
    for d, t in texts.items():
        n = len(plain(t)) + 1
        want |= {(d, k): min(packing.CAPACITIES[-1], n - k * packing.CAPACITIES[-1]) for k in range(-(-n // packing.CAPACITIES[-1]))}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): r.size for r in rows} == want and len(rows) == len(want)
    sizes = sorted(want.values(), reverse=True)
    used = np.bincount(packing.pack(np.array(sizes))[0], sizes)
    assert sorted({(r.group, r.bin): r.used for r in rows}.values()) == sorted(used.tolist())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, stage):
    odd = spark.createDataFrame([(*r, *[None] * 12) for r in odd_rows()], f"doc_id bigint, text string, {EXTRA}")
    assert stage(spark, odd, SF).count() > 0
    assert stage(spark, odd.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = catalog.QUERIES[name](spark, SF)
    cursor = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda rows: sorted((tuple(r[c] for c in sorted(columns)) for r in rows), key=str)
    assert key(got.collect()) == key([dict(zip(columns, r)) for r in cursor.fetchall()])
