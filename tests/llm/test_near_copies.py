"""The pipeline's near-copies: five-word shingles of a Jaccard similarity of at least 0.8."""

import numpy as np

import corpus_pipeline
from auditweave.llm import near_copies, simhash

from .test_operators import EXTRA, plain_components, plain_fingerprint


def plain_shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return bool(a) and 5 * len(a & b) >= 4 * len(a | b)


def edited(r, words, edits):
    out = list(words)
    for k in r.choice(len(words), edits, replace=False):
        out[k] = f"edit{r.integers(1 << 30)}"
    return out


def test_stage_drops_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 5)
    r = np.random.default_rng(3)
    texts = []
    for k in range(12):
        words = [f"w{r.integers(3000)}" for _ in range(220)]
        texts += [" ".join(edited(r, words, e)) for e in (0, 2, 3, 5, 12)[: 2 + k % 4]]
    hub = [f"h{r.integers(3000)}" for _ in range(200)]
    texts += [" ".join(edited(r, hub, 3)) for _ in range(20)] + [" ".join(hub)]
    texts += ["", None, "one", "two words", "one", "a b c d e"]
    docs = spark.createDataFrame([(i, t, "k", 1, "z", "n") for i, t in enumerate(texts)], EXTRA)
    sets, fps = [plain_shingles(t or "") for t in texts], [plain_fingerprint(t or "") for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    by_bits = [p for p in pairs if (fps[p[0]] ^ fps[p[1]]).bit_count() <= 4]
    near = [p for p in pairs if similar(sets[p[0]], sets[p[1]])]
    assert len(set(near) - set(by_bits)) > 20
    got = sorted(x.doc_id for x in corpus_pipeline.simhash_stage(spark, docs, "").collect())
    assert got == sorted(set(plain_components(list(range(len(texts))), by_bits + near).values()))
    assert sorted(x.doc_id for x in simhash.keep_one(docs).collect()) == sorted(set(plain_components(list(range(len(texts))), by_bits).values()))


def test_near_sets_are_exact():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 9000).astype(np.uint64)
    sets = [np.unique(base[: 9000 - 300 * k]) for k in range(12)] + [np.unique(base[:80]), np.unique(base[:100]), np.unique(base[:79])]
    want = [[similar(set(a.tolist()), set(b.tolist())) for b in sets] for a in sets]
    assert near_copies.near_sets(sets).tolist() == want
