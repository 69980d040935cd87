"""Neighbours in a dense group of a table well above the sample."""

from collections import defaultdict

import numpy as np

from auditweave.llm import ann, common


def test_dense_group_above_the_sample(spark, monkeypatch):
    common.findable(spark)
    monkeypatch.setattr(ann, "SAMPLE", 400)
    r = np.random.default_rng(9)
    n, dim = 24_000, 16
    x = r.normal(size=(n, dim))
    x[: n // 3] = r.normal(size=dim) + 0.03 * r.normal(size=(n // 3, dim))
    x = r.permutation(x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for row in ann.search(df, df.where("vec_id % 200 = 0")).collect():
        got[row.query_id].add(row.vec_id)
    hits = []
    for q in range(0, n, 200):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    hits = np.sort(hits)
    print("recall", np.mean(hits), "worst third", np.mean(hits[: len(hits) // 3]))
    assert np.mean(hits) >= 0.95 and np.mean(hits[: len(hits) // 3]) >= 0.85


def test_ids_that_repeat(spark):
    one, two = [1.0, 0.5, 0.0, 0.0], [0.9, 0.4, 0.1, 0.0]
    rows = [(20, one)] * 25 + [(21, one), (22, one), (23, one), (40, two), (40, two), (41, [0.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == {20: [21, 22, 23], 40: [20, 21, 22]}


def test_ties_at_the_last_place(spark, monkeypatch):
    """Many different vectors of one product, all looked up: the smaller ids are listed."""
    monkeypatch.setattr(ann, "CELLS", 1)
    r = np.random.default_rng(2)
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(i, [0.5, *map(float, r.integers(-3, 4, 3))]) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [x.vec_id for x in ann.search(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == list(range(1, 21))


def test_awkward_rows(spark):
    big = [1e300, 1e300]
    rows = [(None, [1.0, 2.0], "x"), (1, None, "x"), (2, [0.0, 0.0], None), (3, [float("nan"), 1.0], "x"), (4, [1.0], "x"), (5, big, "x"), (6, [1e299, 0.0], "x"), (7, [None, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.search(df, df).collect()
    assert {(x.query_id, x.vec_id) for x in got} == {(5, 6), (6, 5)}


def test_a_few_cells_are_looked_up(spark):
    """On 60,000 vectors in groups, a query meets under a tenth of the entries."""
    r = np.random.default_rng(4)
    centers = r.normal(size=(300, 32))
    x = centers[r.integers(300, size=60_000)] + 0.35 * r.normal(size=(60_000, 32))
    index = ann.Index(x[: ann.SAMPLE], len(x))
    cell, _ = index.encode(x[:20_000])
    sizes = np.bincount(cell, minlength=len(index.centroids))
    looked = index.cells(x[::100].astype(np.float32))
    assert (looked @ sizes).mean() < 0.1 * len(cell)
