"""Vector codes against plain Lloyd rounds in Python integers."""

import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from auditweave.llm import common, vector_codes as vc


@pytest.fixture(scope="module", autouse=True)
def found(spark):
    common.findable(spark)


def plain(rows, parts=vc.PARTS, entries=vc.ENTRIES, rounds=vc.ROUNDS):
    rows = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    w = -(-len(rows[0][1]) // parts)
    cut = [[tuple(([math.floor(256 * x) for x in r[1]] + [0] * parts * w)[p * w : p * w + w]) for p in range(parts)] for r in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            held = defaultdict(list)
            for c, n in zip(cut, near):
                held[n[p][1]].append(c[p])
            for k, got in held.items():
                books[p][k] = tuple(sum(col) // len(got) for col in zip(*got))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors, out = defaultdict(int), []
    for r, n in zip(rows, assign()):
        errors[r[2]] += sum(d for d, _ in n)
        out.append((r[0], "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), r[2]))
    return sorted((a, b, c, errors[l], digest) for a, b, c, l in out if a is not None) + sorted((b, c, errors[l], digest) for a, b, c, l in out if a is None)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "vec_id long, embedding array<double>, label int, code string, error long").repartition(3)
    df.createOrReplaceTempView("embeddings_test")
    import unittest.mock as m

    with m.patch.object(common, "table", lambda *a: df):
        got = vc.op12_vector_codes(spark, "").collect()
    return sorted(tuple(r) for r in got if r[0] is not None) + sorted(tuple(r)[1:] for r in got if r[0] is None)


def tables():
    r = np.random.default_rng(4)
    ties = [(k, [float(x) for x in r.integers(-3, 3, 16) / 64], int(k % 3) if k % 5 else None) for k in range(300)]
    normal = [(int(k), r.normal(size=32).tolist(), 1) for k in r.permutation(200)]
    odd = [(k, r.normal(size=20).tolist(), k % 2) for k in range(90)]  # 16 doesn't divide 20
    awkward = [*normal[:150], (None, normal[0][1], None), (None, normal[1][1], None), (5, normal[2][1], 7), (5, normal[2][1], 7), (900, None, 1), (901, [float("nan")] * 32, 1),
               (902, [None] * 32, 1), (903, [0.0] * 32, 1), (904, [float("inf")] + [0.0] * 31, 2), (905, [], 2), (906, [1.0] * 32, None)]
    return {"ties": ties, "normal": normal, "filled up": odd, "awkward": awkward, "few": normal[:5], "one": normal[:1], "none": [], "none kept": awkward[-7:-5]}


@pytest.mark.parametrize("name", list(tables()))
def test_rounds_are_plain(spark, name):
    assert run(spark, tables()[name]) == plain(tables()[name])


def test_sql():
    rows = tables()["ties"]
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [r[0] for r in rows], "embedding": [r[1] for r in rows], "label": [r[2] for r in rows]}))
    assert sorted(con.sql(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({vc.ORACLE_SQL})").fetchall()) == plain(rows)


def test_other_lengths_go(spark):
    rows = [(k, [float(k)] * 16, 1) for k in range(20)]
    assert run(spark, [*rows, (50, [1.0] * 17, 1)]) == plain(rows)


def test_bounds_spare_comparisons_and_change_nothing():
    r = np.random.default_rng(0)
    centres = r.integers(-200, 200, (40, 4))
    x = centres[r.integers(0, 40, 5000)] + r.integers(-3, 4, (5000, 4))
    book = x[:64].copy()
    state = vc.look(x, book)
    for k in range(4):
        new = book.copy()
        for e in range(64):
            if (state[0] == e).any():
                new[e] = x[state[0] == e].sum(0) // (state[0] == e).sum()
        *state, compared = vc.step(x, *state, book, new)
        d = ((x[:, None] - new) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        at = np.arange(len(x))
        assert (state[1].astype(float) ** 2 >= d[at, state[0]]).all()
        d[at, state[0]] = 1 << 40
        assert (state[2].astype(float) <= np.sqrt(d.min(1))).all()
        book = new
    assert compared < 5000 * 0.7


@pytest.mark.parametrize("size", [3, 1 << 20])
def test_whole_numbers(size):
    """Ties and large components are compared exactly."""
    r = np.random.default_rng(1)
    x, c = r.integers(-size, size, (200, 4)) * 5, r.integers(-size, size, (30, 4)) * 5
    assert (vc.squared(x, c) == ((x[:, None].astype(object) - c) ** 2).sum(2)).all()
    assert (vc.squared(x * 2**4, c) == ((x[:, None].astype(object) * 2**4 - c) ** 2).sum(2)).all()


def test_too_large_is_an_error():
    with pytest.raises(ValueError, match="beyond"):
        vc.integers(np.array([[1e30]]))
