"""Ranked lexical search against a plain version."""

import math
import re
from collections import Counter
from unittest import mock

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from auditweave.llm import common, lexical

CUT = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module", autouse=True)
def found(spark):
    common.findable(spark)


def cut(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in CUT.findall(text or "")]


def plain(docs, items, k=10):
    held = [(i, d, cut(t)) for i, (d, t) in enumerate(docs)]
    held = [x for x in held if x[2]]
    n_docs, n_terms = len(held), sum(len(x[2]) for x in held)
    df = Counter(t for x in held for t in set(x[2]))
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(cut(text))
    out = []
    for item, own in asked.items():
        got = []
        for _, d, t in held:
            tf, m = Counter(t), 100 - 90 + (90 * len(t) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in own if tf[x])
            if score > 0:
                got.append((-score, d is None, d or 0))
        got.sort()
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(got[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, window=lexical.WINDOW):
    d = spark.createDataFrame([(*x, "k", 1) for x in docs], "doc_id long, text string, term string, n long").repartition(3)
    q = spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, score string").repartition(2)
    return sorted(map(tuple, lexical.search(d, q, window=window).collect()), key=repr)


def tables():
    r = np.random.default_rng(2)
    words = [f"w{k}" for k in range(60)] + ["É", "naïve", "日本", "x_y", "A-b", "ß", "İ", "\x85", "\xa0"]
    text = lambda n: " ".join(r.choice(words, n, p=np.arange(len(words), 0, -1) / sum(range(len(words) + 1))))
    some = [(int(k), text(int(r.integers(1, 40)))) for k in r.permutation(400) * 3 - 90]
    items = [(k, text(8)) for k in range(12)]
    return {
        "plain": (some, items),
        "awkward": (
            [*some[:50], (None, "w1 w1"), (None, "w1 w1"), (7, None), (8, ""), (9, " .,_\x00"), (10, "W1 w2"), (10, "W1 w2"), (11, "w3 " * 60_000 + "w4"), (2**62, "w5"), (-(2**62), "w5")],
            [(1, "w1 W1 w2"), (1, "w3"), (None, "w5"), (None, "w4"), (2, None), (3, ""), (4, "nowhere"), (5, "w1 " * 5000)],
        ),
        "ties": ([(k, "w1 w2 w3") for k in r.permutation(300).tolist()], [(0, "w1"), (1, "w2 w9")]),
        "one id": ([(5, f"w{k % 3}") for k in range(300)], [(0, "w1")]),
        "in every document": ([(k, "w1 " * (k % 5 + 1)) for k in range(40)], [(0, "w1")]),
        "no documents": ([], items),
        "no items": (some[:5], []),
        "no terms": ([(1, "..")], [(1, "..")]),
    }


@pytest.mark.parametrize("name", list(tables()))
@pytest.mark.parametrize("window", [64, lexical.WINDOW])
def test_search_is_plain(spark, name, window):
    docs, items = tables()[name]
    assert run(spark, docs, items, window) == plain(docs, items)


def test_blocks_of_items_change_nothing(spark):
    docs, items = tables()["plain"]
    with mock.patch.object(lexical, "PAIRS", 20):
        assert run(spark, docs, items) == plain(docs, items)


@pytest.mark.parametrize("size", [64, 100, 512])
def test_windows(size):
    """Windows of any size give what one pass over all documents gives."""
    r = np.random.default_rng(size)
    weights = r.integers(0, 500, 30)
    items = [r.choice(30, 5, replace=False).tolist() for _ in range(9)] + [[]]
    rows = [(d, int(r.integers(1, 50)), np.sort(r.choice(30, int(r.integers(0, 9)), replace=False)).astype("<i4")) for d in range(1000)]
    tf = [r.integers(1, 4, len(x[2])).astype("<i4") for x in rows]
    n_terms = sum(x[1] for x in rows)
    windows = lexical.Windows(items, weights, 1000, n_terms, 7, size)
    for k in range(0, 1000, size):
        part, own = rows[k : k + size], tf[k : k + size]
        windows.add([x[0] for x in part], np.array([x[1] for x in part]), np.array([len(x[2]) for x in part]), np.concatenate([x[2] for x in part]), np.concatenate(own))
        assert not windows.scores.any() and not windows.met.any()
    for heap, item in zip(windows.heaps, items):
        want = []
        for (d, n, terms), f in zip(rows, tf):
            m = 10 + 90 * n * 1000 // n_terms
            s = sum(int(weights[t]) * (1_000_000_000 * int(c) // (1000 * int(c) + 8 * m)) for t, c in zip(terms, f) if t in item)
            want += [(-s, d)] * (s > 0)
        assert sorted((-s, d) for s, _, d in heap) == sorted(want)[:7]


def test_terms():
    for t in ["A-b c_d é9 \x85x\xa0 İ 日本", "", "...", "\x00a\x7fb", "🙂🙂 x"]:
        assert [x.decode() for x in lexical.terms(t.encode())] == cut(t)


def test_sql():
    docs, items = tables()["awkward"]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": [t for _, t in docs]}))
    con.register("benchmark", pa.table({"item_id": pa.array([d for d, _ in items], pa.int64()), "text": [t for _, t in items]}))
    assert sorted(con.sql(f"SELECT item_id, rank, doc_id, score FROM ({lexical.ORACLE_SQL})").fetchall(), key=repr) == plain(docs, items)
