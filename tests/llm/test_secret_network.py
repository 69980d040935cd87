"""The network of the secret scan against plain versions, and on planted secrets."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditweave.llm import common, secret_scan
from auditweave.llm.secret_scan import AFTER, BEFORE, Block, Network


def plain_tokens(text):
    out = []
    for m in re.finditer(r"""[^\s\x00-\x1f"'`,;<>()\[\]{}=:]+""", text):
        core = [k for k in range(m.start(), m.end()) if not (ord(text[k]) < 128 and not text[k].isalnum() and text[k] not in "+/_-@")]
        if core and core[-1] + 1 - core[0] >= secret_scan.TOKEN:
            out.append((core[0], core[-1] + 1))
    return out


def test_candidates():
    r = np.random.default_rng(1)
    bits = ["abcdefgh", "x", " ", ".", "...", "=", '"', "é", "\u3000", "a1-b2_c3", "\n", "***", "+/", "\U0001f600", "(", "9876543210"]
    for _ in range(2000):
        text = "".join(r.choice(bits, r.integers(0, 14)))
        block = Block(["pad", text], [[], []])
        shift = block.offset[1]
        assert [(a - shift, b - shift) for a, b in zip(block.a, block.b, strict=True)] == plain_tokens(text), text


def plain_pooled(net, classes, a, b):
    t = np.einsum("cs,jsf->jcf", net.p["e"], net.p["w"])
    h = np.maximum(sum(t[j][classes[j : len(classes) - 3 + j]] for j in range(4)) + net.p["c"], 0)
    return np.stack([np.concatenate([h[i - BEFORE : i].max(0), h[i : j - 3].max(0), h[i : j - 3].mean(0), h[j - 3 : j + AFTER - 4].max(0)]) for i, j in zip(a, b, strict=True)])


@pytest.mark.parametrize("size", [16, 1 << 14])
def test_pooling_sees_whole_candidates(monkeypatch, size):
    monkeypatch.setattr(secret_scan, "_SLICE", size)
    net = Network(3)
    texts = ["some words of ordinary length here", "q" * 200 + "7Zk" * 30 + " end-of-text", "", "averyveryvery.longtoken"]
    block = Block(texts, [[], [], [], []])
    assert np.allclose(net.pooled(block.classes, block.a, block.b), plain_pooled(net, block.classes, block.a, block.b), atol=1e-4)


def test_gradients():
    net = Network(4)
    rows = [("token = ", "a1b2c3d4e5", " and"), ("", "ordinary", ""), ("see the ", "word.with.dots", ", so")]
    where, y = secret_scan.side_by_side(rows), np.array([1.0, 0.0, 0.0])

    def loss():
        x = plain_pooled(net, *where)
        z = np.maximum(x @ net.p["u"] + net.p["d"], 0) @ net.p["v"] + net.p["b"][0]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    got = net._gradients(*where, y)
    r = np.random.default_rng(2)
    for name, v in net.p.items():
        for _ in range(6):
            at = tuple(r.integers(n) for n in v.shape)
            old = v[at]
            v[at] = old + 1e-5
            up = loss()
            v[at] = old - 1e-5
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-5 - got[name][at]) < 1e-3, name


def test_recall_comes_first():
    """Findings that look like ordinary words still pass the threshold."""
    r = np.random.default_rng(3)
    rows = [("", "".join(r.choice(list("abcdefgh"), 12)), "") for _ in range(400)]
    y = (np.arange(400) % 4 == 0).astype(float)
    net = Network()
    net.train(rows[:300], y[:300], rounds=2)
    net.calibrate(rows[300:], y[300:])
    found = net.scores(*secret_scan.side_by_side([r for r, k in zip(rows[300:], y[300:], strict=True) if k]))
    assert (found >= net.threshold).mean() >= secret_scan.RECALL - 0.04


SECRETS = {
    "jwt": lambda r, w: ".".join(w(r, n) for n in (20, 24, 32)),
    "prefixed": lambda r, w: "ghp_" + w(r, 32),
    "password": lambda r, w: w(r, 6) + "&" + w(r, 6),
    "short": lambda r, w: w(r, 12),
    "base64": lambda r, w: w(r, 20) + "+" + w(r, 10) + "/" + w(r, 8),
}
LOOK_ALIKES = {
    "mail": lambda r, t: f"{t()[:6]}.{r.integers(99):02d}@mail{r.integers(9)}.example.com",
    "address": lambda r, t: ".".join(str(r.integers(100, 255)) for _ in range(4)),
    "path": lambda r, t: "/" + "/".join(t() for _ in range(4)),
    "name": lambda r, t: "_".join(t() for _ in range(3)),
    "number": lambda r, t: "".join(str(r.integers(10)) for _ in range(16)),
}


def test_planted_secrets(spark):
    """Secrets of five shapes that no pattern finds, and look-alikes, among real documents."""
    r = np.random.default_rng(9)
    letters = list("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789")

    def value(r, n):
        while True:
            v = "".join(r.choice(letters, n))
            if len(set(v)) > 3 and any(c.isdigit() for c in v):
                return v

    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    texts = [x.text for x in docs.where("length(text) > 400").orderBy("doc_id").limit(200).collect()]
    words = [w for t in texts for w in t.split() if w.isalpha() and 4 <= len(w) <= 9]
    planted, rows = {}, []
    for k, text in enumerate(texts):
        name, make = [*SECRETS.items()][k % 5]
        alike = [*LOOK_ALIKES.values()][k // 5 % 5]
        own = make(r, value)
        rows.append((1_000_000 + k, f"{text[:200]} {own} {text[200:400]} {alike(r, lambda: str(r.choice(words)).lower())} {text[400:]}"))
        planted[1_000_000 + k] = (name, own, rows[-1][1].index(own))
    net = secret_scan.fit(docs)
    both = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = secret_scan.scan(both, net).select("doc_id", F.filter("spans", lambda s: s["kind"] == "network").alias("spans")).where("size(spans) > 0").collect()
    spans = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in got}
    hits = {n: [] for n in SECRETS}
    for i, (name, own, at) in planted.items():
        hits[name].append(any(a <= at + 2 and at + len(own) - 2 <= b for a, b in spans.get(i, [])))
    right, found = sum(map(sum, hits.values())), sum(map(len, spans.values()))
    print({n: np.mean(h) for n, h in hits.items()}, right / found)
    assert right >= 0.95 * len(planted)
    assert min(np.mean(h) for h in hits.values()) >= 0.85
    assert right >= 0.85 * found


def test_awkward_rows(spark):
    schema = "doc_id long, text string, spans string, score int, a string"
    df = spark.createDataFrame([(None, None, "x", 1, "b"), (1, "", "x", 1, None), (1, "token = abcd1234efgh", "x", 1, "b"), (1, "token = abcd1234efgh", "x", 1, "b"), (2, "z9" * 300_000, "x", 1, "b")], schema)
    got = secret_scan.scan(df)
    assert got.count() == 5
    clean = secret_scan.redact(df)
    assert clean.columns == df.columns and clean.count() == 5
    assert secret_scan.scan(df.limit(0)).count() == 0 and secret_scan.redact(df.limit(0)).count() == 0


def test_everything_else_calibrates(spark):
    """All findings and tokens that weren't trained on are counted, however small the sample, and the threshold keeps 0.99 of the findings."""
    r = np.random.default_rng(5)
    letters = list("abcdefghijkmnopqrstuvwxyz0123456789")
    texts = []
    for k in range(40):
        own = [f"token = {''.join(r.choice(letters, 14 + k % 9))}1" for _ in range(9)]
        texts.append(" ".join(f"{f} {''.join(r.choice(letters[:20], 9))} and then" for f in own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secret_scan.labelled(df).checkpoint()
    train, check = secret_scan.parted(secret_scan.sampled(rows, 20))
    net = secret_scan.trained_on(train)
    known = {row[1:] for row in train}
    found, other = set(), 0
    for t in texts:
        block = Block([t], [secret_scan.base_spans(t)])
        for a, b, base in zip(block.a - block.offset[0], block.b - block.offset[0], block.base, strict=True):
            row = (t[max(0, a - BEFORE) : a], t[a:b], t[b : b + AFTER])
            if row not in known and base:
                found.add(row)
            elif row not in known:
                other += 1
    good, bad = secret_scan.finding_counts(rows, net, train, check), secret_scan.token_counts(df, net, train)
    assert len(found) > 300 and good.sum() % len(found) == 0 and good.sum() >= 4 * len(found)
    assert bad.sum() == other > 250
    net.calibrate_counts(good, bad)
    edges = np.arange(-secret_scan._BINS, secret_scan._BINS) / secret_scan._FINE
    kept = 1 / (1 + np.exp(-np.clip(net.slope * edges + net.shift, -40, 40))) >= net.threshold
    assert 0.99 <= good[kept].sum() / good.sum() and good[1:][kept[:-1]].sum() / good.sum() < 0.99 + 1e-9 + good.max() / good.sum()
    assert (net.scores(*secret_scan.side_by_side(sorted(found))) >= net.threshold).mean() >= 0.98
