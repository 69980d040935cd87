"""Document quality by co-training of a text view and a page view.

The text view sees the text alone: words and their shares (hashed words, repetition, character
classes).  The page view sees metadata alone: language, source and the stated number of characters.  Two
logistic models start from the labelled sample.  In each round either judges every unlabelled document
and gives the other its ``GIVEN`` most confident judgements, as many good and bad ones as their shares
ask for, but only above ``CONFIDENT``, and no document twice.  Of the labelled sample three fifths are
trained on, a fifth calibrates the views, and a fifth weighs them into one probability of label 1.  All
documents are then scored.  Features are made once and kept in the shared folder.

Only the labelled sample is bounded: ``FIT_ROWS`` labelled documents outside the held-out fold (crc32
of the id as text modulo 4 equal to 2), those of smallest id hash.

Rows: null text is empty; null lang, source, n_chars or id are values of their own (a null id is neither
labelled nor held out nor given away); of repeated labels of an id the largest counts, of repeated rows
of a labelled or given id the one with the least features; without labels of both kinds every score is
the share of label 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FIT_ROWS = 4000
ROUNDS = 5
#: Pool documents that a view gives away in a round.
GIVEN = 200
CONFIDENT = 0.9
THRESHOLD = 0.5
HELD_OUT = 2
_HASHED, _STATS = 256, 12
_LANGS, _SOURCES, _SIZES = 16, 64, 24
_PAGE = _LANGS + _SOURCES + _SIZES

_SIGNS = re.compile(r"[^\w\s]")


class Views:
    """Features of one document in both views, with a bounded memo of hashed words."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def text(self, text: str) -> np.ndarray:
        words = text.split()
        out = np.zeros(_STATS + _HASHED, np.float32)
        n = len(words)
        if not n:
            out[0] = 1
            return out
        memo = self.memo
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        chars = len(text)
        letters = sum(map(len, words))
        signs = len(_SIGNS.findall(text))
        digits = sum(text.count(c) for c in "0123456789")
        distinct = len(counts)
        top = max(counts.values())
        out[1:_STATS] = (
            np.log1p(n) / 10, distinct / n, distinct / n**0.7, top / n, letters / n / 10, signs / chars * 5, digits / chars * 5,
            sum(w[:1].isupper() for w in counts) / distinct, sum(len(w) > 12 for w in counts) / distinct, float(signs > n / 2), float(top > n / 5),
        )
        at, by = [], []
        for w, c in counts.items():
            h = memo.get(w)
            if h is None:
                if len(memo) > 200_000:
                    memo.clear()
                h = memo[w] = zlib.crc32(w.lower().encode()) % _HASHED
            at.append(h)
            by.append(c)
        hashed = np.bincount(at, by, _HASHED)
        out[_STATS:] = np.sqrt(hashed / n)
        return out

    def page(self, lang: str | None, source: str | None, n_chars: int | None) -> bytes:
        """Which of each sort of metadata, a byte each."""
        size = 0 if n_chars is None else 1 + min(_SIZES - 2, max(0, n_chars).bit_length())
        return bytes((zlib.crc32(repr(lang).encode()) % _LANGS, zlib.crc32(repr(source).encode()) % _SOURCES, size))


def matrices(t: pa.Array, p: pa.Array) -> list[np.ndarray]:
    """Both views of rows of packed features."""
    n = len(t)
    text = np.frombuffer(b"".join(t.to_pylist()), np.float16).reshape(n, _STATS + _HASHED).astype(np.float32)
    which = np.frombuffer(b"".join(p.to_pylist()), np.uint8).reshape(n, 3) + np.array([0, _LANGS, _LANGS + _SOURCES])
    page = np.zeros((n, _PAGE), np.float32)
    np.put_along_axis(page, which, 1, 1)
    return [text, page]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 200) -> np.ndarray:
    """Weights and, last, the bias, by accelerated gradient steps."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(np.float64)
    rate = 1 / (0.25 * np.linalg.norm(x, 2) ** 2 + ridge)
    w = v = np.zeros(x.shape[1])
    for k in range(steps):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ v, -40, 40))) - y) + ridge * np.r_[v[:-1], 0]
        new = v - rate * g
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class CoTrained:
    """Weights of both views, their calibration (slope, shift), and the weights of the union."""

    def __init__(self, views: list[np.ndarray], scales: list[np.ndarray], union: np.ndarray):
        self.views, self.scales, self.union = views, scales, union

    def scores(self, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = [s[0] * logit(w, v) + s[1] for w, s, v in zip(self.views, self.scales, x, strict=True)]
        return probability(z[0]), probability(z[1]), probability(logit(self.union, np.stack(z, 1)))


def co_train(x: list[np.ndarray], y: np.ndarray, judge, rounds: int = ROUNDS, given: int = GIVEN) -> CoTrained:
    """``judge(views, wanted)`` gives, for each (giver, label, how many) of ``wanted``, the rows of the pool
    that the giver is surest of, in both views."""
    order = np.random.default_rng(11).permutation(len(y))
    cuts = len(y) * 3 // 5, len(y) * 4 // 5
    train, check, weigh = (order[a:b] if b > a else order for a, b in ((0, cuts[0]), (cuts[0], cuts[1]), (cuts[1], len(y))))
    own = [(v[train], y[train].astype(float)) for v in x]
    views = [logistic(*o) for o in own]
    share = float(np.clip(y.mean(), 0.05, 0.95))
    good = int(given * share)
    for _ in range(rounds):
        gifts = judge(views, [(k, label, n) for k in (0, 1) for label, n in ((1, good), (0, given - good))])
        if not any(len(rows[0]) for _, _, rows in gifts):
            break
        for giver, label, rows in gifts:
            a, b = own[1 - giver]
            own[1 - giver] = (np.concatenate([a, rows[1 - giver]]), np.concatenate([b, np.full(len(rows[0]), float(label))]))
        views = [logistic(*o) for o in own]
    scales = []
    for w, v in zip(views, x, strict=True):
        s = logistic(logit(w, v[check])[:, None], y[check].astype(float), 0.1)
        scales.append(s if s[0] > 0 else np.array([1.0, 0.0]))
    z = np.stack([s[0] * logit(w, v[weigh]) + s[1] for w, s, v in zip(views, scales, x, strict=True)], 1)
    return CoTrained(views, scales, logistic(z, y[weigh].astype(float), 0.1))


def features(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """id, mark (its label; null: none) and both views as packed bytes, of every row; kept in the
    shared folder."""
    common.shared_folder(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = Views()
        for batch in batches:
            t, p = [], []
            for text, *page in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                t.append(np.clip(views.text(text), 0, 16).astype(np.float16).tobytes())
                p.append(views.page(*page))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t, pa.binary()), pa.array(p, pa.binary())], names=["id", "t", "p"])

    def named(c: str, kind: str):
        return (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), common.text_of().alias("text"), named("lang", "string"), named("source", "string"), named("n_chars", "long"))
    made = rows.mapInArrow(run, "id long, t binary, p binary")
    if labels is None:
        return made.withColumn("mark", F.lit(None).cast("int"))
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("mark"))
    return made.join(known, "id", "left").checkpoint()


def fit(made: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, given: int = GIVEN, confident: float = CONFIDENT) -> CoTrained:
    """From ``features`` with labels."""
    fold = F.col("mark").isNotNull() & (common.crc_remainder("id") != HELD_OUT)
    sample = made.where(fold).groupBy("id", "mark").agg(F.min(F.struct("t", "p")).alias("f")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    got = sample.select("mark", "f.t", "f.p").toArrow()
    x = matrices(got["t"], got["p"])
    y = (got["mark"].to_numpy() == 1).astype(int)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        flat = [np.zeros(v.shape[1] + 1) for v in x]
        return CoTrained(flat, [np.array([1.0, 0.0])] * 2, np.array([0.0, 0.0, np.log(share / (1 - share))]))
    pool = made.where("mark IS NULL AND id IS NOT NULL")
    taken: list[set] = [set(), set()]  # ids given by either view, GIVEN a round

    def judge(views: list[np.ndarray], wanted: list[tuple[int, int, int]]):
        sent = made.sparkSession.sparkContext.broadcast((views, [np.array(sorted(s), np.int64) for s in taken]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A task's surest rows of each kind: a few hundred."""
            views, gone = sent.value
            best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in wanted]
            for batch in batches:
                ids, v = batch.column(0).to_numpy(), matrices(batch.column(1), batch.column(2))
                p = [probability(logit(w, m)) for w, m in zip(views, v, strict=True)]
                for k, (giver, label, n) in enumerate(wanted):
                    sure = p[giver] if label else 1 - p[giver]
                    rows = np.flatnonzero((sure >= confident) & ~np.isin(ids, gone[giver]))
                    sure, own = np.r_[best[k][0], sure[rows]], np.r_[best[k][1], ids[rows]]
                    order = np.lexsort((own, -sure))
                    order = order[np.sort(np.unique(own[order], return_index=True)[1])[:n]]
                    best[k] = sure[order], own[order]
            kind = np.repeat(np.arange(len(wanted)), [len(b[0]) for b in best])
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], names=["kind", "sure", "id"])

        offers = pool.select("id", "t", "p").mapInArrow(run, "kind int, sure double, id long").groupBy("kind", "id").agg(F.max("sure").alias("sure")).checkpoint()
        picked = None
        for k, (_, _, n) in enumerate(wanted):
            own = offers.where(F.col("kind") == k).orderBy(F.desc("sure"), "id").limit(n)
            picked = own if picked is None else picked.unionByName(own)
        kinds = picked.select("kind", "id")  # at most two times GIVEN rows
        rows = pool.join(F.broadcast(kinds), "id").groupBy("kind", "id").agg(F.min(F.struct("t", "p")).alias("f")).orderBy("kind", "id").select("kind", "id", "f.t", "f.p").toArrow()
        out, of = [], rows["kind"].to_numpy()
        for k, (giver, label, _) in enumerate(wanted):
            own = rows.take(np.flatnonzero(of == k))
            taken[giver].update(own["id"].to_pylist())
            out.append((giver, label, matrices(own["t"], own["p"])))
        return out

    return co_train(x, y, judge, rounds, given)


def score(made: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, text_score, page_score and score (calibrated, of both) of every row of ``features``."""
    sent = made.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                scores = sent.value.scores(matrices(part.column(1), part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(s, pa.float64()) for s in scores]], names=["doc_id", "text_score", "page_score", "score"])

    return made.select("id", "t", "p").mapInArrow(run, "doc_id long, text_score double, page_score double, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    scored = score(made, fit(made))
    held = F.coalesce(common.crc_remainder() == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "text_score", "page_score", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
