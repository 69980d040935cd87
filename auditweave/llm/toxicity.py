"""Toxicity by noisy-channel deobfuscation and a linear model over restored words.

A character trigram model is counted over all documents.  A chunk that looks disguised (digits or
signs among letters, letters set apart, a letter twice in a row) becomes a lattice: each sign may stand for
letters at a price, separators may be silent or end a word, repeats may be silent, and Viterbi
decoding under the trigram model picks the letters and words, however long the chunk is.  Letters in
a row with spaces between them are one chunk.  The restored words, next to the plain ones, are the features: whole words
and their beginnings.  A logistic model over the beginnings and words that tell toxic documents from
others gives a probability: all that the labelled sample's toxic documents hold and that are e times
likelier there; the ridge of one falls with the number of toxic documents that hold it.

Labels are learned from a sample of at most ``FIT_ROWS`` labelled documents, those of smallest id
hash, outside the held-out fold (crc32 of the id as text modulo 4 equal to 2).  Scores come from the
text alone.

Rows: null text is empty and scores like a text without words; null doc_id is not held out; labels
that are null, or of an id without document, are ignored, and of repeated labels the largest counts;
repeated rows score alike, and of those of a labelled id the least text is learned from; without labels of both kinds every score is the share of toxic labels;
an empty table gives an empty result; other columns are ignored (by ``keep_clean``: kept).
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FIT_ROWS = 20_000
#: Ridge of a feature that one toxic document has; it falls with their number.
RIDGE = 16.0
HELD_OUT = 2
THRESHOLD = 0.3

# The model's alphabet: word boundary, a-z, the Latin-1 letters from U+00DF on.
_LATIN = [c for c in map(chr, range(0xDF, 0x100)) if c.isalpha()]
LETTERS = [" ", *map(chr, range(ord("a"), ord("z") + 1)), *_LATIN]
_K = len(LETTERS)
_CODE = {c: i for i, c in enumerate(LETTERS)}
_PLAIN = {c: i for c, i in _CODE.items() if c != " "}
_TABLE = bytes(_CODE.get(chr(b), 0) for b in range(256))

#: What signs may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s", "*": "aeiou", "#": "aeiou",
}
_SIGNS = frozenset(SIGNS)
SEPARATORS = frozenset(".-_*~'`·•^/\\,:; ")
_PRICE_SIGN, _PRICE_WILD, _PRICE_SILENT, _PRICE_REPEAT, _PRICE_DOUBLE = 0.7, 2.0, 0.4, 0.2, 2.5
#: Chunks up to this length are remembered; longer ones are decoded each time.
REMEMBERED = 40
#: Entries of each of a memo's two generations, and features counted before they are told; they bound a
#: worker's memory, never a result.
MEMO_ENTRIES, COUNTED = 100_000, 100_000

_WORDS = re.compile(r"[^\W\d_]+").findall
_SPACED = re.compile(r"(?: [^\W_]| [@$!|]){3,}(?= )")
_DOUBLED, _TRIPLED = (re.compile(r"([^\W\d_])" + r"\1" * n) for n in (1, 2))
_EDGES = "".join(SEPARATORS) + "\"?!()[]{}<>“”„»«…&%$*#=|+"


# -- the character model --------------------------------------------------------------------------


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("latin-1", "replace").translate(_TABLE), np.uint8)


def _trigrams(texts: list[np.ndarray]) -> np.ndarray:
    """Counts over texts in a row; each begins with two boundaries and ends with one."""
    c = np.concatenate([np.zeros(0, np.int32), *texts])
    return np.bincount((c[:-2] * _K + c[1:-1]) * _K + c[2:], minlength=_K**3) if len(c) > 2 else np.zeros(_K**3, np.int64)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all texts.  At most as many rows as there are trigrams reach
    the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(_K**3, np.int64), [], 0
        for batch in batches:
            for t in batch.column(0):
                c = _codes(f"  {t.as_py()} ").astype(np.int32)
                held.append(c)
                size += len(c)
                if size > 500_000:
                    total += _trigrams(held)
                    held, size = [], 0
        total += _trigrams(held)
        (at,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["at", "n"])

    rows = docs.select(common.text_of().alias("text")).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(_K**3)
    counts[rows["at"].to_numpy(int)] = rows["n"].to_numpy(float)
    return counts.reshape(_K, _K, _K)


def log_model(counts: np.ndarray) -> np.ndarray:
    """-log P(third | first, second), smoothed by bigrams and a uniform share."""
    two = counts.sum(axis=0) + 0.1
    back = two / two.sum(axis=1, keepdims=True)
    mixed = (counts + 2.0 * back[None]) / (counts.sum(axis=2, keepdims=True) + 2.0)
    return -np.log(mixed).astype(np.float32)


class Restorer:
    """Viterbi decoding of disguised chunks."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self._prices = array("f", np.ascontiguousarray(model, np.float32).tobytes())  # the same numbers, quick to look up one by one
        self._steps = lru_cache(4096)(self._of)
        self._remembered = lru_cache(10_000)(self._restore)

    def restore(self, chunk: str) -> str:
        """The words of a chunk, with spaces between them."""
        return self._remembered(chunk) if len(chunk) <= REMEMBERED else self._restore(chunk)

    def disguised(self, chunk: str) -> bool:
        """It isn't a plain word: signs or digits in it, or a letter three times in a row."""
        core = chunk.strip(_EDGES) or chunk
        if not any(c.isalpha() for c in core):
            return False
        return not core.isalpha() or _TRIPLED.search(core) is not None or (chunk[:1] in SIGNS and not core[:1].isdigit())

    def suspicious(self, chunk: str) -> bool:
        """It may stand for another word too: disguised, or a letter twice in a row."""
        if _DOUBLED.search(chunk) is not None:  # as in any letter three times in a row
            return True
        core = chunk.strip(_EDGES) or chunk
        return chunk[:1] in SIGNS if core.isalpha() else any(map(str.isalpha, core))

    @staticmethod
    def _of(c: str) -> tuple[list[tuple[int, float]], bool, bool, bool]:
        """What a character may stand for, whether it may be silent inside and at an end, and whether it may end a word."""
        options = [(_CODE[c], 0.0)] if c in _CODE and c != " " else []
        options += [(_CODE[x], _PRICE_WILD if c in "*#" else _PRICE_SIGN) for x in SIGNS.get(c, "")]
        silent = c in SEPARATORS or not (c.isalnum() or c in SIGNS)
        return options, silent or not options, silent or not options or not c.isalnum(), c in SEPARATORS

    def _restore(self, chunk: str) -> str:
        cost, steps, plain, n = self._prices, self._steps, _PLAIN.get, _K
        # state: last two emitted letters, as one number -> (price, (letters before, letter))
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        at, size, before = 0, len(chunk), ""
        while at < size:
            if len(states) == 1:  # as long as letters stand for themselves alone, one state follows another
                ((key, (price, word)),) = states.items()
                start = at
                while at < size and (x := plain(chunk[at])) is not None and chunk[at] != before:
                    price += cost[key * n + x]
                    key = key % n * n + x
                    word = (word, x)
                    before = chunk[at]
                    at += 1
                if at > start:
                    states = {key: (price, word)}
                    continue
            c = chunk[at]
            options, inside, edge, ends = steps(c)
            silent = edge if at in (0, size - 1) else inside
            repeat = c == before and c.isalpha()
            before = c
            at += 1
            new: dict[int, tuple[float, tuple | None]] = {}
            for key, (price, word) in states.items():
                b = key % n
                for x, p in options:
                    total = price + p + cost[key * n + x]
                    if repeat and x == b:
                        total += _PRICE_DOUBLE
                    to = b * n + x
                    if to not in new or total < new[to][0]:
                        new[to] = (total, (word, x))
                if silent or (repeat and options[0][0] == b):
                    total = price + (_PRICE_REPEAT if repeat else _PRICE_SILENT)
                    if key not in new or total < new[key][0]:
                        new[key] = (total, word)
                if ends and b:
                    total = price + _PRICE_SILENT + cost[key * n]
                    to = b * n
                    if to not in new or total < new[to][0]:
                        new[to] = (total, (word, 0))
            states = new
        # a boundary that is emitted at the end has its price already
        word = min(((p + (cost[key * n] if key % n else 0.0), w) for key, (p, w) in states.items()), key=lambda x: x[0])[1]
        out = []
        while word is not None:
            word, x = word
            out.append(LETTERS[x])
        return "".join(reversed(out)).strip()


class Words(dict):
    """Memo in two generations: chunk -> what ``pick`` makes of its plain and restored words."""

    def __init__(self, model: np.ndarray, pick):
        super().__init__()
        self.restorer, self.pick = Restorer(model), pick
        self.older: dict = {}

    def words(self, chunk: str) -> list[str]:
        words = _WORDS(chunk)
        if self.restorer.suspicious(chunk):
            words += [w for w in self.restorer.restore(chunk).split() if w not in words]
        return words

    def spaced(self, run: str) -> list[str]:
        """Words of letters with spaces between them: joined, and as the lattice parts them."""
        words = self.words(run.replace(" ", ""))
        if any(c.isalpha() for c in run):
            words += [w for w in self.restorer.restore(run).split() if w not in words]
        return words

    def _plain(self, chunk: str):
        """The value of a chunk that needs no decoding; None: it has to be decoded.  Letters twice in a row that
        ``pick`` finds nothing new in, whichever are left out, are as good as plain."""
        core = chunk.strip(_EDGES)
        if not core.isalpha() or chunk[0] in SIGNS:
            return None
        value = self.pick(features(core))
        if True not in map(eq, core, core[1:]):
            return value
        if not (_SIGNS.isdisjoint(chunk) and _PLAIN.keys() >= set(core)):
            return None
        at = [k for k in range(1, len(core)) if core[k] == core[k - 1]]
        if len(at) > 3:
            return None
        ways = [core]
        for k in reversed(at):
            ways += [w[:k] + w[k + 1 :] for w in ways]
        own = set(value)
        return value if all(own.issuperset(self.pick(features(w))) for w in ways[1:]) else None

    def __missing__(self, chunk: str):
        value = self.older.get(chunk)
        if value is None:
            value = self._plain(chunk)
        if value is None:
            words = self.spaced(chunk) if " " in chunk else self.words(chunk)
            value = self.pick([f for w in words for f in features(w)])
        if len(chunk) <= REMEMBERED:
            if len(self) >= MEMO_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[chunk] = value
        return value

    def of(self, text: str) -> set:
        chunks = text.lower().split()
        own = set(chunks)
        out = set().union(*map(self.__getitem__, own))
        alone = [k for k, c in enumerate(chunks) if len(c) == 1] if min(map(len, own), default=0) == 1 else []
        if all(k + 2 != m for k, m in zip(alone, alone[2:], strict=False)):  # no three signs in a row by themselves
            return out
        for run in _SPACED.findall(" " + " ".join(chunks) + " "):
            out.update(self[run.strip()])
        return out


def restored_text(text: str, restorer: Restorer) -> str:
    """The text with its disguised chunks spelled out."""
    chunks = text.lower().split()
    row = _SPACED.sub(lambda m: " " + restorer.restore(m[0].strip()), " " + " ".join(chunks) + " ")
    return " ".join([restorer.restore(c) if restorer.disguised(c) else c for c in row.split()])


def features(word: str) -> list[str]:
    """A word and its beginnings of four and five letters."""
    out = [word + "$"]
    if len(word) > 4:
        out.append(word[:4])
        if len(word) > 5:
            out.append(word[:5])
    return out


# -- the model ------------------------------------------------------------------------------------


class ToxicityModel:
    """Trigram prices, features and weights; small, so it travels with the tasks."""

    def __init__(self, prices: np.ndarray, names: list[str], weights: np.ndarray, bias: float):
        self.prices, self.names, self.weights, self.bias = prices, names, weights, bias

    def scorer(self):
        index = {f: i for i, f in enumerate(self.names)}
        words = Words(self.prices, lambda fs: tuple([index[f] for f in fs if f in index]))
        weights, bias = self.weights, self.bias

        def score(text: str) -> float:
            own = sorted(words.of(text))  # the same order, and sum, in every process
            return float(1 / (1 + np.exp(-min(max(bias + weights[own].sum(), -40.0), 40.0)))) if own else float(1 / (1 + np.exp(-bias)))

        return score


def fit_logistic(x_rows: list[list[int]], y: np.ndarray, n: int, ridge: float | np.ndarray = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression over sets of features by accelerated gradient steps; ridge: one, or one a feature."""
    at = np.concatenate([np.array(r, np.int64) for r in x_rows]) if x_rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(x_rows)), [len(r) for r in x_rows])
    w, b = np.zeros(n), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    vw, vb = w.copy(), b
    most = max((len(r) for r in x_rows), default=0) + 1
    rate = 4.0 / (most * len(y) + 1)
    size = np.bincount(at, minlength=n) * most / 4 + ridge
    for k in range(steps):
        z = np.bincount(row, vw[at], len(x_rows)) + vb
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        nw = vw - (np.bincount(at, g[row], n) + ridge * vw) / size
        nb = vb - g.sum() * rate
        m = k / (k + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w, b


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    common.shared_folder(docs.sparkSession)
    prices = log_model(trigram_counts(docs))
    ok = (labels["toxic"].isNotNull()) & (common.crc_remainder() != HELD_OUT)
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(ok)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)  # the stated bound of the sample: small enough to send to every task
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")  # one row an id

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(prices, tuple), {}
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen.setdefault(int(y), Counter()).update(words.of(t.as_py()))
                seen[int(y)][""] += 1
            if sum(map(len, seen.values())) > COUNTED:
                yield from _told(seen)
                seen = {}
        yield from _told(seen)

    held = rows.mapInArrow(count, "feature string, toxic int, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") != 1, F.col("n")).otherwise(0)).alias("good")
    ).checkpoint()
    whole = held.where("feature = ''").head()
    n_bad, n_good = (int(whole.bad), int(whole.good)) if whole else (0, 0)
    if not n_bad or not n_good:
        share = float(np.clip(n_bad / max(1, n_bad + n_good), 1e-9, 1 - 1e-9))
        return ToxicityModel(prices, [], np.zeros(0), float(np.log(share / (1 - share))))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    # every feature that speaks for toxicity, as many as the bounded sample has; rare ones are shrunk, not cut
    told = held.where("feature <> '' and bad > 0").withColumn("odds", odds).where("odds > 1").select("feature", "bad").orderBy("feature").toPandas()
    names, ridge = told["feature"].tolist(), RIDGE / told["bad"].to_numpy(float)
    index = {f: i for i, f in enumerate(names)}

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(prices, lambda fs: tuple([index[f] for f in fs if f in index]))
        for batch in batches:
            own = [sorted(words.of(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], names=["toxic", "own"])

    got: pd.DataFrame = rows.mapInArrow(select, "toxic int, own array<int>").toPandas()  # fit_rows rows at most
    y = (got["toxic"] == 1).to_numpy(float)
    weights, bias = fit_logistic([list(r) for r in got["own"]], y, len(names), ridge)
    return ToxicityModel(prices, names, weights, bias)


def _told(seen: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
    for y, c in seen.items():
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([y] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["feature", "toxic", "n"])


def score_texts(docs: DataFrame, model: ToxicityModel, score: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and a probability."""
    import uuid

    key = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the alphabet and the sample
    text = docs.columns.index("text")
    kind = dict(docs.dtypes)["text"]
    docs = docs if kind == "string" else docs.withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = common.remembered(key, lambda: sent.value.scorer())
        for batch in batches:
            scores = pa.array([own(t.as_py() or "") for t in batch.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, score])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])
    return docs.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with their columns."""
    scored = score_texts(docs, fit(docs, labels), "__aw_score")
    return scored.where(F.col("__aw_score") < threshold).select(*[f"`{c}`" for c in docs.columns])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    held = F.coalesce(common.crc_remainder() == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
