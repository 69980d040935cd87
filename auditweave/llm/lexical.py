"""Ranked lexical search by windowed bucket scoring.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower
case.  With N documents that hold a term, L terms in all, n terms of a document, df documents that hold
the term and tf occurrences of it, a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))) and adds
w * ((10^9 tf) div (1000 tf + 8 (10 + (90 n N) div L))) to the document's score.

Items are dealt in blocks of about ``PAIRS`` (item, term) pairs, so that what a block's tasks are sent
has a bound; a block's terms number from 0.  Every whole text is cut into terms once a block; of a
document its length and the block's terms with their counts are written.  Counts of all documents
follow from that, then the rows are put in doc_id order and every task traverses its range in windows
of ``WINDOW`` documents: the window's postings are turned to lists by term, an item's lists are added
into one array of the window's size with a bitset of the places that were met, and the places are
harvested into the item's heap of the best.  An item whose lists can't reach its heap's last score in
a window is passed over.  Heaps of all tasks meet in a ranked window, which Spark limits before its
shuffle.  Equal doc_id values, null ones too, are spread over the ranges.

Rows: every row is a document, repeated rows too; null and empty texts, and texts without a term, have no
part in N and L; rows of one item_id are one item that holds the terms of all; a null item_id is an
item; a null doc_id comes after all others of equal score; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

K = 10
#: Documents of a window: its scores take 128 KB.
WINDOW = 16_384
#: A window ends early at so many postings, so that long texts don't add up.
POSTINGS = 4 << 20
#: (item, term) pairs of a block, about; an item is never split.
PAIRS = 1 << 18
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return text.translate(_TABLE).split()


def _texts(column) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) pairs of a table of items."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for k, text in enumerate(_texts(batch.column(1))):
                own = sorted(set(terms(text or b"")))
                ids += [k] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(found, pa.binary())], names=["item_id", "term"])

    return items.select("item_id", F.col("text").cast("string")).mapInArrow(run, f"item_id {kind}, term binary").distinct()


class Block:
    """Items of a block by number, their terms by number, and after counting the terms' weights."""

    def __init__(self, pairs: list):
        self.ids = sorted({p.item_id for p in pairs}, key=lambda x: (x is None, x))
        words = sorted({bytes(p.term) for p in pairs})
        self.number = {t: k for k, t in enumerate(words)}
        at = {x: k for k, x in enumerate(self.ids)}
        self.items: list[list[int]] = [[] for _ in self.ids]
        for p in pairs:
            self.items[at[p.item_id]].append(self.number[bytes(p.term)])

    def weigh(self, n_docs: int, df: dict[int, int]) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[k] + 1))) if k in df else 0 for k in range(len(self.number))], np.int64)


def counted(docs: DataFrame, number) -> DataFrame:
    """A row for each document with a term: doc_id, n, and numbers and counts of the block's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.value.get
        for batch in batches:
            rows, n, ids, counts = [], [], [], []
            for k, text in enumerate(_texts(batch.column(1))):
                own = terms(text or b"")
                if own:
                    held = Counter(map(get, own))
                    held.pop(None, None)
                    rows.append(k)
                    n.append(len(own))
                    ids.append(np.fromiter(held, "<i4", len(held)).tobytes())
                    counts.append(np.fromiter(held.values(), "<i4", len(held)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "counts"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, terms binary, counts binary")


def frequencies(index: DataFrame, size: int) -> dict[int, int]:
    """Documents that hold each of a block's terms; one sum a term and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["term", "df"])

    return {r.term: r.df for r in index.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}


class Windows:
    """Heaps of a block's items over windows of documents in ascending order."""

    def __init__(self, items: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int = K, size: int = WINDOW):
        self.items = [[t for t in own if weights[t] > 0] for own in items]
        self.weights, self.n_docs, self.n_terms, self.k = weights, n_docs, n_terms, k
        self.scores = np.zeros(size, np.int64)
        self.met = np.zeros(-(-size // 64), np.uint64)
        self.heaps: list[list[tuple[int, int, int | None]]] = [[] for _ in items]
        self.seen = 0

    def add(self, ids: list, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """One window: a document's id, length and number of postings; then all postings."""
        m = 10 + (90 * n * self.n_docs) // self.n_terms
        slot = np.repeat(np.arange(len(n)), sizes)
        order = np.argsort(term, kind="stable")
        term, slot, tf = term[order], slot[order], tf[order].astype(np.int64)
        gain = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[slot]))
        begins = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(gain, begins).tolist() if len(begins) else []
        lists = dict(zip(term[begins].tolist(), zip(begins.tolist(), [*begins[1:].tolist(), len(term)], most), strict=True))
        word, bit = slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64)
        for heap, own in zip(self.heaps, self.items, strict=True):
            here = [lists[t] for t in own if t in lists]
            floor = heap[0][0] if len(heap) == self.k else 0
            if sum(x[2] for x in here) <= floor:
                continue  # ties go to earlier documents, so a later one must score more
            for a, b, _ in here:
                self.scores[slot[a:b]] += gain[a:b]  # a place occurs once in a list
                np.bitwise_or.at(self.met, word[a:b], bit[a:b])
            at = np.flatnonzero(np.unpackbits(self.met.view(np.uint8), bitorder="little"))
            got = self.scores[at]
            self.scores[at], self.met[:] = 0, 0
            better = np.flatnonzero(got > floor)
            best = better[np.argsort(-got[better], kind="stable")[: self.k]]
            for score, place in zip(got[best].tolist(), at[best].tolist(), strict=True):
                entry = (score, -(self.seen + place), ids[place])
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heappushpop(heap, entry)
        self.seen += len(n)


def _best(block, weights, n_docs: int, n_terms: int, k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(block.value, weights.value, n_docs, n_terms, k, window)
        held: list[pa.RecordBatch] = []
        rows = postings = 0

        def score() -> None:
            nonlocal held, rows, postings
            ids = [x for b in held for x in b.column(0).to_pylist()]
            n = np.concatenate([b.column(1).to_numpy() for b in held])
            packed = [x for b in held for x in b.column(2).to_pylist()]
            sizes = np.array([len(x) // 4 for x in packed], np.int64)
            tf = np.frombuffer(b"".join(x for b in held for x in b.column(3).to_pylist()), "<i4")
            windows.add(ids, n, sizes, np.frombuffer(b"".join(packed), "<i4"), tf)
            held, rows, postings = [], 0, 0

        for batch in batches:
            sizes = np.array([len(x) // 4 for x in batch.column(2).to_pylist()], np.int64)
            begin = 0
            while begin < batch.num_rows:
                fits = np.searchsorted(np.cumsum(sizes[begin:]), POSTINGS - postings, side="right")
                take = int(min(window - rows, batch.num_rows - begin, max(fits, 1 if not rows else 0)))
                if take:
                    held.append(batch.slice(begin, take))
                    rows, postings, begin = rows + take, postings + int(sizes[begin : begin + take].sum()), begin + take
                if rows == window or not take or postings >= POSTINGS:
                    score()
        if rows:
            score()
        found = [(k, s, d) for k, heap in enumerate(windows.heaps) for s, _, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in ((0, pa.int32()), (2, pa.int64()), (1, pa.int64()))], names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """The k best documents (doc_id, text) of every item (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    pairs = common.written(item_terms(items), "item-terms")
    blocks = -(-pairs.count() // PAIRS)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for b in range(blocks):
        block = Block(pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect())
        if not block.ids:
            continue
        index = common.written(counted(docs, spark.sparkContext.broadcast(block.number)), "lexical-index")
        n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        weights = block.weigh(n_docs, frequencies(index, len(block.number)))
        ordered = (
            index.where(F.octet_length("terms") > 0)
            .repartitionByRange(common.partitions(spark), F.col("doc_id").asc_nulls_last(), F.monotonically_increasing_id())  # the latter spreads equal ids
            .sortWithinPartitions(F.col("doc_id").asc_nulls_last())
        )
        send = spark.sparkContext.broadcast
        best = ordered.mapInArrow(_best(send(block.items), send(weights), n_docs, n_terms, k, window), "item int, doc_id long, score long")
        rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        ids = spark.createDataFrame([(i, x) for i, x in enumerate(block.ids)], f"item int, item_id {kind}")
        out = out.unionByName(best.withColumn("rank", rank).where(F.col("rank") <= k).join(ids, "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every item of the benchmark."""
    return search(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark").select("item_id", "text"))


_CUT = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CUT} AS t FROM documents),
lengths AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
whole AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_CUT}) AS term FROM benchmark)),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term),
scored AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN lengths USING (r), whole GROUP BY item_id, r),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored JOIN lengths USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
