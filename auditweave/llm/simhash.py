"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint sums up word shingles: a bit is 1 if it is set in over half of their hashes.  Equal
fingerprints are one node.  Two that differ in at most ``radius`` of 64 bits agree on all but
``radius`` of the blocks that the bits are cut into, so rows meet in buckets of
all choices of blocks; how many blocks there are follows from the number of fingerprints, and every
choice is exact.  In a bucket the fingerprints are compared vertically: bit k of all of them is one
row of machine words, a difference is an exclusive or, and carry-save counters of whole words add up
the distances of 64 pairs at once; a block is left as soon as all of its pairs exceed the radius.  A
bucket of more than ``CHUNK`` rows is dealt to tasks as pairs of its chunks.  Tasks return a forest
of links, never all pairs.

Rows: null and empty text, and text without a word, has fingerprint zero, which links like any
other; null doc_id is of no account for a component's id, which is null only if all its ids are; repeated
rows are nodes of one component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, near_copies
from .components import components

WORDS = 4
RADIUS = 4
SEED = 42
#: Rows of a bucket that one task compares with each other.
CHUNK = 4096
#: Groups up to this size are compared by shifts, all groups of a batch at once.
SMALL = 64
#: Mean bucket size that the number of blocks is chosen for.
BUCKET = 256
#: Queries of one step against a block.
_QUERIES = 128


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of the text's word shingles, repeats counted; 0 without a word."""
    tokens = text.encode().lower().split()  # of bytes: only A-Z and ASCII white space
    if not tokens:
        return 0
    row = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(tokens) > words:
        a, b = starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist()
    else:
        a, b = [0], [len(row)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, len(a), 8192):
        h = np.array([digest(row[x:y], seed) for x, y in zip(a[k : k + 8192], b[k : k + 8192], strict=True)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    out = np.packbits(2 * counts > len(a), bitorder="little")
    return int(out.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# -- bit-sliced comparison ------------------------------------------------------------------------


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 rows of machine words: bit i of row k is bit k of fingerprint i."""
    fill = -len(fps) % 64
    padded = np.concatenate([fps, np.zeros(fill, np.uint64)])
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


class Counters:
    """Carry-save counters: word-wise counts of differing bits, up to ``radius`` and beyond."""

    def __init__(self, shape: tuple[int, ...], radius: int, kind):
        self.radius = radius
        self.bits = [np.zeros(shape, kind) for _ in range(radius.bit_length())]
        self.over = np.zeros(shape, kind)

    def add(self, x: np.ndarray) -> None:
        for k, c in enumerate(self.bits):
            self.bits[k], x = c ^ x, c & x
        self.over |= x

    def add3(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> None:
        """A full adder takes three differences to a sum and a carry of weight two."""
        half = x ^ y
        self.add(half ^ z)
        carry = (x & y) | (half & z)
        for k in range(1, len(self.bits)):
            self.bits[k], carry = self.bits[k] ^ carry, self.bits[k] & carry
        self.over |= carry

    def beyond(self) -> np.ndarray:
        """Set where the count exceeds the radius."""
        more = np.zeros_like(self.over)
        equal = ~more
        for k in range(len(self.bits) - 1, -1, -1):
            if self.radius >> k & 1:
                equal = equal & self.bits[k]
            else:
                more |= equal & self.bits[k]
                equal = equal & ~self.bits[k]
        return more | self.over


def _distances(differences, shape: tuple[int, ...], radius: int, kind, out: np.ndarray) -> np.ndarray | None:
    """Words of pairs within the radius; None once all exceed it.  ``out``: pairs of no account."""
    counters = Counters(shape, radius, kind)
    for k in range(0, 63, 3):
        counters.add3(differences(k), differences(k + 1), differences(k + 2))
        if k >= 12 and k % 6 == 0:
            far = counters.beyond() | out
            if not np.any(~far):
                return None
    counters.add(differences(63))
    near = ~(counters.beyond() | out)
    return near if np.any(near) else None


def near_within(fps: np.ndarray, radius: int) -> np.ndarray:
    """Index of the least member of each fingerprint's component among ``fps``, in blocks of
    queries against all."""
    n = len(fps)
    planes = planes_of(fps)
    fill = np.zeros(planes.shape[1] * 64, np.uint8)
    fill[n:] = 1
    outside = np.packbits(fill, bitorder="little").view(np.uint64)[None, :]
    label = np.arange(n)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, n, _QUERIES):
        queries = fps[at : at + _QUERIES]
        flips = [np.where(queries >> np.uint64(k) & np.uint64(1), full, np.uint64(0))[:, None] for k in range(64)]
        near = _distances(lambda k: planes[k][None, :] ^ flips[k], (len(queries), planes.shape[1]), radius, np.uint64, outside)  # noqa: B023
        if near is None:
            continue
        hits = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :n]
        for q in np.flatnonzero(hits.sum(axis=1) > 1):
            own = np.unique(label[np.flatnonzero(hits[q])])
            if len(own) > 1:
                label[np.isin(label, own)] = own[0]
    return label


def near_by_shifts(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius among rows of one group; rows are sorted by group and groups are
    small.  Shift d compares all rows with the rows d further on at once."""
    planes = planes_of(fps).view(np.uint8)
    n, width = len(fps), planes.shape[1]
    most = int(np.max(np.unique(group, return_counts=True)[1], initial=1))
    left, right = [], []
    for d in range(1, most):
        byte, bit = divmod(d, 8)
        if byte >= width:
            break
        size = width - byte
        same = np.zeros(size * 8, np.uint8)
        same[: n - d] = group[: n - d] == group[d:]
        if not same.any():
            break
        out = ~np.packbits(same, bitorder="little")

        def difference(k: int, byte: int = byte, bit: int = bit, size: int = size) -> np.ndarray:
            row = planes[k]
            moved = row[byte:] >> bit
            if bit:
                moved = moved.copy()
                moved[:-1] |= row[byte + 1 :] << (8 - bit)
            return row[:size] ^ moved

        near = _distances(difference, (size,), radius, np.uint8, out)
        if near is not None:
            i = np.flatnonzero(np.unpackbits(near, bitorder="little"))
            left.append(i)
            right.append(i + d)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def least_label(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each node's component, for links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _forest(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least of its component) within the groups of sorted rows."""
    _, begin, inverse, size = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
    little = size[inverse] <= SMALL
    out_a, out_b = [], []
    if little.any():
        own, own_group = fps[little], group[little]
        label = least_label(len(own), *near_by_shifts(own, own_group, radius))
        hit = label != np.arange(len(own))
        out_a.append(own[hit])
        out_b.append(own[label[hit]])
    for k in np.flatnonzero(size > SMALL):
        own = np.unique(fps[begin[k] : begin[k] + size[k]])
        label = near_within(own, radius)
        hit = label != np.arange(len(own))
        out_a.append(own[hit])
        out_b.append(own[label[hit]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def choose_blocks(n: int, radius: int) -> int:
    """Blocks of the 64 bits: the fewest whose buckets hold about BUCKET of n even fingerprints."""
    for blocks in range(radius + 1, radius + 6):
        if n >> (64 // blocks * (blocks - radius)) <= BUCKET:
            return blocks
    return radius + 5


def bucket_masks(blocks: int, radius: int) -> list[int]:
    """Masks of all choices of blocks on which two near fingerprints may agree."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    own = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(c) for c in combinations(own, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Links a-b that connect all of the distinct ``fp`` within the radius, directly or in steps."""
    spark = fps.sparkSession
    blocks = blocks or choose_blocks(fps.count(), radius)
    masks = bucket_masks(blocks, radius)
    bucket = F.explode(F.array(*[F.struct(F.lit(i).alias("way"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    rows = fps.select("fp", bucket.alias("at")).select("fp", "at.*")
    sizes = rows.groupBy("way", "key").count().where("count > 1")
    chunks = F.ceil(F.col("count") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    placed = rows.join(sizes.select("way", "key", chunks.alias("chunks")), ["way", "key"]).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    met = placed.select("fp", "way", "key", "own", other).select(
        "fp", "way", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)], axis=1)
            rows = np.concatenate([*held, rows])
            changes = np.any(rows[1:, 1:] != rows[:-1, 1:], axis=1)
            cuts = np.flatnonzero(changes) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            if last:
                group = np.concatenate([[0], np.cumsum(changes)])[:last]
                a, b = _forest(np.ascontiguousarray(rows[:last, 0]).view(np.uint64), group, radius)
                yield _links(a, b)
            held = [rows[last:]]
        if held and len(held[0]):
            yield _links(*_forest(np.ascontiguousarray(held[0][:, 0]).view(np.uint64), np.zeros(len(held[0]), np.int64), radius))

    keys = ["way", "key", "i", "j"]
    dealt = met.repartition(common.partitions(spark), *keys).sortWithinPartitions(*keys, "fp")
    return dealt.select("fp", *[F.col(k).cast("long") for k in keys]).mapInArrow(run, "a long, b long")


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def group_fingerprints(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp and component_id (smallest doc_id of the component) of every distinct ``fp`` of rows
    (doc_id, fp)."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")).checkpoint()
    found = components(near_links(nodes.select("fp"), radius))
    labelled = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least_id", F.coalesce("least", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("least_id").alias("component_id")).checkpoint()
    return labelled.join(ids, "root").select("fp", "component_id")


def simhash_groups(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of every row."""
    common.shared_folder(docs.sparkSession)
    fps = fingerprints(docs, words, seed).checkpoint()
    groups = group_fingerprints(fps, radius)
    return fps.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, seed: int = SEED, near: bool = False) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that of the smallest doc_id (null
    last), then of the smallest text hash.  With ``near``, texts whose shingles of five words have a
    Jaccard similarity of at least 0.8 are linked too."""
    common.shared_folder(docs.sparkSession)
    a, b = F.xxhash64(common.text_of()), F.xxhash64(F.lit("second"), common.text_of())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for batch in batches:
            fps, s1, s2, keys = [], [], [], []
            for t in batch.column(3):
                text = t.as_py()
                fps.append(fingerprint(text, words, seed))
                if near:
                    own = near_copies.shingles(text)
                    x, y = near_copies.digest(own)
                    s1.append(x)
                    s2.append(y)
                    keys.append(near_copies.band_keys(own))
            more = [pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))] if near else []
            out = [*batch.columns[:3], pa.array(np.array(fps, np.uint64).view(np.int64)), *more]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "a", "b", "fp", "s1", "s2", "keys"][: len(out)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), a.alias("a"), b.alias("b"), common.text_of().alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, a long, b long, fp long" + ", s1 long, s2 long, keys array<long>" * near).checkpoint()
    marked = docs.withColumn("__aw_a", a).withColumn("__aw_b", b).withColumn("__aw_id", common.id_key())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")).alias("first")
    nodes = rows.groupBy("fp").agg(first)
    links = near_links(nodes.select("fp"), radius)
    found = components(links.unionByName(near_copies.links(rows, marked)) if near else links)
    kept = (
        nodes.join(found, nodes["fp"] == found["node"], "left")
        .groupBy(F.coalesce("least", "fp").alias("root"))
        .agg(F.min("first").alias("first"))
        .select(common.id_key("first.doc_id").alias("__aw_id"), F.col("first.a").alias("__aw_a"), F.col("first.b").alias("__aw_b"))
    )
    # a row that is there several times, id and text alike, is kept once; the join finds the rows dealt as it needs them
    keys = ["__aw_a", "__aw_b", "__aw_id"]
    out = marked.dropDuplicates(keys).join(kept, keys, "left_semi")
    return out.select(*[f"`{c}`" for c in docs.columns])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(common.table(spark, sf_dir, "documents"))
