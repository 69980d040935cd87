"""Near-copies by word shingles: MinHash bands for candidates, exact Jaccard similarity for links.

A text's shingles are a set of hashes.  ``BANDS`` keys of ``ROWS`` minima each put sets into buckets;
two sets of similarity s share none of them with probability (1 - s^ROWS)^BANDS, under 3 in 100,000 at
0.8.  Sets that meet in a bucket are compared by exact counts of common shingles; buckets of the same
members are one.  Equal sets are one
node.  A bucket of more than ``CHUNK`` nodes is dealt to tasks as pairs of its chunks, and a task
returns a forest of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 5
SEED = 42
#: Similarity from which two texts are near-copies: NEAR / OF.
NEAR, OF = 4, 5
BANDS, ROWS = 20, 4
#: Nodes of a bucket that one task compares with each other.
CHUNK = 256
#: Shingles of one step of a comparison.
_STEP = 4096

_FLIPS, _FACTORS = np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_FACTORS |= np.uint64(1)


def shingles(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, of the whole row if it has fewer words."""
    tokens = text.encode().lower().split()  # as in ``simhash.fingerprint``
    digest = xxhash.xxh64_intdigest
    n = max(1, len(tokens) - words + 1) if tokens else 0
    return np.unique(np.fromiter((digest(b" ".join(tokens[k : k + words]), seed) for k in range(n)), np.uint64, n))


def band_keys(own: np.ndarray) -> list[int]:
    """Keys of the buckets of a set; none for the empty set."""
    if not len(own):
        return []
    least = np.min([((own[k : k + 4096, None] ^ _FLIPS) * _FACTORS).min(axis=0) for k in range(0, len(own), 4096)], axis=0)
    keys = [xxhash.xxh64_intdigest(r.tobytes()) for r in least.reshape(BANDS, ROWS)]
    return [k - (1 << 64) if k >= 1 << 63 else k for k in keys]


def digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
    return int(a), int(b)


def near_sets(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets have a similarity of at least NEAR / OF; counts are exact."""
    size = np.array([len(s) for s in sets], np.int64)
    _, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    common_to = seen > 1  # the others are in no intersection of two
    place = np.cumsum(common_to) - 1
    row, at = row[common_to[at]], place[at[common_to[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for k in range(0, int(common_to.sum()), _STEP):
        a, b = np.searchsorted(at, [k, k + _STEP])
        m = np.zeros((len(sets), _STEP), np.float32)
        m[row[a:b], at[a:b] - k] = 1
        both += (m @ m.T).astype(np.int64)
    return OF * both >= NEAR * (size[:, None] + size[None, :] - both)


def _forest(fps: list[int], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    from .simhash import least_label

    a, b = np.nonzero(np.triu(near_sets(sets), 1))
    label = least_label(len(sets), a, b)
    own = np.array(fps, np.int64)
    hit = own != own[label]
    return own[hit], own[label[hit]]


def links(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Links a-b of fingerprints that connect all near-copies, directly or in steps.  ``rows``: doc_id,
    a, b (hashes of the text), fp, s1, s2 (digest of the set), keys; ``docs``: __aw_id, __aw_a, __aw_b, text."""
    spark = rows.sparkSession
    node = ["fp", "s1", "s2"]
    nodes = (
        rows.where("size(keys) > 0").groupBy(*node).agg(F.min(F.struct("a", "b", "doc_id")).alias("first"), F.min("keys").alias("keys")).checkpoint()
    )
    at = nodes.select(*node, F.posexplode("keys").alias("way", "key"))
    chunks = F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")
    members = [F.bit_xor(F.xxhash64(*more, *node)).alias(n) for n, more in (("x1", []), ("x2", [F.lit("second")]))]
    sizes = at.groupBy("way", "key").agg(F.count(F.lit(1)).alias("count"), *members).where("count > 1")
    # buckets of the same members, by 128 bits, are compared once
    sizes = sizes.groupBy("count", "x1", "x2").agg(F.min(F.struct("way", "key")).alias("first")).select("first.way", "first.key", chunks).checkpoint()
    placed = at.join(sizes, ["way", "key"]).withColumn("own", F.pmod(F.xxhash64(*node), F.col("chunks")).cast("int")).checkpoint()

    asked = nodes.join(placed.select(*node).distinct(), node, "left_semi").select(*node, F.col("first.a").alias("a"), F.col("first.b").alias("b"), common.id_key("first.doc_id").alias("id"))
    asked = asked.checkpoint()
    docs = docs.select("__aw_id", "__aw_a", "__aw_b", common.text_of().alias("text"))
    same = (docs["__aw_a"] == asked["a"]) & (docs["__aw_b"] == asked["b"]) & (docs["__aw_id"] == asked["id"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([shingles(t.as_py()).tobytes() for t in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], own], names=[*node, "own_set"])

    sets = docs.join(asked, same).select(*node, "text").mapInArrow(sets_of, "fp long, s1 long, s2 long, own_set binary")
    sets = sets.dropDuplicates(node).checkpoint()

    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    met = placed.select(*node, "way", "key", "own", other).select(*node, "way", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    keys = ["way", "key", "i", "j"]
    dealt = met.join(sets, node).select("fp", "own_set", *keys).repartition(common.partitions(spark), *keys).sortWithinPartitions(*keys, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fps, sets = None, [], []
        for batch in batches:
            found = []
            for fp, own, *key in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if key != group:
                    if len(fps) > 1:
                        found.append(_forest(fps, sets))
                    group, fps, sets = key, [], []
                fps.append(fp)
                sets.append(np.frombuffer(own, np.uint64))
            yield _told(found)
        if len(fps) > 1:
            yield _told([_forest(fps, sets)])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _told(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *[f[k] for f in found]])) for k in (0, 1)], names=["a", "b"])
