"""Codes of integer vectors: Lloyd's rounds with Hamerly's bounds, one codebook for each part.

A component x becomes floor(256 x).  Vectors are cut into ``PARTS`` equal consecutive parts; the codebook
of a part starts as that part of the ``ENTRIES`` smallest kept ids.  A round assigns every part to its
nearest entry (squared Euclidean distance, ties to the lower index) and replaces every entry by its
parts' floor(sum / count); unused entries stay.  After the rounds the parts are assigned again.

Each part of each vector keeps its entry, an upper bound of the distance to it and a lower bound of the
distance to any other entry (the second nearest when it was last looked at), written with the vector
after every assignment.  When entries move, the upper bound grows by how far the own entry went and
the lower shrinks by how far any other went.  Only where the upper bound, first as kept and then
measured anew, isn't strictly below the lower one are all entries compared, in whole numbers; a tie
therefore always reaches the comparison, which prefers the lower index.  Bounds are single precision,
rounded away from each other, so that rounding can't hide a tie.

The driver holds the codebooks, ``ENTRIES`` times the dimension; sums come from one pass over what
was written, ``ENTRIES`` times the dimension of numbers a task.  Label sums are a plain side of their join.

Rows: vectors that are null or hold null or non-finite components are dropped, and so are those of
another length than most (of several lengths as frequent, the longest stays); zero vectors stay; a length that
``PARTS`` doesn't divide is filled up with zeros; a null id comes after all others; repeated ids are
separate rows, of which the least vector comes first; with fewer rows than ``ENTRIES`` a codebook has as
many entries as there are rows; an empty table gives an empty result; other columns are ignored.
Components beyond ``LARGEST`` in absolute value raise an error: their distances leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .vectors import matrix

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Absolute value of a component, at most; 256 times it squares and sums within 64 bits, whatever the dimension.
LARGEST = 1 << 16
#: Rows compared at once.
BLOCK = 8192
_STATE = "vec_id long, label string, ints binary, entry binary, upper binary, lower binary"


def kept(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Condition: the vector is there and all of its components are finite numbers."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))


def integers(x: np.ndarray) -> np.ndarray:
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST}")
    return np.floor(SCALE * x).astype(np.int64)


def parted(ints: np.ndarray, parts: int) -> np.ndarray:
    """(vector, part, component); filled up with zeros."""
    fill = -ints.shape[1] % parts
    if fill:
        ints = np.concatenate([ints, np.zeros((len(ints), fill), ints.dtype)], 1)
    return ints.reshape(len(ints), parts, -1)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c in whole numbers.  Doubles are used where every
    product and sum fits them exactly."""
    bound = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * x.shape[1] * int(bound) ** 2 < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return ((x[:, None, :] - c) ** 2).sum(2)


def above(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf))


def look(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lowest of equals), and bounds: its distance and the second nearest's."""
    entry, upper, lower = np.empty(len(x), np.uint8), np.empty(len(x), np.float32), np.full(len(x), np.inf, np.float32)
    for k in range(0, len(x), BLOCK):
        d = squared(x[k : k + BLOCK], book)
        rows, at = np.arange(len(d)), d.argmin(1)
        entry[k : k + BLOCK], upper[k : k + BLOCK] = at, above(np.sqrt(d[rows, at].astype(np.float64)))
        if len(book) > 1:
            d[rows, at] = np.iinfo(np.int64).max
            lower[k : k + BLOCK] = below(np.sqrt(d.min(1).astype(np.float64)))
    return entry, upper, lower


def moved(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry went, at most, and how far any other went, at most."""
    drift = above(np.sqrt(((new - old).astype(np.float64) ** 2).sum(1)))
    drift[(new == old).all(1)] = 0
    if len(drift) < 2:
        return drift, np.zeros_like(drift)
    first, second = drift.argmax(), np.partition(drift, -2)[-2]
    others = np.full_like(drift, drift[first])
    others[first] = second
    return drift, others


def step(x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Assignment and bounds of one part after its entries moved; the last number counts the rows
    that were compared with all entries."""
    drift, others = moved(old, new)
    entry, upper, lower = entry.copy(), above(upper + drift[entry].astype(np.float64)), below(lower - others[entry].astype(np.float64))
    open_ = np.flatnonzero(~(upper < lower))
    own = new[entry[open_]]
    upper[open_] = above(np.sqrt(((x[open_] - own).astype(np.float64) ** 2).sum(1)))
    open_ = open_[~(upper[open_] < lower[open_])]
    entry[open_], upper[open_], lower[open_] = look(x[open_], new)
    return entry, upper, lower, len(open_)


def _binary(column, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _bytes(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.array([r.tobytes() for r in x], pa.binary())


def _first(books: list[np.ndarray], parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = parted(integers(matrix(batch.column(2))), parts)
            made = [look(x[:, p], books[p]) for p in range(parts)]
            yield _state_batch(batch.column(0), batch.column(1), _bytes(x.reshape(len(x), -1).astype(np.int32)), made)

    return run


def _state_batch(ids, labels, ints, made) -> pa.RecordBatch:
    stacked = [np.stack([m[k] for m in made], 1) for k in range(3)]
    return pa.RecordBatch.from_arrays([ids, labels, ints, *map(_bytes, stacked)], names=["vec_id", "label", "ints", "entry", "upper", "lower"])


def _again(old: list[np.ndarray], new: list[np.ndarray], parts: int, dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, made = advanced(batch, old, new, parts, dim)
            yield _state_batch(batch.column(0), batch.column(1), batch.column(2), made)

    return run


def advanced(batch: pa.RecordBatch, old, new, parts: int, dim: int):
    x = _binary(batch.column(2), np.int32, dim).astype(np.int64).reshape(batch.num_rows, parts, -1)
    entry, upper, lower = (_binary(batch.column(k), t, parts) for k, t in ((3, np.uint8), (4, np.float32), (5, np.float32)))
    return x, [step(x[:, p], entry[:, p], upper[:, p], lower[:, p], old[p], new[p]) for p in range(parts)]


def _sums(parts: int, dim: int, entries: int) -> Callable:
    """Of a task: count and componentwise sums of each entry of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = dim // parts
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            x = _binary(batch.column(0), np.int32, dim).astype(np.int64).reshape(batch.num_rows, parts, -1)
            entry = _binary(batch.column(1), np.uint8, parts)
            for p in range(parts):
                order = np.argsort(entry[:, p], kind="stable")
                at = entry[order, p]
                begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
                if len(begins):
                    total[p, at[begins], 1:] += np.add.reduceat(x[order, p], begins, axis=0)
                    total[p, :, 0] += np.bincount(at, minlength=entries)
        p, e, k = np.nonzero(total)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()) for a in (p, e, k)] + [pa.array(total[p, e, k])], names=["part", "entry", "at", "value"])

    return run


def updated(state: DataFrame, books: list[np.ndarray], parts: int) -> list[np.ndarray]:
    """The codebooks after one round's means; at most entries x (dimension + parts) sums reach the driver."""
    width = books[0].shape[1]
    sums = state.select("ints", "entry").mapInArrow(_sums(parts, parts * width, len(books[0])), "part int, entry int, at int, value long")
    total = np.zeros((parts, len(books[0]), width + 1), np.int64)
    for r in sums.groupBy("part", "entry", "at").agg(F.sum("value").alias("value")).collect():
        total[r.part, r.entry, r.at] = r.value
    out = [b.copy() for b in books]
    for p in range(parts):
        used = total[p, :, 0] > 0
        out[p][used] = total[p, used, 1:] // total[p, used, :1]  # numpy's integer division goes down
    return out


def first_books(vectors: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    x = parted(integers(np.array([r.v for r in rows], np.float64)), parts)
    return [x[:, p].copy() for p in range(parts)]


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``vectors`` (vec_id, embedding, label) -> rows vec_id, label, code (one byte a part) and error, and
    the codebooks.  At least one round; at most 256 entries."""
    spark = vectors.sparkSession
    own = kept(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    lengths = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    out = "vec_id long, label string, code binary, error long"
    if lengths is None:
        return spark.createDataFrame([], out), []
    own = own.where(F.size("v") == lengths.d)
    books = first_books(own, parts, entries)
    dim = parts * books[0].shape[1]
    state = common.written(own.select("vec_id", "label", "v").mapInArrow(_first(books, parts), _STATE), "vector-codes")
    for k in range(rounds):
        old, books = books, updated(state, books, parts)
        if k < rounds - 1:
            state = common.written(state.mapInArrow(_again(old, books, parts, dim), _STATE), "vector-codes")

    def final(batches: Iterator[pa.RecordBatch], old=old, new=books) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, made = advanced(batch, old, new, parts, dim)
            error = sum(((x[:, p] - new[p][made[p][0]]) ** 2).sum(1) for p in range(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _bytes(np.stack([m[0] for m in made], 1)), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return state.mapInArrow(final, out), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, their errors, and the errors summed over equal labels."""
    coded, books = compress(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    coded = common.written(coded, "vector-codes-final")
    # counts of labels are a plain side of the join, so that Spark can split a hot label's rows
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")).checkpoint()
    return coded.join(total, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )


def oracle_sql(rounds: int = ROUNDS) -> str:
    """The same rounds as one statement; every assignment compares all entries."""
    ctes = [
        """kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"parts AS (SELECT r, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS x FROM kept, range({PARTS}) AS t(p))",
        f"book0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES})",
    ]
    for k in range(rounds + 1):
        ctes.append(
            f"""near{k} AS (SELECT a.r, a.p, min_by(b.e, list_value(list_sum([(a.x[i] - b.c[i]) * (a.x[i] - b.c[i]) FOR i IN range(1, len(a.x) + 1)]), b.e)) AS e,
  CAST(min(list_sum([(a.x[i] - b.c[i]) * (a.x[i] - b.c[i]) FOR i IN range(1, len(a.x) + 1)])) AS BIGINT) AS d FROM parts a JOIN book{k} b USING (p) GROUP BY a.r, a.p)"""
        )
        if k < rounds:
            ctes.append(
                f"""sums{k} AS (SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM parts JOIN near{k} USING (r, p), range(1, 1025) AS t(i) WHERE i <= len(x) GROUP BY p, e, i)"""
            )
            ctes.append(f"book{k + 1} AS (SELECT b.p, b.e, coalesce(s.c, b.c) AS c FROM book{k} b LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS c FROM sums{k} GROUP BY p, e) s USING (p, e))")
    last = rounds
    ctes.append(f"coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{last} GROUP BY r)")
    ctes.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last})")
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256\nFROM coded JOIN kept USING (r), digest"
    )


ORACLE_SQL = oracle_sql()
