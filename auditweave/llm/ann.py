"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids (at most ``CELLS``) and the code books of the residuals are fitted on a bounded
sample (``SAMPLE`` rows of smallest hash); every row is indexed: its cell, its codes, what the codes
leave over in bytes of a scale of its own, and the length of what either leaves.  Equal vectors are one
entry that carries its ``k`` + 1 smallest distinct ids, all that a list of ``k`` neighbours can use.

Entries stay where their cell is: neighbouring cells form areas of about ``AREA`` entries, a larger
cell several areas.  A query is sent to the areas that hold a cell it looks up; a crowd of queries is
dealt in blocks of ``ASKING``.  There, entries of cells that are looked up are scored from the query's
distance tables; those that may be among the ``k`` + 1 nearest, by a bound of ``SURE`` standard deviations
of the codes' error, are scored again with the bytes, and those that still may be, by a strict bound, are
told.  No list has a fixed length, so a dense group just tells more.  What the ``k`` + 1 best of all areas
don't rule out is scored exactly, in double precision, on the original vectors.

How many cells a query looks up, and in which of three orders, follows from the recall that the sample
shows; cells that hold too few entries are made up for by more cells.

Rows: vectors that are null or zero, hold null or non-finite components, have no id, or are of
another length than most take no part; repeated rows of an id are one query, and never neighbours
of that id; an id is listed once, at its best; ties go to the smaller id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .vectors import usable

K = 20
#: Rows the index is fitted on, at most, and of these for code books.
SAMPLE, BOOK_SAMPLE = 32_768, 8_192
#: Centroids, at most, and rows of the sample for one.
CELLS, PER_CELL = 4096, 16
#: Components of one code.
SUB = 2
CODES = 256
#: Entries of an area, and queries of a block, about.
AREA, ASKING = 65_536, 65_536
#: Entries that make it worth sending a query, however many tasks there are.
LEAST_AREA = 512
#: Recall that the cells looked up are chosen for on the sample.
RECALL = 0.97
SURE = 3.0
#: Of single-precision products, as a share of the lengths' product.
ROUNDING = 1e-5


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        s = np.stack([np.bincount(at, x[:, d], len(c)) for d in range(x.shape[1])], 1)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([np.zeros(0, np.int64), *[(x[k : k + 4096] @ c.T - half).argmax(1) for k in range(0, len(x), 4096)]])


class Index:
    """Centroids and code books, how far to look, and where the cells are."""

    def __init__(self, sample: np.ndarray, n: int, k: int = K, recall: float = RECALL):
        self.dim, self.k = sample.shape[1], k
        x = sample.astype(np.float32)
        self.centroids = k_means(x, int(max(1, min(CELLS, 8 * n**0.5, len(x) / PER_CELL))))
        at = nearest(x, self.centroids)
        rest = self._padded(x - self.centroids[at])[:BOOK_SAMPLE]
        self.books = np.stack([np.pad(b := k_means(rest[:, s : s + SUB], CODES, 6), ((0, CODES - len(b)), (0, 0)), mode="edge") for s in range(0, rest.shape[1], SUB)])
        self.order, self.looked = 0, len(self.centroids)
        self.sizes = np.bincount(at, minlength=len(self.centroids)) * max(1.0, n / max(1, len(x)))
        self._calibrate(x, at, k, recall)

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % SUB)))

    def _orders(self, q: np.ndarray) -> list[np.ndarray]:
        """What cells may be ordered by: product, product with the direction, distance."""
        c = q @ self.centroids.T
        size = np.linalg.norm(self.centroids, axis=1)
        return [c, c / np.maximum(size, 1e-20), c - 0.5 * size**2]

    def _calibrate(self, x: np.ndarray, at: np.ndarray, k: int, recall: float) -> None:
        q = x[:: max(1, len(x) // 256)]
        k = min(k, len(x) - 1)
        if k < 1:
            return
        best = np.argpartition(-(q @ x.T), k, axis=1)[:, : k + 1]
        depths = []
        for c in self._orders(q):
            rank = np.argsort(np.argsort(-c, axis=1, kind="stable"), axis=1)
            needed = np.sort(np.take_along_axis(rank, at[best], 1).ravel())
            depths.append(int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1)
        self.order = int(np.argmin(depths))
        self.looked = depths[self.order]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and rows of bytes: codes, remainder, and three numbers (its scale, and what codes and
        remainder leave over, at most)."""
        size = np.linalg.norm(x, axis=1)
        x32 = x.astype(np.float32)
        at = nearest(x32, self.centroids)
        rest = self._padded(x32 - self.centroids[at])
        codes = np.stack([nearest(rest[:, s * SUB : (s + 1) * SUB], b) for s, b in enumerate(self.books)], 1).astype(np.uint8)
        coded = np.concatenate([b[codes[:, s]] for s, b in enumerate(self.books)], 1)[:, : self.dim]
        rest = x - self.centroids[at] - coded
        scale = np.maximum(np.abs(rest).max(axis=1) / 127, 1e-30).astype(np.float32)
        fine = np.rint(rest / scale[:, None]).astype(np.int8)
        left = np.linalg.norm(rest - fine * scale[:, None].astype(float), axis=1) + ROUNDING * size
        numbers = np.stack([scale, np.linalg.norm(rest, axis=1), left], 1).astype(np.float32)
        return at, np.concatenate([codes, fine.view(np.uint8), numbers.view(np.uint8)], axis=1)

    def cells(self, q: np.ndarray) -> np.ndarray:
        """Whether each query looks up each cell: ``looked`` cells, or more if they are nearly empty."""
        order = np.argsort(-self._orders(q)[self.order], axis=1, kind="stable")
        enough = (np.cumsum(self.sizes[order], axis=1) < 2 * (self.k + 1)).sum(axis=1) + 1
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, np.arange(order.shape[1]) < np.maximum(self.looked, enough)[:, None], 1)
        return out

    def lay_out(self, sizes: np.ndarray, tasks: int) -> None:
        """Areas of neighbouring cells: first area and number of areas of each cell."""
        self.sizes = sizes.astype(float)
        full = min(AREA, max(LEAST_AREA, -(-int(sizes.sum()) // tasks)))
        around = k_means(self.centroids, int(max(1, len(self.centroids) ** 0.5)), 6)
        self.first, self.parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        area, held = 0, 0
        for c in np.lexsort((np.arange(len(sizes)), nearest(self.centroids, around))):
            if held and held + sizes[c] > full:
                area, held = area + 1, 0
            self.first[c], self.parts[c] = area, max(1, -(-int(sizes[c]) // (2 * full)))
            held += sizes[c]
            if self.parts[c] > 1:
                area, held = area + int(self.parts[c]), 0
        self.areas = area + 1

    def asked_areas(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of query and area: the areas of the cells that a query looks up."""
        looked = self.cells(q)
        out = np.zeros((len(q), self.areas), bool)
        for part in range(int(self.parts.max())):
            own = np.flatnonzero(self.parts > part)
            i, c = np.nonzero(looked[:, own])
            out[i, self.first[own[c]] + part] = True
        return np.nonzero(out)


class Area:
    """The entries of an area, as they come, and what queries find among them."""

    def __init__(self, index: Index):
        self.index, self.held = index, []
        self.ready = None

    def add(self, cells: np.ndarray, keys: np.ndarray, rows: list[bytes]) -> None:
        self.held.append((cells, keys, np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)))
        self.ready = None

    def _arrays(self):
        if self.ready is None:
            cells, keys, raw = (np.concatenate(c) for c in zip(*self.held, strict=True))
            s, d = len(self.index.books), self.index.dim
            codes = np.ascontiguousarray(raw[:, :s].T)
            numbers = np.ascontiguousarray(raw[:, s + d :]).view(np.float32)
            self.held = [(cells, keys, raw)]
            self.ready = cells, keys, codes, np.ascontiguousarray(raw[:, s : s + d]).view(np.int8), *numbers.T
        return self.ready

    def near(self, query_ids: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        """What may be among the k + 1 nearest of each query here, with the most and the least that its
        product may be."""
        index, want = self.index, self.index.k + 1
        cells, keys, codes, fine, scale, rough, left = self._arrays()
        looked = index.cells(v)
        rows = np.flatnonzero(looked.any(axis=0)[cells])
        size = np.linalg.norm(v, axis=1)
        table = np.einsum("bsd,skd->sbk", index._padded(v).reshape(len(v), -1, SUB), index.books).astype(np.float32)
        to_cell = (v @ index.centroids.T).astype(np.float32)
        score = np.empty((len(v), len(rows)), np.float32)
        for a in range(0, len(rows), 4096):
            own = rows[a : a + 4096]
            part = to_cell[:, cells[own]]
            for s in range(len(codes)):
                part += np.take(table[s], codes[s, own], axis=1)
            part[~looked[:, cells[own]]] = -np.inf
            score[:, a : a + 4096] = part
        slack = (SURE / index.dim**0.5) * size[:, None] * rough[rows][None] + size[:, None] * left[rows][None]
        floor = np.partition(score - slack, -want, axis=1)[:, -want] if len(rows) > want else np.full(len(v), -np.inf)
        maybe = (score + slack >= floor[:, None]) & (score > -np.inf)
        out = []
        for b in range(len(v)):
            (j,) = np.nonzero(maybe[b])
            if not len(j):
                continue
            e = rows[j]
            fined = score[b, j] + (fine[e].astype(np.float32) @ v[b]) * scale[e]
            error = size[b] * left[e]
            least = float(np.partition(fined - error, -want)[-want]) if len(e) >= want else -np.inf
            keep = fined + error >= least
            e = e[keep]
            out.append((np.full(len(e), query_ids[b]), keys[e], (fined + error)[keep].astype(float), (fined - error)[keep].astype(float)))
        if not out:
            return _found([], np.zeros((0, 2), np.int64), [], [])
        return _found(*(np.concatenate(c) for c in zip(*out, strict=True)))


def _found(query_ids, keys, most, least) -> pd.DataFrame:
    return pd.DataFrame({"query_id": np.asarray(query_ids, np.int64), "h1": keys[:, 0], "h2": keys[:, 1], "most": np.asarray(most, float), "least": np.asarray(least, float)})


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``k`` nearest of ``vectors`` for every row of ``queries`` (both: vec_id, embedding):
    query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    common.shared_folder(spark)

    def clean(df: DataFrame) -> DataFrame:
        return df.where(usable(df) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim"))

    rows = clean(vectors)
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).head(1)
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims[0]["dim"]
    rows = rows.where(F.col("dim") == dim)
    same = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("second"), "embedding").alias("h2")]
    first = W.partitionBy("h1", "h2").orderBy("vec_id")
    entries = (
        rows.select("vec_id", "embedding", *same)
        .dropDuplicates(["h1", "h2", "vec_id"])
        .withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") <= k + 1)  # limited in each task before the shuffle
        .groupBy("h1", "h2")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding"))
        .checkpoint()
    )
    largest = F.max(F.array_max(F.transform("embedding", lambda c: F.abs(c.cast("double")))))
    n, top = entries.agg(F.count(F.lit(1)), largest).head()
    share = min(1.0, 1.5 * SAMPLE / max(1, n))  # of the hashes: so few rows are sorted
    sample = entries.where(F.col("h1") <= min(2**63 - 1, int((2 * share - 1) * 2**63))).orderBy("h1", "h2").limit(SAMPLE).select("embedding").toPandas()
    index = Index(_stack(sample["embedding"]) / top, n, k)
    rough = spark.sparkContext.broadcast(index)  # at most CELLS centroids

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell, raw = rough.value.encode(_stack(f["embedding"]) / top)
            yield pd.DataFrame({"h1": f["h1"], "h2": f["h2"], "cell": cell.astype(np.int32), "row": [r.tobytes() for r in raw]})

    coded = entries.select("h1", "h2", "embedding").mapInPandas(encode, "h1 long, h2 long, cell int, row binary").checkpoint()
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in coded.groupBy("cell").count().collect():  # at most CELLS rows
        sizes[r["cell"]] = r["count"]
    index.lay_out(sizes, common.partitions(spark))
    known = spark.sparkContext.broadcast(index)

    asked = clean(queries).where(F.col("dim") == dim).groupBy("vec_id").agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = known.value
        for f in frames:
            for a in range(0, len(f), 512):
                own = f.iloc[a : a + 512]
                v = (_stack(own["embedding"]) / top).astype(np.float32)
                i, area = index.asked_areas(v)
                rows = [r.tobytes() for r in v]
                yield pd.DataFrame({"area": area, "query_id": own["vec_id"].to_numpy()[i], "cell": nearest(v, index.centroids)[i].astype(np.int32), "row": [rows[x] for x in i]})

    routed = asked.mapInPandas(route, "area long, query_id long, cell int, row binary").checkpoint()
    # queries of an area in blocks: one row an area of about AREA entries reaches the driver
    blocks = {r["area"]: -(-r["count"] // ASKING) for r in routed.groupBy("area").count().collect()}
    most = spark.sparkContext.broadcast(blocks)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Entries to their area, once for each block of queries that it has."""
        index, blocks = known.value, most.value
        for f in frames:
            cell = f["cell"].to_numpy()
            area = index.first[cell] + (f["h1"].to_numpy() & 0x7FFFFFFF) % index.parts[cell]
            times = np.array([blocks.get(a, 0) for a in area.tolist()], np.int64)
            i = np.repeat(np.arange(len(f)), times)
            block = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
            yield f.iloc[i].assign(area=area[i], block=block, kind=0)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries of an area to one of its blocks."""
        for f in frames:
            share = np.array([most.value[a] for a in f["area"].tolist()], np.int64)
            yield pd.DataFrame({"h1": f["query_id"], "h2": 0, "cell": f["cell"], "row": f["row"], "area": f["area"], "block": f["mix"].to_numpy() % share if len(f) else share, "kind": 1})

    schema = "h1 long, h2 long, cell int, row binary, area long, block long, kind int"
    mixed = routed.withColumn("mix", F.pmod(F.xxhash64("query_id"), F.lit(1 << 31)))
    met = coded.mapInPandas(place, schema).unionByName(mixed.mapInPandas(deal, schema)).repartition(common.partitions(spark), "area", "block").sortWithinPartitions("area", "block", "kind", "cell", "h1", "h2")

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, area = None, None
        for f in frames:
            for key, own in f.groupby(["area", "block"], sort=True):
                if key != task:
                    task, area = key, Area(known.value)
                entries, asks = own[own["kind"] == 0], own[own["kind"] == 1]
                if len(entries):
                    area.add(entries["cell"].to_numpy(), entries[["h1", "h2"]].to_numpy(np.int64), list(entries["row"]))
                for a in range(0, len(asks) if area.held else 0, 64):
                    part = asks.iloc[a : a + 64]
                    yield area.near(part["h1"].to_numpy(np.int64), np.stack([np.frombuffer(r, np.float32) for r in part["row"]]))

    found = met.mapInPandas(look, "query_id long, h1 long, h2 long, most double, least double")
    # an entry counts if the most it may have reaches what k + 1 entries have at least
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("least"), "h1", "h2"))
    floor = F.max(F.when(F.col("nth") == k + 1, F.col("least"))).over(W.partitionBy("query_id"))
    listed = found.withColumn("nth", nth).withColumn("floor", floor).where("floor IS NULL OR most >= floor").select("query_id", "h1", "h2")
    exact = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)
    scored = (
        listed.join(entries, ["h1", "h2"])
        .join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
        .select("query_id", exact.alias("score"), F.explode("ids").alias("vec_id"))
        .where("vec_id <> query_id")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    nearest_first = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
