"""Near-duplicate vectors by an exact metric range join.

Vectors with the same label and the same components are one node with a weight.  On unit vectors a
cosine of at least ``least`` is a Euclidean distance of at most r.  Pivots, chosen farthest first
from a bounded sample of each label of some size, partition the label's nodes: a node is at home at its
nearest pivot c.  By the triangle inequality a node x within r of a node at home at pivot p lies within
R(p) + r of p, at least as far as the nearest node at home there less r, and at most d(x, c) + 2 r away
from p (R: the largest distance at home); and it lies at most r from the plane half-way between c and p.
Only if all of this holds, and for one of c and p only, is it replicated to p.  How many pivots are
taken follows from the replication and the comparisons that the sample shows.

Cells are joined independently, one that is larger than ``BLOCK`` in parts that meet in pairs.  A task
holds a part's ``BLOCK`` vectors and streams the replicated ones past them; it tells each vector's number
of links there and one link to hold its component together, never all pairs.  Products are
made in single precision; what is within ``_BAND`` of the bound is decided in double precision.

Rows: a vector that is null or zero, or holds null or non-finite components, and one whose label
is null, links with nothing; so do vectors of different lengths; null vec_id counts as a vector but gives
no component id; repeated rows link with each other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash import least_label
from .vectors import usable

LEAST = 0.93
#: Vectors that a task holds, about.
BLOCK = 8192
#: Vectors for one pivot, at least; pivots of all labels together, and of one label, at most.
CELL, PIVOTS, OF_LABEL = 512, 4096, 512
#: Rows of a label that its pivots are chosen from, at most.
SAMPLE = 4096
#: Operations that sending a vector is worth, when pivots are chosen.
_SENT = 60_000
#: Slack of the bounds, above rounding; it only adds candidates.
_SLACK = 1e-6
_BAND = 1e-5


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * u @ pivots.T))


def sent_to(c, p):
    """Whether pairs of cells c and p are met in p."""
    return ((c + p) % 2 == 0) == (c < p)


def replicated(d: np.ndarray, home: np.ndarray, between: np.ndarray, inner: np.ndarray, outer: np.ndarray, r: float) -> np.ndarray:
    """Which vectors go to which further cells: ``d`` their distances from the pivots, ``between`` those of
    the pivots from each other, ``inner`` and ``outer`` the least and largest distance at home."""
    own = d[np.arange(len(d)), home][:, None]
    apart = 2 * between[home]
    near = (d <= outer + r) & (d >= inner - r) & (d <= own + 2 * r) & (d**2 - own**2 <= r * apart + _SLACK)
    return near & sent_to(home[:, None], np.arange(d.shape[1])[None])


def choose(v: np.ndarray, n: int, most: int, r: float) -> np.ndarray:
    """Pivots for ``n`` vectors from a sample of them: farthest first, as many as cost least."""
    u = unit(v)
    most = int(min(most, OF_LABEL, n // CELL, len(u)))
    chosen, near = [0], u @ u[0]
    while len(chosen) < most:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, u @ u[chosen[-1]])
    d = distances(u, u[chosen])
    best, scale, k = (np.inf, 1), n / len(u), 1
    while k <= most:
        own = d[:, :k]
        home = own.argmin(1)
        near = own[np.arange(len(u)), home]
        count = np.bincount(home, minlength=k)
        outer, inner = np.zeros(k), np.full(k, np.inf)
        np.maximum.at(outer, home, near)
        np.minimum.at(inner, home, near)
        more = replicated(own, home, distances(u[chosen[:k]], u[chosen[:k]]), inner, outer, r)
        cost = scale * (len(u) + more.sum()) * _SENT + scale**2 * float((count * (count + more.sum(0))).sum()) * 2 * u.shape[1]
        best = min(best, (cost, k))
        k *= 2
    return u[chosen[: best[1]]]


class Part:
    """The vectors that a task holds, and what is streamed past them."""

    def __init__(self, least: float):
        self.least, self.held = least, []
        self.ready = False

    def hold(self, keys: np.ndarray, weight: np.ndarray, v: np.ndarray) -> None:
        self.held.append((keys, weight, v))

    def _prepare(self) -> None:
        self.keys, self.weight, self.v = (np.concatenate(c) for c in zip(*self.held, strict=True)) if self.held else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros((0, 0)))
        self.u = unit(self.v).astype(np.float32) if len(self.v) else self.v
        self.links, self.label = np.zeros(len(self.keys), np.int64), np.arange(len(self.keys))
        self.ready = True
        for a in range(0, len(self.keys), 512):
            near = self._near(self.u[a : a + 512], self.v[a : a + 512])
            near[np.arange(len(near)), a + np.arange(len(near))] = True
            self.links[a : a + 512] = near @ self.weight
            own = near.copy()
            own[:, a + 512 :] = False  # a pair joins its components once
            self._join(own)

    def _near(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        c = u @ self.u.T
        near = c >= self.least
        i, j = np.nonzero(np.abs(c - self.least) < _BAND)
        if len(i):
            near[i, j] = [exact(v[x], self.v[y], self.least) for x, y in zip(i, j, strict=True)]
        return near

    def _join(self, near: np.ndarray) -> None:
        """Vectors that one streamed vector links with are of one component."""
        for a in range(0, len(near), 64):
            i, j = np.nonzero(near[a : a + 64])
            if not len(i):
                continue
            own = self.label[j]
            begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            least = np.repeat(np.minimum.reduceat(own, begin), np.diff(np.r_[begin, len(i)]))
            other = own != least
            if other.any():
                pairs = np.unique(np.stack([own[other], least[other]], 1), axis=0)
                self.label = least_label(len(self.label), pairs[:, 0], pairs[:, 1])[self.label]

    def meet(self, keys: np.ndarray, weight: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        """Links of streamed vectors here, and one vector that each links with."""
        if not self.ready:
            self._prepare()
        to, links = keys.copy(), np.zeros(len(keys), np.int64)
        if len(self.keys):
            u = unit(v).astype(np.float32)
            for a in range(0, len(keys), 512):
                near = self._near(u[a : a + 512], v[a : a + 512])
                links[a : a + 512] = near @ self.weight
                self.links += weight[a : a + 512] @ near
                self._join(near)
                some = near.any(axis=1)
                to[a : a + 512][some] = self.keys[near.argmax(axis=1)[some]]
        return _told(keys, links, to)

    def told(self) -> pd.DataFrame:
        if not self.ready:
            self._prepare()
        return _told(self.keys, self.links, self.keys[self.label])


def _told(keys: np.ndarray, links: np.ndarray, to: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"h1": keys[:, 0], "h2": keys[:, 1], "links": links, "g1": to[:, 0], "g2": to[:, 1]})


def exact(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(np.dot(x, y)) / (float(np.sqrt(np.dot(x, x))) * float(np.sqrt(np.dot(y, y)))) >= least


def range_join(vectors: DataFrame, least: float = LEAST, key: str = "vec_id") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    common.shared_folder(spark)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), "embedding", "label").select("*", (F.col("label").isNotNull() & usable(vectors)).alias("ok"))
    own = [F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit("second"), "label", "embedding").alias("h2")]
    rows = rows.select("vec_id", "ok", "label", "embedding", *own)
    # Equal vectors are one node; the hashes have 128 bits together.  -0.0 and 0.0 stay two nodes.
    nodes = (
        rows.where("ok")
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least_id"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .select("h1", "h2", "weight", "least_id", F.xxhash64("label").alias("l1"), F.xxhash64(F.lit("second"), "label").alias("l2"), F.size("embedding").alias("dim"), "embedding")
        .checkpoint()
    )
    r = float(np.sqrt(max(0.0, 2 - 2 * least))) + _SLACK
    label = ["l1", "l2", "dim"]

    # pivots of labels that are large enough: PIVOTS together, so as many labels at most
    sizes = nodes.groupBy(*label).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).head()[0] or 0
    large = sizes.where(F.col("n") >= max(2 * CELL, 2 * total // PIVOTS))
    picked = nodes.join(F.broadcast(large), label).withColumn("nth", F.row_number().over(W.partitionBy(*label).orderBy("h1", "h2"))).where(F.col("nth") <= SAMPLE)

    def pivots_of(own: pd.DataFrame) -> pd.DataFrame:
        n = int(own["n"].iloc[0])
        found = choose(_stack(own["embedding"]), n, max(1, PIVOTS * n // max(1, total)), r)
        first = own.iloc[[0] * len(found)]
        return pd.DataFrame({**{c: first[c].to_numpy() for c in label}, "cell": np.arange(len(found)), "pivot": [p.tobytes() for p in found]})

    pivots: dict[tuple, list] = {}
    for p in picked.groupBy(*label).applyInPandas(pivots_of, "l1 long, l2 long, dim int, cell int, pivot binary").orderBy(*label, "cell").collect():
        pivots.setdefault((p["l1"], p["l2"], p["dim"]), []).append(np.frombuffer(p["pivot"]))
    sent = spark.sparkContext.broadcast({k: np.stack(v) for k, v in pivots.items() if len(v) > 1})  # PIVOTS vectors at most

    number = np.dtype(np.float32 if dict(nodes.dtypes)["embedding"] == "array<float>" else np.float64)

    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell, far = np.zeros(len(f), np.int32), np.zeros(len(f))
            v = [np.asarray(x, np.float64) for x in f["embedding"]]
            for at, rows in f.groupby(label).indices.items():
                p = sent.value.get(at)
                if p is not None:
                    d = distances(unit(np.stack([v[k] for k in rows])), p)
                    cell[rows] = d.argmin(1)
                    far[rows] = d.min(1)
            yield f[["h1", "h2", "weight", *label]].assign(cell=cell, far=far, vector=[x.astype(number).tobytes() for x in v])

    kinds = "h1 long, h2 long, weight long, l1 long, l2 long, dim int, cell int, far double, vector binary"
    placed = nodes.select("h1", "h2", "weight", *label, "embedding").mapInPandas(home, kinds).checkpoint()
    cells = placed.groupBy(*label, "cell").agg(F.min("far").alias("inner"), F.max("far").alias("outer"), F.count(F.lit(1)).alias("n")).checkpoint()
    radii: dict[tuple, dict] = {}
    for c in cells.join(F.broadcast(large.select(*label)), label).collect():  # PIVOTS rows, and one for a label without pivots
        radii.setdefault((c["l1"], c["l2"], c["dim"]), {})[c["cell"]] = (c["inner"], c["outer"])
    reach = spark.sparkContext.broadcast(radii)

    def replicate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(at=f["cell"])
            for at, rows in f.groupby(label).indices.items():
                p = sent.value.get(at)
                if p is None:
                    continue
                own = f.iloc[rows]
                none = (np.inf, -np.inf)  # nothing is at home there
                inner, outer = np.array([reach.value[at].get(c, none) for c in range(len(p))]).T
                u = unit(np.stack([np.frombuffer(x, number) for x in own["vector"]]))
                i, c = np.nonzero(replicated(distances(u, p), own["cell"].to_numpy(), distances(p, p), inner, outer, r))
                yield own.iloc[i].assign(at=c)

    # a large cell in parts: a vector is held by one, and streamed past those of the others that meet it there
    met = placed.mapInPandas(replicate, f"{kinds}, at int").join(cells.select(*label, F.col("cell").alias("at"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), [*label, "at"])
    mine = F.pmod("h1", "parts").cast("int")
    dealt = (
        met.withColumn("mine", F.when(F.col("cell") == F.col("at"), mine).otherwise(-1))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        .withColumn("held", F.col("mine") == F.col("part"))
        .where(F.col("held") | (F.col("mine") < 0) | (((F.col("mine") + F.col("part")) % 2 == 0) == (F.col("mine") < F.col("part"))))
        .select("h1", "h2", "weight", *label, "at", "part", F.when(F.col("held"), 0).otherwise(1).alias("kind"), "vector")
        .repartition(common.partitions(spark), *label, "at", "part")
        .sortWithinPartitions(*label, "at", "part", "kind", "h1", "h2")
    )

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, part = None, None
        for f in frames:
            for key, own in f.groupby([*label, "at", "part"], sort=True):
                if key != at:
                    if part is not None:
                        yield part.told()
                    at, part = key, Part(least)
                for kind, some in own.groupby("kind", sort=True):
                    args = some[["h1", "h2"]].to_numpy(np.int64), some["weight"].to_numpy(np.int64), np.stack([np.frombuffer(x, number) for x in some["vector"]]).astype(np.float64)
                    if kind == 0:
                        part.hold(*args)
                    else:
                        yield part.meet(*args)
        if part is not None:
            yield part.told()

    made = dealt.mapInPandas(join, "h1 long, h2 long, links long, g1 long, g2 long").checkpoint()
    counts = made.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    links = made.select(F.struct("h1", "h2").alias("a"), F.struct(F.col("g1").alias("h1"), F.col("g2").alias("h2")).alias("b"))
    found = components(links.where("a <> b"))
    state = nodes.select(F.struct("h1", "h2").alias("node"), "least_id").join(found, "node", "left").select("node", "least_id", F.coalesce("least", "node").alias("root"))
    # plain sides of joins, so that Spark can split the rows of a large component or of one vector
    ids = state.groupBy("root").agg(F.min("least_id").alias("component_id")).checkpoint()
    state = state.join(ids, "root").select("node.h1", "node.h2", "component_id").join(counts, ["h1", "h2"]).checkpoint()
    out = rows.select("vec_id", "ok", "h1", "h2").join(state, ["h1", "h2"], "left")
    alone = ~F.col("ok")
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.when(alone, F.lit(0)).otherwise(F.col("links") - 1).cast("long").alias("n_links"),  # a vector doesn't link with itself
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op5_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(common.table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         AND list_inner_product(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
