"""Following merge edges, closures and chains.

Loops run one join a level and cut the lineage with ``checkpoint()``, so depth and size are not
bound by the limits of a recursive statement; two numbers a level reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut


def single_parent(edges: DataFrame) -> DataFrame:
    """Of several parents of a node the largest id."""
    return edges.groupBy("from_id").agg(F.max("to_id").alias("to_id"))


def resolve(nodes: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node, canonical: edges followed to their end.  On a cycle the first repeated node is the
    end; with ``known`` ids, edges to others are not followed."""
    one = _followed(edges, known)
    ids = nodes.select(F.col("id").alias("node"))
    still = ids.join(one.select(F.col("from_id").alias("node")), "node", "left_anti").select("node", F.col("node").alias("canonical"))
    return still.unionByName(_walked(ids, one))


def resolve_moved(nodes: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``resolve`` of the nodes that have an edge to follow; all others are their own canonical ones."""
    return _walked(nodes.select(F.col("id").alias("node")), _followed(edges, known))


def _followed(edges: DataFrame, known: DataFrame | None) -> DataFrame:
    """One edge a node, made once for all levels of a walk."""
    one = single_parent(edges)
    if known is not None:
        one = one.join(known.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return cut(one.select("from_id", "to_id"))


def _walked(ids: DataFrame, one: DataFrame) -> DataFrame:
    linked = ids.join(one.select(F.col("from_id").alias("node")), "node", "left_semi")
    live = cut(linked.select("node", F.array("node").alias("path")))
    done = []
    while not live.isEmpty():
        step = live.join(one, F.element_at("path", -1) == one["from_id"], "left")
        again = F.array_contains("path", F.col("to_id"))
        step = cut(step.select("node", "path", "to_id", F.coalesce(again, F.lit(False)).alias("again")))
        done.append(step.where("to_id IS NULL").select("node", F.element_at("path", -1).alias("canonical")))
        done.append(step.where("again").select("node", F.col("to_id").alias("canonical")))
        live = step.where("to_id IS NOT NULL AND NOT again").select("node", F.concat("path", F.array("to_id")).alias("path"))
    out = live.select("node", F.element_at("path", -1).alias("canonical"))  # of no rows by now
    for d in done:
        out = out.unionByName(d)
    return out


def closure(edges: DataFrame, child: str, parent: str, of: DataFrame | None = None) -> DataFrame:
    """(node, ancestor) for all ancestors; a node is its own ancestor only on a cycle.  With ``of`` (node) only those
    of its nodes are followed."""
    one = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).distinct()
    step = one.select(F.col("node").alias("mid"), F.col("ancestor").alias("next"))
    known = cut(one if of is None else one.join(of.select("node"), "node", "left_semi"))
    fresh = known
    while not fresh.isEmpty():
        more = fresh.join(step, fresh["ancestor"] == step["mid"]).select("node", F.col("next").alias("ancestor")).distinct()
        fresh = cut(more.join(known, ["node", "ancestor"], "left_anti"))
        known = known.unionByName(fresh)  # of parts that are written already
    return known


def chain_depth(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """id, depth: hops to the root of a forest (child_id has one parent_id).  A cycle raises: each walk keeps a
    node of an earlier level, anew at every power of two, and may not meet it again."""
    live = cut(ids.select("id", F.col("id").alias("at"), F.col("id").alias("mark"), F.lit(0).alias("depth")))
    done, level = [], 0
    while not live.isEmpty():
        level += 1
        step = cut(live.join(edges, live["at"] == edges["child_id"], "left").select("id", "parent_id", "mark", "depth"))
        if not step.where("parent_id = mark").isEmpty():
            raise ValueError("the edges hold a cycle")
        done.append(step.where("parent_id IS NULL").select("id", "depth"))
        mark = F.col("parent_id") if level & (level - 1) == 0 else F.col("mark")
        live = step.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("at"), mark.alias("mark"), (F.col("depth") + 1).alias("depth"))
    out = done[0] if done else ids.select("id", F.lit(0).alias("depth"))
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def prior_incomplete(ids: DataFrame, edges: DataFrame, runs: DataFrame, reflections: DataFrame) -> DataFrame:
    """id, prior: verdicts IncompleteStep of the runs of all ancestors of a code generation."""
    up = closure(edges, "child_id", "parent_id")
    bad = reflections.where("result = 'IncompleteStep'").join(runs.select(F.col("id").alias("run_id"), "code_id"), "run_id").groupBy("code_id").count()
    hit = up.join(bad, up["ancestor"] == bad["code_id"]).groupBy("node").agg(F.sum("count").alias("prior"))
    return ids.select("id").join(hit, F.col("id") == F.col("node"), "left").select("id", F.coalesce("prior", F.lit(0)).cast("long").alias("prior"))


def leaves(roots: DataFrame, calls: DataFrame, terminals: DataFrame) -> DataFrame:
    """Ids among roots and call ends that call nothing and aren't terminal."""
    ends = roots.select("id").unionByName(calls.select(F.col("caller_id").alias("id"))).unionByName(calls.select(F.col("callee_id").alias("id"))).distinct()
    return ends.join(calls.select(F.col("caller_id").alias("id")), "id", "left_anti").join(terminals.select("id"), "id", "left_anti")
