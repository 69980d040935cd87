"""Finished projects written into the graph: all rows of all tables, for one version of a store.

``write_projects`` takes the tables as they are and what was learned of a batch of projects, and gives
what changes: tables to replace and rows to append.  Ids are new, after the largest there, in the order
of project and place; what the data model forbids raises before anything is returned.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.enums import trim_all
from ..storage import cut, measured_joins, written
from .state import with_new_ids

IN_PROJECT = "in-project link: the finding is an instance of the concept in its own project"


@dataclass
class Learned:
    """projects: ord, name, platform_id; categories: ord, category; semantics: ord, idx, name, definition,
    description, category, functions (name, contract), targets, new_description; findings: ord, idx, title,
    severity, root_cause, description, category_id, targets, new_description; links: ord, finding_idx,
    semantic_idx.  ``ord`` is the project's."""

    projects: DataFrame
    categories: DataFrame
    semantics: DataFrame
    findings: DataFrame
    links: DataFrame


@dataclass
class Change:
    replace: dict[str, DataFrame]
    append: dict[str, DataFrame]
    #: Ids of concepts that nothing was folded into: the caller's to queue.
    new_semantics: DataFrame


def none_or_raise(rows: DataFrame, what: str) -> None:
    if first := rows.limit(1).collect():
        raise ValueError(f"{what}: {first[0].asDict()}")


def project_ids(projects: DataFrame, platforms: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (ord, name, platform_id) with id and ``new``: by platform where one is named, only else by name."""
    by_platform = platforms.groupBy("platform_id").agg(F.min("project_id").alias("p_id"))
    by_name = projects.groupBy("name").agg(F.min("id").alias("n_id"))
    at = incoming.join(by_platform, "platform_id", "left").join(by_name, "name", "left")
    at = cut(at.select("ord", "name", "platform_id", F.when(F.col("platform_id").isNotNull(), F.col("p_id")).otherwise(F.col("n_id")).alias("known")))
    # of several incoming rows of one new name or platform the first makes the project
    key = F.coalesce(F.concat(F.lit("p:"), "platform_id"), F.concat(F.lit("n:"), "name"))
    unknown = at.where("known IS NULL").withColumn("key", key)
    made = with_new_ids(projects, unknown.groupBy("key").agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord")), "ord").select("key", F.col("id").alias("made"))
    fresh = unknown.join(made, "key").select("ord", "name", "platform_id", F.col("made").alias("id"), F.lit(True).alias("new"))
    return at.where("known IS NOT NULL").select("ord", "name", "platform_id", F.col("known").alias("id"), F.lit(False).alias("new")).unionByName(fresh)


def _missing(have: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys).distinct().join(have.select(*keys), keys, "left_anti")


def _told(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """Nodes with the last new description of the items that fold into them, where it isn't blank."""
    told = items.select(F.explode("targets").alias("id"), "at", trim_all("new_description").alias("text")).where("text <> ''")
    last = told.groupBy("id").agg(F.max_by("text", "at").alias("text"))
    return nodes.join(last, "id", "left").withColumn("description", F.coalesce("text", "description")).select(*nodes.columns)


def write_projects(base: Mapping[str, DataFrame], learned: Learned) -> Change:
    """Raises where a target, a taxonomy entry or the end of a link isn't there."""
    with measured_joins(base["semantic_node"].sparkSession):
        return _written(base, learned)


def _written(base: Mapping[str, DataFrame], learned: Learned) -> Change:
    at = F.struct("ord", "idx")
    semantics = written(with_new_ids(base["semantic_node"], learned.semantics.withColumn("at", at), "at"), "semantics")
    findings = written(with_new_ids(base["audit_finding"], learned.findings.withColumn("at", at), "at"), "findings")
    for items, nodes, what in ((semantics, "semantic_node", "a concept folds into none"), (findings, "audit_finding", "a finding folds into none")):
        none_or_raise(items.select("ord", "idx", F.explode("targets").alias("id")).join(base[nodes].select("id"), "id", "left_anti"), what)
    taxonomy = base["category"].select(F.col("id").alias("category_id")).distinct()
    none_or_raise(findings.join(taxonomy, "category_id", "left_anti").select("ord", "idx", "category_id"), "no such taxonomy entry")

    ids = cut(project_ids(base["project"], base["project_platform"], learned.projects))
    of = ids.select("ord", F.col("id").alias("project_id"))
    done = ids.select("id").distinct().withColumn("done", F.lit(True))
    projects = base["project"].join(done, "id", "left").withColumn("status", F.when(F.col("done"), "completed").otherwise(F.col("status"))).select(*base["project"].columns)
    made = ids.where("new").groupBy("id").agg(F.min_by("name", "ord").alias("name")).select("id", "name", F.lit("completed").alias("status"))
    platforms = ids.where("platform_id IS NOT NULL").groupBy(F.col("id").alias("project_id")).agg(F.min_by("platform_id", "ord").alias("platform_id"))
    platforms = platforms.join(base["project_platform"].select("project_id").distinct(), "project_id", "left_anti")
    known = base["project_category"].select("category").distinct()  # a category nobody has is passed over
    categories = learned.categories.join(of, "ord").join(known, "category", "left_semi")

    targets = lambda items: items.select("ord", F.explode("targets").alias("node"))
    owned = lambda items, name: items.select("ord", F.col("id").alias("node")).unionByName(targets(items)).join(of, "ord").select("project_id", F.col("node").alias(name))

    ends = lambda items, name: items.select("ord", F.col("idx").alias(f"{name}_idx"), F.col("id").alias(f"{name}_id"))
    links = learned.links.join(ends(findings, "finding"), ["ord", "finding_idx"], "left").join(ends(semantics, "semantic"), ["ord", "semantic_idx"], "left")
    links = cut(links)
    none_or_raise(links.where("finding_id IS NULL OR semantic_id IS NULL").select("ord", "finding_idx", "semantic_idx"), "a link has no such end")
    pairs = links.select(F.col("semantic_id").alias("semantic_node_id"), F.col("finding_id").alias("audit_finding_id")).distinct()

    merges = lambda items: items.select(F.col("id").alias("from_id"), F.explode(F.array_distinct("targets")).alias("to_id"))
    nodes, held = base["semantic_node"], base["audit_finding"]
    return Change(
        replace={
            "project": projects.unionByName(made.select(*projects.columns)),
            "semantic_node": _told(nodes, semantics).unionByName(semantics.select(*nodes.columns)),
            "audit_finding": _told(held, findings).unionByName(findings.select(*held.columns)),
        },
        append={
            "project_platform": platforms,
            "project_category": _missing(base["project_category"], categories, ["project_id", "category"]),
            "semantic_function": semantics.select(F.col("id").alias("semantic_node_id"), F.explode("functions").alias("f")).select("semantic_node_id", F.col("f.name").alias("function_name"), F.col("f.contract").alias("contract_path")),
            "semantic_merge": merges(semantics),
            "project_semantic": _missing(base["project_semantic"], owned(semantics, "semantic_node_id"), ["project_id", "semantic_node_id"]),
            "finding_taxonomy": findings.select(F.col("id").alias("audit_finding_id"), "category_id"),
            "finding_merge": merges(findings),
            "project_finding": _missing(base["project_finding"], owned(findings, "audit_finding_id"), ["project_id", "audit_finding_id"]),
            "semantic_finding_link": pairs.withColumn("strength", F.lit("High")).withColumn("evidence", F.lit(IN_PROJECT)),
        },
        new_semantics=semantics.where(F.size("targets") == 0).select("id"),
    )


def clear_fuzz_tables(store):
    """Coverage, runs and code generations go together, in one version."""
    from ..sources.versions import cleared

    return cleared(store, ["line_coverage", "harness_run", "code_gen"])
