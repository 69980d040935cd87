"""Canonical concepts and findings of another graph, imported as one version of all tables.

Everything follows from one map of old to new ids per kind, written before it is used: what folds into
a canonical row of this graph does so over one edge, links are carried to where both ends resolve, and
the row that marks the import as done is part of the same version.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, measured_joins
from .graph import resolve
from .learning import _missing, _told, none_or_raise
from .state import with_new_ids


@dataclass
class Incoming:
    """semantics: src_id, name, definition, description, category, functions (name, contract), targets,
    new_description, projects; findings: src_id, title, severity, root_cause, description, category_id, targets,
    new_description, projects; links: src_semantic_id, src_finding_id, strength, evidence, ord.  Ids ``src_`` are the
    other graph's, targets and projects this one's."""

    semantics: DataFrame
    findings: DataFrame
    links: DataFrame


@dataclass
class Imported:
    """Tables to replace, rows to append, and the maps src_id -> id."""

    replace: dict[str, DataFrame]
    append: dict[str, DataFrame]
    semantic_ids: DataFrame
    finding_ids: DataFrame


def _carried(links: DataFrame, semantics: DataFrame, findings: DataFrame, semantic_merges: DataFrame, finding_merges: DataFrame, existing: DataFrame) -> DataFrame:
    """Links with both ends imported, at the canonical rows that these resolve to; pairs that are there stay, of
    several carried ones the first does."""
    at = lambda items, merges, name: items.select(F.col("src_id").alias(f"src_{name}_id"), F.col("id").alias("node")).join(
        resolve(items.select("id"), merges), "node"
    ).select(f"src_{name}_id", F.col("canonical").alias(f"{name}_id"))
    moved = links.join(at(semantics, semantic_merges, "semantic"), "src_semantic_id").join(at(findings, finding_merges, "finding"), "src_finding_id")
    first = moved.groupBy(F.col("semantic_id").alias("semantic_node_id"), F.col("finding_id").alias("audit_finding_id")).agg(F.min_by(F.struct("strength", "evidence"), "ord").alias("f"))
    return first.join(existing.select("semantic_node_id", "audit_finding_id"), ["semantic_node_id", "audit_finding_id"], "left_anti").select("semantic_node_id", "audit_finding_id", "f.*")


def import_canonicals(base: Mapping[str, DataFrame], incoming: Incoming, source_key: str) -> Imported:
    """Raises where a target or a taxonomy entry isn't there."""
    with measured_joins(base["semantic_node"].sparkSession):
        return _imported(base, incoming, source_key)


def _imported(base: Mapping[str, DataFrame], incoming: Incoming, source_key: str) -> Imported:
    semantics = cut(with_new_ids(base["semantic_node"], incoming.semantics.withColumn("at", F.col("src_id")), "src_id"))
    findings = cut(with_new_ids(base["audit_finding"], incoming.findings.withColumn("at", F.col("src_id")), "src_id"))
    for items, nodes, what in ((semantics, "semantic_node", "a concept folds into none"), (findings, "audit_finding", "a finding folds into none")):
        none_or_raise(items.select("src_id", F.explode("targets").alias("id")).join(base[nodes].select("id"), "id", "left_anti"), what)
    none_or_raise(findings.join(base["category"].select(F.col("id").alias("category_id")).distinct(), "category_id", "left_anti").select("src_id", "category_id"), "no such taxonomy entry")

    merges = lambda items: items.select(F.col("id").alias("from_id"), F.explode(F.array_distinct("targets")).alias("to_id"))
    owned = lambda items, name: items.select(F.explode("projects").alias("project_id"), F.concat(F.array("id"), "targets").alias("all")).select("project_id", F.explode("all").alias(name))
    new_s, new_f = merges(semantics), merges(findings)
    nodes, held = base["semantic_node"], base["audit_finding"]
    links = _carried(
        incoming.links, semantics, findings, base["semantic_merge"].select("from_id", "to_id").unionByName(new_s), base["finding_merge"].select("from_id", "to_id").unionByName(new_f), base["semantic_finding_link"]
    )
    fresh = semantics.where(F.size("targets") == 0).select(F.col("id").alias("semantic_node_id"))
    folded = findings.where(F.size("targets") > 0).select(F.col("id").alias("audit_finding_id"))
    spark = nodes.sparkSession
    mark = with_new_ids(base["merge_status"], spark.createDataFrame([(source_key, "imported")], "source_key string, phase string"), "source_key")
    return Imported(
        replace={
            "semantic_node": _told(nodes, semantics).unionByName(semantics.select(*nodes.columns)),
            "audit_finding": _told(held, findings).unionByName(findings.select(*held.columns)),
        },
        append={
            "semantic_function": semantics.select(F.col("id").alias("semantic_node_id"), F.explode("functions").alias("f")).select("semantic_node_id", F.col("f.name").alias("function_name"), F.col("f.contract").alias("contract_path")),
            "semantic_merge": new_s,
            "finding_merge": new_f,
            "pending_semantic": _missing(base["pending_semantic"], fresh, ["semantic_node_id"]),
            "project_semantic": _missing(base["project_semantic"], owned(semantics, "semantic_node_id"), ["project_id", "semantic_node_id"]),
            "project_finding": _missing(base["project_finding"], owned(findings, "audit_finding_id"), ["project_id", "audit_finding_id"]),
            "finding_taxonomy": findings.select(F.col("id").alias("audit_finding_id"), "category_id"),
            "finding_link_status": _missing(base["finding_link_status"], folded, ["audit_finding_id"]),
            "semantic_finding_link": links,
            "merge_status": mark.select("id", "source_key", "phase"),
        },
        semantic_ids=semantics.select("src_id", "id"),
        finding_ids=findings.select("src_id", "id"),
    )
