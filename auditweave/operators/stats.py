"""Graph-wide statistics: one pass a table, one row or one small group table as the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, dealt
from .knowledge import canonical_only, folded, split_links


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def strength_counts(links: DataFrame) -> DataFrame:
    """Links by kind (all, in_project, cross) and strength."""
    kinds = split_links(links).select(F.explode(F.array(F.lit("all"), F.col("kind"))).alias("kind"), "strength")
    return kinds.groupBy("kind").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("strength") == s).alias(s.lower()) for s in ("High", "Medium", "Low")]
    )


def totals(nodes: DataFrame, semantic_merges: DataFrame, findings: DataFrame, finding_merges: DataFrame, links: DataFrame) -> DataFrame:
    """One row: totals, folded (distinct ``from``, dangling too), canonical = total - folded, cross links'
    distinct ends, densities and the most parents of a node."""
    n = nodes.agg(F.count(F.lit(1)).alias("semantics_total"))
    f = findings.agg(F.count(F.lit(1)).alias("findings_total"))
    sm = semantic_merges.agg(F.countDistinct("from_id").alias("semantics_folded"))
    fm = finding_merges.agg(F.countDistinct("from_id").alias("findings_folded"))
    cross = split_links(links).where("kind = 'cross'").agg(
        F.count(F.lit(1)).alias("cross_links"), F.countDistinct("semantic_node_id").alias("linked_semantics"), F.countDistinct("audit_finding_id").alias("linked_findings")
    )
    parents = semantic_merges.groupBy("from_id").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("max_parents"))
    one = n.crossJoin(f).crossJoin(sm).crossJoin(fm).crossJoin(cross).crossJoin(parents)  # one row each
    out = one.withColumn("semantics_canonical", F.col("semantics_total") - F.col("semantics_folded")).withColumn("findings_canonical", F.col("findings_total") - F.col("findings_folded"))
    return out.withColumn("links_per_semantic", F.round(_ratio(F.col("cross_links"), F.col("linked_semantics")), 6)).withColumn(
        "links_per_finding", F.round(_ratio(F.col("cross_links"), F.col("linked_findings")), 6)
    )


def _reach(nodes: DataFrame, merges: DataFrame, held: DataFrame, column: str, parts: int) -> DataFrame:
    """id of each canonical node that a project holds, and its or its children's projects as rows, each once; all of a
    node's are in one of ``parts`` tasks (see ``dealt``)."""
    own = dealt(held.select(F.col(column).alias("id"), "project_id"), parts, "id")
    edges = dealt(merges.select("from_id", "to_id"), parts, "from_id")
    lent = own.join(edges, own["id"] == edges["from_id"]).select(F.col("to_id").alias("id"), "project_id")
    canonical = dealt(canonical_only(nodes, merges).select("id"), parts, "id")
    return dealt(own.unionByName(lent), parts, "id").join(canonical, "id", "left_semi").distinct()


def project_reach(nodes: DataFrame, merges: DataFrame, project_semantic: DataFrame, parts: int = 0) -> DataFrame:
    """Distinct projects of each canonical node or of what is merged into it (every parent is
    credited): average over canonical nodes, and the most."""
    reach = _reach(nodes, merges, project_semantic, "semantic_node_id", parts).groupBy("id").count()
    n = canonical_only(nodes, merges).agg(F.count(F.lit(1)).alias("canonical"))
    sums = reach.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("reached"), F.coalesce(F.max("count"), F.lit(0)).alias("max_reach"))
    return n.crossJoin(sums).select("canonical", "max_reach", F.round(_ratio(F.col("reached"), F.col("canonical")), 6).alias("avg_reach"))


def top_categories(nodes: DataFrame, column: str, n: int = 5) -> DataFrame:
    return nodes.groupBy(F.col(column).alias("category")).count().orderBy(F.desc("count"), "category").limit(n).withColumnRenamed("count", "n")


def platform_counts(platforms: DataFrame) -> DataFrame:
    return platforms.groupBy(F.substring_index("platform_id", "-", 1).alias("platform")).agg(F.count(F.lit(1)).alias("n"))


def mean_lengths(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Mean number of characters, truncated to a whole number; 0 without rows."""
    means = [F.coalesce((F.sum(F.char_length(c)) / F.count(F.lit(1))).cast("long"), F.lit(0)).alias(f"mean_{c}") for c in columns]
    return nodes.agg(*means)


def category_counts(nodes: DataFrame, merges: DataFrame, project_category: DataFrame) -> DataFrame:
    """Per category: active concepts and projects, zeros kept on either side."""
    active = canonical_only(nodes, merges).groupBy("category").agg(F.count(F.lit(1)).alias("semantics"))
    projects = project_category.groupBy("category").agg(F.countDistinct("project_id").alias("projects"))
    out = active.join(projects, "category", "full")
    return out.select("category", F.coalesce("semantics", F.lit(0)).alias("semantics"), F.coalesce("projects", F.lit(0)).alias("projects"))


def folded_share(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    return nodes.join(folded(merges).withColumn("gone", F.lit(1)), "id", "left").groupBy("category").agg(F.count("gone").alias("folded"), F.count(F.lit(1)).alias("total"))


def overview(t, parts: int = 0) -> DataFrame:
    """(measure, value) of the whole graph: one aggregate a table, each turned into rows, then ratios of these.
    ``t`` gives the graph's tables by name; links are in ``sfl`` and, as projects' rows, go to ``parts`` tasks
    (see ``dealt``).  Linked ends are counted as rows a finding and rows a concept, not as distinct values of one task."""

    def rows(df: DataFrame, *measures) -> DataFrame:
        """One aggregate with a column a measure -> a row a measure."""
        one = df.agg(*[m.cast("double").alias(n) for n, m in measures])
        return one.unpivot([], [n for n, _ in measures], "measure", "value")

    def named(df: DataFrame, prefix: str, column: str) -> DataFrame:
        return df.groupBy(F.concat(F.lit(prefix), column).alias("measure")).agg(F.count(F.lit(1)).cast("double").alias("value"))

    n, cond = F.count(F.lit(1)), F.count_if
    sem, fin = t["semantic_node"], t["audit_finding"]
    raw = t["semantic_merge"].select(F.col("from_id").alias("id")).distinct().withColumn("folded", F.lit(True))
    folded_findings = folded(t["finding_merge"]).select("id").distinct()
    gone = dealt(folded_findings.select(F.col("id").alias("audit_finding_id")), parts, "audit_finding_id").withColumn("on_folded", F.lit(True))
    split = split_links(t["sfl"]).select("semantic_node_id", "audit_finding_id", "strength", "kind")
    links = dealt(split, parts, "audit_finding_id").join(gone, "audit_finding_id", "left")
    ends = lambda c: dealt(split.where("kind = 'cross'").select(c), parts, c).where(F.col(c).isNotNull()).distinct()
    cross, own = F.col("kind") == "cross", F.col("kind") == "in_project"

    def reach(nodes: DataFrame, merges: DataFrame, held: DataFrame, column: str) -> DataFrame:
        return _reach(nodes, merges, held, column, parts).groupBy("id").agg(F.count("project_id").alias("n"))

    lengths = lambda columns, prefix: [(f"{prefix}_{c}_length", F.floor(F.coalesce(F.avg(F.char_length(c)), F.lit(0)))) for c in columns]
    parts = [
        rows(t["project"], ("projects_total", n), ("projects_completed", cond(F.col("status") == "completed"))),
        named(t["project_platform"].withColumn("platform", F.substring_index("platform_id", "-", 1)), "platform:", "platform"),
        rows(sem.join(raw, "id", "left"), ("semantics_total", n), ("semantics_there_folded", F.count("folded")), *lengths(["name", "definition", "description"], "semantic")),
        rows(raw, ("semantics_folded", n)),
        rows(fin, ("findings_total", n), *[(f"findings_{s.lower()}", cond(F.col("severity") == s)) for s in ("High", "Medium", "Low")], *lengths(["title", "root_cause", "description"], "finding")),
        rows(folded_findings, ("findings_folded", n)),
        rows(t["semantic_merge"].groupBy("from_id").count(), ("semantic_merge_edges", F.coalesce(F.sum("count"), F.lit(0))), ("semantic_max_parents", F.coalesce(F.max("count"), F.lit(0)))),
        rows(t["finding_merge"].groupBy("from_id").count(), ("finding_merge_edges", F.coalesce(F.sum("count"), F.lit(0))), ("finding_max_parents", F.coalesce(F.max("count"), F.lit(0)))),
        rows(t["finding_link_status"], ("link_processed_findings", n)),
        rows(t["pending_semantic"], ("pending_semantics", n)),
        rows(t["merge_status"], ("merge_status_rows", n)),
        rows(t["semantic_function"], ("semantic_functions_total", n)),
        rows(reach(sem, t["semantic_merge"], t["project_semantic"], "semantic_node_id"), ("semantic_projects", F.coalesce(F.sum("n"), F.lit(0))), ("max_projects_per_canonical_semantic", F.coalesce(F.max("n"), F.lit(0)))),
        rows(reach(fin, t["finding_merge"], t["project_finding"], "audit_finding_id"), ("finding_projects", F.coalesce(F.sum("n"), F.lit(0)))),
        rows(t["project_category"], ("project_categories", n)),
        named(canonical_only(sem, t["semantic_merge"]), "semantic_category:", "category"),
        named(t["finding_taxonomy"], "finding_category:", "category"),
        rows(
            links, ("links_total", n), ("links_in_project", cond(own)), ("links_cross", cond(cross)),
            *[(f"{k}_{s.lower()}", cond(w & (F.col("strength") == s))) for k, w in (("total", F.lit(True)), ("in_project", own), ("cross", cross)) for s in ("High", "Medium", "Low")],
            ("cross_links_on_folded_findings", cond(cross & F.col("on_folded"))),
        ),
        rows(ends("audit_finding_id"), ("cross_linked_findings", n)),
        rows(ends("semantic_node_id"), ("cross_linked_semantics", n)),
    ]
    told = parts[0]
    for p in parts[1:]:
        told = told.unionByName(p)
    told = cut(told)
    ratios = [
        ("functions_per_raw_semantic", "semantic_functions_total", "semantics_total", None), ("projects_per_canonical_semantic", "semantic_projects", "semantics_total", "semantics_folded"),
        ("projects_per_canonical_finding", "finding_projects", "findings_total", "findings_folded"), ("categories_per_project", "project_categories", "projects_total", None),
        ("cross_links_per_canonical_finding", "links_cross", "findings_total", "findings_folded"), ("cross_high_per_canonical_finding", "cross_high", "findings_total", "findings_folded"),
        ("cross_links_per_canonical_semantic", "links_cross", "semantics_total", "semantics_folded"),
    ]
    at = lambda name: F.coalesce(F.max(F.when(F.col("measure") == name, F.col("value"))), F.lit(0.0))
    canonical = [("semantics_canonical", at("semantics_total") - at("semantics_folded")), ("findings_canonical", at("findings_total") - at("findings_folded"))]
    made = [(n, F.round(_ratio(at(a), at(b) - (at(less) if less else F.lit(0.0))), 6)) for n, a, b, less in ratios]
    return told.unionByName(rows(told, *canonical, *made))
