"""Queries over the knowledge graph: canonical nodes, links, scopes, candidates, work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.enums import IN_PROJECT, rank, STRENGTHS
from ..storage import cut, dealt
from .graph import resolve, resolve_moved, single_parent
from .keep import first_by, strongest
from .rules import first_category, one_category, scope_categories


def folded(merges: DataFrame) -> DataFrame:
    return merges.select(F.col("from_id").alias("id")).distinct()


def canonical_only(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    return nodes.join(folded(merges), "id", "left_anti")


def search(nodes: DataFrame, query: str) -> DataFrame:
    """Name, definition or description holds the query, whatever the case."""
    q = "%" + query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return nodes.where(F.col("name").ilike(q) | F.col("definition").ilike(q) | F.col("description").ilike(q))


def findings_for_semantics(ids: DataFrame, links: DataFrame, findings: DataFrame, merges: DataFrame) -> DataFrame:
    """Findings of the requested concepts and of what is merged into them directly; per (concept,
    finding) the strongest link."""
    wanted = ids.select(F.col("id").alias("canonical_id"))
    children = merges.join(wanted, merges["to_id"] == wanted["canonical_id"], "left_semi")
    raw = single_parent(children).join(wanted, F.col("from_id") == F.col("canonical_id"), "left_anti")
    expand = wanted.select("canonical_id", F.col("canonical_id").alias("semantic_node_id")).unionByName(
        raw.select(F.col("to_id").alias("canonical_id"), F.col("from_id").alias("semantic_node_id"))
    )
    joined = links.join(expand, "semantic_node_id").withColumn("ord", F.struct("semantic_node_id", "ord"))
    flat = joined.select("canonical_id", "audit_finding_id", "strength", "evidence", "semantic_node_id", F.col("ord.ord").alias("ord"))
    best = F.max_by(F.struct("strength", "evidence"), F.struct(rank("strength", STRENGTHS).alias("r"), (-F.col("semantic_node_id")).alias("s"), (-F.col("ord")).alias("o")))
    kept = flat.groupBy("canonical_id", "audit_finding_id").agg(best.alias("b")).select("canonical_id", "audit_finding_id", "b.strength", "b.evidence")
    return kept.join(findings.select(F.col("id").alias("audit_finding_id"), "title", "severity"), "audit_finding_id")


def with_children(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """Canonical nodes with the sorted names of all that is merged into them; none is an empty list."""
    child = nodes.select(F.col("id").alias("from_id"), F.col("name").alias("child"))
    lists = merges.join(child, "from_id").groupBy(F.col("to_id").alias("id")).agg(F.array_sort(F.collect_list("child")).alias("children"))
    return canonical_only(nodes, merges).join(lists, "id", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def pending_findings(findings: DataFrame, status: DataFrame, taxonomy: DataFrame, project_finding: DataFrame, project_category: DataFrame, merges: DataFrame) -> DataFrame:
    """Findings without a link marker: taxonomy, canonical id and the sorted categories of their projects.  A
    finding, marked or not, that has no category or several raises."""
    named = one_category(findings, taxonomy).withColumnRenamed("category", "taxonomy")
    waiting = cut(named.join(status.select(F.col("audit_finding_id").alias("id")), "id", "left_anti"))
    own = project_finding.join(waiting.select(F.col("id").alias("audit_finding_id")), "audit_finding_id", "left_semi")
    where = own.join(project_category, "project_id").groupBy(F.col("audit_finding_id").alias("id")).agg(F.array_sort(F.collect_set("category")).alias("categories"))
    canonical = resolve(waiting, merges)
    out = waiting.join(where, "id", "left")
    out = out.join(canonical, out["id"] == canonical["node"])
    return out.select("id", "title", "taxonomy", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), "canonical")


def linked_findings(findings: DataFrame, status: DataFrame, taxonomy: DataFrame, merges: DataFrame) -> DataFrame:
    done = canonical_only(findings, merges).join(status.select(F.col("audit_finding_id").alias("id")), "id", "left_semi")
    return done.join(first_category(taxonomy).withColumnRenamed("category", "taxonomy"), "id")


def processed_without_links(status: DataFrame, links: DataFrame, merges: DataFrame, parts: int = 0) -> DataFrame:
    """Marked findings whose canonical finding has no link; ``parts``: as of ``dealt``."""
    ids = status.select(F.col("audit_finding_id").alias("id"))
    at = dealt(resolve(ids, merges), parts, "canonical")
    linked = dealt(links.select(F.col("audit_finding_id").alias("canonical")), parts, "canonical")
    return at.join(linked, "canonical", "left_anti").select(F.col("node").alias("id"))


def link_candidates(nodes: DataFrame, merges: DataFrame, categories: list[str]) -> DataFrame:
    """(node, canonical) of the categories' nodes, canonical by the last target that exists; canonical
    targets of other categories come along as themselves."""
    own = nodes.where(F.col("category").isin(categories))
    at = resolve(own, merges, nodes)
    return at.unionByName(at.select(F.col("canonical").alias("node"), "canonical")).distinct()


def vulnerability_scope(
    links: DataFrame, findings: DataFrame, nodes: DataFrame, finding_merges: DataFrame, semantic_merges: DataFrame, project_finding: DataFrame, project_category: DataFrame, parts: int = 0
) -> DataFrame:
    """Per canonical finding the sorted distinct names and categories of its canonical concepts; without
    any, the categories of its first project, or Others.  Repeated links are as good as one.  Links of unknown
    concepts and findings meet no name, or no finding in the end.  ``parts``: as of ``dealt``."""
    f = resolve_moved(findings, finding_merges, findings).select(F.col("node").alias("audit_finding_id"), F.col("canonical").alias("moved_to"))
    s = resolve_moved(nodes, semantic_merges, nodes).select(F.col("node").alias("id"), "canonical")
    of = nodes.select("id").join(s, "id", "left").select(F.col("id").alias("semantic_node_id"), F.coalesce("canonical", "id").alias("id"))
    named = of.join(nodes.select("id", "name", "category"), "id").drop("id")

    def met(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
        """Both sides dealt alike; of the right, a row a key, a task holds its share, so that links needn't be sorted."""
        return dealt(left, parts, key).join(dealt(right, parts, key).hint("shuffle_hash"), key, how)

    pairs = met(links.select("semantic_node_id", "audit_finding_id"), f, "audit_finding_id", "left")
    pairs = pairs.select("semantic_node_id", F.coalesce("moved_to", "audit_finding_id").alias("id"))
    told = dealt(met(pairs, named, "semantic_node_id", "inner").select("id", "name", "category"), parts, "id")
    own = told.groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("names"), F.sort_array(F.collect_set("category")).alias("categories"))
    none = F.array().cast("array<string>")
    every = canonical_only(findings, finding_merges).select("id").join(own, "id", "left").select("id", F.coalesce("names", none).alias("names"), F.coalesce("categories", none).alias("categories"))
    return scope_categories(every, project_finding, project_category).select(F.col("id").alias("finding_id"), "names", "categories")


def scope_seed(nodes: DataFrame, merges: DataFrame, functions: DataFrame) -> DataFrame:
    lists = functions.groupBy(F.col("semantic_node_id").alias("id")).agg(F.array_sort(F.collect_list(F.concat_ws("::", "contract_path", "function_name"))).alias("functions"))
    return canonical_only(nodes, merges).join(lists, "id", "left").withColumn("functions", F.coalesce("functions", F.array().cast("array<string>")))


def link_fan_out(matched: DataFrame, extracts: DataFrame, nodes: DataFrame, links: DataFrame, findings: DataFrame) -> DataFrame:
    """Match, extract, concept, link and finding as one row for each (extract, concept, finding), of several
    the first: matches and links are made unique and get their texts before they meet, so that no join shuffles
    the rows that they fan out to."""
    matched, links = first_by(matched, ["extract_id", "historical_id"]), first_by(links, ["semantic_node_id", "audit_finding_id"])
    m = matched.select("extract_id", "historical_id", F.col("strength").alias("match"))
    e = extracts.select(F.col("id").alias("extract_id"), F.col("name").alias("extract_name"))
    h = nodes.select(F.col("id").alias("historical_id"), F.col("name").alias("historical_name"))
    x = links.select(F.col("semantic_node_id").alias("historical_id"), F.col("audit_finding_id").alias("finding_id"), F.col("strength").alias("link"))
    f = findings.select(F.col("id").alias("finding_id"), "title")
    told = m.join(e, "extract_id").join(h, "historical_id").join(x.join(f, "finding_id"), "historical_id")
    return told.select("finding_id", "historical_id", "extract_id", "match", "extract_name", "historical_name", "link", "title")


def split_links(links: DataFrame) -> DataFrame:
    """Links with ``kind``: in-project by the prefix of their evidence, else cross."""
    return links.withColumn("kind", F.when(F.col("evidence").startswith(IN_PROJECT.rstrip()), "in_project").otherwise("cross"))


def resolve_links(links: DataFrame, nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """Links moved to their canonical concepts, the strongest of each pair kept."""
    at = resolve(nodes, merges, nodes)
    moved = links.join(at, links["semantic_node_id"] == at["node"]).select(F.col("canonical").alias("semantic_node_id"), "audit_finding_id", "strength", F.struct("node", "ord").alias("o"))
    best = F.max_by("strength", F.struct(rank("strength", STRENGTHS).alias("r"), (-F.col("o.node")).alias("n"), (-F.col("o.ord")).alias("d")))
    return moved.groupBy("semantic_node_id", "audit_finding_id").agg(best.alias("strength"))


def upsert_links(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Strongest wins, equal keeps what is there."""
    both = existing.withColumn("ord", F.lit(0)).unionByName(incoming.withColumn("ord", F.lit(1)))
    return strongest(both, ["semantic_node_id", "audit_finding_id"]).drop("ord")


def append_links(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Inserted only where absent; what is there is never changed."""
    new = incoming.join(existing, ["semantic_node_id", "audit_finding_id"], "left_anti").dropDuplicates(["semantic_node_id", "audit_finding_id"])
    return existing.unionByName(new)
