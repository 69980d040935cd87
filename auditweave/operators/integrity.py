"""Referential checks, repair, resume state and gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import Table, ordered
from ..storage import dealt, written


def dangling(rows: DataFrame, table: str, key: list[str], targets: list[tuple[str, str, DataFrame, str]], parts: int = 0) -> DataFrame:
    """One issue a row that misses a target; the problem lists every missing side.  ``targets``:
    (column, name, table, its key); ``parts``: as of ``dealt``."""
    marked = rows.select(*dict.fromkeys([*key, *[column for column, *_ in targets]]))
    for k, (column, _, target, own) in enumerate(targets):
        there = dealt(target.select(F.col(own).alias(f"_k{k}")), parts, f"_k{k}").distinct().withColumn(f"_h{k}", F.lit(1))
        marked = dealt(marked, parts, column)
        marked = marked.join(there, marked[column] == F.col(f"_k{k}"), "left")
    missing = F.array_compact(F.array(*[F.when(F.col(f"_h{k}").isNull(), F.lit(f"missing {name}")) for k, (_, name, _, _) in enumerate(targets)]))
    return marked.where(F.size(missing) > 0).select(
        F.lit(table).alias("table_name"), F.concat_ws(",", *[F.col(c).cast("string") for c in key]).alias("row_key"), F.array_join(missing, "; ").alias("problem")
    )


def issues(t: dict[str, DataFrame], parts: int = 0) -> DataFrame:
    """All rules over the graph's tables.  Tables with a row a link go to ``parts`` tasks (see ``dealt``)."""
    node, finding, project = t["semantic_node"], t["audit_finding"], t["project"]
    out = [
        dangling(t["project_platform"], "project_platform", ["project_id"], [("project_id", "project", project, "id")]),
        dangling(t["project_category"], "project_category", ["project_id", "category"], [("project_id", "project", project, "id")]),
        dangling(t["semantic_function"], "semantic_function", ["semantic_node_id", "function_name"], [("semantic_node_id", "semantic", node, "id")]),
        dangling(t["semantic_merge"], "semantic_merge", ["from_id", "to_id"], [("from_id", "from", node, "id"), ("to_id", "to", node, "id")]),
        dangling(t["finding_merge"], "finding_merge", ["from_id", "to_id"], [("from_id", "from", finding, "id"), ("to_id", "to", finding, "id")], parts),
        dangling(t["finding_taxonomy"], "finding_taxonomy", ["audit_finding_id"], [("audit_finding_id", "finding", finding, "id")], parts),
        dangling(t["sfl"], "semantic_finding_link", ["semantic_node_id", "audit_finding_id"], [("semantic_node_id", "semantic", node, "id"), ("audit_finding_id", "finding", finding, "id")], parts),
        dangling(t["finding_link_status"], "finding_link_status", ["audit_finding_id"], [("audit_finding_id", "finding", finding, "id")], parts),
    ]

    def told(df: DataFrame, table: str, key: str, problem: str) -> DataFrame:
        return df.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.lit(problem).alias("problem"))

    linked = dealt(t["sfl"].select("audit_finding_id"), parts, "audit_finding_id").distinct()
    partial = linked.join(dealt(t["finding_link_status"], parts, "audit_finding_id"), "audit_finding_id", "left_anti")
    out.append(told(partial, "semantic_finding_link", "audit_finding_id", "linked without status"))
    out.append(told(t["pending_semantic"], "pending_semantic", "semantic_node_id", "queue not drained"))
    latest = t["merge_status"].groupBy("source_key").agg(F.max_by("phase", "id").alias("phase")).where("phase <> 'link'")
    out.append(told(latest, "merge_status", "source_key", "merge incomplete"))
    all_issues = out[0]
    for more in out[1:]:
        all_issues = all_issues.unionByName(more)
    return all_issues


def issue_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("table_name", "problem").agg(F.count(F.lit(1)).alias("n"))


def repair_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends there."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


@dataclass
class Repaired:
    """tables without rows that point nowhere; report: table_name, detected (rows that point nowhere as the
    tables were), repaired (rows that went), remaining."""

    tables: dict[str, DataFrame]
    report: DataFrame


def pointing_nowhere(tables: dict[str, DataFrame], spec: Table) -> DataFrame:
    """Rows of one table of which a reference, null aside, finds no row."""
    rows = tables[spec.name]
    bad = F.lit(False)
    for k, (column, (other, own)) in enumerate(spec.refs.items()):
        there = tables[other].select(F.col(own).alias(f"_k{k}")).distinct().withColumn(f"_h{k}", F.lit(True))
        rows = rows.join(there, rows[column] == F.col(f"_k{k}"), "left")
        bad = bad | (F.col(f"`{column}`").isNotNull() & F.col(f"_h{k}").isNull())
    return rows.withColumn("_bad", bad).select(*[f"`{c}`" for c in tables[spec.name].columns], "_bad")


def repaired(tables: dict[str, DataFrame], specs: list[Table]) -> Repaired:
    """Rows that point nowhere go, and then those that pointed to them: tables in the order of their
    references, so that one pass reaches the end; a table that references itself is passed until it holds."""
    out, counts = dict(tables), []
    for spec in ordered([s for s in specs if s.name in tables]):
        if not spec.refs:
            counts.append((spec.name, 0, 0, 0))
            continue
        out[spec.name] = written(tables[spec.name], spec.name)  # a table may be costly to make, and is read several times
        n, detected = pointing_nowhere({**tables, spec.name: out[spec.name]}, spec).agg(F.count(F.lit(1)), F.count_if("_bad")).head()
        while True:
            out[spec.name] = written(pointing_nowhere(out, spec).where("NOT _bad").drop("_bad"), spec.name)
            kept, left = pointing_nowhere(out, spec).agg(F.count(F.lit(1)), F.count_if("_bad")).head()
            if not left or all(other != spec.name for other, _ in spec.refs.values()):
                break
        counts.append((spec.name, detected, n - kept, left))
    spark = next(iter(tables.values())).sparkSession
    return Repaired(out, spark.createDataFrame(counts, "table_name string, detected long, repaired long, remaining long"))


def gate(found: DataFrame, force: bool = False) -> None:
    """Refuse a graph with issues, unless forced."""
    if not force and not found.isEmpty():
        raise ValueError("the knowledge graph has validation issues")


def incomplete_merges(merge_status: DataFrame) -> DataFrame:
    """Per source the latest phase, where it isn't the last one."""
    return merge_status.groupBy("source_key").agg(F.max_by("phase", "id").alias("phase"), F.max("id").alias("id")).where("phase <> 'link'")


def resume_state(links: DataFrame, specs: DataFrame, code_gens: DataFrame) -> DataFrame:
    """Per (extract, concept, finding): NotStarted without specification, Built if all of them have
    code, else Partial with the ids of those that don't."""
    key = ["extract_id", "historical_id", "finding_id"]
    built = code_gens.select(F.col("spec_id").alias("id")).distinct().withColumn("built", F.lit(True))
    own = specs.join(built, "id", "left")
    state = own.groupBy(*key).agg(F.count(F.lit(1)).alias("specs"), F.array_sort(F.collect_list(F.when(F.col("built").isNull(), F.col("id")))).alias("open"))
    out = links.select(*key).distinct().join(state, key, "left")
    named = F.when(F.col("specs").isNull(), "NotStarted").when(F.size("open") == 0, "Built").otherwise("Partial")
    return out.select(*key, named.alias("state"), F.coalesce(F.array_join("open", ","), F.lit("")).alias("open"))


def runtime_gate(runs: DataFrame, most: float = 0.95) -> DataFrame:
    """id, gate, why: a failed set-up, then reverts, else pass."""
    rate = F.when(F.col("calls") > 0, F.col("reverts") / F.col("calls")).otherwise(0.0)
    why = F.when(F.col("reason").contains("setUp()"), "setup failed").when((F.col("calls") > 0) & (rate >= most), "reverts")
    return runs.select("id", F.when(why.isNull(), "Pass").otherwise("Fail").alias("gate"), F.coalesce(why, F.lit("")).alias("why"))


def duplicate_ids(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).count().where("count > 1")
