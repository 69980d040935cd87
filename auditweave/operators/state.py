"""State changes as functions of tables: (state, input) -> new state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.enums import REVIEW_SEVERITIES, rank, trim_all
from ..storage import dealt
from .graph import cut


def put(state: DataFrame, rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Keyed overwrite: the last incoming row of a key wins over what is there."""
    if order:
        rest = [c for c in rows.columns if c not in key]
        rows = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*key, "r.*")
    rows = rows.select(*state.columns)
    return state.join(rows.select(*key), key, "left_anti").select(*state.columns).unionByName(rows)


def add_missing(state: DataFrame, rows: DataFrame, key: list[str], parts: int = 0) -> DataFrame:
    """Insert where the key is absent; ``parts``: as of ``dealt``."""
    new = dealt(rows.select(*state.columns), parts, *key).join(dealt(state.select(*key), parts, *key), key, "left_anti").dropDuplicates(key)
    return state.unionByName(new.select(*state.columns))


def with_new_ids(state: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """Incoming rows with ids after the largest there, in order.  Ranges of ``order`` are numbered each on
    their own and shifted, so no task holds all rows."""
    rows = cut(rows)  # ranges are drawn from a first reading
    most = state.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most"))
    parts = cut(rows.repartitionByRange(order).withColumn("part", F.spark_partition_id()))  # read twice: its ranges must not move
    sizes = parts.groupBy("part").count()
    before = sizes.select("part", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy("part").orderBy(order))
    return parts.withColumn("nth", nth).join(F.broadcast(before), "part").crossJoin(F.broadcast(most)).withColumn("id", (F.col("most") + F.col("before") + F.col("nth")).cast("int")).drop("part", "nth", "before", "most")


def carry_links(existing: DataFrame, carried: DataFrame, moved: DataFrame) -> DataFrame:
    """Links with their concept mapped; of colliding ones the first to arrive stays, whatever its strength."""
    mapped = carried.join(moved, carried["semantic_node_id"] == moved["node"], "left")
    mapped = mapped.select(F.coalesce("canonical", "semantic_node_id").alias("semantic_node_id"), "audit_finding_id", "strength", "ord")
    first = mapped.groupBy("semantic_node_id", "audit_finding_id").agg(F.min_by("strength", "ord").alias("strength"))
    return add_missing(existing.select("semantic_node_id", "audit_finding_id", "strength"), first, ["semantic_node_id", "audit_finding_id"])


def raise_severity(findings: DataFrame, members: DataFrame) -> DataFrame:
    """Report findings whose severity never falls: the highest of their own and their members'."""
    both = findings.select("id", "severity").unionByName(members.select(F.col("to_id").alias("id"), "severity").join(findings.select("id"), "id", "left_semi"))
    return both.groupBy("id").agg(F.max_by("severity", rank("severity", REVIEW_SEVERITIES)).alias("severity"))


def decisions(items: DataFrame, merges: DataFrame) -> DataFrame:
    """Items joined to their decision by lower name; without targets an item is new."""
    m = merges.select(F.lower("name").alias("key"), "targets")
    out = items.join(m, F.lower(items["name"]) == m["key"], "left")
    return out.select(*[items[c] for c in items.columns], F.when(F.size(F.coalesce("targets", F.array().cast("array<int>"))) > 0, "Merge").otherwise("New").alias("action"))


def first_updates(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """Over the chunks of a key: targets united in order of arrival, first text that isn't blank."""
    text = F.min_by("text", F.when(F.char_length(trim_all("text")) > 0, F.col(order)))
    targets = F.transform(F.array_sort(F.collect_list(F.struct(order, "target"))), lambda s: s["target"])
    return chunks.groupBy(key).agg(F.array_distinct(targets).alias("targets"), F.when(F.max(F.char_length(trim_all("text"))) > 0, text).alias("text"))


def take_turns(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Rows with ``turn``: the k-th of every group before the next of any."""
    return rows.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(order)))


def judged(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Queue rows after judgement: duplicates go to the back lane, the rest keep their place."""
    out = queue.join(verdicts.select("id", "duplicate"), "id", "left")
    return out.withColumn("lane", F.when(F.coalesce("duplicate", F.lit(False)), F.lit(1)).otherwise(F.lit(0))).drop("duplicate")


def latest(rows: DataFrame, key: str, sort: str, tie: str) -> DataFrame:
    """Per key the row of the largest sort key; ties keep the first by ``tie``."""
    rest = [c for c in rows.columns if c != key]
    w = F.struct(F.col(sort), (-F.col(tie)).alias("t"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), w).alias("r")).select(key, "r.*")


def usage(calls: DataFrame, group: str) -> DataFrame:
    """Tokens added without overflow, money as decimals."""
    cap = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    return calls.groupBy(group).agg(F.least(F.sum(F.col("tokens").cast("decimal(38,0)")), cap).cast("long").alias("tokens"), F.sum(F.col("usd").cast("decimal(38,18)")).alias("usd"))


def write_items(nodes: DataFrame, merges: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts of a finished project into the graph: (nodes, merge edges).

    ``items``: ord, name, definition, description, category, targets, new_description.  Every item becomes
    a node of a new id; an item with targets also becomes an edge to each of them.  Of a target only the
    description is replaced, by the new one of the last item where that isn't blank."""
    fresh = with_new_ids(nodes, items, "ord")
    edges = fresh.select(F.col("id").alias("from_id"), F.explode("targets").alias("to_id"))
    told = items.select(F.explode("targets").alias("id"), "ord", "new_description").where(F.char_length(trim_all("new_description")) > 0)
    last = told.groupBy("id").agg(F.max_by("new_description", "ord").alias("new_description"))
    kept = nodes.join(last, "id", "left").withColumn("description", F.coalesce("new_description", "description")).select(*nodes.columns)
    return kept.unionByName(fresh.select(*nodes.columns)), merges.unionByName(edges.select(*merges.columns))


def import_canonicals(nodes: DataFrame, merges: DataFrame, links: DataFrame, incoming: DataFrame, incoming_links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonical concepts of another graph: (nodes, merge edges, links).  ``incoming`` has id (of the other
    graph), name, category and targets; each gets a new id, folds one level into its targets, and its
    links follow it to its smallest target, where the first to arrive stays."""
    fresh = with_new_ids(nodes, incoming.withColumnRenamed("id", "old_id"), "old_id")
    edges = fresh.select(F.col("id").alias("from_id"), F.explode("targets").alias("to_id"))
    at = fresh.select(F.col("old_id").alias("node"), F.coalesce(F.array_min("targets"), F.col("id")).alias("canonical"))
    return (
        nodes.unionByName(fresh.select(*nodes.columns)),
        merges.unionByName(edges.select(*merges.columns)),
        carry_links(links, incoming_links, at),
    )


def upsert_projects(projects: DataFrame, platforms: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (name, platform_id) with the id that is there by platform, else by name, else a new one."""
    by_platform = platforms.select("platform_id", F.col("project_id").alias("p_id"))
    by_name = projects.groupBy("name").agg(F.min("id").alias("n_id"))
    known = incoming.join(by_platform, "platform_id", "left").join(by_name, "name", "left").withColumn("known", F.coalesce("p_id", "n_id"))
    fresh = with_new_ids(projects, known.where("known IS NULL").select("name", "platform_id"), "name")
    return known.where("known IS NOT NULL").select("name", "platform_id", F.col("known").alias("id"), F.lit(False).alias("new")).unionByName(fresh.select("name", "platform_id", "id", F.lit(True).alias("new")))


def unique_or_raise(rows: DataFrame, key: list[str]) -> DataFrame:
    if not rows.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"{', '.join(key)}: not unique")
    return rows


def write_runs(code_gens: DataFrame, runs: DataFrame, new_code: DataFrame, new_runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Code generations and their runs with shared new ids; a run names its code by ``code_ord``."""
    code = with_new_ids(code_gens, new_code, "ord")
    own = new_runs.join(code.select(F.col("ord").alias("code_ord"), F.col("id").alias("code_id")), "code_ord")
    made = with_new_ids(runs, own, "run_ord")
    return code_gens.unionByName(code.select(*code_gens.columns)), runs.unionByName(made.select(*runs.columns))


def add_columns(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns that aren't there yet, with their default."""
    for c, v in defaults.items():
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(v))
    return rows


def completed(progress: DataFrame, expected: DataFrame) -> DataFrame:
    """Findings of which every expected context has a result and none failed."""
    done = progress.groupBy("finding_id").agg(F.countDistinct("context").alias("n"), F.bool_or("failed").alias("failed"))
    return done.join(expected, "finding_id").where("n = contexts AND NOT failed").select("finding_id")
