"""Rules that refuse bad input, call-graph checks, budgets, and packing of sources into a window.

What the data model forbids raises ``ValueError`` before anything is returned; each check is one
aggregate or anti-join and brings a single row to the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enums import STRENGTHS, rank, trim_all
from ..storage import cut, findable
from .state import unique_or_raise, with_new_ids

VALID = "ValidFinding"
#: Verdicts that close a direction and so may carry a claim.
CLOSING = ("IntendedBehavior", "NotReproducible")
#: Least tokens of a block of a prompt.
BLOCK_FLOOR = 2048


def refuse(bad: DataFrame, why: str) -> None:
    """Raise if there is a row; the message shows the first."""
    first = bad.head(1)
    if first:
        raise ValueError(f"{why}: {first[0].asDict()}")


def complete_or_raise(rows: DataFrame, partners: DataFrame, key: str, partner_key: str) -> DataFrame:
    """``rows``, if each finds its partner."""
    refuse(rows.join(partners.select(F.col(partner_key).alias(key)), key, "left_anti").select(key), "a row misses its partner")
    return rows


def one_category(findings: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Findings (id) with their only category; none or several raise."""
    counted = taxonomy.groupBy(F.col("audit_finding_id").alias("id")).agg(F.count(F.lit(1)).alias("categories"), F.min("category").alias("category"))
    out = findings.join(counted, "id", "left")
    refuse(out.where("categories IS NULL OR categories <> 1").select("id", "categories"), "not exactly one category")
    return out.drop("categories")


def first_category(taxonomy: DataFrame) -> DataFrame:
    """Per finding the category of smallest id."""
    return taxonomy.groupBy(F.col("audit_finding_id").alias("id")).agg(F.min_by("category", "category_id").alias("category"))


def scope_categories(own: DataFrame, project_finding: DataFrame, project_category: DataFrame) -> DataFrame:
    """Findings (id, categories) where an empty list is replaced by the categories of the finding's project
    of smallest id, and these, if there are none, by Others; other columns are kept."""
    project = project_finding.groupBy(F.col("audit_finding_id").alias("id")).agg(F.min("project_id").alias("project_id"))
    lists = project_category.groupBy("project_id").agg(F.array_sort(F.collect_set("category")).alias("of_project"))
    out = own.join(project.join(lists, "project_id"), "id", "left")
    filled = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    chosen = F.when(filled(F.col("categories")), F.col("categories")).when(filled(F.col("of_project")), F.col("of_project")).otherwise(F.array(F.lit("Others")))
    return out.select(*[chosen.alias(c) if c == "categories" else F.col(c) for c in own.columns])


def rendered_or_raw(rendered: Column, raw: Column) -> Column:
    return F.when(F.char_length(trim_all(F.coalesce(rendered, F.lit("")))) > 0, rendered).otherwise(raw)


def batch_results(progress: DataFrame) -> DataFrame:
    """Links of findings whose every expected context is there and none failed.  ``progress`` has finding_id,
    target_id (the finding that links are written to), context, expected, failed, semantic_id, strength and
    evidence; a finding of several targets raises.  Per (concept, finding) the strongest stays, of equals that of
    the first context and then of the greatest evidence, which it brings."""
    of = progress.groupBy("finding_id").agg(
        F.max("expected").alias("expected"), F.min("target_id").alias("target"), F.max("target_id").alias("other"), F.countDistinct("context").alias("contexts"), F.bool_or("failed").alias("failed")
    )
    refuse(of.where("target <> other").select("finding_id", "target", "other"), "a finding has several link targets")
    done = of.where("contexts = expected AND NOT failed").select("finding_id")
    own = progress.where("semantic_id IS NOT NULL").join(done, "finding_id")
    best = F.struct(rank("strength", STRENGTHS).alias("rank"), (-F.col("context")).alias("late"), "evidence")
    return own.groupBy("semantic_id", F.col("target_id").alias("finding_id")).agg(F.max_by(F.struct("strength", "evidence"), best).alias("b")).select("semantic_id", "finding_id", "b.*")


def grouped_candidates(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, canonical) in groups, the canonical first, then by name and id; a canonical node that isn't
    there raises."""
    complete_or_raise(candidates.select("canonical").distinct(), nodes, "canonical", "id")
    named = candidates.join(nodes.select(F.col("id").alias("node"), "name"), "node")
    members = F.array_sort(F.collect_list(F.struct((F.col("node") != F.col("canonical")).alias("later"), "name", "node")))
    return named.groupBy("canonical").agg(F.transform(members, lambda m: m["node"]).alias("members"))


def insert_reflections(reflections: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming verdicts (ord, run_id, result, claim, has_finding) after those there.  A valid finding must
    bring its finding and nothing else may; a claim stays only with a closing verdict."""
    refuse(incoming.where((F.col("result") == VALID) != F.col("has_finding")).select("ord", "result", "has_finding"), "a valid finding and its record go together")
    made = with_new_ids(reflections, incoming, "ord")
    kept = made.withColumn("claim", F.when(F.col("result").isin(*CLOSING), F.col("claim")))
    return reflections.unionByName(kept.select(*reflections.columns))


def merge_ruled_out(merges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges of ruled-out claims with the new ones, a representative's to itself; a claim that is merged
    already, or twice, raises."""
    new = chosen.select(F.col("id").alias("from_id"), F.coalesce("representative", "id").alias("to_id"))
    return unique_or_raise(merges.unionByName(new.select(*merges.columns)), ["from_id"])


def add_lineage(lineage: DataFrame, new: DataFrame) -> DataFrame:
    """A child has one parent."""
    return unique_or_raise(lineage.unionByName(new.select(*lineage.columns)), ["child_id"])


def ensure_project(projects: DataFrame, name: str) -> DataFrame:
    """The only project, which must have this name, or a first one."""
    there = projects.orderBy("id").select("id", "name").head(2)
    if len(there) > 1:
        raise ValueError("more than one project")
    if there and there[0]["name"] != name:
        raise ValueError(f"the project is {there[0]['name']}, not {name}")
    return projects if there else projects.sparkSession.createDataFrame([(1, name)], projects.select("id", "name").schema)


def runtime_gates(runs: DataFrame, sequence_overlap, most: float = 0.95) -> DataFrame:
    """id, gate, why, in order: set-up failed; nearly all calls reverted; a violation that isn't deterministic
    whose counterexample touches nothing of a stated sequence.  ``runs`` has id, setup_failed, calls, reverts,
    violated, deterministic, counterexample and sequence (arrays of contract and function)."""
    reverted = (F.col("calls") > 0) & (F.col("reverts") / F.col("calls") >= most)
    overlap = sequence_overlap(F.col("counterexample"), F.col("sequence"))
    stray = F.col("violated") & ~F.col("deterministic") & (F.size("sequence") > 0) & ((F.size("counterexample") == 0) | (overlap == "disjoint"))
    why = F.when(F.col("setup_failed"), "setup failed").when(reverted, "reverts").when(stray, "disjoint").otherwise("")
    return runs.select("id", F.when(why == "", "Pass").otherwise("Fail").alias("gate"), why.alias("why"))


def record_operations(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """History (id, type, args) with incoming (ord, type, args) whose type and arguments, equal as JSON, aren't there."""
    # keys in order and no blanks; the kinds of values too, since 1 and 1.0 are different arguments
    same = lambda df: df.withColumn("json", F.concat_ws(" ", F.to_json(F.parse_json("args")), F.schema_of_variant(F.parse_json("args"))))
    new = same(incoming).groupBy("type", "json").agg(F.min(F.struct("ord", "args")).alias("first"))
    new = new.join(same(history).select("type", "json"), ["type", "json"], "left_anti").select("type", "first.ord", "first.args")
    return history.unionByName(with_new_ids(history, new, "ord").select(*history.columns))


# -- call graphs ----------------------------------------------------------------------------------


def call_graph_problems(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(problem, id) of functions (id, start_line, start_column, end_line, end_column) and calls (id, holder_id,
    from_id, to_id): repeated ids, a call held by another function than it comes from, a missing target,
    and a place that is before the first line or ends before it starts."""

    def told(rows: DataFrame, problem: str) -> DataFrame:
        return rows.select(F.lit(problem).alias("problem"), F.col("id").cast("long").alias("id")).distinct()

    def twice(rows: DataFrame, problem: str) -> DataFrame:
        return told(rows.groupBy("id").count().where("count > 1"), problem)

    place = "start_line < 1 OR end_line < start_line OR (end_line = start_line AND end_column < start_column)"
    return (
        twice(functions, "repeated function")
        .unionByName(twice(calls, "repeated call"))
        .unionByName(told(calls.where("holder_id <> from_id"), "held elsewhere"))
        .unionByName(told(calls.join(functions.select(F.col("id").alias("to_id")), "to_id", "left_anti"), "missing target"))
        .unionByName(told(functions.where(place), "bad place"))
    )


def first_calls(recorded: DataFrame) -> DataFrame:
    """Of recorded calls (ord, from_id, to_id) the first of each pair."""
    return recorded.groupBy("from_id", "to_id").agg(F.min("ord").alias("ord"))


def degrees(containers: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Containers (id, is_interface, vendored) that aren't vendored, with their degree: calls out of their functions
    and into them, of calls that contracts make; that of an interface is 0.  ``functions``: id, owner_id; ``calls``:
    caller_id, callee_id."""
    owner = functions.select(F.col("id").alias("function_id"), "owner_id")
    made = owner.join(containers.where("NOT is_interface").select(F.col("id").alias("owner_id")), "owner_id", "left_semi")
    calls = calls.join(made.select(F.col("function_id").alias("caller_id")), "caller_id", "left_semi")
    ends = calls.select(F.col("caller_id").alias("function_id")).unionByName(calls.select(F.col("callee_id").alias("function_id")))
    counted = ends.groupBy("function_id").agg(F.count(F.lit(1)).alias("n")).join(owner, "function_id").groupBy(F.col("owner_id").alias("id")).agg(F.sum("n").alias("n"))
    out = containers.where("NOT vendored").join(counted, "id", "left")
    return out.select(*containers.columns, F.when(F.col("is_interface"), F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("degree"))


def core_ranks(containers: DataFrame, core: DataFrame) -> DataFrame:
    """Containers (id, name, path) with their place among the core components (pos, name, path): by path, or by
    name where a component has no path; else by name; else after all of them."""
    by_path = core.where("path <> ''").groupBy(F.regexp_replace("path", r"^(\./)+", "").alias("path")).agg(F.min("pos").alias("at_path"))
    bare = core.where("path = ''").groupBy("name").agg(F.min("pos").alias("at_bare"))
    by_name = core.groupBy("name").agg(F.min("pos").alias("at_name"))
    out = containers.join(by_path, "path", "left").join(bare, "name", "left").join(by_name, "name", "left")
    return out.select(*containers.columns, F.coalesce(F.least("at_path", "at_bare"), "at_name", F.lit(2**31 - 1)).alias("core_rank"))


def resident(candidates: DataFrame, group: str, budget: Column) -> DataFrame:
    """Per project the containers whose sources fit the window, taken by core rank, degree, size and name; one
    that doesn't fit is skipped and the next tried.  ``candidates``: core_rank, degree, bytes, name, id, tokens.
    An ordered fold over one project's containers is inherent; projects are folded apart, over their tokens alone
    and each in one pass."""
    findable(candidates.sparkSession)
    order = F.struct("core_rank", (-F.col("degree")).alias("d"), (-F.col("bytes")).alias("b"), "name", "id", F.col("tokens").cast("long").alias("tokens"))

    @F.pandas_udf("array<boolean>")
    def taken(tokens: pd.Series, budget: pd.Series) -> pd.Series:
        return pd.Series([_taken(t.tolist(), int(b)) for t, b in zip(tokens, budget, strict=True)], dtype=object)

    none = F.lit(2**63 - 1).cast("long")
    lists = candidates.groupBy(group).agg(F.array_sort(F.collect_list(order)).alias("all"), F.coalesce(F.max(budget).cast("long"), -none - 1).alias("budget"))
    lists = lists.withColumn("taken", taken(F.transform("all", lambda c: F.coalesce(c["tokens"], none)), F.col("budget")))
    kept = F.filter("all", lambda c, i: F.get("taken", i))
    omitted = F.filter("all", lambda c, i: ~F.get("taken", i))
    return lists.select(
        group, F.aggregate(kept, F.lit(0).cast("long"), lambda n, c: n + c["tokens"]).alias("tokens"), F.transform(kept, lambda c: c["id"].cast("int")).alias("kept"), F.array_sort(F.transform(omitted, lambda c: c["name"])).alias("omitted")
    )


def _taken(tokens: list[int], budget: int) -> list[bool]:
    """Which of the items fit, each after those before it that did."""
    used, out = 0, []
    for t in tokens:
        out.append(fits := used + t <= budget)
        used += t if fits else 0
    return out


# -- budgets and texts ----------------------------------------------------------------------------


def split_window(usable: Column, ratio: Column) -> tuple[Column, Column]:
    """Tokens for new items and for candidates."""
    share = F.greatest(F.lit(0.05), F.least(F.lit(0.95), ratio.cast("double")))
    new = F.greatest(F.floor(usable * share), F.lit(BLOCK_FLOOR)).cast("long")
    return new, F.greatest(usable - new, F.lit(BLOCK_FLOOR)).cast("long")


def finding_budget(budget: Column, prefix: Column, target: Column) -> Column:
    """Tokens for findings behind a prefix; raises where none are left."""
    left = F.least(target, F.greatest(budget - prefix, F.lit(0)))
    return F.when(left > 0, left).otherwise(F.raise_error(F.lit("no room for findings under the input budget")).cast("long"))


def context_budget(most: Column, utilization: Column) -> Column:
    return F.floor(most * F.greatest(F.lit(0.05), F.least(F.lit(1.0), utilization.cast("double")))).cast("long")


def slug(c: Column) -> Column:
    """Letters and digits in lower case, anything else one dash, 48 characters at most."""
    head = F.regexp_extract(c, "^(?:[A-Za-z0-9]|[^A-Za-z0-9]++){0,48}", 0)  # what the first 48 characters come from, however long the rest
    short = F.btrim(F.substring(F.lower(F.regexp_replace(head, "[^A-Za-z0-9]+", "-")), 1, 48), F.lit("-"))
    return F.when(short == "", F.lit("project")).otherwise(short)


def checked_int(c: Column) -> Column:
    """A place as a 32-bit number; raises where it doesn't fit."""
    return F.when(c.between(0, 2**31 - 1), c.cast("int")).when(c.isNotNull(), F.raise_error(F.lit("a place doesn't fit")).cast("int"))


def source_chunk(text: Column, start_line: Column, start_column: Column, end_line: Column, end_column: Column) -> Column:
    """Characters between two places (lines from 1, columns from 0); a line's break belongs to it, so the column
    after it is a place too; raises where a place isn't in the text."""
    lines = F.split(text, "\n", -1)

    def at(line: Column, column: Column) -> Column:
        before = F.aggregate(F.slice(lines, 1, line - 1), F.lit(0), lambda s, x: s + F.char_length(x) + 1)
        there = (line >= 1) & (line <= F.size(lines)) & (column >= 0) & (column <= F.char_length(F.get(lines, line - 1)) + (line < F.size(lines)).cast("int"))
        return F.when(there, before + column).otherwise(F.raise_error(F.lit("a place isn't in the text")).cast("int"))

    a, b = at(start_line, start_column), at(end_line, end_column)
    return F.when(a <= b, F.substr(text, a + 1, b - a)).otherwise(F.raise_error(F.lit("a place ends before it starts")))


# -- queues and tallies ---------------------------------------------------------------------------


def merge_choices(chunks: DataFrame) -> DataFrame:
    """What to do with an item after its chunks were asked (item, chunk, target; no chunk: null): no match is new,
    one is merged, several are asked again among these."""
    found = chunks.groupBy("item").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    n = F.size("targets")
    return found.select("item", F.when(n == 0, "new").when(n == 1, "merge").otherwise("ask again").alias("choice"), "targets")


def cleared(rows: DataFrame, keep=None) -> tuple[DataFrame, DataFrame]:
    """What is left of a table, and the number of rows that went."""
    left = rows.where(F.coalesce(keep, F.lit(False))) if keep is not None else rows.limit(0)
    gone = rows.where(~F.coalesce(keep, F.lit(False))) if keep is not None else rows
    return left, gone.agg(F.count(F.lit(1)).alias("cleared"))


def added_tallies(tallies: DataFrame, key: list[str]) -> DataFrame:
    """Counters of several runs, added."""
    return tallies.groupBy(*key).agg(*[F.sum(c).alias(c) for c in tallies.columns if c not in key])


def write_regeneration(specs: DataFrame, codes: DataFrame, runs: DataFrame, spec_lineage: DataFrame, code_lineage: DataFrame, new: DataFrame, new_runs: DataFrame) -> tuple[DataFrame, ...]:
    """Regenerated specifications with their code, runs and both lineage rows, under new ids.  ``new``: ord, title,
    parent_spec, parent_code; ``new_runs``: run_ord, ord, violated.  A new child can't have a parent yet."""
    made = with_new_ids(specs, new, "ord").withColumnRenamed("id", "spec_id")
    made = cut(with_new_ids(codes, made, "ord").withColumnRenamed("id", "code_id"))
    own = with_new_ids(runs, new_runs.join(made.select("ord", "code_id"), "ord"), "run_ord")
    return (
        specs.unionByName(made.select(F.col("spec_id").alias("id"), *[c for c in specs.columns if c != "id"])),
        codes.unionByName(made.select(F.col("code_id").alias("id"), *[c for c in codes.columns if c != "id"])),
        runs.unionByName(own.select(*runs.columns)),
        add_lineage(spec_lineage, made.select(F.col("spec_id").alias("child_id"), F.col("parent_spec").alias("parent_id"))),
        add_lineage(code_lineage, made.select(F.col("code_id").alias("child_id"), F.col("parent_code").alias("parent_id"))),
    )


def schema_probe(spark, names: list[str]) -> dict[str, bool]:
    """Which tables the catalog has."""
    return {n: spark.catalog.tableExists(n) for n in names}
