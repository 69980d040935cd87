"""Project side: code graph, coverage, runs, verdicts, regeneration, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.enums import REGEN, REPORTABLE, RESUMABLE, REVIEW_SEVERITIES, RULED_OUT, rank, trim_all
from .graph import closure


def covered_functions(functions: DataFrame, coverage: DataFrame, width: int = 16) -> DataFrame:
    """Function rows with ``hit``: whether any covered line lies in [start_line, end_line] of its path.

    A range join on (path, bucket of lines): a function goes to the buckets it touches, a line to
    one, so neither side is compared with a whole file."""
    lines = coverage.select("path", "line_number").distinct().withColumn("bucket", F.floor(F.col("line_number") / width))
    spans = functions.select("id", "path", "start_line", "end_line").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))))
    hit = spans.join(lines, ["path", "bucket"]).where("line_number BETWEEN start_line AND end_line").select("id").distinct().withColumn("hit", F.lit(True))
    return functions.join(hit, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def fidelity(covered: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """Share of functions that are hit, and the gate (below ``least`` fails); none expected is 1."""
    share = F.coalesce(F.avg(F.col("hit").cast("int")), F.lit(1.0))
    return covered.groupBy(key).agg(F.count(F.lit(1)).alias("expected"), F.round(share, 6).alias("fidelity"), (share >= least).alias("passed"))


def runs_of(code_gens: DataFrame, runs: DataFrame) -> DataFrame:
    return runs.join(code_gens.select(F.col("id").alias("code_id")), "code_id", "left_semi")


def revert_rate(runs: DataFrame) -> DataFrame:
    return runs.groupBy("code_id").agg(
        F.sum("calls").alias("calls"), F.sum("reverts").alias("reverts"), F.max("violated").alias("violated"),
        F.round(F.coalesce(F.try_divide(F.sum("reverts").cast("double"), F.sum("calls").cast("double")), F.lit(0.0)), 6).alias("revert_rate"),
    )


def reflect_work(code_gens: DataFrame, runs: DataFrame, reflections: DataFrame, most: int = 0) -> DataFrame:
    """Violated runs of completed code that have no verdict; ``most`` = 0 is no limit."""
    done = code_gens.where("status = 'Completed'").select(F.col("id").alias("code_id"))
    out = runs.where("violated").join(done, "code_id", "left_semi").join(reflections.select(F.col("run_id").alias("id")), "id", "left_anti")
    return out.orderBy("id").limit(most) if most else out


def reflect_counters(code_gens: DataFrame, runs: DataFrame, reflections: DataFrame) -> DataFrame:
    """How many runs are skipped, and why."""
    seen = reflections.select(F.col("run_id").alias("id")).distinct().withColumn("seen", F.lit(True))
    all_runs = runs.join(code_gens.select(F.col("id").alias("code_id"), "status"), "code_id").join(seen, "id", "left")
    completed = F.col("status") == "Completed"
    return all_runs.agg(
        F.count_if(~completed).alias("not_completed"), F.count_if(completed & ~F.col("violated")).alias("not_violated"),
        F.count_if(completed & F.col("violated") & F.col("seen").isNotNull()).alias("already_reflected"),
        F.count_if(completed & F.col("violated") & F.col("seen").isNull()).alias("selected"),
    )


def pending_reflections(reflections: DataFrame, runs: DataFrame, code_regen: DataFrame, spec_regen: DataFrame) -> DataFrame:
    """Verdicts that ask for another try and that neither kind of regeneration has used."""
    waiting = reflections.where(F.col("result").isin(*REGEN))
    waiting = waiting.join(code_regen.select(F.col("child_id").alias("id")), "id", "left_anti").join(spec_regen.select(F.col("child_id").alias("id")), "id", "left_anti")
    return waiting.join(runs.select(F.col("id").alias("run_id"), "code_id"), "run_id").select("id", "run_id", "code_id", "result")


def unreviewed(reflections: DataFrame, reviews: DataFrame) -> DataFrame:
    return reflections.where("result = 'ValidFinding'").join(reviews.select(F.col("reflection_id").alias("id")), "id", "left_anti").select("id", "run_id")


def unmerged_reviews(reviews: DataFrame, merges: DataFrame) -> DataFrame:
    return reviews.where(F.col("severity").isin(*REPORTABLE)).join(merges.select(F.col("from_id").alias("reflection_id")), "reflection_id", "left_anti")


def _claimed(reflections: DataFrame) -> DataFrame:
    return reflections.where(F.col("result").isin(*RULED_OUT) & F.col("claim").isNotNull() & (F.char_length(trim_all("claim")) > 0))


def unmerged_ruled_out(reflections: DataFrame, merges: DataFrame) -> DataFrame:
    return _claimed(reflections).join(merges.select(F.col("from_id").alias("id")), "id", "left_anti").select("id", "claim")


def ruled_out_conclusions(reflections: DataFrame, merges: DataFrame) -> DataFrame:
    """Per representative its claim and how often it was reached."""
    n = merges.groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("occurrences"))
    return n.join(_claimed(reflections).select("id", "claim"), "id")


def verdict_tally(reflections: DataFrame) -> DataFrame:
    return reflections.groupBy("result").agg(F.count(F.lit(1)).alias("n"))


def completed_specs(code_gens: DataFrame) -> DataFrame:
    return code_gens.where(F.col("status").isin(*RESUMABLE)).select("spec_id").distinct()


def hydrated_findings(reflections: DataFrame, runs: DataFrame, code_gens: DataFrame, specs: DataFrame) -> DataFrame:
    """Valid findings with their run, code and specification; one that misses any of them raises."""
    v = reflections.where("result = 'ValidFinding'").select(F.col("id").alias("reflection_id"), "run_id")
    r = runs.select(F.col("id").alias("run_id"), "code_id", F.lit(True).alias("has_run"))
    c = code_gens.select(F.col("id").alias("code_id"), "spec_id", F.lit(True).alias("has_code"))
    s = specs.select(F.col("id").alias("spec_id"), "extract_id", "historical_id", "finding_id", F.lit(True).alias("has_spec"))
    out = v.join(r, "run_id", "left").join(c, "code_id", "left").join(s, "spec_id", "left")
    whole = F.col("has_run") & F.col("has_code") & F.col("has_spec")
    checked = F.when(whole, F.col("reflection_id")).otherwise(F.raise_error(F.concat(F.lit("a valid finding misses its run, code or specification: "), F.col("reflection_id"))).cast("int"))
    return out.select(checked.alias("reflection_id"), "run_id", "code_id", "spec_id", "extract_id", "historical_id", "finding_id")


def assert_complete(rows: DataFrame, joined: DataFrame, key: str) -> None:
    """A referential assertion: every row found its partners."""
    if not rows.select(key).join(joined.select(key), key, "left_anti").isEmpty():
        raise ValueError(f"{key}: a row misses its partner")


def provenance(specs: DataFrame, matched: DataFrame, links: DataFrame) -> DataFrame:
    """Specifications with the strength of their match and of their link, where there are any."""
    m = matched.select("extract_id", "historical_id", F.col("strength").alias("match"))
    x = links.select(F.col("semantic_node_id").alias("historical_id"), F.col("audit_finding_id").alias("finding_id"), F.col("strength").alias("link"))
    return specs.join(m, ["extract_id", "historical_id"], "left").join(x, ["historical_id", "finding_id"], "left").select("id", "extract_id", "historical_id", "finding_id", "match", "link")


def report_numbers(reviews: DataFrame) -> DataFrame:
    """H-01, M-01, L-01, I-01 and OOS-01 in order of id within a severity."""
    tag = F.element_at(F.create_map(*[F.lit(x) for kv in (("High", "H"), ("Medium", "M"), ("Low", "L"), ("Informational", "I"), ("ReviewedOutOfScope", "OOS")) for x in kv]), F.col("severity"))
    nth = F.row_number().over(W.partitionBy("severity").orderBy("reflection_id"))
    digits = F.greatest(F.lit(2), F.length(nth.cast("string")))
    return reviews.select("reflection_id", "severity", F.concat_ws("-", tag, F.lpad(nth.cast("string"), digits, F.lit("0"))).alias("number"))


def severity_counts(reviews: DataFrame) -> DataFrame:
    """All severities in their order, zeros kept."""
    spark = reviews.sparkSession
    dim = spark.createDataFrame([(s, r) for s, r in REVIEW_SEVERITIES.items()], "severity string, rank int")
    return dim.join(reviews.groupBy("severity").count(), "severity", "left").select("severity", "rank", F.coalesce("count", F.lit(0)).alias("n"))


def merged_severity(reviews: DataFrame, merges: DataFrame) -> DataFrame:
    """Per report finding its members and the highest severity among them."""
    m = merges.join(reviews, merges["from_id"] == reviews["reflection_id"])
    at = rank("severity", REVIEW_SEVERITIES)
    return m.groupBy(F.col("to_id").alias("report_id")).agg(F.count(F.lit(1)).alias("members"), F.max_by("severity", at).alias("severity"))


def escalation(depths: DataFrame, spec_depths: DataFrame, most: int = 5) -> DataFrame:
    """spec_regen from ``most`` hops of code on; patch up to ``most`` hops of specification, else scratch."""
    s = spec_depths.select(F.col("id"), F.col("depth").alias("spec_depth"))
    mode = F.when(F.col("depth") < most, "code_regen").when(F.coalesce("spec_depth", F.lit(0)) <= most, "spec_patch").otherwise("spec_scratch")
    return depths.join(s, "id", "left").select("id", "depth", F.coalesce("spec_depth", F.lit(0)).alias("spec_depth"), mode.alias("mode"))


def visible_variables(contracts: DataFrame, inherits: DataFrame, variables: DataFrame) -> DataFrame:
    """State variables that aren't constant, own and of all ancestors."""
    up = closure(inherits, "contract_id", "inherited_id").select(F.col("node").alias("contract_id"), F.col("ancestor").alias("owner"))
    own = contracts.select(F.col("id").alias("contract_id"), F.col("id").alias("owner"))
    v = variables.where("NOT constant").select(F.col("contract_id").alias("owner"), F.col("name").alias("variable"))
    return own.unionByName(up).distinct().join(v, "owner").select("contract_id", "owner", "variable")


def call_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls between known functions, not to oneself, once for each pair."""
    ids = functions.select("id")
    known = calls.join(ids.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi").join(ids.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi")
    return known.where("caller_id <> callee_id").select("caller_id", "callee_id").distinct()


def function_order(functions: DataFrame) -> DataFrame:
    return functions.withColumn("nth", F.row_number().over(W.partitionBy("path").orderBy("start_line", "id")))


def cover_by_code(coverage: DataFrame, runs: DataFrame) -> DataFrame:
    return coverage.join(runs.select(F.col("id").alias("run_id"), "code_id"), "run_id").groupBy("code_id", "path").agg(F.count(F.lit(1)).alias("rows"), F.sum("hit_count").alias("hits"))
