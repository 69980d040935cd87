"""Queries over the project side: name -> (plan, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.enums import REGEN, REPORTABLE
from ..operators import graph, integrity, keep, project
from ..streaming import events as stream

_HYDRATED = """SELECT f.id AS reflection_id, h.id AS run_id, c.id AS code_id, c.spec_id, s.extract_id, s.historical_id, s.finding_id FROM reflection f JOIN harness_run h ON h.id = f.run_id
JOIN code_gen c ON c.id = h.code_id LEFT JOIN specification s ON s.id = c.spec_id WHERE f.result = 'ValidFinding'"""
_UP = "up AS (SELECT contract_id AS node, inherited_id AS a FROM contract_inherit UNION SELECT u.node, c.inherited_id FROM up u JOIN contract_inherit c ON c.contract_id = u.a)"


def _depth(name: str, table: str, edges: str) -> str:
    return f"{name}_w AS (SELECT id, id AS cur, 0 AS depth FROM {table} UNION ALL SELECT w.id, e.parent_id, depth + 1 FROM {name}_w w JOIN {edges} e ON e.child_id = w.cur), {name} AS (SELECT id, max(depth) AS depth FROM {name}_w GROUP BY id)"


def _members(r):
    reviews = r["finding_review"].select(F.col("reflection_id").alias("member_id"), "severity", "body")
    return (
        r["report_merge"].select(F.col("from_id").alias("member_id"), F.col("to_id").alias("report_id")).join(reviews, "member_id")
        .join(r["specification"].select(F.col("id").alias("member_id"), "extract_id", "historical_id", "finding_id"), "member_id")
        .join(r["semantic_matched"].select("extract_id", "historical_id", F.col("strength").alias("match")), ["extract_id", "historical_id"], "left")
        .join(r["sfl"].select(F.col("semantic_node_id").alias("historical_id"), F.col("audit_finding_id").alias("finding_id"), F.col("strength").alias("link")), ["historical_id", "finding_id"], "left")
        .withColumn("ord", F.col("member_id"))
    )


_MEMBERS = """mem AS (SELECT m.from_id AS member_id, m.to_id AS report_id, v.severity, v.body, x.strength AS ms, l.strength AS link FROM report_merge m JOIN finding_review v ON v.reflection_id = m.from_id
JOIN specification s ON s.id = m.from_id LEFT JOIN semantic_matched x ON x.extract_id = s.extract_id AND x.historical_id = s.historical_id
LEFT JOIN sfl l ON l.semantic_node_id = s.historical_id AND l.audit_finding_id = s.finding_id)"""
_SEV = "CASE severity WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 WHEN 'Informational' THEN 1 ELSE 0 END"

def every_spec(r):
    """Specifications, with one without content for code whose specification the tables don't hold: hydration refuses those."""
    s = r["specification"]
    gone = r["code_gen"].select(F.col("spec_id").alias("id")).distinct().join(s.select("id"), "id", "left_anti")
    return s.unionByName(gone.select("id", *[F.lit(None).cast(s.schema[c].dataType).alias(c) for c in s.columns if c != "id"]))


QUERIES = {
    "f08_regen_verdicts": (
        lambda r: r["reflection"].where(F.col("result").isin(*REGEN)).select("id", "result"),
        "SELECT id, result FROM reflection WHERE result IN ('IncompleteStep', 'WrongHarness', 'WrongSpec')",
    ),
    "f11_state_variables": (
        lambda r: r["state_variable"].where("NOT constant").select("id", "name"),
        "SELECT id, name FROM state_variable WHERE NOT constant",
    ),
    "f12_reportable": (
        lambda r: r["finding_review"].where(F.col("severity").isin(*REPORTABLE)).select("reflection_id", "severity"),
        "SELECT reflection_id, severity FROM finding_review WHERE severity <> 'ReviewedOutOfScope'",
    ),
    "f13_resumable_specs": (
        lambda r: project.completed_specs(r["code_gen"]),
        "SELECT DISTINCT spec_id FROM code_gen WHERE status IN ('Completed', 'Abandoned', 'StepsExhausted')",
    ),
    "f17_reflect_work": (
        lambda r: project.reflect_work(r["code_gen"], r["harness_run"], r["reflection"]).select("id", "code_id"),
        """SELECT h.id, code_id FROM harness_run h JOIN code_gen c ON c.id = code_id WHERE status = 'Completed' AND violated AND h.id NOT IN (SELECT run_id FROM reflection)""",
    ),
    "f17_reflect_counters": (
        lambda r: project.reflect_counters(r["code_gen"], r["harness_run"], r["reflection"]),
        """SELECT count(*) FILTER (status <> 'Completed') AS not_completed, count(*) FILTER (status = 'Completed' AND NOT violated) AS not_violated,
        count(*) FILTER (status = 'Completed' AND violated AND h.id IN (SELECT run_id FROM reflection)) AS already_reflected,
        count(*) FILTER (status = 'Completed' AND violated AND h.id NOT IN (SELECT run_id FROM reflection)) AS selected FROM harness_run h JOIN code_gen c ON c.id = code_id""",
    ),
    "j17_hydrated_findings": (
        lambda r: project.hydrated_findings(r["reflection"], r["harness_run"], r["code_gen"], every_spec(r)),
        _HYDRATED,
    ),
    "j18_unreviewed": (
        lambda r: project.unreviewed(r["reflection"], r["finding_review"]),
        "SELECT id, run_id FROM reflection WHERE result = 'ValidFinding' AND id NOT IN (SELECT reflection_id FROM finding_review)",
    ),
    "j19_unmerged_reviews": (
        lambda r: project.unmerged_reviews(r["finding_review"], r["report_merge"]).select("reflection_id", "severity"),
        "SELECT reflection_id, severity FROM finding_review WHERE severity <> 'ReviewedOutOfScope' AND reflection_id NOT IN (SELECT from_id FROM report_merge)",
    ),
    "j20_unmerged_ruled_out": (
        lambda r: project.unmerged_ruled_out(r["reflection"], r["ruled_out_merge"]),
        "SELECT id, claim FROM reflection WHERE result IN ('IntendedBehavior', 'NotReproducible') AND trim(claim) <> '' AND id NOT IN (SELECT from_id FROM ruled_out_merge)",
    ),
    "j21_reviews_by_ids": (
        lambda r: r["finding_review"].join(r["report_merge"].select(F.col("to_id").alias("reflection_id")), "reflection_id", "left_semi").select("reflection_id", "severity"),
        "SELECT reflection_id, severity FROM finding_review WHERE reflection_id IN (SELECT to_id FROM report_merge)",
    ),
    "j22_report_members": (
        lambda r: r["report_merge"].join(r["finding_review"], F.col("from_id") == F.col("reflection_id")).select("to_id", "from_id", "severity"),
        "SELECT to_id, from_id, severity FROM report_merge JOIN finding_review ON from_id = reflection_id",
    ),
    "j23_members_with_strengths": (
        lambda r: _members(r).select("report_id", "member_id", "severity", "match", "link"),
        f'WITH {_MEMBERS} SELECT report_id, member_id, severity, ms AS "match", link FROM mem',
    ),
    "j25_provenance": (
        lambda r: project.provenance(r["specification"], r["semantic_matched"], r["sfl"]),
        """SELECT s.id, s.extract_id, s.historical_id, s.finding_id, m.strength AS "match", l.strength AS link FROM specification s
        LEFT JOIN semantic_matched m ON m.extract_id = s.extract_id AND m.historical_id = s.historical_id LEFT JOIN sfl l ON l.semantic_node_id = s.historical_id AND l.audit_finding_id = s.finding_id""",
    ),
    "j24_link_for_spec": (
        lambda r: project.provenance(r["specification"], r["semantic_matched"], r["sfl"]).where("match IS NOT NULL AND link IS NOT NULL"),
        """SELECT s.id, s.extract_id, s.historical_id, s.finding_id, m.strength AS "match", l.strength AS link FROM specification s
        JOIN semantic_matched m ON m.extract_id = s.extract_id AND m.historical_id = s.historical_id JOIN sfl l ON l.semantic_node_id = s.historical_id AND l.audit_finding_id = s.finding_id""",
    ),
    "j26_pending_reflections": (
        lambda r: project.pending_reflections(r["reflection"], r["harness_run"], r["code_gen_regen"], r["specification_regen"]),
        """SELECT f.id, run_id, code_id, result FROM reflection f JOIN harness_run h ON h.id = run_id WHERE result IN ('IncompleteStep', 'WrongHarness', 'WrongSpec')
        AND f.id NOT IN (SELECT child_id FROM code_gen_regen) AND f.id NOT IN (SELECT child_id FROM specification_regen)""",
    ),
    "j27_coverage_by_code": (
        lambda r: project.cover_by_code(r["line_coverage"], r["harness_run"]),
        """SELECT code_id, path, count(*) AS "rows", sum(hit_count)::BIGINT AS hits FROM line_coverage JOIN harness_run h ON h.id = run_id GROUP BY 1, 2""",
    ),
    "j28_runs_for_code": (
        lambda r: project.runs_of(r["code_gen"].where("status = 'Completed'"), r["harness_run"]).select("code_id", "id", "calls"),
        "SELECT code_id, h.id, calls FROM harness_run h JOIN code_gen c ON c.id = code_id WHERE status = 'Completed'",
    ),
    "j29_coverage_range_join": (
        lambda r: project.covered_functions(r["function_t"], r["line_coverage"]).select("id", "path", "hit"),
        "SELECT f.id, f.path, EXISTS (SELECT 1 FROM line_coverage l WHERE l.path = f.path AND l.line_number BETWEEN f.start_line AND f.end_line) AS hit FROM function_t f",
    ),
    "j37_visible_variables": (
        lambda r: project.visible_variables(r["contract"], r["contract_inherit"], r["state_variable"]),
        f"""WITH RECURSIVE {_UP}, o AS (SELECT id AS c, id AS owner FROM contract UNION SELECT node, a FROM up)
        SELECT c AS contract_id, owner, name AS variable FROM o JOIN state_variable v ON v.contract_id = owner WHERE NOT constant""",
    ),
    "a11_ruled_out_conclusions": (
        lambda r: project.ruled_out_conclusions(r["reflection"], r["ruled_out_merge"]),
        """SELECT f.id, occurrences, claim FROM (SELECT to_id, count(*) AS occurrences FROM ruled_out_merge GROUP BY 1) m JOIN reflection f ON f.id = m.to_id
        WHERE result IN ('IntendedBehavior', 'NotReproducible') AND trim(claim) <> ''""",
    ),
    "a13_spec_roll_up": (
        lambda r: r["specification"].join(r["code_gen"].select(F.col("spec_id").alias("id"), "status"), "id").groupBy("extract_id").agg(
            F.count(F.lit(1)).alias("specs"), F.count_if(F.col("status") == "Completed").alias("built"), F.count_if(F.col("status") == "Abandoned").alias("abandoned")
        ),
        "SELECT extract_id, count(*) AS specs, count(*) FILTER (status = 'Completed') AS built, count(*) FILTER (status = 'Abandoned') AS abandoned FROM specification s JOIN code_gen c ON c.spec_id = s.id GROUP BY 1",
    ),
    "a14_verdict_tally": (
        lambda r: project.verdict_tally(r["reflection"]),
        "SELECT result, count(*) AS n FROM reflection GROUP BY 1",
    ),
    "a17_call_graph_counts": (
        lambda r: r["contract"].agg(F.count(F.lit(1)).alias("containers")).crossJoin(r["function_t"].agg(F.count(F.lit(1)).alias("functions"))).crossJoin(r["function_call"].agg(F.count(F.lit(1)).alias("calls"))),
        "SELECT (SELECT count(*) FROM contract) AS containers, (SELECT count(*) FROM function_t) AS functions, (SELECT count(*) FROM function_call) AS calls",
    ),
    "a18_coverage_fidelity": (
        lambda r: project.fidelity(project.covered_functions(r["function_t"], r["line_coverage"]), "path"),
        """WITH h AS (SELECT f.path, EXISTS (SELECT 1 FROM line_coverage l WHERE l.path = f.path AND l.line_number BETWEEN f.start_line AND f.end_line) AS hit FROM function_t f)
        SELECT path, count(*) AS expected, round(avg(hit::INT), 6) AS fidelity, avg(hit::INT) >= 0.5 AS passed FROM h GROUP BY 1""",
    ),
    "a20_revert_rate": (
        lambda r: project.revert_rate(r["harness_run"]),
        """SELECT code_id, sum(calls)::BIGINT AS calls, sum(reverts)::BIGINT AS reverts, bool_or(violated) AS violated, round(coalesce(sum(reverts)::DOUBLE / nullif(sum(calls), 0), 0.0), 6) AS revert_rate FROM harness_run GROUP BY 1""",
    ),
    "a23_severity_counts": (
        lambda r: project.severity_counts(r["finding_review"]),
        f"""SELECT d.severity, {_SEV.replace('severity', 'd.severity')} AS rank, (SELECT count(*) FROM finding_review f WHERE f.severity = d.severity) AS n
        FROM (VALUES ('High'), ('Medium'), ('Low'), ('Informational'), ('ReviewedOutOfScope')) d(severity)""",
    ),
    "w06_report_numbers": (
        lambda r: project.report_numbers(r["finding_review"]),
        """SELECT reflection_id, severity, concat(CASE severity WHEN 'High' THEN 'H' WHEN 'Medium' THEN 'M' WHEN 'Low' THEN 'L' WHEN 'Informational' THEN 'I' ELSE 'OOS' END, '-', CASE WHEN rn < 10 THEN concat('0', rn) ELSE rn::VARCHAR END) AS number
        FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY reflection_id) AS rn FROM finding_review) x""",
    ),
    "w08_representatives": (
        lambda r: keep.representative(_members(r), "report_id"),
        f"""WITH {_MEMBERS} SELECT report_id, member_id AS representative_id FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY {_SEV} DESC,
        CASE link WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END DESC, CASE ms WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END DESC, strlen(body), member_id DESC) AS rn FROM mem) x WHERE rn = 1""",
    ),
    "w09_finding_batches": (
        lambda r: keep.greedy_batches(r["finding_taxonomy"].join(r["audit_finding"].select(F.col("id").alias("audit_finding_id"), F.char_length("description").alias("tokens")), "audit_finding_id").select("category", "audit_finding_id", "tokens"), ["category"], "audit_finding_id", "tokens", 300, 12),
        """WITH RECURSIVE t AS (SELECT category, audit_finding_id, length(description) AS tokens, row_number() OVER (PARTITION BY category ORDER BY audit_finding_id) AS k FROM finding_taxonomy x JOIN audit_finding f ON f.id = x.audit_finding_id),
        w AS (SELECT category, audit_finding_id, tokens, k, tokens AS used, 1 AS n, 0 AS batch FROM t WHERE k = 1
          UNION ALL SELECT t.category, t.audit_finding_id, t.tokens, t.k, CASE WHEN w.n >= 12 OR w.used + t.tokens > 300 THEN t.tokens ELSE w.used + t.tokens END,
          CASE WHEN w.n >= 12 OR w.used + t.tokens > 300 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 12 OR w.used + t.tokens > 300 THEN w.batch + 1 ELSE w.batch END FROM w JOIN t ON t.category = w.category AND t.k = w.k + 1)
        SELECT category, audit_finding_id, tokens::INT AS tokens, batch FROM w""",
    ),
    "u21_merged_severity": (
        lambda r: project.merged_severity(r["finding_review"], r["report_merge"]),
        f"SELECT to_id AS report_id, count(*) AS members, arg_max(severity, {_SEV}) AS severity FROM report_merge JOIN finding_review ON from_id = reflection_id GROUP BY 1",
    ),
    "v04_resume_state": (
        lambda r: integrity.resume_state(
            r["specification"].select("extract_id", "historical_id", "finding_id").unionByName(r["specification"].select((F.col("extract_id") + 1).alias("extract_id"), "historical_id", "finding_id")), r["specification"], r["code_gen"]
        ),
        """WITH k AS (SELECT extract_id AS e, historical_id AS h, finding_id AS f FROM specification UNION SELECT extract_id + 1, historical_id, finding_id FROM specification),
        s AS (SELECT extract_id AS e, historical_id AS h, finding_id AS f, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (id NOT IN (SELECT spec_id FROM code_gen)) AS o FROM specification GROUP BY 1, 2, 3)
        SELECT k.e AS extract_id, k.h AS historical_id, k.f AS finding_id, CASE WHEN n IS NULL THEN 'NotStarted' WHEN o IS NULL THEN 'Built' ELSE 'Partial' END AS state, coalesce(o, '') AS open FROM k LEFT JOIN s USING (e, h, f)""",
    ),
    "v05_loaded_pairs": (
        lambda r: r["specification"].select("extract_id", "historical_id").distinct(),
        "SELECT DISTINCT extract_id, historical_id FROM specification",
    ),
    "v06_has_reflection": (
        lambda r: r["harness_run"].join(r["reflection"].select(F.col("run_id").alias("id")).distinct().withColumn("seen", F.lit(True)), "id", "left").select("id", F.coalesce("seen", F.lit(False)).alias("reflected")),
        "SELECT id, id IN (SELECT run_id FROM reflection) AS reflected FROM harness_run",
    ),
    "v07_runtime_gate": (
        lambda r: integrity.runtime_gate(r["harness_run"], 0.9),
        """SELECT id, CASE WHEN reason LIKE '%setUp()%' OR (calls > 0 AND reverts / calls >= 0.9) THEN 'Fail' ELSE 'Pass' END AS gate,
        CASE WHEN reason LIKE '%setUp()%' THEN 'setup failed' WHEN calls > 0 AND reverts / calls >= 0.9 THEN 'reverts' ELSE '' END AS why FROM harness_run""",
    ),
    "v09_escalation": (
        lambda r: project.escalation(graph.chain_depth(r["code_gen"], r["code_gen_regen"]), graph.chain_depth(r["specification"], r["specification_regen"])),
        f"""WITH RECURSIVE {_depth('c', 'code_gen', 'code_gen_regen')}, {_depth('s', 'specification', 'specification_regen')}
        SELECT c.id, c.depth, coalesce(s.depth, 0) AS spec_depth, CASE WHEN c.depth < 5 THEN 'code_regen' WHEN coalesce(s.depth, 0) <= 5 THEN 'spec_patch' ELSE 'spec_scratch' END AS mode FROM c LEFT JOIN s USING (id)""",
    ),
    "g09_call_edges": (
        lambda r: project.call_edges(r["function_call"], r["function_t"]),
        "SELECT DISTINCT caller_id, callee_id FROM function_call WHERE caller_id <> callee_id AND caller_id IN (SELECT id FROM function_t) AND callee_id IN (SELECT id FROM function_t)",
    ),
    "g11_connected_functions": (
        lambda r: r["function_call"].select(F.col("caller_id").alias("id")).unionByName(r["function_call"].select(F.col("callee_id").alias("id"))).distinct(),
        "SELECT caller_id AS id FROM function_call UNION SELECT callee_id FROM function_call",
    ),
    "g12_duplicate_calls": (
        lambda r: integrity.duplicate_ids(r["function_call"], ["caller_id", "callee_id"]).withColumnRenamed("count", "n"),
        "SELECT caller_id, callee_id, count(*) AS n FROM function_call GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    "o01_function_order": (
        lambda r: project.function_order(r["function_t"]).select("id", "path", "nth"),
        "SELECT id, path, (row_number() OVER (PARTITION BY path ORDER BY start_line, id))::INT AS nth FROM function_t",
    ),
    "t01_lane_totals": (
        lambda r: r["specification"].join(r["reflection"].select("id", "result"), "id", "left").groupBy(F.when(F.col("result").isin(*REGEN), "deferred").otherwise("main").alias("lane")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT CASE WHEN result IN ('IncompleteStep', 'WrongHarness', 'WrongSpec') THEN 'deferred' ELSE 'main' END AS lane, count(*) AS n FROM specification s LEFT JOIN reflection f ON f.id = s.id GROUP BY 1",
    ),
    "t12_event_windows": (
        lambda r: stream.window_counts(r["events"]).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "users"),
        "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
    ),
}
