"""Readers, rendering, report and work-list queries: name -> (plan, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.enums import REVIEW_SEVERITIES, rank, trim_all
from ..operators import graph, keep, knowledge, project, state
from ..storage import dealt
from .project_queries import every_spec

_CANON = "SELECT n.* FROM semantic_node n WHERE n.id NOT IN (SELECT from_id FROM semantic_merge)"
_SEV = "CASE severity WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 WHEN 'Informational' THEN 1 ELSE 0 END"


def _items(r):
    n = r["semantic_node"].where("id % 50 = 1")
    return n.select(
        F.col("id").alias("ord"), F.concat(F.lit("new "), "name").alias("name"), "definition", "description", "category",
        F.when(F.col("id") % 100 == 1, F.array(F.col("id") + 1, F.col("id") + 2)).otherwise(F.array().cast("array<int>")).alias("targets"),
        F.when(F.col("id") % 3 == 0, " ").otherwise(F.concat(F.lit("told "), "id")).alias("new_description"),
    )


def _ordered(column: str, *by: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by))), lambda s: s[column].cast("string")), ",")


QUERIES = {
    "s15_dataset_join": (
        lambda r: r["project"].where("id % 2 = 0").join(r["project_platform"].where("project_id % 4 = 0").select(F.col("project_id").alias("id"), "platform_id"), "id").join(r["contract"].where("id % 8 = 0").select("id", "path"), "id", "left").select(F.concat(F.lit("c4-"), "id").alias("platform"), "name", "path"),
        "SELECT concat('c4-', p.id) AS platform, p.name, c.path FROM project p JOIN project_platform f ON f.project_id = p.id AND p.id % 4 = 0 LEFT JOIN contract c ON c.id = p.id AND c.id % 8 = 0",
    ),
    "s22_newest_artifacts": (
        lambda r: state.latest(r["path_t"].select((F.col("id") % 60).alias("file_id"), (F.col("id").cast("long") * 7919 % 101).cast("int").alias("mtime"), "id", "path"), "file_id", "mtime", "id").select("file_id", "mtime", "path"),
        "SELECT file_id, mtime, path FROM (SELECT id % 60 AS file_id, id * 7919 % 101 AS mtime, path, row_number() OVER (PARTITION BY id % 60 ORDER BY id * 7919 % 101 DESC, id) AS rn FROM path_t) x WHERE rn = 1",
    ),
    "s27_nested_call_graph": (
        lambda r: r["function_t"].join(r["function_call"].select(F.col("caller_id").alias("id"), "callee_id").distinct().groupBy("id").agg(F.array_sort(F.collect_list("callee_id")).alias("calls")), "id", "left").select("id", F.coalesce(F.array_join("calls", ","), F.lit("")).alias("calls")),
        "SELECT f.id, coalesce(string_agg(DISTINCT callee_id::VARCHAR, ',' ORDER BY callee_id::VARCHAR), '') AS calls FROM function_t f LEFT JOIN function_call c ON c.caller_id = f.id GROUP BY f.id".replace("string_agg(DISTINCT callee_id::VARCHAR, ',' ORDER BY callee_id::VARCHAR)", "array_to_string(list_sort(list_distinct(list(callee_id))), ',')"),
    ),
    "s29_inheritance_pairs": (
        lambda r: r["contract_inherit"].unionByName(r["contract_inherit"]).dropDuplicates(["contract_id", "inherited_id"]),
        "SELECT DISTINCT contract_id, inherited_id FROM contract_inherit",
    ),
    "s30_struct_abilities": (
        lambda r: r["lineitem"].select((F.col("l_partkey") % 90).alias("struct_id"), F.element_at(F.array(*map(F.lit, ("copy", "drop", "store", "key"))), (F.col("l_linenumber") % 4 + 1)).alias("ability")).dropDuplicates(["struct_id", "ability"]),
        "SELECT DISTINCT l_partkey % 90 AS struct_id, ['copy','drop','store','key'][l_linenumber % 4 + 1] AS ability FROM lineitem",
    ),
    "s35_graph_payload": (
        lambda r: knowledge.canonical_only(r["semantic_node"], r["semantic_merge"]).select(F.to_json(F.struct("id", F.col("name").alias("label"), F.lit("semantic").alias("type"))).alias("node")),
        f"""SELECT concat('{{"id":', id, ',"label":"', name, '","type":"semantic"}}') AS node FROM ({_CANON}) c""",
    ),
    "s36_report_headings": (
        lambda r: project.report_numbers(r["finding_review"]).join(r["finding_review"].select("reflection_id", "body"), "reflection_id").select(F.concat(F.lit("## "), "number", F.lit(": "), t.truncate_text(F.coalesce("body", F.lit("")), 60)).alias("heading")),
        """SELECT concat('## ', CASE severity WHEN 'High' THEN 'H' WHEN 'Medium' THEN 'M' WHEN 'Low' THEN 'L' WHEN 'Informational' THEN 'I' ELSE 'OOS' END, '-', CASE WHEN rn < 10 THEN concat('0', rn) ELSE rn::VARCHAR END, ': ', regexp_replace(trim(coalesce(body, '')), ' +', ' ', 'g')) AS heading
        FROM (SELECT reflection_id, severity, body, row_number() OVER (PARTITION BY severity ORDER BY reflection_id) AS rn FROM finding_review) x""",
    ),
    "j13_canonical_taxonomy": (
        lambda r: knowledge.canonical_only(r["audit_finding"], r["finding_merge"]).join(r["finding_taxonomy"].select(F.col("audit_finding_id").alias("id"), "category"), "id").select("id", "title", "category"),
        "SELECT f.id, title, category FROM audit_finding f JOIN finding_taxonomy t ON t.audit_finding_id = f.id WHERE f.id NOT IN (SELECT from_id FROM finding_merge)",
    ),
    "j16_match_set": (
        lambda r: knowledge.canonical_only(r["semantic_node"], r["semantic_merge"]).join(r["semantic_matched"].select(F.col("historical_id").alias("id")), "id", "left_semi").join(r["sfl"].groupBy(F.col("semantic_node_id").alias("id")).agg(F.count(F.lit(1)).alias("findings")), "id", "left").select("id", F.coalesce("findings", F.lit(0)).alias("findings")),
        f"SELECT c.id, (SELECT count(*) FROM sfl WHERE semantic_node_id = c.id) AS findings FROM ({_CANON}) c WHERE c.id IN (SELECT historical_id FROM semantic_matched)",
    ),
    "j33_ingested_findings": (
        lambda r: r["audit_finding"].select("title", "severity", (F.col("id") % 3 == 0).alias("grounded"), F.col("id").alias("pos")).where("grounded").withColumn("category", F.lit("Services")).select("pos", "title", "category"),
        "SELECT id AS pos, title, 'Services' AS category FROM audit_finding WHERE id % 3 = 0",
    ),
    "j34_reproduced": (
        lambda r: r["specification"].select("id", "extract_id").join(project.hydrated_findings(r["reflection"], r["harness_run"], r["code_gen"], every_spec(r)).groupBy(F.col("spec_id").alias("id")).agg(_ordered("reflection_id", "reflection_id").alias("ids")), "id", "left").select("id", F.col("ids").isNotNull().alias("reproduced"), F.coalesce("ids", F.lit("")).alias("ids")),
        """WITH v AS (SELECT c.spec_id, string_agg(f.id::VARCHAR, ',' ORDER BY f.id) AS ids FROM reflection f JOIN harness_run h ON h.id = f.run_id JOIN code_gen c ON c.id = h.code_id JOIN specification s ON s.id = c.spec_id WHERE f.result = 'ValidFinding' GROUP BY 1)
        SELECT s.id, ids IS NOT NULL AS reproduced, coalesce(ids, '') AS ids FROM specification s LEFT JOIN v ON v.spec_id = s.id""",
    ),
    "j38_has_variable": (
        lambda r: r["contract"].join(project.visible_variables(r["contract"], r["contract_inherit"], r["state_variable"]).select(F.col("contract_id").alias("id")), "id", "left_semi").select("id", "name"),
        """WITH RECURSIVE up AS (SELECT contract_id AS node, inherited_id AS a FROM contract_inherit UNION SELECT u.node, c.inherited_id FROM up u JOIN contract_inherit c ON c.contract_id = u.a)
        SELECT id, name FROM contract WHERE id IN (SELECT contract_id FROM state_variable WHERE NOT constant) OR id IN (SELECT node FROM up WHERE a IN (SELECT contract_id FROM state_variable WHERE NOT constant))""",
    ),
    "j41_endpoints": (
        lambda r: r["function_t"].alias("a").join(r["function_t"].where("id % 100 = 0").select("name", F.when(F.col("id") % 200 == 0, F.col("path")).alias("want_path")).distinct().alias("w"), "name").where("want_path IS NULL OR want_path = path").select("id", "name", "path").distinct(),
        "WITH w AS (SELECT DISTINCT name, CASE WHEN id % 200 = 0 THEN path END AS want FROM function_t WHERE id % 100 = 0) SELECT DISTINCT id, f.name, path FROM function_t f JOIN w ON w.name = f.name WHERE want IS NULL OR want = path",
    ),
    "w10_candidate_batches": (
        lambda r: keep.greedy_batches(r["semantic_node"].select("category", "id", F.char_length("description").alias("tokens")), ["category"], "id", "tokens", 250, 9).groupBy("category", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")),
        """WITH RECURSIVE t AS (SELECT category, id, length(description) AS tokens, row_number() OVER (PARTITION BY category ORDER BY id) AS k FROM semantic_node),
        w AS (SELECT category, tokens, k, tokens AS used, 1 AS n, 0 AS batch FROM t WHERE k = 1 UNION ALL SELECT t.category, t.tokens, t.k, CASE WHEN w.n >= 9 OR w.used + t.tokens > 250 THEN t.tokens ELSE w.used + t.tokens END,
        CASE WHEN w.n >= 9 OR w.used + t.tokens > 250 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 9 OR w.used + t.tokens > 250 THEN w.batch + 1 ELSE w.batch END FROM w JOIN t ON t.category = w.category AND t.k = w.k + 1)
        SELECT category, batch, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM w GROUP BY 1, 2""",
    ),
    "w14_task_turns": (
        lambda r: state.take_turns(r["harness_run"].where("violated").select("code_id", "id"), "code_id", "id").where("turn <= 2"),
        "SELECT code_id, id, turn FROM (SELECT code_id, id, (row_number() OVER (PARTITION BY code_id ORDER BY id))::INT AS turn FROM harness_run WHERE violated) x WHERE turn <= 2",
    ),
    "w18_project_rows": (
        lambda r: r["project"].agg(F.least(F.lit(12), F.greatest(F.lit(2), F.ceil(F.sqrt(F.count(F.lit(1)))))).cast("int").alias("rows")),
        'SELECT least(12, greatest(2, ceil(sqrt(count(*)))))::INT AS "rows" FROM project',
    ),
    "o02_category_lists": (
        lambda r: r["project_category"].groupBy("project_id").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("category"))), "|").alias("categories")),
        "SELECT project_id, string_agg(DISTINCT category, '|' ORDER BY category) AS categories FROM project_category GROUP BY 1",
    ),
    "o05_newest_reported": (
        lambda r: r["finding_review"].orderBy(F.desc("reflection_id")).limit(10).select("reflection_id", t.truncate_text(F.coalesce("body", F.lit("")), 16).alias("text")),
        "SELECT reflection_id, CASE WHEN length(b) > 16 THEN concat(rtrim(substr(b, 1, 16)), '…') ELSE b END AS text FROM (SELECT reflection_id, regexp_replace(trim(coalesce(body, '')), ' +', ' ', 'g') AS b FROM finding_review ORDER BY reflection_id DESC LIMIT 10) x",
    ),
    "o07_pending_truncation": (
        lambda r: project.reflect_work(r["code_gen"], r["harness_run"], r["reflection"], 15).select("id"),
        "SELECT h.id FROM harness_run h JOIN code_gen c ON c.id = code_id WHERE status = 'Completed' AND violated AND h.id NOT IN (SELECT run_id FROM reflection) ORDER BY h.id LIMIT 15",
    ),
    "o15_source_files": (
        lambda r: r["contract"].select(t.relative_path(F.concat(F.lit("./"), "path")).alias("path")).unionByName(r["contract"].select("path")).dropDuplicates(["path"]),
        "SELECT DISTINCT path FROM contract",
    ),
    "o17_remapping_dedup": (
        lambda r: keep.first_by(r["lineitem"].select((F.col("l_suppkey") % 40).alias("context"), (F.col("l_partkey") % 3).alias("prefix"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")), ["context", "prefix"]),
        "SELECT l_suppkey % 40 AS context, l_partkey % 3 AS prefix, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY 1, 2",
    ),
    "g03_candidate_pairs": (
        lambda r: graph.resolve(r["semantic_node"].where("category = 'SMALL'"), r["semantic_merge"], r["semantic_node"]),
        """WITH RECURSIVE one AS (SELECT from_id, max(to_id) AS to_id FROM semantic_merge GROUP BY from_id HAVING max(to_id) IN (SELECT id FROM semantic_node)),
        walk AS (SELECT id AS node, id AS cur, [id] AS path, false AS closed FROM semantic_node WHERE category = 'SMALL' UNION ALL SELECT w.node, o.to_id, list_append(w.path, o.to_id), list_contains(w.path, o.to_id) FROM walk w JOIN one o ON w.cur = o.from_id WHERE NOT w.closed)
        SELECT node, arg_max(cur, len(path)) AS canonical FROM walk GROUP BY node""",
    ),
    "g10_variable_edges": (
        lambda r: r["lineitem"].select((F.col("l_partkey") % 500).alias("function_id"), (F.col("l_suppkey") % 25).alias("variable_id"), (F.col("l_linestatus") == "O").alias("is_write")).distinct(),
        "SELECT DISTINCT l_partkey % 500 AS function_id, l_suppkey % 25 AS variable_id, l_linestatus = 'O' AS is_write FROM lineitem",
    ),
    "x05_rendered_findings": (
        lambda r: r["finding_merge"].join(r["audit_finding"].select(F.col("id").alias("from_id"), "root_cause"), "from_id").groupBy(F.col("to_id").alias("id")).agg(F.array_sort(F.collect_list("root_cause")).alias("notes")).join(r["audit_finding"].select("id", "title"), "id").select("id", t.render_with_variants(F.col("title"), F.col("notes"), 99).alias("text")),
        "SELECT c.id, concat(trim(c.title), string_agg(concat(chr(10), '— ', k.root_cause), '' ORDER BY k.root_cause)) AS text FROM finding_merge m JOIN audit_finding k ON k.id = m.from_id JOIN audit_finding c ON c.id = m.to_id GROUP BY c.id, c.title",
    ),
    "x07_status_block": (
        lambda r: r["finding_review"].orderBy("reflection_id").limit(3).agg(F.concat(F.lit("reported:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reflection_id", "severity"))), lambda s: F.concat(F.lit("- "), s["severity"])), "\n")).alias("block")),
        "SELECT concat('reported:', chr(10), string_agg('- ' || severity, chr(10) ORDER BY reflection_id)) AS block FROM (SELECT * FROM finding_review ORDER BY reflection_id LIMIT 3) x",
    ),
    "x17_trimmed_findings": (
        lambda r: r["audit_finding"].select("id", *[trim_all(F.concat(F.lit(" \n\t"), c, F.lit("\t "))).alias(c) for c in ("title", "root_cause", "description")]),
        "SELECT id, title, root_cause, description FROM audit_finding",
    ),
    "x21_dot_labels": (
        lambda r: r["semantic_node"].select("id", t.dot_escape(F.concat(F.lit('a"b\\c\n'), "name")).alias("label")),
        r"""SELECT id, concat('a\"b\\c\n', name) AS label FROM semantic_node""",
    ),
    "x28_whole_words": (
        lambda r: r["documents"].select("doc_id", t.whole_word(F.coalesce("text", F.lit("")), "the").alias("hit")),
        r"SELECT doc_id, regexp_matches(coalesce(text, ''), '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])') AS hit FROM documents",
    ),
    "x33_missed_labels": (
        lambda r: project.covered_functions(r["function_t"], r["line_coverage"]).groupBy("path").agg(F.concat_ws("|", F.array_sort(F.collect_list(F.when(~F.col("hit"), F.concat(F.col("path"), F.lit("::"), F.col("id").cast("string")))))).alias("missed")),
        """WITH h AS (SELECT f.path, f.id, EXISTS (SELECT 1 FROM line_coverage l WHERE l.path = f.path AND l.line_number BETWEEN f.start_line AND f.end_line) AS hit FROM function_t f)
        SELECT path, coalesce(string_agg(concat(path, '::', id), '|' ORDER BY concat(path, '::', id)) FILTER (NOT hit), '') AS missed FROM h GROUP BY 1""",
    ),
    "u06_migrated_links": (
        lambda r: state.add_columns(r["sfl"].select("semantic_node_id", "audit_finding_id"), {"strength": "Medium", "evidence": ""}),
        "SELECT semantic_node_id, audit_finding_id, 'Medium' AS strength, '' AS evidence FROM sfl",
    ),
    "u07_written_nodes": (
        lambda r: state.write_items(r["semantic_node"], r["semantic_merge"], _items(r))[0].select("id", "name", "description"),
        """WITH i AS (SELECT * FROM semantic_node WHERE id % 50 = 1), m AS (SELECT max(id) AS m FROM semantic_node)
        SELECT n.id, n.name, coalesce((SELECT concat('told ', i.id) FROM i WHERE i.id % 100 = 1 AND i.id % 3 <> 0 AND n.id IN (i.id + 1, i.id + 2)), description) AS description FROM semantic_node n
        UNION ALL SELECT (m + row_number() OVER (ORDER BY id))::INT, concat('new ', name), description FROM i, m""",
    ),
    "u07_written_edges": (
        lambda r: state.write_items(r["semantic_node"], r["semantic_merge"], _items(r))[1],
        """WITH i AS (SELECT id, (SELECT max(id) FROM semantic_node) + row_number() OVER (ORDER BY id) AS new_id FROM semantic_node WHERE id % 50 = 1)
        SELECT from_id, to_id FROM semantic_merge UNION ALL SELECT new_id::INT, id + k FROM i, (VALUES (1), (2)) v(k) WHERE id % 100 = 1""",
    ),
    "u10_import_projects": (
        lambda r: state.upsert_projects(r["project"], r["project_platform"], r["project_platform"].where("project_id % 3 = 0").select(F.concat(F.lit("imported "), "project_id").alias("name"), "platform_id").unionByName(r["project"].where("id % 7 = 0").select("name", F.lit("none").alias("platform_id")))).where("NOT new").select("name", "id"),
        "SELECT concat('imported ', project_id) AS name, project_id AS id FROM project_platform WHERE project_id % 3 = 0 UNION ALL SELECT name, id FROM project WHERE id % 7 = 0",
    ),
    "u11_provenance_rows": (
        lambda r: state.add_missing(r["project_semantic"], dealt(r["semantic_merge"], r.parts("lineitem"), "from_id").join(dealt(r["project_semantic"], r.parts("lineitem"), "semantic_node_id"), F.col("from_id") == F.col("semantic_node_id")).select("project_id", F.col("to_id").alias("semantic_node_id")), ["project_id", "semantic_node_id"], r.parts("lineitem")),
        "SELECT project_id, semantic_node_id FROM project_semantic UNION SELECT project_id, to_id FROM semantic_merge JOIN project_semantic ON from_id = semantic_node_id",
    ),
    "u12_imported_links": (
        lambda r: state.import_canonicals(
            r["semantic_node"], r["semantic_merge"], r["sfl"].where("semantic_node_id % 4 = 0"),
            r["semantic_node"].where("id % 9 = 1").select("id", "name", "definition", "description", "category", F.when(F.col("id") % 2 == 0, F.array(F.col("id") + 3, F.col("id") + 2)).otherwise(F.array().cast("array<int>")).alias("targets")),
            r["sfl"].where("semantic_node_id % 9 = 1").withColumn("ord", F.struct("semantic_node_id", "ord")),
        )[2],
        """WITH i AS (SELECT id, CASE WHEN id % 2 = 0 THEN id + 2 ELSE ((SELECT max(id) FROM semantic_node) + row_number() OVER (ORDER BY id))::INT END AS c FROM semantic_node WHERE id % 9 = 1),
        e AS (SELECT semantic_node_id AS s, audit_finding_id AS f, strength FROM sfl WHERE semantic_node_id % 4 = 0),
        k AS (SELECT c AS s, audit_finding_id AS f, strength, row_number() OVER (PARTITION BY c, audit_finding_id ORDER BY semantic_node_id, ord) AS rn FROM sfl JOIN i ON i.id = semantic_node_id)
        SELECT s AS semantic_node_id, f AS audit_finding_id, strength FROM e UNION ALL SELECT s, f, strength FROM k WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.s = k.s AND e.f = k.f)""",
    ),
    "u16_written_runs": (
        lambda r: state.write_runs(r["code_gen"].select("id", "status"), r["harness_run"].select("id", "code_id"), r["project"].select(F.col("id").alias("ord"), "status"), r["project"].select(F.col("id").alias("code_ord"), (F.col("id") * 2).alias("run_ord")))[1],
        """SELECT id, code_id FROM harness_run UNION ALL SELECT ((SELECT max(id) FROM harness_run) + row_number() OVER (ORDER BY id))::INT, ((SELECT max(id) FROM code_gen) + row_number() OVER (ORDER BY id))::INT FROM project""",
    ),
    "u19_redo_counts": (
        lambda r: r["reflection"].agg(F.count(F.lit(1)).alias("reflections"), F.count_if(F.col("result") == "ValidFinding").alias("findings")),
        "SELECT count(*) AS reflections, count(*) FILTER (result = 'ValidFinding') AS findings FROM reflection",
    ),
    "u22_self_representatives": (
        lambda r: r["ruled_out_merge"].unionByName(r["ruled_out_merge"].select(F.col("to_id").alias("from_id"), "to_id")).dropDuplicates(["from_id"]).groupBy("to_id").agg(F.count(F.lit(1)).alias("members")),
        "SELECT to_id, count(DISTINCT from_id) AS members FROM (SELECT from_id, to_id FROM ruled_out_merge UNION SELECT to_id, to_id FROM ruled_out_merge) x GROUP BY 1",
    ),
    "t04_requeued": (
        lambda r: r["specification"].select("id").join(r["reflection"].select("id", "result"), "id", "left").select("id", F.when(F.col("result") == "WrongHarness", 1).otherwise(0).alias("lane")).orderBy("lane", "id"),
        "SELECT s.id, CASE WHEN result = 'WrongHarness' THEN 1 ELSE 0 END AS lane FROM specification s LEFT JOIN reflection f ON f.id = s.id",
    ),
    "t08_completed_findings": (
        lambda r: state.completed(r["lineitem"].select(F.col("l_orderkey").alias("finding_id"), F.col("l_linenumber").alias("context"), (F.col("l_returnflag") == "R").alias("failed")), r["lineitem"].groupBy(F.col("l_orderkey").alias("finding_id")).agg(F.max("l_linenumber").cast("long").alias("contexts"))),
        "SELECT l_orderkey AS finding_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = max(l_linenumber) AND NOT bool_or(l_returnflag = 'R')",
    ),
    "a14_severity_tally": (
        lambda r: r["finding_review"].agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in REVIEW_SEVERITIES], F.max(rank("severity", REVIEW_SEVERITIES)).alias("worst")),
        f"""SELECT count(*) FILTER (severity = 'ReviewedOutOfScope') AS reviewedoutofscope, count(*) FILTER (severity = 'Informational') AS informational, count(*) FILTER (severity = 'Low') AS low,
        count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'High') AS high, max({_SEV}) AS worst FROM finding_review""",
    ),
}
