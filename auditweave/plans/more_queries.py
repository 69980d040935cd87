"""Code, state and layout queries: name -> (plan, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.enums import REVIEW_SEVERITIES, STRENGTHS, parse_language, rank
from ..operators import code, graph, keep, knowledge, project, state, stats
from ..sources import formats
from .graph_queries import _walk

_SEV = "CASE severity WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 WHEN 'Informational' THEN 1 ELSE 0 END"
_OWNED = """owned AS (SELECT f.*, CASE WHEN owner_id % 3 = 0 THEN 'contract' WHEN owner_id % 3 = 1 THEN 'interface' ELSE 'unknown' END AS kind,
CASE WHEN owner_id % 3 = 0 THEN concat('C', owner_id) WHEN owner_id % 3 = 1 THEN concat('I', owner_id) ELSE '?' END AS owner FROM function_t f)"""


def _owned(r):
    contracts = r["contract"].where("id % 3 = 0 AND id < 97")
    interfaces = r["contract"].where("id % 3 = 1 AND id < 97").select("id", F.concat(F.lit("I"), "id").alias("name"))
    return code.owner_of(r["function_t"], contracts, interfaces)


def _steps(r):
    return r["function_t"].select("id", F.concat(F.when(F.col("id") % 4 == 0, "C").otherwise("I"), "owner_id").alias("contract"), F.when(F.col("id") % 10 == 0, "none").otherwise(F.col("name")).alias("function"))


QUERIES = {
    "s10_merge_tables": (
        lambda r: formats.merge_tables(r["project"].select("id", "name"), r["project"].select("id", F.concat("name", F.when(F.col("id") % 2 == 0, "").otherwise("x")).alias("name")), "name")[0],
        """SELECT id, name FROM project UNION ALL SELECT ((SELECT max(id) FROM project) + row_number() OVER (ORDER BY id))::INT, concat(name, 'x') FROM project WHERE id % 2 <> 0""",
    ),
    "s13_scope_filter": (
        lambda r: r["path_t"].where(t.matches_any(F.col("path"), formats.scope_globs(["# note", "./src/", "/lib/F9.sol", "", "contracts/*/*.sol"]))).select("id", "path"),
        "SELECT id, path FROM path_t WHERE path LIKE 'src/%' OR path = 'lib/F9.sol' OR path LIKE 'contracts/test/%.sol'",
    ),
    "s16_first_root": (
        lambda r: r["path_t"].select((F.col("id") % 40).alias("file_id"), (F.col("id") % 3).alias("root"), F.col("id"), "path").groupBy("file_id").agg(F.min_by("path", F.struct("root", "id")).alias("path")),
        "SELECT file_id, path FROM (SELECT id % 40 AS file_id, path, row_number() OVER (PARTITION BY id % 40 ORDER BY id % 3, id) AS rn FROM path_t) x WHERE rn = 1",
    ),
    "s17_latest_snapshots": (
        lambda r: state.latest(r["orders"].select((F.col("o_custkey") % 50).alias("commit_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("sort_key"), "o_orderkey"), "commit_id", "sort_key", "o_orderkey"),
        """SELECT commit_id, sort_key, o_orderkey FROM (SELECT o_custkey % 50 AS commit_id, strftime(o_orderdate, '%Y%m%d') AS sort_key, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY strftime(o_orderdate, '%Y%m%d') DESC, o_orderkey) AS rn FROM orders) x WHERE rn = 1""",
    ),
    "s18_findings_by_commit": (
        lambda r: r["audit_finding"].groupBy((F.col("id") % 100).alias("commit_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "severity"))), lambda s: s["severity"]), ",").alias("severities")),
        "SELECT id % 100 AS commit_id, string_agg(severity, ',' ORDER BY id) AS severities FROM audit_finding GROUP BY 1",
    ),
    "s19_numeric_folders": (
        lambda r: r["pages"].select(F.element_at(F.split(F.split("url", r"\?")[0], "/"), -1).alias("name")).where("name RLIKE '^[0-9]+$'").select(F.col("name").cast("int").alias("contest")).distinct(),
        r"SELECT DISTINCT regexp_extract(split_part(url, '?', 1), '/([0-9]+)$', 1)::INT AS contest FROM pages WHERE regexp_matches(split_part(url, '?', 1), '/[0-9]+$')",
    ),
    "s20_project_specs": (
        lambda r: r["project"].select(F.split(F.concat_ws(":", "name", F.lit("p/x"), "id"), ":", 3).alias("p")).select(F.col("p")[0].alias("name"), F.col("p")[1].alias("path"), F.col("p")[2].alias("platform")),
        "SELECT name, 'p/x' AS path, id::VARCHAR AS platform FROM project",
    ),
    "s21_languages": (
        lambda r: r["path_t"].select(F.substring_index("path", ".", -1).alias("ext")).groupBy(parse_language("ext").alias("language")).agg(F.count(F.lit(1)).alias("files")),
        "SELECT 'Solidity' AS language, count(*) AS files FROM path_t",
    ),
    "s26_findings_json": (
        lambda r: formats.findings_json(r["audit_finding"].select("id", F.to_json(F.array(F.struct(F.col("title"), F.when(F.col("severity") != "Low", F.col("severity")).alias("severity")))).alias("text"))).select("id", "title", "severity"),
        "SELECT id, title, CASE WHEN severity = 'Low' THEN 'Medium' ELSE severity END AS severity FROM audit_finding",
    ),
    "s31_nested_semantics": (
        lambda r: r["semantic_function"].groupBy("semantic_node_id").agg(F.array_sort(F.collect_list("function_name")).alias("fs")).select("semantic_node_id", F.to_json("fs").alias("functions")),
        """SELECT semantic_node_id, concat('["', string_agg(function_name, '","' ORDER BY function_name), '"]') AS functions FROM semantic_function GROUP BY 1""",
    ),
    "s32_match_set": (
        lambda r: keep.first_by(
            r["semantic_matched"].select(F.col("historical_id").alias("id"), F.lit("match").alias("origin"), F.lit(0).alias("ord")).unionByName(r["semantic_merge"].select(F.col("from_id").alias("id"), F.lit("child").alias("origin"), F.lit(1).alias("ord"))), ["id"]
        ).select("id", "origin"),
        "SELECT DISTINCT historical_id AS id, 'match' AS origin FROM semantic_matched UNION ALL SELECT DISTINCT from_id, 'child' FROM semantic_merge WHERE from_id NOT IN (SELECT historical_id FROM semantic_matched)",
    ),
    "s33_metadata_put": (
        lambda r: state.put(r["events"].where("event_id % 2 = 0").select((F.col("event_id") % 100).alias("key"), F.col("event_id").alias("n")).groupBy("key").agg(F.max("n").alias("n")), r["events"].where("event_id % 3 = 0").select((F.col("event_id") % 100).alias("key"), (-F.col("event_id")).alias("n")), ["key"], "n"),
        """WITH a AS (SELECT event_id % 100 AS key, max(event_id) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_id % 100 AS key, max(-event_id) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1)
        SELECT key, n FROM b UNION ALL SELECT key, n FROM a WHERE key NOT IN (SELECT key FROM b)""",
    ),
    "j30_step_resolution": (
        lambda r: code.resolve_steps(_steps(r), _owned(r)).fillna(-1, ["function_id", "tier"]),
        f"""WITH {_OWNED}, st AS (SELECT id, concat(CASE WHEN id % 4 = 0 THEN 'C' ELSE 'I' END, owner_id) AS contract, CASE WHEN id % 10 = 0 THEN 'none' ELSE name END AS fn FROM function_t),
        c AS (SELECT st.id, CASE WHEN o.kind = 'contract' THEN 0 ELSE 1 END AS tier, o.id AS fid FROM st JOIN owned o ON o.owner = st.contract AND o.name = st.fn UNION ALL SELECT st.id, 2, o.id FROM st JOIN owned o ON o.name = st.fn),
        b AS (SELECT id, tier, fid, row_number() OVER (PARTITION BY id ORDER BY tier, fid) AS rn FROM c)
        SELECT st.id, contract, fn AS "function", coalesce(fid, -1) AS function_id, coalesce(tier, -1) AS tier FROM st LEFT JOIN b ON b.id = st.id AND rn = 1""",
    ),
    "j31_sequence_overlap": (
        lambda r: r["orders"].select("o_orderkey", *[F.array(F.struct(F.concat(F.lit("c"), (F.col("o_orderkey") % a).cast("string")).alias("contract"), F.concat(F.lit("f"), (F.col("o_custkey") % b).cast("string")).alias("function"))).alias(n) for n, a, b in (("calls", 2, 3), ("spec", 4, 2))]).select("o_orderkey", code.sequence_overlap(F.col("calls"), F.col("spec")).alias("overlap")),
        "SELECT o_orderkey, CASE WHEN o_custkey % 3 <> o_custkey % 2 THEN 'disjoint' WHEN o_orderkey % 2 = o_orderkey % 4 THEN 'pair' ELSE 'function' END AS overlap FROM orders",
    ),
    "j32_grounding": (
        lambda r: code.ground(r["function_t"].select(F.col("id").alias("pos"), F.when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("c"), (F.col("owner_id") * (F.col("id") % 2 + 1)).cast("string"))).alias("contract"), F.upper("name").alias("function")), r["contract"].where("id < 97"), r["function_t"]).select("pos", F.coalesce("contract_id", F.lit(-1)).alias("contract_id"), F.coalesce("reason", F.lit("")).alias("reason")),
        """SELECT f.id AS pos, coalesce(c.id, -1) AS contract_id, CASE WHEN f.id % 5 = 0 THEN '' WHEN c.id IS NULL THEN 'unknown contract' WHEN NOT EXISTS (SELECT 1 FROM function_t g WHERE g.owner_id = c.id AND lower(g.name) = lower(f.name)) THEN 'unknown function' ELSE '' END AS reason
        FROM function_t f LEFT JOIN contract c ON c.id < 97 AND f.id % 5 <> 0 AND c.id = f.owner_id * (f.id % 2 + 1)""",
    ),
    "j35_interface_methods": (
        lambda r: code.interface_methods(r["function_t"].select("id", F.col("owner_id"), F.concat(F.lit("m"), F.col("id") % 4).alias("name")), r["contract_inherit"], r["contract"].select("id", (F.col("id") % 2 == 0).alias("concrete"))),
        """WITH RECURSIVE up AS (SELECT contract_id AS node, inherited_id AS a FROM contract_inherit UNION SELECT u.node, c.inherited_id FROM up u JOIN contract_inherit c ON c.contract_id = u.a),
        reach AS (SELECT id AS o, id AS impl FROM contract WHERE id % 2 = 0 UNION SELECT a, node FROM up)
        SELECT DISTINCT f.id, g.id AS target FROM function_t f JOIN reach ON o = f.owner_id JOIN function_t g ON g.owner_id = impl AND g.id % 4 = f.id % 4""",
    ),
    "j36_function_owners": (lambda r: _owned(r).select("id", "kind", "owner"), f"WITH {_OWNED} SELECT id, kind, owner FROM owned"),
    "j39_function_labels": (lambda r: code.label(_owned(r)), f"WITH {_OWNED} SELECT id, concat(kind, ' ', owner, '::', name, ' @ ', path) AS label FROM owned"),
    "j40_inherit_by_name": (
        lambda r: code.inherit_by_name(r["contract"].select("id", F.concat(F.lit("N"), F.col("id") % 300).alias("name")), r["contract_inherit"].select("contract_id", F.concat(F.lit("N"), F.col("inherited_id")).alias("base"))).fillna(-1, ["inherited_id"]),
        """WITH b AS (SELECT contract_id, concat('N', inherited_id) AS base FROM contract_inherit), n AS (SELECT id, concat('N', id % 300) AS name FROM contract),
        h AS (SELECT contract_id, base, id AS inherited_id FROM b JOIN n ON name = base WHERE id <> contract_id)
        SELECT * FROM h UNION ALL SELECT contract_id, base, -1 FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.contract_id = b.contract_id AND h.base = b.base)""",
    ),
    "j42_scope_intersect": (
        lambda r: code.in_scope(r["path_t"].select("path"), r["path_t"].where("id % 2 = 0")),
        "SELECT path, id % 2 = 0 AS available FROM path_t",
    ),
    "w07_take_turns": (
        lambda r: state.take_turns(r["semantic_matched"].select("extract_id", "historical_id"), "extract_id", "historical_id"),
        "SELECT extract_id, historical_id, (row_number() OVER (PARTITION BY extract_id ORDER BY historical_id))::INT AS turn FROM semantic_matched",
    ),
    "w13_candidate_groups": (
        lambda r: graph.resolve(r["semantic_node"], r["semantic_merge"], r["semantic_node"]).join(r["semantic_node"].select(F.col("id").alias("node"), "name"), "node").groupBy("canonical").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("node") != F.col("canonical")).alias("late"), "name", "node"))), lambda s: s["node"].cast("string")), ",").alias("members")
        ),
        f"""WITH RECURSIVE {_walk("semantic_node", "semantic_merge", known=True)} SELECT canonical, string_agg(node::VARCHAR, ',' ORDER BY node <> canonical, name, node) AS members FROM res JOIN semantic_node ON id = node GROUP BY canonical""",
    ),
    "w16_first_updates": (
        lambda r: state.first_updates(r["lineitem"].groupBy("l_orderkey").agg(F.min("l_linenumber").alias("m")).select((F.col("l_orderkey") % 500).alias("key"), F.col("l_orderkey").alias("ord"), (F.col("l_orderkey") % 7).alias("target"), F.when(F.col("l_orderkey") % 2 == 0, " ").otherwise(F.concat(F.lit("t"), "l_orderkey")).alias("text")), "key", "ord").select("key", F.array_join("targets", ",").alias("targets"), "text"),
        """WITH o AS (SELECT DISTINCT l_orderkey % 500 AS key, l_orderkey AS o, l_orderkey % 7 AS target FROM lineitem), f AS (SELECT key, target, min(o) AS o FROM o GROUP BY 1, 2)
        SELECT key, string_agg(target::VARCHAR, ',' ORDER BY o) AS targets, (SELECT concat('t', min(o.o)) FROM o WHERE o.key = f.key AND o.o % 2 <> 0 HAVING count(*) > 0) AS text FROM f GROUP BY key""",
    ),
    "w17_grid_positions": (
        lambda r: r["semantic_node"].select("id", F.pmod(F.col("id"), F.lit(20)).alias("column"), F.floor(F.col("id") / 20).alias("row"), (F.pmod(F.col("id"), F.lit(20)) * 180 - 1710).alias("x")),
        'SELECT id, id % 20 AS "column", id // 20 AS "row", (id % 20) * 180 - 1710 AS x FROM semantic_node',
    ),
    "o13_merge_decisions": (
        lambda r: state.decisions(r["semantic_node"].select("id", F.concat("name", "id").alias("name")), r["semantic_node"].where("id % 5 = 0").select(F.upper(F.concat("name", "id")).alias("name"), F.when(F.col("id") % 2 == 0, F.array("id")).otherwise(F.array().cast("array<int>")).alias("targets"))),
        "SELECT id, concat(name, id) AS name, CASE WHEN id % 10 = 0 THEN 'Merge' ELSE 'New' END AS action FROM semantic_node",
    ),
    "o14_carried_links": (
        lambda r: state.carry_links(r["sfl"].where("semantic_node_id % 4 = 0"), r["sfl"].where("semantic_node_id % 4 <> 0").withColumn("ord", F.struct("semantic_node_id", "ord")), graph.resolve(r["semantic_node"], r["semantic_merge"], r["semantic_node"])),
        f"""WITH RECURSIVE {_walk("semantic_node", "semantic_merge", known=True)}, e AS (SELECT semantic_node_id AS s, audit_finding_id AS f, strength FROM sfl WHERE semantic_node_id % 4 = 0),
        c AS (SELECT canonical AS s, audit_finding_id AS f, strength, row_number() OVER (PARTITION BY canonical, audit_finding_id ORDER BY semantic_node_id, ord) AS rn FROM sfl JOIN res ON node = semantic_node_id WHERE semantic_node_id % 4 <> 0)
        SELECT s AS semantic_node_id, f AS audit_finding_id, strength FROM e UNION ALL SELECT s, f, strength FROM c WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.s = c.s AND e.f = c.f)""",
    ),
    "a01_kg_stats": (
        lambda r: stats.overview(r, r.parts("lineitem")),
        """WITH sr AS (SELECT id, count(DISTINCT project_id) AS n FROM (SELECT semantic_node_id AS id, project_id FROM project_semantic UNION ALL SELECT to_id, project_id FROM project_semantic JOIN semantic_merge ON from_id = semantic_node_id) x
          WHERE id IN (SELECT id FROM semantic_node) AND id NOT IN (SELECT from_id FROM semantic_merge) GROUP BY 1),
        fr AS (SELECT id, count(DISTINCT project_id) AS n FROM (SELECT audit_finding_id AS id, project_id FROM project_finding UNION ALL SELECT to_id, project_id FROM project_finding JOIN finding_merge ON from_id = audit_finding_id) x
          WHERE id IN (SELECT id FROM audit_finding) AND id NOT IN (SELECT from_id FROM finding_merge) GROUP BY 1),
        m(measure, value) AS (
        SELECT 'projects_total', CAST(count(*) AS DOUBLE) FROM project
        UNION ALL SELECT 'projects_completed', CAST(count(*) FILTER (status = 'completed') AS DOUBLE) FROM project
        UNION ALL SELECT concat('platform:', string_split(platform_id, '-')[1]), count(*)::DOUBLE FROM project_platform GROUP BY 1
        UNION ALL SELECT 'semantics_total', CAST(count(*) AS DOUBLE) FROM semantic_node
        UNION ALL SELECT 'semantics_there_folded', CAST(count(*) FILTER (id IN (SELECT from_id FROM semantic_merge)) AS DOUBLE) FROM semantic_node
        UNION ALL SELECT 'semantic_name_length', CAST(floor(avg(length(name))) AS DOUBLE) FROM semantic_node
        UNION ALL SELECT 'semantic_definition_length', CAST(floor(avg(length(definition))) AS DOUBLE) FROM semantic_node
        UNION ALL SELECT 'semantic_description_length', CAST(floor(avg(length(description))) AS DOUBLE) FROM semantic_node
        UNION ALL SELECT 'semantics_folded', CAST(count(DISTINCT from_id) AS DOUBLE) FROM semantic_merge
        UNION ALL SELECT 'semantic_merge_edges', CAST(count(*) AS DOUBLE) FROM semantic_merge
        UNION ALL SELECT 'findings_total', CAST(count(*) AS DOUBLE) FROM audit_finding
        UNION ALL SELECT 'findings_high', CAST(count(*) FILTER (severity = 'High') AS DOUBLE) FROM audit_finding
        UNION ALL SELECT 'findings_medium', CAST(count(*) FILTER (severity = 'Medium') AS DOUBLE) FROM audit_finding
        UNION ALL SELECT 'findings_low', CAST(count(*) FILTER (severity = 'Low') AS DOUBLE) FROM audit_finding
        UNION ALL SELECT 'finding_title_length', CAST(floor(avg(length(title))) AS DOUBLE) FROM audit_finding
        UNION ALL SELECT 'finding_root_cause_length', CAST(floor(avg(length(root_cause))) AS DOUBLE) FROM audit_finding
        UNION ALL SELECT 'finding_description_length', CAST(floor(avg(length(description))) AS DOUBLE) FROM audit_finding
        UNION ALL SELECT 'findings_folded', CAST(count(DISTINCT from_id) AS DOUBLE) FROM finding_merge
        UNION ALL SELECT 'finding_merge_edges', CAST(count(*) AS DOUBLE) FROM finding_merge
        UNION ALL SELECT 'semantic_max_parents', CAST(max(n) AS DOUBLE) FROM (SELECT count(*) AS n FROM semantic_merge GROUP BY from_id)
        UNION ALL SELECT 'finding_max_parents', CAST(max(n) AS DOUBLE) FROM (SELECT count(*) AS n FROM finding_merge GROUP BY from_id)
        UNION ALL SELECT 'link_processed_findings', CAST(count(*) AS DOUBLE) FROM finding_link_status
        UNION ALL SELECT 'pending_semantics', CAST(count(*) AS DOUBLE) FROM pending_semantic
        UNION ALL SELECT 'merge_status_rows', CAST(count(*) AS DOUBLE) FROM merge_status
        UNION ALL SELECT 'semantic_functions_total', CAST(count(*) AS DOUBLE) FROM semantic_function
        UNION ALL SELECT 'project_categories', CAST(count(*) AS DOUBLE) FROM project_category
        UNION ALL SELECT 'semantic_projects', CAST(sum(n) AS DOUBLE) FROM sr
        UNION ALL SELECT 'max_projects_per_canonical_semantic', CAST(max(n) AS DOUBLE) FROM sr
        UNION ALL SELECT 'finding_projects', CAST(sum(n) AS DOUBLE) FROM fr
        UNION ALL SELECT concat('semantic_category:', category), count(*)::DOUBLE FROM semantic_node WHERE id NOT IN (SELECT from_id FROM semantic_merge) GROUP BY 1
        UNION ALL SELECT concat('finding_category:', category), count(*)::DOUBLE FROM finding_taxonomy GROUP BY 1
        UNION ALL SELECT 'links_total', CAST(count(*) AS DOUBLE) FROM sfl
        UNION ALL SELECT 'links_in_project', CAST(count(*) FILTER (NOT (NOT starts_with(evidence, 'in-project link:'))) AS DOUBLE) FROM sfl
        UNION ALL SELECT 'links_cross', CAST(count(*) FILTER (NOT starts_with(evidence, 'in-project link:')) AS DOUBLE) FROM sfl
        UNION ALL SELECT 'cross_links_on_folded_findings', CAST(count(*) FILTER (NOT starts_with(evidence, 'in-project link:') AND audit_finding_id IN (SELECT from_id FROM finding_merge)) AS DOUBLE) FROM sfl
        UNION ALL SELECT 'cross_linked_findings', CAST(count(DISTINCT audit_finding_id) FILTER (NOT starts_with(evidence, 'in-project link:')) AS DOUBLE) FROM sfl
        UNION ALL SELECT 'cross_linked_semantics', CAST(count(DISTINCT semantic_node_id) FILTER (NOT starts_with(evidence, 'in-project link:')) AS DOUBLE) FROM sfl
        UNION ALL SELECT 'total_high', CAST(count(*) FILTER (true AND strength = 'High') AS DOUBLE) FROM sfl
        UNION ALL SELECT 'total_medium', CAST(count(*) FILTER (true AND strength = 'Medium') AS DOUBLE) FROM sfl
        UNION ALL SELECT 'total_low', CAST(count(*) FILTER (true AND strength = 'Low') AS DOUBLE) FROM sfl
        UNION ALL SELECT 'in_project_high', CAST(count(*) FILTER (NOT (NOT starts_with(evidence, 'in-project link:')) AND strength = 'High') AS DOUBLE) FROM sfl
        UNION ALL SELECT 'in_project_medium', CAST(count(*) FILTER (NOT (NOT starts_with(evidence, 'in-project link:')) AND strength = 'Medium') AS DOUBLE) FROM sfl
        UNION ALL SELECT 'in_project_low', CAST(count(*) FILTER (NOT (NOT starts_with(evidence, 'in-project link:')) AND strength = 'Low') AS DOUBLE) FROM sfl
        UNION ALL SELECT 'cross_high', CAST(count(*) FILTER (NOT starts_with(evidence, 'in-project link:') AND strength = 'High') AS DOUBLE) FROM sfl
        UNION ALL SELECT 'cross_medium', CAST(count(*) FILTER (NOT starts_with(evidence, 'in-project link:') AND strength = 'Medium') AS DOUBLE) FROM sfl
        UNION ALL SELECT 'cross_low', CAST(count(*) FILTER (NOT starts_with(evidence, 'in-project link:') AND strength = 'Low') AS DOUBLE) FROM sfl)
        SELECT measure, value FROM m
        UNION ALL SELECT 'semantics_canonical', (SELECT value FROM m WHERE measure = 'semantics_total') - (SELECT value FROM m WHERE measure = 'semantics_folded')
        UNION ALL SELECT 'findings_canonical', (SELECT value FROM m WHERE measure = 'findings_total') - (SELECT value FROM m WHERE measure = 'findings_folded')
        UNION ALL SELECT 'functions_per_raw_semantic', round((SELECT value FROM m WHERE measure = 'semantic_functions_total') / (SELECT value FROM m WHERE measure = 'semantics_total'), 6)
        UNION ALL SELECT 'projects_per_canonical_semantic', round((SELECT value FROM m WHERE measure = 'semantic_projects') / ((SELECT value FROM m WHERE measure = 'semantics_total') - (SELECT value FROM m WHERE measure = 'semantics_folded')), 6)
        UNION ALL SELECT 'projects_per_canonical_finding', round((SELECT value FROM m WHERE measure = 'finding_projects') / ((SELECT value FROM m WHERE measure = 'findings_total') - (SELECT value FROM m WHERE measure = 'findings_folded')), 6)
        UNION ALL SELECT 'categories_per_project', round((SELECT value FROM m WHERE measure = 'project_categories') / (SELECT value FROM m WHERE measure = 'projects_total'), 6)
        UNION ALL SELECT 'cross_links_per_canonical_finding', round((SELECT value FROM m WHERE measure = 'links_cross') / ((SELECT value FROM m WHERE measure = 'findings_total') - (SELECT value FROM m WHERE measure = 'findings_folded')), 6)
        UNION ALL SELECT 'cross_high_per_canonical_finding', round((SELECT value FROM m WHERE measure = 'cross_high') / ((SELECT value FROM m WHERE measure = 'findings_total') - (SELECT value FROM m WHERE measure = 'findings_folded')), 6)
        UNION ALL SELECT 'cross_links_per_canonical_semantic', round((SELECT value FROM m WHERE measure = 'links_cross') / ((SELECT value FROM m WHERE measure = 'semantics_total') - (SELECT value FROM m WHERE measure = 'semantics_folded')), 6)""",
    ),
    "a01_kg_overview": (
        lambda r: r["project"].agg(F.count(F.lit(1)).alias("projects"), F.count_if(F.col("status") == "completed").alias("completed")).crossJoin(r["project_semantic"].agg(F.count(F.lit(1)).alias("project_semantics"))).crossJoin(
            r["semantic_function"].agg(F.count(F.lit(1)).alias("functions"))).crossJoin(r["pending_semantic"].agg(F.count(F.lit(1)).alias("pending"))).crossJoin(r["finding_link_status"].agg(F.count(F.lit(1)).alias("processed"))),
        """SELECT (SELECT count(*) FROM project) AS projects, (SELECT count(*) FROM project WHERE status = 'completed') AS completed, (SELECT count(*) FROM project_semantic) AS project_semantics,
        (SELECT count(*) FROM semantic_function) AS functions, (SELECT count(*) FROM pending_semantic) AS pending, (SELECT count(*) FROM finding_link_status) AS processed""",
    ),
    "a16_usage": (
        lambda r: state.usage(r["lineitem"].select((F.col("l_suppkey") % 10).alias("phase"), F.col("l_quantity").cast("long").alias("tokens"), (F.col("l_quantity").cast("decimal(10,0)") / 4).alias("usd")), "phase").select("phase", "tokens", F.col("usd").cast("double").alias("usd")),
        "SELECT l_suppkey % 10 AS phase, sum(l_quantity::BIGINT)::BIGINT AS tokens, sum(l_quantity::BIGINT) / 4.0 AS usd FROM lineitem GROUP BY 1",
    ),
    "a19_run_reduction": (
        lambda r: r["harness_run"].groupBy("code_id").agg(F.sum("calls").alias("calls"), F.sum("reverts").alias("reverts"), F.max("violated").alias("violated"), F.min_by("reason", F.when(F.col("violated"), F.col("id"))).alias("reason")).where("violated"),
        """SELECT code_id, sum(calls)::BIGINT AS calls, sum(reverts)::BIGINT AS reverts, true AS violated, arg_min(reason, id) FILTER (violated) AS reason FROM harness_run GROUP BY 1 HAVING bool_or(violated)""",
    ),
    "a21_node_type_counts": (
        lambda r: r["semantic_node"].select(F.lit("semantic").alias("type")).unionByName(r["audit_finding"].select(F.lit("finding").alias("type"))).unionByName(r["project"].select(F.lit("project").alias("type"))).groupBy("type").agg(F.count(F.lit(1)).alias("n")),
        "SELECT 'semantic' AS type, count(*) AS n FROM semantic_node UNION ALL SELECT 'finding', count(*) FROM audit_finding UNION ALL SELECT 'project', count(*) FROM project",
    ),
    "a22_folded_share": (
        lambda r: stats.folded_share(r["semantic_node"], r["semantic_merge"]),
        "SELECT category, count(*) FILTER (id IN (SELECT from_id FROM semantic_merge)) AS folded, count(*) AS total FROM semantic_node GROUP BY 1",
    ),
    "a24_batch_slack": (
        lambda r: keep.greedy_batches(r["finding_taxonomy"].join(r["audit_finding"].select(F.col("id").alias("audit_finding_id"), F.char_length("description").alias("tokens")), "audit_finding_id").select("category", "audit_finding_id", "tokens"), ["category"], "audit_finding_id", "tokens", 1000, 12).groupBy("category", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("used")).where("n = 12").groupBy("category").agg(F.count(F.lit(1)).alias("capped"), F.sum(1000 - F.col("used")).alias("slack")),
        """WITH t AS (SELECT category, length(description) AS tokens, (row_number() OVER (PARTITION BY category ORDER BY audit_finding_id) - 1) // 12 AS batch FROM finding_taxonomy x JOIN audit_finding f ON f.id = x.audit_finding_id),
        b AS (SELECT category, batch, count(*) AS n, sum(tokens) AS used FROM t GROUP BY 1, 2) SELECT category, count(*) AS capped, sum(1000 - used)::BIGINT AS slack FROM b WHERE n = 12 GROUP BY 1""",
    ),
    "a25_issue_counts": (
        lambda r: r["semantic_merge"].join(r["semantic_node"].select(F.col("id").alias("to_id")), "to_id", "left_anti").agg(F.count(F.lit(1)).alias("detected")),
        "SELECT count(*) AS detected FROM semantic_merge WHERE to_id NOT IN (SELECT id FROM semantic_node)",
    ),
    "x03_label_variants": (
        lambda r: r["semantic_node"].select("id", F.when(F.trim("name") == "", F.concat(F.lit("additional context: "), "definition")).otherwise(F.concat(F.lit('additional context (from raw "'), "name", F.lit('"): '), "definition")).alias("note")),
        """SELECT id, concat('additional context (from raw "', name, '"): ', definition) AS note FROM semantic_node""",
    ),
    "x09_taxonomy_pairs": (
        lambda r: r["finding_taxonomy"].withColumn("key", t.normalize_key(F.upper("category"))).join(F.broadcast(r["finding_taxonomy"].select("category_id", t.normalize_key(F.col("category")).alias("key")).distinct().withColumnRenamed("category_id", "known")), "key").select("audit_finding_id", "known"),
        "SELECT audit_finding_id, category_id AS known FROM finding_taxonomy",
    ),
    "x23_relative_paths": (lambda r: r["path_t"].select("id", t.relative_path(F.concat(F.lit(" ././"), "path")).alias("path")), "SELECT id, path FROM path_t"),
    "x30_snapshot_keys": (
        lambda r: r["orders"].select("o_orderkey", t.snapshot_key(F.concat(F.lit("a_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_010203"))).alias("key"), t.is_commit(F.sha1(F.col("o_orderkey").cast("string").cast("binary"))).alias("commit")),
        "SELECT o_orderkey, concat(strftime(o_orderdate, '%Y%m%d'), '_010203') AS key, true AS \"commit\" FROM orders",
    ),
    "x39_remappings": (
        lambda r: r["project"].select("id", t.remapping(F.concat(F.lit("ctx:@"), "name", F.lit("/=lib/"), "name")).alias("m")).select("id", "m.context", "m.prefix", "m.path"),
        "SELECT id, 'ctx' AS context, concat('@', name, '/') AS prefix, concat('lib/', name) AS path FROM project",
    ),
    "u02_mark_complete": (
        lambda r: state.add_missing(r["finding_link_status"], r["audit_finding"].where("id % 2 = 0").select(F.col("id").alias("audit_finding_id")), ["audit_finding_id"]),
        "SELECT audit_finding_id FROM finding_link_status UNION SELECT id FROM audit_finding WHERE id % 2 = 0",
    ),
    "u08_enqueue_pending": (
        lambda r: state.add_missing(r["pending_semantic"], knowledge.canonical_only(r["semantic_node"], r["semantic_merge"]).where("id % 10 = 3").select(F.col("id").alias("semantic_node_id")), ["semantic_node_id"]),
        "SELECT semantic_node_id FROM pending_semantic UNION SELECT id FROM semantic_node WHERE id % 10 = 3 AND id NOT IN (SELECT from_id FROM semantic_merge)",
    ),
    "u09_set_platform": (
        lambda r: state.put(r["project_platform"], r["project"].where("id % 9 = 0").select(F.col("id").alias("project_id"), F.concat(F.lit("new-"), "id").alias("platform_id")), ["project_id"]),
        "SELECT project_id, platform_id FROM project_platform WHERE project_id % 9 <> 0 UNION ALL SELECT id, concat('new-', id) FROM project WHERE id % 9 = 0",
    ),
    "u15_append_specs": (
        lambda r: state.with_new_ids(r["specification"], r["project"].select(F.col("id").alias("ord"), "name"), "ord").select("id", "ord", "name"),
        "SELECT ((SELECT max(id) FROM specification) + row_number() OVER (ORDER BY id))::INT AS id, id AS ord, name FROM project",
    ),
    "u18_reflection_rules": (
        lambda r: r["reflection"].select("id", F.when(F.col("result").isin("IntendedBehavior", "NotReproducible"), F.col("claim")).alias("claim")),
        "SELECT id, CASE WHEN result IN ('IntendedBehavior', 'NotReproducible') THEN claim END AS claim FROM reflection",
    ),
    "u20_review_put": (
        lambda r: state.put(r["finding_review"].select("reflection_id", "severity"), r["finding_review"].where("reflection_id % 4 = 0").select("reflection_id", F.lit("Low").alias("severity")), ["reflection_id"]),
        "SELECT reflection_id, CASE WHEN reflection_id % 4 = 0 THEN 'Low' ELSE severity END AS severity FROM finding_review",
    ),
    "u21_raised_severity": (
        lambda r: state.raise_severity(r["finding_review"].select(F.col("reflection_id").alias("id"), "severity"), r["report_merge"].join(r["finding_review"], F.col("from_id") == F.col("reflection_id")).select("to_id", "severity")),
        f"""WITH b AS (SELECT reflection_id AS id, severity FROM finding_review UNION ALL SELECT to_id, severity FROM report_merge JOIN finding_review ON reflection_id = from_id WHERE to_id IN (SELECT reflection_id FROM finding_review))
        SELECT id, arg_max(severity, {_SEV}) AS severity FROM b GROUP BY id""",
    ),
    "v08_coverage_gate": (
        lambda r: project.fidelity(project.covered_functions(r["function_t"], r["line_coverage"]), "path").select("path", "passed"),
        """WITH h AS (SELECT f.path, EXISTS (SELECT 1 FROM line_coverage l WHERE l.path = f.path AND l.line_number BETWEEN f.start_line AND f.end_line) AS hit FROM function_t f)
        SELECT path, avg(hit::INT) >= 0.5 AS passed FROM h GROUP BY 1""",
    ),
    "v10_two_strikes": (
        lambda r: graph.prior_incomplete(r["code_gen"], r["code_gen_regen"], r["harness_run"], r["reflection"]).where("prior >= 2").select("id"),
        """WITH RECURSIVE up AS (SELECT child_id AS id, parent_id AS a FROM code_gen_regen UNION SELECT u.id, e.parent_id FROM up u JOIN code_gen_regen e ON e.child_id = u.a)
        SELECT up.id FROM up JOIN harness_run h ON h.code_id = up.a JOIN reflection f ON f.run_id = h.id WHERE f.result = 'IncompleteStep' GROUP BY 1 HAVING count(*) >= 2""",
    ),
    "t02_next_work": (
        lambda r: state.judged(r["specification"].select("id", F.col("id").alias("ordinal")), r["reflection"].select("id", (F.col("result") == "WrongSpec").alias("duplicate"))).orderBy("lane", "ordinal").limit(25).select("id", "lane"),
        "SELECT id, CASE WHEN result = 'WrongSpec' THEN 1 ELSE 0 END AS lane FROM specification LEFT JOIN reflection USING (id) ORDER BY 2, 1 LIMIT 25",
    ),
    "t03_judged_queue": (
        lambda r: state.judged(r["specification"].select("id", F.col("id").alias("ordinal")), r["reflection"].select("id", (F.col("result") == "WrongSpec").alias("duplicate"))),
        "SELECT id, id AS ordinal, CASE WHEN result = 'WrongSpec' THEN 1 ELSE 0 END AS lane FROM specification LEFT JOIN reflection USING (id)",
    ),
    "t07_retro_pairs": (
        lambda r: r["pending_semantic"].join(r["sfl"], "semantic_node_id").join(r["finding_link_status"], "audit_finding_id", "left_semi").groupBy("semantic_node_id").agg(F.count(F.lit(1)).alias("linked"), F.max(rank("strength", STRENGTHS)).alias("best")),
        "SELECT semantic_node_id, count(*) AS linked, max(CASE strength WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) AS best FROM pending_semantic JOIN sfl USING (semantic_node_id) WHERE audit_finding_id IN (SELECT audit_finding_id FROM finding_link_status) GROUP BY 1",
    ),
    "t10_review_order": (
        lambda r: r["finding_review"].select("reflection_id", rank("severity", REVIEW_SEVERITIES).alias("rank")).orderBy(F.desc("rank"), "reflection_id").limit(50),
        f"SELECT reflection_id, {_SEV} AS rank FROM finding_review ORDER BY rank DESC, reflection_id LIMIT 50",
    ),
}
