"""Queries over the knowledge graph: name -> (plan, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.enums import STRENGTHS, at_least, rank
from ..operators import graph, integrity, keep, knowledge, rules, stats
from ..storage import cut, dealt

_RANK = "CASE strength WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END"
#: Edges followed to their end; a cycle ends at the first repeated node.
_WALK = """one AS (SELECT from_id, max(to_id) AS to_id FROM {edges} GROUP BY from_id {known}),
walk AS (SELECT id AS node, id AS cur, [id] AS path, false AS closed FROM {nodes}
  UNION ALL SELECT w.node, o.to_id, list_append(w.path, o.to_id), list_contains(w.path, o.to_id) FROM walk w JOIN one o ON w.cur = o.from_id WHERE NOT w.closed),
{name} AS (SELECT node, arg_max(cur, len(path)) AS canonical FROM walk GROUP BY node)"""


def _walk(nodes: str, edges: str, name: str = "res", known: bool = False) -> str:
    n = name
    text = _WALK.format(nodes=nodes, edges=edges, name=n, known="")
    if known:
        text = text.replace(f"FROM {edges} GROUP BY from_id )", f"FROM {edges} GROUP BY from_id HAVING max(to_id) IN (SELECT id FROM {nodes}))")
    return text.replace("one AS", f"one_{n} AS").replace("JOIN one o", f"JOIN one_{n} o").replace("walk", f"walk_{n}")


def _lists(df, *columns):
    """Arrays as text, for comparing."""
    return df.select(*[F.array_join(c, "|").alias(c) if c in columns else F.col(c) for c in df.columns])


_CANON = "SELECT n.* FROM semantic_node n WHERE n.id NOT IN (SELECT from_id FROM semantic_merge)"

def _every_category(r):
    """The taxonomy, with an entry of its own for findings that have none: the work list refuses those."""
    none = r["audit_finding"].select(F.col("id").alias("audit_finding_id")).join(r["finding_taxonomy"].select("audit_finding_id"), "audit_finding_id", "left_anti")
    return r["finding_taxonomy"].unionByName(none.select("audit_finding_id", F.lit(-1).alias("category_id"), F.lit("unsorted").alias("category")))


QUERIES = {
    "s02_seed_dimensions": (
        lambda r: r["semantic_node"].select("category").distinct().withColumn("known", F.lit(True)),
        "SELECT DISTINCT category, true AS known FROM semantic_node",
    ),
    "f01_completed_projects": (
        lambda r: r["project"].where("status = 'completed'").join(r["project_platform"], F.col("id") == F.col("project_id"), "left").select("id", "name", "platform_id"),
        "SELECT id, name, platform_id FROM project LEFT JOIN project_platform ON id = project_id WHERE status = 'completed'",
    ),
    "f02_is_completed": (
        lambda r: r["project_platform"].join(r["project"].where("status = 'completed'").select(F.col("id").alias("project_id"), F.lit(True).alias("done")), "project_id", "left").select("project_id", "platform_id", F.coalesce("done", F.lit(False)).alias("completed")),
        "SELECT project_id, platform_id, project_id IN (SELECT id FROM project WHERE status = 'completed') AS completed FROM project_platform",
    ),
    "f03_search_semantics": (
        lambda r: knowledge.search(r["semantic_node"], "BRAND#1").select("id", "name"),
        "SELECT id, name FROM semantic_node WHERE name ILIKE '%brand#1%' OR definition ILIKE '%brand#1%' OR description ILIKE '%brand#1%'",
    ),
    "f04_category_filter": (
        lambda r: r["semantic_node"].where(F.col("category").isin("PROMO", "ECONOMY")).select("id", "category"),
        "SELECT id, category FROM semantic_node WHERE category IN ('PROMO', 'ECONOMY')",
    ),
    "f05_not_merged_away": (
        lambda r: knowledge.canonical_only(r["semantic_node"], r["semantic_merge"]).select("id", "name"),
        f"SELECT id, name FROM ({_CANON}) c",
    ),
    "f06_strength_threshold": (
        lambda r: r["sfl"].where(at_least("strength", "Medium")).select("semantic_node_id", "audit_finding_id", "strength"),
        "SELECT semantic_node_id, audit_finding_id, strength FROM sfl WHERE strength IN ('High', 'Medium')",
    ),
    "f07_evidence_prefix": (
        lambda r: knowledge.split_links(r["sfl"]).groupBy("kind", "strength").agg(F.count(F.lit(1)).alias("n")),
        "SELECT CASE WHEN evidence LIKE 'in-project link:%' THEN 'in_project' ELSE 'cross' END AS kind, strength, count(*) AS n FROM sfl GROUP BY ALL",
    ),
    "f14_project_semantics": (
        lambda r: r["project_semantic"].where("project_id = 3").join(r["semantic_node"], F.col("semantic_node_id") == F.col("id")).select("project_id", "id", "name"),
        "SELECT project_id, id, name FROM project_semantic JOIN semantic_node ON semantic_node_id = id WHERE project_id = 3",
    ),
    "f16_native_ceiling": (
        lambda r: r["semantic_node"].crossJoin(r["pending_semantic"].agg(F.max("semantic_node_id").alias("ceiling"))).where("id <= ceiling").select("id"),
        "SELECT id FROM semantic_node WHERE id <= (SELECT max(semantic_node_id) FROM pending_semantic)",
    ),
    "j01_findings_for_semantics": (
        lambda r: knowledge.findings_for_semantics(r["semantic_node"].select("id"), r["sfl"], r["audit_finding"], r["semantic_merge"]),
        f"""WITH want AS (SELECT id FROM semantic_node),
        kid AS (SELECT from_id, max(to_id) AS to_id FROM semantic_merge WHERE to_id IN (SELECT id FROM want) GROUP BY from_id),
        expand AS (SELECT id AS canonical_id, id AS raw FROM want UNION ALL SELECT to_id, from_id FROM kid WHERE from_id NOT IN (SELECT id FROM want)),
        ranked AS (SELECT canonical_id, audit_finding_id, strength, evidence, row_number() OVER (PARTITION BY canonical_id, audit_finding_id ORDER BY {_RANK} DESC, semantic_node_id, ord) AS rn
          FROM expand JOIN sfl ON raw = semantic_node_id)
        SELECT canonical_id, audit_finding_id, strength, evidence, title, severity FROM ranked JOIN audit_finding f ON f.id = audit_finding_id WHERE rn = 1""",
    ),
    "j02_semantics_with_children": (
        lambda r: _lists(knowledge.with_children(r["semantic_node"], r["semantic_merge"]).select("id", "children"), "children"),
        f"""SELECT c.id, coalesce(string_agg(k.name, '|' ORDER BY k.name), '') AS children FROM ({_CANON}) c
        LEFT JOIN semantic_merge m ON m.to_id = c.id LEFT JOIN semantic_node k ON k.id = m.from_id GROUP BY c.id""",
    ),
    "j03_findings_with_taxonomy": (
        lambda r: knowledge.canonical_only(r["audit_finding"], r["finding_merge"]).join(rules.first_category(r["finding_taxonomy"]), "id").join(
            r["finding_merge"].groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("children")), "id", "left"
        ).select("id", "title", "category", F.coalesce("children", F.lit(0)).alias("children")),
        """SELECT f.id, title, t.category, (SELECT count(*) FROM finding_merge m WHERE m.to_id = f.id) AS children
        FROM audit_finding f JOIN finding_taxonomy t ON t.audit_finding_id = f.id WHERE f.id NOT IN (SELECT from_id FROM finding_merge)""",
    ),
    "j04_semantic_children": (
        lambda r: r["semantic_merge"].join(r["semantic_node"], F.col("from_id") == F.col("id")).select("to_id", "from_id", "name"),
        "SELECT to_id, from_id, name FROM semantic_merge JOIN semantic_node ON from_id = id",
    ),
    "j05_finding_children": (
        lambda r: r["finding_merge"].join(r["audit_finding"], F.col("from_id") == F.col("id")).select("to_id", "from_id", "title", "root_cause"),
        "SELECT to_id, from_id, title, root_cause FROM finding_merge JOIN audit_finding ON from_id = id",
    ),
    "j06_pending_findings": (
        lambda r: _lists(knowledge.pending_findings(r["audit_finding"], r["finding_link_status"], _every_category(r), r["project_finding"], r["project_category"], r["finding_merge"]), "categories"),
        f"""WITH RECURSIVE {_walk("audit_finding", "finding_merge")},
        cats AS (SELECT audit_finding_id, string_agg(DISTINCT category, '|' ORDER BY category) AS categories FROM project_finding JOIN project_category USING (project_id) GROUP BY 1)
        SELECT f.id, title, coalesce(t.category, 'unsorted') AS taxonomy, coalesce(categories, '') AS categories, canonical FROM audit_finding f LEFT JOIN finding_taxonomy t ON t.audit_finding_id = f.id
        JOIN res ON res.node = f.id LEFT JOIN cats ON cats.audit_finding_id = f.id WHERE f.id NOT IN (SELECT audit_finding_id FROM finding_link_status)""",
    ),
    "j07_linked_findings": (
        lambda r: knowledge.linked_findings(r["audit_finding"], r["finding_link_status"], r["finding_taxonomy"], r["finding_merge"]).select("id", "taxonomy"),
        """SELECT f.id, t.category AS taxonomy FROM audit_finding f JOIN finding_taxonomy t ON t.audit_finding_id = f.id
        WHERE f.id IN (SELECT audit_finding_id FROM finding_link_status) AND f.id NOT IN (SELECT from_id FROM finding_merge)""",
    ),
    "j08_processed_without_links": (
        lambda r: knowledge.processed_without_links(r["finding_link_status"], r["sfl"].where("strength = 'High'"), r["finding_merge"], r.parts("lineitem")),
        f"""WITH RECURSIVE {_walk("audit_finding", "finding_merge")}
        SELECT node AS id FROM res WHERE node IN (SELECT audit_finding_id FROM finding_link_status) AND canonical NOT IN (SELECT audit_finding_id FROM sfl WHERE strength = 'High')""",
    ),
    "j09_pending_semantics": (
        lambda r: r["semantic_node"].join(r["pending_semantic"].withColumnRenamed("semantic_node_id", "id"), "id", "left_semi").select("id", "name", "category"),
        "SELECT id, name, category FROM semantic_node WHERE id IN (SELECT semantic_node_id FROM pending_semantic)",
    ),
    "j10_link_candidates": (
        lambda r: knowledge.link_candidates(r["semantic_node"], r["semantic_merge"], ["PROMO"]),
        f"""WITH RECURSIVE {_walk("semantic_node", "semantic_merge", known=True)}, own AS (SELECT node, canonical FROM res JOIN semantic_node ON node = id WHERE category = 'PROMO')
        SELECT node, canonical FROM own UNION SELECT canonical, canonical FROM own""",
    ),
    "j11_scope_seed": (
        lambda r: _lists(knowledge.scope_seed(r["semantic_node"], r["semantic_merge"], r["semantic_function"]).select("id", "functions"), "functions"),
        f"""SELECT c.id, coalesce(string_agg(contract_path || '::' || function_name, '|' ORDER BY contract_path || '::' || function_name), '') AS functions
        FROM ({_CANON}) c LEFT JOIN semantic_function f ON f.semantic_node_id = c.id GROUP BY c.id""",
    ),
    "j12_vulnerability_scope": (
        lambda r: _lists(knowledge.vulnerability_scope(r["sfl_raw"], r["audit_finding"], r["semantic_node"], r["finding_merge"], r["semantic_merge"], r["project_finding"], r["project_category"], r.parts("lineitem")), "names", "categories"),
        f"""WITH RECURSIVE {_walk("audit_finding", "finding_merge", "rf", True)}, {_walk("semantic_node", "semantic_merge", "rs", True)},
        own AS (SELECT rf.canonical AS id, string_agg(DISTINCT n.name, '|' ORDER BY n.name) AS names, string_agg(DISTINCT n.category, '|' ORDER BY n.category) AS categories
          FROM sfl JOIN rf ON rf.node = audit_finding_id JOIN rs ON rs.node = semantic_node_id JOIN semantic_node n ON n.id = rs.canonical GROUP BY 1),
        p AS (SELECT audit_finding_id AS id, min(project_id) AS project_id FROM project_finding GROUP BY 1),
        l AS (SELECT project_id, string_agg(DISTINCT category, '|' ORDER BY category) AS cats FROM project_category GROUP BY 1)
        SELECT f.id AS finding_id, coalesce(names, '') AS names, coalesce(categories, cats, 'Others') AS categories
        FROM audit_finding f LEFT JOIN own USING (id) LEFT JOIN p USING (id) LEFT JOIN l USING (project_id) WHERE f.id NOT IN (SELECT from_id FROM finding_merge)""",
    ),
    "j14_provenance": (
        lambda r: _lists(r["project_semantic"].groupBy("semantic_node_id").agg(F.array_sort(F.collect_list("project_id")).alias("projects")), "projects"),
        "SELECT semantic_node_id, string_agg(project_id::VARCHAR, '|' ORDER BY project_id) AS projects FROM project_semantic GROUP BY 1",
    ),
    "j15_link_fan_out": (
        lambda r: knowledge.link_fan_out(r["semantic_matched"], r["project_extract"], r["semantic_node"], r["sfl"], r["audit_finding"]),
        """SELECT extract_id, historical_id, m.strength AS "match", e.name AS extract_name, n.name AS historical_name, l.audit_finding_id AS finding_id, l.strength AS link, title
        FROM semantic_matched m JOIN project_extract e ON e.id = extract_id JOIN semantic_node n ON n.id = historical_id JOIN sfl l ON l.semantic_node_id = historical_id
        JOIN audit_finding f ON f.id = l.audit_finding_id""",
    ),
    "w02_keep_strongest": (
        lambda r: keep.strongest(r["match_raw"], ["extract_id", "historical_id"]),
        f"""SELECT extract_id, historical_id, strength, ord FROM (SELECT *, row_number() OVER (PARTITION BY extract_id, historical_id ORDER BY {_RANK} DESC, ord) AS rn FROM match_raw) x WHERE rn = 1""",
    ),
    "w03_resolved_links": (
        lambda r: knowledge.resolve_links(r["sfl"], r["semantic_node"], r["semantic_merge"]),
        f"""WITH RECURSIVE {_walk("semantic_node", "semantic_merge", known=True)}
        SELECT semantic_node_id, audit_finding_id, strength FROM (SELECT canonical AS semantic_node_id, audit_finding_id, strength,
          row_number() OVER (PARTITION BY canonical, audit_finding_id ORDER BY {_RANK} DESC, node, ord) AS rn FROM sfl JOIN res ON node = semantic_node_id) x WHERE rn = 1""",
    ),
    "w05_planned_links": (
        lambda r: keep.plan_links(
            dealt(r["semantic_matched"].select("extract_id", "historical_id", F.col("strength").alias("match"), "ord").where("match <> 'Low'"), r.parts("lineitem"), "historical_id").join(
                dealt(keep.first_links(r["sfl"].select(F.col("semantic_node_id").alias("historical_id"), F.col("audit_finding_id").alias("finding_id"), F.col("strength").alias("link")), "Medium", 2), r.parts("lineitem"), "historical_id"), "historical_id"
            ).withColumn("ord", F.struct("ord", "finding_id", "historical_id")),
            r["specification"], "Medium", "Medium", 2, 20, 400,
        ).select("extract_id", "historical_id", "finding_id", "match", "link", "turn"),
        """WITH l AS (SELECT extract_id, historical_id, audit_finding_id AS finding_id, m.strength AS ms, f.strength AS link, m.ord AS o, CASE m.strength WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END AS mr,
          CASE f.strength WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END AS lr FROM semantic_matched m JOIN sfl f ON f.semantic_node_id = historical_id WHERE m.strength <> 'Low' AND f.strength <> 'Low'),
        a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY extract_id, historical_id ORDER BY mr DESC, lr DESC, o, finding_id, historical_id) AS rn FROM l) x WHERE rn <= 2),
        b AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY extract_id ORDER BY mr DESC, lr DESC, o, finding_id, historical_id) AS rn FROM a) x WHERE rn <= 20),
        c AS (SELECT * FROM b ORDER BY mr DESC, lr DESC, o, finding_id, historical_id LIMIT 400),
        d AS (SELECT *, row_number() OVER (PARTITION BY extract_id ORDER BY mr DESC, lr DESC, o, finding_id, historical_id)::INT AS turn FROM c)
        SELECT extract_id, historical_id, finding_id, ms AS "match", link, turn FROM d WHERE NOT EXISTS (SELECT 1 FROM specification s
          WHERE s.extract_id = d.extract_id AND s.historical_id = d.historical_id AND s.finding_id = d.finding_id)""",
    ),
    "g01_resolve_merge_target": (
        lambda r: graph.resolve(r["semantic_node"], r["semantic_merge"]),
        f"WITH RECURSIVE {_walk('semantic_node', 'semantic_merge')} SELECT node, canonical FROM res",
    ),
    "g02_resolve_known": (
        lambda r: graph.resolve(r["semantic_node"], r["semantic_merge"], r["semantic_node"]),
        f"WITH RECURSIVE {_walk('semantic_node', 'semantic_merge', known=True)} SELECT node, canonical FROM res",
    ),
    "g05_inheritance_closure": (
        lambda r: graph.closure(r["contract_inherit"], "contract_id", "inherited_id"),
        "WITH RECURSIVE up AS (SELECT contract_id AS node, inherited_id AS ancestor FROM contract_inherit UNION SELECT u.node, c.inherited_id FROM up u JOIN contract_inherit c ON c.contract_id = u.ancestor) SELECT node, ancestor FROM up",
    ),
    "g06_code_gen_depth": (
        lambda r: graph.chain_depth(r["code_gen"], r["code_gen_regen"]),
        "WITH RECURSIVE w AS (SELECT id, id AS at_id, 0 AS depth FROM code_gen UNION ALL SELECT w.id, e.parent_id, depth + 1 FROM w JOIN code_gen_regen e ON e.child_id = w.at_id) SELECT id, max(depth) AS depth FROM w GROUP BY id",
    ),
    "g07_spec_depth": (
        lambda r: graph.chain_depth(r["specification"], r["specification_regen"]),
        "WITH RECURSIVE w AS (SELECT id, id AS at_id, 0 AS depth FROM specification UNION ALL SELECT w.id, e.parent_id, depth + 1 FROM w JOIN specification_regen e ON e.child_id = w.at_id) SELECT id, max(depth) AS depth FROM w GROUP BY id",
    ),
    "g08_prior_incomplete": (
        lambda r: graph.prior_incomplete(r["code_gen"], r["code_gen_regen"], r["harness_run"], r["reflection"]),
        """WITH RECURSIVE up AS (SELECT child_id AS id, parent_id AS a FROM code_gen_regen UNION SELECT u.id, e.parent_id FROM up u JOIN code_gen_regen e ON e.child_id = u.a)
        SELECT c.id, (SELECT count(*) FROM up JOIN harness_run h ON h.code_id = up.a JOIN reflection f ON f.run_id = h.id WHERE up.id = c.id AND f.result = 'IncompleteStep') AS prior FROM code_gen c""",
    ),
    "o16_leaves": (
        lambda r: graph.leaves(r["function_t"], r["function_call"], r["function_t"].where("owner_id = 5")),
        """WITH c AS (SELECT * FROM function_call), e AS (SELECT id FROM function_t UNION SELECT caller_id FROM c UNION SELECT callee_id FROM c)
        SELECT id FROM e WHERE id NOT IN (SELECT caller_id FROM c) AND id NOT IN (SELECT id FROM function_t WHERE owner_id = 5)""",
    ),
    "o08_category_union": (
        lambda r: r["semantic_node"].select("category").unionByName(r["project_extract"].select("category")).unionByName(r["semantic_node"].select(F.lit("Others").alias("category"))).distinct(),
        "SELECT category FROM semantic_node UNION SELECT category FROM project_extract UNION SELECT 'Others'",
    ),
    "o09_second_pass": (
        lambda r: r["project_extract"].join(r["semantic_matched"].where("strength = 'High'").select(F.col("extract_id").alias("id")), "id", "left_anti").select("id", F.col("category").alias("own")).crossJoin(
            F.broadcast(r["semantic_node"].select("category").distinct())
        ).where("category <> own").select("id", "category"),
        """SELECT e.id, c.category FROM project_extract e, (SELECT DISTINCT category FROM semantic_node) c
        WHERE c.category <> e.category AND e.id NOT IN (SELECT extract_id FROM semantic_matched WHERE strength = 'High')""",
    ),
    "a02_strength_counts": (
        lambda r: stats.strength_counts(r["sfl"]),
        """WITH k AS (SELECT 'all' AS kind, strength FROM sfl UNION ALL SELECT CASE WHEN evidence LIKE 'in-project link:%' THEN 'in_project' ELSE 'cross' END, strength FROM sfl)
        SELECT kind, count(*) AS total, count(*) FILTER (strength = 'High') AS high, count(*) FILTER (strength = 'Medium') AS medium, count(*) FILTER (strength = 'Low') AS low FROM k GROUP BY kind""",
    ),
    "a03_totals": (
        lambda r: stats.totals(r["semantic_node"], r["semantic_merge"], r["audit_finding"], r["finding_merge"], r["sfl"]),
        """WITH x AS (SELECT count(*) AS c, count(DISTINCT semantic_node_id) AS s, count(DISTINCT audit_finding_id) AS f FROM sfl WHERE evidence NOT LIKE 'in-project link:%'),
        b AS (SELECT (SELECT count(*) FROM semantic_node) AS st, (SELECT count(DISTINCT from_id) FROM semantic_merge) AS sf, (SELECT count(*) FROM audit_finding) AS ft, (SELECT count(DISTINCT from_id) FROM finding_merge) AS ff)
        SELECT st AS semantics_total, ft AS findings_total, sf AS semantics_folded, ff AS findings_folded, c AS cross_links, s AS linked_semantics, f AS linked_findings,
        (SELECT max(n) FROM (SELECT count(*) AS n FROM semantic_merge GROUP BY from_id) m) AS max_parents, st - sf AS semantics_canonical, ft - ff AS findings_canonical,
        round(c::DOUBLE / s, 6) AS links_per_semantic, round(c::DOUBLE / f, 6) AS links_per_finding FROM x, b""",
    ),
    "a07_project_reach": (
        lambda r: stats.project_reach(r["semantic_node"], r["semantic_merge"], r["project_semantic"], r.parts("lineitem")),
        f"""WITH c AS (SELECT id FROM ({_CANON}) q), p AS (SELECT semantic_node_id AS id, project_id FROM project_semantic UNION SELECT to_id, project_id FROM project_semantic JOIN semantic_merge ON from_id = semantic_node_id),
        k AS (SELECT c.id, count(DISTINCT project_id) AS n FROM c LEFT JOIN p ON p.id = c.id GROUP BY c.id)
        SELECT count(*) AS canonical, max(n) AS max_reach, round(sum(n)::DOUBLE / count(*), 6) AS avg_reach FROM k""",
    ),
    "a08_top_categories": (
        lambda r: stats.top_categories(knowledge.canonical_only(r["semantic_node"], r["semantic_merge"]), "category"),
        f"SELECT category, count(*) AS n FROM ({_CANON}) c GROUP BY category ORDER BY n DESC, category LIMIT 5",
    ),
    "a09_platform_counts": (
        lambda r: stats.platform_counts(r["project_platform"]),
        "SELECT split_part(platform_id, '-', 1) AS platform, count(*) AS n FROM project_platform GROUP BY 1",
    ),
    "a10_mean_lengths": (
        lambda r: stats.mean_lengths(r["semantic_node"], ["name", "description"]),
        "SELECT floor(sum(length(name)) / count(*))::BIGINT AS mean_name, floor(sum(length(description)) / count(*))::BIGINT AS mean_description FROM semantic_node",
    ),
    "a12_match_outcome": (
        lambda r: r["semantic_matched"].agg(*[F.count_if(F.col("strength") == s).alias(s.lower()) for s in STRENGTHS], F.countDistinct("extract_id").alias("matched")),
        "SELECT count(*) FILTER (strength = 'Low') AS low, count(*) FILTER (strength = 'Medium') AS medium, count(*) FILTER (strength = 'High') AS high, count(DISTINCT extract_id) AS matched FROM semantic_matched",
    ),
    "a22_category_counts": (
        lambda r: stats.category_counts(r["semantic_node"], r["semantic_merge"], r["project_category"]),
        f"""WITH s AS (SELECT category, count(*) AS n FROM ({_CANON}) c GROUP BY 1), p AS (SELECT category, count(DISTINCT project_id) AS n FROM project_category GROUP BY 1)
        SELECT coalesce(s.category, p.category) AS category, coalesce(s.n, 0) AS semantics, coalesce(p.n, 0) AS projects FROM s FULL JOIN p ON s.category = p.category""",
    ),
    "u01_upsert_links": (
        lambda r: knowledge.upsert_links(r["sfl"].where("semantic_node_id % 2 = 0").select("semantic_node_id", "audit_finding_id", "strength", "evidence"), r["sfl"].where("semantic_node_id % 3 = 0").select("semantic_node_id", "audit_finding_id", F.lit("Medium").alias("strength"), F.lit("new").alias("evidence"))),
        f"""WITH u AS (SELECT semantic_node_id, audit_finding_id, strength, evidence, 0 AS o FROM sfl WHERE semantic_node_id % 2 = 0 UNION ALL SELECT semantic_node_id, audit_finding_id, 'Medium', 'new', 1 FROM sfl WHERE semantic_node_id % 3 = 0)
        SELECT semantic_node_id, audit_finding_id, strength, evidence FROM (SELECT *, row_number() OVER (PARTITION BY semantic_node_id, audit_finding_id ORDER BY {_RANK} DESC, o) AS rn FROM u) x WHERE rn = 1""",
    ),
    "u03_append_links": (
        lambda r: knowledge.append_links(r["sfl"].where("semantic_node_id % 2 = 0").select("semantic_node_id", "audit_finding_id", "strength"), r["sfl"].where("semantic_node_id % 3 = 0").select("semantic_node_id", "audit_finding_id", F.lit("High").alias("strength"))),
        """SELECT semantic_node_id, audit_finding_id, strength FROM sfl WHERE semantic_node_id % 2 = 0
        UNION ALL SELECT semantic_node_id, audit_finding_id, 'High' FROM sfl WHERE semantic_node_id % 3 = 0 AND semantic_node_id % 2 <> 0""",
    ),
    "u05_clear_progress": (
        lambda r: knowledge.split_links(r["sfl"]).where("kind = 'in_project'").select("semantic_node_id", "audit_finding_id"),
        "SELECT semantic_node_id, audit_finding_id FROM sfl WHERE evidence LIKE 'in-project link:%'",
    ),
    "u13_incomplete_merges": (
        lambda r: integrity.incomplete_merges(r["merge_status"]),
        "SELECT source_key, arg_max(phase, id) AS phase, max(id) AS id FROM merge_status GROUP BY 1 HAVING arg_max(phase, id) <> 'link'",
    ),
    "u14_record_operation": (
        lambda r: r["operation_history"].groupBy("type", "args").agg(F.min("id").alias("id")),
        "SELECT type, args, min(id) AS id FROM operation_history GROUP BY 1, 2",
    ),
    "v01_validation_issues": (
        lambda r: cut(integrity.issues(r, r.parts("lineitem"))).orderBy("table_name", "row_key", "problem"),  # a sort reads its rows twice
        """WITH n AS (SELECT id FROM semantic_node), f AS (SELECT id FROM audit_finding), i AS (
        SELECT 'semantic_merge' AS table_name, from_id || ',' || to_id AS row_key, concat_ws('; ', CASE WHEN from_id NOT IN (FROM n) THEN 'missing from' END, CASE WHEN to_id NOT IN (FROM n) THEN 'missing to' END) AS problem FROM semantic_merge
        UNION ALL SELECT 'finding_merge', from_id || ',' || to_id, concat_ws('; ', CASE WHEN from_id NOT IN (FROM f) THEN 'missing from' END, CASE WHEN to_id NOT IN (FROM f) THEN 'missing to' END) FROM finding_merge
        UNION ALL SELECT 'semantic_finding_link', semantic_node_id || ',' || audit_finding_id, concat_ws('; ', CASE WHEN semantic_node_id NOT IN (FROM n) THEN 'missing semantic' END, CASE WHEN audit_finding_id NOT IN (FROM f) THEN 'missing finding' END) FROM sfl
        UNION ALL SELECT 'project_platform', project_id::VARCHAR, CASE WHEN project_id NOT IN (SELECT id FROM project) THEN 'missing project' ELSE '' END FROM project_platform
        UNION ALL SELECT 'project_category', project_id || ',' || category, CASE WHEN project_id NOT IN (SELECT id FROM project) THEN 'missing project' ELSE '' END FROM project_category
        UNION ALL SELECT 'semantic_function', semantic_node_id || ',' || function_name, CASE WHEN semantic_node_id NOT IN (FROM n) THEN 'missing semantic' ELSE '' END FROM semantic_function
        UNION ALL SELECT 'finding_taxonomy', audit_finding_id::VARCHAR, CASE WHEN audit_finding_id NOT IN (FROM f) THEN 'missing finding' ELSE '' END FROM finding_taxonomy
        UNION ALL SELECT 'finding_link_status', audit_finding_id::VARCHAR, CASE WHEN audit_finding_id NOT IN (FROM f) THEN 'missing finding' ELSE '' END FROM finding_link_status
        UNION ALL SELECT DISTINCT 'semantic_finding_link', audit_finding_id::VARCHAR, 'linked without status' FROM sfl WHERE audit_finding_id NOT IN (SELECT audit_finding_id FROM finding_link_status)
        UNION ALL SELECT 'pending_semantic', semantic_node_id::VARCHAR, 'queue not drained' FROM pending_semantic
        UNION ALL SELECT 'merge_status', source_key, 'merge incomplete' FROM (SELECT source_key FROM merge_status GROUP BY 1 HAVING arg_max(phase, id) <> 'link') m)
        SELECT table_name, row_key, problem FROM i WHERE problem <> ''""",
    ),
    "v02_repaired_edges": (
        lambda r: integrity.repair_edges(r["semantic_merge"], r["semantic_node"]).select("from_id", "to_id"),
        "SELECT from_id, to_id FROM semantic_merge WHERE from_id IN (SELECT id FROM semantic_node) AND to_id IN (SELECT id FROM semantic_node)",
    ),
    "x13_severity_max": (
        lambda r: r["audit_finding"].groupBy("title").agg(F.max_by("severity", rank("severity", STRENGTHS)).alias("severity")),
        "SELECT title, arg_max(severity, CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END) AS severity FROM audit_finding GROUP BY title",
    ),
}
