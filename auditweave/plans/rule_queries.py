"""Queries of the rules: checks that raise, call-graph problems, budgets, packing; with fixture tables
for cases that the driver's tables don't hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code, link_plan, rules
from ..functions import text as t

def _runs(r):
    """Runs with every stage of the gate: by id failed set-ups, reverts, counterexamples near and far."""
    def steps(cond, name: str):
        full = F.array(F.struct(F.lit("Vault").alias("contract"), F.lit(name).alias("function")))
        return F.when(cond, full).otherwise(F.filter(full, lambda _: F.lit(False)))

    i = F.col("id")
    return r["harness_run"].select(
        "id", (i % 11 == 0).alias("setup_failed"), F.lit(100).cast("long").alias("calls"), F.when(i % 7 == 0, 95).otherwise(94).cast("long").alias("reverts"), "violated",
        (i % 5 == 0).alias("deterministic"), F.when(i % 3 == 0, steps(F.lit(True), "deposit")).otherwise(steps(i % 2 == 0, "withdraw")).alias("counterexample"), steps(i % 13 != 0, "deposit").alias("sequence"),
    )


def _resident(r):
    c = r["function_t"].select(
        (F.col("id") % 10).alias("project"), F.when(F.col("id") % 17 == 0, F.col("id") % 3).otherwise(2**31 - 1).cast("int").alias("core_rank"), (F.col("id") * 7 % 23).alias("degree"),
        F.octet_length("name").alias("bytes"), F.concat("name", F.lit(" "), "id").alias("name"), "id", (F.octet_length("name") * 3 + F.col("id") % 40).cast("long").alias("tokens"),
    )
    return rules.resident(c, "project", F.lit(900)).select("project", "tokens", F.concat_ws(",", F.transform("kept", lambda x: x.cast("string"))).alias("kept"), F.concat_ws("|", "omitted").alias("omitted"))


def _degrees(r):
    c = r["contract"].select("id", (F.col("id") % 3 == 1).alias("is_interface"), (F.col("id") % 9 == 0).alias("vendored"))
    return rules.degrees(c, r["function_t"], r["function_call"]).select("id", "degree")


def _scope(r):
    own = r["audit_finding"].select("id", F.when(F.col("id") % 2 == 0, F.array("severity")).otherwise(F.array().cast("array<string>")).alias("categories"))
    return rules.scope_categories(own, r["project_finding"], r["project_category"]).select("id", F.concat_ws("|", "categories").alias("categories"))


def _chunk(r):
    d = r["documents"].select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.size(F.split("text", "\n", -1)))
    cut = rules.source_chunk(F.col("text"), F.when(F.col("n") > 1, 2).otherwise(1), F.lit(0), F.col("n"), F.lit(0))
    return d.select("doc_id", F.md5(cut).alias("chunk"))


def _progress(r):
    """Lines as results of contexts: a context more is expected of some orders, and lines of large quantity failed."""
    lines = r["lineitem"].select(
        F.col("l_orderkey").cast("int").alias("finding_id"), F.floor(F.col("l_orderkey") / 4).cast("int").alias("target_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("context"), (F.col("l_quantity") > 49).alias("failed"),
        F.col("l_partkey").cast("int").alias("semantic_id"), F.when(F.col("l_returnflag") == "R", "High").when(F.col("l_returnflag") == "A", "Medium").otherwise("Low").alias("strength"), F.col("l_suppkey").cast("string").alias("evidence"),
    )
    expected = lines.groupBy("finding_id").agg((F.countDistinct("context") + F.when(F.col("finding_id") % 9 == 0, 1).otherwise(0)).alias("expected"))
    return lines.join(expected, "finding_id")


def _core(r):
    n = F.col("n_nationkey")
    path = F.when(n % 3 == 0, F.concat(F.lit("./src/BUILDING/C"), n * 5, F.lit(".sol"))).when(n % 3 == 1, "").otherwise("src/nowhere.sol")
    return r["nation"].select(n.alias("pos"), F.concat(F.lit("C"), n * 5).alias("name"), path.alias("path"))


def _tests(r):
    reason = F.when(F.col("id") % 17 == 0, F.concat(F.lit("Failed to SET up "), "id")).otherwise(F.col("reason"))
    return r["harness_run"].select("id", "code_id", F.when(F.col("violated"), "Failure").otherwise("Success").alias("status"), F.when(F.col("id") % 3 == 0, "setUp()").otherwise("testRun").alias("test"), reason.alias("reason"))


def _reflections(r):
    there = r["reflection"].select("id", "run_id", "result", "claim")
    new = r["harness_run"].where("id % 2 = 1").select(
        F.col("id").alias("ord"), F.col("id").alias("run_id"), F.element_at(F.array(*map(F.lit, ("ValidFinding", "IntendedBehavior", "WrongHarness"))), (F.col("id") % 3 + 1).cast("int")).alias("result"),
        F.concat(F.lit("claim "), "id").alias("claim"), (F.col("id") % 3 == 0).alias("has_finding"),
    )
    return rules.insert_reflections(there, new).select("id", "run_id", "result", F.coalesce("claim", F.lit("")).alias("claim"))


def _regeneration(r):
    specs = r["specification"].select("id", F.lit("spec").alias("title"))
    codes = r["code_gen"].select("id", F.lit("spec").alias("title"))
    runs = r["harness_run"].select("id", "code_id", "violated")
    new = r["project"].select(F.col("id").alias("ord"), F.concat(F.lit("again "), "id").alias("title"), F.col("id").alias("parent_spec"), F.col("id").alias("parent_code"))
    new_runs = r["project"].select((F.col("id") * 2).alias("run_ord"), F.col("id").alias("ord"), (F.col("id") % 2 == 0).alias("violated"))
    empty = r["code_gen_regen"].select("child_id", "parent_id").limit(0)
    after = rules.write_regeneration(specs, codes, runs, empty, empty, new, new_runs)[2]
    return after.join(runs.select("id"), "id", "left_anti")


#: Budgets of the link plan's queries.
LINK = link_plan.Budgets(input_tokens=4000, fixed_tokens=200, finding_target=900, most_findings=40, most_concepts=60)


def _candidates(r):
    """Canonical nodes and, one level down, what was folded into them."""
    n = r["semantic_node"].select(F.col("id").alias("node"), "category", "name", F.char_length("description").alias("tokens"))
    folded = r["semantic_merge"].join(r["semantic_node"].select(F.col("id").alias("to_id")), "to_id", "left_semi").groupBy(F.col("from_id").alias("node")).agg(F.max("to_id").alias("to_id"))
    roots = n.select("node").join(folded.select("node"), "node", "left_anti")
    one = folded.join(roots.select(F.col("node").alias("to_id")), "to_id", "left_semi")
    return n.join(roots.select("node", F.col("node").alias("canonical")).unionByName(one.select("node", F.col("to_id").alias("canonical"))), "node")


def _asked(r):
    pending = r["audit_finding"].join(r["finding_link_status"].withColumnRenamed("audit_finding_id", "id"), "id", "left_anti")
    return pending.select(F.col("id").alias("finding_id"), F.col("id").alias("ord"), (F.char_length("title") + F.char_length("description")).alias("tokens"))


def _batched(r):
    return link_plan.batches(_asked(r), link_plan.contexts(link_plan.chunks(_candidates(r), LINK), LINK), LINK)


#: Greedy packing in SQL: jump(grp, i) is the next batch's first row; what is reached from row 1 starts a batch.
def _packed(rows: str, budget: str, most: int, as_: str) -> str:
    return f"""{as_}_s AS (SELECT *, sum(tokens) OVER (PARTITION BY grp ORDER BY i) AS upto FROM {rows}),
    {as_}_j AS (SELECT grp, i, least(i + {most}, 1 + count(*) OVER (PARTITION BY grp ORDER BY upto RANGE BETWEEN UNBOUNDED PRECEDING AND greatest({budget} - tokens, 0) FOLLOWING)) AS j FROM {as_}_s),
    {as_}_b AS (SELECT DISTINCT grp, CAST(1 AS BIGINT) AS i FROM {as_}_s UNION ALL SELECT w.grp, j FROM {as_}_b w JOIN {as_}_j USING (grp, i)),
    {as_} AS (SELECT s.*, CAST(count(b.i) OVER (PARTITION BY s.grp ORDER BY s.i) - 1 AS INT) AS batch FROM {as_}_s s LEFT JOIN {as_}_b b USING (grp, i))"""


_CHUNKS = f"""n AS (SELECT id AS node, category, name, length(description) AS tokens FROM semantic_node),
folded AS (SELECT from_id AS node, max(to_id) AS to_id FROM semantic_merge WHERE to_id IN (SELECT id FROM semantic_node) GROUP BY 1),
roots AS (SELECT node FROM n WHERE node NOT IN (SELECT node FROM folded)),
c AS (SELECT n.*, m.canonical FROM n JOIN (SELECT node, node AS canonical FROM roots UNION ALL SELECT node, to_id FROM folded WHERE to_id IN (SELECT node FROM roots)) m USING (node)),
g AS (SELECT 1 AS grp, canonical, any_value(category) FILTER (node = canonical) AS category, any_value(name) FILTER (node = canonical) AS name, sum(tokens) AS tokens, count(*) AS members,
  string_agg(CAST(node AS VARCHAR), ',' ORDER BY node <> canonical, name, node) AS nodes FROM c GROUP BY canonical),
gi AS (SELECT *, row_number() OVER (ORDER BY category, name, canonical) AS i FROM g),
{_packed("gi", "2900", 60, "chunked")},
ctx AS (SELECT batch AS chunk, sum(members) AS concepts, sum(tokens) + 200 AS prefix_tokens, least(900, 4000 - sum(tokens) - 200) AS finding_tokens FROM chunked GROUP BY batch)"""
_BATCHES = f"""{_CHUNKS},
fi AS (SELECT id AS finding_id, length(title) + length(description) AS tokens, row_number() OVER (ORDER BY id) AS i FROM audit_finding WHERE id NOT IN (SELECT audit_finding_id FROM finding_link_status)),
cf AS (SELECT chunk AS grp, finding_id, tokens, i, finding_tokens AS room FROM fi, ctx),
{_packed("cf", "room", 40, "packed")}"""

QUERIES = {
    "y06_link_contexts": (
        lambda r: link_plan.contexts(link_plan.chunks(_candidates(r), LINK), LINK),
        f"WITH RECURSIVE {_CHUNKS} SELECT chunk, concepts::BIGINT AS concepts, prefix_tokens::BIGINT AS prefix_tokens, finding_tokens::BIGINT AS finding_tokens FROM ctx",
    ),
    "y07_context_members": (
        lambda r: link_plan.chunks(_candidates(r), LINK).select("chunk", "canonical", "tokens", F.concat_ws(",", F.transform("members", lambda x: x.cast("string"))).alias("members")),
        f"WITH RECURSIVE {_CHUNKS} SELECT batch AS chunk, canonical, tokens::BIGINT AS tokens, nodes AS members FROM chunked",
    ),
    "y08_link_batches": (
        _batched,
        f"WITH RECURSIVE {_BATCHES} SELECT grp AS chunk, batch, finding_id, tokens::INT AS tokens, (SELECT count(*) FROM ctx)::INT AS expected FROM packed",
    ),
    "j03_first_category": (
        lambda r: rules.first_category(r["finding_taxonomy"].unionByName(r["finding_taxonomy"].select("audit_finding_id", (F.col("category_id") + 1).alias("category_id"), F.lit("later").alias("category")))),
        "SELECT audit_finding_id AS id, category FROM finding_taxonomy",
    ),
    "j06_one_category": (
        lambda r: rules.one_category(r["audit_finding"].select("id").join(r["finding_taxonomy"].select(F.col("audit_finding_id").alias("id")), "id", "left_semi"), r["finding_taxonomy"]),
        "SELECT audit_finding_id AS id, category FROM finding_taxonomy",
    ),
    "j12_category_fallback": (
        _scope,
        """WITH p AS (SELECT audit_finding_id, min(project_id) AS project_id FROM project_finding GROUP BY 1),
        l AS (SELECT project_id, string_agg(DISTINCT category, '|' ORDER BY category) AS cats FROM project_category GROUP BY 1)
        SELECT id, CASE WHEN id % 2 = 0 THEN severity ELSE coalesce(cats, 'Others') END AS categories FROM audit_finding LEFT JOIN p ON p.audit_finding_id = id LEFT JOIN l USING (project_id)""",
    ),
    "j15_rendered_or_raw": (
        lambda r: r["reflection"].select("id", rules.rendered_or_raw(F.col("claim"), F.col("result")).alias("told")),
        "SELECT id, CASE WHEN trim(coalesce(claim, '')) <> '' THEN claim ELSE result END AS told FROM reflection",
    ),
    "j17_complete_runs": (
        lambda r: rules.complete_or_raise(r["reflection"].select("id", "run_id"), r["harness_run"], "run_id", "id"),
        "SELECT id, run_id FROM reflection WHERE run_id IN (SELECT id FROM harness_run)",
    ),
    "w04_batch_results": (
        lambda r: rules.batch_results(_progress(r)),
        f"""WITH p AS (SELECT l_orderkey AS finding_id, l_orderkey // 4 AS target_id, l_linenumber AS context, l_partkey AS semantic_id, l_shipdate AS d, CAST(l_suppkey AS VARCHAR) AS evidence, l_quantity > 49 AS failed,
          CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS k, count(DISTINCT l_linenumber) OVER (PARTITION BY l_orderkey) + CAST(l_orderkey % 9 = 0 AS INT) AS expected FROM lineitem),
        ok AS (SELECT finding_id FROM p GROUP BY 1 HAVING count(DISTINCT context) = max(expected) AND NOT bool_or(failed)),
        b AS (SELECT *, row_number() OVER (PARTITION BY semantic_id, finding_id // 4 ORDER BY k DESC, finding_id * 10 + context, evidence DESC) AS rn FROM p JOIN ok USING (finding_id))
        SELECT semantic_id::INT AS semantic_id, target_id::INT AS finding_id, CASE k WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS strength, evidence FROM b WHERE rn = 1""",
    ),
    "w13_grouped_candidates": (
        lambda r: rules.grouped_candidates(r["semantic_merge"].select(F.col("from_id").alias("node"), F.col("to_id").alias("canonical")).unionByName(r["semantic_merge"].select(F.col("to_id").alias("node"), F.col("to_id").alias("canonical")).distinct()).join(r["semantic_node"].select(F.col("id").alias("canonical")), "canonical", "left_semi"), r["semantic_node"]).select("canonical", F.concat_ws(",", F.transform("members", lambda x: x.cast("string"))).alias("members")),
        """WITH c AS (SELECT from_id AS node, to_id AS canonical FROM semantic_merge UNION ALL SELECT DISTINCT to_id, to_id FROM semantic_merge)
        SELECT canonical, string_agg(node::VARCHAR, ',' ORDER BY node <> canonical, name, node) AS members FROM c JOIN semantic_node n ON n.id = node WHERE canonical IN (SELECT id FROM semantic_node) GROUP BY 1""",
    ),
    "u14_json_operations": (
        lambda r: rules.record_operations(r["operation_history"].where("id % 2 = 0").select("id", "type", "args"), r["operation_history"].select((F.col("id") + 7).alias("ord"), "type", "args")),
        """WITH h AS (SELECT id, type, args FROM operation_history WHERE id % 2 = 0), n AS (SELECT type, args, min(id) AS o FROM operation_history WHERE (type, args) NOT IN (SELECT type, args FROM h) GROUP BY 1, 2)
        SELECT id, type, args FROM h UNION ALL SELECT (SELECT max(id) FROM h) + row_number() OVER (ORDER BY o), type, args FROM n""",
    ),
    "u17_regenerated_runs": (
        _regeneration,
        """SELECT (SELECT max(id) FROM harness_run) + row_number() OVER (ORDER BY id) AS id, (SELECT max(id) FROM code_gen) + row_number() OVER (ORDER BY id) AS code_id, id % 2 = 0 AS violated FROM project""",
    ),
    "u18_inserted_reflections": (
        _reflections,
        """SELECT id, run_id, result, coalesce(claim, '') AS claim FROM reflection
        UNION ALL SELECT (SELECT max(id) FROM reflection) + row_number() OVER (ORDER BY id), id, CASE id % 3 WHEN 0 THEN 'ValidFinding' WHEN 1 THEN 'IntendedBehavior' ELSE 'WrongHarness' END,
          CASE WHEN id % 3 = 1 THEN concat('claim ', id) ELSE '' END FROM harness_run WHERE id % 2 = 1""",
    ),
    "u04_cleared_queue": (
        lambda r: rules.cleared(r["pending_semantic"])[1],
        "SELECT count(*) AS cleared FROM pending_semantic",
    ),
    "u05_cleared_links": (
        lambda r: rules.cleared(r["sfl"], F.col("evidence").startswith("in-project link:"))[0].select("semantic_node_id", "audit_finding_id"),
        "SELECT semantic_node_id, audit_finding_id FROM sfl WHERE evidence LIKE 'in-project link:%'",
    ),
    "a08_top_finding_categories": (
        lambda r: r["finding_taxonomy"].groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(5),
        "SELECT category, count(*) AS n FROM finding_taxonomy GROUP BY 1 ORDER BY n DESC, category LIMIT 5",
    ),
    "a15_regen_tallies": (
        lambda r: rules.added_tallies(r["harness_run"].select((F.col("code_id") % 20).alias("code"), F.col("violated").cast("long").alias("violations"), "calls"), ["code"]),
        "SELECT code_id % 20 AS code, sum(violated::BIGINT)::BIGINT AS violations, sum(calls)::BIGINT AS calls FROM harness_run GROUP BY 1",
    ),
    "v07_gate_stages": (
        lambda r: rules.runtime_gates(_runs(r), code.sequence_overlap),
        """SELECT id, CASE WHEN why = '' THEN 'Pass' ELSE 'Fail' END AS gate, why FROM (SELECT id, CASE WHEN id % 11 = 0 THEN 'setup failed' WHEN id % 7 = 0 THEN 'reverts'
          WHEN violated AND id % 5 <> 0 AND id % 13 <> 0 AND id % 3 <> 0 THEN 'disjoint' ELSE '' END AS why FROM harness_run) x""",
    ),
    "g12_call_graph_problems": (
        lambda r: rules.call_graph_problems(
            r["function_t"].select("id", (F.col("start_line") / 10 - 1).cast("int").alias("start_line"), F.lit(4).alias("start_column"), ((F.col("start_line") / 10 - 1) + F.col("id") % 3 - 1).cast("int").alias("end_line"), (F.col("id") % 7).cast("int").alias("end_column")),
            r["lineitem"].select((F.col("l_orderkey") * 10 + F.col("l_linenumber") % 5).alias("id"), (F.col("l_orderkey") % 2000).alias("holder_id"), F.when(F.col("l_linenumber") == 7, F.col("l_suppkey")).otherwise(F.col("l_orderkey") % 2000).alias("from_id"),
                                 F.when(F.col("l_quantity") > 49, -1).otherwise(F.col("l_partkey")).alias("to_id")),
        ),
        """WITH f AS (SELECT id, start_line // 10 - 1 AS a, 4 AS ac, start_line // 10 - 1 + id % 3 - 1 AS b, id % 7 AS bc FROM function_t),
        c AS (SELECT l_orderkey * 10 + l_linenumber % 5 AS id, l_orderkey % 2000 AS h, CASE WHEN l_linenumber = 7 THEN l_suppkey ELSE l_orderkey % 2000 END AS s, CASE WHEN l_quantity > 49 THEN -1 ELSE l_partkey END AS t FROM lineitem)
        SELECT 'repeated call' AS problem, id FROM c GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'held elsewhere', id FROM c WHERE h <> s
        UNION ALL SELECT DISTINCT 'missing target', id FROM c WHERE t NOT IN (SELECT id FROM f) UNION ALL SELECT 'bad place', id FROM f WHERE a < 1 OR b < a OR (b = a AND bc < ac)""",
    ),
    "y01_resident_sources": (
        _resident,
        """WITH RECURSIVE c AS (SELECT id % 10 AS project, CASE WHEN id % 17 = 0 THEN id % 3 ELSE 2147483647 END AS core, id * 7 % 23 AS degree, strlen(name) AS bytes, concat(name, ' ', id) AS name, id, strlen(name) * 3 + id % 40 AS tokens FROM function_t),
        o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY core, degree DESC, bytes DESC, name) AS rn FROM c),
        f AS (SELECT project, rn, id, name, tokens <= 900 AS kept, CASE WHEN tokens <= 900 THEN tokens ELSE 0 END AS used FROM o WHERE rn = 1
          UNION ALL SELECT o.project, o.rn, o.id, o.name, f.used + o.tokens <= 900, CASE WHEN f.used + o.tokens <= 900 THEN f.used + o.tokens ELSE f.used END FROM f JOIN o ON o.project = f.project AND o.rn = f.rn + 1)
        SELECT project, max(used) AS tokens, coalesce(string_agg(id::VARCHAR, ',' ORDER BY rn) FILTER (kept), '') AS kept, coalesce(string_agg(name, '|' ORDER BY name) FILTER (NOT kept), '') AS omitted FROM f GROUP BY 1""",
    ),
    "y02_container_degrees": (
        _degrees,
        """WITH k AS (SELECT * FROM function_call WHERE caller_id IN (SELECT f.id FROM function_t f JOIN contract c ON c.id = owner_id WHERE c.id % 3 <> 1)), e AS (SELECT caller_id AS f FROM k UNION ALL SELECT callee_id FROM k), d AS (SELECT owner_id, count(*) AS n FROM e JOIN function_t ON id = f GROUP BY 1)
        SELECT id, CASE WHEN id % 3 = 1 THEN 0 ELSE coalesce(n, 0) END AS degree FROM contract LEFT JOIN d ON owner_id = id WHERE id % 9 <> 0""",
    ),
    "y03_core_ranks": (
        lambda r: rules.core_ranks(r["contract"].select("id", "name", "path"), _core(r)).select("id", "core_rank"),
        """WITH core AS (SELECT n_nationkey AS pos, concat('C', n_nationkey * 5) AS name, CASE n_nationkey % 3 WHEN 0 THEN concat('src/BUILDING/C', n_nationkey * 5, '.sol') WHEN 1 THEN '' ELSE 'src/nowhere.sol' END AS path FROM nation)
        SELECT id, coalesce(least((SELECT min(pos) FROM core k WHERE k.path <> '' AND k.path = c.path), (SELECT min(pos) FROM core k WHERE k.path = '' AND k.name = c.name)), (SELECT min(pos) FROM core k WHERE k.name = c.name), 2147483647) AS core_rank FROM contract c""",
    ),
    "y04_window_split": (
        lambda r: r["orders"].select("o_orderkey", *[c.alias(n) for c, n in zip(rules.split_window((F.col("o_custkey") * 10).cast("long"), (F.col("o_orderkey") % 11) / 10), ("new_items", "candidates"), strict=True)]),
        """SELECT o_orderkey, n AS new_items, greatest(u - n, 2048) AS candidates FROM (SELECT o_orderkey, u, greatest(floor(u * greatest(0.05::DOUBLE, least(0.95::DOUBLE, k::DOUBLE / 10)))::BIGINT, 2048) AS n
        FROM (SELECT o_orderkey, o_custkey * 10 AS u, o_orderkey % 11 AS k FROM orders) x) y""",
    ),
    "y05_slugs": (
        lambda r: r["documents"].select("doc_id", rules.slug(F.coalesce("text", F.lit(""))).alias("slug")),
        """SELECT doc_id, CASE WHEN s = '' THEN 'project' ELSE s END AS slug FROM (SELECT doc_id, trim(left(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', '-', 'g')), 48), '-') AS s FROM documents) x""",
    ),
    "y14_merge_choices": (
        lambda r: rules.merge_choices(r["lineitem"].select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("chunk"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey") % 3).alias("target"))).select("item", "choice", F.concat_ws(",", F.transform("targets", lambda x: x.cast("string"))).alias("targets")),
        """SELECT item, CASE len(t) WHEN 0 THEN 'new' WHEN 1 THEN 'merge' ELSE 'ask again' END AS choice, array_to_string(t, ',') AS targets
        FROM (SELECT l_orderkey AS item, coalesce(list_sort(list(DISTINCT l_partkey % 3) FILTER (l_returnflag = 'R')), []) AS t FROM lineitem GROUP BY 1) x""",
    ),
    "y17_external_summary": (
        lambda r: r["audit_finding"].agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "High").alias("grounded"), F.count_if(F.col("severity") != "High").alias("skipped")),
        "SELECT count(*) AS total, count(*) FILTER (severity = 'High') AS grounded, count(*) FILTER (severity <> 'High') AS skipped FROM audit_finding",
    ),
    "y22_first_calls": (
        lambda r: rules.first_calls(r["function_call"].select((F.col("caller_id") * 10 + F.col("site")).alias("ord"), F.col("caller_id").alias("from_id"), F.col("callee_id").alias("to_id"))),
        "SELECT caller_id AS from_id, callee_id AS to_id, min(caller_id * 10 + site) AS ord FROM function_call GROUP BY 1, 2",
    ),
    "y26_source_chunks": (
        _chunk,
        r"""SELECT doc_id, md5(CASE WHEN n = 1 THEN '' ELSE substr(text, strpos(text, chr(10)) + 1, length(text) - strpos(text, chr(10)) - length(l[-1])) END) AS chunk
        FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) AS n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) x) y""",
    ),
    "x20_wrapped_labels": (
        lambda r: r["part"].select("p_partkey", t.wrap_label(F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name"), 14).alias("label")),
        """SELECT p_partkey, list_reduce(string_split(concat_ws(' ', p_name, p_type, p_brand, p_name), ' '), lambda a, w: CASE WHEN strlen(string_split(a, chr(10))[-1]) + 1 + strlen(w) <= 14 THEN concat(a, ' ', w) ELSE concat(a, chr(10), w) END) AS label FROM part""",
    ),
    "x24_line_columns": (
        lambda r: r["documents"].where("text IS NOT NULL").select("doc_id", t.line_column(F.col("text"), F.octet_length("text")).alias("p")).select("doc_id", "p.line", "p.column"),
        'SELECT doc_id, len(string_split(text, chr(10))) AS line, length(string_split(text, chr(10))[-1]) AS "column" FROM documents WHERE text IS NOT NULL',
    ),
    "x25_byte_cuts": (
        lambda r: r["documents"].select("doc_id", F.md5(t.head_bytes(F.col("text"), 300)).alias("head"), F.md5(t.tail_bytes(F.col("text"), 300)).alias("tail"), F.md5(t.tail_bytes(F.col("text"), 300, note=False)).alias("bare")),
        """SELECT doc_id, md5(CASE WHEN strlen(text) <= 300 THEN text WHEN text IS NOT NULL THEN concat(h, ' … [', strlen(text) - strlen(h), ' bytes truncated]') END) AS head,
        md5(CASE WHEN strlen(text) <= 300 THEN text WHEN text IS NOT NULL THEN concat('…[', strlen(text) - 300, ' bytes earlier]', chr(10), b) END) AS tail, md5(CASE WHEN strlen(text) <= 300 THEN text ELSE b END) AS bare
        FROM (SELECT doc_id, text, left(text, list_max(list_filter(range(0, 301), lambda k: strlen(left(t3, k)) <= 300 AND k <= length(t3)))) AS h, right(text, list_max(list_filter(range(0, 301), lambda k: strlen(right(r3, k)) <= 300 AND k <= length(r3)))) AS b
          FROM (SELECT doc_id, text, left(text, 300) AS t3, right(text, 300) AS r3 FROM documents) x) y""",
    ),
    "x25_document_cuts": (
        lambda r: r["documents"].where("text IS NOT NULL").select("doc_id", F.octet_length(t.tail_bytes(F.col("text"), 101, note=False)).alias("n"), F.md5(t.tail_bytes(F.col("text"), 400, note=False)).alias("tail")).select("doc_id", F.col("n").between(0, 101).alias("short"), "tail"),
        """SELECT doc_id, true AS short, md5(CASE WHEN strlen(text) <= 400 THEN text ELSE right(t4, list_max(list_filter(range(0, 401), lambda k: strlen(right(t4, k)) <= 400))) END) AS tail
        FROM (SELECT doc_id, text, right(text, 400) AS t4 FROM documents WHERE text IS NOT NULL) x""",
    ),
    "x21_identifiers": (
        lambda r: r["path_t"].select("id", t.dot_identifier(F.concat(F.lit("./"), "path")).alias("name")),
        "SELECT id, lower(regexp_replace(regexp_replace(concat('./', path), '[^A-Za-z0-9]+', '_', 'g'), '^_|_$', '', 'g')) AS name FROM path_t",
    ),
    "x21_short_labels": (
        lambda r: r["documents"].where("text IS NOT NULL").select("doc_id", t.short_label(F.col("text")).alias("label")),
        r"""SELECT doc_id, CASE WHEN length(l) <= 120 THEN l ELSE concat(left(l, 117), '...') END AS label FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\r?\n\z', ''), '\r?\n', ' ', 'g') AS l FROM documents WHERE text IS NOT NULL) x""",
    ),
    "x34_setup_failures": (
        lambda r: _tests(r).select("id", t.setup_failed(F.col("status"), F.col("test"), F.col("reason")).alias("failed")),
        """SELECT id, violated AND (id % 3 = 0 OR id % 17 = 0) AS failed FROM harness_run""",
    ),
    "x34_first_reasons": (
        lambda r: _tests(r).groupBy("code_id").agg(F.min_by("reason", F.when((F.col("status") == "Failure") & (F.col("reason") != ""), F.col("id"))).alias("reason")),
        "SELECT code_id, arg_min(CASE WHEN id % 17 = 0 THEN concat('Failed to SET up ', id) ELSE reason END, id) FILTER (violated) AS reason FROM harness_run GROUP BY 1",
    ),
    "x35_invariant_stats": (
        lambda r: r["harness_run"].select("id", t.invariant_stats(F.when(F.col("id") % 4 == 0, F.concat(F.lit('{"Unit": {"gas": '), "calls", F.lit("}}"))).when(F.col("id") % 5 == 0, F.lit("not JSON")).otherwise(
            F.concat(F.lit('{"Invariant": {"calls": '), "calls", F.lit(', "reverts": '), "reverts", F.when(F.col("id") % 7 == 0, "").otherwise(F.concat(F.lit(', "runs": '), "code_id")), F.lit("}}")))).alias("s")).select("id", "s.runs", "s.calls", "s.reverts"),
        """SELECT id, CASE WHEN id % 4 <> 0 AND id % 5 <> 0 THEN CASE WHEN id % 7 = 0 THEN 0 ELSE code_id END END AS runs, CASE WHEN id % 4 <> 0 AND id % 5 <> 0 THEN calls END AS calls,
        CASE WHEN id % 4 <> 0 AND id % 5 <> 0 THEN reverts END AS reverts FROM harness_run""",
    ),
    "x36_deterministic": (
        lambda r: r["documents"].select(
            "doc_id", t.is_deterministic_violation(F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.lit(" attack reached: yes")).otherwise(F.lit(" deterministic"))), "attack reached:", F.concat(F.when(F.col("doc_id") % 3 == 0, "invariant").otherwise("test"), "lang"), F.col("doc_id") % 5 == 0).alias("marked")
        ),
        "SELECT doc_id, text IS NOT NULL AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND (doc_id % 2 = 0 OR contains(text, 'attack reached:')) AS marked FROM documents",
    ),
    "x38_checked_places": (
        lambda r: r["lineitem"].select("l_orderkey", "l_linenumber", rules.checked_int(F.col("l_partkey").cast("long") * 1000).alias("place")),
        "SELECT l_orderkey, l_linenumber, (l_partkey * 1000)::INT AS place FROM lineitem",
    ),
}
