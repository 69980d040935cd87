"""Text functions and formats over the driver's tables: name -> (plan, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.enums import parse_project_category, parse_strength
from ..operators import keep
from ..sources import formats

_WS = r"[\t\n\x0b\x0c\r ]+"

QUERIES = {
    "f09_vendored_paths": (
        lambda r: r["path_t"].select("id", t.is_vendored(F.col("path")).alias("vendored"), t.is_vendored(F.col("path"), True).alias("without_lib")),
        """SELECT id, path LIKE 'lib/%' OR path LIKE '%/vendor/%' OR path LIKE '%/test/%' OR path LIKE '%node_modules/%' OR path LIKE 'target/%' AS vendored,
        path LIKE '%/vendor/%' OR path LIKE '%/test/%' OR path LIKE '%node_modules/%' OR path LIKE 'target/%' AS without_lib FROM path_t""",
    ),
    "f10_not_audited_paths": (
        lambda r: r["path_t"].select("id", t.is_not_audited(F.col("path")).alias("skipped")),
        "SELECT id, list_has_any(string_split(path, '/'), ['test','tests','mock','mocks','script','scripts','deploy','out','artifacts','cache','broadcast','node_modules','target']) AS skipped FROM path_t",
    ),
    "x01_truncate": (
        lambda r: r["semantic_node"].select("id", t.truncate_text(F.concat(F.lit("  "), F.regexp_replace("description", " ", " \n ")), 18).alias("short")),
        "SELECT id, CASE WHEN length(description) > 18 THEN concat(rtrim(substr(description, 1, 18)), '…') ELSE description END AS short FROM semantic_node",
    ),
    "x02_render_variants": (
        lambda r: r["semantic_merge"].join(r["semantic_node"].select(F.col("id").alias("from_id"), "name"), "from_id").groupBy("to_id").agg(F.array_sort(F.collect_list("name")).alias("notes")).select(
            "to_id", t.render_with_variants(F.concat(F.lit(" node "), F.col("to_id").cast("string")), F.col("notes"), 2, 4).alias("text")
        ),
        """WITH k AS (SELECT to_id, name, row_number() OVER (PARTITION BY to_id ORDER BY name) AS rn, count(*) OVER (PARTITION BY to_id) AS n FROM semantic_merge JOIN semantic_node ON id = from_id)
        SELECT to_id, concat('node ', to_id, string_agg(concat(chr(10), '— ', CASE WHEN length(name) > 4 THEN concat(substr(name, 1, 4), ' …[truncated]') ELSE name END), '' ORDER BY rn) FILTER (rn <= 2),
        CASE WHEN max(n) > 2 THEN concat(chr(10), '— (+', max(n) - 2, ' more folded raws not shown)') ELSE '' END) AS text FROM k GROUP BY to_id""",
    ),
    "x08_taxonomy_key": (
        lambda r: r["audit_finding"].select("id", t.normalize_key(F.concat(F.lit(" -- "), F.col("title"), F.lit("/X_"))).alias("key")),
        "SELECT id, trim(regexp_replace(lower(concat(' -- ', title, '/X_')), '[^a-z0-9]+', ' ', 'g')) AS key FROM audit_finding",
    ),
    "x10_category_parse": (
        lambda r: r["customer"].select("c_custkey", parse_project_category(F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, ("SERVICES ", "real_world_assets", "nft-marketplace", "Sevices"))), (F.col("c_custkey") % 4 + 1).cast("int")))).alias("category")),
        "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Services' WHEN 1 THEN 'Real World Assets' WHEN 2 THEN 'NFT Marketplace' END AS category FROM customer",
    ),
    "x11_strength_parse": (
        lambda r: r["sfl"].select("semantic_node_id", "audit_finding_id", parse_strength(F.concat(F.lit(" "), F.upper(F.substring("strength", 1, 3)), F.lit(" "))).alias("short"), parse_strength(F.upper("strength")).alias("whole")),
        "SELECT semantic_node_id, audit_finding_id, CASE strength WHEN 'Medium' THEN 'Medium' WHEN 'Low' THEN 'Low' END AS short, strength AS whole FROM sfl",
    ),
    "x14_quote_form": (
        lambda r: r["documents"].select("doc_id", F.md5(t.quote_form(F.concat(F.lit("“‘É’”\u00a0"), F.coalesce("text", F.lit(""))))).alias("form")),
        r"""SELECT doc_id, md5(lower(regexp_replace(translate(concat('“‘É’”', chr(160), coalesce(text, '')), '‘’‚‛“”„‟', concat(repeat(chr(39), 4), repeat('"', 4))),
          '[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS form FROM documents""",
    ),
    "x15_evidence_check": (
        lambda r: r["sfl"].join(r["audit_finding"].select(F.col("id").alias("audit_finding_id"), "description"), "audit_finding_id").select(
            "semantic_node_id", "audit_finding_id", t.evidence_ok(F.col("evidence"), F.col("strength"), F.col("description"), {"High": 12, "Medium": 12, "Low": 14}).alias("ok")
        ),
        "SELECT semantic_node_id, audit_finding_id, CASE strength WHEN 'High' THEN false WHEN 'Medium' THEN strlen(trim(evidence)) >= 12 ELSE strlen(trim(evidence)) >= 14 END AS ok FROM sfl",
    ),
    "x16_field_guard": (
        lambda r: r["documents"].select("doc_id", F.translate(F.coalesce("text", F.lit("")), "\n\t\r", "xxx").alias("a")).select("doc_id", t.field_update(F.col("a"), F.when(F.col("doc_id") % 2 == 0, F.translate("a", "aeinrst ", "")).otherwise(F.col("a"))).alias("why")),
        """WITH d AS (SELECT doc_id, length(trim(a)) AS o, length(trim(CASE WHEN doc_id % 2 = 0 THEN translate(a, 'aeinrst ', '') ELSE a END)) AS n
          FROM (SELECT doc_id, translate(coalesce(text, ''), chr(10) || chr(9) || chr(13), 'xxx') AS a FROM documents) x)
        SELECT doc_id, CASE WHEN n = 0 THEN 'blank' WHEN n > 2000 THEN 'too long' WHEN o >= 160 AND n < floor(o * 0.6) THEN 'shrinks' END AS why FROM d""",
    ),
    "x18_sql_literals": (
        lambda r: r["supplier"].select("s_suppkey", t.sql_literal(F.concat(F.lit("it's "), F.col("s_name"))).alias("literal")),
        "SELECT s_suppkey, concat('''it''''s ', s_name, '''') AS literal FROM supplier",
    ),
    "x19_redacted_urls": (
        lambda r: r["pages"].select("page_id", t.redact_url(F.regexp_replace("url", "://", "://user:pw@")).alias("url")),
        "SELECT page_id, url FROM pages",
    ),
    "x22_parameter_list": (
        lambda r: r["semantic_node"].select("id", t.parameter_list(F.concat(F.lit("( "), F.regexp_replace("description", " / ", " ,  "), F.lit(" )"))).alias("args")),
        "SELECT id, replace(description, ' / ', ',') AS args FROM semantic_node",
    ),
    "x31_anchor": (
        lambda r: r["audit_finding"].select("id", t.anchor(F.concat(F.lit("H-01: "), F.col("title"))).alias("anchor")),
        "SELECT id, regexp_replace(replace(lower(concat('H-01: ', title)), ' ', '-'), '[^a-z0-9-]', '', 'g') AS anchor FROM audit_finding",
    ),
    "s08_insert_statements": (
        lambda r: formats.insert_statements(r["project"], "project"),
        """SELECT concat('INSERT INTO "project" ("id", "name", "status") VALUES (', id, ', ''', name, ''', ''', status, ''');') AS statement FROM project""",
    ),
    "s24_lcov": (
        lambda r: formats.lcov_lines(
            r["line_coverage"].select("run_id", "path", "line_number", "hit_count").distinct().groupBy(F.col("run_id").alias("id"), "path").agg(
                F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("DA:"), "line_number", F.lit(","), (F.col("hit_count") - 1).cast("string")))), "\n").alias("lines")
            ).groupBy("id").agg(F.concat(F.lit("DA:1,9\n"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("SF:"), "path", F.lit("\t\r\n"), "lines", F.lit("\nDA:7,3x\nDA:8\n  SF:not/at/the/front\nend_of_record \nDA:2,9")))), "\n")).alias("text"))
        ),
        "SELECT DISTINCT run_id AS id, path, line_number, hit_count - 1 AS hit_count FROM line_coverage WHERE hit_count > 1",
    ),
    "s25_run_summary": (
        lambda r: formats.run_summary(r["harness_run"].select("id", F.when(F.col("id") % 5 == 0, "not json").otherwise(F.concat(
            F.lit('{"src/T.sol:T":{"test_results":{"invariant_a()":{"status":"'), F.when(F.col("violated"), "Failure").otherwise("Success"), F.lit('","reason":"'), "reason",
            F.lit('","kind":{"Invariant":{"runs":1,"calls":'), F.col("calls").cast("string"), F.lit(',"reverts":'), F.col("reverts").cast("string"), F.lit("}}}}}}"))).alias("text"))),
        """SELECT id, 'src/T.sol:T' AS suite, 'invariant_a()' AS test, CASE WHEN violated THEN 'Failure' ELSE 'Success' END AS status, reason, calls, reverts FROM harness_run WHERE id % 5 <> 0""",
    ),
    "s34_dot_edges": (
        lambda r: r["semantic_merge"].select(F.concat(F.lit('  "s'), "from_id", F.lit('" -> "s'), "to_id", F.lit('" [style=dashed];')).alias("line")),
        """SELECT concat('  "s', from_id, '" -> "s', to_id, '" [style=dashed];') AS line FROM semantic_merge""",
    ),
    "o11_dedup_semantics": (
        lambda r: keep.dedup_semantics(r["semantic_node"].select(F.concat(F.lit(" "), F.upper("category"), F.lit(" ")).alias("name"), "definition", "description", "category", F.array("name").alias("functions"), F.col("id").alias("ord"))).select(
            "key", "name", "description", "category", F.size("functions").alias("n_functions")
        ),
        """SELECT lower(category) AS key, concat(' ', upper(category), ' ') AS name, arg_max(description, struct_pack(n := strlen(description), o := -id)) AS description, category, count(DISTINCT name)::INT AS n_functions
        FROM semantic_node GROUP BY category""",
    ),
    "o12_dedup_findings": (
        lambda r: keep.dedup_findings(r["audit_finding"].select("title", "severity", "root_cause", "description", F.lit("c").alias("category"), F.concat(F.lit("s"), "id").alias("subcategory"), F.col("id").alias("ord"))),
        """SELECT title, arg_max(severity, struct_pack(r := CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END, o := -id)) AS severity, arg_max(root_cause, struct_pack(n := strlen(root_cause), o := -id)) AS root_cause,
        arg_max(description, struct_pack(n := strlen(description), o := -id)) AS description, 'c' AS category, concat('s', arg_max(id, struct_pack(n := strlen(description), o := -id))) AS subcategory FROM audit_finding GROUP BY title""",
    ),
    "x06_children_block": (
        lambda r: r["semantic_merge"].join(r["semantic_node"].select(F.col("id").alias("from_id"), "name"), "from_id").groupBy("to_id").agg(F.array_sort(F.collect_list("name")).alias("names")).select("to_id", t.first_children(F.col("names"), 1).alias("block")),
        """SELECT to_id, CASE WHEN count(*) > 1 THEN concat('- ', min(name), chr(10), '- +', count(*) - 1, ' more') ELSE concat('- ', min(name)) END AS block FROM semantic_merge JOIN semantic_node ON id = from_id GROUP BY to_id""",
    ),
    "x26_signatures": (
        lambda r: r["function_t"].select("id", t.function_signature(F.concat(F.lit("function f"), "id", F.lit("(uint a, // first\n  uint b) /* note; */ public\n{ return a; }"))).alias("signature")),
        "SELECT id, concat('function f', id, '(uint a, uint b) public') AS signature FROM function_t",
    ),
    "x27_headers": (
        lambda r: r["contract"].select("id", t.source_header(F.concat(F.lit("// contract notes\nimport 'a.sol';\n"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("abstract contract "), "name", F.lit(" { contract x }"))).otherwise(""))).alias("header")),
        "SELECT id, concat('// contract notes', chr(10), 'import ''a.sol'';', chr(10)) AS header FROM contract",
    ),
    "x29_move_packages": (
        lambda r: r["project"].select("id", t.move_package(F.concat(F.lit('[addresses]\nname = "no"\n[package]\nversion = "1"\n'), F.when(F.col("id") % 2 == 0, F.concat(F.lit('name = "'), "name", F.lit('"\n'))).otherwise(""), F.lit('[dependencies]\nname = "dep"'))).alias("package")),
        "SELECT id, CASE WHEN id % 2 = 0 THEN name END AS package FROM project",
    ),
}
