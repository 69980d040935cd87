"""The driver's tables in the roles of the data model, as SQL that Spark and DuckDB both read.

A role names its sources in braces: base tables or other roles.  ``Roles`` gives each as a
DataFrame, ``with_roles`` puts the definitions that a statement needs in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dealt, task_count

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

ROLES = {
    # knowledge graph
    "semantic_node": "SELECT CAST(p_partkey AS INT) AS id, p_name AS name, p_type AS definition, CONCAT(p_name,' / ',p_brand,' / ',p_type) AS description, p_type AS category FROM {part}",
    "audit_finding": "SELECT CAST(o_orderkey AS INT) AS id, CONCAT(o_orderpriority,' ',CAST(o_custkey % 97 AS STRING)) AS title, CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'Medium' ELSE 'Low' END AS severity, CONCAT('cause ',CAST(o_custkey % 13 AS STRING)) AS root_cause, CONCAT('finding of ',o_orderpriority) AS description FROM {orders}",
    "sfl_raw": "SELECT CAST(l_partkey AS INT) AS semantic_node_id, CAST(l_orderkey AS INT) AS audit_finding_id, CASE l_returnflag WHEN 'R' THEN 'High' WHEN 'A' THEN 'Medium' ELSE 'Low' END AS strength, CASE WHEN l_linestatus='O' AND l_linenumber=1 THEN 'in-project link: row' ELSE CONCAT('rationale ',CAST(l_suppkey AS STRING)) END AS evidence, l_linenumber AS ord FROM {lineitem}",
    "sfl": "SELECT semantic_node_id, audit_finding_id, strength, evidence, ord FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY semantic_node_id, audit_finding_id ORDER BY CASE strength WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END DESC, ord, evidence) AS rn FROM {sfl_raw}) x WHERE rn = 1",
    "semantic_merge": "SELECT id AS from_id, CAST(FLOOR(id/5) AS INT) AS to_id FROM {semantic_node} WHERE id>0 AND id%5=0 UNION ALL SELECT id, CAST(FLOOR(id/10) AS INT) FROM {semantic_node} WHERE id>0 AND id%10=0 UNION ALL SELECT 7,11 UNION ALL SELECT 11,7 UNION ALL SELECT 13,999999999",
    "finding_merge": "SELECT id AS from_id, CAST(FLOOR(id/4) AS INT) AS to_id FROM {audit_finding} WHERE id>0 AND id%4=0",
    "finding_link_status": "SELECT id AS audit_finding_id FROM {audit_finding} WHERE severity<>'Low'",
    "pending_semantic": "SELECT CAST(p_partkey AS INT) AS semantic_node_id FROM {part} WHERE p_size>45",
    "project": "SELECT CAST(s_suppkey AS INT) AS id, s_name AS name, CASE WHEN s_suppkey%10=0 THEN 'pending' ELSE 'completed' END AS status FROM {supplier}",
    "project_platform": "SELECT CAST(s_suppkey AS INT) AS project_id, CONCAT(n_name,'-',CAST(s_suppkey AS STRING)) AS platform_id FROM {supplier} JOIN {nation} ON s_nationkey=n_nationkey WHERE s_suppkey%7<>0",
    "project_category": "SELECT DISTINCT CAST(l_suppkey AS INT) AS project_id, p_type AS category FROM {lineitem} JOIN {part} ON l_partkey=p_partkey WHERE l_linenumber=2",
    "project_semantic": "SELECT DISTINCT CAST(l_suppkey AS INT) AS project_id, CAST(l_partkey AS INT) AS semantic_node_id FROM {lineitem}",
    "project_finding": "SELECT DISTINCT CAST(l_suppkey AS INT) AS project_id, CAST(l_orderkey AS INT) AS audit_finding_id FROM {lineitem} WHERE l_linenumber=1",
    "finding_taxonomy": "SELECT CAST(o_orderkey AS INT) AS audit_finding_id, CAST(o_custkey % 7 AS INT) AS category_id, CONCAT('vuln ',CAST(o_custkey % 7 AS STRING)) AS category FROM {orders} WHERE o_orderkey % 31 <> 0",
    "semantic_function": "SELECT CAST(ps.l_partkey AS INT) AS semantic_node_id, CONCAT('fn',CAST(ps.l_suppkey AS STRING)) AS function_name, CONCAT('src/C',CAST(ps.l_suppkey % 5 AS STRING),'.sol') AS contract_path FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem} WHERE l_quantity > 45) ps",
    "operation_history": "SELECT CAST(event_id AS INT) AS id, event_type AS type, props AS args FROM {events}",
    "merge_status": "SELECT CAST(n_nationkey AS INT) AS id, CONCAT('src',CAST(n_nationkey % 6 AS STRING)) AS source_key, CASE n_nationkey % 3 WHEN 0 THEN 'imported' WHEN 1 THEN 'retro' ELSE 'link' END AS phase FROM {nation}",
    # project
    "project_extract": "SELECT CAST(s_suppkey AS INT) AS id, s_name AS name, CONCAT('extract ',s_name) AS description, CASE s_suppkey % 3 WHEN 0 THEN 'PROMO' WHEN 1 THEN 'ECONOMY' ELSE 'STANDARD' END AS category FROM {supplier}",
    "match_raw": "SELECT CAST(l_suppkey AS INT) AS extract_id, CAST(l_partkey AS INT) AS historical_id, CASE l_returnflag WHEN 'R' THEN 'High' WHEN 'A' THEN 'Medium' ELSE 'Low' END AS strength, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ord FROM {lineitem} WHERE l_quantity > 25",
    "semantic_matched": "SELECT extract_id, historical_id, strength, ord FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY extract_id, historical_id ORDER BY CASE strength WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END DESC, ord) AS rn FROM {match_raw}) x WHERE rn = 1",
    "specification": "SELECT CAST(o_orderkey AS INT) AS id, CAST(MIN(l_suppkey) AS INT) AS extract_id, CAST(MIN(l_partkey) AS INT) AS historical_id, CAST(o_orderkey AS INT) AS finding_id FROM {orders} JOIN {lineitem} ON l_orderkey=o_orderkey AND l_linenumber=1 GROUP BY o_orderkey",
    "code_gen": "SELECT CAST(c_custkey AS INT) AS id, CAST(c_custkey * 5 AS INT) AS spec_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Completed' WHEN 'AUTOMOBILE' THEN 'Abandoned' WHEN 'MACHINERY' THEN 'StepsExhausted' WHEN 'HOUSEHOLD' THEN 'Completed' ELSE 'AgentError' END AS status FROM {customer}",
    "code_gen_regen": "SELECT CAST(c_custkey AS INT) AS child_id, CAST(FLOOR(c_custkey/2) AS INT) AS parent_id FROM {customer} WHERE c_custkey>1 AND c_custkey%3<>0",
    "specification_regen": "SELECT CAST(o_orderkey AS INT) AS child_id, CAST(FLOOR(o_orderkey/3) AS INT) AS parent_id FROM {orders} WHERE o_orderkey>2 AND o_orderkey%4<>1",
    "harness_run": "SELECT CAST(o_orderkey AS INT) AS id, CAST(o_custkey AS INT) AS code_id, CAST(o_orderstatus='F' AS BOOLEAN) AS violated, CAST(o_custkey % 50 AS BIGINT) AS calls, CAST(FLOOR((o_custkey % 50) * (o_orderkey % 11) / 10) AS BIGINT) AS reverts, CASE WHEN o_orderkey % 17 = 0 THEN 'setUp() failed' ELSE 'assertion' END AS reason FROM {orders}",
    "reflection": "SELECT CAST(o_orderkey AS INT) AS id, CAST(o_orderkey AS INT) AS run_id, CASE o_orderkey % 6 WHEN 0 THEN 'ValidFinding' WHEN 1 THEN 'IncompleteStep' WHEN 2 THEN 'WrongHarness' WHEN 3 THEN 'WrongSpec' WHEN 4 THEN 'IntendedBehavior' ELSE 'NotReproducible' END AS result, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '  ' ELSE CONCAT('claim ',CAST(o_custkey AS STRING)) END AS claim FROM {orders} WHERE o_orderkey % 3 <> 2",
    "finding_review": "SELECT id AS reflection_id, CASE id % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' WHEN 3 THEN 'Informational' ELSE 'ReviewedOutOfScope' END AS severity, CONCAT('review text ',COALESCE(claim,'')) AS body FROM {reflection} WHERE result='ValidFinding' AND id % 12 <> 0",
    "report_merge": "SELECT reflection_id AS from_id, CAST(reflection_id - reflection_id % 60 + 6 AS INT) AS to_id FROM {finding_review} WHERE reflection_id % 18 <> 0",
    "ruled_out_merge": "SELECT id AS from_id, CAST(id - id % 48 + 4 AS INT) AS to_id FROM {reflection} WHERE result IN ('IntendedBehavior','NotReproducible') AND claim IS NOT NULL AND id % 10 <> 4",
    # code
    "contract": "SELECT CAST(c_custkey AS INT) AS id, CONCAT('C',CAST(c_custkey AS STRING)) AS name, CONCAT('src/',c_mktsegment,'/C',CAST(c_custkey AS STRING),'.sol') AS path FROM {customer}",
    "contract_inherit": "SELECT CAST(c_custkey AS INT) AS contract_id, CAST(FLOOR(c_custkey/3) AS INT) AS inherited_id FROM {customer} WHERE c_custkey>0",
    "function_t": "SELECT CAST(p_partkey AS INT) AS id, p_brand AS path, p_name AS name, CAST(p_size*10 AS INT) AS start_line, CAST(p_size*10+8 AS INT) AS end_line, CAST(p_partkey % 97 AS INT) AS owner_id FROM {part}",
    "function_call": "SELECT CAST(l_orderkey % 2000 AS INT) AS caller_id, CAST(l_partkey AS INT) AS callee_id, CAST(l_linenumber AS INT) AS site FROM {lineitem} WHERE l_linenumber < 3",
    "state_variable": "SELECT CAST(n_nationkey AS INT) AS id, n_name AS name, CAST(n_nationkey * 4 AS INT) AS contract_id, CAST(n_nationkey % 4 = 0 AS BOOLEAN) AS constant FROM {nation}",
    "line_coverage": "SELECT CAST(l_orderkey AS INT) AS run_id, p_brand AS path, CAST(l_quantity*10+l_linenumber AS INT) AS line_number, CAST(l_linenumber AS BIGINT) AS hit_count FROM {lineitem} JOIN {part} ON l_partkey=p_partkey",
    "path_t": "SELECT CAST(p_partkey AS INT) AS id, CONCAT(CASE p_partkey % 9 WHEN 0 THEN 'lib/' WHEN 1 THEN 'src/vendor/' WHEN 2 THEN 'contracts/test/' WHEN 3 THEN 'tests/' WHEN 4 THEN 'a/node_modules/b/' WHEN 5 THEN 'target/' WHEN 6 THEN 'sub/target/' WHEN 7 THEN 'library/' ELSE 'src/' END, 'F', CAST(p_partkey AS STRING), '.sol') AS path FROM {part}",
}


#: Roles of a row a line or nearly: the source that is dealt out by their key before they are made.
DEALT = {
    "sfl": ("sfl_raw", "semantic_node_id", "audit_finding_id"),
    "semantic_matched": ("match_raw", "extract_id", "historical_id"),
    "project_semantic": ("lineitem", "CAST(l_suppkey AS INT)", "CAST(l_partkey AS INT)"),
    "project_finding": ("lineitem", "CAST(l_suppkey AS INT)", "CAST(l_orderkey AS INT)"),
}


class Roles:
    """Base tables and roles of one input folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}
        self._parts: dict[str, int] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in ROLES:
                used = {n: self[n] for n in re.findall(r"\{(\w+)\}", ROLES[name])}
                if name in DEALT:
                    source, *keys = DEALT[name]
                    used[source] = dealt(used[source], self.parts("lineitem"), *map(F.expr, keys))
                self._made[name] = self.spark.sql(ROLES[name], **used)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def parts(self, table: str) -> int:
        """Tasks for the rows of a base table, by the counts in its files' footers."""
        if table not in self._parts:
            self._parts[table] = task_count(self[table].count())
        return self._parts[table]


def with_roles(statement: str) -> str:
    """The statement for DuckDB, with the roles it names as common table expressions."""
    order: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\b\w+\b", text):
            if name in ROLES and name not in order:
                add(ROLES[name])
                order.append(name)

    statement = statement.strip()
    add(statement)
    roles = [f"{n} AS ({re.sub(r'[{}]', '', ROLES[n])})" for n in order]
    if m := re.match(r"WITH (RECURSIVE )?", statement):
        statement = statement[m.end() :]
        return f"WITH RECURSIVE {', '.join(roles + [statement])}"
    return f"WITH RECURSIVE {', '.join(roles)} {statement}" if roles else statement
