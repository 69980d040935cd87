"""Tasks that follow the rows, and work that is done once."""

import pytest
from pyspark.sql import functions as F

from auditweave import storage
from auditweave.operators import code, integrity, keep, knowledge, rules, state, stats
from auditweave.plans.registry import queries
from auditweave.plans.roles import Roles

SF = "/root/testdata/sf0.001"
PARTS = 7


@pytest.fixture
def roles(spark):
    return Roles(spark, SF)


def dealt_the_same(few, many):
    """The same rows, and shuffles of PARTS tasks."""
    assert f", {PARTS}), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_links_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 1000)
    r = Roles(spark, SF)
    rows = r["lineitem"].count()
    assert r.parts("lineitem") == -(-rows // 1000) > 1
    assert f", {r.parts('lineitem')}), REPARTITION_BY_NUM" in r["sfl"]._jdf.queryExecution().executedPlan().toString()


def test_issues_in_tasks(roles):
    dealt_the_same(integrity.issues(roles), integrity.issues(roles, PARTS))


def test_missing_rows_in_tasks(spark):
    there, new = spark.range(50).selectExpr("id % 9 AS a", "id AS b"), spark.range(40, 70).selectExpr("id % 9 AS a", "id AS b")
    dealt_the_same(state.add_missing(there, new, ["a", "b"]), state.add_missing(there, new, ["a", "b"], PARTS))


def test_reach_in_tasks(roles):
    of = [roles[n] for n in ("semantic_node", "semantic_merge", "project_semantic")]
    dealt_the_same(stats.project_reach(*of), stats.project_reach(*of, PARTS))


def test_steps_meet_a_row_a_name(spark):
    """Three thousand functions of one name and owner: nine million pairs, of which no join may make a row."""
    steps = spark.range(3000).selectExpr("id", "concat('C', id % 1) AS contract", "concat('f', id % 1) AS function")
    owned = spark.range(3000).selectExpr("id", "concat('f', id % 1) AS name", "concat('C', id % 1) AS owner", "'contract' AS kind")
    out = code.resolve_steps(steps, owned)
    got = out.groupBy("function_id", "tier").count().collect()
    assert [tuple(x) for x in got] == [(0, 0, 3000)]
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    inner = next(k for k, line in enumerate(lines) if "Join Inner" in line and "owner" in line)
    assert any("Aggregate [owner" in line for line in lines[inner:])


def test_methods_are_made_in_even_tasks(spark, monkeypatch):
    """Functions of one name and owner: their pairs are made by many tasks, each pair of lists once."""
    for name, value in {"BLOCK": 64, "TILE": 16, "MADE": 10_000}.items():
        monkeypatch.setattr(code, name, value, raising=False)
    functions = spark.range(600).selectExpr("CAST(id AS INT) AS id", "1 AS owner_id", "'m' AS name")
    inherits, owners = spark.createDataFrame([], "contract_id int, inherited_id int"), spark.createDataFrame([(1, True)], "id int, concrete boolean")
    got = code.interface_methods(functions, inherits, owners)
    assert got.distinct().count() == got.count() == 600 * 600
    made = [n for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(made) >= 20 and max(made) <= 60_000


def test_processed_without_links_in_tasks(roles):
    of = [roles["finding_link_status"], roles["sfl"].where("strength = 'High'"), roles["finding_merge"]]
    dealt_the_same(knowledge.processed_without_links(*of), knowledge.processed_without_links(*of, PARTS))


def test_repair_reads_a_table_once(spark):
    from auditweave.sources.snapshots import Table

    specs = [Table("a", "id long"), Table("b", "id long, a long", {"a": ("a", "id")})]
    rows, made = counted(spark, spark.range(100).selectExpr("id", "id % 10 AS a"))
    got = integrity.repaired({"a": spark.range(8), "b": rows}, specs)
    assert sorted(map(tuple, got.report.collect())) == [("a", 0, 0, 0), ("b", 20, 20, 0)] and got.tables["b"].count() == 80
    assert made.value == 100


def test_slugs_read_what_they_need(spark):
    texts = ["", " - ", "a" * 100, "é" * 5000 + "b" + "é" * 5000 + "c" * 60, "x--y " * 40, "ab\n\r𝄞" * 30, "a-" * 24 + "é", "a-" * 23 + "bé" * 3, "-" * 9000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.btrim(F.substring(F.lower(F.regexp_replace("t", "[^A-Za-z0-9]+", "-")), 1, 48), F.lit("-"))
    got = df.select(rules.slug(F.col("t")).alias("slug"), F.when(plain == "", "project").otherwise(plain).alias("plain"))
    assert all(r.slug == r.plain for r in got.collect())
    assert "regexp_extract" in got.select("slug")._jdf.queryExecution().optimizedPlan().toString()


def test_caps_before_the_fan_out(spark):
    """A concept's links beyond the cap of a pair never meet its extracts, and the plan stays the same."""
    links = spark.range(90).selectExpr("id % 3 AS historical_id", "id AS finding_id", "CASE id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' ELSE 'Medium' END AS link")
    first = keep.first_links(links, "Medium", 2)
    assert sorted(map(tuple, first.collect())) == [(0, 0, "High"), (0, 12, "High"), (1, 4, "High"), (1, 16, "High"), (2, 8, "High"), (2, 20, "High")]
    matched = spark.range(12).selectExpr("id % 4 AS extract_id", "id % 3 AS historical_id", "CASE id % 2 WHEN 0 THEN 'High' ELSE 'Medium' END AS match", "id AS ord")
    built = links.where("finding_id = 12").select(F.lit(0).alias("extract_id"), "historical_id", "finding_id")

    def plan(of):
        fan = matched.join(of, "historical_id").withColumn("ord", F.struct("ord", "finding_id", "historical_id"))
        return sorted(map(str, keep.plan_links(fan, built, "Medium", "Medium", 2, 3, 10).collect()))

    assert plan(links) == plan(first)


def test_overview_in_tasks(roles):
    assert sorted(map(str, stats.overview(roles).collect())) == sorted(map(str, stats.overview(roles, PARTS).collect()))
    of = [roles[n] for n in ("semantic_node", "semantic_merge", "project_semantic")]
    dealt_the_same(stats._reach(*of, "semantic_node_id", 0), stats._reach(*of, "semantic_node_id", PARTS))


def counted(spark, df):
    """The frame, and how often its rows have been made."""
    made = spark.sparkContext.accumulator(0)

    def one(batches):
        for b in batches:
            made.add(len(b))
            yield b

    return df.mapInPandas(one, df.schema), made


def test_new_ids_read_their_rows_once(spark):
    rows, made = counted(spark, spark.range(100).withColumnRenamed("id", "at"))
    out = state.with_new_ids(spark.range(5), rows, "at")
    assert sorted(map(tuple, out.select("at", "id").collect())) == [(k, 5 + k) for k in range(100)]
    assert made.value == 100


def test_batches_size_their_shuffles(spark, tmp_path):
    from auditweave.sources.versions import Store
    from auditweave.streaming import drains

    spark.range(4).write.parquet(str(tmp_path / "in"))
    seen = []

    def work(fresh, base):
        seen.append(fresh.sparkSession.conf.get("spark.sql.adaptive.enabled"))
        return {}, {"out": fresh}

    queue = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = drains.drain(queue, Store(spark, f"file://{tmp_path}/store"), "q", ["id"], work).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == ["true"]

def test_drained_files_follow_the_rows(spark, monkeypatch, tmp_path):
    from auditweave.plans import store_queries

    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    monkeypatch.setattr(store_queries, "scratch_path", lambda spark, what: f"file://{tmp_path}/{what}")
    parts = Roles(spark, SF).parts("lineitem")
    out = queries()["t08_drained_results"](spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert len(spark.read.parquet(f"file://{tmp_path}/drain/in").inputFiles()) >= parts > 6


def test_complete_findings_are_made_once(spark):
    from auditweave.sources.versions import Snapshot
    from auditweave.streaming import drains

    fresh = spark.createDataFrame([(1, 1, 1, 1, False, 3, "Low", "")], "finding_id int, target_id int, context int, expected int, failed boolean, semantic_id int, strength string, evidence string")
    out = drains.link_findings(fresh, Snapshot(spark, 0, {}))[1]
    assert [tuple(r) for r in out["link_complete"].collect()] == [(1,)]
    assert "Exchange" not in out["link_complete"]._jdf.queryExecution().executedPlan().toString()


def test_scope_reads_links_once(roles):
    """Names and categories come of one pass over the links, in tasks by their rows, and no link is ranked before."""
    made = knowledge.vulnerability_scope(
        *[roles[n] for n in ("sfl_raw", "audit_finding", "semantic_node", "finding_merge", "semantic_merge", "project_finding", "project_category")], PARTS
    )
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_partkey#") and plan.count("collect_set(name") == plan.count("collect_set(category") - 1 == 1  # the projects' categories are another
    whole = queries()["j12_vulnerability_scope"](roles.spark, SF)
    assert "Window" not in whole._jdf.queryExecution().optimizedPlan().toString()
    few = knowledge.vulnerability_scope(*[roles[n] for n in ("sfl", "audit_finding", "semantic_node", "finding_merge", "semantic_merge", "project_finding", "project_category")])
    dealt_the_same(few, made)


def test_moved_nodes_only(spark):
    from auditweave.operators import graph

    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 7, 11)], "id int")
    edges = spark.createDataFrame([(4, 2), (2, 1), (7, 11), (11, 7), (3, 99), (98, 1)], "from_id int, to_id int")
    every = {r.node: r.canonical for r in graph.resolve(nodes, edges, nodes).collect()}
    moved = {r.node: r.canonical for r in graph.resolve_moved(nodes, edges, nodes).collect()}
    assert moved == {4: 1, 2: 1, 7: 7, 11: 11} and every == moved | {1: 1, 3: 3}
    assert not graph.resolve_moved(nodes, edges.limit(0), nodes).collect()
