"""What the rules refuse."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from auditweave.operators import graph, integrity, rules, state


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_one_category(spark):
    f = rows(spark, [(1,), (2,)], "id int")
    for bad in ([(1, "a")], [(1, "a"), (2, "b"), (2, "c")]):
        with pytest.raises(ValueError, match="category"):
            rules.one_category(f, rows(spark, bad, "audit_finding_id int, category string"))


def test_partners(spark):
    with pytest.raises(ValueError, match="partner"):
        rules.complete_or_raise(rows(spark, [(1, 5)], "id int, run_id int"), rows(spark, [(4,)], "id int"), "run_id", "id")


PROGRESS = "finding_id int, target_id int, context int, expected int, failed boolean, semantic_id int, strength string, evidence string"


def test_targets_that_disagree(spark):
    with pytest.raises(ValueError, match="targets"):
        rules.batch_results(rows(spark, [(1, 7, 1, 2, False, 3, "Low", ""), (1, 8, 2, 2, False, 3, "Low", "")], PROGRESS))


def test_results_of_batches(spark):
    p = [(1, 1, 1, 2, False, 10, "Low", "a"), (1, 1, 2, 2, False, 10, "High", "b"), (1, 1, 2, 2, False, 11, "Medium", "c"), (2, 2, 1, 2, False, 10, "High", "d"), (3, 3, 1, 1, True, 10, "High", "e"),
         (4, 4, 1, 1, False, None, None, None), (5, 9, 2, 2, False, 12, "Low", "late"), (5, 9, 1, 2, False, 12, "Low", "first")]
    assert sorted(map(tuple, rules.batch_results(rows(spark, p, PROGRESS)).collect())) == [(10, 1, "High", "b"), (11, 1, "Medium", "c"), (12, 9, "Low", "first")]


def test_rules_are_part_of_the_operators(spark):
    """Work lists and hydration raise on what the data model forbids."""
    from auditweave.operators import knowledge, project

    f = rows(spark, [(1, "t"), (2, "u")], "id int, title string")
    none = rows(spark, [], "from_id int, to_id int")
    pf, pc = rows(spark, [(1, 5), (1, 3)], "project_id int, audit_finding_id int"), rows(spark, [(1, "DEX")], "project_id int, category string")
    done = rows(spark, [(2,)], "audit_finding_id int")
    for bad in ([(1, 1, "a")], [(1, 1, "a"), (2, 1, "b"), (2, 2, "c")]):  # of a finding that is done, too
        with pytest.raises(ValueError, match="category"):
            knowledge.pending_findings(f, done, rows(spark, bad, "audit_finding_id int, category_id int, category string"), pf, pc, none)
    two = rows(spark, [(1, 4, "b"), (1, 2, "a"), (2, 1, "x")], "audit_finding_id int, category_id int, category string")
    assert [tuple(r) for r in knowledge.linked_findings(f, rows(spark, [(1,)], "audit_finding_id int"), two, none).select("id", "taxonomy").collect()] == [(1, "a")]
    reflections = rows(spark, [(1, 5, "ValidFinding", None)], "id int, run_id int, result string, claim string")
    runs, codes = rows(spark, [(5, 6)], "id int, code_id int"), rows(spark, [(6, 7)], "id int, spec_id int")
    with pytest.raises(Exception, match="misses"):
        project.hydrated_findings(reflections, runs, codes, rows(spark, [], "id int, extract_id int, historical_id int, finding_id int")).collect()
    matched = rows(spark, [(1, 2, "Low", 1), (1, 2, "High", 2)], "extract_id int, historical_id int, strength string, ord int")
    links = rows(spark, [(2, 3, "High", "e", 1), (2, 3, "Low", "f", 2)], "semantic_node_id int, audit_finding_id int, strength string, evidence string, ord int")
    out = knowledge.link_fan_out(matched, rows(spark, [(1, "x")], "id int, name string"), rows(spark, [(2, "h")], "id int, name string"), links, rows(spark, [(3, "t")], "id int, title string"))
    assert [(r["match"], r.link) for r in out.collect()] == [("Low", "High")]


def test_scope_falls_back(spark):
    from auditweave.operators import knowledge

    f, n = rows(spark, [(1,), (2,), (3,)], "id int"), rows(spark, [(9, "n", "DEX")], "id int, name string, category string")
    links = rows(spark, [(9, 1)], "semantic_node_id int, audit_finding_id int")
    none = rows(spark, [], "from_id int, to_id int")
    out = knowledge.vulnerability_scope(links, f, n, none, none, rows(spark, [(4, 2)], "project_id int, audit_finding_id int"), rows(spark, [(4, "Oracle")], "project_id int, category string"))
    assert sorted((r.finding_id, r.names, r.categories) for r in out.collect()) == [(1, ["n"], ["DEX"]), (2, [], ["Oracle"]), (3, [], ["Others"])]


def test_kinds_of_numbers_differ(spark):
    history = rows(spark, [(1, "a", '{"x":1}')], "id int, type string, args string")
    new = rows(spark, [(1, "a", '{"x":1.0}'), (2, "a", ' {"x" : 1}')], "ord int, type string, args string")
    assert sorted(r.args for r in rules.record_operations(history, new).collect()) == ['{"x":1.0}', '{"x":1}']


def test_places_and_degrees(spark):
    from pyspark.sql import functions as F

    one = rows(spark, [("abc\ndef",)], "t string")
    cut = lambda *p: one.select(rules.source_chunk(F.col("t"), *map(F.lit, p))).head()[0]
    assert cut(1, 0, 1, 4) == "abc\n" and cut(1, 4, 2, 3) == "def"
    for bad in ((1, 0, 1, 5), (2, 0, 2, 4), (3, 0, 3, 0)):
        with pytest.raises(Exception, match="place"):
            cut(*bad)
    containers = rows(spark, [(1, False, False), (2, True, False), (3, False, False)], "id int, is_interface boolean, vendored boolean")
    functions = rows(spark, [(10, 1), (20, 2), (30, 3)], "id int, owner_id int")
    calls = rows(spark, [(20, 30), (10, 30), (10, 20)], "caller_id int, callee_id int")
    assert {r.id: r.degree for r in rules.degrees(containers, functions, calls).collect()} == {1: 2, 2: 0, 3: 1}


def test_missing_canonical(spark):
    with pytest.raises(ValueError, match="partner"):
        rules.grouped_candidates(rows(spark, [(1, 9)], "node int, canonical int"), rows(spark, [(1, "n")], "id int, name string"))


@pytest.mark.parametrize("result, has", [("ValidFinding", False), ("WrongHarness", True)])
def test_findings_and_verdicts_go_together(spark, result, has):
    there = rows(spark, [(1, 1, "x", None)], "id int, run_id int, result string, claim string")
    with pytest.raises(ValueError, match="together"):
        rules.insert_reflections(there, rows(spark, [(1, 2, result, "c", has)], "ord int, run_id int, result string, claim string, has_finding boolean"))


def test_one_edge_a_claim(spark):
    there = rows(spark, [(1, 1)], "from_id int, to_id int")
    assert sorted(map(tuple, rules.merge_ruled_out(there, rows(spark, [(2, None), (3, 1)], "id int, representative int")).collect())) == [(1, 1), (2, 2), (3, 1)]
    for bad in ([(1, None)], [(2, None), (2, 1)]):
        with pytest.raises(ValueError, match="unique"):
            rules.merge_ruled_out(there, rows(spark, bad, "id int, representative int"))


def test_one_parent(spark):
    with pytest.raises(ValueError, match="unique"):
        rules.add_lineage(rows(spark, [(2, 1)], "child_id int, parent_id int"), rows(spark, [(2, 3)], "child_id int, parent_id int"))


def test_one_project(spark):
    schema = "id int, name string"
    assert rules.ensure_project(rows(spark, [], schema), "p").collect()[0]["name"] == "p"
    assert rules.ensure_project(rows(spark, [(4, "p")], schema), "p").collect()[0]["id"] == 4
    for there in ([(4, "q")], [(4, "p"), (5, "p")]):
        with pytest.raises(ValueError):
            rules.ensure_project(rows(spark, there, schema), "p")


def test_gate(spark):
    bad = rows(spark, [("t", "p")], "table_name string, problem string")
    with pytest.raises(ValueError):
        integrity.gate(bad)
    integrity.gate(bad, force=True)
    integrity.gate(bad.limit(0))


def test_texts_that_raise(spark):
    one = rows(spark, [("ab\nc",)], "text string")
    assert one.select(rules.source_chunk(F.col("text"), F.lit(1), F.lit(1), F.lit(2), F.lit(1))).head()[0] == "b\nc"
    for place in ((0, 0, 1, 1), (1, 4, 2, 0), (2, 2, 2, 2), (1, 0, 3, 0), (2, 0, 1, 0)):
        with pytest.raises(PySparkException):
            one.select(rules.source_chunk(F.col("text"), *map(F.lit, place))).collect()
    with pytest.raises(PySparkException):
        one.select(rules.checked_int(F.lit(2**31))).collect()
    with pytest.raises(PySparkException):
        one.select(rules.finding_budget(F.lit(10), F.lit(10), F.lit(5))).collect()
    assert one.select(rules.finding_budget(F.lit(20), F.lit(10), F.lit(50)), rules.context_budget(F.lit(1000), F.lit(0.01))).head()[:] == (10, 50)


def test_cycles_raise(spark):
    edges = rows(spark, [(2, 3), (3, 4), (4, 2), (1, 2), (7, 8)], "child_id int, parent_id int")
    assert sorted(map(tuple, graph.chain_depth(rows(spark, [(7,), (8,)], "id int"), edges).collect())) == [(7, 1), (8, 0)]
    with pytest.raises(ValueError, match="cycle"):
        graph.chain_depth(rows(spark, [(1,)], "id int"), edges)


def test_catalog_probe(spark):
    there = {"a": rows(spark, [(1,)], "id int")}
    there["a"].createOrReplaceTempView("here_it_is")
    assert rules.schema_probe(spark, ["here_it_is", "not_there"]) == {"here_it_is": True, "not_there": False}


def test_new_ids_are_distinct(spark):
    made = state.with_new_ids(spark.range(5), spark.range(2000).withColumnRenamed("id", "ord"), "ord").select("id").collect()
    assert sorted(x.id for x in made) == list(range(5, 2005))


def test_repair_cascades(spark):
    """What pointed to a row that goes, goes too; null points to nothing and stays."""
    from auditweave.operators import integrity
    from auditweave.sources.snapshots import Table

    specs = [Table("a", "id int"), Table("b", "id int, a_id int", {"a_id": ("a", "id")}), Table("c", "id int, b_id int", {"b_id": ("b", "id")}), Table("t", "id int, up int", {"up": ("t", "id")})]
    tables = {
        "a": rows(spark, [(1,)], "id int"), "b": rows(spark, [(1, 1), (2, 9), (3, None)], "id int, a_id int"), "c": rows(spark, [(1, 1), (2, 2), (3, 3), (4, 8)], "id int, b_id int"),
        "t": rows(spark, [(1, None), (2, 1), (3, 9), (4, 3), (5, 4)], "id int, up int"),
    }
    out = integrity.repaired(tables, specs)
    assert {n: sorted(r.id for r in df.collect()) for n, df in out.tables.items()} == {"a": [1], "b": [1, 3], "c": [1, 3], "t": [1, 2]}
    assert sorted(map(tuple, out.report.collect())) == [("a", 0, 0, 0), ("b", 1, 1, 0), ("c", 1, 2, 0), ("t", 1, 3, 0)]


def test_a_project_of_many_containers_is_folded_in_one_pass(spark):
    """100,000 containers of which few fit: copying the list at each of them took minutes."""
    import time

    c = spark.range(100_000).select(F.lit(1).alias("project"), F.lit(0).alias("core_rank"), F.col("id").alias("degree"), F.lit(1).alias("bytes"), F.format_string("n%06d", "id").alias("name"), F.col("id").cast("int").alias("id"), (F.col("id") % 7 + 1).alias("tokens"))
    began = time.time()
    (got,) = rules.resident(c, "project", F.lit(10)).collect()
    kept, used = [], 0
    for i in range(99_999, -1, -1):
        if used + i % 7 + 1 <= 10:
            used += i % 7 + 1
            kept.append(i)
    assert (got.tokens, got.kept) == (used, kept) and got.omitted == [f"n{i:06}" for i in range(100_000) if i not in kept]
    assert time.time() - began < 60


def test_interface_methods_of_few_owners(spark):
    """A long chain of contracts of which few own functions: only those are followed; pairs come once."""
    from auditweave.operators import code

    inherits = spark.createDataFrame([(k + 1, k) for k in range(1, 12)], "contract_id int, inherited_id int")
    owners = spark.createDataFrame([(k, k % 2 == 0) for k in range(1, 13)], "id int, concrete boolean")
    functions = spark.createDataFrame([(1, 1, "f"), (2, 2, "f"), (3, 4, "f"), (4, 4, "g"), (5, 2, "f"), (5, 4, "f"), (5, 4, "f")], "id int, owner_id int, name string")
    df = code.interface_methods(functions, inherits, owners)
    reach = {(a, b) for a in range(1, 13) for b in range(a, 13) if b > a or a % 2 == 0}
    own = {tuple(r) for r in functions.collect()}
    want = sorted({(f, g) for f, o, n in own for g, p, m in own if n == m and (o, p) in reach})
    assert sorted(map(tuple, df.collect())) == want
    # what is compared by a shuffle of all pairs are those of repeated ids only
    seen = graph.closure(inherits, "contract_id", "inherited_id", functions.select(functions.owner_id.alias("node")).distinct())
    assert {r.node for r in seen.collect()} == {2, 4}


def test_contexts_of_equal_room_are_packed_once(spark, monkeypatch):
    from auditweave.operators import link_plan

    real, asked = link_plan.greedy_batches, []

    def counted(df, *rest):
        asked.append(df.count())
        return real(df, *rest)

    monkeypatch.setattr(link_plan, "greedy_batches", counted)
    findings = spark.createDataFrame([(k, k, 3 + k % 4) for k in range(50)], "finding_id int, ord int, tokens int")
    made = spark.createDataFrame([(c, 20 if c % 3 else 9) for c in range(30)], "chunk int, finding_tokens long")
    got = {(r.chunk, r.finding_id): (r.batch, r.expected) for r in link_plan.batches(findings, made, link_plan.Budgets(1000)).collect()}
    assert asked == [100] and len(got) == 30 * 50
    for c in range(30):
        batch, used = 0, 0
        for k in range(50):
            if used and used + 3 + k % 4 > (20 if c % 3 else 9):
                batch, used = batch + 1, 0
            used += 3 + k % 4
            assert got[c, k] == (batch, 30)


def test_contexts_meet_findings_in_short_parts(spark, monkeypatch):
    """A finding's rows end with a part of the contexts and the next finding repeats the part, which files shrink to little; tasks follow the rows."""
    from auditweave.operators import link_plan

    monkeypatch.setattr(link_plan, "MADE", 50_000, raising=False)
    findings = spark.createDataFrame([(k, k, 3 + k % 4) for k in range(300)], "finding_id int, ord int, tokens int")
    made = spark.range(1000).selectExpr("CAST(id AS INT) AS chunk", "9L AS finding_tokens")
    out = link_plan.batches(findings, made, link_plan.Budgets(1000))
    assert out.distinct().count() == 300 * 1000 and out.rdd.getNumPartitions() == 6
    for task in out.rdd.glom().map(lambda rows: [(r.finding_id, r.chunk // 256) for r in rows]).collect():
        runs = task[:1] + [b for a, b in zip(task, task[1:]) if a != b]
        parts = [p for _, p in runs]
        assert len(runs) == len(set(runs)) and sum(a != b for a, b in zip(parts, parts[1:])) < 8 * 4
    assert link_plan.batches(findings.limit(0), made, link_plan.Budgets(1000)).count() == 0


def test_the_fan_out_of_links_is_not_shuffled(spark):
    from auditweave.operators import knowledge

    mk = spark.createDataFrame
    df = knowledge.link_fan_out(
        mk([(1, 2, "High", 1)], "extract_id int, historical_id int, strength string, ord int"), mk([(1, "e")], "id int, name string"), mk([(2, "n")], "id int, name string"),
        mk([(2, 5, "Low", "v", 1)], "semantic_node_id int, audit_finding_id int, strength string, evidence string, ord int"), mk([(5, "t")], "id int, title string"),
    )
    assert [tuple(r) for r in df.collect()] == [(5, 2, 1, "High", "e", "n", "Low", "t")]
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert "historical_id" in joins[0] and "finding_id" not in joins[0]
