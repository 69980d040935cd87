"""Writing finished projects: what must raise, and rows that awkward input gives."""

import pytest
from pyspark.sql import functions as F

from auditweave.operators import learning


def base(spark):
    mk = spark.createDataFrame
    return {
        "project": mk([(1, "a", "pending"), (2, "b", "completed")], "id int, name string, status string"),
        "project_platform": mk([(2, "p2")], "project_id int, platform_id string"),
        "project_category": mk([(2, "DEX")], "project_id int, category string"),
        "category": mk([(7,)], "id int"),
        "semantic_node": mk([(10, "n", "d", "old", "DEX")], "id int, name string, definition string, description string, category string"),
        "semantic_function": mk([], "semantic_node_id int, function_name string, contract_path string"),
        "semantic_merge": mk([], "from_id int, to_id int"),
        "project_semantic": mk([(2, 10)], "project_id int, semantic_node_id int"),
        "audit_finding": mk([(5, "t", "High", "r", "old")], "id int, title string, severity string, root_cause string, description string"),
        "finding_taxonomy": mk([], "audit_finding_id int, category_id int"),
        "finding_merge": mk([], "from_id int, to_id int"),
        "project_finding": mk([], "project_id int, audit_finding_id int"),
        "semantic_finding_link": mk([], "semantic_node_id int, audit_finding_id int, strength string, evidence string"),
    }


def learned(spark, projects, semantics=(), findings=(), links=(), categories=()):
    mk = spark.createDataFrame
    return learning.Learned(
        mk(list(projects), "ord int, name string, platform_id string"),
        mk(list(categories), "ord int, category string"),
        mk([(o, i, f"s{i}", "d", f"text {i}", "DEX", [("f", "c")], t, u) for o, i, t, u in semantics], "ord int, idx int, name string, definition string, description string, category string, functions array<struct<name:string,contract:string>>, targets array<int>, new_description string"),
        mk([(o, i, f"f{i}", "Low", "r", f"text {i}", c, t, u) for o, i, c, t, u in findings], "ord int, idx int, title string, severity string, root_cause string, description string, category_id int, targets array<int>, new_description string"),
        mk(list(links), "ord int, finding_idx int, semantic_idx int"),
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rows_of_a_batch(spark):
    b = base(spark)
    change = learning.write_projects(b, learned(
        spark, [(1, "a", None), (2, "a", "p9"), (3, "zzz", "p2"), (4, "a", "p9")],
        semantics=[(1, 0, [], None), (1, 1, [10], "  "), (3, 0, [10], " new "), (2, 0, [10, 10], "late? no")],
        findings=[(1, 0, 7, [5], "told"), (3, 0, 7, [], None)],
        links=[(1, 0, 1), (1, 0, 1), (3, 0, 0)], categories=[(1, "DEX"), (2, "nobody has it"), (3, "DEX")],
    ))
    # a platform that isn't known makes a new project, whatever the name; two rows of it make one
    assert rows(change.replace["project"]) == [(1, "a", "completed"), (2, "b", "completed"), (3, "a", "completed")]
    assert rows(change.append["project_platform"]) == [(3, "p9")]
    assert rows(change.append["project_category"]) == [(1, "DEX")]
    nodes = {r.id: r for r in change.replace["semantic_node"].collect()}
    assert sorted(nodes) == [10, 11, 12, 13, 14] and nodes[10].description == "new" and nodes[10].name == "n"  # the last in order tells
    assert rows(change.append["semantic_merge"]) == [(12, 10), (13, 10), (14, 10)]
    assert rows(change.append["project_semantic"]) == [(1, 10), (1, 11), (1, 12), (2, 14), (3, 10), (3, 13)]
    assert {r.id: r.description for r in change.replace["audit_finding"].collect()} == {5: "told", 6: "text 0", 7: "text 0"}
    assert rows(change.append["project_finding"]) == [(1, 5), (1, 6), (2, 7)]
    assert [r[:3] for r in rows(change.append["semantic_finding_link"])] == [(12, 6, "High"), (14, 7, "High")]
    assert rows(change.append["finding_taxonomy"]) == [(6, 7), (7, 7)] and len(rows(change.append["semantic_function"])) == 4
    assert rows(change.new_semantics) == [(11,)]


def test_nothing_learned(spark):
    change = learning.write_projects(base(spark), learned(spark, []))
    assert all(df.count() == base(spark)[n].count() for n, df in change.replace.items()) and all(df.count() == 0 for df in change.append.values())


@pytest.mark.parametrize(("more", "what"), [
    ({"semantics": [(1, 0, [99], None)]}, "folds into none"), ({"findings": [(1, 0, 7, [99], None)]}, "folds into none"),
    ({"findings": [(1, 0, 8, [], None)]}, "taxonomy"), ({"findings": [(1, 0, 7, [], None)], "links": [(1, 0, 3)]}, "no such end"),
])
def test_what_must_raise(spark, more, what):
    with pytest.raises(ValueError, match=what):
        learning.write_projects(base(spark), learned(spark, [(1, "a", None)], **more))


def test_a_failed_batch_leaves_the_store(spark, tmp_path):
    from auditweave.sources.versions import Store

    store = Store(spark, f"file://{tmp_path}/s")
    held = store.commit(store.snapshot(), replace=base(spark))
    good = learning.write_projects(dict(held), learned(spark, [(1, "a", None)], semantics=[(1, 0, [], None)]))
    bad = good.append | {"semantic_merge": spark.range(5).select(F.raise_error(F.lit("dies")).cast("int").alias("from_id"), F.lit(1).alias("to_id"))}
    with pytest.raises(Exception, match="dies"):
        store.commit(held, good.replace, bad)
    assert store.snapshot().version == 1 and store.snapshot()["semantic_node"].count() == 1
    assert store.commit(held, good.replace, good.append).rows["semantic_node"] == 2


INCOMING = (
    "src_id int, name string, definition string, description string, category string, functions array<struct<name:string,contract:string>>, targets array<int>, new_description string, projects array<int>",
    "src_id int, title string, severity string, root_cause string, description string, category_id int, targets array<int>, new_description string, projects array<int>",
    "src_semantic_id int, src_finding_id int, strength string, evidence string, ord int",
)


def imported(spark, semantics=(), findings=(), links=(), **more):
    from auditweave.operators import importing

    tables = base(spark) | {"pending_semantic": spark.createDataFrame([], "semantic_node_id int"), "finding_link_status": spark.createDataFrame([], "audit_finding_id int"),
                            "merge_status": spark.createDataFrame([(3, "x", "link")], "id int, source_key string, phase string")} | more
    s = [(i, f"s{i}", "d", "t", "DEX", [("f", "c")], t, u, p) for i, t, u, p in semantics]
    f = [(i, f"f{i}", "Low", "r", "t", c, t, None, p) for i, c, t, p in findings]
    return importing.import_canonicals(tables, importing.Incoming(*[spark.createDataFrame(list(x), k) for x, k in zip((s, f, links), INCOMING)]), "other")


def test_canonicals_of_another_graph(spark):
    # 10 is folded into 8 already, so what folds into 10 has its links carried to 8
    more = {"semantic_node": spark.createDataFrame([(8, "m", "d", "o", "DEX"), (10, "n", "d", "old", "DEX")], "id int, name string, definition string, description string, category string"),
            "semantic_merge": spark.createDataFrame([(10, 8)], "from_id int, to_id int"), "semantic_finding_link": spark.createDataFrame([(8, 6, "Low", "there")], "semantic_node_id int, audit_finding_id int, strength string, evidence string")}
    out = imported(
        spark, semantics=[(1, [10], " new ", [2]), (2, [], None, [1, 2])], findings=[(7, 7, [], [1]), (9, 7, [5], [1, 1])],
        links=[(1, 9, "Low", "first", 1), (1, 9, "High", "second", 2), (1, 7, "High", "is there", 3), (2, 9, "High", "own", 4), (2, 99, "High", "gone", 5)], **more,
    )
    assert rows(out.semantic_ids) == [(1, 11), (2, 12)] and rows(out.finding_ids) == [(7, 6), (9, 7)]
    assert rows(out.append["semantic_merge"]) == [(11, 10)] and rows(out.append["finding_merge"]) == [(7, 5)]
    assert rows(out.append["semantic_finding_link"]) == [(12, 5, "High", "own"), (8, 5, "Low", "first")]
    assert rows(out.append["pending_semantic"]) == [(12,)] and rows(out.append["finding_link_status"]) == [(7,)]
    assert rows(out.append["project_semantic"]) == [(1, 12), (2, 11), (2, 12)] and rows(out.append["project_finding"]) == [(1, 5), (1, 6), (1, 7)]
    assert rows(out.append["merge_status"]) == [(4, "other", "imported")]
    assert {r.id: r.description for r in out.replace["semantic_node"].collect()} == {8: "o", 10: "new", 11: "t", 12: "t"}


@pytest.mark.parametrize(("more", "what"), [({"semantics": [(1, [99], None, [])]}, "folds into none"), ({"findings": [(1, 8, [], [])]}, "taxonomy")])
def test_imports_that_must_raise(spark, more, what):
    with pytest.raises(ValueError, match=what):
        imported(spark, **more)


def test_joins_are_broadcast_by_measured_size_only(spark, tmp_path, monkeypatch):
    """Many ids in a small file would be a large table in the driver."""
    from auditweave.operators import importing
    from auditweave.sources.versions import Store

    seen, threshold = [], "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold, None)

    def noted(real):
        return lambda *a: (seen.append(spark.conf.get(threshold, None)), real(*a))[1]

    for module in (learning, importing):
        monkeypatch.setattr(module, "cut", noted(module.cut))
    b = base(spark)
    learning.write_projects(b, learned(spark, [(1, "a", None)]))
    imported(spark, semantics=[(1, [], None, [])])
    assert len(seen) >= 4 and set(seen) == {"-1"}
    assert spark.conf.get(threshold, None) == before
    # the store plans what it writes in the same way
    spark.range(100_000).write.parquet(str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids"))
    store = Store(spark, f"file://{tmp_path}/store")
    monkeypatch.setattr(type(ids.write), "parquet", noted(type(ids.write).parquet))
    seen.clear()
    assert store.commit(store.snapshot(), replace={"t": ids}).rows == {"t": 100_000} and set(seen) == {"-1"}
