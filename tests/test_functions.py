"""Text functions, formats and folds on the awkward cases."""

import pytest
from pyspark.sql import functions as F

from auditweave.functions import enums, text
from auditweave.operators import code, graph, integrity, keep, project, state
from auditweave.sources import formats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


@pytest.mark.parametrize(
    ("given", "want"),
    [("  SERVICES ", "Services"), ("real_world_assets", "Real World Assets"), ("nft-marketplace", "NFT Marketplace"), ("Sevices", None), ("", None)],
)
def test_project_category(spark, given, want):
    assert one(spark, enums.parse_project_category(F.lit(given))) == want


def test_strengths(spark):
    assert one(spark, enums.parse_strength(F.lit(" MED "))) == "Medium"
    assert one(spark, enums.parse_strength(F.lit("severe"))) is None


def test_render(spark):
    notes = F.array(F.lit(" a "), F.lit(" "), F.lit("bcdef"), F.lit("x"))
    assert one(spark, text.render_with_variants(F.lit(" base "), notes, 2, 3)) == "base\n— a\n— bcd …[truncated]\n— (+1 more folded raws not shown)"
    assert one(spark, text.render_with_variants(F.lit("base"), F.array(F.lit(" ")), 2)) == "base"


def test_truncate_counts_characters(spark):
    assert one(spark, text.truncate_text(F.lit(" é  ö\nü x "), 4)) == "é ö…"
    assert one(spark, text.truncate_text(F.lit("abc"), 3)) == "abc"


def test_bytes(spark):
    assert one(spark, text.head_bytes(F.lit("aéb"), 2)) == "a … [3 bytes truncated]"
    assert one(spark, text.head_bytes(F.lit("ab"), 2)) == "ab"
    assert one(spark, text.head_bytes(F.lit("é"), 1)) == " … [2 bytes truncated]"
    assert one(spark, text.tail_bytes(F.lit("é"), 1, note=False)) == ""


@pytest.mark.parametrize("at", [1, 4])
def test_places_within_characters_and_past_the_end_raise(spark, at):
    with pytest.raises(Exception, match="not a place in the text"):
        one(spark, text.line_column(F.lit("éx"), F.lit(at)))


def test_evidence(spark):
    floors = {"High": 40, "Medium": 40, "Low": 15}
    body = F.lit("The vault lets anyone withdraw  shares twice in one block.")
    good = F.lit('It says “lets anyone withdraw shares twice” and that is the cause')
    assert one(spark, text.evidence_ok(good, F.lit("High"), body, floors))
    assert not one(spark, text.evidence_ok(F.lit("x" * 50), F.lit("High"), body, floors))
    assert one(spark, text.evidence_ok(F.lit("x" * 50), F.lit("Medium"), body, floors))


def test_globs(spark):
    for path, want in [("lib/a.sol", True), ("x/lib/a.sol", True), ("library/a.sol", False), ("target/a", True), ("x/target/a", False), ("src/vendor/a", True), ("src/a.sol", False)]:
        assert one(spark, text.is_vendored(F.lit(path))) == want, path
    assert not one(spark, text.is_vendored(F.lit("lib/a.sol"), include_lib=True))
    assert len(text.vendored_globs()) == 42


def test_lcov(spark):
    lines = "DA:1,5\nSF:a.sol\nDA:3,2\nDA:4,0\nDA:x,1\nDA:5,-1\nend_of_record\nDA:9,9\nSF:b.sol\nDA:7,1"
    odd = "SF: c.sol\t\r\nDA: 1 , 3 ,x\r\n  SF:no\nDA:2,3x\nDA:3\nDA:99999999999,1\n end_of_record\nDA:4,1\nend_of_record  \nDA:5,1\nSF:d\nSF:e\nDA:+6,1"
    df = spark.createDataFrame([(1, lines)], "id int, text string")
    others = spark.createDataFrame([(2, odd), (3, None), (4, ""), (5, "SF:x")], "id int, text string")
    assert sorted(tuple(r) for r in formats.lcov_lines(others).collect()) == [(2, "c.sol", 1, 3), (2, "c.sol", 4, 1), (2, "e", 6, 1)]
    assert {(r.path, r.line_number, r.hit_count) for r in formats.lcov_lines(df).collect()} == {("a.sol", 3, 2), ("b.sol", 7, 1)}


def test_sequence_json(spark):
    js = '{"counterexample":{"Sequence":[2,[{"contract_name":"A","function_name":"f","x":1},{"contract_name":"B","function_name":"g"}]]}}'
    df = spark.createDataFrame([(1, js), (2, "compile error")], "id int, text string")
    assert [(r.contract_name, r.function_name) for r in formats.counterexample_calls(df).orderBy("pos").collect()] == [("A", "f"), ("B", "g")]
    assert formats.run_summary(df).count() == 0


def test_snapshot_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "it's", None)], "id int, name string, note string")
    formats.export_tables({"t": df}, str(tmp_path))
    assert formats.import_tables(spark, {"t": df.schema}, str(tmp_path))["t"].collect() == df.collect()
    assert formats.insert_statements(df, "t").head().statement == "INSERT INTO \"t\" (\"id\", \"name\", \"note\") VALUES (1, 'it''s', NULL);"


@pytest.mark.parametrize(
    ("tokens", "budget", "most", "sizes"),
    [([40, 20, 50], 60, 99, [2, 1]), ([120, 30], 100, 99, [1, 1]), ([10] * 5, 999, 2, [2, 2, 1]), ([], 10, 2, [])],
)
def test_greedy_batches(spark, tokens, budget, most, sizes):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(tokens)], "g int, i int, t int")
    got = keep.greedy_batches(df, ["g"], "i", "t", budget, most).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == sizes


def test_resolve_cycles(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 5, 7, 11, 13, 25, 40, 41, 42, 9)], "id int")
    edges = spark.createDataFrame([(25, 5), (5, 1), (7, 11), (11, 7), (13, 999), (40, 41), (41, 42), (42, 41), (9, 9)], "from_id int, to_id int")
    got = {r.node: r.canonical for r in graph.resolve(nodes, edges).collect()}
    assert got == {1: 1, 5: 1, 25: 1, 7: 7, 11: 11, 13: 999, 40: 41, 41: 41, 42: 42, 9: 9}
    assert {r.node: r.canonical for r in graph.resolve(nodes, edges, nodes).collect()}[13] == 13


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "c int, p int")
    got = {(r.node, r.ancestor) for r in graph.closure(edges, "c", "p").collect()}
    assert got == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3)}


def test_coverage_gate(spark):
    f = spark.createDataFrame([(1, "contracts/Pool.sol", 30, 50)], "id int, path string, start_line int, end_line int")
    for line, share in ((35, 1.0), (51, 0.0)):
        c = spark.createDataFrame([("contracts/Pool.sol", line)], "path string, line_number int")
        assert project.fidelity(project.covered_functions(f, c), "path").head().fidelity == share


def test_runtime_gate(spark):
    runs = spark.createDataFrame([(1, 10, 1, "setUp()"), (2, 1000, 990, "x"), (3, 1000, 50, "x"), (4, 0, 0, "x")], "id int, calls long, reverts long, reason string")
    assert {r.id: r.gate for r in integrity.runtime_gate(runs).collect()} == {1: "Fail", 2: "Fail", 3: "Pass", 4: "Pass"}


def test_gate_refuses(spark):
    with pytest.raises(ValueError):
        integrity.gate(spark.range(1))
    integrity.gate(spark.range(1), force=True)
    integrity.gate(spark.range(0))


def test_put_and_overlap(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, o int")
    assert {(r.k, r.v) for r in state.put(s, new, ["k"], "o").collect()} == {(1, "a"), (2, "y"), (3, "z")}
    kind = "array<struct<contract:string,function:string>>"
    rows = spark.createDataFrame([([("A", "f")], [("A", "f")]), ([("B", "f")], [("A", "f")]), ([("B", "g")], [("A", "f")]), ([], [("A", "f")])], f"a {kind}, b {kind}")
    assert [r.x for r in rows.select(code.sequence_overlap(F.col("a"), F.col("b")).alias("x")).collect()] == ["pair", "function", "disjoint", None]


def test_scope_and_specs():
    assert formats.scope_globs(["# c", "src/", "./a.sol", "", "/lib"]) == ["src/**", "a.sol", "lib/**"]
    assert formats.project_spec("n:p:x-1") == ("n", "p", "x-1") and formats.snapshot_format("a.JSON") == "json"
    with pytest.raises(ValueError):
        formats.snapshot_format("a")
