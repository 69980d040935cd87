"""Rules and text functions on cases that the driver's tables don't hold, against stated rows."""

import pytest
from pyspark.sql import functions as F

from auditweave.functions import text as t
from auditweave.operators import rules

from .test_plans import plain

#: Small tables that both engines read as they are.
FIXTURES = {
    "history": """(VALUES (1, 'import', '{"a": 1, "b": [1, 2]}'), (2, 'link', '{"a": 1}'), (3, 'merge', 'null')) AS t(id, type, args)""",
    "operations": """(VALUES (1, 'import', '{"b":[1,2],"a":1}', true), (2, 'import', '{"b":[2,1],"a":1}', false), (3, 'import', '{"a":1, "b": [2, 1]}', true), (4, 'merge', '{"a":1}', false), (5, 'link', ' {"a" : 1} ', true), (6, 'merge', 'null', true)) AS t(ord, type, args, known)""",
    "places": "(VALUES (1, 1, 0, 3, 1), (2, 2, 4, 2, 1), (3, 0, 0, 1, 0), (4, 5, 0, 4, 9), (5, 7, 3, 7, 3), (5, 8, 0, 9, 0)) AS t(id, start_line, start_column, end_line, end_column)",
    "held": "(VALUES (1, 1, 1, 2), (2, 1, 2, 3), (3, 2, 2, 99), (3, 4, 4, 1), (4, 5, 5, NULL)) AS t(id, holder_id, from_id, to_id)",
    "core": "(VALUES (0, 'Vault', './src/Vault.sol'), (1, 'Pool', ''), (2, 'Router', 'src/R.sol'), (3, 'Vault', 'src/other/Vault.sol')) AS t(pos, name, path)",
    "parts": "(VALUES (1, 'Vault', 'src/Vault.sol'), (2, 'Vault', 'src/Copy.sol'), (3, 'Pool', 'src/Pool.sol'), (4, 'Router', 'lib/R.sol'), (5, 'Other', 'src/R.sol'), (6, 'None', 'src/N.sol')) AS t(id, name, path)",
    "asked": "(VALUES (1, 1, NULL), (1, 2, NULL), (2, 1, 7), (2, 2, 7), (3, 1, 7), (3, 2, 9), (4, 1, NULL), (4, 2, 5)) AS t(item, chunk, target)",
    "titles": "(VALUES (1, 'Fee On Transfer'), (2, '  --  '), (3, 'Ünïcode tokens & 1,000 more'), (4, 'A very long title that goes on and on, far past forty-eight characters'), (5, ''), (6, 'forty-seven characters and then a dash come h - x')) AS t(id, title)",
    "labels_in": "(VALUES (1, 'aa bb cc dd'), (2, '  '), (3, 'toolongword x'), (4, 'é é é'), (5, NULL), (6, ' a  b\\nc ')) AS t(id, text)",
    "offsets": "(VALUES (1, 'abc\\ndef\\nghi', 4), (2, 'abc\\ndef\\nghi', 8), (3, 'abc\\ndef\\nghi', 6), (4, 'abc\\ndef\\nghi', 11), (5, 'é\\nx', 2), (6, 'é\\nx', 3), (7, '', 0)) AS t(id, text, at)",
    "cuts": "(VALUES (1, 'abcde'), (2, 'abcdé'), (3, 'éabcd'), (4, '𝄞𝄞'), (5, ''), (6, NULL), (7, 'abcd��')) AS t(id, text)",
    "names": "(VALUES (1, 'DeFi Lending / v2'), (2, '  '), (3, 'Ünï-x'), (4, '__A__b__'), (5, ''), (6, NULL)) AS t(id, name)",
    "long_labels": "(VALUES (1, 'a\\r\\nb\\n'), (2, 'a\\n\\nb'), (3, repeat('é', 121)), (4, repeat('é', 120)), (5, ''), (6, 'a\\n\\n')) AS t(id, text)",
    "tests": "(VALUES (1, 1, 'Failure', 'setUp()', NULL), (2, 1, 'Failure', 'testA', 'FAILED to Set Up: x'), (3, 1, 'Success', 'setUp()', 'failed to set up'), (4, 2, 'Failure', 'testB', ''), (5, 2, 'Failure', 'testC', 'overflow'), (6, 2, 'Failure', 'testD', 'later'), (7, 3, NULL, 'setUp()', NULL)) AS t(id, run, status, test, reason)",
    "kinds": """(VALUES (1, '{"Invariant": {"runs": 3, "calls": 40, "reverts": 5}}'), (2, '{"Invariant": {"runs": 3}}'), (3, '{"Unit": {"gas": 9}}'), (4, '{"Invariant": {"runs": "3"}}'), (5, '{"Invariant": 7}'), (6, 'not JSON'), (7, NULL)) AS t(id, kind)""",
    "rendered": "(VALUES (1, 'told', 'raw 1'), (2, ' ', 'raw 2'), (3, NULL, 'raw 3'), (4, '', NULL)) AS t(id, rendered, raw)",
}


def fx(r, name: str):
    return r.spark.sql(f"SELECT * FROM {FIXTURES[name]}")


def _in(name: str) -> str:
    return f"(SELECT * FROM {FIXTURES[name]})"


class Session:
    def __init__(self, spark):
        self.spark = spark


CASES = {
    "j15_rendered_or_raw": (
        lambda r: fx(r, "rendered").select("id", F.coalesce(rules.rendered_or_raw(F.col("rendered"), F.col("raw")), F.lit("none")).alias("text")),
        "SELECT * FROM (VALUES (1, 'told'), (2, 'raw 2'), (3, 'raw 3'), (4, 'none')) AS t(id, text)",
    ),
    "u14_json_operations": (
        lambda r: rules.record_operations(fx(r, "history"), fx(r, "operations")).select("id", "type", "args"),
        f"""SELECT id, type, args FROM {_in("history")} UNION ALL SELECT 3 + row_number() OVER (ORDER BY ord), type, args FROM {_in("operations")} WHERE NOT known""",
    ),
    "g12_call_graph_problems": (
        lambda r: rules.call_graph_problems(fx(r, "places"), fx(r, "held")),
        "SELECT * FROM (VALUES ('repeated function', 5), ('repeated call', 3), ('held elsewhere', 2), ('missing target', 3), ('missing target', 4), ('bad place', 2), ('bad place', 3), ('bad place', 4)) AS t(problem, id)",
    ),
    "y03_core_ranks": (
        lambda r: rules.core_ranks(fx(r, "parts"), fx(r, "core")).select("id", "core_rank"),
        "SELECT * FROM (VALUES (1, 0), (2, 0), (3, 1), (4, 2), (5, 2), (6, 2147483647)) AS t(id, core_rank)",
    ),
    "y05_slugs": (
        lambda r: fx(r, "titles").select("id", rules.slug(F.col("title")).alias("slug")),
        "SELECT * FROM (VALUES (1, 'fee-on-transfer'), (2, 'project'), (3, 'n-code-tokens-1-000-more'), (4, 'a-very-long-title-that-goes-on-and-on-far-past-f'), (5, 'project'), (6, 'forty-seven-characters-and-then-a-dash-come-h-x')) AS t(id, slug)",
    ),
    "y14_merge_choices": (
        lambda r: rules.merge_choices(fx(r, "asked")).select("item", "choice", F.concat_ws(",", F.transform("targets", lambda x: x.cast("string"))).alias("targets")),
        "SELECT * FROM (VALUES (1, 'new', ''), (2, 'merge', '7'), (3, 'ask again', '7,9'), (4, 'merge', '5')) AS t(item, choice, targets)",
    ),
    "x20_wrapped_labels": (
        lambda r: fx(r, "labels_in").select("id", t.wrap_label(F.col("text"), 5).alias("label")),
        r"SELECT * FROM (VALUES (1, E'aa bb\ncc dd'), (2, '  '), (3, E'toolongword\nx'), (4, E'é é\né'), (5, NULL), (6, 'a b c')) AS t(id, label)",
    ),
    "x21_identifiers": (
        lambda r: fx(r, "names").select("id", t.dot_identifier(F.col("name")).alias("name")),
        "SELECT * FROM (VALUES (1, 'defi_lending_v2'), (2, 'cluster'), (3, 'n_x'), (4, 'a_b'), (5, 'cluster'), (6, NULL)) AS t(id, name)",
    ),
    "x21_short_labels": (
        lambda r: fx(r, "long_labels").select("id", t.short_label(F.col("text")).alias("label")),
        "SELECT * FROM (VALUES (1, 'a b'), (2, 'a  b'), (3, concat(repeat('é', 117), '...')), (4, repeat('é', 120)), (5, ''), (6, 'a ')) AS t(id, label)",
    ),
    "x24_line_columns": (
        lambda r: fx(r, "offsets").select("id", t.line_column(F.col("text"), F.col("at")).alias("p")).select("id", "p.line", "p.column"),
        'SELECT * FROM (VALUES (1, 2, 0), (2, 3, 0), (3, 2, 2), (4, 3, 3), (5, 1, 1), (6, 2, 0), (7, 1, 0)) AS t(id, line, "column")',
    ),
    "x25_byte_cuts": (
        lambda r: fx(r, "cuts").select("id", t.head_bytes(F.col("text"), 5).alias("head"), t.tail_bytes(F.col("text"), 5).alias("tail"), t.tail_bytes(F.col("text"), 5, note=False).alias("bare")),
        r"""SELECT * FROM (VALUES (1, 'abcde', 'abcde', 'abcde'), (2, 'abcd … [2 bytes truncated]', E'…[1 bytes earlier]\nbcdé', 'bcdé'),
        (3, 'éabc … [1 bytes truncated]', E'…[1 bytes earlier]\nabcd', 'abcd'), (4, '𝄞 … [4 bytes truncated]', E'…[3 bytes earlier]\n𝄞', '𝄞'), (5, '', '', ''), (6, NULL, NULL, NULL),
        (7, 'abcd … [6 bytes truncated]', E'…[5 bytes earlier]\n�', '�')) AS t(id, head, tail, bare)""",
    ),
    "x34_setup_failures": (
        lambda r: fx(r, "tests").select("id", t.setup_failed(F.col("status"), F.col("test"), F.col("reason")).alias("failed")),
        "SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, false), (5, false), (6, false), (7, false)) AS t(id, failed)",
    ),
    "x34_first_reasons": (
        lambda r: fx(r, "tests").groupBy("run").agg(F.min_by("reason", F.when((F.col("status") == "Failure") & (F.col("reason") != ""), F.col("id"))).alias("reason")),
        "SELECT * FROM (VALUES (1, 'FAILED to Set Up: x'), (2, 'overflow'), (3, NULL)) AS t(run, reason)",
    ),
    "x35_invariant_stats": (
        lambda r: fx(r, "kinds").select("id", t.invariant_stats(F.col("kind")).alias("s")).select("id", "s.runs", "s.calls", "s.reverts"),
        "SELECT * FROM (VALUES (1, 3, 40, 5), (2, 3, 0, 0), (3, NULL, NULL, NULL), (4, NULL, NULL, NULL), (5, NULL, NULL, NULL), (6, NULL, NULL, NULL), (7, NULL, NULL, NULL)) AS t(id, runs, calls, reverts)",
    ),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    import duckdb

    make, sql = CASES[name]
    df = make(Session(spark))
    columns = sorted(df.columns)
    want = duckdb.sql(sql)
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain([[r[k] for k in order] for r in want.fetchall()])


def test_artifacts_of_large_ids(spark, tmp_path):
    """Ids whose product with the query's factor is beyond 32 bits."""
    from __spark_entry__ import queries

    spark.createDataFrame([(1_200_000 + k,) for k in range(120)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.file_id: (r.mtime, r.path) for r in queries()["s22_newest_artifacts"](spark, str(tmp_path)).collect()}
    assert len(got) == 60
    for k in range(60):
        newest = max((1_200_000 + k, 1_200_060 + k), key=lambda i: (i * 7919 % 101, -i))
        assert got[k][0] == newest * 7919 % 101 and f"F{newest}.sol" in got[k][1]


def test_byte_cuts_of_every_document(spark, tmp_path):
    """Null texts too, and all three cuts."""
    import hashlib

    from __spark_entry__ import queries

    texts = {1: None, 2: "", 3: "é" * 150, 4: "a" + "é" * 200, 5: "x" * 301, 6: "𝄞" * 100 + "ab"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in queries()["x25_byte_cuts"](spark, str(tmp_path)).collect()}
    for i, text in texts.items():
        data = text.encode() if text is not None else b""
        head, tail = data[:300].decode(errors="ignore"), data[-300:].decode(errors="ignore")
        told = (f"{head} … [{len(data) - len(head.encode())} bytes truncated]", f"…[{len(data) - 300} bytes earlier]\n{tail}", tail) if len(data) > 300 else (text,) * 3
        assert got[i] == tuple(x if x is None else hashlib.md5(x.encode()).hexdigest() for x in told)
