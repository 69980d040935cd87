"""SQL scripts, snapshots and versions: round trips, awkward text, failures that change nothing."""

import random

import pytest

from auditweave.sources import snapshots as sn
from auditweave.sources import sql_scripts as sq
from auditweave.sources.versions import Conflict, Store, cleared, clobber_into


def plain_split(script):
    """Statements by a loop over characters."""
    out, now, i, quote = [], "", 0, ""
    while i < len(script):
        c, after = script[i], script[i + 1 : i + 2]
        if quote:
            now += c
            if c == "\\" and quote != "`":
                now += after
                i += 1
            elif c == quote and after == quote:
                now += c
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote, now = c, now + c
        elif c == ";":
            out.append(now.strip())
            now = ""
        elif c == "#" or (c == "-" and after == "-" and (script[i + 2 : i + 3] in (" ", "\t", "\r", "\n", ""))):
            end = script.find("\n", i)
            i = len(script) if end < 0 else end
            now += "\n" if end >= 0 else ""
        elif c == "/" and after == "*":
            end = script.find("*/", i + 2)
            now += " " if end >= 0 else ""
            i = len(script) if end < 0 else end + 1
        else:
            now += c
        i += 1
    return [s for s in [*out, now.strip()] if s]


KNOWN = r"""
-- header; of a snapshot
CREATE TABLE "demo" ("value" TEXT);
INSERT INTO "demo" ("value") VALUES ('semi;colon');
/* block; comment */
INSERT INTO "demo" ("value") VALUES ('quote '' inside');
INSERT INTO `demo` (`value`) VALUES ('backslash \' quote');
"""


def scripts():
    r = random.Random(5)
    parts = ["'", '"', "`", "\\", ";", "-", "--", "-- ", "---", "#", "/*", "*/", "/", "*", "\n", "\r\n", " ", "a", "é", "日", "''", "x;y", "\t"]
    return [KNOWN, "", ";;", "a", "--", "a--", "a-- b", "a/**/b;c", "'abc\\", "/*/ x */ y", *["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(300)]]


def test_statements_by_stretches():
    for k, script in enumerate(scripts()):
        data, state = script.encode(), 0
        for cut in (0, 1 if k < 20 else 17):
            state, out, now = 0, [], b""
            step = cut or max(1, len(data))
            for k in range(0, len(data), step):
                part = data[k : k + step]
                at, last = sq.ends(part, state), 0
                for e in at.tolist():
                    out.append(now + part[last:e])
                    now, last = b"", e + 1
                now += part[last:]
                state = sq.table_of(part)[state]
            got = [s for s in (sq.without_comments(x.decode("utf-8", "replace"), k < len(out)) for k, x in enumerate([*out, now])) if s]
            assert got == plain_split(script), (script, cut)


@pytest.mark.parametrize("piece", [40, 1 << 20])
def test_statements_of_files(spark, tmp_path, piece):
    whole = [s for s in scripts() if s]
    for k, s in enumerate(whole[:40]):
        (tmp_path / f"{k:03}.sql").write_bytes(s.encode())
    # one long script in which quotes and comments span lines and splits
    long = "".join(f"INSERT INTO t VALUES ({k}, 'line {k};\n -- no comment\n it''s', \"a;b\"); /* {k};\n */ -- end; {k}\n" for k in range(800))
    (tmp_path / "long.sql").write_text(long)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    try:
        rows = sq.statements(spark, str(tmp_path), piece).orderBy("file", "number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for k, s in enumerate(whole[:40]):
        assert [r.statement for r in rows if r.file.endswith(f"/{k:03}.sql")] == plain_split(s), s
    assert [r.statement for r in rows if r.file.endswith("/long.sql")] == plain_split(long)


def test_values():
    p = lambda s, d="sqlite": list(sq.parsed(s, d))
    assert p("INSERT INTO \"a\"\"b\" (x, `y`) VALUES (1, 'it''s; (1, 2)'), (NULL, X'00ff')") == [("insert", 'a"b', ["x", "y"], ["1", "it's; (1, 2)"]), ("insert", 'a"b', ["x", "y"], [None, "00ff"])]
    assert p("insert into t (a, b, c) values (-1.5e3, CAST(X'615C27' AS TEXT), 'NULL')") == [("insert", "t", ["a", "b", "c"], ["-1.5e3", "a\\'", "NULL"])]
    assert p(r"INSERT INTO t (a, b) VALUES ('a\'b\\c\n\0', 0x00FF)", "mysql") == [("insert", "t", ["a", "b"], ["a'b\\c\n\0", "00FF"])]
    assert p("DROP TABLE IF EXISTS `t`")[0][:2] == ("drop", "t") and p("CREATE TABLE \"t\" (x TEXT)")[0][:2] == ("create", "t")
    assert p("DELETE FROM t")[0][0] == "other"
    for bad in ("INSERT INTO t (a) VALUES (1, 2)", "INSERT INTO t (a) VALUES (f(1))", "INSERT INTO t (a) VALUES (1) RETURNING a"):
        with pytest.raises(ValueError):
            p(bad)


SPECS = [
    sn.Table("child", "id int, parent_id int, note string", {"parent_id": ("parent", "id")}),
    sn.Table("parent", "id int not null, name string, ok boolean, share double, raw binary, big bigint"),
    sn.Table("edge", "a int, b int", {"a": ("child", "id"), "b": ("child", "id")}),
]
TEXTS = ["plain", None, "", "it's; -- x", "a\\", "\\'; DROP", "line\nbreak\r\n;", "é日本🙂", "/* */ #", "'", "\"`", "\t", "NULL", "\x00z"]


def tables(spark):
    parents = [(k, t, [True, False, None][k % 3], [0.1, None, -1e300, float("inf")][k % 4] if k % 4 != 3 else 2.5, None if k % 2 else bytes([k, 0, 255]) * (k % 3), (1 << 62) * (k % 2)) for k, t in enumerate(TEXTS)]
    return {
        "parent": spark.createDataFrame(parents, "id int, name string, ok boolean, share double, raw binary, big bigint"),
        "child": spark.createDataFrame([(k, k % 14 if k % 5 else None, TEXTS[-k % 14]) for k in range(60)], "id int, parent_id int, note string").repartition(3),
        "edge": spark.createDataFrame([], "a int, b int"),
    }


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_order_of_tables():
    assert [t.name for t in sn.ordered(SPECS)] == ["parent", "child", "edge"]
    with pytest.raises(ValueError, match="circle"):
        sn.ordered([sn.Table("a", "x int", {"x": ("b", "x")}), sn.Table("b", "x int", {"x": ("a", "x")})])


@pytest.mark.parametrize("dialect", ["sqlite", "mysql"])
def test_sql_snapshot_restores(spark, tmp_path, dialect):
    own = tables(spark)
    sn.export_sql(own, SPECS, str(tmp_path), dialect)
    got = sn.import_sql(spark, SPECS, str(tmp_path), dialect)
    assert set(got.tables) == set(own)
    for name, df in own.items():
        assert got.tables[name].schema.simpleString() == df.schema.simpleString() and rows(got.tables[name]) == rows(df), name
    done = {(r.kind, r.table): r["count"] for r in got.done.groupBy("kind", "table").count().collect()}
    assert done == {(k, t): 1 for k in ("drop", "create") for t in own} | {("insert", "parent"): 14, ("insert", "child"): 60}


def test_sqlite_reads_the_script(spark, tmp_path):
    import sqlite3

    own = tables(spark)
    sn.export_sql(own, SPECS, str(tmp_path))
    con = sqlite3.connect(":memory:")
    for f in sorted(tmp_path.glob("*/part-*")):
        con.executescript(f.read_bytes().decode().replace("\x00", "\\0"))
    assert [r[0] for r in con.execute("SELECT name FROM parent ORDER BY id")][:13] == TEXTS[:13]


def test_bad_scripts_raise(spark, tmp_path):
    for k, (script, what) in enumerate([("DELETE FROM parent;", "known table"), ("CREATE TABLE other (x INT);", "known table"), ("INSERT INTO edge (a, b) VALUES (1, 2);", "aren't created"), ("CREATE TABLE edge (a INT); INSERT INTO edge (a, c) VALUES (1, 2);", "doesn't have")]):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "s.sql").write_text(script)
        with pytest.raises(ValueError, match=what):
            sn.import_sql(spark, SPECS, str(tmp_path / str(k)))


def test_json_snapshot_restores(spark, tmp_path):
    own = tables(spark)
    sn.export_json(own, SPECS, str(tmp_path))
    for name, df in sn.import_json(spark, SPECS, str(tmp_path)).items():
        assert rows(df) == rows(own[name]), name


def test_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.snapshot().version == 0 and not store.versions()
    one = store.commit(store.snapshot(), replace={"a": spark.range(5), "b": spark.range(3)})
    old = store.snapshot()
    two = store.commit(one, append={"a": spark.range(10, 12)}, drop={"b"})
    assert two.rows == {"a": 7} and store.snapshot()["a"].count() == 7
    assert old.rows == {"a": 5, "b": 3} and old["a"].count() == 5 and old["b"].count() == 3  # a reader keeps its version
    with pytest.raises(Conflict):
        store.commit(one, replace={"a": spark.range(1)})
    assert store.snapshot()["a"].count() == 7 and store.versions() == [1, 2]
    with pytest.raises(ValueError):
        store.commit(two, append={"a": spark.range(3).selectExpr("string(id) AS id")})
    assert store.vacuum() > 0 and store.versions() == [2] and store.snapshot()["a"].count() == 7


def test_a_failed_write_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    base = store.commit(store.snapshot(), replace={"a": spark.range(5), "b": spark.range(3)})
    bad = spark.range(100).selectExpr("raise_error('task dies') AS id")
    with pytest.raises(Exception, match="task dies"):
        store.commit(base, replace={"a": spark.range(50), "b": bad})
    now = store.snapshot()
    assert now.version == 1 and now["a"].count() == 5 and now["b"].count() == 3


def test_clobber_and_clear(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.commit(store.snapshot(), replace={"old": spark.range(9), "parent": spark.range(2)})
    made, copied = clobber_into(tables(spark), store)
    assert copied == 14 + 60 and set(made) == {"parent", "child", "edge"} and rows(made["child"]) == rows(tables(spark)["child"])
    empty = cleared(store, ["child", "absent"])
    assert empty.rows == {"parent": 14, "child": 0, "edge": 0}


def test_a_restored_table_reads_its_own_rows_only(spark, tmp_path):
    specs = [sn.Table(n, "id int, name string") for n in ("one", "two")]
    tables = {n: spark.createDataFrame([(k, f"{n} -- {k}") for k in range(3)], "id int, name string") for n in ("one", "two")}
    sn.export_sql(tables, specs, f"{tmp_path}/s")
    got = sn.import_sql(spark, specs, f"{tmp_path}/s").tables
    for n in tables:
        assert sorted(map(tuple, got[n].collect())) == sorted(map(tuple, tables[n].collect()))
        assert "(known#" in (plan := got[n]._jdf.queryExecution().executedPlan().toString()) and f"= {n})" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_a_task_splits_one_stretch_at_a_time(spark, tmp_path, monkeypatch):
    """However many stretches a partition has: the splitter gets a table of one of them."""
    from auditweave.sources import sql_scripts

    real = sql_scripts._pieces

    def one(key, stretch, first):
        if stretch.num_rows != 1 or first.num_rows != 1:
            raise ValueError("several stretches at once")
        return real(key, stretch, first)

    monkeypatch.setattr(sql_scripts, "_pieces", one)
    (tmp_path / "a.sql").write_text("".join(f"insert {k} 'a;\n';\n" for k in range(200)))
    assert sql_scripts.statements(spark, str(tmp_path / "a.sql"), piece=50).count() == 200


def test_compressed_scripts_are_split_as_they_are_read(spark, tmp_path, monkeypatch):
    """Nothing is written but what is asked for; long statements and comments cross stretches, other scripts may lie beside."""
    import gzip

    from auditweave.plans.registry import queries

    whole = {f"{k:03}.sql.gz": s for k, s in enumerate(s for s in scripts() if s)}
    whole["long.sql.gz"] = "".join(f"INSERT INTO t VALUES ({k}, 'line {k};\n -- no comment\n it''s', \"a;b\"); /* {k};\n */ -- end; {k}\n" for k in range(800))
    for name, s in whole.items():
        (tmp_path / name).write_bytes(gzip.compress(s.encode()))
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "p.sql").write_text(whole["long.sql.gz"])

    def got(path):
        out = {}
        for r in sq.statements(spark, str(path), 40).orderBy("file", "number").collect():
            out.setdefault(r.file.rsplit("/", 1)[1], []).append(r.statement)
        return out

    want = {n: plain_split(s) for n, s in whole.items() if plain_split(s)}
    assert got(tmp_path) == want | {"p.sql": want["long.sql.gz"]}
    (tmp_path / "plain" / "p.sql").unlink()

    def kept(*_):
        raise AssertionError("written")

    monkeypatch.setattr(sq, "written", kept)
    assert got(tmp_path) == want
    counts = {(r.table_name, r.kind): r.n for r in queries()["s06_script_statements"](spark, "/root/testdata/sf0.001").collect()}
    assert counts["audit_finding", "insert"] == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_compressed_snapshot_restores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sn, "TASK_ROWS", 7)
    own = tables(spark)
    sn.export_sql(own, SPECS, str(tmp_path), compressed=True)
    assert len(list(tmp_path.glob("*-child/*.gz"))) >= 60 / 7 and not list(tmp_path.glob("*/part-*.txt"))
    got = sn.import_sql(spark, SPECS, str(tmp_path)).tables
    for name, df in own.items():
        assert rows(got[name]) == rows(df), name
