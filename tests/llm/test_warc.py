"""WARC: round trips, revisits against a plain version, predicates that leave payloads undecoded."""

import gzip
import hashlib
import io
import os

import duckdb
import pyarrow as pa
import pytest

from auditweave.llm import common, warc

LONG = "x" * 150


@pytest.fixture(scope="module", autouse=True)
def found(spark):
    common.findable(spark)


def row(k, kind="response", payload=b"", **more):
    return dict.fromkeys(["record_type", "record_id", "date", "target_uri", "refers_to", "payload_digest", "content_type", "payload_bytes", "payload"]) | {
        "record_type": kind, "record_id": f"<urn:page:{k}>", "content_type": "text/html", "payload": payload,
    } | more


def plain(pages):
    first = {}
    for i, (pid, url, html) in sorted(enumerate(pages), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[1][1] is None, x[1][1] or "", x[0])):
        first.setdefault(html or "", (i, pid))
    out = []
    for i, (pid, _, html) in enumerate(pages):
        data = (html or "").encode()
        again = len(data) >= 100 and first[html or ""][0] != i
        out.append((pid, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html or ""][1] if again else None))
    return sorted(out, key=repr)


PAGES = [
    (3, "http://a", LONG), (1, "http://b", LONG), (None, None, LONG), (1, "http://b", LONG), (1, "http://a c\r\nd", LONG), (2, None, "short"), (4, "", "short"),
    (5, "u", None), (6, "u", ""), (7, "u", "é" * 50), (8, "u", "é" * 50), (9, "u", "é" * 49), (10, "u", "é" * 49), (11, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 9000), (12, "u", "\x1f\x8b\x08" * 100),
    (None, "n", "y" * 100), (None, "n", "y" * 100), (-4, "n", "z" * 100), (-5, "n", "z" * 100),
]


@pytest.mark.parametrize("pages", [PAGES, [], [(k % 2, "u", LONG) for k in range(500)], [(k, "u", str(k % 7) * 200) for k in range(400)]], ids=["awkward", "none", "one page", "few payloads"])
def test_archive_is_the_plain_version(spark, tmp_path, pages):
    df = spark.createDataFrame([(*p, "k", 1) for p in pages], "page_id long, url string, html string, digest string, size long").repartition(3)
    warc.archive(df, str(tmp_path / "w"))
    got = warc.described(spark, str(tmp_path / "w")).collect()
    assert sorted(map(tuple, got), key=repr) == plain(pages)


def test_sql(spark, tmp_path):
    pages = pa.table({"page_id": [p[0] for p in PAGES], "url": [p[1] for p in PAGES], "html": [p[2] for p in PAGES]})
    con = duckdb.connect()
    con.register("pages", pages)
    got = con.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.ORACLE_SQL})").fetchall()
    assert sorted(got, key=repr) == plain(PAGES)


def read(data, wanted=lambda r: True, payload=True, kind=warc.Gzip):
    stream = kind(pa.BufferReader(data))
    return list(warc.records(stream, wanted, payload)), stream


@pytest.mark.parametrize("form", ["members", "members without lengths", "one stream", "plain"])
def test_forms_of_files(form):
    rows = [row(k, payload=os.urandom(k * 997) + b"\r\n\r\n" * k) for k in range(120)] + [row(0, "revisit", payload_bytes=77), row(1, "resource", payload=b"raw"), row(2, "warcinfo")]
    made = [warc.record_bytes(r) for r in rows]
    data = {
        "members": lambda: b"".join(map(warc.member, made)),
        "members without lengths": lambda: b"".join(map(gzip.compress, made)),
        "one stream": lambda: gzip.compress(b"".join(made)),
        "plain": lambda: b"".join(made),
    }[form]()
    kind = warc.Plain if form == "plain" else warc.Gzip
    if form != "plain":
        assert gzip.GzipFile(fileobj=io.BytesIO(data)).read() == b"".join(made)  # any reader can open it
    got, _ = read(data, kind=kind)
    assert [(r["record_type"], r["record_id"], r["payload"]) for r in got] == [(r["record_type"], r["record_id"], None if r["record_type"] == "revisit" else r["payload"]) for r in rows]
    assert got[-3]["payload_bytes"] == 77
    some, _ = read(data, lambda r: r["record_type"] != "response", kind=kind)
    assert [r["record_id"] for r in some] == [r["record_id"] for r in rows[120:]]
    heads, _ = read(data, payload=False, kind=kind)
    assert [r["payload_bytes"] for r in heads] == [r["payload_bytes"] for r in got] and not any(r["payload"] for r in heads)


def test_unwanted_payloads_are_not_decoded():
    data = b"".join(warc.member(warc.record_bytes(row(k, payload=os.urandom(50_000)))) for k in range(40))
    got, stream = read(data, lambda r: r["record_id"] == "<urn:page:7>")
    assert len(got) == 1 and stream.decoded < 40 * 2048 + 52_000
    _, stream = read(data, payload=False)
    assert stream.decoded <= 40 * 2048


@pytest.mark.parametrize("cut", [5, 300, 5_000, 10_080])
def test_damage_is_an_error(cut):
    whole = warc.member(warc.record_bytes(row(1, payload=os.urandom(10_000))))
    with pytest.raises((ValueError, Exception)):
        read(whole[:cut])
    bad = bytearray(whole)
    bad[-6] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        read(bytes(bad))


def test_predicates_reach_the_reader(spark, tmp_path):
    folder = str(tmp_path / "w")
    warc.archive(spark.createDataFrame([(k, f"http://h{k % 3}/p", f"{k % 40} " * 60) for k in range(100)], "page_id long, url string, html string"), folder)
    all_rows = spark.read.format("warc").load(folder)
    from pyspark.sql import functions as F

    ways = [
        (F.col("record_type") == "revisit", 60), (F.col("target_uri").startswith("http://h1/"), 33), (F.col("refers_to").isNull() & (F.col("record_type") == "response"), 40),
        (F.col("record_id").isin("<urn:page:3>", "<urn:page:99>"), 2), (F.col("record_type") != "warcinfo", 100), (~F.col("target_uri").startswith("http://h1/"), 67),
        ((F.col("record_type") == "revisit") & (F.col("payload_bytes") > 120), 40),
    ]
    for where, n in ways:
        assert all_rows.where(where).count() == n, where
    plan = lambda where: all_rows.where(where)._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" in plan("payload_bytes > 3") and "Filter (" not in plan("record_type = 'revisit'")  # the reader takes it whole


def test_plan_bundles_small_files(tmp_path, monkeypatch):
    for k in range(5):
        (tmp_path / f"{k}.warc").write_bytes(warc.record_bytes(row(k, payload=b"a" * 1000)))
    (tmp_path / "ignored.txt").write_text("x")
    (tmp_path / ".half.warc").write_text("x")
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 2500)
    reader = warc.WarcReader(str(tmp_path), True, None)
    assert [len(p.paths) for p in reader.partitions()] == [3, 2]
    assert warc.WarcReader(str(tmp_path / "none"), True, None).partitions() == [warc.Bundle(())]


def test_only_commits_count(spark, tmp_path):
    writer = warc.WarcWriter(str(tmp_path), False)
    batch = pa.RecordBatch.from_pylist([row(1, payload=b"a")])
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))  # a task that ran twice
    assert not warc._archives(*common.place(str(tmp_path)))
    writer.commit([again])
    assert [x.base_name for x in warc._archives(*common.place(str(tmp_path)))] == list(again.names)
    writer.abort([first])
    assert len(list(tmp_path.iterdir())) == 1
    over = warc.WarcWriter(str(tmp_path), True)
    made = over.write(iter([batch]))
    over.commit([made])
    assert [p.name for p in tmp_path.iterdir()] == list(made.names)
