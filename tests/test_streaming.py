"""Streams against their batch counterparts."""

from pyspark.sql import functions as F

from auditweave.operators import keep
from auditweave.plans.roles import Roles
from auditweave.streaming import events

SF = "/root/testdata/sf0.001"


def test_strongest_links_equal_batch(spark, tmp_path):
    links = Roles(spark, SF)["sfl_raw"].where("semantic_node_id < 30").select("semantic_node_id", "audit_finding_id", "strength", "ord")
    links.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(links.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.strongest_links(stream).writeStream.outputMode("update").format("memory").queryName("strongest").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rank = {"Low": 1, "Medium": 2, "High": 3}
    got = {}
    for r in spark.sql("SELECT * FROM strongest").collect():
        k = (r.semantic_node_id, r.audit_finding_id)
        got[k] = max(got.get(k, "Low"), r.strength, key=rank.get)
    want = {(r.semantic_node_id, r.audit_finding_id): r.strength for r in keep.strongest(links, ["semantic_node_id", "audit_finding_id"]).collect()}
    assert got == want


def test_first_events(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = events.first_events(stream, ["user_id", "event_type"], "60 days").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM firsts").count() == spark.read.parquet(str(tmp_path / "in")).select("user_id", "event_type").distinct().count()


def test_a_batch_counts_once(spark, tmp_path, monkeypatch):
    """A writer that dies after the work and before its version is published, and one that dies right after."""
    from auditweave.sources.versions import Store
    from auditweave.streaming import drains

    spark.range(30).select((F.col("id") % 10).alias("id")).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = Store(spark, f"file://{tmp_path}/store")
    worked, publish, fails = [], Store._publish, {1: "before", 3: "after"}

    def work(fresh, base):
        worked.append(fresh.count())
        return {}, {"out": fresh.withColumn("twice", F.col("id") * 2)}

    def dying(self, version, entries):
        how = fails.pop(version, None)
        if how != "before":
            publish(self, version, entries)
        if how:
            raise RuntimeError("the writer dies")

    monkeypatch.setattr(Store, "_publish", dying)
    for _ in range(5):
        q = drains.drain(stream(), store, "queue", ["id"], work).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
            break
        except Exception as e:
            assert "the writer dies" in str(e)
        finally:
            q.stop()
    assert not fails and len(worked) > 3
    now = store.snapshot()
    assert sorted(map(tuple, now["out"].collect())) == [(k, 2 * k) for k in range(10)]
    assert now[drains.BATCHES].count() == now[drains.BATCHES].distinct().count() == 3


def test_another_writer_in_between(spark, tmp_path):
    from auditweave.sources.versions import Store
    from auditweave.streaming import drains

    spark.range(4).write.parquet(str(tmp_path / "in"))
    store = Store(spark, f"file://{tmp_path}/store")
    seen = []

    def work(fresh, base):
        if not seen:
            store.commit(base, append={"other": spark.range(2)})
        seen.append(base.version)
        return {}, {"out": fresh}

    q = drains.drain(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), store, "q", ["id"], work).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    now = store.snapshot()
    assert seen == [0, 1] and now["out"].count() == 4 and now["other"].count() == 2
