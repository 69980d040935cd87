"""Queues drained exactly once into a versioned store.

A micro-batch's results, the keys it has worked on and its number become visible in one version.  A
batch that dies before leaves nothing; Spark then runs the same number again; a number that is in the
store already is passed over.  So work may run again, but its results are there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import batch_results
from ..sources.versions import Conflict, Snapshot, Store
from ..storage import adaptive, written

#: Tables to replace and rows to append, of a batch's fresh rows and the version it starts from.
Work = Callable[[DataFrame, Snapshot], tuple[dict[str, DataFrame], dict[str, DataFrame]]]
BATCHES = "drained_batches"


def drain(queue: DataFrame, store: Store, name: str, key: list[str], work: Work, attempts: int = 5):
    """A stream of work rows -> a writer that gives ``work`` the rows whose key was never worked on, of rows
    of one key in a batch any.  Another writer's version in between means another attempt on top of it."""

    def run(batch: DataFrame, number: int) -> None:
        with adaptive(batch.sparkSession):
            once(batch, number)

    def once(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for attempt in range(attempts):
            base = store.snapshot()
            if BATCHES in base and not base[BATCHES].where((F.col("name") == name) & (F.col("number") == number)).isEmpty():
                return
            fresh = batch.dropDuplicates(key)
            if f"{name}_done" in base:
                fresh = fresh.join(base[f"{name}_done"], key, "left_anti")
            fresh = fresh.persist()
            try:
                replace, append = work(fresh, base)
                marks = {BATCHES: spark.createDataFrame([(name, number)], "name string, number long"), f"{name}_done": fresh.select(*key)}
                store.commit(base, replace, {**append, **marks})
                return
            except Conflict:
                if attempt == attempts - 1:
                    raise
            finally:
                fresh.unpersist()

    return queue.writeStream.foreachBatch(run)


def link_findings(fresh: DataFrame, base: Snapshot) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Results of (finding, context) as they come: kept as progress; findings whose every expected context is
    there and none failed get their links, the strongest of each, and a completion row."""
    before = base.get("link_progress")
    progress = fresh if before is None else before.unionByName(fresh.select(*before.columns))
    touched = progress.join(fresh.select("finding_id").distinct(), "finding_id", "left_semi")
    counts = touched.groupBy("finding_id").agg(F.countDistinct("context").alias("n"), F.max("expected").alias("expected"), F.bool_or("failed").alias("failed"))
    ready = counts.where("n = expected AND NOT failed").select("finding_id")
    if "link_complete" in base:
        ready = ready.join(base["link_complete"].select("finding_id"), "finding_id", "left_anti")
    ready = written(ready, "ready")  # both are read more than once
    whole = written(touched.join(ready, "finding_id", "left_semi"), "whole")
    return {}, {"link_progress": fresh, "link_rows": batch_results(whole), "link_complete": ready}
