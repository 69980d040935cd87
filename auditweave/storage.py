"""The folder that driver and executors share: checkpoints, written tables, scratch paths."""

from __future__ import annotations

import os
import re
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where a session within one machine names no shared folder, as in tests.
OWN_FOLDER = "file:///tmp/checkpoints/auditweave"


def shared_folder(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``.  Without it a session within one machine gets a folder of its own and
    a cluster is refused."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = OWN_FOLDER
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def findable(spark: SparkSession) -> None:
    """Let Python workers that share the driver's disk import the package from here; a cluster has it
    installed or gets it by --py-files."""
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    paths = [p for p in (environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


#: Rows that a task of a shuffle over a large table takes, about.
TASK_ROWS = 1 << 17


def task_count(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def dealt(df: DataFrame, parts: int, *keys) -> DataFrame:
    """Dealt out by keys to a number of tasks that follows the rows; 0 leaves the number to the engine, which joins
    partitions by their bytes on disk: of sorted ids, that pack to a few bytes a row, a task would then take tens of
    millions of rows."""
    return df.repartition(parts, *keys) if parts else df


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def measured_joins(spark: SparkSession):
    """What runs within broadcasts a side of a join only if its shuffle has shown it to be small.  The size of a
    file of few or repeated numbers tells little: a million ids can lie in some hundred kilobytes, and
    the driver would have to hold them all as a table."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


@contextmanager
def adaptive(spark: SparkSession):
    """Streams turn the engine's adaptive execution off in their session, for the sake of their states; what a batch does
    within this, in tables of its own, sizes its shuffles and files by their rows again."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_CLEARED: set[str] = set()


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder that goes when the application ends."""
    own = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-tables"
    if own not in _CLEARED:
        _CLEARED.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{own}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder and read from there: typed files instead of a checkpoint."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
