"""Helpers that several training-data operators share."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where a session within one machine names no shared folder, as in tests.
OWN_FOLDER = "file:///tmp/checkpoints/auditweave"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findable(spark: SparkSession) -> None:
    """Let Python workers that share the driver's disk import the package from here; a cluster has it
    installed or gets it by --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in (environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


#: Bytes of rows that go to a Python worker at once.  Executor and worker hold a batch several times over, on
#: its way there and back; the engine's own bound is 64 MB.
BATCH = "4m"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Python workers get whole texts in batches of about ``BATCH``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


_REMEMBERED: dict[str, object] = {}


def remembered(key: str, make):
    """What a Python worker keeps from task to task, one thing at a time: what another stage has left goes
    before the new one is made."""
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def forget() -> None:
    """A stage that keeps nothing doesn't carry what another one has left."""
    _REMEMBERED.clear()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.  Without it, a session
    within one machine gets one of its own; a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = OWN_FOLDER
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
    named = named.rstrip("/")
    _cleared_at_exit(spark, named)
    return named


_CLEARED: set[str] = set()


def _cleared_at_exit(spark: SparkSession, folder: str) -> None:
    """What this application leaves in the folder goes when it ends."""
    own = spark.sparkContext.applicationId
    if own in _CLEARED:
        return
    _CLEARED.add(own)
    jvm, paths = spark._jvm, [f"{folder}/{own}"]
    checkpoints = spark.sparkContext._jsc.sc().getCheckpointDir()
    if checkpoints.isDefined():
        paths.append(checkpoints.get())
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; the same name is never given twice."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read from there."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """How many shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(column: str = "text"):
    """A text column with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_key(column: str = "doc_id"):
    """An id as text, empty for null: equal ids join by it, null ones too."""
    return F.coalesce(F.col(column).cast("long").cast("string"), F.lit(""))


def crc_remainder(column: str = "doc_id"):
    """crc32 of the id as text, modulo 4: the fold of a document (2 is held out)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


def place(uri: str):
    """pyarrow's file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
