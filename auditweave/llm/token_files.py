"""Token ids in Arrow stream files of fixed-size-list batches.

Documents are dealt by ranges of doc_id, sorted and encoded; each range becomes one shard of two
files in the shared folder.  ``<shard>.ids.arrow``: record batches of ``ids`` (fixed-size list of
``sequence`` unsigned integers) and ``mask`` (fixed-size list of as many booleans; false where the
last sequence of a shard is filled up).  Sequence k of a shard is a slice of the mapped buffer,
whatever k.  ``<shard>.docs.arrow``: doc_id, first id in the shard and number of ids of each document.

A shard is written under a name of its own attempt and then renamed, so a task may run again at any
time.  Shards number as the session's shuffle partitions; only one row for each (name, ids, first
doc_id) reaches the driver.

Rows: null text is empty (the end id alone); null doc_id sorts first; repeated doc_id values are
separate documents that stand side by side, in order of their text; an empty table gives no shard;
other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .vocab import END_ID, default_path, ids_of, packed

#: Ids of one fixed-size list.
SEQUENCE = 2048
#: Sequences of one record batch.
BATCH = 256


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """Writes one shard, holding one record batch of ids and three numbers for each document."""

    def __init__(self, folder: str, name: str, width: np.dtype, sequence: int):
        self.fs, self.folder = _place(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.attempt = name, uuid.uuid4().hex[:8]
        self.width, self.sequence = width, sequence
        item = pa.from_numpy_dtype(width)
        self.schema = pa.schema([("ids", pa.list_(item, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.sink = self.fs.open_output_stream(self._path("ids", self.attempt))
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0
        self.docs: list[tuple[int | None, int, int]] = []

    def _path(self, kind: str, attempt: str = "") -> str:
        return f"{self.folder}/{self.name}.{kind}.arrow" + (f".{attempt}" if attempt else "")

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        self.waiting.append(ids.astype(self.width))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BATCH * self.sequence:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        row = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.width)
        whole = len(row) // self.sequence * self.sequence
        for k in range(0, whole, BATCH * self.sequence):
            self._batch(row[k : min(whole, k + BATCH * self.sequence)])
        rest = row[whole:]
        if last and len(rest):
            self._batch(rest)
            rest = rest[:0]
        self.waiting, self.held = [rest], len(rest)

    def _batch(self, row: np.ndarray) -> None:
        real = len(row)
        fill = -real % self.sequence
        values = pa.array(np.concatenate([row, np.zeros(fill, self.width)]))
        mask = pa.array(np.arange(real + fill) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.sequence) for x in (values, mask)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> tuple[str, int, int | None]:
        self._flush(True)
        self.stream.close()
        self.sink.close()
        table = pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "first", "n_tokens"), zip(*self.docs, strict=True), strict=True)})
        with self.fs.open_output_stream(self._path("docs", self.attempt)) as sink, pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        for kind in ("docs", "ids"):
            self.fs.move(self._path(kind, self.attempt), self._path(kind))
        return self.name, self.total, self.docs[0][0]


class ShardReader:
    """Random access to a shard: the files are mapped where the folder is local, else read once."""

    def __init__(self, folder: str, name: str):
        fs, at = _place(folder)
        self.docs = self._open(fs, f"{at}/{name}.docs.arrow").read_all()
        batches = self._open(fs, f"{at}/{name}.ids.arrow").read_all().to_batches()
        self.batches = [b.column(0) for b in batches]
        self.masks = [b.column(1) for b in batches]
        self.sequence = self.batches[0].type.list_size if self.batches else 1
        self.flat = [b.flatten().to_numpy(zero_copy_only=True) for b in self.batches]
        self.begins = np.cumsum([0, *map(len, self.flat)])

    @staticmethod
    def _open(fs: pafs.FileSystem, path: str):
        local = isinstance(fs, pafs.LocalFileSystem)
        return pa.ipc.open_stream(pa.memory_map(path) if local else fs.open_input_file(path).read_buffer())

    def sequence_at(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence k; the ids are a view of the file's buffer."""
        b = int(np.searchsorted(self.begins, k * self.sequence, side="right")) - 1
        row = (k * self.sequence - int(self.begins[b])) // self.sequence
        ids = self.flat[b][row * self.sequence : (row + 1) * self.sequence]
        return ids, np.asarray(self.masks[b][row].as_py(), bool)

    def ids(self, first: int, n: int) -> np.ndarray:
        """n ids from ``first`` on: a view, or a copy where they lie in several batches."""
        out = []
        b = int(np.searchsorted(self.begins, first, side="right")) - 1
        while n > 0:
            at = first - int(self.begins[b])
            got = self.flat[b][at : at + n]
            out.append(got)
            first, n, b = first + len(got), n - len(got), b + 1
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, sequence: int = SEQUENCE, end_id: int | None = END_ID) -> DataFrame:
    """Write all documents' ids to ``folder``; a row for each shard: name, n_ids, least doc_id."""
    path = path or default_path()
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = ids_of(path), None
        ids = encode.vocabulary.tokens
        width = np.dtype(np.uint16 if max(ids) < 1 << 16 else np.uint32)
        end = packed([end_id]) if end_id is not None else b""
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer = writer or ShardWriter(folder, f"shard-{uuid.uuid4().hex}", width, sequence)
                writer.add(doc_id, np.frombuffer(encode(text.as_py()) + end, "<u4"))
        if writer:
            name, total, least = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total], pa.int64()), pa.array([least], pa.int64())], names=["shard", "n_ids", "least_doc_id"])

    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
        .repartitionByRange(common.partitions(spark), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    return common.written(dealt.mapInArrow(run, "shard string, n_ids long, least_doc_id long"), "shards")


def read_token_files(shards: DataFrame, folder: str, derive=None, schema: str = "ids array<long>") -> DataFrame:
    """Every document of the shards, from the files alone: doc_id, start (ids of all documents
    before it), n_tokens, and what ``derive`` makes of its ids (by default the ids)."""
    spark = shards.sparkSession
    derive = derive or (lambda ids: (ids.tolist(),))
    # One small row for each shard; all rows of one doc_id lie in the same.
    listed, base = sorted((r.least_doc_id is not None, r.least_doc_id or 0, r.shard, r.n_ids) for r in shards.collect()), 0
    rows = []
    for *_, shard, n in listed:
        rows.append((shard, base))
        base += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = ShardReader(folder, shard)
                for docs in reader.docs.to_batches(max_chunksize=2000):
                    firsts, sizes = docs.column(1).to_pylist(), docs.column(2).to_pylist()
                    made = [derive(reader.ids(f, n)) for f, n in zip(firsts, sizes, strict=True)]
                    cols = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array([base + f for f in firsts], pa.int64()), docs.column(2), *cols], names=names)

    out = f"doc_id long, start long, n_tokens long, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(out))
    names, types = arrow.names, arrow.types[3:]
    listed_df = spark.createDataFrame(rows, "shard string, base long")
    return listed_df.repartition(max(1, len(rows))).mapInArrow(run, out)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids, read the files back, and describe each document from them."""
    folder = common.scratch_path(spark, "token-files")
    shards = write_token_files(common.table(spark, sf_dir, "documents"), folder)
    return read_token_files(shards, folder, lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),), "ids_crc32 long")
