"""Bounded-space online packing of token streams into sequences of a fixed length.

Each partition keeps at most ``windows`` open windows.  A document's ids (with the end id) are cut
into whole sequences while they are longer than one; the rest is placed in the open window that it
fills best.  When none has room and no further window may open, the fullest is emitted; the slack
it would leave beyond ``max_pad`` is first filled with the head of the piece.  At the end of a
partition the windows that are left are poured together, so one at most is not full; those of 64
partitions at a time are merged in the same way until one group is left.  Memory is bounded by
``windows`` sequences a task, and by 64 in the merge.

Rows: null text is empty (the end id alone); null and repeated doc_id values are documents of their
own; an empty table gives no rows; other columns are ignored.  Order of input rows decides
which pieces share a sequence, never which ids are packed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .vocab import END_ID, MEMO_ENTRIES, default_path, ids_of, packed

SEQUENCE = 2048
WINDOWS = 32
#: Most ids a sequence that is emitted online may lack.
MAX_PAD = 16
#: Partitions whose leftovers one task merges.
MERGED = 64

_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, part long, round int, number long, offset long, whole boolean"
_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "part", "round", "number", "offset", "whole"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

#: doc_id, ids before the piece, its packed ids, ids of the document
Piece = tuple[int | None, int, bytes, int]


class Packer:
    def __init__(self, part: int, round_: int, sequence: int, windows: int, max_pad: int):
        self.part, self.round, self.size, self.windows, self.max_pad = part, round_, sequence, windows, max_pad
        self.open: list[tuple[int, list[Piece]]] = []
        self.number = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list[Piece], whole: bool) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, ids, total, self.part, self.round, self.number, offset, whole))
            offset += n
        self.number += 1

    def document(self, doc_id: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.size:
            self.emit([(doc_id, at, ids[4 * at : 4 * (at + self.size)], total)], True)
            at += self.size
        if at < total:
            self.place((doc_id, at, ids[4 * at :], total))

    def place(self, piece: Piece) -> None:
        n = len(piece[2]) // 4
        fit = max((k for k, (used, _) in enumerate(self.open) if used + n <= self.size), key=lambda k: self.open[k][0], default=None)
        if fit is None and len(self.open) >= self.windows:
            used, pieces = self.open.pop(max(range(len(self.open)), key=lambda k: self.open[k][0]))
            if (room := self.size - used) > self.max_pad:
                head, piece = cut(piece, room)
                pieces.append(head)
            self.emit(pieces, True)
            return self.place(piece)
        if fit is None:
            self.open.append((n, [piece]))
            return None
        used, pieces = self.open[fit]
        pieces.append(piece)
        self.open[fit] = (used + n, pieces)
        if used + n == self.size:
            self.emit(self.open.pop(fit)[1], True)
        return None

    def finish(self, last: bool) -> None:
        """Pour what is left together, fullest windows first; a window that isn't full is emitted as
        left over, or as it is if ``last``."""
        used, row = 0, []
        for _, pieces in sorted(self.open, key=lambda w: -w[0]):
            for piece in pieces:
                while piece is not None:
                    head, piece = cut(piece, self.size - used)
                    row.append(head)
                    used += len(head[2]) // 4
                    if used == self.size:
                        self.emit(row, True)
                        used, row = 0, []
        if row:
            self.emit(row, last)
        self.open = []

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(_NAMES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


def cut(piece: Piece, n: int) -> tuple[Piece, Piece | None]:
    doc_id, start, ids, total = piece
    if len(ids) <= 4 * n:
        return piece, None
    return (doc_id, start, ids[: 4 * n], total), (doc_id, start + n, ids[4 * n :], total)


def pack(
    docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, windows: int = WINDOWS, max_pad: int = MAX_PAD, end_id: int = END_ID, memo: int = MEMO_ENTRIES
) -> DataFrame:
    """All pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset.  ``memo``: entries of a worker's memo of ids."""
    path = path or default_path()
    spark = docs.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = ids_of(path, memo), packed([end_id])
        packer = Packer(TaskContext.get().partitionId(), 0, sequence, windows, max_pad)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.document(doc_id, encode(text.as_py()) + end)
                if len(packer.rows) >= 2000:
                    yield packer.take()
        packer.finish(False)
        yield packer.take()

    def merge(round_: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer, at = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if packer is None or r["part"] // MERGED != packer.part:
                        if packer is not None:
                            packer.finish(last)
                            yield packer.take()
                        packer, at = Packer(r["part"] // MERGED, round_, sequence, MERGED, max_pad), None
                    if (own := (r["part"], r["number"])) != at:
                        packer.open.append((0, []))
                        at = own
                    used, pieces = packer.open[-1]
                    pieces.append((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
                    packer.open[-1] = (used + r["length"], pieces)
            if packer is not None:
                packer.finish(last)
                yield packer.take()

        return run

    got = common.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(first, _SCHEMA), "pieces")
    done, left, round_ = [got.where("whole")], got.where("not whole"), 0
    parts = left.agg(F.max("part")).head()[0]
    while parts is not None:
        round_ += 1
        groups = parts // MERGED + 1
        merged = left.withColumn("group", F.floor(F.col("part") / MERGED)).repartition(groups, "group").sortWithinPartitions("group", "part", "number", "offset")
        got = common.written(merged.drop("group").mapInArrow(merge(round_, groups == 1), _SCHEMA), "merged")
        done.append(got.where("whole"))
        left = got.where("not whole")
        parts = groups - 1 if groups > 1 else None
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    number = F.shiftleft(F.col("round").cast("long"), 58) + F.shiftleft("part", 28) + F.col("number")
    return out.select("doc_id", "start", "length", "ids", "doc_tokens", number.alias("sequence_id"), "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pack(common.table(spark, sf_dir, "documents")))


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
