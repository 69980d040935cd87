"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece is a row of symbols.  Leaf i of the tree holds the merge rank of the pair that starts at
symbol i (infinite if it can't merge), made unique by i; the root therefore yields the leftmost
pair of the lowest rank.  A merge changes three leaves, each in logarithmic time (a node has 16
children), until the root is infinite.  A piece of n symbols takes O(n log n), however long it is.

Rows: null text is empty (no ids, empty decoding); null and repeated doc_id values pass through,
one output row per input row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .vocab import Pieces, Vocabulary, default_path, packed, unpacked

_NEVER = float("inf")
#: Children of a node of the segment tree.
_FAN = 16
#: Bits of an id in the key of a pair.
_ID = 20


class MergeTree:
    """Merges a row of symbol ids by a table of pair ranks."""

    def __init__(self, ranks: dict[int, int], made: list[int]):
        self.ranks, self.made = ranks, made

    def merge(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        if n < 2:
            return symbols
        ranks, made = self.ranks.get, self.made
        bits = n.bit_length()
        at = (1 << bits) - 1
        leaves = [_NEVER] * (n - 1)
        left = symbols[0]
        for i in range(1, n):
            right = symbols[i]
            r = ranks(left << _ID | right)
            if r is not None:
                leaves[i - 1] = r << bits | (i - 1)
            left = right
        levels = [leaves]
        while len(levels[-1]) > _FAN:
            low = levels[-1]
            levels.append([min(low[k : k + _FAN]) for k in range(0, len(low), _FAN)])
        top = levels[-1]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := min(top)) != _NEVER:
            i = root & at
            j = after[i]
            new = symbols[i] = made[root >> bits]
            symbols[j] = -1
            k = after[i] = after[j]
            leaves[i] = _NEVER
            if k < n:
                before[k] = i
                leaves[j] = _NEVER
                r = ranks(new << _ID | symbols[k])
                if r is not None:
                    leaves[i] = r << bits | i
            h = before[i]
            if h >= 0:
                r = ranks(symbols[h] << _ID | new)
                leaves[h] = _NEVER if r is None else r << bits | h
            if len(levels) > 1:
                changed = {i} | ({j} if k < n else set()) | ({h} if h >= 0 else set())
                for low, high in zip(levels, levels[1:], strict=False):
                    changed = {x // _FAN for x in changed}
                    for x in changed:
                        high[x] = min(low[x * _FAN : (x + 1) * _FAN])
        return [s for s in symbols if s >= 0]


def merge_tree(vocabulary: Vocabulary) -> MergeTree:
    ids = vocabulary.ids
    ranks = {ids[a] << _ID | ids[b]: rank for rank, (a, b) in enumerate(vocabulary.merges)}
    return MergeTree(ranks, [ids[a + b] for a, b in vocabulary.merges])


class SegmentTreeBpe(Pieces):
    """Text to ids by the merge tree, and ids to text."""

    def __init__(self, path: str):
        super().__init__(Vocabulary(path))
        self.tree = merge_tree(self.vocabulary)
        self.decimal = {i: str(i) for i in self.vocabulary.tokens}

    def piece(self, piece: str) -> bytes:
        ids, written = self.vocabulary.ids, self.vocabulary.written(piece)
        row = [*written[:-1], written[-1] + self.vocabulary.suffix]
        return packed(self.tree.merge([ids[s] for s in row if s in ids]))

    def encode(self, text: str) -> list[int]:
        return unpacked(self(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """As the library does without a decoder: known tokens joined by one space."""
        tokens = self.vocabulary.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


_KEPT: dict[str, SegmentTreeBpe] = {}


def coder(path: str) -> SegmentTreeBpe:
    if path not in _KEPT:
        _KEPT[path] = SegmentTreeBpe(path)
    return _KEPT[path]


#: What a row gives besides doc_id, from the coder, a document's ids and its decoded text.
Derive = Callable[[SegmentTreeBpe, array, str], tuple]


def ids_and_text(coder: SegmentTreeBpe, ids: array, decoded: str) -> tuple:
    return ids.tolist(), decoded


def digests(coder: SegmentTreeBpe, ids: array, decoded: str) -> tuple:
    decimal = " ".join(map(coder.decimal.__getitem__, ids))
    return len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encode_decode(
    docs: DataFrame,
    path: str | None = None,
    derive: Derive = ids_and_text,
    schema: str = "ids array<int>, decoded string",
) -> DataFrame:
    """Encode every text, decode its ids, and return doc_id with what ``derive`` makes of both."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = coder(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = unpacked(both(text.as_py()))
                rows.append(derive(both, ids, both.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows, types)], names=names)

    out_schema = f"doc_id long, {schema}"
    names, types = _arrow(docs.sparkSession, out_schema)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(run, out_schema)


def _arrow(spark: SparkSession, ddl: str) -> tuple[list[str], list[pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    s = to_arrow_schema(StructType.fromDDL(ddl))
    return s.names, s.types[1:]


def _columns(rows: list[tuple], types: list[pa.DataType]) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) if rows else [() for _ in types]
    return [pa.array(c, type=t) for c, t in zip(cols, types, strict=True)]


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document."""
    return encode_decode(
        common.table(spark, sf_dir, "documents"),
        derive=digests,
        schema="n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
