"""The corpus pipeline: five stages over the documents, each on all that the one before kept.

A stage takes (spark, docs, sf_dir).  All but the last return the columns of documents; the last
returns the pieces of packed sequences.  In every stage null text counts as empty text, an empty table
gives an empty result, and columns beyond those of documents are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditweave.llm import common, lines, packing, secret_scan, simhash, toxicity

#: The packing stage's workers live beside an executor that five stages have filled.
MEMO_ENTRIES = 60_000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.  Empty text scores like text without words; repeated rows score
    alike and stay or go together, null doc_id too; without labels of both kinds every score is the share of
    toxic labels."""
    common.findable(spark)
    common.small_batches(spark)
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; every document stays, repeated rows and null doc_id too, each a
    document of its own; what is left of a text may be empty."""
    common.findable(spark)
    common.small_batches(spark)
    return lines.drop_lines(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: near by fingerprint, or by five-word
    shingles of a Jaccard similarity of at least 0.8.  That of the smallest doc_id stays (null last), of equal
    ones that of the smallest text hash, and of rows equal in both one; texts without words are one group."""
    common.findable(spark)
    common.small_batches(spark)
    return simhash.keep_one(docs, near=True)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, repeated rows and null doc_id too; overlapping
    secrets get one mark."""
    common.findable(spark)
    common.small_batches(spark)
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of one length.  Every row is a document, also with null or
    repeated doc_id; an empty text is its end id alone; a document longer than a sequence is cut, no id is
    lost; of equal windows the first opened is filled."""
    common.findable(spark)
    common.small_batches(spark)
    return packing.piece_digests(packing.pack(docs, memo=MEMO_ENTRIES))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Learned decisions can't be said in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage but the last is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, name)
    return docs
