"""Queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, common, lexical, lines, metric_join, packing, quality, secret_scan, simhash, token_files, toxicity, vector_codes, warc

Query = Callable[[SparkSession, str], DataFrame]


def found(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.findable(spark)
        return query(spark, sf_dir)

    return run


_OWN: dict[str, Query] = {
    "op1_ann": ann.op1_ann,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_secrets": secret_scan.op3_secrets,
    "op4_quality": quality.op4_quality,
    "op5_metric_join": metric_join.op5_metric_join,
    "op6_simhash": simhash.op6_simhash,
    "op7_packing": packing.op7_packing,
    "op8_token_files": token_files.op8_token_files,
    "op9_bpe_codec": bpe.op9_bpe_codec,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_warc": warc.op11_warc,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_lexical": lexical.op13_lexical,
}

QUERIES: dict[str, Query] = {name: found(query) for name, query in _OWN.items()}

ORACLES: dict[str, str] = {
    "op5_metric_join": metric_join.ORACLE_SQL,
    "op10_line_dedup": lines.ORACLE_SQL,
    "op11_warc": warc.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
    "op13_lexical": lexical.ORACLE_SQL,
}
