"""Keeping one row of several, ordered folds and quotas.

One-of-many is an aggregate (``max_by`` on a struct), not a window: tasks fold their own rows before
the shuffle, so a hot key costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.enums import STRENGTHS, rank
from .batches import greedy_batches  # noqa: F401


def strongest(df: DataFrame, keys: list[str], order: str = "ord", strength: str = "strength", values: dict[str, int] = STRENGTHS) -> DataFrame:
    """Per key the row of highest rank; ties keep the first by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(rank(strength, values).alias("rank"), (-F.col(order)).alias("late")))
    return df.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*").select(*df.columns)


def first_by(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("best")).select(*keys, "best.*").select(*df.columns)


def quota(df: DataFrame, keys: list[str], cap: int, order: list[Column]) -> DataFrame:
    """The first ``cap`` rows of each key; 0 is no cap."""
    if not cap:
        return df
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= cap).drop("_nth")


def first_links(links: DataFrame, least: str, cap: int) -> DataFrame:
    """Of each concept's links (historical_id, finding_id, link) those that can stay under a cap of ``cap`` links a pair
    of ``plan_links``: within a pair match and arrival are the same, so that every extract keeps the same first
    links of a concept.  Taken before links fan out to extracts."""
    strong = links.where(rank("link", STRENGTHS) >= STRENGTHS[least])
    return quota(strong, ["historical_id"], cap, [rank("link", STRENGTHS).desc(), F.col("finding_id").asc()])


def plan_links(links: DataFrame, built: DataFrame, least_match: str = "Low", least_link: str = "Low", per_pair: int = 0, per_extract: int = 0, total: int = 0) -> DataFrame:
    """Links (extract_id, historical_id, finding_id, match, link, ord) in the order of work.

    In sequence: strength filters; strongest match, then link, then arrival; quota of a pair; of an
    extract; of all; extracts take turns; links that are built already go last of all.
    """
    ranked = links.where((rank("match", STRENGTHS) >= STRENGTHS[least_match]) & (rank("link", STRENGTHS) >= STRENGTHS[least_link]))
    order = [rank("match", STRENGTHS).desc(), rank("link", STRENGTHS).desc(), F.col("ord").asc()]
    kept = quota(ranked, ["extract_id", "historical_id"], per_pair, order)
    kept = quota(kept, ["extract_id"], per_extract, order)
    if total:
        kept = kept.orderBy(*order).limit(total)
    turn = F.row_number().over(W.partitionBy("extract_id").orderBy(*order))
    kept = kept.withColumn("turn", turn)
    return kept.join(built, ["extract_id", "historical_id", "finding_id"], "left_anti")


def representative(members: DataFrame, key: str, text: str = "body") -> DataFrame:
    """Per key the member of highest (severity, link, match) and fewest text bytes; ties keep the last."""
    from ..functions.enums import REVIEW_SEVERITIES

    at = F.struct(
        rank("severity", REVIEW_SEVERITIES).alias("s"), rank("link", STRENGTHS).alias("l"), rank("match", STRENGTHS).alias("m"),
        (-F.octet_length(text)).alias("b"), F.col("ord").alias("o"),
    )
    return members.groupBy(key).agg(F.max_by("member_id", at).alias("representative_id"))


def dedup_semantics(df: DataFrame) -> DataFrame:
    """Key: trimmed lower name.  The longest description in bytes (first of equals) brings its name,
    definition and category; functions are united."""
    from ..functions.enums import trim_all

    key = trim_all(F.lower("name")).alias("key")
    at = F.struct(F.octet_length("description").alias("n"), (-F.col("ord")).alias("o"))
    best = F.max_by(F.struct("name", "definition", "description", "category"), at).alias("best")
    functions = F.array_sort(F.array_distinct(F.flatten(F.collect_list("functions")))).alias("functions")
    return df.groupBy(key).agg(best, functions).select("key", "best.*", "functions")


def dedup_findings(df: DataFrame) -> DataFrame:
    """Per title: highest severity; each text on its own the longest in bytes (first of equals);
    category and subcategory go with the description."""
    from ..functions.enums import SEVERITIES

    def longest(c: str, *rest: str):
        at = F.struct(F.octet_length(c).alias("n"), (-F.col("ord")).alias("o"))
        return F.max_by(F.struct(c, *rest) if rest else F.col(c), at)

    severity = F.max_by("severity", F.struct(rank("severity", SEVERITIES).alias("r"), (-F.col("ord")).alias("o"))).alias("severity")
    return df.groupBy("title").agg(severity, longest("root_cause").alias("root_cause"), longest("description", "category", "subcategory").alias("d")).select(
        "title", "severity", "root_cause", "d.*"
    )
