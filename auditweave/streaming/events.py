"""Structured Streaming over events: windows, dedup, and the strongest edge as a state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.enums import STRENGTHS

LINKS = "semantic_node_id int, audit_finding_id int, strength string"


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    timed = _timed(events, late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users") if not events.isStreaming else F.approx_count_distinct("user_id").alias("users")).select(
        F.col("w.start").alias("start"), "event_type", "n", "users"
    )


def first_events(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each key once within the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark(keys)


def _keep(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    best = state.get[0] if state.exists else ""
    for f in frames:
        for s in f["strength"]:
            if STRENGTHS.get(s, 0) > STRENGTHS.get(best, 0):
                best = s
    state.update((best,))
    yield pd.DataFrame({"semantic_node_id": [key[0]], "audit_finding_id": [key[1]], "strength": [best]})


def strongest_links(links: DataFrame) -> DataFrame:
    """A stream of links -> after each batch the strongest of every pair that it touches."""
    return links.groupBy("semantic_node_id", "audit_finding_id").applyInPandasWithState(_keep, LINKS, "strength string", "update", "NoTimeout")
