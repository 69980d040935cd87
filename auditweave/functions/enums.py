"""Enumerations of the data model and their orders, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
PROJECT_CATEGORIES = (
    "Lending", "Dexes", "Yield", "Services", "Derivatives", "Yield Aggregator", "Real World Assets", "Stablecoins",
    "Indexes", "Insurance", "NFT Marketplace", "NFT Lending", "Cross Chain", "Others",
)
FINDING_CATEGORIES = ("Access Control", "Arithmetic", "Block Manipulation", "Cryptographic", "Denial of Services", "Reentrancy", "Storage & Memory")
STRENGTHS = {"Low": 1, "Medium": 2, "High": 3}
SEVERITIES = {"Low": 1, "Medium": 2, "High": 3}
REVIEW_SEVERITIES = {"ReviewedOutOfScope": 0, "Informational": 1, "Low": 2, "Medium": 3, "High": 4}
REPORTABLE = ("High", "Medium", "Low", "Informational")
REGEN = ("IncompleteStep", "WrongHarness", "WrongSpec")
SPEC_REGEN = ("WrongSpec",)
RULED_OUT = ("IntendedBehavior", "NotReproducible")
RESUMABLE = ("Completed", "Abandoned", "StepsExhausted")
PHASES = {"imported": 1, "retro": 2, "link": 3}
IN_PROJECT = "in-project link: "


def rank(column: str | Column, order: dict[str, int], missing: int = 0) -> Column:
    """Rank of an enumeration's value; unknown and null rank as ``missing``."""
    c = F.col(column) if isinstance(column, str) else column
    out = None
    for value, r in order.items():
        out = F.when(c == value, r) if out is None else out.when(c == value, r)
    return out.otherwise(missing)


def at_least(column: str | Column, least: str, order: dict[str, int] = STRENGTHS) -> Column:
    return rank(column, order) >= order[least]


def parse_strength(c: str | Column) -> Column:
    """Any case, trimmed; ``med`` is Medium; unknown is null."""
    key = F.lower(trim_all(c))
    return F.when(key == "high", "High").when(key.isin("medium", "med"), "Medium").when(key == "low", "Low")


def parse_project_category(c: str | Column) -> Column:
    """Trimmed, any ASCII case, ``_`` and ``-`` as spaces, runs of space as one; unknown is null."""
    key = F.trim(F.regexp_replace(F.translate(F.lower(trim_all(c)), "_-", "  "), r"\s+", " "))
    out = None
    for value in PROJECT_CATEGORIES:
        hit = key == value.lower()
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def parse_language(c: str | Column) -> Column:
    key = F.lower(trim_all(c))
    return F.when(key.isin("solidity", "sol"), "Solidity").when(key.isin("move", "sui move", "sui_move"), "Move")


def trim_all(c: str | Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
