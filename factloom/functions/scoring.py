"""Deterministic relevance: the score and its signals as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROFILES = ("general", "semantic", "scholarly", "historical")

#: Base score by match type, and where a profile lifts it.
BASE = {"lookup": 1000, "exact": 950, "semantic": 900, "conceptual": 880, "relational": 860, "lexical": 820, "traversal": 780}
LIFTED = {"semantic": {"semantic": 1000}, "scholarly": {"conceptual": 930, "relational": 910}}


def _by_type(match_type: Column, values: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, value in values.items():
        out = F.when(match_type == name, value).otherwise(out)
    return out.cast("bigint")


def signals(profile: str, c: dict[str, Column]) -> dict[str, Column]:
    """The five signals of a candidate's columns: match_quality, path_relevance, evidence_support, authority_metadata, temporal_relevance."""
    steps = F.coalesce(F.size(c["path"]), F.lit(0))
    length = F.when(c["path"].isNull(), 0).otherwise(steps)
    return {
        "match_quality": _by_type(c["match_type"], BASE | LIFTED.get(profile, {})),
        "path_relevance": F.greatest(F.lit(0), 100 - 10 * length).cast("bigint"),
        "evidence_support": (10 * F.least(F.lit(10), F.greatest(F.lit(0), F.coalesce(F.size(c["evidence_ids"]), F.lit(0))))).cast("bigint"),
        "authority_metadata": (8 * F.least(F.lit(10), F.greatest(F.lit(0), F.coalesce(F.size(c["authority"]), F.lit(0))))).cast("bigint"),
        "temporal_relevance": c["validity"].isNotNull().cast("bigint"),
    }


def score(profile: str, c: dict[str, Column]) -> Column:
    if profile not in PROFILES:
        raise ValueError(f"unknown ranking profile {profile!r}")
    s = signals(profile, c)
    total = s["match_quality"] + s["path_relevance"] + s["evidence_support"] + s["authority_metadata"]
    if profile == "historical":
        total = total + 20 * s["temporal_relevance"]
    elif profile == "scholarly":
        total = total + s["evidence_support"] + s["authority_metadata"]
    elif profile == "semantic":
        total = total + F.when(c["match_type"].isin("semantic", "conceptual"), 50).otherwise(0)
    return total.cast("bigint")
