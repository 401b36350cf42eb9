"""The quality gate of extracted relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    min_confidence: float = 0.0
    heuristic_min_confidence: float = 0.55
    approved_confidence: float = 0.7
    include_reviewable: bool = True


def review_status(confidence: Column, method: Column, policy: Policy) -> Column:
    heuristic, model = method.startswith("heuristic:"), method.startswith("claude:")
    return (
        F.when(confidence.isNull() | F.isnan(confidence) | (confidence < policy.min_confidence), "rejected_low_confidence")
        .when(heuristic & (confidence < policy.heuristic_min_confidence), "rejected_heuristic_low_confidence")
        .when(heuristic | (model & (confidence < policy.approved_confidence)), "review")
        .otherwise("approved")
    )


def gate(relations: DataFrame, policy: Policy = Policy(), confidence: str = "conf", method: str = "method") -> DataFrame:
    """relations with review_status and load_decision (load or exclude); without a confidence a relation is rejected."""
    rows = relations.withColumn("review_status", review_status(F.col(confidence), F.col(method), policy))
    out = F.col("review_status").startswith("rejected")
    if not policy.include_reviewable:
        out = out | (F.col("review_status") == "review")
    return rows.withColumn("load_decision", F.when(out, "exclude").otherwise("load"))
