"""What a grounded answer rests on: all aggregates and ranked rows of one scope."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hazardlens.operators import aggregates, retrieval, trends


def packet(reports: DataFrame, **scope: str | None) -> dict[str, DataFrame]:
    """Lazy DataFrames over one filtered scan; persist the scope yourself if you run several of them."""
    rows = retrieval.scoped(reports, **scope)
    months = trends.last_months(rows)
    return {
        "totals": aggregates.sif_stats(rows), "levels": aggregates.risk_distribution(rows), "sites": aggregates.top_by(rows, "site", 5), "categories": aggregates.top_by(rows, "category", 5),
        "barriers": aggregates.barrier_frequency(rows), "months": months, "trend": trends.assessed_trend(months), "evidence": retrieval.evidence(rows),
    }
