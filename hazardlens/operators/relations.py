"""Joins between reports and their children, set operations, checks between stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_actions(reports: DataFrame, actions: DataFrame) -> DataFrame:
    """Every report with its number of actions; actions are added up before the join."""
    n = actions.groupBy("report_id").agg(F.count("*").alias("actions"), F.count_if(F.col("status") == "OPEN").alias("open"))
    return reports.join(n, "report_id", "left").select("report_id", F.coalesce("actions", F.lit(0)).alias("actions"), F.coalesce("open", F.lit(0)).alias("open"))


def orphans(actions: DataFrame, reports: DataFrame) -> DataFrame:
    """Actions of reports that don't exist; an action without report id is none."""
    return actions.filter(F.col("report_id").isNotNull()).join(reports.select("report_id"), "report_id", "left_anti")


def with_report(actions: DataFrame, reports: DataFrame) -> DataFrame:
    return actions.join(reports.select("report_id"), "report_id", "left_semi")


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Reports whose score or SIF differs between two stores."""
    x, y = a.select("report_id", "risk_score", "sif_potential"), b.select("report_id", F.col("risk_score").alias("other_score"), F.col("sif_potential").alias("other_sif"))
    return x.join(y, "report_id").filter((F.col("risk_score") != F.col("other_score")) | (F.col("sif_potential") != F.col("other_sif")))


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the least `order` of each key: partial minima, then a semi-join."""
    return df.groupBy(key).agg(F.min(order).alias(order))
