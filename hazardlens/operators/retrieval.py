"""Filters, ranking and search over reports."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEARCHED = ("description", "site", "unit", "area", "activity", "category", "barrier_failure", "report_id")


def scoped(df: DataFrame, date_from: str | None = None, date_to: str | None = None, **equal: str | None) -> DataFrame:
    """Equality filters and an inclusive range of dates as text; null dates drop out of a range."""
    for c, v in equal.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    if date_from is not None:
        df = df.filter(F.col("date") >= date_from)
    if date_to is not None:
        df = df.filter(F.col("date") <= date_to)
    return df


def matching(df: DataFrame, words: list[str]) -> DataFrame:
    """Rows in which any of up to six words occurs in any searched column, in any case."""
    tests = [F.col(c).ilike(f"%{w}%") for w in words[:6] for c in SEARCHED]
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])) if tests else df


def words_of(question: str, stop: frozenset[str] = frozenset()) -> list[str]:
    """The words of a question to search for: two characters or more, no stop word, in their order."""
    return [w for w in re.findall(r"[a-z0-9_-]{2,}", question.lower()) if w not in stop]


def similar(df: DataFrame, n: int = 4) -> DataFrame:
    """For every report up to n others of its rule, the newest: report_id, similar_id, place.

    The n + 1 newest of each rule are found first (Spark keeps that many per task
    before it shuffles), one row per rule; they are broadcast, as rules are a fixed few.
    """
    newest = Window.partitionBy("category").orderBy(F.desc("created_at"), "report_id")
    few = df.select("category", "report_id", "created_at").withColumn("at", F.row_number().over(newest)).filter(F.col("at") <= n + 1)
    few = few.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "report_id"))), lambda x: x["report_id"]).alias("ids"))
    others = F.slice(F.filter("ids", lambda i: i != F.col("report_id")), 1, n)
    out = df.select("report_id", "category").join(F.broadcast(few), "category").select("report_id", F.posexplode(others).alias("at", "similar_id"))
    return out.select("report_id", "similar_id", (F.col("at") + 1).cast("int").alias("place"))


def evidence(df: DataFrame, n: int = 8) -> DataFrame:
    """SIF reports first, then by score and date; the n best."""
    first = F.when(F.col("sif_potential") == "YES", 0).otherwise(1)
    return df.orderBy(first, F.desc("risk_score"), F.desc("date"), "report_id").limit(n)


def evidence_for(df: DataFrame, words: list[str], n: int = 8) -> DataFrame:
    """The n best of the rows in which a word occurs; where none does, the n best of all. `by_words` tells which.

    Both lists are top-n aggregates; one of them is chosen over their 2 n rows.
    """
    found = evidence(matching(df, words), n).withColumn("by_words", F.lit(bool(words[:6])))
    best = evidence(df, n).withColumn("by_words", F.lit(False))
    both = found.unionByName(best) if words[:6] else best
    any_found = F.max("by_words").over(Window.partitionBy(F.lit(1)))
    return both.withColumn("_any", any_found).filter(F.col("by_words") == F.col("_any")).drop("_any")


def page(df: DataFrame, offset: int, n: int) -> DataFrame:
    return df.orderBy(F.desc("created_at"), "report_id").offset(offset).limit(n)


def priority(df: DataFrame, n: int = 20) -> DataFrame:
    return df.filter(F.col("risk_level").isin("CRITICAL", "HIGH")).orderBy(F.desc("risk_score"), "report_id").limit(n)


def last_turns(conversations: DataFrame, n: int = 6) -> DataFrame:
    """The last n turns of every conversation."""
    by = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return conversations.withColumn("back", F.row_number().over(by)).filter(F.col("back") <= n)


def nearest(vectors: DataFrame, query: list[float], k: int, least: float | None = None) -> DataFrame:
    """Cosine similarity to one vector; the bound applies after the k best are chosen."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    score = dot(F.col("embedding"), q) / (F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(dot(q, q)))
    out = vectors.select("report_id", F.bround(F.greatest(score, F.lit(0.0)), 6).alias("score")).orderBy(F.desc("score"), "report_id").limit(k)
    return out if least is None else out.filter(F.col("score") >= least)


def nearest_of(vectors: DataFrame, reports: DataFrame, query: list[float], k: int, least: float | None = None) -> DataFrame:
    """The k nearest among the vectors of the given reports, with the reports' site and level."""
    within = vectors.join(reports.select("report_id"), "report_id", "left_semi")
    return nearest(within, query, k, least).join(reports.select("report_id", "site", "risk_level"), "report_id")
