"""Flat aggregates over reports: one pass and one shuffle on a narrow key each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlens.schema import LEVELS, PLACEHOLDER_BARRIERS, UNKNOWN_BARRIER


def is_level(level: str) -> Column:
    return F.upper("risk_level") == level


def is_sif() -> Column:
    return F.upper("sif_potential") == "YES"


def present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def risk_distribution(df: DataFrame) -> DataFrame:
    """All four levels in one row each, also those without reports."""
    spark = df.sparkSession
    names = spark.range(len(LEVELS)).select((F.col("id") + 1).cast("int").alias("position"), F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("id") + 1).cast("int")).alias("risk_level"))
    counts = df.groupBy(F.upper("risk_level").alias("risk_level")).agg(F.count("*").alias("n"))
    return names.join(counts, "risk_level", "left").select("position", "risk_level", F.coalesce("n", F.lit(0)).alias("reports"))


def sif_stats(df: DataFrame) -> DataFrame:
    """Yes and no counts and the share of yes among all, unknown ones included."""
    out = df.agg(F.count_if(is_sif()).alias("sif_yes"), F.count_if(F.upper("sif_potential") == "NO").alias("sif_no"), F.count("*").alias("total"))
    return out.withColumn("sif_percent", F.when(F.col("total") > 0, F.bround(F.col("sif_yes") * 100.0 / F.col("total"), 1)).otherwise(F.lit(0.0)))


def ranked_places(df: DataFrame, by: str) -> DataFrame:
    """Counts, truncated mean score and level of each site or activity."""
    mean = F.bround(F.avg("risk_score"), 1)
    out = df.filter(present(by)).groupBy(by).agg(F.count("*").alias("total"), F.count_if(is_level("CRITICAL")).alias("critical"), F.count_if(is_sif()).alias("sif"), mean.alias("mean"))
    level = F.when((F.col("critical") > 0) | (F.col("mean") >= 75), "CRITICAL").when(F.col("mean") >= 50, "HIGH").otherwise("MEDIUM")
    return out.select(by, "total", "critical", "sif", F.col("mean").cast("int").alias("risk_score"), level.alias("risk_level")).orderBy(F.desc("total"), by)


def site_stats(df: DataFrame) -> DataFrame:
    return ranked_places(df, "site")


def activity_stats(df: DataFrame) -> DataFrame:
    return ranked_places(df, "activity")


def category_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count("*").alias("reports")).orderBy(F.desc("reports"), "category")


def dashboard(df: DataFrame) -> DataFrame:
    """Everything that the dashboard shows, in one pass."""
    levels = [F.count_if(is_level(v)).alias(v.lower()) for v in LEVELS]
    out = df.agg(F.count("*").alias("total"), F.coalesce(F.bround(F.avg("risk_score"), 1), F.lit(0.0)).alias("mean_score"), F.count_if(is_sif()).alias("sif_yes"), *levels)
    most = F.greatest(*[F.col(v.lower()) for v in LEVELS])
    top = F.coalesce(*[F.when(F.col(v.lower()) == most, v) for v in LEVELS])
    return out.withColumn("top_level", top)


def dashboard_bundle(df: DataFrame) -> DataFrame:
    """One row: dashboard() with SIF shares, the reports of each named rule and the most frequent one; N/A where there is none.

    Rules are counted first, so that one row a rule makes the whole. Of equally frequent rules the first by name counts.
    """
    levels = [F.count_if(is_level(v)).alias(v.lower()) for v in LEVELS]
    rules = df.groupBy("category").agg(F.count("*").alias("n"), F.sum("risk_score").alias("points"), F.count("risk_score").alias("scored"), F.count_if(is_sif()).alias("sif"), F.count_if(F.upper("sif_potential") == "NO").alias("no"), *levels)
    named = F.col("category").isNotNull() & (F.col("category") != "")
    total = F.coalesce(F.sum("n"), F.lit(0))
    one = rules.agg(
        total.alias("total"), F.coalesce(F.bround(F.try_divide(F.sum("points"), F.sum("scored")), 1), F.lit(0.0)).alias("mean_score"), F.coalesce(F.sum("sif"), F.lit(0)).alias("sif_yes"), F.coalesce(F.sum("no"), F.lit(0)).alias("sif_no"),
        *[F.coalesce(F.sum(v.lower()), F.lit(0)).alias(v.lower()) for v in LEVELS], F.collect_list(F.when(named, F.struct((-F.col("n")).alias("less"), F.col("category").alias("category")))).alias("found"),
    )
    one = one.withColumn("found", F.array_sort("found"))
    most = F.greatest(*[F.col(v.lower()) for v in LEVELS])
    level = F.when(most > 0, F.coalesce(*[F.when(F.col(v.lower()) == most, v) for v in LEVELS])).otherwise("N/A")
    return one.select(
        "total", "mean_score", "sif_yes", "sif_no", F.coalesce(F.bround(F.try_divide(F.col("sif_yes") * 100.0, F.col("total")), 1), F.lit(0.0)).alias("sif_percent"),
        *[v.lower() for v in LEVELS], level.alias("top_level"), F.map_from_entries(F.transform("found", lambda x: F.struct(x["category"], -x["less"]))).alias("by_category"),
        F.coalesce(F.try_element_at("found", F.lit(1))["category"], F.lit("N/A")).alias("top_category"),
    )


def command_center(df: DataFrame, actions: DataFrame) -> DataFrame:
    high = F.col("risk_level").isin("CRITICAL", "HIGH")
    one = df.agg(F.count_if(F.col("risk_level") == "CRITICAL").alias("critical"), F.count_if(F.col("sif_potential") == "YES").alias("sif"), F.count_distinct(F.when(high, F.col("site"))).alias("sites_at_risk"))
    # Two results of one row each.
    two = actions.agg(F.count_if(F.col("status") == "OPEN").alias("open_actions"))
    return one.crossJoin(F.broadcast(two)).withColumn("immediate", F.least("critical", F.lit(4)))


def field_population(df: DataFrame, fields: tuple[str, ...] = ("site", "unit", "area", "activity", "category", "barrier_failure", "date")) -> DataFrame:
    return df.agg(*[F.count_if(present(c)).alias(c) for c in fields])


def dataset_version(df: DataFrame) -> DataFrame:
    return df.agg(F.concat_ws("_", F.count("*").cast("string"), F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss")).alias("version"))


def top_by(df: DataFrame, by: str, n: int) -> DataFrame:
    """Count, SIF count and mean score of the n largest groups."""
    return df.filter(present(by)).groupBy(by).agg(F.count("*").alias("reports"), F.count_if(is_sif()).alias("sif"), F.bround(F.avg("risk_score"), 1).alias("mean_score")).orderBy(F.desc("reports"), by).limit(n)


def barrier_frequency(df: DataFrame, n: int = 8) -> DataFrame:
    real = F.col("barrier_failure").isNotNull() & ~F.col("barrier_failure").isin(*PLACEHOLDER_BARRIERS)
    return df.filter(real).groupBy("barrier_failure").agg(F.count("*").alias("reports"), F.count_if(is_sif()).alias("sif")).orderBy(F.desc("reports"), "barrier_failure").limit(n)


def legacy_patterns(df: DataFrame) -> DataFrame:
    """Rule and barrier pairs that occur twice or more, numbered by frequency."""
    real = (F.col("category") != "General Safety") & F.col("barrier_failure").isNotNull() & (F.col("barrier_failure") != UNKNOWN_BARRIER)
    name = F.concat_ws(" + ", "category", "barrier_failure").alias("name")
    out = df.filter(real).groupBy(name).agg(F.count("*").alias("frequency"), F.count_distinct(F.when(present("site"), F.col("site"))).alias("sites"), (F.count_if(is_sif()) / F.count("*")).alias("share")).filter("frequency >= 2")
    level = F.when(F.col("share") > 0.7, "CRITICAL").when(F.col("share") > 0.4, "HIGH").when(F.col("share") > 0.1, "MEDIUM").otherwise("LOW")
    # One row per pair of rule and barrier: a small, bounded result is numbered.
    number = F.row_number().over(Window.orderBy(F.desc("frequency"), "name"))
    return out.select(F.concat(F.lit("PAT-"), number.cast("string")).alias("pattern_id"), "name", "frequency", "sites", level.alias("risk_level"))


def legacy_site_risk(df: DataFrame) -> DataFrame:
    site = F.coalesce(F.nullif("site", F.lit("")), F.lit("Unknown")).alias("site")
    out = df.groupBy(site).agg(F.count("*").alias("total_reports"), F.count_if(F.col("sif_potential") == "YES").alias("sif_count"), F.count_if(F.col("risk_level") == "CRITICAL").alias("critical_count"))
    score = F.bround(F.col("sif_count") / F.col("total_reports") * 70 + F.col("critical_count") / F.col("total_reports") * 30, 0).cast("int")
    out = out.withColumn("risk_score", score)
    return out.withColumn("risk_level", F.when(F.col("risk_score") > 50, "CRITICAL").when(F.col("risk_score") > 35, "HIGH").when(F.col("risk_score") > 15, "MEDIUM").otherwise("LOW"))


def activity_risk(df: DataFrame) -> DataFrame:
    """Mean of the scores above zero; bands are open at their lower ends."""
    out = df.filter(present("activity")).groupBy("activity").agg(F.count("*").alias("reports"), F.count_if(is_sif()).alias("sif"), F.floor(F.coalesce(F.avg(F.when(F.col("risk_score") > 0, F.col("risk_score"))), F.lit(0.0)) + 0.5).cast("int").alias("mean_score"))
    return out.withColumn("risk_level", F.when(F.col("mean_score") > 80, "CRITICAL").when(F.col("mean_score") > 60, "HIGH").when(F.col("mean_score") > 30, "MEDIUM").otherwise("LOW"))


def barrier_histogram(df: DataFrame, n: int = 10) -> DataFrame:
    """Reports per barrier and their rounded share of all; the total over the few groups is a window."""
    out = df.filter(present("barrier_failure")).groupBy("barrier_failure").agg(F.count("*").alias("reports"))
    whole = F.sum("reports").over(Window.partitionBy())
    return out.withColumn("percent", F.floor(F.col("reports") * 100.0 / whole + 0.5).cast("int")).orderBy(F.desc("reports"), "barrier_failure").limit(n)


def early_warnings(df: DataFrame) -> DataFrame:
    """Up to four warnings from one pass; previous values are estimates by fixed factors, not measurements."""
    confined = F.col("category").contains("Confined Space") | F.coalesce(F.col("activity").contains("Confined Space"), F.lit(False))
    energy = F.col("category").contains("Energy Isolation") | F.coalesce(F.col("barrier_failure").contains("Isolation"), F.lit(False))
    one = df.agg(F.count("*").alias("n"), F.count_if(F.col("sif_potential") == "YES").alias("sif"), F.count_if(confined).alias("confined"), F.count_if(energy).alias("energy"), F.count_if(F.col("risk_level") == "CRITICAL").alias("critical"))
    rows = [("EW-001", "CRITICAL", "sif", F.col("sif") > F.col("n") * 0.4, 0.7, 30), ("EW-002", "WARNING", "confined", F.col("confined") >= 3, 0.65, 35), ("EW-003", "WARNING", "energy", F.col("energy") >= 3, 0.72, 28), ("EW-004", "CRITICAL", "critical", F.col("critical") > F.col("n") * 0.25, 0.75, 25)]
    parts = [F.when(cond, F.struct(F.lit(i).alias("warning_id"), F.lit(k).alias("kind"), F.col(c).alias("current_value"), F.floor(F.col(c) * factor + 0.5).cast("long").alias("previous_value"), F.lit(pct).alias("change_percent"))) for i, k, c, cond, factor, pct in rows]
    return one.select(F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("w")).select("w.*")


def z_scores(df: DataFrame) -> DataFrame:
    """Score against the dataset's mean and sample deviation; a small deviation falls back to a hundredth of the score."""
    stats = df.agg(F.coalesce(F.avg("risk_score"), F.lit(50.0)).alias("mean"), F.coalesce(F.stddev_samp("risk_score"), F.lit(20.0)).alias("sd"))
    z = F.when(F.col("sd") < 5, F.col("risk_score") / 100.0).otherwise((F.col("risk_score") - F.col("mean")) / F.col("sd"))
    # The statistics are one row.
    return df.crossJoin(F.broadcast(stats)).select("report_id", F.bround(z, 2).alias("normalized_score"), (F.col("sd") >= 5).alias("normalized"))


def action_counters(actions: DataFrame) -> DataFrame:
    s = F.upper("status")
    return actions.agg(F.count_if(s.contains("OPEN")).alias("open"), F.count_if(s.contains("PROGRESS")).alias("in_progress"), F.count_if(s.contains("COMPLETE")).alias("completed"))


def rule_distribution(df: DataFrame, n: int = 8) -> DataFrame:
    return df.groupBy("category").agg(F.count("*").alias("reports"), F.count_if(is_sif()).alias("sif")).orderBy(F.desc("reports"), "category").limit(n)
