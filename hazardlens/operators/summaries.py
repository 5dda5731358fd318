"""Small aggregates and derived values beside the dashboard's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlens.operators import aggregates
from hazardlens.operators.aggregates import is_level, is_sif, present
from hazardlens.schema import LEVELS

# Percent by which a control lowers the score, by rule; the last is for rules without their own.
CONTROLS = {
    "Confined Space": {"gas_test": 25, "permit": 20, "standby": 18, "ventilation": 12},
    "Energy Isolation": {"loto": 30, "verify": 20, "cert": 15, "supervisor": 10},
    "Hot Work": {"permit": 25, "gas_check": 22, "fire_watch": 18, "extinguisher": 10},
    "Working at Height": {"harness": 28, "anchor": 20, "guardrail": 18, "scaffold_inspect": 12},
    "Line of Fire": {"exclusion": 30, "lift_plan": 20, "rig_inspect": 15, "supervisor": 12},
    "": {"ptw": 20, "ppe": 12, "toolbox": 8, "supervisor": 10},
}
MOST_REDUCTION, LEAST_SCORE = 75, 5


def summary_totals(df: DataFrame) -> DataFrame:
    """Reports, SIF reports with their share, critical ones; no row for an empty table."""
    out = df.agg(F.count("*").alias("total_reports"), F.count_if(F.col("sif_potential") == "YES").alias("sif_potential"), F.count_if(F.col("risk_level") == "CRITICAL").alias("critical_count"))
    return out.filter("total_reports > 0").withColumn("sif_percentage", F.bround(F.col("sif_potential") * 100.0 / F.col("total_reports"), 1))


def most_frequent(df: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n most frequent values; null and empty ones are Unknown; ties by name."""
    name = F.coalesce(F.nullif(by, F.lit("")), F.lit("Unknown")).alias("name")
    return df.groupBy(name).agg(F.count("*").alias("reports")).orderBy(F.desc("reports"), "name").limit(n)


def top_category(df: DataFrame) -> DataFrame:
    """The most frequent rule, ties by name, or N/A."""
    counts = df.filter(present("category")).groupBy("category").agg(F.count("*").alias("n"))
    best = counts.agg(F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("top_category"))
    return best.select(F.coalesce("top_category", F.lit("N/A")).alias("top_category"))


def level_shares(df: DataFrame) -> DataFrame:
    """Levels that occur, in their order, with their rounded percentage of all reports."""
    rows = aggregates.risk_distribution(df).filter("reports > 0")
    whole = F.sum("reports").over(Window.partitionBy())
    return rows.select("position", "risk_level", "reports", F.floor(F.col("reports") * 100.0 / whole + 0.5).cast("int").alias("percent"))


def sites_to_watch(df: DataFrame, n: int = 5) -> DataFrame:
    return aggregates.site_stats(df).filter("risk_level <> 'LOW'").orderBy(F.desc("total"), "site").limit(n)


def open_actions(actions: DataFrame, n: int = 5) -> DataFrame:
    return actions.filter("status = 'OPEN'").orderBy("deadline", "report_id", "line").limit(n)


def pattern_shares(patterns: DataFrame, total: int) -> DataFrame:
    """Each pattern's share of all reports in percent, at most 100."""
    share = F.floor(F.col("frequency") * 100.0 / max(1, total) + 0.5)
    return patterns.withColumn("share", F.least(F.lit(100), share).cast("int"))


def months_covered(df: DataFrame) -> DataFrame:
    """First and last month, SIF and critical reports."""
    month = F.when(F.substring("date", 1, 7).rlike(r"^\d{4}-\d{2}$"), F.substring("date", 1, 7))
    return df.agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"), F.count_if(is_sif()).alias("sif"), F.count_if(is_level("CRITICAL")).alias("critical"))


def drill_down(tree: DataFrame, levels: tuple[str, ...], **path: str) -> DataFrame:
    """Children of the node at a path (site=..., unit=..., in the order of levels); the top without one."""
    depth = len(path)
    rows = tree.filter(F.col("level") == depth + 1)
    for c in levels[:depth]:
        rows = rows.filter(F.col(c) == path[c])
    return rows


def factor_shares(df: DataFrame, factors: str = "factors") -> DataFrame:
    """Total of the factors' points of each row and each factor's rounded percentage of it."""
    total = F.aggregate(factors, F.lit(0), lambda s, f: s + f["points"])
    part = lambda f: F.struct(f["name"].alias("name"), F.when(F.col("total") > 0, F.floor(f["points"] * 100.0 / F.col("total") + 0.5)).otherwise(0).cast("int").alias("percent"))
    return df.withColumn("total", total).withColumn("shares", F.transform(factors, part))


def legacy_values(df: DataFrame) -> DataFrame:
    """SIF and level from the score alone; bands are open at their lower ends."""
    s = F.coalesce("risk_score", F.lit(0))
    level = F.when(s > 80, "CRITICAL").when(s > 60, "HIGH").when(s > 30, "MEDIUM").otherwise("LOW")
    return df.withColumns({"sif_potential": F.when(s >= 70, "YES").otherwise("NO"), "risk_level": level})


def gauge(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(100))


def what_if(df: DataFrame, chosen: Column) -> DataFrame:
    """Score after the chosen controls (array of names): each rule's own percentages, at most 75 together, at least 5 left."""
    table = F.create_map(*[x for rule, controls in CONTROLS.items() for x in (F.lit(rule), F.create_map(*[F.lit(v) for pair in controls.items() for v in pair]))])
    own = F.coalesce(F.try_element_at(table, F.col("category")), F.try_element_at(table, F.lit("")))
    cut = F.aggregate(F.array_distinct(chosen), F.lit(0), lambda s, name: s + F.coalesce(F.try_element_at(own, name), F.lit(0)))
    left = F.floor(F.col("risk_score") * (1 - F.least(cut, F.lit(MOST_REDUCTION)) / 100) + 0.5)
    return df.withColumn("simulated_score", F.greatest(F.lit(LEAST_SCORE), left).cast("int"))


def latest_versions(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, the one with the greatest version: an update is an appended row."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), version).alias("_row"))
    return best.select(*keys, "_row.*")


def upserted(stored: DataFrame, new: DataFrame, dim: int, model: str) -> DataFrame:
    """Vectors after an upsert: valid new ones (a number in each of dim places) take the place of those with their report and model."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = new.filter(F.coalesce((F.size("embedding") == dim) & finite, F.lit(False))).withColumn("model_id", F.lit(model))
    return latest_versions(stored.unionByName(valid), ["report_id", "model_id"], "created_at")


def without_parents(children: DataFrame, deleted: DataFrame, key: str = "report_id") -> DataFrame:
    """What a cascading delete of parents leaves of their children."""
    return children.join(deleted.select(key), key, "left_anti")


def with_columns_of(df: DataFrame, columns: tuple[tuple[str, str, object], ...]) -> DataFrame:
    """All columns (name, type, default): missing ones are added, nulls filled where there is a default."""
    have = set(df.columns)
    value = lambda n, t, d: (F.col(n).cast(t) if n in have else F.lit(None).cast(t)) if d is None else F.coalesce(F.col(n).cast(t), F.lit(d).cast(t)) if n in have else F.lit(d).cast(t)
    return df.select(*[value(n, t, d).alias(n) for n, t, d in columns])


def refreshed(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of each aggregate, all computed anew."""
    counts = [df.agg(F.lit(name).alias("aggregate"), F.count("*").alias("rows")) for name, df in parts.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
