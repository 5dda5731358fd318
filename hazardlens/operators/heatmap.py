"""Six-level risk roll-up: site, unit, area, activity, rule, barrier.

One expand and one shuffle produce all levels (grouping sets); the tree is only
built where it is shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlens.operators.aggregates import is_level, is_sif
from hazardlens.operators.trends import period_percent
from hazardlens.schema import FALLBACK_NAMES

LEVELS = ("site", "unit", "area", "activity", "category", "barrier_failure")
#: Parts of a place in which its newest reports are found first where Spark doesn't limit them before the shuffle.
SALTS = 64
LIMITED = "spark.sql.optimizer.windowGroupLimitThreshold"
NAMES = {"site": "Site Alpha", "unit": "Not Specified", "area": "Not Specified", "activity": "General Operation", "category": "General Safety", "barrier_failure": "Unspecified"}


def filtered(df: DataFrame, **values: str | None) -> DataFrame:
    """Equality on the levels given; blank and `all` are no filter."""
    for c, v in values.items():
        if v and v.strip() and v.strip().lower() != "all":
            df = df.filter(F.col(c) == v.strip())
    return df


def nodes(df: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """A row per node: level (1 for sites), path, counts, density, mean, 30-day trend and risk level."""
    day = F.try_to_date(F.substring(F.trim("date"), 1, 10), "yyyy-MM-dd")
    rows = df.select(*[F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(NAMES[c])).alias(c) for c in levels], "risk_score", "risk_level", "sif_potential", day.alias("day"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("day").alias("anchor"))))
    now = F.col("day").between(F.date_sub("anchor", 29), F.col("anchor"))
    past = (F.col("day") >= F.date_sub("anchor", 59)) & (F.col("day") < F.date_sub("anchor", 29))
    out = rows.rollup(*levels).agg(
        F.count("*").alias("reports"), F.count_if(is_sif()).alias("sif"), F.count_if(is_level("CRITICAL")).alias("critical"), F.bround(F.avg("risk_score"), 1).alias("mean_score"),
        F.count_if(is_sif() & now).alias("current_sif"), F.count_if(is_sif() & past).alias("previous_sif"), F.datediff(F.max("anchor"), F.min("day")).alias("span"), F.grouping_id().alias("gid"),
    )
    depth = len(levels) - F.bit_count("gid")
    out = out.withColumn("level", depth.cast("int")).filter("level > 0").withColumn("trend_percent", period_percent("current_sif", "previous_sif", "span"))
    high = (F.col("sif") >= 3) | (F.col("mean_score") >= 70) | (F.col("critical") > 0)
    risk = F.when(high, "HIGH").when((F.col("sif") >= 1) & (F.col("trend_percent") >= 15), "EMERGING").when((F.col("mean_score") >= 50) | (F.col("sif") >= 1), "MEDIUM").otherwise("LOW")
    density = F.bround(F.col("sif") * 100.0 / F.col("reports"), 1)
    change = F.concat(F.when(F.col("trend_percent") > 0, "+").otherwise(""), F.col("trend_percent").cast("string"), F.lit("% vs prev 30d"))
    label = F.when(F.col("trend_percent").isNull(), "Insufficient data").when(F.col("previous_sif") > 0, change).when(F.col("current_sif") > 0, "+100% vs prev 30d").otherwise("0.0% vs prev 30d")
    return out.select("level", *levels, "reports", "sif", "critical", density.alias("density"), "mean_score", "trend_percent", label.alias("trend_label"), risk.alias("node_level"))


def summary(tree: DataFrame) -> DataFrame:
    """Totals, how many nodes are high (sites, units, areas) or emerging (sites, units), and where the mean score is greatest.

    Units and areas with placeholder names don't count. Of equal means the first by site, then the site before its units, by name.
    """
    site, named = F.col("level") == 1, lambda c: ~F.coalesce(F.lower(F.trim(c)), F.lit("")).isin(*FALLBACK_NAMES)
    counted = (F.col("level") == 1) | ((F.col("level") == 2) & named("unit")) | ((F.col("level") == 3) & named("area"))
    eligible = (site & named("site")) | ((F.col("level") == 2) & named("unit"))
    name = F.when(site, F.concat("site", F.lit(" (Risk: "), "node_level", F.lit(", SIF: "), F.col("sif").cast("string"), F.lit(")"))).otherwise(F.concat("site", F.lit(" → "), "unit", F.lit(" ("), "node_level", F.lit(")")))
    first = F.struct((-F.col("mean_score")).alias("score"), F.col("site"), F.col("level"), F.coalesce("unit", F.lit("")).alias("unit"))
    out = tree.agg(
        F.sum(F.when(site, F.col("reports"))).alias("reports"), F.sum(F.when(site, F.col("sif"))).alias("sif"), F.count_if(counted & (F.col("node_level") == "HIGH")).alias("high"),
        F.count_if(counted & (F.col("level") <= 2) & (F.col("node_level") == "EMERGING")).alias("emerging"), F.min_by(F.when(eligible, name), F.when(eligible, first)).alias("top_concentration"),
    )
    return out.withColumn("density", F.bround(F.col("sif") * 100.0 / F.col("reports"), 1)).withColumn("top_concentration", F.coalesce("top_concentration", F.lit("None detected")))


def _seen() -> Column:
    """Where a report stands in the list that is read from the newest to the oldest; reports without a time come last."""
    return F.struct(F.col("created_at").isNull().alias("late"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("time"), F.col("report_id").alias("id"))


def _real(c: str) -> Column:
    return F.when(~F.coalesce(F.lower(F.trim(c)), F.lit("")).isin(*FALLBACK_NAMES), F.trim(c))


def dominant(counts: DataFrame, by: list[str]) -> DataFrame:
    """`top_barrier` of each group of rows with barrier, rule, n and seen.

    The most frequent real barrier, the most frequent rule where there is none,
    Unspecified without either; of equally frequent ones the one seen first. Counts are added up
    for each name before the groups meet, so a group's rows are its names.
    """
    barrier, rule = F.col("barrier").isNotNull(), F.nullif(F.trim("rule"), F.lit(""))
    name = F.explode(F.array_compact(F.array(F.when(barrier, F.struct(F.lit(0).alias("rank"), F.col("barrier").alias("name"))), F.when(rule.isNotNull(), F.struct(F.lit(1).alias("rank"), rule.alias("name"))))))
    names = counts.select(*by, "n", "seen", name.alias("named")).groupBy(*by, "named").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    return names.groupBy(*by).agg(F.min_by("named.name", F.struct("named.rank", -F.col("n"), "seen")).alias("top_barrier"))


def _cells(df: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """The reports' places, with missing names filled in, their real barrier and rule."""
    return df.select(*[F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(NAMES[c])).alias(c) for c in levels], _real("barrier_failure").alias("barrier"), F.col("category").alias("rule"), "report_id", _seen().alias("seen"))


def members(df: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """level, path (array of names from the site down) and report_id: every report in every node that holds it; no shuffle."""
    path = F.explode(F.array(*[F.array(*levels[: k + 1]) for k in range(len(levels))])).alias("path")
    return _cells(df, levels).select(path, "report_id").select(F.size("path").alias("level"), "path", "report_id")


def detailed(df: DataFrame, ids: int = 20, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """nodes() with top_barrier, and report_ids: the newest `ids` reports of each node; members() has them all.

    Rows are first added up for each path down to the barrier; the upper levels are
    made from these. Every task keeps the newest reports of a path that it has read
    before the tasks' rows meet, so that no task holds a place with very many reports;
    Spark does so up to LIMITED reports, beyond that SALTS parts of a path come first.
    """
    rows = _cells(df, levels)
    cells = rows.groupBy(*levels, "barrier", "rule").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))
    paths = F.explode(F.array(*[F.array(*levels[: k + 1]) for k in range(len(levels))])).alias("path")
    top = dominant(cells.select(paths, "barrier", "rule", "n", "seen"), ["path"])
    # At the lowest level the node is the barrier.
    top = top.withColumn("top_barrier", F.when(F.size("path") == len(LEVELS), F.element_at("path", -1)).otherwise(F.coalesce("top_barrier", F.lit("Unspecified")))) if levels == LEVELS else top
    first = lambda df, by: df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("seen"))).filter(F.col("nth") <= ids).drop("nth")
    newest = rows.select(*levels, "seen")
    if ids > int(df.sparkSession.conf.get(LIMITED)):
        newest = first(newest.withColumn("part", F.pmod(F.xxhash64("seen.id"), F.lit(SALTS))), [*levels, "part"]).drop("part")
    newest = first(newest, list(levels))
    newest = first(newest.select(paths, "seen"), ["path"]).groupBy("path").agg(F.transform(F.array_sort(F.collect_list("seen")), lambda x: x["id"]).alias("report_ids"))
    tree = nodes(df, levels).withColumn("path", F.slice(F.array(*levels), 1, F.col("level")))
    return tree.join(top, "path", "left").join(newest, "path", "left").drop("path")


def top_barrier(df: DataFrame, by: str) -> DataFrame:
    """The dominant barrier of each group of reports."""
    rows = df.select(by, _real("barrier_failure").alias("barrier"), F.col("category").alias("rule"), _seen().alias("seen"))
    counts = rows.groupBy(by, "barrier", "rule").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))
    return dominant(counts, [by])
