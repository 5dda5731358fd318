"""Monthly series, trends, period comparison and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlens.operators.aggregates import is_level, is_sif, ranked_places


def monthly(df: DataFrame) -> DataFrame:
    """Reports, SIF and critical ones per month; rows without a year-month prefix are left out."""
    month = F.substring(F.trim("date"), 1, 7)
    return df.withColumn("month", month).filter(F.col("month").rlike(r"^\d{4}-\d{2}$")).groupBy("month").agg(F.count("*").alias("total"), F.count_if(is_sif()).alias("sif"), F.count_if(is_level("CRITICAL")).alias("critical"))


def monthly_or_current(df: DataFrame, as_of: str) -> DataFrame:
    """The monthly series; if no date has a month, one row for the month of the given day with all reports."""
    series = monthly(df)
    whole = df.agg(F.count("*").alias("total"), F.count_if(is_sif()).alias("sif"), F.count_if(is_level("CRITICAL")).alias("critical")).filter("total > 0")
    # Both sides are one row.
    none = series.agg(F.count("*").alias("months")).filter("months = 0").select()
    return series.unionByName(whole.crossJoin(F.broadcast(none)).select(F.lit(as_of[:7]).alias("month"), "total", "sif", "critical"))


def last_months(df: DataFrame, n: int = 12) -> DataFrame:
    return monthly(df).orderBy(F.desc("month")).limit(n)


def _numbered(series: DataFrame) -> DataFrame:
    """A monthly series has one row a month, so numbering it in one task is bounded."""
    return series.withColumn("at", F.row_number().over(Window.orderBy("month"))).withColumn("n", F.count("*").over(Window.partitionBy()))


def trend(series: DataFrame, value: str = "total") -> DataFrame:
    """RISING RISK, IMPROVING or STABLE from the means of both halves; too little data is STABLE."""
    x = _numbered(series)
    half = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    out = x.agg(
        F.max("n").alias("periods"), F.sum(value).alias("total"), F.avg(F.when(F.col("at") <= half, F.col(value))).alias("early"), F.avg(F.when(F.col("at") > half, F.col(value))).alias("late"),
        F.max(F.when(F.col("at") == 1, F.col(value))).alias("first"), F.max(F.when(F.col("at") == F.col("n"), F.col(value))).alias("last"),
    )
    delta = F.when(F.col("early") > 0, (F.col("late") - F.col("early")) / F.col("early") * 100).otherwise(0.0)
    few = F.coalesce(F.col("periods") < 2, F.lit(True)) | F.coalesce(F.col("total") < 10, F.lit(True))
    rising = (delta >= 20) | ((F.col("last") > F.col("first")) & (F.col("last") >= 2 * F.col("first")))
    label = F.when(few, "STABLE").when(rising, "RISING RISK").when(delta <= -20, "IMPROVING").otherwise("STABLE")
    return out.select("periods", "total", F.bround(F.coalesce(delta, F.lit(0.0)), 4).alias("delta_percent"), label.alias("trend"))


def assessed_trend(series: DataFrame) -> DataFrame:
    """Direction only from three months and ten reports on."""
    x = _numbered(series)
    half = F.floor(F.col("n") / 2)
    out = x.agg(F.count("*").alias("months"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.avg(F.when(F.col("at") <= half, F.col("total"))).alias("early"), F.avg(F.when(F.col("at") > half, F.col("total"))).alias("late"))
    ok = (F.col("months") >= 3) & (F.col("total") >= 10)
    delta = (F.col("late") - F.col("early")) / F.col("early") * 100
    way = F.when(F.col("early") == 0, F.when(F.col("late") > 0, "INCREASING").otherwise("STABLE")).when(delta >= 20, "INCREASING").when(delta <= -20, "DECREASING").otherwise("STABLE")
    return out.select("months", "total", ok.alias("assessable"), F.when(ok, way).alias("direction"))


def month_anomaly(series: DataFrame) -> DataFrame:
    """The last month, if it has half as many reports again as the mean of all before it."""
    x = _numbered(series).withColumn("baseline", F.avg("total").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)))
    spike = (F.col("at") == F.col("n")) & (F.col("n") >= 3) & (F.col("baseline") > 0) & (F.col("total") >= 1.5 * F.col("baseline")) & (F.col("total") >= 3)
    return x.filter(spike).select("month", "total", F.bround(F.col("total") / F.col("baseline"), 1).alias("ratio"))


def site_anomalies(df: DataFrame) -> DataFrame:
    """Sites with 1.8 times the mean of all sites and four reports or more."""
    every = Window.partitionBy()
    x = ranked_places(df, "site").select("site", "total").withColumn("mean", F.avg("total").over(every)).withColumn("sites", F.count("*").over(every))
    return x.filter((F.col("sites") >= 2) & (F.col("total") >= 1.8 * F.col("mean")) & (F.col("total") >= 4)).select("site", "total", F.bround(F.col("total") / F.col("mean"), 1).alias("ratio"))


def period_trend(df: DataFrame, by: list[str]) -> DataFrame:
    """SIF reports of the last 30 days against the 30 before, anchored at the latest day of the whole table."""
    day = F.try_to_date(F.substring(F.trim("date"), 1, 10), "yyyy-MM-dd")
    rows = df.withColumn("day", day)
    # The anchor is one row.
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("day").alias("anchor"))))
    now = F.col("day").between(F.date_sub("anchor", 29), F.col("anchor"))
    past = (F.col("day") >= F.date_sub("anchor", 59)) & (F.col("day") < F.date_sub("anchor", 29))
    out = rows.groupBy(*by).agg(F.count_if(is_sif() & now).alias("current_sif"), F.count_if(is_sif() & past).alias("previous_sif"), F.datediff(F.max("anchor"), F.min("day")).alias("span"))
    return out.select(*by, "current_sif", "previous_sif", period_percent("current_sif", "previous_sif", "span").alias("trend_percent"))


def period_percent(now: str, past: str, span: str):
    change = F.when(F.col(past) > 0, F.bround((F.col(now) - F.col(past)) / F.col(past) * 100, 1)).when(F.col(now) > 0, 100.0).otherwise(0.0)
    return F.when(F.col(span) >= 14, change)
