"""Profiling of uploaded text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.functions.text import script_language
from hazardlens.sources.uploads import mapped

# What a missing column means, and how many points of health it costs.
ABSENT = {
    "report_text": ("No report text column detected. Text-based analysis will be unavailable.", 30),
    "sif_label": ("No SIF label column detected. Running AI/rule-based prototype analysis mode.", 10),
    "date": ("No date column detected. Trend analysis will be unavailable.", 10),
    "site": ("No site column detected. Site-level risk analysis will be unavailable.", 5),
    "activity": ("No activity column detected. Activity-level analysis may be limited.", 0),
}
#: Counts of distinct values, and the field whose column they are of.
DISTINCT = {"unique_report_types": "report_type", "unique_activities": "activity", "unique_sites": "site", "unique_locations": "location"}


def profile(df: DataFrame, text: str = "description") -> DataFrame:
    """Rows, empty texts, texts that repeat another (trimmed, lower case), mean length: digests only are shuffled."""
    key = F.md5(F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))))
    kinds = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("size"), F.max((F.trim(F.coalesce(F.col(text), F.lit(""))) == "").cast("int")).alias("empty"))
    out = kinds.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("empty") == 1, F.col("n"))), F.lit(0)).alias("empty"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum("size").alias("size"))
    return out.select("rows", "empty", "duplicates", F.bround(F.col("size") / F.col("rows"), 1).alias("mean_length"))


def languages(df: DataFrame, text: str = "description") -> DataFrame:
    return df.groupBy(script_language(F.col(text)).alias("language")).agg(F.count("*").alias("rows"))


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def dataset(df: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """One row about an uploaded table: sizes, missing values by column, empty and repeated texts, distinct values, labels, warnings, health.

    fields says which column holds which field; without it the names decide
    (`uploads.mapped`). A blank value is missing; texts repeat if they are equal without case and spaces at
    the ends. An empty table has health by its columns alone. Texts are shuffled as digests.
    """
    fields = mapped(df.columns) if fields is None else fields
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    text = F.trim(value(fields["report_text"])) if "report_text" in fields else F.lit("")
    rows = df.select(
        *[(F.trim(value(c)) == "").alias(f"missing{k}") for k, c in enumerate(df.columns)], F.length(text).alias("size"), F.md5(F.lower(text)).alias("digest"),
        *[(F.md5(value(fields[f])) if f in fields else F.lit(None).cast("string")).alias(n) for n, f in DISTINCT.items()],
    )
    counts = rows.agg(
        F.count("*").alias("total_records"), *[F.count_if(f"missing{k}").alias(f"missing{k}") for k in range(len(df.columns))], F.count_if(F.col("size") == 0).alias("blank"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("letters"), F.countDistinct("digest").alias("texts"), *[F.countDistinct(n).alias(n) for n in DISTINCT],
    )
    has = "report_text" in fields
    out = counts.withColumns({
        "total_columns": F.lit(len(df.columns)), "missing_values": F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(f"missing{k}") for k in range(len(df.columns))])),
        "empty_reports": F.col("blank") if has else F.lit(0), "duplicate_records": F.col("total_records") - F.col("texts") if has else F.lit(0), **{f"has_{f}": F.lit(f in fields) for f in ("sif_label", "date", "site", "activity")},
    })
    told = F.col("total_records") - F.col("empty_reports")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total_records")), F.lit(0.0))
    warnings = [F.lit(ABSENT[f][0]) for f in ABSENT if f not in fields]
    warnings.append(F.when(F.col("empty_reports") > 0, F.concat(F.col("empty_reports").cast("string"), F.lit(" reports ("), _half_up(share("empty_reports") * 100).cast("string"), F.lit("%) have missing or empty text."))))
    warnings.append(F.when(F.col("duplicate_records") > 0, F.concat(F.col("duplicate_records").cast("string"), F.lit(" potential duplicate records detected."))))
    lost = sum(points for f, (_, points) in ABSENT.items() if f not in fields)
    health = F.lit(100 - lost) - _half_up(share("empty_reports") * 20) - _half_up(share("duplicate_records") * 10)
    out = out.withColumns({
        "avg_report_length": F.when((told > 0) & F.lit(has), _half_up(F.col("letters") / told)).otherwise(0), "warnings": F.array_compact(F.array(*warnings)), "health_score": F.greatest(F.lit(0), F.least(F.lit(100), health)).cast("int"),
    })
    return out.drop("blank", "letters", "texts", *[f"missing{k}" for k in range(len(df.columns))])


def labels(df: DataFrame, c: str) -> DataFrame:
    """Rows by label; none is Unknown."""
    return df.groupBy(F.trim(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("Unknown"))).alias("label")).agg(F.count("*").alias("rows"))
