"""Lists as the pages show them: filters, sorting, paging, status values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.operators.ordinals import numbered
from hazardlens.schema import LEVELS

# States of an action and decisions of a review.
STATUSES = ("OPEN", "IN_PROGRESS", "COMPLETED", "OVERDUE")
DECISIONS = ("CONFIRMED", "CORRECTED", "REJECTED")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def by_id(df: DataFrame, value: str, id_col: str = "report_id") -> DataFrame:
    """The row with an id, if there is one."""
    return df.filter(F.col(id_col) == value).limit(1)


def searched(df: DataFrame, search: str | None = None, level: str | None = None) -> DataFrame:
    """Rows whose description contains a text in any case, of one level; blanks and names that are no level don't filter.

    % and _ in the text stand for any characters, as in LIKE.
    """
    if search and search.strip():
        df = df.filter(F.col("description").ilike(f"%{search.strip()}%"))
    if level and level.strip().upper() in LEVELS:
        df = df.filter(F.upper("risk_level") == level.strip().upper())
    return df


def listed(df: DataFrame, search: str = "", sif: str = "", level: str = "", category: str = "") -> DataFrame:
    """Rows whose description, id or category contains a text in any case, with the values that are given."""
    if search:
        wanted = F.lit(search.lower())
        df = df.filter(_any([F.contains(F.lower(c), wanted) for c in ("description", "report_id", "category")]))
    for c, v in (("sif_potential", sif), ("risk_level", level), ("category", category)):
        if v and v.lower() != "all":
            df = df.filter(F.col(c) == v)
    return df


def any_column_contains(df: DataFrame, search: str) -> DataFrame:
    """Rows in which any column, as text, contains a text in any case."""
    return df.filter(_any([F.contains(F.lower(F.col(f"`{c}`").cast("string")), F.lit(search.lower())) for c in df.columns]))


def status(c: Column) -> Column:
    """A state of an action in upper case with underscores; what is none stays as it is, trimmed."""
    v = F.replace(F.upper(F.trim(c)), F.lit(" "), F.lit("_"))
    return F.when(v.isin(*STATUSES), v).otherwise(F.trim(c))


def validated(df: DataFrame, c: str, allowed: tuple[str, ...] = DECISIONS) -> tuple[DataFrame, DataFrame]:
    """Rows with an allowed value, in upper case, and the others as they are."""
    ok = F.coalesce(F.upper(F.trim(c)).isin(*allowed), F.lit(False))
    return df.filter(ok).withColumn(c, F.upper(F.trim(c))), df.filter(~ok)


def resolved(df: DataFrame, c: str, wanted: str) -> DataFrame:
    """The stored value that a name means: equal in any case, else one that contains it; the first by name. No row if none does."""
    name = F.lower(F.lit(wanted.strip()))
    values = df.select(F.col(c).alias("value")).filter(F.col(c).isNotNull() & (F.col(c) != "")).distinct()
    rank = F.when(F.lower("value") == name, 0).when(F.contains(F.lower("value"), name), 1)
    return values.withColumn("rank", rank).filter("rank IS NOT NULL").orderBy("rank", "value").limit(1).select("value")


def natural(c: Column) -> list[Column]:
    """Sort keys of a text: numbers by value before other texts, these in lower case."""
    number = F.try_to_number(F.regexp_extract(c, r"^\s*(-?\d{1,15})\s*$", 1), F.lit("S999999999999999"))
    return [number.isNull(), number, F.lower(c)]


def sorted_by(df: DataFrame, c: str, descending: bool = False, id_col: str = "report_id") -> DataFrame:
    """Rows by any column, numbers in texts by their value, ties by id."""
    keys = natural(F.col(c).cast("string"))
    return df.orderBy(*[(k.desc() if descending else k.asc()) for k in keys], id_col)


def newest(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.orderBy(F.desc("created_at"), *ids)


def pages(df: DataFrame, size: int = 20) -> DataFrame:
    """Rows and how many pages of `size` they fill."""
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def effective_date(df: DataFrame) -> DataFrame:
    """`date`, where it is blank the day on which the row was created."""
    return df.withColumn("date", F.coalesce(F.nullif("date", F.lit("")), F.date_format("created_at", "yyyy-MM-dd")))


def numbered_ids(df: DataFrame, order: str, prefix: str = "RPT-") -> DataFrame:
    """report_id from the place in the order, at least four digits: RPT-0001.

    Ranges of the order are numbered in parallel: only one count per range is gathered.
    """
    number = F.col("_number").cast("string")
    width = F.greatest(F.lit(4), F.length(number))
    return numbered(df, [order], "_number", 1).withColumn("report_id", F.concat(F.lit(prefix), F.lpad(number, width, F.lit("0")))).drop("_number")
