"""Uploaded files: reading, binding of columns, and the append-only store.

Everything is read as text. A file needs a description column; the other columns
are optional and get defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.functions.text import content_hash, normalized, report_date
from hazardlens.lineage import cut
from hazardlens.operators.listing import natural
from hazardlens.schema import LEVELS

# Accepted headers, in order of priority.
ALIASES = {
    "description": ("description", "report_text", "observation", "text", "details", "incident_description", "safety_observation"),
    "report_id": ("report_id", "id", "incident_id", "report_number", "rpt_id"),
    "severity": ("severity", "risk_severity", "severity_level", "risk_level"),
    "report_type": ("report_type", "type", "category_input", "incident_type", "category", "life_saving_rule"),
    "date": ("date", "incident_date", "timestamp", "datetime", "created_date", "time"),
    "site": ("site", "plant", "facility", "installation", "location", "workplace"),
    "unit": ("unit", "operating_unit", "plant_unit", "process_unit", "refinery_unit", "facility_unit"),
    "area": ("area", "work_area", "zone", "section", "location_area", "bay", "sector"),
    "barrier_failure": ("barrier_failure", "barrier", "failed_barrier", "control_failure", "barrier_type"),
    "activity": ("activity", "task", "work", "operation", "job"),
}
DEFAULTS = {"site": "Site Alpha", "unit": "Not Specified", "area": "Not Specified", "activity": "General Operation"}
SHORTEST = 5


# Extensions that are accepted, and the largest file in bytes.
EXPORTED = ("id", "description", "category", "risk_score", "risk_level", "sif_potential", "created_at")
EXTENSIONS, LARGEST = (".csv", ".xlsx", ".xls"), 15 * 1024 * 1024
# Words by which headers are found that have no alias; a header may contain one.
HINTS = {
    "report_text": ("report_text", "text", "description", "observation", "narrative", "report", "detail", "comment"),
    "sif_label": ("sif", "sif_potential", "sif_label", "serious", "fatality", "label"),
    "severity": ("severity", "risk", "level", "criticality", "priority"),
    "report_type": ("report_type", "type", "category", "classification"),
    "site": ("site", "plant", "facility", "installation"),
    "unit": ("unit", "operating_unit", "plant_unit", "refinery_unit"),
    "area": ("area", "zone", "section", "work_area", "bay", "sector"),
    "location": ("location", "place", "loc"),
    "activity": ("activity", "task", "work_type", "job_type", "operation"),
    "date": ("date", "incident_date", "report_date", "timestamp", "created_at", "reported_on"),
    "barrier_failure": ("barrier", "control_failure", "failed_barrier", "barrier_failure"),
    "recommended_action": ("recommendation", "action", "corrective", "recommended_action", "remedy"),
    "life_saving_rule": ("rule", "lsr", "life_saving_rule", "safety_rule", "critical_rule"),
}


def checked(path: str, size: int) -> None:
    """Raise unless the file has an accepted extension, some bytes and not too many."""
    if not path.lower().endswith(EXTENSIONS):
        raise ValueError(f"unsupported file type; accepted are {', '.join(EXTENSIONS)}")
    if size == 0:
        raise ValueError("the file is empty")
    if size > LARGEST:
        raise ValueError(f"the file has over {LARGEST >> 20} MB")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and md5 of the files at a path: the ledger by which a file is known again."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.md5("content").alias("file_hash"))


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A CSV file as text columns; nothing is taken for null, quoted fields may span lines, empty lines are skipped.

    Without an encoding, a file that isn't UTF-8 is read as Latin-1. An upload has 15
    MB at most; it is read by one task because a quoted field may hold a line break.
    """
    if encoding is None:
        bad = spark.read.format("binaryFile").load(path).filter(~F.is_valid_utf8(F.col("content").cast("string")))
        encoding = "UTF-8" if bad.isEmpty() else "ISO-8859-1"
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
    return rows.na.drop("all").na.fill("")


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook as text columns; needs openpyxl, which pandas reads it with."""
    import pandas as pd

    rows = pd.read_excel(path, dtype=str, keep_default_na=False)
    return spark.createDataFrame(rows.fillna("")).select(*[F.col(f"`{c}`").cast("string").alias(str(c)) for c in rows.columns])


def mapped(columns: list[str]) -> dict[str, str]:
    """Fields and the columns that hold them: the first column that equals or contains the first hint that any does."""
    lower = [(c.lower().strip(), c) for c in columns]
    out = {}
    for field, hints in HINTS.items():
        found = next((c for h in hints for low, c in lower if h in low), None)
        if found is not None:
            out[field] = found
    return out


def bind(df: DataFrame) -> DataFrame:
    """Known columns under their own names; of several headers for a column the first alias wins."""
    headers = {c.strip().lower(): c for c in reversed(df.columns)}
    found = {name: next((headers[a] for a in aliases if a in headers), None) for name, aliases in ALIASES.items()}
    if found["description"] is None:
        raise ValueError("no description column; expected one of " + ", ".join(ALIASES["description"]))
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(n) for n, c in found.items()])


def prepared(df: DataFrame, as_of: str) -> DataFrame:
    """Bound rows as reports: defaults, dates, content hash; too short descriptions are left out."""
    text = normalized(F.col("description"))
    filled = {c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(v)) for c, v in DEFAULTS.items()}
    rows = df.withColumn("description", text).filter(F.length("description") >= SHORTEST).withColumns(filled).withColumn("date", report_date(F.col("date"), as_of))
    rows = rows.withColumn("content_hash", content_hash(F.col("description"), F.col("date"), F.col("site")))
    return rows.withColumn("report_id", F.coalesce(F.nullif(F.trim("report_id"), F.lit("")), F.col("content_hash")))


def accepted(rows: DataFrame, order: str = "row_number") -> DataFrame:
    """Rows in their order, each unless an accepted row before it has its id or its content.

    A row is accepted in the round in which it is the first of all undecided rows
    with its id and with its content; rows that share a key with it go. Every round
    is two group-bys on digests and decides at least the first row of each group,
    so few rounds do; lineage is cut after each.
    """
    keys = rows.select(F.col(order).alias("at"), "report_id", "content_hash")
    open_, taken = cut(keys), None
    while not open_.isEmpty():
        least = lambda key: open_.groupBy(key).agg(F.min("at").alias(f"first_{key}"))
        marked = open_.join(least("report_id"), "report_id").join(least("content_hash"), "content_hash")
        now = cut(marked.filter((F.col("at") == F.col("first_report_id")) & (F.col("at") == F.col("first_content_hash"))).select("at", "report_id", "content_hash"))
        taken = now if taken is None else taken.unionByName(now)
        rest = open_.join(now.select("report_id"), "report_id", "left_anti").join(now.select("content_hash"), "content_hash", "left_anti")
        open_ = cut(rest.select("at", "report_id", "content_hash"))
    return rows.limit(0) if taken is None else rows.join(taken.select(F.col("at").alias(order)), order, "left_semi")


def new_rows(rows: DataFrame, stored: DataFrame, order: str = "row_number") -> DataFrame:
    """Rows whose id and content are neither stored nor those of an accepted row before them."""
    rows = rows.join(stored.select("report_id"), "report_id", "left_anti").join(stored.select("content_hash"), "content_hash", "left_anti")
    return accepted(rows, order)


def summary(prepared_rows: DataFrame, read: int, inserted: int) -> DataFrame:
    """What an upload did: counts over all rows that were long enough, duplicates included.

    read is the number of rows in the file, inserted how many were new. prepared_rows
    has risk_level, sif_potential and pii_count.
    """
    levels = [F.count_if(F.col("risk_level") == v).alias(v.lower()) for v in LEVELS]
    out = prepared_rows.agg(F.count("*").alias("processed"), *levels, F.count_if(F.col("sif_potential") == "YES").alias("sif"), F.count_if(F.col("pii_count") > 0).alias("pii_rows"), F.coalesce(F.sum("pii_count"), F.lit(0)).alias("pii_total"))
    return out.select(F.lit(read).cast("long").alias("total_rows"), "processed", (F.lit(read) - F.col("processed")).alias("skipped"), F.lit(inserted).cast("long").alias("inserted"), (F.col("processed") - inserted).alias("duplicates"), *[v.lower() for v in LEVELS], "sif", "pii_rows", "pii_total")


def skipped(bound: DataFrame, order: str = "row_number", most: int = 20) -> DataFrame:
    """The first rows that were left out, and why."""
    size = F.length(normalized(F.col("description")))
    reason = F.concat(F.lit("Row "), (F.col(order) + 2).cast("string"), F.lit(": description is empty or too short (got "), size.cast("string"), F.lit(" chars)."))
    return bound.filter(size < SHORTEST).orderBy(order).limit(most).select(order, reason.alias("reason"))


def sample(rows: DataFrame, order: str = "row_number", n: int = 5) -> DataFrame:
    return rows.orderBy(order).limit(n)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled; one file per task, so that it stays distributed."""
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').mode("overwrite").csv(path)


def export_sorted(rows: DataFrame, path: str, by: str, descending: bool = False, parts: int | None = None, id_col: str = "report_id") -> None:
    """The EXPORTED columns as CSV files whose order by name is the order of `by` (numbers by value, ties by id).

    Rows are dealt into ranges of the order and sorted there, so the files, each with
    a header, can be put one after the other. Nulls are empty, all fields quoted.
    """
    keys = [k.desc() if descending else k.asc() for k in natural(F.col(by).cast("string"))] + [F.col(id_col).asc()]
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    shown = [F.coalesce(F.col(id_col if c == "id" else c).cast("string"), F.lit("")).alias(c) for c in EXPORTED]
    dealt.sortWithinPartitions(*keys).select(*shown).write.option("header", True).option("quoteAll", True).option("escape", '"').mode("overwrite").csv(path)
