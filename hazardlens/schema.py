"""The reports table, its children and their fixed vocabularies."""

from __future__ import annotations

from pyspark.sql.types import IntegerType, StringType, StructField, StructType, TimestampType

# Names that results must carry as they are.
LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
RULES = ("Confined Space", "Energy Isolation", "Hot Work", "Working at Height", "Line of Fire", "Vehicle Movement", "Chemical Handling", "Fire Prevention", "General Safety")
UNKNOWN_BARRIER = "Unknown Barrier Failure"
FALLBACK_NAMES = ("not specified", "unspecified", "general unit", "general area", "general operation", "unknown barrier failure", "unknown barrier", "unknown", "")
PLACEHOLDER_BARRIERS = ("Unspecified", "Unknown", UNKNOWN_BARRIER)

#: Column, type and default of a report.
REPORT_COLUMNS = (
    ("report_id", "string", None), ("content_hash", "string", None), ("description", "string", None), ("category", "string", "General Safety"),
    ("risk_level", "string", "LOW"), ("risk_score", "int", 0), ("sif_potential", "string", "NO"), ("site", "string", "Site Alpha"),
    ("unit", "string", "Not Specified"), ("area", "string", "Not Specified"), ("activity", "string", "General Operation"),
    ("barrier_failure", "string", "Unspecified"), ("pii_detected", "int", 0), ("pii_count", "int", 0), ("pii_types", "string", ""), ("date", "string", None), ("created_at", "timestamp", None),
)
_types = {"string": StringType(), "int": IntegerType(), "timestamp": TimestampType()}
REPORTS = StructType([StructField(n, _types[t], n not in ("report_id", "description")) for n, t, _ in REPORT_COLUMNS])
