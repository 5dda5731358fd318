"""Personal data in free text: what identifies a person gives way to placeholders.

The steps are ordered, and later ones see the placeholders of earlier ones. Names
need a look at a list of words that must stay, which a replacement in SQL can't
do, so all steps run in one Arrow-batched function.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

FOUND = StructType([StructField("text", StringType()), StructField("count", IntegerType()), StructField("types", ArrayType(StringType()))])

# Words that are never redacted.
KEPT = frozenset([
    "worker", "workers", "technician", "technicians", "operator", "operators", "contractor", "contractors", "supervisor", "supervisors", "engineer", "engineers",
    "electrician", "electricians", "welder", "welders", "rigger", "riggers", "driver", "drivers", "auditor", "auditors", "officer", "officers", "crew", "team",
    "hse", "safety manager", "site manager", "banksman", "attendant", "standby",
    "confined space", "energy isolation", "hot work", "working at height", "line of fire", "vehicle movement", "chemical handling", "fire prevention",
    "general safety", "near miss", "unsafe act", "unsafe condition", "incident",
    "pump", "motor", "reactor", "vessel", "tank", "compressor", "pipe", "pipeline", "valve", "boiler", "substation", "generator", "crane", "forklift", "scaffold",
    "scaffolding", "ladder", "harness", "breaker", "switchgear", "panel", "electrical panel", "manifold", "flange", "turbine", "chiller", "conveyor",
    "refinery", "unit", "area", "workshop", "fabrication", "terminal", "storage", "tank farm", "control room", "switchgear room", "transfer station", "bay",
    "site alpha", "site beta", "site gamma", "site delta", "manifold section",
    "lockout", "tagout", "loto", "permit", "ptw", "ppe", "gas test", "atmospheric", "atmospheric testing", "oxygen", "h2s", "safety glasses", "gloves", "helmet",
    "respirator", "mask", "face shield", "ear protection", "fall arrest", "barrier", "isolation", "fire watch", "pre-entry", "inspection", "maintenance", "overhaul",
    "ventilation", "grounding", "earthing", "chock",
])

# Patterns of the steps.
_name = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}"
_email = re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", re.IGNORECASE)
_employee = re.compile(r"\b(?:(?:Employee|Emp|Worker|Staff|Badge)\s*(?:ID|Number|No|#)\s*[:#\-]?\s*([A-Za-z0-9\-]{2,15})|(?:ID\s*[:#\-]\s*([A-Za-z0-9\-]{2,15}))|\b(?:DEMO|EMP|WRK|STF)[-_][0-9]{3,8}\b)\b", re.IGNORECASE)
_phone = re.compile(
    r"(?:(?:\+?91[-.\s]?)?[6-9]\d{9}\b|(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b|\b555[-.\s]?\d{3,4}[-.\s]?\d{4}\b|\b555[-.\s]?\d{4}\b|\b\d{3}[-.]\d{3}[-.]\d{4}\b)"
)
_address = re.compile(r"\b\d{1,5}\s+[A-Za-z0-9\s.,]{3,30}\b(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Apartment|Apt|Suite|Ste|Floor|Fl|Cross|Layout|Nagar|Colony)\b", re.IGNORECASE)
# The first and the last of the name patterns ignore case, so their names may be in lower case.
_name_before_id = re.compile(rf"\b({_name})\s*(?:\(\s*(?:Employee|Emp|Staff|Badge|Worker\s*ID|ID)|,\s*(?:Employee|Emp|Staff|Badge|Worker\s*ID|ID))\b", re.IGNORECASE)
_name_before_placeholder = re.compile(rf"\b({_name})\s*\(\s*\[EMPLOYEE_ID\]\)")
_name_after_role = re.compile(rf"\b(Worker|Technician|Operator|Contractor|Engineer|Employee|Supervisor|Auditor|Officer|Staff|Driver|Welder|Mechanic|Electrician|Rigger|Specialist)\s+({_name})\b")
_name_after_title = re.compile(rf"\b(Mr\.|Mrs\.|Ms\.|Dr\.)\s+({_name})\b")
_name_before_verb = re.compile(rf"\b({_name})\s+(?:reported|called|phoned|contacted|notified|stated|witnessed|observed|informed|escalated|intervened|halted|stopped)\b")
_name_after_label = re.compile(rf"\b(?:Name|Reporter|Observer|Injured Person)\s*[:=]\s*({_name})\b", re.IGNORECASE)

# Parts that every match of a step holds; they are found faster than the names before them.
_id_after = re.compile(r"[(,]\s*(?:Employee|Emp|Staff|Badge|Worker\s*ID|ID)\b", re.IGNORECASE)
_verb_after = re.compile(r"\s(?:reported|called|phoned|contacted|notified|stated|witnessed|observed|informed|escalated|intervened|halted|stopped)\b")
_at, _placeholder = re.compile("@"), re.compile(r"\[EMPLOYEE_ID\]\)")


def kept(words: str) -> bool:
    """Whether a candidate, or each of its words, must stay."""
    words = words.strip().lower()
    return words in KEPT or all(w in KEPT for w in words.split())


def redact(text: str | None) -> tuple[str | None, int, list[str]]:
    """The text with placeholders, the number of replacements and their kinds in order of name."""
    if not text:
        return text, 0, []
    found: list[str] = []

    def step(pattern: re.Pattern, kind: str, group: int = 0, put: str | None = None, stays=kept, needs: re.Pattern | None = None) -> None:
        """Replace a group of each match, or the whole match by `put`, unless the candidate stays. No match is without `needs`."""
        nonlocal text
        if needs is not None and not needs.search(text):
            return

        def one(m: re.Match) -> str:
            if stays(m[group]):
                return m[0]
            found.append(kind)
            return m.expand(put) if put else m[0].replace(m[group], f"[{kind}]", 1)

        text = pattern.sub(one, text)

    never = lambda _: False
    step(_email, "EMAIL", stays=never, needs=_at)
    step(_employee, "EMPLOYEE_ID", stays=never)
    step(_phone, "PHONE", stays=lambda m: sum(c.isdecimal() for c in m) < 7)
    step(_address, "ADDRESS")
    step(_name_before_id, "WORKER_NAME", 1, needs=_id_after)
    step(_name_before_placeholder, "WORKER_NAME", 1, "[WORKER_NAME] ([EMPLOYEE_ID])", needs=_placeholder)
    step(_name_after_role, "WORKER_NAME", 2, r"\1 [WORKER_NAME]")
    step(_name_after_title, "WORKER_NAME", 2, "[WORKER_NAME]")
    step(_name_before_verb, "WORKER_NAME", 1, needs=_verb_after)
    step(_name_after_label, "WORKER_NAME", 1)
    return text, len(found), sorted(set(found))


@F.pandas_udf(FOUND)
def redacted(texts: pd.Series) -> pd.DataFrame:
    """struct<text, count, types> of a column of texts; null stays null."""
    return pd.DataFrame([redact(t) for t in texts], columns=["text", "count", "types"])
