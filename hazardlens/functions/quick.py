"""A quick look at a report: substrings instead of word forms, one pass over the text, its own lists and bands.

It is for screens that can't wait for the whole analysis, and differs from it on
purpose: barriers by phrases, rules by the number of their words, levels above 80, 60 and 30.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.functions import explain
from hazardlens.functions.narrative import HIGH_HAZARD, any_of
from hazardlens.schema import UNKNOWN_BARRIER

# Words of the rules.
RULES = {
    "Confined Space": (
        "confined space", "vessel entry", "tank entry", "permit", "gas test", "atmospheric", "oxygen", "h2s", "drain", "pit", "sump", "chamber",
        "enclosed",
    ),
    "Energy Isolation": (
        "lockout", "tagout", "loto", "isolation", "energized", "de-energize", "live circuit", "electrical", "voltage", "power source",
        "isolation certificate", "pressure", "stored energy",
    ),
    "Hot Work": (
        "welding", "cutting", "grinding", "hot work", "sparks", "flame", "arc", "torch", "fire watch", "flammable", "ignition", "permit to work",
    ),
    "Working at Height": (
        "height", "scaffold", "ladder", "roof", "platform", "harness", "fall arrest", "elevated", "guardrail", "edge protection", "toe board",
        "fall protection",
    ),
    "Line of Fire": (
        "line of fire", "suspended load", "crane", "lift", "rigging", "exclusion zone", "struck by", "falling object", "overhead", "below load",
    ),
    "Vehicle Movement": (
        "vehicle", "forklift", "hgv", "truck", "reversing", "pedestrian", "banksman", "traffic", "collision", "seat belt", "speeding", "excavator",
        "mobile plant",
    ),
    "Chemical Handling": (
        "chemical", "acid", "caustic", "toxic", "corrosive", "spill", "ppe", "sds", "msds", "inhalation", "exposure", "gas leak", "chlorine",
        "sulfuric", "ammonia",
    ),
    "Fire Prevention": ("fire", "smoke", "detector", "suppression", "extinguisher", "flammable", "combustible", "ignition", "evacuation", "alarm"),
}
# Phrases of failed barriers.
BARRIERS = {
    "Gas Testing Not Completed": ("without gas test", "no gas test", "without atmospheric", "not tested", "not calibrated"),
    "Permit Not Obtained": ("without permit", "no permit", "permit not obtained", "without authorization", "no authorization"),
    "Isolation Not Applied": ("without isolat", "no isolation", "not isolated", "isolation not applied", "without lockout", "without loto"),
    "Lockout/Tagout Not Completed": ("lockout not applied", "tag not applied", "loto not completed", "lock not applied"),
    "Fall Protection Not Used": ("without harness", "no harness", "no fall arrest", "no edge protection", "no guardrail", "fall protection not"),
    "Exclusion Zone Not Established": ("exclusion zone", "no exclusion", "zone not established", "standing under", "below load"),
    "Fire Watch Not Posted": ("no fire watch", "fire watch not", "without fire watch"),
    "Standby Person Not Assigned": ("no standby", "no attendant", "attendant not", "standby not"),
    "PPE Not Available": ("without ppe", "no ppe", "ppe not available", "without protection", "without gloves", "without face shield"),
    "Pressure Not Released": ("not depressurized", "pressure not released", "still under pressure", "pressurized"),
    "Hot Work Permit Not Obtained": ("without hot work permit", "no hot work permit"),
    "Scaffold Not Inspected": ("scaffold not inspected", "not inspected", "uninspected scaffold"),
    "Rescue Plan Not Available": ("rescue not", "no rescue", "rescue team not"),
    "Exposed Live Parts": ("live terminal", "live conductor", "exposed conductor", "exposed terminal", "live wire"),
    "Pedestrian Segregation Not Maintained": ("pedestrian segregat", "segregation not maintained", "barriers removed", "barrier not"),
    "Seat Belt Not Worn": ("without seat belt", "no seat belt", "not wearing seat belt"),
    "Fire Detection Disabled": ("detector disabled", "alarm disabled", "suppression isolated", "detector covered"),
    "Housekeeping Standards Not Met": ("trailing cable", "spilled", "poor lighting", "tools left"),
}
# Words of hazards; the first hazard that has one counts.
HAZARDS = {
    "Oxygen Deficiency": ("oxygen deficient", "low oxygen", "asphyxiation", "o2 level"),
    "Toxic Atmosphere": ("h2s", "hydrogen sulfide", "toxic gas", "gas exposure", "chlorine", "ammonia leak"),
    "Electrical Energy": ("electrical", "live", "energized", "voltage", "current", "electrocution"),
    "Stored Pressure": ("pressurized", "pressure", "hydraulic", "pneumatic"),
    "Fire and Explosion": ("fire", "explosion", "flammable", "ignition", "combustion"),
    "Fall from Height": ("fall", "fell", "height", "elevated", "roof"),
    "Struck by Object": ("struck by", "hit by", "impact", "falling object"),
    "Chemical Exposure": ("chemical", "acid", "caustic", "corrosive", "toxic substance"),
    "Caught in Equipment": ("caught in", "entangled", "trapped", "pinch point"),
    "Vehicle Collision": ("vehicle collision", "struck by vehicle", "run over", "vehicle movement"),
    "Unsafe Entry": ("entered without", "entry without", "gained access without"),
}
# Phrases that are evidence, and such as may end in a serious injury.
EVIDENCE = (
    "confined space", "without gas testing", "without permit", "no permit", "without isolation", "lockout", "tagout", "live circuit", "energized",
    "without harness", "no fall protection", "welding", "hot work", "grinding", "without fire watch", "exclusion zone", "suspended load",
    "without seat belt", "chemical", "acid", "chlorine", "pressurized", "without standby", "no standby", "fire suppression disabled",
    "detector covered", "without ppe", "not wearing ppe", "atmospheric testing", "gas detector", "scaffold not inspected",
)
SERIOUS = (
    "confined space", "without gas testing", "lockout", "without isolation", "energized", "live circuit", "without harness", "suspended load",
    "line of fire", "exclusion zone", "chemical exposure", "toxic gas", "oxygen deficient", "pressurized", "fire suppression disabled", "hot work",
    "without permit", "no permit", "not wearing", "no standby",
)
# Patterns of negation.
STOP = (
    r"\b(?:"
    r"(?:did\s+not|didn't|does\s+not|doesn't|would\s+not|wouldn't|refused\s+to|decided\s+not\s+to|opted\s+not\s+to|declined\s+to)\s+(?:proceed|enter|start|commence|work|operate|continue|execute|climb|step|go\s+into|begin|resume)|"
    r"(?:work|job|entry|task|operation|activity|maintenance|welding|lifting|pour|process)\s+(?:was\s+)?(?:stopped|halted|suspended|aborted|cancelled|put\s+on\s+hold|paused|delayed|refused|prevented|ceased)|"
    r"stopped(?:\s+(?:work|entry|task|job|activity|operation|hot\s+work|maintenance|welding|climbing))?|"
    r"halted(?:\s+(?:work|entry|task|job|activity|operation))?|"
    r"aborted(?:\s+(?:entry|operation|task|job|activity))?|"
    r"suspended(?:\s+(?:work|entry|task|job|activity|operation))?|"
    r"avoided(?:\s+(?:entering|working|climbing|proceeding|operating|starting|entry|work))?|"
    r"refused(?:\s+(?:to\s+enter|to\s+work|to\s+proceed|to\s+climb|to\s+start|entry))?|"
    r"intervened\s+and\s+stopped|"
    r"held\s+back\s+from|"
    r"stayed\s+back\s+from"
    r")\b"
)
NOT_STOPPED = r"\b(?:did\s+not|didn't|failed\s+to|refused\s+to|could\s+not)\s+(?:stop|halt|abort|suspend|cease)\b"
OMISSION = (
    r"\b(?:"
    r"(?:without|with\s+no|no|missing|lack\s+of|absence\s+of|failed\s+to\s+(?:conduct|perform|obtain|wear|apply|use))\s+(?:gas\s+test(?:ing)?|atmospheric\s+test(?:ing)?|permit(?: to work)?|ptw|authorization|isolation|lockout|tagout|loto|harness|fall\s+protection|fall\s+arrest|ppe|safety\s+glasses|gloves|helmet|mask|respirator|fire\s+watch|standby(?:\s+person)?|attendant|ventilation|guardrail|earthing|grounding|chock|banksman)|"
    r"(?:gas\s+test(?:ing)?|permit|ptw|authorization|isolation|lockout|tagout|loto|harness|fall\s+protection|ppe|fire\s+watch|standby|attendant|ventilation|guardrail)\s+(?:was\s+|were\s+)?(?:not\s+(?:done|obtained|conducted|applied|completed|issued|available|present|worn|used|carried\s+out|tested|performed))|"
    r"not\s+wearing\s+(?:ppe|harness|helmet|gloves|safety\s+glasses|mask|respirator|protection|seat\s*belt)|"
    r"not\s+(?:tested|isolated|depressurized|grounded|authorized|inspected)"
    r")\b"
)
UNCLEAR = (
    r"\b(?:"
    r"unclear\s+(?:if|whether)|"
    r"not\s+confirmed\s+(?:if|whether)|"
    r"possibly|"
    r"may\s+have|"
    r"while\s+inspecting|"
    r"inspection\s+only|"
    r"started\s+(?:then|and\s+then)\s+stopped|"
    r"entered\s+(?:then|and\s+then)\s+stopped"
    r")\b"
)
# What to do, by rule.
ACTIONS = {
    "Confined Space": (
        "Stop all confined space entry immediately.", "Complete atmospheric gas testing with a calibrated instrument.",
        "Obtain a valid confined space entry permit.", "Assign a trained standby/rescue person before entry.",
        "Verify all emergency rescue equipment is available.", "Conduct a toolbox talk on confined space requirements before resuming.",
    ),
    "Energy Isolation": (
        "Stop work immediately on all energized equipment.", "Apply lockout/tagout to all energy isolation points.",
        "Verify zero energy state using an appropriate tester.", "Obtain an energy isolation certificate from the authorized person.",
        "Conduct a supervisor verification walkthrough.", "Review and re-brief all maintenance personnel on LOTO procedures.",
    ),
    "Hot Work": (
        "Stop all hot work activities immediately.", "Obtain a valid hot work permit before resuming.",
        "Conduct gas testing in the immediate work area.", "Post a trained fire watch for the duration of hot work plus 30 minutes.",
        "Ensure fire extinguisher is available and serviceable within 5 meters.",
        "Verify flammable materials are removed or protected within exclusion distance.",
    ),
    "Working at Height": (
        "Stop work at height until fall protection controls are in place.", "Inspect and fit all workers with appropriate harnesses and lanyards.",
        "Install guardrails, toe boards, and edge protection.", "Identify and rig suitable anchor points before work resumes.",
        "Ensure scaffold has been formally inspected and tagged.", "Conduct a working-at-height toolbox talk.",
    ),
    "Line of Fire": (
        "Establish and mark exclusion zones around all lifting operations.", "Brief all personnel on line-of-fire hazards before proceeding.",
        "Conduct a formal lift plan review.", "Inspect all rigging equipment for defects.",
        "Appoint a qualified lifting supervisor for all critical lifts.",
    ),
    "Vehicle Movement": (
        "Re-establish pedestrian and vehicle segregation.", "Appoint a banksman for all reversing operations.",
        "Repair or replace malfunctioning reversing alarms.", "Reinstate pedestrian barriers and crossing signage.",
        "Conduct driver briefing on site speed limits and traffic plan.",
    ),
    "Chemical Handling": (
        "Stop chemical handling until appropriate PPE is available.", "Restock PPE station with required chemical-resistant equipment.",
        "Review SDS for all chemicals in use.", "Ensure emergency shower and eyewash station is accessible.",
        "Conduct chemical hazard awareness briefing.",
    ),
    "Fire Prevention": (
        "Reinstate fire suppression and detection systems immediately.", "Conduct an audit of all fire protection equipment.",
        "Report all fire system defects within 4 hours.", "Remove combustible materials from proximity of ignition sources.",
        "Verify fire extinguishers are serviceable and in-date.",
    ),
    "General Safety": (
        "Conduct an immediate inspection of the reported hazard.", "Apply temporary controls to prevent injury while permanent fix is implemented.",
        "Assign a responsible person and set a corrective action due date.", "Review the area for similar hazards.",
    ),
}
#: Phrases of evidence that are kept.
MOST = 8


def _found(lower: Column, phrases: Iterable[str]) -> Column:
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(lower, p))


def _first(lower: Column, groups: dict[str, tuple[str, ...]], other: str) -> Column:
    return reduce(lambda acc, g: acc.when(any_of(lower, g[1]), g[0]), groups.items(), F.when(F.lit(False), "")).otherwise(other)


def look(df: DataFrame, text: str = "description", severity: str | None = None, kind: str | None = None, activity: str | None = None) -> DataFrame:
    """df with quick_rule, quick_barriers, quick_hazard, quick_activity, quick_negation, quick_score, quick_level, quick_sif, quick_confidence, quick_evidence and quick_actions.

    A null text is an empty one. No row needs another; each list is tried once a row.
    """
    told = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c else F.lit("")
    rows = df.withColumns({"_low": told(text), "_sev": told(severity), "_kind": told(kind)})
    low, sev, kinds = F.col("_low"), F.col("_sev"), F.col("_kind")
    hits = F.array(*[F.struct((-F.size(_found(low, words))).alias("less"), F.lit(k).alias("at"), F.lit(rule).alias("rule")) for k, (rule, words) in enumerate(RULES.items())])
    barriers = F.array_compact(F.array(*[F.when(any_of(low, phrases), F.lit(b)) for b, phrases in BARRIERS.items()]))
    known = F.col(activity) if activity else F.lit(None).cast("string")
    near = F.regexp_extract_all(low, F.lit(r"(?:without|no|not|missing|absent)\s+\w+(?:\s+\w+)?"), F.lit(0))
    rows = rows.withColumns({
        "_best": F.array_min(hits), "quick_barriers": barriers, "quick_hazard": _first(low, HAZARDS, "General Hazard"), "quick_activity": explain.activity(low, known),
        "quick_evidence": F.slice(F.array_distinct(F.concat(_found(low, EVIDENCE), near)), 1, MOST),
        **{f"_{n}": low.rlike(p) for n, p in (("stop", STOP), ("unstopped", NOT_STOPPED), ("omits", OMISSION), ("unclear", UNCLEAR))},
    })
    negation = (
        F.when(F.trim(low) == "", "NONE").when(F.col("_unclear"), "AMBIGUOUS").when(F.col("_unstopped") & F.col("_omits"), "UNSAFE_VIOLATION")
        .when(F.col("_stop") & ~F.col("_unstopped"), "SAFE_PREVENTIVE").when(F.col("_omits"), "UNSAFE_VIOLATION").otherwise("NONE")
    )
    rows = rows.withColumns({"quick_rule": F.when(F.col("_best.less") < 0, F.col("_best.rule")).otherwise("General Safety"), "_hits": -F.col("_best.less"), "quick_negation": negation, "_n": F.size("quick_barriers")})
    rule, n, ruled = F.col("quick_rule"), F.col("_n"), F.col("quick_rule") != "General Safety"
    safe, unclear = F.col("quick_negation") == "SAFE_PREVENTIVE", F.col("quick_negation") == "AMBIGUOUS"
    hazard = F.when(sev.contains("critical") | ruled, 28).when(sev.contains("high"), 22).when(sev.contains("medium"), 14).when(sev.contains("low"), 6).otherwise(15)
    failed = F.when(n == 0, F.when(F.col("quick_negation") == "UNSAFE_VIOLATION", 25).otherwise(5)).otherwise(F.least(F.lit(35), 25 + (n - 1) * 5))
    exposed = F.when(any_of(low, ("two worker", "crew", "multiple")), 20).when(any_of(low, ("worker", "technician", "operator")), 16).otherwise(8)
    critical = F.when(any_of(low, [r.lower() for r in HIGH_HAZARD]) | rule.isin(*HIGH_HAZARD), 10).otherwise(5)
    again = F.when(kinds.contains("incident"), 15).when(kinds.contains("near miss"), 12).when(kinds.contains("unsafe act"), 10).when(kinds.contains("unsafe condition"), 8).otherwise(5)
    doubtful = F.when(ruled, 18).otherwise(10) + F.when(n > 0, F.least(F.lit(20), 12 + (n - 1) * 4)).otherwise(12) + 20
    score = F.when(safe, F.when(ruled, 18).otherwise(13)).when(unclear, doubtful).otherwise(F.least(F.lit(100), hazard + failed + exposed + critical + again))
    rows = rows.withColumn("quick_score", score.cast("int"))
    s = F.col("quick_score")
    level = F.when(safe, "LOW").when(unclear, "MEDIUM").when(s > 80, "CRITICAL").when(s > 60, "HIGH").when(s > 30, "MEDIUM").otherwise("LOW")
    serious = F.when(safe, "NO").when(unclear, "UNKNOWN").when(any_of(low, SERIOUS) | (s >= 70), "YES").when(s <= 30, "NO").otherwise("UNKNOWN")
    words = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    role, act = low.rlike(explain.ROLES), low.rlike(explain.ACTS)
    # In hundredths, so that no rounding has ties.
    sure = (
        50 + F.when(F.col("_hits") >= 2, 15).when(F.col("_hits") == 1, 8).otherwise(-5) + F.when(n >= 2, 15).when(n == 1, 10).otherwise(-5) + F.when(F.size("quick_evidence") >= 2, 5).otherwise(0)
        + F.when(role & act, 10).when(role | act, 5).otherwise(0) + F.when(unclear, -35).when(F.col("quick_negation") != "NONE", 5).otherwise(0) + F.when(words < 4, -20).otherwise(0)
    )
    actions = reduce(lambda acc, r: acc.when(rule == r[0], F.array(*[F.lit(a) for a in r[1]])), ACTIONS.items(), F.when(F.lit(False), F.array().cast("array<string>")))
    rows = rows.withColumns({"quick_level": level, "quick_sif": serious, "quick_confidence": F.least(F.lit(98), F.greatest(F.lit(20), sure)) / 100, "quick_actions": actions})
    first = F.coalesce(F.try_element_at("quick_barriers", F.lit(1)), F.lit(UNKNOWN_BARRIER))
    return rows.withColumn("quick_barrier", first).drop("_low", "_sev", "_kind", "_best", "_hits", "_n", "_stop", "_unstopped", "_omits", "_unclear")
