"""Why an analysis says what it says: evidence, reasons, factors, confidence, validation, actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlens.functions import narrative as n
from hazardlens.schema import RULES, UNKNOWN_BARRIER

# Phrases that are evidence by themselves, and rule words of the confidence.
KEY_PHRASES = (
    "confined space", "without gas testing", "without permit", "no permit", "without isolation", "lockout", "live circuit", "without harness", "welding", "without fire watch", "exclusion zone", "without standby",
    "no standby", "not wearing ppe", "entry without testing", "without testing", "before atmospheric testing", "without checking the atmosphere", "without atmospheric monitoring",
)
RULE_WORDS = {
    "Confined Space": ("confined space", "vessel", "vessel entry", "tank", "tank entry", "gas test", "atmospheric", "oxygen", "h2s", "drain", "pit", "sump", "chamber", "manhole", "column", "reactor"),
    "Energy Isolation": ("lockout", "tagout", "loto", "isolation", "energized", "de-energize", "live circuit", "electrical", "voltage", "stored energy", "switchgear", "breaker"),
    "Hot Work": ("welding", "cutting", "grinding", "hot work", "sparks", "flame", "arc", "torch", "fire watch", "flammable", "brazing"),
    "Working at Height": ("height", "scaffold", "ladder", "roof", "platform", "harness", "fall arrest", "elevated", "guardrail", "edge protection", "manlift", "cherry picker"),
    "Line of Fire": ("line of fire", "suspended load", "crane", "lift", "rigging", "exclusion zone", "struck by", "falling object", "below load", "overhead load"),
    "Vehicle Movement": ("vehicle", "forklift", "hgv", "truck", "reversing", "pedestrian", "banksman", "traffic", "collision", "seat belt", "speeding", "excavator"),
    "Chemical Handling": ("chemical", "acid", "caustic", "toxic", "corrosive", "spill", "ppe", "inhalation", "exposure", "gas leak", "chlorine", "ammonia"),
    "Fire Prevention": ("fire", "smoke", "detector", "suppression", "extinguisher", "flammable", "combustible", "sprinkler"),
}
ROLES = r"\b(worker|workers|technician|technicians|operator|operators|crew|team|electrician|welder|supervisor|contractor|personnel)\b"
ACTS = r"\b(entered|proceeded|working|climbed|welding|operating|started|stopped|halted|avoided|refused|conducted|performed|inspected)\b"
HIGH_RISK_WORDS = (
    "vessel entry", "confined space entry", "inside reactor", "inside column", "live electrical", "energized busbar", "high voltage line", "suspended load", "overhead crane lift", "toxic gas leak", "h2s release", "unsecured at height",
)
# Words of an activity, the first group that occurs counts.
ACTIVITIES = (
    ("Confined Space Entry", ("confined space", "vessel entry", "tank entry", "pit entry", "sump", "drain chamber")),
    ("Maintenance - Electrical", ("electrical maintenance", "control panel", "switchgear", "electrician", "electrical work")),
    ("Maintenance - Mechanical", ("mechanical maintenance", "pipework", "pipe joint", "pump maintenance", "conveyor")),
    ("Hot Work", ("welding", "cutting", "grinding", "hot work", "torch work")),
    ("Working at Height", ("working at height", "scaffold", "roof", "elevated platform", "ladder work")),
    ("Lifting Operations", ("crane", "lift", "rigging", "suspended load", "hoisting")),
    ("Vehicle Movement", ("vehicle", "forklift", "truck", "hgv", "driving")),
    ("Chemical Handling", ("chemical", "acid handling", "decanting", "chemical transfer")),
    ("Fire Safety", ("fire system", "suppression system", "fire alarm", "fire extinguisher")),
    ("Electrical Work", ("electrical work", "live conductor", "junction box", "live terminal")),
    ("General Inspection", ("inspection", "housekeeping", "walkway", "workshop")),
)
# What to do, by the kind of finding.
ACTIONS = {
    "prevented": ("Log positive safety intervention / proactive stop report.", "Complete required barrier control before authorizing work.", "Verify pre-entry and isolation checklists are formally signed off.", "Brief the crew on safe work procedures prior to resumption."),
    "stopped": ("Conduct immediate site walkthrough to verify operational status.", "Clarify if personnel were exposed before work was stopped.", "Ensure permit and safety controls are strictly validated before proceeding."),
    "routine": ("Continue routine operations and maintain standard workplace housekeeping.", "Acknowledge proactive reporting."),
    "violation": ("Stop work immediately.", "Apply all required barrier controls and obtain necessary permits.", "Perform supervisor verification before resuming.", "Brief all workers on Life-Saving Rules compliance."),
}
CAUTIOUS_REASON = "Medium risk evaluated under safe fallback mode due to unclear or limited input."
FALLBACK_ACTIONS = ("Review observation text manually with site supervisor.", "Verify operational controls and permits.")


def cautious_confidence() -> Column:
    return F.struct(F.lit(0.30).alias("score"), F.lit("LOW").alias("level"))


def _words(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur whole."""
    return reduce(lambda a, b: a + b, [text.rlike(rf"\b{w}\b").cast("int") for w in words])


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def evidence(lower: Column, concepts: Column) -> Column:
    """Phrases of a text that support its analysis, with those of the concepts: distinct, in order of name, at most eight."""
    key = F.filter(_strings(KEY_PHRASES), lambda p: F.contains(lower, p))
    near = F.regexp_extract_all(lower, F.lit(r"((?:without|no|not|missing|before|prior\s+to)\s+\w+(?:\s+\w+)?)"), F.lit(1))
    return F.slice(F.array_sort(F.array_distinct(F.concat(key, near, concepts))), 1, 8)


def capital(level: Column) -> Column:
    return F.concat(F.substring(level, 1, 1), F.lower(F.substring(level, 2, 20)))


def reason(level: Column, rule: Column, negation: Column, names: Column) -> Column:
    """One sentence: why the risk is what it is. names are the barriers, the unknown one left out."""
    where = F.when(rule == "General Safety", "operations").otherwise(F.lower(rule))
    first, some, several = F.try_element_at(names, F.lit(1)), F.size(names) > 0, F.size(names) >= 2
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    risk = capital(level)
    prevented = F.when(some, say("Low risk due to proactive stop-work intervention preventing ", first, " during ", where, ".")).otherwise("Low risk due to proactive safety intervention avoiding hazard exposure before work began.")
    stopped = F.when(some, say(risk, " inherent risk due to missing ", first, " during unsafe ", where, " activity; residual exposure curtailed by intervention.")).otherwise(say(risk, " inherent risk in ", where, "; ongoing exposure stopped by intervention."))
    unclear = F.when(some, say("Medium risk due to uncertain operational controls and potential ", first, " in ", where, ".")).otherwise("Medium risk due to ambiguous operational context and unconfirmed safety controls.")
    high = (
        F.when(several & (where == "confined space"), say(risk, " risk due to multiple barrier failures and unsafe entry into confined space"))
        .when(several, say(risk, " risk due to multiple barrier failures (", F.array_join(F.slice(names, 1, 2), ", "), ") and unsafe activity in ", where))
        .when(some, say(risk, " risk due to missing ", first, " during unsafe ", where, " activity")).otherwise(say(risk, " risk due to unmitigated high-severity hazard exposure in ", where))
    )
    medium = F.when(some, say("Medium risk due to potential ", first, " identified in ", where, ".")).otherwise("Medium risk due to moderate hazard exposure without verified critical barrier breach.")
    low = say("Low risk due to routine operational conditions with no barrier failures in ", where, ".")
    return F.when(negation == "SAFE_PREVENTIVE", prevented).when(negation == "UNSAFE_WITH_INTERVENTION", stopped).when(negation == "AMBIGUOUS", unclear).when(level.isin("CRITICAL", "HIGH"), high).when(level == "MEDIUM", medium).otherwise(low)


def confidence(lower: Column, rule: Column, negation: Column, barriers: Column, phrases: Column, words: Column) -> Column:
    """struct<score, level> of the text: 0.5 and what speaks for and against it, within 0.20 and 0.98."""
    hits = reduce(lambda acc, r: acc.when(rule == r, _words(lower, RULE_WORDS[r])), list(RULE_WORDS), F.when(F.lit(False), 0)).otherwise(0)
    role, act = lower.rlike(ROLES), lower.rlike(ACTS)
    score = (
        F.lit(0.5) + F.when(hits >= 2, 0.15).when(hits == 1, 0.08).otherwise(-0.05) + F.when(barriers >= 2, 0.15).when(barriers == 1, 0.10).otherwise(-0.05) + F.when(phrases >= 2, 0.05).otherwise(0.0)
        + F.when(role & act, 0.10).when(role | act, 0.05).otherwise(0.0)
        + F.when((negation == "AMBIGUOUS") | lower.rlike(n.AMBIGUOUS), -0.35).when(negation.isin("SAFE_PREVENTIVE", "UNSAFE_VIOLATION"), 0.05).otherwise(0.0) + F.when(words < 4, -0.20).otherwise(0.0)
    )
    value = F.bround(F.least(F.lit(0.98), F.greatest(F.lit(0.20), score)), 2)
    return F.struct(value.alias("score"), F.when(value >= 0.8, "HIGH").when(value >= 0.5, "MEDIUM").otherwise("LOW").alias("level"))


def system_confidence(barrier: Column, rule: Column, clarity: Column, penalty: Column, conflicting: Column, weak: Column) -> Column:
    """struct<score, level>: weighted confidences less penalties of 0.65 at most, within 0.15 and 0.99."""
    unit = lambda c: F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(1.0))
    b, r, t = unit(barrier), unit(rule), unit(clarity)
    off = F.greatest(penalty.cast("double"), F.lit(0.0)) + F.when(t < 0.6, 0.15).otherwise(0.0) + F.when(conflicting, 0.20).otherwise(0.0) + F.when(weak | ((b <= 0.5) & (r <= 0.5)), 0.15).otherwise(0.0)
    value = F.bround(F.greatest(F.lit(0.15), F.least(F.lit(0.99), 0.45 * b + 0.35 * r + 0.20 * t - F.least(F.lit(0.65), off))), 2)
    return F.struct(value.alias("score"), F.when(value >= 0.8, "HIGH").when(value >= 0.5, "MEDIUM").otherwise("LOW").alias("level"))


def factors(lower: Column, rule: Column, negation: Column, names: Column, phrases: Column, exposure: Column, exposed: Column, severity: Column, kind: Column) -> Column:
    """The five parts of the score: array<struct<name, points, most, reason, evidence>>.

    names are the failed barriers, phrases what they rest on, exposure the phrases that
    tell of it, exposed whether there was any.
    """
    sev, kind, barriers = F.lower(F.coalesce(severity, F.lit(""))), F.lower(F.coalesce(kind, F.lit(""))), F.size(names)
    standard, hh = rule != "General Safety", rule.isin(*n.HIGH_HAZARD)
    safe, stopped, unclear, violation = (negation == v for v in ("SAFE_PREVENTIVE", "UNSAFE_WITH_INTERVENTION", "AMBIGUOUS", "UNSAFE_VIOLATION"))
    top = F.when(hh | sev.contains("critical"), 28).when(standard | sev.contains("high"), 22).when(sev.contains("medium"), 14)
    mild = sev.contains("low") | sev.contains("minor")
    hazard = F.when(safe, F.when(standard, 10).otherwise(3)).when(stopped, top.otherwise(8)).when(unclear, F.when(standard, 18).otherwise(10)).otherwise(top.when(mild, 2).otherwise(3))
    more = F.least(F.lit(35), 25 + 5 * (barriers - 1))
    failed = (
        F.when(safe, 0).when(stopped, F.when(barriers <= 1, 25).otherwise(more)).when(unclear, F.when(barriers > 0, F.least(F.lit(20), 12 + 4 * (barriers - 1))).otherwise(12))
        .when(barriers == 0, F.when(violation, 25).otherwise(0)).when(barriers == 1, 25).otherwise(more)
    )
    none_near = F.regexp_extract(lower, n.NO_EXPOSURE, 0)
    seen = (
        F.when(safe, 0).when(stopped, 8).when(unclear, 10).when((none_near != "") & ~violation, 0).when(n.any_of(lower, n.GROUPS), 20)
        .when((n.any_of(lower, n.ACTORS) | exposed) & (standard | violation), 16).when(n.any_of(lower, n.SINGLE_ACTORS), 4).otherwise(2)
    )
    activity = F.when(safe, F.when(hh, 5).otherwise(1)).when(unclear, 5).when(hh, 10).when(standard, 6).otherwise(F.when(stopped, 2).otherwise(1))
    again = (
        F.when(safe, F.when(standard, 4).otherwise(2)).when(stopped, F.when(standard, 10).otherwise(6)).when(unclear, 5).when(kind.contains("incident"), 15)
        .when(kind.contains("near miss"), F.when(standard, 8).otherwise(3)).when(kind.contains("unsafe act") | violation, F.when(standard, 10).otherwise(5)).otherwise(F.when(standard, 6).otherwise(2))
    )
    none = F.array().cast("array<string>")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    or_else = lambda rows, other: F.when(F.size(rows) > 0, rows).otherwise(other)
    one = lambda *words: F.array(*[w if isinstance(w, Column) else F.lit(w) for w in words])
    ruled = F.when(standard, one(rule)).otherwise(none)
    why_hazard = (
        F.when(safe & standard, text(rule, " hazard potential recognized and controlled prior to incident exposure.")).when(safe, "Routine operational hazard baseline under general workplace safety.")
        .when(hh | sev.contains("critical"), text(rule, " is classified as a high-hazard Life-Saving Rule.")).when(standard | sev.contains("high"), text(rule, " is classified as a regulated Life-Saving Rule hazard."))
        .when(sev.contains("medium"), "Moderate operational hazard level identified.").otherwise("Minor or routine operational hazard with low inherent severity.")
    )
    by_hazard = F.when(safe, or_else(exposure, ruled)).when(hh | standard | sev.contains("critical") | sev.contains("high"), or_else(exposure, one(rule))).when(sev.contains("medium"), or_else(exposure, ruled)).otherwise(none)
    joined = F.array_join(names, ", ")
    why_failed = (
        F.when(safe & (barriers > 0), text("Proactive stop-work or control verification successfully prevented barrier failure (", joined, ").")).when(safe, "No active barrier failure; safety controls verified or proactively maintained.")
        .when((barriers == 0) & violation, "Unsafe condition identified without explicit barrier breakdown.").when(barriers == 0, "All expected safety barriers intact or operational controls maintained.")
        .when(barriers == 1, text("Required barrier was not implemented: ", joined, ".")).otherwise(text("Multiple safety barrier breaches identified: ", F.array_join(F.slice(names, 1, 2), ", "), "."))
    )
    by_failed = F.when(safe, or_else(phrases, F.transform(names, lambda b: F.concat(F.lit("Prevented: "), b)))).when(barriers == 0, none).otherwise(or_else(phrases, names))
    absent = safe | (seen == 0)
    why_seen = (
        F.when(absent, "Hazard exposure prevented or absent before work commenced.").when(seen == 20, "Multiple personnel or crew actively exposed to hazard zone.")
        .when(seen == 16, "Active operational exposure detected within hazard area.").when(seen == 8, "Active personnel exposure occurred but was curtailed by subsequent intervention.")
        .when(seen == 4, "Personnel present in proximity to operational area.").otherwise("Routine operational conditions with minimal direct exposure.")
    )
    by_seen = (
        F.when(absent, F.when(none_near != "", F.array(none_near)).when(safe, one("exposure prevented")).otherwise(none)).when(seen == 20, or_else(exposure, one("crew/multiple workers")))
        .when(seen == 16, or_else(exposure, one("active personnel exposure"))).when(seen == 8, or_else(exposure, one("curtailed exposure"))).when(seen == 4, or_else(exposure, one("personnel present"))).otherwise(none)
    )
    why_activity = F.when(hh, text("High-risk critical activity governed by ", rule, " mandatory procedures.")).when(standard, text("Regulated operational activity subject to ", rule, " safety requirements.")).otherwise("General workplace operational activity.")
    why_again = (
        F.when(safe, "Proactive safety observation reduces organizational recurrence risk.").when(kind.contains("incident"), "Actual incident occurrence carries maximum organizational risk priority.")
        .when(kind.contains("near miss"), "Near-miss event indicates elevated risk of future high-consequence recurrence.")
        .when(kind.contains("unsafe act") | violation, "Unsafe act or direct violation increases probability of severe event.").otherwise("Standard recurrence weight based on operational classification.")
    )
    by_again = (
        F.when(safe, one(negation)).when(kind.contains("incident"), one("incident")).when(kind.contains("near miss"), one("near miss"))
        .when(kind.contains("unsafe act"), one("unsafe act")).when(violation, one("direct violation")).otherwise(none)
    )
    rows = (
        ("Hazard Severity", hazard, F.lit(30), why_hazard, by_hazard), ("Barrier Failure", failed, F.when(barriers > 1, 35).otherwise(25), why_failed, by_failed), ("Exposure", seen, F.lit(20), why_seen, by_seen),
        ("Activity Criticality", activity, F.lit(10), why_activity, one(rule)), ("Recurrence Weight", again, F.lit(15), why_again, by_again),
    )
    return F.array(*[F.struct(F.lit(name).alias("name"), points.cast("int").alias("points"), most.alias("most"), why.alias("reason"), by.alias("evidence")) for name, points, most, why, by in rows])


def fallback(lower: Column, rule: Column, negation: Column, sif: Column, barriers: Column) -> Column:
    """Whether an analysis must give way to the cautious one: a rule that is none, or high-risk words without any barrier found."""
    risky = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in HIGH_RISK_WORDS])
    return ~F.coalesce(rule.isin(*RULES), F.lit(False)) | (risky & (barriers == 0) & ~((negation == "SAFE_PREVENTIVE") | (sif == "NO")))


def actions(negation: Column, level: Column, barriers: Column, cautious: Column) -> Column:
    """What is recommended."""
    return (
        F.when(cautious, _strings(FALLBACK_ACTIONS)).when(negation == "SAFE_PREVENTIVE", _strings(ACTIONS["prevented"])).when(negation == "UNSAFE_WITH_INTERVENTION", _strings(ACTIONS["stopped"]))
        .when((level == "LOW") & (barriers == 0), _strings(ACTIONS["routine"])).otherwise(_strings(ACTIONS["violation"]))
    )


def activity(lower: Column, known: Column) -> Column:
    """The activity that is known, else the first whose words occur."""
    found = reduce(lambda acc, a: acc.when(reduce(lambda x, y: x | y, [F.contains(lower, F.lit(w)) for w in a[1]]), a[0]), ACTIVITIES, F.when(F.lit(False), "")).otherwise("General Maintenance")
    return F.when((F.coalesce(known, F.lit("")) != "") & (known != "Unknown"), known).otherwise(found)


def shown_barriers(names: Column, score: Column, negation: Column) -> Column:
    """The barriers, or the unknown one for a violation with more than 30 points that names none."""
    empty = F.array().cast("array<string>")
    return F.when(F.size(names) > 0, names).when((score > 30) & (negation == "UNSAFE_VIOLATION"), F.array(F.lit(UNKNOWN_BARRIER))).otherwise(empty)
