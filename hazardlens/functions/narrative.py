"""Analysis of one narrative as column expressions: rule, negation, clarity, score, SIF potential.

All functions take and give columns, so that an analysis is a projection without
shuffle. Word lists are tested with `contains` on text padded by spaces.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signals of the rules.
STRONG = {
    "Confined Space": (
        "entered vessel", "entered tank", "tank entry", "vessel entry", "inside chamber", "inside tank", "inside vessel", "confined space",
        "manhole entry", "column entry", "reactor entry", "inside sump", "entered pit", "entered chamber", "entry into tank", "entry into vessel",
        "stepped into chamber", "stepped into tank", "stepped into vessel", "stepped inside", "went inside",
    ),
    "Working at Height": (
        "at height", "above ground", "elevated platform", "on scaffold", "on roof", "climbed ladder", "climbing ladder", "climbed tower", "manlift",
        "cherry picker", "edge protection", "fall arrest", "climbed 10", "climbed", "falling from height", "working at height", "climbed structure",
        "fall protection",
    ),
    "Energy Isolation": (
        "lockout tagout", "lockout", "tagout", "loto", "energized system", "live circuit", "de energize", "de energization", "energy isolation",
        "electrical switchgear", "breaker panel", "stored energy", "high voltage", "live wire", "live conductor", "circuit remained live",
        "remained live", "energized equipment",
    ),
    "Hot Work": ("hot work", "welding", "torch cutting", "open flame", "grinding sparks", "brazing", "plasma cutting"),
    "Line of Fire": (
        "line of fire", "suspended load", "under load", "crane lift", "rigging failure", "falling object", "struck by load", "drop zone",
        "below load", "under suspended load", "beneath suspended load", "beneath load", "entered the drop zone", "path of moving equipment",
    ),
    "Vehicle Movement": (
        "forklift operation", "reversing vehicle", "hgv movement", "pedestrian walkway", "vehicle collision", "traffic management", "heavy vehicle",
        "forklift struck",
    ),
    "Chemical Handling": (
        "chemical spill", "acid splash", "toxic leak", "caustic exposure", "chemical inhalation", "chlorine leak", "ammonia leak",
        "hazardous chemical", "toxic atmosphere",
    ),
    "Fire Prevention": ("fire breakout", "combustible fire", "sprinkler discharge", "fire suppression", "extinguisher deployed"),
}
MEDIUM = {
    "Confined Space": (
        "gas testing", "gas test", "atmospheric test", "atmosphere", "oxygen", "h2s", "toxic gas", "ventilation", "hole watch", "standby person",
        "vessel", "tank", "chamber", "sump", "pit", "manhole",
    ),
    "Working at Height": (
        "harness", "lanyard", "safety line", "lifeline", "guardrail", "scaffold", "scaffolding", "ladder", "roof", "platform", "tie off", "tied off",
    ),
    "Energy Isolation": (
        "energized valve", "electrical panel", "breaker", "voltage", "switchgear", "circuit", "transformer", "substation", "isolation", "isolated",
        "energized", "depressurized",
    ),
    "Hot Work": ("fire watch", "welder", "torch", "arc", "sparks", "flame", "flammable", "cutting", "grinding"),
    "Line of Fire": ("crane", "hoist", "rigging", "exclusion zone", "sling", "lifting", "overhead load"),
    "Vehicle Movement": ("forklift", "truck", "vehicle", "excavator", "banksman", "reversing", "speeding", "seat belt"),
    "Chemical Handling": ("acid", "caustic", "toxic", "corrosive", "chemical", "spill", "solvent", "inhalation", "ppe"),
    "Fire Prevention": ("smoke", "fire", "detector", "suppression", "extinguisher", "combustible", "flammable"),
}
WEAK = {
    "Confined Space": ("permit", "entry clearance", "drain", "sampling", "confined"),
    "Working at Height": ("ladder", "step", "climb", "tower", "level", "meters", "feet"),
    "Energy Isolation": ("power", "wire", "cable", "motor", "pump", "electrical", "cord", "valve"),
    "Hot Work": ("heat", "burn", "spark"),
    "Line of Fire": ("dropped", "struck", "swing", "load"),
    "Vehicle Movement": ("driver", "traffic", "car", "pedestrian"),
    "Chemical Handling": ("fumes", "leak", "drum"),
    "Fire Prevention": ("alarm", "heat"),
}
ACTIONS = {
    "Confined Space": ("entered", "entering", "entry", "stepped into", "went into", "inside"),
    "Working at Height": ("climbed", "climbing", "working at", "elevated", "mounted"),
    "Energy Isolation": ("locking", "tagging", "switching", "operating", "opening", "servicing"),
    "Hot Work": ("welding", "cutting", "grinding", "burning", "brazing"),
    "Line of Fire": ("lifting", "rigging", "standing", "walking under"),
    "Vehicle Movement": ("driving", "reversing", "operating", "speeding"),
    "Chemical Handling": ("handling", "pouring", "mixing", "flushing"),
    "Fire Prevention": ("extinguishing", "igniting"),
}
OFFICE = (
    "office", "corridor", "desk", "cabin", "walkway", "canteen", "cafeteria", "parking lot", "reception", "restroom", "lobby", "breakroom", "kitchen",
    "pantry",
)
INDUSTRIAL = (
    "vessel", "tank", "confined space", "substation", "transformer", "high voltage", "switchgear", "scaffold", "crane", "rigging", "pipeline",
    "furnace", "reactor", "column", "manifold", "breaker panel", "generator", "plant", "refinery", "tower",
)
ABBREVIATIONS = {
    "loto": "lockout tagout", "ptw": "permit to work", "ppe": "personal protective equipment", "sds": "safety data sheet", "swp": "safe work permit", "jha": "job hazard analysis",
    "tra": "task risk assessment", "hgv": "heavy vehicle", "h2s": "hydrogen sulfide", "scba": "self contained breathing apparatus", "apr": "air purifying respirator",
}

# Phrases of negation and exposure.
NEGATED_STOP = r"\b(?:did\s+not|didn't|failed\s+to|refused\s+to|could\s+not)\s+(?:stop|halt|abort|suspend|cease)\b"
STOP = (
    r"\b("
    r"(?:did\s+not|didn't|does\s+not|doesn't|would\s+not|wouldn't|refused\s+to|decided\s+not\s+to|opted\s+not\s+to|declined\s+to)\s+(?:proceed|enter|start|"
    r"commence|work|operate|continue|execute|climb|step|go\s+into|begin|resume)|"
    r"(?:work|job|entry|task|operation|activity|maintenance|welding|lifting|pour|process)\s+(?:was\s+)?(?:stopped|halted|suspended|aborted|cancelled|put\s+"
    r"on\s+hold|paused|delayed|refused|prevented|ceased)|"
    r"(?:ordered|issued|enforced)\s+(?:a\s+)?stop[\s-]?work|"
    r"stop[\s-]?work|"
    r"stopped\s+(?:work|the\s+work|entry|task|job|activity|operation|hot\s+work|maintenance|welding|climbing)?|"
    r"halted\s+(?:work|the\s+work|entry|task|job|activity|operation|the\s+operation)?|"
    r"aborted\s+(?:entry|operation|task|job|activity)?|"
    r"suspended\s+(?:work|the\s+work|entry|task|job|activity|operation|the\s+operation)|"
    r"avoided\s+(?:entering|working|climbing|proceeding|operating|starting|entry|work)?|"
    r"refused\s+(?:to\s+enter|to\s+work|to\s+proceed|to\s+climb|to\s+start|entry)?|"
    r"(?:supervisor|management|operator|team|lead)\s+(?:intervened|halted|stopped|suspended)|"
    r"intervened\s+(?:and\s+)?(?:stopped|halted)?|"
    r"(?:was\s+)?prevented\s+(?:from\s+)?(?:entering|proceeding|working|climbing|operating)?|"
    r"prevented\s+(?:the\s+worker\s+|the\s+operator\s+|entry|work)|"
    r"held\s+back\s+from|"
    r"stayed\s+back\s+from"
    r")\b"
)
PRE_EXPOSURE = (
    r"\b("
    r"(?:stopped|halted|intervened|suspended|prevented|held\s+back|proactively\s+halted)\s+(?:.*?\s+)?(?:before|until|prior\s+to)\s+(?:any\s+)?(?:entry|"
    r"entering|servicing|work|starting|climbing|proceeding|exposure|operation|use|using|testing|atmospheric\s+testing)|"
    r"prevented\s+(?:.*?\s+)?from\s+(?:entering|climbing|operating|working|proceeding)|"
    r"(?:before|until|prior\s+to)\s+(?:any\s+)?(?:entry|entering|servicing|anyone\s+(?:entered|tripped|fell|was\s+exposed|was\s+injured|was\s+harmed)|"
    r"work\s+(?:began|started)|starting|climbing|exposure)|"
    r"(?:halted|stopped)\s+(?:.*?\s+)?until\s+(?:.*?\s+)?(?:completed|conducted|performed|done|verified)|"
    r"(?:preparing|about|attempted|attempting)\s+to\s+(?:enter|climb|work|operate)\s+.*?\s+(?:stopped|halted|prevented|intervened)|"
    r"(?:completed|verified|conducted|performed|obtained|issued)\s+before\s+(?:entry|entering|work|resumed)"
    r")\b"
)
POST_EXPOSURE = (
    r"\b("
    r"after\s+(?:the\s+)?(?:unsafe|entry|entering|work|incident|condition|breach|had\s+already)|"
    r"had\s+already\s+(?:entered|started|begun|operated|climbed)|"
    r"already\s+(?:entered|inside|operating|working)|"
    r"entered\s+.*?\s+when\s+(?:the\s+)?(?:supervisor|management)\s+intervened|"
    r"(?:was\s+)?(?:suspended|stopped|halted)\s+after"
    r")\b"
)
ACTIVE_EXPOSURE = (
    r"\b("
    r"(?:entered|was\s+entering|had\s+entered|proceeded\s+to\s+enter|inside|went\s+inside|stepped\s+inside|stepping\s+into|stepped\s+into|accessing|"
    r"accessed|penetrated)\s+(?:the\s+)?(?:confined\s+space|vessel|tank|reactor|column|sump|pit|chamber|pipe|drum)?|"
    r"(?:entry\s+occurred|entry\s+was\s+made|unauthorized\s+entry|confined[\s-]space\s+entry|vessel\s+entry|tank\s+entry)|"
    r"(?:working|worked|operating|operated|servicing|serviced|repairing|repaired)\s+(?:on|with|inside)\s+(?:a\s+|the\s+)?(?:live|energized|circuit|"
    r"switchgear|panel|breaker|motor|pump|board)|"
    r"(?:climbed|climbing|mounted|mounting|working|worked)\s+(?:at\s+height|on\s+scaffold|on\s+ladder|on\s+roof|tower)|"
    r"(?:grinding|welding|cutting)\s+.*?\s+(?:without|before|prior\s+to)|"
    r"(?:without|before|prior\s+to)\s+(?:gas\s+test|permit|isolation|lockout|harness|ppe|safety\s+glasses|fire\s+watch|standby|atmospheric\s+test(?:ing)?|"
    r"atmospheric\s+monitoring)\s+.*?\s+(?:work\s+continued|proceeded|continued|entered|went\s+inside)|"
    r"(?:entered|operated|worked|grinding|welding|climbed|went\s+inside|stepped\s+into|mounted|accessed)\s+(?:without|before|prior\s+to)|"
    r"(?:without|before|prior\s+to)\s+.*?\s+(?:entered|operated|worked|climbed|went\s+inside|stepped\s+into|mounted|accessed)"
    r")\b"
)
NO_EXPOSURE = (
    r"\b("
    r"no(?:body|\s+one)?\s+(?:was\s+)?(?:exposed|harmed|injured)|"
    r"no\s+(?:harm|injury|exposure)|"
    r"without\s+(?:exposure|incident|injury|harm)|"
    r"nobody\s+(?:was\s+)?injured|"
    r"before\s+(?:anyone|injury|harm|tripped|entered|was\s+exposed)|"
    r"prevented\s+from\s+entering|"
    r"picked\s+it\s+up\s+immediately|"
    r"work\s+was\s+not\s+affected"
    r")\b"
)
OMISSION = (
    r"\b("
    r"(?:without|with\s+no|no|missing|lack\s+of|absence\s+of|failed\s+to\s+(?:conduct|perform|obtain|wear|apply|use))\s+(?:any\s+|approved\s+|proper\s+|"
    r"required\s+|standard\s+|valid\s+)?(?:gas\s+test(?:ing)?|atmospheric\s+test(?:ing)?|atmospheric\s+monitoring|gas\s+monitoring|air\s+monitoring|testing|"
    r"permit(?: to work)?|ptw|authorization|clearance|isolation|lockout|tagout|loto|harness|fall\s+protection|fall\s+arrest|ppe|safety\s+glasses|gloves|"
    r"helmet|mask|respirator|fire\s+watch|standby(?:\s+person)?|attendant|ventilation|guardrail|earthing|grounding|chock|banksman)|"
    r"(?:gas\s+test(?:ing)?|testing|permit|ptw|authorization|isolation|lockout|tagout|loto|harness|fall\s+protection|ppe|safety\s+glasses|fire\s+watch|"
    r"standby|attendant|ventilation|guardrail)\s+(?:was\s+|were\s+)?(?:not\s+(?:done|obtained|conducted|applied|completed|issued|available|present|worn|"
    r"used|carried\s+out|tested|performed))|"
    r"(?:before|prior\s+to)\s+(?:any\s+)?(?:atmospheric\s+testing|atmospheric\s+monitoring|gas\s+testing|gas\s+test|testing|permit|ptw|authorization|"
    r"clearance|isolation|lockout|tagout|securing\s+lanyard|harness|standby)|"
    r"without\s+(?:checking|verifying|monitoring|testing|measuring|sampling)\s+(?:the\s+)?(?:atmosphere|gas|air|oxygen|gas\s+levels)|"
    r"without\s+(?:locking\s+out|isolating|de-energizing|securing|wearing|obtaining|getting)\s+(?:the\s+)?(?:breaker|power|circuit|lanyard|harness|permit|"
    r"authorization)|"
    r"not\s+wearing\s+(?:any\s+|approved\s+|proper\s+|required\s+)?(?:ppe|harness|helmet|gloves|safety\s+glasses|mask|respirator|protection|seat\s*belt)|"
    r"not\s+(?:tested|isolated|depressurized|grounded|authorized|inspected)|"
    r"entry\s+without\s+testing"
    r")\b"
)
AMBIGUOUS = (
    r"\b("
    r"unclear\s+(?:if|whether)|"
    r"not\s+confirmed\s+(?:if|whether)|"
    r"possibly|"
    r"maybe|"
    r"not\s+sure|"
    r"may\s+have|"
    r"while\s+inspecting|"
    r"inspection\s+only|"
    r"started\s+(?:then|and\s+then)\s+stopped|"
    r"entered\s+(?:then|and\s+then)\s+stopped"
    r")\b"
)
DOUBLE_NEGATION = (
    r"\bnot\s+(?:without|unverified|unsafe|missing|lacking|omitted|absent)\b",
    r"\bnever\s+(?:without|unverified|unsafe|missing|lacking)\b",
    r"\bno\s+lack\s+of\b",
    r"\bwithout\s+no\b",
)
SPECULATIVE = (
    r"\b(?:maybe|perhaps|possibly|allegedly|supposedly|unconfirmed)\b",
    r"\bnot\s+sure(?:\s+if|\s+whether)?\b",
    r"\bunclear(?:\s+if|\s+whether)?\b",
    r"\buncertain(?:\s+if|\s+whether)?\b",
    r"\bmight\s+have\b",
    r"\bcould\s+be\b",
    r"\bseem(?:s|ed)?\s+to\b",
    r"\bnot\s+confirmed\b",
)
CONNECTIVES = r"\b(but\s+later|and\s+then|subsequently|followed\s+by|after\s+that|however|later|then|afterwards)\b"
PRECURSORS = (
    "confined space", "without gas testing", "lockout", "without isolation", "energized", "live circuit", "without harness", "suspended load",
    "line of fire", "chemical exposure", "toxic", "oxygen deficient", "pressurized", "no standby",
)
HIGH_HAZARD = ("Confined Space", "Energy Isolation", "Hot Work", "Working at Height")
GROUPS = (
    "two worker", "crew", "multiple workers", "team", "contract workers",
)
ACTORS = (
    "worker", "technician", "operator", "electrician", "welder", "contractor", "personnel", "employee", "mechanic", "rigger", "driver",
)
SINGLE_ACTORS = ("worker", "technician", "operator", "employee")


def any_of(text: Column, phrases: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def _hits(padded: Column, phrases: Iterable[str]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(f" {p} ") for p in phrases]), lambda p: F.contains(padded, p)))


def normalized(c: Column) -> Column:
    """Lower case, contractions and abbreviations in full, no ASCII punctuation, single spaces.

    Null gives the empty text. Misspelled words stay as they are.
    """
    t = F.lower(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\bwon't\b", "will not"), r"\bcan't\b", "cannot"), r"\b(did|was|were|have|has|had|do|does|would|could|should|is|are)n't\b", "$1 not")
    for short, full in ABBREVIATIONS.items():
        t = F.regexp_replace(t, rf"\b{short}\b", full)
    return F.trim(F.regexp_replace(t, r"[\s!-/:-@\[-`{-~]+", " "))


def rule_signals(norm: Column) -> Column:
    """Hits of each rule's word lists, and whether the place is an office without anything industrial: struct<rules, office>."""
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    rules = [F.struct(F.lit(r).alias("rule"), _hits(padded, STRONG[r]).alias("strong"), _hits(padded, MEDIUM[r]).alias("medium"), _hits(padded, WEAK[r]).alias("weak"), _hits(padded, ACTIONS[r]).alias("acts")) for r in STRONG]
    return F.struct(F.array(*rules).alias("rules"), ((_hits(padded, OFFICE) > 0) & (_hits(padded, INDUSTRIAL) == 0)).alias("office"))


def rule_scores(signals: Column, domains: Column | None = None) -> Column:
    """Rules with a score above 0 as array<struct<rank, rule, score>>, best first, ties by name. The signals should be a column of their own.

    A rule without any point gets 5 if it is one of the domains that the text touches.
    """

    def scored(x: Column) -> Column:
        score = 5 * x["strong"] + 3 * x["medium"] + x["weak"] + F.when((x["strong"] > 0) & (x["acts"] > 0), 3).otherwise(0)
        score = F.when(signals["office"] & (x["strong"] == 0), 0).otherwise(score)
        if domains is not None:
            score = F.when((score == 0) & ~signals["office"] & F.array_contains(domains, x["rule"]), 5).otherwise(score)
        return F.struct((-score).alias("rank"), x["rule"].alias("rule"), score.alias("score"))

    return F.array_sort(F.filter(F.transform(signals["rules"], scored), lambda s: s["score"] > 0))


def primary_rule(scores: Column) -> Column:
    return F.coalesce(F.try_element_at(scores, F.lit(1))["rule"], F.lit("General Safety"))


def secondary_rule(scores: Column) -> Column:
    """The second rule if it is within 3 points or has 5 points and 0.4 of the first; else null."""
    a, b = F.try_element_at(scores, F.lit(1))["score"], F.try_element_at(scores, F.lit(2))
    return F.when((a - b["score"] <= 3) | ((b["score"] >= 5) & (b["score"] >= a * 0.4)), b["rule"])


def omissions(lower: Column) -> Column:
    """Distinct phrases that name a missing control."""
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(OMISSION), F.lit(1)))


def negation(lower: Column) -> Column:
    """AMBIGUOUS, UNSAFE_VIOLATION, UNSAFE_WITH_INTERVENTION, SAFE_PREVENTIVE or NONE."""
    barrier, stop, not_stopped = lower.rlike(OMISSION), lower.rlike(STOP), lower.rlike(NEGATED_STOP)
    pre = lower.rlike(PRE_EXPOSURE)
    exposed = lower.rlike(ACTIVE_EXPOSURE) | lower.rlike(POST_EXPOSURE) | barrier
    return (
        F.when(lower.rlike(AMBIGUOUS), "AMBIGUOUS").when(not_stopped & barrier, "UNSAFE_VIOLATION")
        .when(stop & ~not_stopped, F.when(exposed & ~pre, "UNSAFE_WITH_INTERVENTION").otherwise("SAFE_PREVENTIVE"))
        .when(barrier, "UNSAFE_VIOLATION").otherwise("NONE")
    )


def clause_states(clauses: Column) -> Column:
    """Per clause: U unsafe, S safe, N neither, and whether it tells of an intervention, as array<struct<state, stopped>>."""
    seen = F.transform(clauses, lambda c: F.struct(negation(F.lower(c)).alias("kind"), F.lower(c).rlike(OMISSION).alias("omits"), F.lower(c).rlike(STOP).alias("stops")))
    letter = lambda x: F.when((x["kind"] == "UNSAFE_VIOLATION") | (x["omits"] & (x["kind"] != "SAFE_PREVENTIVE")), "U").when(x["kind"] == "SAFE_PREVENTIVE", "S").otherwise("N")
    return F.transform(seen, lambda x: F.struct(letter(x).alias("state"), ((x["kind"] == "UNSAFE_WITH_INTERVENTION") | x["stops"]).alias("stopped")))


def sequence(active: Column, stopped: Column, lower: Column) -> Column:
    """Name of the order of the letters U and S in `active`."""
    unsafe, safe = active.contains("U"), active.contains("S")
    two = F.length(active) == 2
    resolved = lower.rlike(PRE_EXPOSURE) & ~(lower.rlike(POST_EXPOSURE) | lower.rlike(ACTIVE_EXPOSURE))
    mixed = F.when(active.endswith("U") & ~stopped, F.when(two, "SAFE_TO_UNSAFE").otherwise("MULTI_STAGE_UNSAFE")).when(resolved, F.when(two, "UNSAFE_TO_SAFE").otherwise("MULTI_STAGE_SAFE_RESOLVED")).otherwise("UNSAFE_WITH_INTERVENTION")
    calm = F.when(lower.rlike(PRE_EXPOSURE), "PREVENTIVE_BEFORE_EXPOSURE").otherwise("PURE_SAFE")
    return F.when(unsafe & (safe | stopped), mixed).when(unsafe, "PURE_UNSAFE").when(safe, calm).otherwise("NEUTRAL")


def effective(sequence: Column) -> Column:
    """The negation that a sequence stands for; null if neutral."""
    return F.when(sequence.isin("SAFE_TO_UNSAFE", "MULTI_STAGE_UNSAFE", "PURE_UNSAFE"), "UNSAFE_VIOLATION").when(sequence == "UNSAFE_WITH_INTERVENTION", sequence).when(sequence != "NEUTRAL", "SAFE_PREVENTIVE")


def clauses(text: Column) -> Column:
    """Sentences, cut again before each temporal connective."""
    cut = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[.;!?\n\r]+", "\u0001"), f"(?i){CONNECTIVES}", "\u0001$1")
    return F.filter(F.transform(F.split(cut, "\u0001"), lambda c: F.trim(c)), lambda c: c != "")


def doubts(lower: Column, words: Column) -> Column:
    """How many signs of unclear wording a text has: double negations, speculation, fewer than four words."""
    return reduce(lambda a, b: a + b, [lower.rlike(p).cast("int") for p in (*DOUBLE_NEGATION, *SPECULATIVE)]) + (words < 4).cast("int")


def clarity_penalty(lower: Column, words: Column) -> Column:
    found = lambda patterns: reduce(lambda a, b: a + b, [lower.rlike(p).cast("int") for p in patterns])
    return F.bround(found(DOUBLE_NEGATION) * 0.25 + found(SPECULATIVE) * 0.2 + F.when(words < 4, 0.25).otherwise(0.0), 2)


def clarity(penalty: Column, words: Column) -> Column:
    return F.when((penalty >= 0.35) | (words < 3), "LOW").when((penalty > 0) | (words < 6), "MEDIUM").otherwise("HIGH")


def raw_score(lower: Column, rule: Column, negation: Column, barriers: Column, severity: Column, kind: Column) -> Column:
    """0 to 100: hazard, barriers, exposure, activity and recurrence, by the kind of negation."""
    sev, kind = F.lower(F.coalesce(severity, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))
    standard, hh = rule != "General Safety", rule.isin(*HIGH_HAZARD)
    violation, stopped = negation == "UNSAFE_VIOLATION", negation == "UNSAFE_WITH_INTERVENTION"
    more = F.least(F.lit(35), 25 + 5 * (barriers - 1))
    top = F.when(hh | sev.contains("critical"), 28).when(standard | sev.contains("high"), 22).when(sev.contains("medium"), 14)
    safe = F.when(standard, 10).otherwise(3) + F.when(hh, 5).otherwise(1) + F.when(standard, 4).otherwise(2)
    partly = top.otherwise(8) + F.when(barriers <= 1, 25).otherwise(more) + 8 + F.when(hh, 10).when(standard, 6).otherwise(2) + F.when(standard, 10).otherwise(6)
    unclear = F.when(standard, 18).otherwise(10) + F.when(barriers > 0, F.least(F.lit(20), 12 + 4 * (barriers - 1))).otherwise(12) + 20
    exposure = (
        F.when(lower.rlike(NO_EXPOSURE) & ~violation, 0).when(any_of(lower, GROUPS), 20)
        .when((any_of(lower, ACTORS) | lower.rlike(ACTIVE_EXPOSURE)) & (standard | violation), 16).when(any_of(lower, SINGLE_ACTORS), 4).otherwise(2)
    )
    again = F.when(kind.contains("incident"), 15).when(kind.contains("near miss"), F.when(standard, 8).otherwise(3)).when(kind.contains("unsafe act") | violation, F.when(standard, 10).otherwise(5)).otherwise(F.when(standard, 6).otherwise(2))
    barrier = F.when(barriers == 0, F.when(violation, 25).otherwise(0)).when(barriers == 1, 25).otherwise(more)
    other = top.when(sev.isin("low", "minor"), 2).otherwise(3) + barrier + exposure + F.when(hh, 10).when(standard, 6).otherwise(1) + again
    return F.least(F.lit(100), F.when(negation == "SAFE_PREVENTIVE", safe).when(stopped, partly).when(negation == "AMBIGUOUS", unclear).otherwise(other)).cast("int")


def level(score: Column, negation: Column) -> Column:
    bands = F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 30, "MEDIUM").otherwise("LOW")
    return F.when(negation == "SAFE_PREVENTIVE", "LOW").when(negation == "AMBIGUOUS", "MEDIUM").otherwise(bands)


def sif_potential(lower: Column, rule: Column, negation: Column, barriers: Column, score: Column, level: Column, quality: Column) -> Column:
    """Whether a serious injury could have come of it: YES, NO or UNKNOWN."""
    sign = any_of(lower, PRECURSORS) | (rule.isin("Confined Space", "Energy Isolation", "Working at Height", "Line of Fire") & (barriers > 0))
    return (
        F.when(negation == "SAFE_PREVENTIVE", "NO")
        .when(negation == "UNSAFE_WITH_INTERVENTION", F.when(sign | (score >= 70), "YES").when(score <= 30, "NO").otherwise("UNKNOWN"))
        .when((negation == "AMBIGUOUS") | (quality == "LOW"), "UNKNOWN").when((level == "LOW") & (barriers == 0), "NO")
        .when(sign & ((barriers > 0) | any_of(lower, ("without", "no "))), "YES").when(score >= 80, "YES")
        .when((score <= 30) | ((rule == "General Safety") & ~sign), "NO").otherwise("UNKNOWN")
    )
