"""Failed barriers that a narrative names: which, on what evidence, with what confidence.

Stages, from strong to weak: a control that a phrase says was left out, patterns
and synonyms, phrases near a negation, keywords near a negation, unclear wording.
What a text says was done, and what can't be in an office, is taken back. All
stages are column expressions over two normal forms of the text; a row needs no
other row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.functions.narrative import ABBREVIATIONS, INDUSTRIAL, OFFICE, any_of
from hazardlens.functions.spelling import corrected

GAS, PERMIT, FALL, LOCKOUT, ISOLATION = "Gas Testing Not Completed", "Permit Not Obtained", "Fall Protection Not Used", "Lockout/Tagout Not Completed", "Isolation Not Applied"
STANDBY, ZONE, WATCH, PPE, PRESSURE = "Standby Person Not Assigned", "Exclusion Zone Not Established", "Fire Watch Not Posted", "PPE Not Available", "Pressure Not Released"
BARRIERS = (GAS, PERMIT, FALL, LOCKOUT, ISOLATION, STANDBY, ZONE, WATCH, PPE, PRESSURE)

# What is done with a control.
VERBS = {
    GAS: (
        "test", "testing", "tested", "check", "checking", "checked", "monitor", "monitoring", "monitored", "sample", "sampling", "sampled", "measure",
        "measuring", "measured", "verify", "verifying", "verified", "detect", "detecting", "detection", "analyze", "analyzing", "analyzed",
    ),
    PERMIT: (
        "obtain", "obtaining", "obtained", "issue", "issuing", "issued", "sign", "signing", "signed", "authorize", "authorizing", "authorized",
        "approve", "approving", "approved", "grant", "granting", "granted", "get", "getting", "got", "acquire", "acquiring", "acquired",
    ),
    FALL: (
        "wear", "wearing", "worn", "use", "using", "used", "put on", "tie off", "tying off", "tied off", "hook up", "hooking up", "hooked up",
        "attach", "attaching", "attached", "secure", "securing", "secured", "clip", "clipping", "clipped", "anchor", "anchoring", "anchored",
    ),
    LOCKOUT: (
        "apply", "applying", "applied", "complete", "completing", "completed", "install", "installing", "installed", "lock", "locking", "locked",
        "lock out", "locking out", "locked out", "tag", "tagging", "tagged", "tag out", "tagging out", "tagged out", "affix", "affixing", "affixed",
    ),
    ISOLATION: (
        "isolate", "isolating", "isolated", "de energize", "de energizing", "de energized", "de-energize", "de-energizing", "de-energized",
        "deenergize", "deenergizing", "deenergized", "disconnect", "disconnecting", "disconnected", "switch off", "switching off", "switched off",
        "shut down", "shutting down", "shut off",
    ),
    STANDBY: (
        "assign", "assigning", "assigned", "post", "posting", "posted", "station", "stationing", "stationed", "provide", "providing", "provided",
        "deploy", "deploying", "deployed", "position", "positioning", "positioned",
    ),
    ZONE: (
        "establish", "establishing", "established", "set up", "setting up", "erect", "erecting", "erected", "cordon", "cordoning", "cordoned",
        "barricade", "barricading", "barricaded", "demarcate", "demarcating", "demarcated",
    ),
    WATCH: ("post", "posting", "posted", "assign", "assigning", "assigned", "station", "stationing", "stationed", "deploy", "deploying", "deployed"),
    PPE: ("wear", "wearing", "worn", "use", "using", "used", "put on", "provide", "providing", "provided", "don", "donning", "donned"),
    PRESSURE: (
        "release", "releasing", "released", "depressurize", "depressurizing", "depressurized", "bleed", "bleeding", "bled", "vent", "venting",
        "vented", "drain", "draining", "drained",
    ),
}
# The control itself.
TARGETS = {
    GAS: (
        "gas", "gases", "atmosphere", "atmospheric", "air", "air quality", "oxygen", "oxygen levels", "oxygen level", "gas levels", "gas level",
        "h2s", "toxic gas", "flammable gas", "combustible gas", "air sample", "air sampling", "gas check", "gas testing", "atmospheric test",
        "atmospheric testing", "atmospheric monitoring", "gas monitoring",
    ),
    PERMIT: (
        "permit", "work permit", "safe work permit", "ptw", "entry permit", "clearance", "entry clearance", "authorization", "approval",
        "work clearance", "formal permit", "work authorization", "clearance or permit", "permit to work",
    ),
    FALL: (
        "harness", "safety harness", "lanyard", "lifeline", "safety line", "fall protection", "fall arrest", "fall restraint", "guardrail",
        "edge protection", "anchor point", "anchorage", "safety belt", "tied off", "tie off", "being tied off",
    ),
    LOCKOUT: (
        "lockout", "tagout", "loto", "padlock", "breaker lock", "hasp", "lockout tagout", "loto padlock", "isolation lock", "safety tag", "breaker",
        "the breaker", "breaker panel", "power switch", "switch", "panel", "motor", "pump", "circuit",
    ),
    ISOLATION: (
        "isolation", "energy isolation", "power", "electrical supply", "circuit", "power source", "electrical isolation", "line isolation", "feed",
        "breaker", "switchgear", "motor", "pump", "system", "circuit remained live", "remained live", "energized equipment", "live circuit",
    ),
    STANDBY: (
        "standby", "standby person", "hole watch", "safety watcher", "attendant", "safety attendant", "entry watcher", "sentry", "observer",
        "standby monitor",
    ),
    ZONE: (
        "exclusion zone", "barricade", "perimeter", "drop zone", "safety perimeter", "warning tape", "cordon", "red zone", "area",
        "beneath suspended load", "under suspended load", "positioned beneath suspended load", "entered the drop zone", "path of moving equipment",
    ),
    WATCH: ("fire watch", "fire guard", "spark watch", "extinguisher standby", "hot work watch"),
    PPE: (
        "ppe", "personal protective equipment", "safety glasses", "eye protection", "face shield", "gloves", "safety gloves", "helmet", "hard hat",
        "respirator", "mask", "hearing protection", "earplugs", "safety shoes",
    ),
    PRESSURE: ("pressure", "residual pressure", "line pressure", "system pressure", "hydraulic pressure", "pneumatic pressure", "steam pressure"),
}
# The control and what is done with it, in one name.
COMPOUNDS = {
    GAS: (
        "gas test", "gas testing", "atmospheric test", "atmospheric testing", "atmospheric monitoring", "gas monitoring", "air monitoring",
        "oxygen test", "oxygen testing", "gas check", "gas checking", "air test", "air testing", "gas detection", "gas measurement",
        "atmospheric check", "oxygen sampling", "air quality check",
    ),
    PERMIT: (
        "work permit", "permit to work", "safe work permit", "entry clearance", "entry permit", "ptw issuance", "permit authorization",
        "clearance sign off", "permit issuance", "permit issue", "issuance of permit", "permit approval",
    ),
    FALL: (
        "safety harness", "fall protection", "fall arrest", "fall restraint", "edge protection", "anchor point", "safety line", "guardrail",
        "tied off", "tie off", "being tied off",
    ),
    LOCKOUT: ("lockout tagout", "loto application", "breaker lockout", "padlock application", "circuit isolation tag", "hasp locking"),
    ISOLATION: (
        "energy isolation", "de energization", "power cutoff", "electrical disconnection", "system isolation", "circuit de energize",
        "breaker isolation", "electrical isolation", "circuit remained live", "remained live", "energized equipment", "live circuit",
    ),
    STANDBY: ("standby person", "hole watch", "safety attendant", "safety watcher", "entry watcher", "standby observer"),
    ZONE: (
        "exclusion zone", "perimeter barricade", "drop zone clearance", "red zone demarcation", "lift exclusion", "safety perimeter",
        "area was barricaded", "barricaded", "barricade", "beneath suspended load", "under suspended load", "positioned beneath suspended load",
        "entered the drop zone", "path of moving equipment",
    ),
    WATCH: ("fire watch", "fire guard", "spark watch", "hot work watch"),
    PPE: ("personal protective equipment", "safety glasses", "eye protection", "face shield", "hard hat", "respirator unit"),
    PRESSURE: ("pressure release", "line venting", "bleed off", "residual pressure", "line depressurization"),
}
# Words that say that a control was left out, and words that put work before it.
OMISSIONS = (
    "without", "with no", "no", "not", "missing", "lack of", "lacked", "absence of", "skipped", "omitted", "neglected", "failed to", "forgot to",
    "unperformed", "untested", "unverified", "unauthorized", "without any", "did not conduct", "did not perform", "did not do", "did not obtain",
    "did not apply", "did not isolate", "did not check", "did not wear", "did not tie", "did not assign", "without being",
)
OMITTED_ACTS = (
    "without", "with no", "no", "not", "forgot to", "omitted to", "failed to", "neglected to", "did not", "didnt", "missing",
)
BEFORE = (
    "before", "prior to", "ahead of", "in advance of", "previous to",
)
ACTIVITY = r"\b(?:opened|opening|started|starting|began|beginning|commenced|commencing|proceeded|proceeding|worked|working|serviced|servicing|repaired|repairing|maintenance|operation|climb|climbed|access|accessed)\b"
# Hyphens and spacing of the concepts' normal form.
HYPHENS = (
    (r"\bconfined[\s-]space\b", "confined space"), (r"\block[\s-]out[\s-]tag[\s-]out\b", "lockout tagout"), (r"\block[\s-]out\b", "lockout"), (r"\btag[\s-]out\b", "tagout"), (r"\bstop[\s-]work\b", "stop work"),
    (r"\bde[\s-]energiz", "de energiz"), (r"\btie[\s-]off\b", "tie off"), (r"\btied[\s-]off\b", "tied off"), (r"\bdrop[\s-]zone\b", "drop zone"), (r"\bair[\s-]monitoring\b", "air monitoring"),
    (r"\bgas[\s-]testing\b", "gas testing"), (r"\bgas[\s-]test\b", "gas test"), (r"\bfire[\s-]watch\b", "fire watch"), (r"\bhole[\s-]watch\b", "hole watch"),
)
# Patterns of the second stage.
PATTERNS = {
    GAS: (
        r"\b(?:without|no|not|missing|lacked|forgot|omitted|skipped|bypassed|neglected|failed\s+to(?:\s+conduct|\s+perform)?)\s+(?:to\s+)?(?:conduct\s+|perform\s+|do\s+)?(?:any\s+)?(?:gas|atmospheric|atmosphere|oxygen|air)\s+(?:test(?:ing)?|check(?:ing)?|sampling|monitoring|levels?|measurement)\b",
        r"\b(?:gas|atmospheric|atmosphere|oxygen|air)\s+(?:levels?|sampling|test(?:ing)?|check(?:ing)?|monitoring)\s+(?:were|was|is|are)?\s*(?:not|never|omitted|skipped|forgotten|neglected)\s*(?:done|completed|conducted|performed|tested|checked|monitored|taken|measured)\b",
        r"\b(?:not|never|forgot\s+to|omitted\s+to)\s+(?:tested|test|checked|check|monitored|sampled)\s+(?:for\s+gas|the\s+atmosphere|atmospheric|air\s+quality|oxygen|gas\s+levels)\b",
        r"\b(?:without|no|forgot|skipped|omitted)\s+(?:gas\s+test|gas\s+testing|atmospheric\s+test|atmospheric\s+testing|gas\s+check)\b",
        r"\b(?:skipped|omitted|neglected|forgot)\s+(?:gas\s+test|atmospheric\s+test|gas\s+monitoring)\b",
        r"\b(?:without|no)\s+(?:any\s+)?testing\b",
        r"\bentry\s+without\s+testing\b",
    ),
    PERMIT: (
        r"\b(?:without|no|not|missing|lacked|skipped|omitted|forgot|bypassed|failed\s+to\s+obtain)\s+(?:to\s+obtain\s+)?(?:any\s+)?(?:valid\s+)?(?:work\s+)?(?:permit|clearance|ptw|authorization|approval|entry\s+clearance|entry\s+permit)\b",
        r"\b(?:permit|ptw|authorization|clearance|entry\s+clearance|work\s+permit)\s+(?:was|were|is|are)?\s*(?:not|never)\s*(?:issued|obtained|authorized|approved|signed|granted)\b",
        r"\bentered\s+(?:.*?\s+)?without\s+(?:any\s+)?(?:clearance|permit|authorization|approval|ptw)\b",
        r"\bunauthorized\s+(?:entry|work|activity)\b",
        r"\bno\s+permit\s+was\s+issued\b",
    ),
    FALL: (
        r"\b(?:without|no|not|missing|lacked|forgot|omitted|skipped|bypassed)\s+(?:any\s+)?(?:safety\s+)?(?:harness|fall\s+protection|fall\s+arrest|guardrail|edge\s+protection|lifeline|safety\s+line|lanyard)\b",
        r"\b(?:not|never|forgot\s+to\s+wear)\s+(?:wearing|tied\s+off|hooked\s+up|attached|secured)\s+(?:with\s+)?(?:a\s+)?(?:safety\s+)?(?:harness|at\s+height|to\s+lifeline|fall\s+protection)?\b",
        r"\b(?:worker|technician|personnel|contractor|operator)\s+(?:was\s+|were\s+)?not\s+tied\s+off\b",
        r"\bunsecured\s+at\s+height\b",
        r"\bnot\s+tied\s+off\s+at\s+height\b",
    ),
    LOCKOUT: (
        r"\b(?:without|no|not|missing|forgot|omitted|skipped|bypassed)\s+(?:lockout|tagout|loto|breaker\s+lock|padlock)\b",
        r"\b(?:lockout|tagout|loto)\s+(?:was|were)?\s*(?:not|never)\s*(?:applied|done|completed|performed|installed)\b",
        r"\bloto\s+not\s+(?:done|applied|completed)\b",
    ),
    ISOLATION: (
        r"\b(?:without|no|not|missing|forgot|omitted|skipped|bypassed)\s+(?:energy\s+)?(?:isolation|isolating)\b",
        r"\b(?:energy|circuit|power|system|equipment|line)\s+(?:was|were)?\s*(?:not|never)\s*(?:isolated|de\s*energized|switched\s+off)\b",
        r"\b(?:live\s+circuit|energized\s+system)\s+(?:was\s+)?not\s+isolated\b",
        r"\bnot\s+de\s*energized\b",
        r"\b(?:circuit|equipment|panel|system|line)\s+(?:remained|was\s+still|still)\s+(?:live|energized)\b",
        r"\bwhile\s+(?:the\s+)?(?:circuit|equipment|panel|system)\s+remained\s+(?:live|energized)\b",
    ),
    STANDBY: (
        r"\b(?:without|no|not|missing|forgot|omitted)\s+(?:any\s+)?(?:standby|standby\s+person|attendant|hole\s+watch|watcher|sentry)\b",
        r"\b(?:standby(?:\s+person)?|attendant|hole\s+watch)\s+(?:was|were)?\s*(?:not|never)\s*(?:assigned|present|posted|stationed|available)\b",
    ),
    ZONE: (
        r"\b(?:without|no|not|missing|forgot|omitted)\s+(?:any\s+)?(?:exclusion\s+zone|barricade|perimeter|drop\s+zone|warning\s+tape)\b",
        r"\b(?:exclusion\s+zone|barricade)\s+(?:was|were)?\s*(?:not|never)\s*(?:established|set\s+up|created|posted|demarcated)\b",
        r"\b(?:standing|stood|positioned|stationed|walked|walking|working)\s+(?:under|below|beneath)\s+(?:a\s+)?(?:suspended\s+)?(?:load|crane|lift|rigging)\b",
        r"\b(?:entered|inside|crossed\s+into)\s+(?:the\s+)?(?:drop\s+zone|lift\s+radius|red\s+zone)\b",
        r"\b(?:in\s+the\s+path\s+of|path\s+of)\s+(?:moving\s+)?(?:equipment|machinery|vehicle)\b",
    ),
    WATCH: (
        r"\b(?:without|no|not|missing|forgot|omitted)\s+(?:any\s+)?(?:fire\s+watch|fire\s+guard|spark\s+watch)\b",
        r"\b(?:fire\s+watch|fire\s+guard)\s+(?:was|were)?\s*(?:not|never)\s*(?:posted|assigned|present|available|stationed)\b",
    ),
    PPE: (
        r"\b(?:without|no|not|missing|forgot|omitted)\s+(?:any\s+|approved\s+|proper\s+|required\s+|standard\s+)?(?:ppe|protective\s+equipment|gloves|safety\s+glasses|eye\s+protection|helmet|hard\s+hat|mask|respirator)\b",
        r"\bnot\s+wearing\s+(?:any\s+|approved\s+|proper\s+|required\s+|standard\s+)?(?:ppe|gloves|safety\s+glasses|eye\s+protection|helmet|hard\s+hat|mask|respirator|protection)\b",
    ),
    PRESSURE: (
        r"\b(?:not|never|was\s+not|forgot\s+to|omitted\s+to)\s+(?:depressurized|vented|bled|drained)\b",
        r"\b(?:pressure|line|vessel|system)\s+(?:was\s+)?(?:not\s+released|still\s+under\s+pressure|not\s+depressurized|not\s+bled|not\s+vented)\b",
        r"\bresidual\s+pressure\s+(?:not\s+bled|remained)\b",
    ),
}
# Phrases that mean the same.
SYNONYMS = {
    GAS: (
        "no gas test", "no gas testing", "without gas test", "without gas testing", "gas testing not done", "gas test not done",
        "gas testing was not done", "gas test was not done", "gas testing not completed", "gas testing was not completed", "gas test not completed",
        "no atmospheric test", "no atmospheric testing", "without atmospheric test", "without atmospheric testing", "atmospheric test missing",
        "no atmospheric test done", "gas check not performed", "no gas check", "gas check missing", "gas monitoring not conducted",
        "not tested for gas", "gas not tested", "atmosphere not tested", "oxygen levels were not checked", "oxygen levels not checked",
    ),
    PERMIT: (
        "no permit", "no work permit", "permit not obtained", "permit was not obtained", "permit not issued", "permit was not issued",
        "no permit was issued", "without permit", "without work permit", "without authorization", "no authorization", "missing permit",
        "work permit missing", "no valid permit", "entry not authorized", "unauthorized entry", "unauthorized work", "ptw not issued",
        "ptw not obtained", "without ptw", "no ptw", "without clearance or permit", "without any clearance or permit",
    ),
    FALL: (
        "no harness", "without harness", "no safety harness", "not wearing harness", "not wearing safety harness", "no fall protection",
        "without fall protection", "fall protection not used", "fall protection missing", "no fall arrest", "without fall arrest", "not tied off",
        "not tied off at height", "harness was missing", "harness was not available", "no guardrail", "no edge protection", "no safety line",
        "unsecured at height", "working at height without harness",
    ),
    LOCKOUT: (
        "lockout not applied", "tag not applied", "tagout not applied", "loto not completed", "loto not done", "loto not applied", "lockout not done",
        "lockout not completed", "tagout not completed", "no lockout", "without lockout", "without loto", "no loto", "loto missing",
    ),
    ISOLATION: (
        "without isolation", "without isolat", "no isolation", "not isolated", "isolation not applied", "isolation was not applied",
        "missing isolation", "isolation missing", "energy not isolated", "not de energized", "not deenergized", "live circuit not isolated",
        "power not isolated",
    ),
    STANDBY: (
        "no standby", "no standby person", "standby person not assigned", "standby not assigned", "without standby", "standby was missing",
        "no attendant", "attendant not assigned", "no hole watch", "hole watch missing",
    ),
    ZONE: (
        "no exclusion zone", "exclusion zone not established", "exclusion zone missing", "without exclusion zone", "no exclusion",
        "zone not established", "standing under suspended load", "standing under load", "below load", "standing below load", "no barricade",
        "drop zone not cleared",
    ),
    WATCH: ("no fire watch", "without fire watch", "fire watch not posted", "missing fire watch", "fire watch missing", "no fire guard"),
    PPE: (
        "without ppe", "no ppe", "missing ppe", "ppe was missing", "ppe was not available", "ppe not available", "ppe not worn", "not wearing ppe",
        "without protection", "without gloves", "not wearing gloves", "not wearing safety glasses", "not wearing eye protection",
        "not wearing helmet", "not wearing mask",
    ),
    PRESSURE: (
        "pressure not released", "not depressurized", "was not depressurized", "still under pressure", "line under pressure",
        "system not depressurized", "pressure not bled",
    ),
}
# Phrases that count near a negation.
NEAR = {
    GAS: (
        "atmospheric check", "oxygen test", "gas sampling", "atmospheric testing", "oxygen levels", "gas check", "air monitoring",
        "testing procedure", "gas measurement", "oxygen sampling", "air quality check",
    ),
    PERMIT: (
        "authorization", "approval", "entry clearance", "ptw", "work clearance", "clearance", "entry permit", "formal permit", "work authorization",
    ),
    FALL: ("safety harness", "fall arrest", "tie off", "lanyard", "lifeline", "edge protection", "height safety", "anchor point", "fall restraint"),
    LOCKOUT: ("lockout tagout", "loto application", "breaker lockout", "padlock application", "circuit isolation tag", "hasp locking"),
    ISOLATION: ("energy isolation", "de energization", "power cutoff", "electrical disconnection", "system isolation", "circuit de energize"),
    STANDBY: ("safety watcher", "safety attendant", "hole watch", "standby monitor", "entry watcher", "standby observer"),
    ZONE: ("perimeter barricade", "drop zone clearance", "red zone demarcation", "lift exclusion", "safety perimeter"),
    WATCH: ("spark watch", "fire guard", "extinguisher standby", "hot work watch"),
    PPE: ("personal protective equipment", "safety gear", "face shield", "respirator unit", "eye protection", "hard hat"),
    PRESSURE: ("pressure release", "line venting", "bleed off", "residual pressure", "hydraulic release", "line depressurization"),
}
# Keywords, two of which count near a negation.
KEYWORDS = {
    GAS: ("gas", "atmospheric", "atmosphere", "testing", "test", "tested", "check", "oxygen", "h2s", "sampling", "monitoring", "procedure"),
    PERMIT: ("permit", "ptw", "authorization", "authorized", "clearance", "approval"),
    FALL: ("harness", "lanyard", "anchor", "anchorage", "tied", "tie", "lifeline", "guardrail", "fall", "arrest", "height"),
    LOCKOUT: ("lockout", "tagout", "loto", "padlock", "breaker", "hasp"),
    ISOLATION: ("isolation", "isolated", "isolate", "de-energized", "deenergized", "energized", "power"),
    STANDBY: ("standby", "attendant", "watcher", "watchperson", "hole-watch", "sentry"),
    ZONE: ("exclusion", "barricade", "perimeter", "demarcation", "cordon", "suspended", "load"),
    WATCH: ("firewatch", "fire", "watch", "extinguisher", "spark-watch"),
    PPE: ("ppe", "glasses", "gloves", "helmet", "respirator", "mask", "goggles", "shield"),
    PRESSURE: ("depressurized", "depressurize", "pressure", "bled", "bleed", "venting", "vented", "vent"),
}
NEGATIONS = (
    "no", "not", "without", "missing", "lack", "lacked", "absence", "failed", "failure", "unauthorized", "unperformed", "untested", "unsecured",
    "unisolated", "skipped", "omitted", "neglected", "never", "cannot",
)
NEGATED = ("no ", "without ", "not ", "missing ", "skipped ", "omitted ", "failed ")
# Unclear wording, and wording that says that the control was there.
WEAK = {
    GAS: (
        r"\b(?:gas\s+test|testing|atmosphere|atmospheric\s+check)\s+(?:was\s+|is\s+)?(?:unclear|uncertain|unconfirmed|inconclusive|doubtful)\b",
        r"\b(?:unclear|uncertain|unconfirmed)\s+(?:if|whether)\s+(?:gas\s+test|testing|atmosphere)\b",
        r"\btesting\s+unclear\b",
    ),
    PERMIT: (r"\b(?:permit|clearance|ptw)\s+(?:was\s+|is\s+)?(?:unclear|uncertain|unconfirmed)\b",),
    FALL: (r"\b(?:harness|fall\s+protection|tie\s+off)\s+(?:was\s+|is\s+)?(?:unclear|uncertain|unconfirmed)\b",),
    ISOLATION: (r"\b(?:isolation|de\s*energization)\s+(?:was\s+|is\s+)?(?:unclear|uncertain|unconfirmed)\b",),
}
DONE = {
    GAS: (
        r"\b(?:gas\s+test(?:ing)?|atmospheric\s+test(?:ing)?|oxygen\s+test(?:ing)?|testing)\s+(?:was\s+|were\s+|is\s+)?(?:completed|conducted|performed|done|verified|confirmed|passed)\b",
        r"\b(?:completed|conducted|performed|done)\s+(?:the\s+)?(?:gas\s+test(?:ing)?|atmospheric\s+test(?:ing)?|testing)\b",
        r"\bgas\s+(?:was\s+)?tested\b",
        r"\b(?:not\s+skipped|not\s+omitted|was\s+not\s+skipped|was\s+not\s+omitted|did\s+not\s+skip|did\s+not\s+omit|never\s+skipped)\b",
        r"\batmosphere\s+(?:was\s+)?verified\s+safe\b",
    ),
    PERMIT: (
        r"\b(?:permit|ptw|authorization|clearance)\s+(?:was\s+|were\s+)?(?:obtained|issued|signed|authorized|approved|in\s+place|completed)\b",
        r"\b(?:obtained|issued|approved)\s+(?:the\s+)?(?:permit|ptw|authorization|clearance)\b",
    ),
    FALL: (
        r"\b(?:harness|fall\s+protection|lanyard|lifeline)\s+(?:was\s+|were\s+|is\s+)?(?:worn|used|attached|tied\s+off|secured|connected|already\s+secured)\b",
        r"\b(?:wearing|used|tied\s+off\s+with|connected|secured)\s+(?:safety\s+)?(?:harness|fall\s+protection|lanyard)\b",
        r"\bconnected\s+(?:the\s+)?(?:fall\s+protection|harness|lanyard)\b",
    ),
    LOCKOUT: (
        r"\b(?:lockout|tagout|loto)\s+(?:was\s+|were\s+)?(?:applied|completed|performed|done|installed|verified)\b",
        r"\b(?:breaker|panel)\s+(?:was\s+)?(?:locked\s+out|isolated)\b",
        r"\blocked\s+out\s+(?:and\s+verified)?\b",
    ),
    ISOLATION: (
        r"\b(?:isolation|circuit|equipment|line|breaker)\s+(?:was\s+|were\s+)?(?:isolated|de\s*energized|switched\s+off|verified\s+de\s*energized)\b",
        r"\bverified\s+de\s*energized\b",
        r"\bverified\s+(?:as\s+)?isolated\b",
    ),
    ZONE: (
        r"\b(?:area|perimeter|zone)\s+(?:was\s+)?(?:barricaded|cordoned|established|secured)\b",
        r"\b(?:remained|stayed|stood)\s+outside\s+(?:the\s+)?(?:drop\s+zone|lift\s+radius|perimeter|exclusion\s+zone)\b",
    ),
}
# What belongs to a hazard, and the rule whose control a barrier is.
ENTITIES = {
    "Confined Space": (
        "vessel", "tank", "chamber", "pit", "sump", "manhole", "column", "reactor", "pipe", "pipeline", "duct", "silo", "vault", "sewer",
        "compartment", "enclosed space", "confined space", "drum", "boiler", "tanker", "tunnel",
    ),
    "Working at Height": (
        "scaffold", "scaffolding", "ladder", "tower", "roof", "platform", "elevated platform", "manlift", "cherry picker", "mast", "beam", "edge",
        "walkway at height", "structure", "overhead", "staging",
    ),
    "Energy Isolation": (
        "electrical panel", "breaker", "breaker panel", "circuit", "switchgear", "busbar", "transformer", "motor", "pump", "live wire",
        "live circuit", "high voltage", "energized line", "stored energy", "distribution board", "mcc", "substation", "generator", "energized system",
        "live conductor",
    ),
    "Hot Work": ("welding", "torch cutting", "open flame", "grinding sparks", "brazing", "plasma cutting", "hot work", "torch", "arc", "grinder"),
    "Chemical Handling": (
        "acid", "caustic", "toxic", "corrosive", "chemical", "chlorine", "ammonia", "solvent", "h2s", "hazardous chemical", "toxic gas",
        "chemical splash", "fumes",
    ),
    "Vehicle Movement": ("forklift", "hgv", "truck", "vehicle", "excavator", "loader", "traffic", "trailer", "reach truck", "telehandler"),
}
# What tells of exposure, first matches count; a rule's words beside its things.
_ROOM = r"(?:confined\s+space|vessel|tank|reactor|column|sump|pit|chamber|pipe|drum)"
EXPOSURES = {
    "ENTRY_EXPOSURE": (
        r"\b(?:entered|was\s+entering|had\s+entered|proceeded\s+to\s+enter|stepping\s+into|stepped\s+into|went\s+into|gone\s+into|crawled\s+into|climbed\s+into)"
        rf"(?:\s+(?:the\s+)?{_ROOM})?\b",
        rf"\b(?:went\s+inside|stepped\s+inside|stepping\s+inside|gone\s+inside|accessed\s+the\s+inside|inside\s+the)(?:\s+(?:the\s+)?{_ROOM})?\b",
        rf"\b(?:accessing|accessed|penetrated|entered\s+the|entry\s+into)(?:\s+(?:the\s+)?{_ROOM})?\b",
        rf"\b(?:opened|opening|accessing|accessed|working\s+on)\s+(?:the\s+)?{_ROOM}\b",
        r"\b(?:entry\s+occurred|entry\s+was\s+made|unauthorized\s+entry|confined[\s-]space\s+entry|vessel\s+entry|tank\s+entry|manhole\s+entry|chamber\s+entry)\b",
        r"\b(?:worker|technician|operator|crew|personnel|contractor)\s+(?:inside|in\s+the)\b",
    ),
    "HEIGHT_EXPOSURE": (
        r"\b(?:climbed|climbing|mounted|mounting|ascended|ascending)\b",
        r"\b(?:working\s+at\s+height|working\s+on\s+(?:scaffold|scaffolding|ladder|roof|platform|tower))\b",
        r"\b(?:at\s+height|above\s+ground|elevated\s+work)\b",
    ),
    "ENERGY_EXPOSURE": (
        r"\b(?:working\s+on|worked\s+on|servicing|serviced|repaired|repairing|troubleshooting|operating\s+on|operated\s+on|opened|opening)\s+(?:a\s+|the\s+)?"
        r"(?:live\s+|energized\s+|electrical\s+)?(?:circuit|panel|breaker|switchgear|motor|pump|board|transformer|switch|equipment)\b",
        r"\b(?:operated|working\s+with|worked\s+with)\s+(?:live\s+circuit|energized\s+system|energized\s+equipment)\b",
        r"\b(?:touched|touching|handling)\s+(?:busbar|live\s+conductor|live\s+wire)\b",
        r"\b(?:maintenance|servicing|work|repair)\s+(?:began|started|conducted|performed)?\s*while\s+.*?\s+(?:live|energized)\b",
    ),
    "LINE_OF_FIRE_EXPOSURE": (
        r"\b(?:walked|walking|standing|stood|positioned|stationed|moved)\s+(?:under|below|beneath)\s+(?:a\s+)?(?:suspended\s+load|load|crane|crane\s+load|lift|overhead\s+load|pipe)\b",
        r"\b(?:under|below|beneath)\s+(?:a\s+)?(?:suspended\s+load|overhead\s+load)\b",
        r"\b(?:entered|inside|crossed\s+into)\s+(?:the\s+)?(?:drop\s+zone|line\s+of\s+fire|lift\s+radius)\b",
        r"\b(?:in\s+the\s+path\s+of|path\s+of)\s+(?:moving\s+)?(?:equipment|machinery|vehicle)\b",
    ),
}
BESIDE = {"Working at Height": ("climbed", "working", "on", "above"), "Energy Isolation": ("servicing", "repair", "operating", "working", "live"), "Confined Space": ("inside", "gas", "atmosphere", "air")}
# Controls that a text says were there, by the rule they belong to.
CONTROLS = {
    "gas_testing_verified": ("Confined Space", (
        r"\b(?:gas\s+testing|gas\s+test|atmospheric\s+testing|atmospheric\s+monitoring|atmosphere)\s+(?:was|were|is)?\s*(?:completed|verified|performed|done|confirmed|tested|verified\s+safe)\b",
        r"\b(?:completed|verified)\s+(?:gas\s+testing|atmospheric\s+monitoring|air\s+testing)\s+before\s+entry\b",
        r"\batmosphere\s+(?:was\s+)?verified\s+safe\b",
        r"\bgas\s+testing\s+was\s+not\s+skipped\b",
        r"\bnot\s+skipped\s+(?:any\s+)?(?:gas\s+testing|atmospheric\s+testing)\b",
    )),
    "fall_protection_verified": ("Working at Height", (
        r"\b(?:connected|secured|tied\s+off|attached)\s+(?:safety\s+)?(?:fall\s+protection|harness|lanyard)\b",
        r"\b(?:fall\s+protection|harness|lanyard)\s+(?:was\s+|were\s+)?(?:already\s+secured|secured|connected|tied\s+off|inspected)\b",
        r"\bworker\s+connected\s+fall\s+protection\s+before\s+climbing\b",
        r"\bconnected\s+(?:the\s+)?(?:fall\s+protection|harness)\s+before\s+(?:climbing|work)\b",
    )),
    "energy_isolation_verified": ("Energy Isolation", (
        r"\b(?:breaker|panel|circuit|equipment)\s+(?:was\s+)?(?:locked\s+out|isolated|de-energized)\b",
        r"\b(?:locked\s+out\s+and\s+verified\s+de-energized|verified\s+de-energized)\b",
        r"\blockout\s+was\s+completed\s+before\s+work\b",
        r"\blockout\s+tagout\s+(?:was\s+)?(?:verified|completed)\b",
    )),
    "exclusion_zone_verified": ("Line of Fire", (
        r"\barea\s+was\s+barricaded\b",
        r"\b(?:remained|stayed)\s+outside\s+(?:the\s+)?(?:drop\s+zone|lift\s+radius|perimeter|exclusion\s+zone)\b",
        r"\bexclusion\s+zone\s+(?:was\s+)?(?:established|barricaded)\b",
    )),
}
# Concepts of the barriers.
CONCEPTS = {
    GAS: "gas_testing_missing", PERMIT: "permit_missing", FALL: "fall_protection_missing", LOCKOUT: "lockout_tagout_missing", ISOLATION: "isolation_missing",
    STANDBY: "standby_missing", ZONE: "exclusion_zone_missing", WATCH: "fire_watch_missing", PPE: "ppe_missing", PRESSURE: "pressure_not_released",
}
RULE_OF = {GAS: "Confined Space", PERMIT: "Confined Space", FALL: "Working at Height", LOCKOUT: "Energy Isolation", ISOLATION: "Energy Isolation", STANDBY: "Confined Space", ZONE: "Line of Fire", WATCH: "Hot Work", PPE: "General Safety", PRESSURE: "Energy Isolation"}
#: Barriers that an office without anything industrial can't have.
INDUSTRIAL_ONLY = (LOCKOUT, GAS, PRESSURE, FALL, WATCH)
#: Least confidence that is reported, confidences of the bands, how many are reported.
LEAST, HIGH, MEDIUM, TOP = 0.45, 0.85, 0.60, 3


def _group(words: Iterable[str]) -> str:
    """Alternatives, the longest first."""
    return "(?:" + "|".join(re.escape(w) for w in sorted(dict.fromkeys(words), key=len, reverse=True)) + ")"


def forms(barrier: str) -> dict[str, tuple[float, str]]:
    """Confidence and pattern of the ways in which a phrase says that a control was left out."""
    verbs, targets, names = _group(VERBS[barrier]), _group(TARGETS[barrier]), _group(COMPOUNDS[barrier] + TARGETS[barrier])
    left_out = rf"\b{_group(OMISSIONS)}\s+(?:any\s+|the\s+|proper\s+|required\s+|valid\s+)?"
    not_done = r"\b(?:" + "|".join(re.escape(w) for w in OMITTED_ACTS) + r")\s+(?:to\s+)?"
    before = r"\b(?:" + "|".join(re.escape(w) for w in BEFORE) + r")\s+(?:the\s+|an\s+|any\s+|area\s+|circuit\s+|equipment\s+|line\s+|work\s+)?(?:was\s+|were\s+|is\s+|are\s+)?"
    return {
        "name": (0.98, rf"{left_out}{names}\b"),
        "act": (0.96, rf"{not_done}{verbs}\s+(?:the\s+|any\s+|all\s+|required\s+|proper\s+)?{targets}\b"),
        "before name": (0.95, rf"{before}(?:any\s+|the\s+|conducting\s+|performing\s+|doing\s+|completing\s+|verifying\s+)?{names}\b"),
        "before act": (0.94, rf"{before}{verbs}\s+(?:the\s+|any\s+|required\s+)?{targets}\b"),
        "passive": (0.95, rf"{targets}\s+(?:was|were|is|are)?\s*(?:not|never|omitted|skipped|forgotten|neglected)\s*(?:done|completed|conducted|performed|{verbs})\b"),
    }


def hyphenless(c: Column) -> Column:
    """Lower case with the compounds of safety language in one spelling and single spaces."""
    t = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    for pattern, put in HYPHENS:
        t = F.regexp_replace(t, pattern, put)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def plain(phrase: str) -> str:
    """A phrase of the tables in the narrative's normal form."""
    for short, full in ABBREVIATIONS.items():
        phrase = re.sub(rf"\b{short}\b", full, phrase)
    return " ".join(corrected(w) for w in re.sub(r"[^\w\s]", " ", phrase).split())


def _found(text: Column, phrases: Iterable[str]) -> Column:
    """The phrases that occur, in the table's order."""
    return F.filter(F.array(*[F.lit(p) for p in dict.fromkeys(phrases)]), lambda p: F.contains(text, p))


def _matches(text: Column, patterns: Iterable[str]) -> Column:
    """The first match of each pattern that has one."""
    return F.filter(F.array(*[F.regexp_extract(text, p, 0) for p in patterns]), lambda m: m != "")


def _any_word(text: Column, words: Iterable[str]) -> Column:
    return text.rlike(r"\b(?:" + "|".join(re.escape(w) for w in words) + r")\b")


def _longest_word(text: Column, words: Iterable[str]) -> Column:
    """The longest of the words that occurs; null if none does."""
    return F.try_element_at(F.filter(F.array(*[F.regexp_extract(text, rf"\b{re.escape(w)}\b", 0) for w in sorted(words, key=lambda w: (-len(w), w))]), lambda m: m != ""), F.lit(1))


def exposed(df: DataFrame) -> DataFrame:
    """df (with `safe`, the form of `hyphenless`) and what it tells of exposure.

    Adds entry, height, energy and fire (array<string>, first matches), near_height
    and near_energy (a rule's thing beside one of its words), exposure (all matches)
    and is_exposed.
    """
    some = lambda rule: any_of(F.col("safe"), BESIDE[rule])
    df = df.withColumns({name: _matches(F.col("safe"), EXPOSURES[kind]) for name, kind in zip(("entry", "height", "energy", "fire"), EXPOSURES, strict=True)})
    df = df.withColumns({f"near_{name}": _any_word(F.col("safe"), ENTITIES[rule]) & some(rule) for name, rule in (("height", "Working at Height"), ("energy", "Energy Isolation"))})
    df = df.withColumn("exposure", F.concat("entry", "height", "energy", "fire"))
    return df.withColumn("is_exposed", (F.size("exposure") > 0) | F.col("near_height") | F.col("near_energy"))


def exposure_type() -> Column:
    """The first kind of exposure that a row of exposed() has; null without any."""
    entry, height, energy, fire = EXPOSURES
    return (
        F.when(F.size("entry") > 0, entry).when((F.size("height") > 0) | F.col("near_height"), height)
        .when((F.size("energy") > 0) | F.col("near_energy"), energy).when(F.size("fire") > 0, fire)
    )


def domains() -> Column:
    """The rules that a row of exposed() with `safe` and `omissions` touches: by what it names, what is done there, and the controls left out or in place."""
    safe = F.col("safe")
    named = lambda rule: _any_word(safe, ENTITIES[rule])
    tests = {
        "Confined Space": named("Confined Space") | ((F.size("entry") > 0) & any_of(safe, BESIDE["Confined Space"])),
        "Working at Height": (F.size("height") > 0) | F.col("near_height"),
        "Energy Isolation": (F.size("energy") > 0) | F.col("near_energy"),
        "Line of Fire": F.size("fire") > 0,
        **{rule: named(rule) for rule in ("Hot Work", "Chemical Handling", "Vehicle Movement")},
    }
    left_out = F.transform("omissions", lambda x: x["rule"])
    in_place = F.transform("controls", lambda x: x["rule"])
    return F.array_distinct(F.concat(F.array_compact(F.array(*[F.when(t, F.lit(rule)) for rule, t in tests.items()])), left_out, in_place))


def omissions(df: DataFrame) -> DataFrame:
    """df with `omissions`: array<struct<barrier, concept, rule, phrase, confidence>>, the controls that a phrase of `safe` says were left out.

    The first form that matches counts; those with `before` need an activity or exposure.
    """
    # Every form holds one of these: without them no pattern is tried.
    signs = any_of(F.col("safe"), dict.fromkeys((*OMISSIONS, *OMITTED_ACTS, *BEFORE, "never", "forgotten")))
    df = df.withColumns({"_signs": signs, "_busy": F.col("is_exposed") | F.col("safe").rlike(ACTIVITY)})
    where = F.when(F.col("_signs"), F.col("safe")).otherwise("")
    df = df.withColumn("_where", where).withColumn("_active", F.when(F.col("_busy"), F.col("_where")).otherwise(""))
    columns = {}
    for k, barrier in enumerate(BARRIERS):
        tests = [
            F.struct(F.lit(barrier).alias("barrier"), F.lit(CONCEPTS[barrier]).alias("concept"), F.lit(RULE_OF[barrier]).alias("rule"), F.regexp_extract("_active" if name.startswith("before") else "_where", pattern, 0).alias("phrase"), F.lit(score).alias("confidence"))
            for name, (score, pattern) in forms(barrier).items()
        ]
        columns[f"_left{k}"] = F.try_element_at(F.filter(F.array(*tests), lambda x: x["phrase"] != ""), F.lit(1))
    df = df.withColumns(columns)
    return df.withColumn("omissions", F.array_compact(F.array(*columns))).drop(*columns, "_signs", "_busy", "_where", "_active")


def controls(safe: Column) -> Column:
    """array<struct<concept, rule, phrase>>: the controls that a text says were there, by the first pattern of each that matches."""
    rows = [F.struct(F.lit(name).alias("concept"), F.lit(rule).alias("rule"), F.try_element_at(_matches(safe, patterns), F.lit(1)).alias("phrase")) for name, (rule, patterns) in CONTROLS.items()]
    return F.filter(F.array(*rows), lambda x: x["phrase"].isNotNull())


def done(norm: Column) -> Column:
    """Whether a text says that any control was there."""
    return norm.rlike("|".join(p for patterns in DONE.values() for p in patterns))


def detected(df: DataFrame) -> DataFrame:
    """df (with norm, the normal form, and omissions) and `items`: array<struct<barrier, confidence, method, evidence, band>>.

    At most TOP, the most confident first, ties by name. Stages are projections of their own, as each is used several times by the next one.
    """
    norm = F.col("norm")
    negated = _any_word(norm, NEGATIONS) | any_of(norm, NEGATED)
    office = _any_word(norm, OFFICE) & ~_any_word(norm, INDUSTRIAL)
    df = df.withColumns({"_negated": negated, "_office": office})
    none = F.array().cast("array<string>")
    left_out = lambda barrier: F.try_element_at(F.filter("omissions", lambda x: x["barrier"] == barrier), F.lit(1))
    stage = {}
    for k, b in enumerate(BARRIERS):
        stage |= {
            f"_exact{k}": _matches(norm, PATTERNS[b]), f"_same{k}": _found(norm, map(plain, SYNONYMS[b])),
            f"_near{k}": F.when(F.col("_negated"), _found(norm, map(plain, NEAR[b]))).otherwise(none), f"_words{k}": F.array_sort(_found(norm, KEYWORDS[b])),
            f"_left{k}": left_out(b),
        }
        if b in WEAK:
            stage[f"_weak{k}"] = _matches(norm, WEAK[b])
        if b in DONE:
            stage[f"_done{k}"] = norm.rlike("|".join(DONE[b]))
    df = df.withColumns(stage)
    df = df.withColumns({f"_said{k}": F.array_distinct(F.concat(f"_exact{k}", f"_same{k}")) for k in range(len(BARRIERS))})
    first = lambda k: F.when(F.col(f"_left{k}").isNull(), none).otherwise(F.array(F.col(f"_left{k}")["phrase"]))
    df = df.withColumns({f"_first{k}": F.slice(F.array_distinct(F.concat(F.col(f"_said{k}"), first(k))), 1, 4) for k in range(len(BARRIERS))})
    df = df.withColumns({f"_item{k}": _item(k, b) for k, b in enumerate(BARRIERS)})
    df = df.withColumn("_found", F.filter(F.array(*[f"_item{k}" for k in range(len(BARRIERS))]), lambda x: x.isNotNull() & (x["confidence"] >= LEAST)))
    df = df.withColumn("_several", F.size(F.filter("_found", lambda x: x["confidence"] >= HIGH)) >= 2)
    more = lambda x: F.when(F.col("_several"), F.least(F.lit(1.0), F.bround(x["confidence"] + 0.05, 2))).otherwise(x["confidence"])
    df = df.withColumn("_raised", F.transform("_found", lambda x: F.struct((-more(x)).alias("rank"), x["barrier"].alias("barrier"), x["method"].alias("method"), x["evidence"].alias("evidence"))))
    band = lambda c: F.when(c >= HIGH, "HIGH").when(c >= MEDIUM, "MEDIUM").otherwise("LOW")
    best = F.transform(F.slice(F.array_sort("_raised"), 1, TOP), lambda x: F.struct(x["barrier"].alias("barrier"), (-x["rank"]).alias("confidence"), x["method"].alias("method"), x["evidence"].alias("evidence"), band(-x["rank"]).alias("band")))
    helpers = [f"_{name}{k}" for k in range(len(BARRIERS)) for name in ("exact", "same", "near", "words", "left", "weak", "done", "said", "first", "item")]
    return df.withColumn("items", best).drop(*helpers, "_negated", "_office", "_found", "_several", "_raised")


def _item(k: int, b: str) -> Column:
    """struct<barrier, confidence, method, evidence> of one barrier from the columns of its stages, or null."""
    said, evidence, near, words, left = (F.col(f"_{c}{k}") for c in ("said", "first", "near", "words", "left"))
    # Confidences are hundredths: they are reckoned as whole numbers, so that rounding has no ties.
    score = F.least(F.lit(99), 92 + (F.size(said) - 1) * 3) / 100
    with_near = F.concat(evidence, F.filter(near, lambda s: ~F.array_contains(evidence, s)))
    item = lambda c, m, e: F.struct(F.lit(b).alias("barrier"), c.cast("double").alias("confidence"), F.lit(m).alias("method"), e.alias("evidence"))
    out = (
        F.when(F.size(said) > 0, item(F.greatest(score, F.coalesce(left["confidence"], F.lit(0.0))), "synonym", with_near))
        .when(left.isNotNull(), item(left["confidence"], "concept", with_near))
        .when(F.size(near) > 0, item(F.least(F.lit(88), 80 + (F.size(near) - 1) * 4) / 100, "semantic", F.slice(near, 1, 3)))
        .when((F.size(words) >= 2) & F.col("_negated"), item(F.lit(0.60), "keyword", F.array(F.concat(F.lit("Keywords: "), F.array_join(F.slice(words, 1, 3), " + ")))))
    )
    if b in WEAK:
        out = out.when(F.size(f"_weak{k}") > 0, item(F.lit(0.50), "weak_signal", F.slice(f"_weak{k}", 1, 1)))
    if b in DONE:
        out = F.when(~(F.col(f"_done{k}") & (F.size(f"_exact{k}") == 0)), out)
    if b in INDUSTRIAL_ONLY:
        return F.when(~F.col("_office"), out)
    return F.when(~F.col("_office"), out).otherwise(out.withField("confidence", F.bround(F.greatest(F.lit(0.0), out["confidence"] - 0.4), 2)))


def structured(rule: Column, safe_outcome: Column) -> Column:
    """What supports an analysis, in order: exposure, controls left out, controls in place; else the places a text names.

    For a row with the columns of exposed(), omissions, controls and domains:
    array<struct<concept, phrase, type, state, barrier, rule>>, distinct by concept, phrase
    and state. rule is the analysis's rule, safe_outcome whether exposure was prevented.
    """
    state = F.when(safe_outcome, "PREVENTED").otherwise("ACTIVE_VIOLATION")
    order = ("Confined Space", "Working at Height", "Energy Isolation", "Hot Work", "Line of Fire", "Chemical Handling", "Vehicle Movement")
    primary = F.coalesce(F.try_element_at(F.filter(F.array(*[F.lit(r) for r in order]), lambda r: F.array_contains("domains", r)), F.lit(1)), F.array_min("domains"), F.lit("General Safety"))
    context = F.when(rule != "General Safety", rule).otherwise(primary)
    none = F.lit(None).cast("string")
    row = lambda concept, phrase, kind, where, barrier, of: F.struct(concept.alias("concept"), phrase.alias("phrase"), kind.alias("type"), where.alias("state"), barrier.alias("barrier"), of.alias("rule"))
    kind = exposure_type()
    exposure = F.when(F.size("exposure") > 0, F.array(row(F.lower(kind), F.try_element_at("exposure", F.lit(1)), kind, state, none, context)))
    left_out = F.transform("omissions", lambda x: row(x["concept"], x["phrase"], F.lit("BARRIER_OMISSION"), state, x["barrier"], context))
    in_place = F.transform("controls", lambda x: row(x["concept"], x["phrase"], F.lit("POSITIVE_CONTROL"), F.lit("POSITIVE_CONTROL"), none, x["rule"]))
    places = [(c, r, _longest_word(F.col("safe"), ENTITIES[r])) for c, r in (("confined_space", "Confined Space"), ("working_at_height", "Working at Height"), ("energy_isolation", "Energy Isolation"))]
    named = F.filter(F.array(*[row(F.lit(c), w, F.lit("SPATIAL_ENTITY"), F.lit("CONTEXT_ONLY"), none, F.lit(r)) for c, r, w in places]), lambda x: x["phrase"].isNotNull())
    no_rows = F.filter(named, lambda _: F.lit(False))
    told = F.concat(F.coalesce(exposure, no_rows), left_out, in_place)
    first = lambda rows: F.filter(rows, lambda x, i: F.size(F.filter(F.slice(rows, 1, i), lambda y: (y["concept"] == x["concept"]) & (y["phrase"] == x["phrase"]) & (y["state"] == x["state"]))) == 0)
    alone = ~F.col("is_exposed") & (F.size("omissions") == 0) & (F.size("controls") == 0)
    return F.when(alone, named).otherwise(first(told))
