"""Queries over narratives, and SQL that states the same rules from the fixed values."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardlens.functions import narrative as n
from hazardlens.operators.analysis import analyze
from hazardlens.operators.distinct import once
from hazardlens.sources.adapters import NARRATIVES_SQL, narratives


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_q(pattern)})"


def _hits(phrases: tuple[str, ...]) -> str:
    return f"len(list_filter([{', '.join(_q(f' {p} ') for p in phrases)}], lambda p: contains(' ' || norm || ' ', p)))"


def _any(phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower, {_q(p)})" for p in phrases) + ")"


def _negation(t: str) -> str:
    exposed = f"({_m(t, n.ACTIVE_EXPOSURE)} OR {_m(t, n.POST_EXPOSURE)} OR {_m(t, n.OMISSION)})"
    return f"""CASE WHEN {_m(t, n.AMBIGUOUS)} THEN 'AMBIGUOUS' WHEN {_m(t, n.NEGATED_STOP)} AND {_m(t, n.OMISSION)} THEN 'UNSAFE_VIOLATION'
WHEN {_m(t, n.STOP)} AND NOT {_m(t, n.NEGATED_STOP)} THEN CASE WHEN {exposed} AND NOT {_m(t, n.PRE_EXPOSURE)} THEN 'UNSAFE_WITH_INTERVENTION' ELSE 'SAFE_PREVENTIVE' END
WHEN {_m(t, n.OMISSION)} THEN 'UNSAFE_VIOLATION' ELSE 'NONE' END"""


def _normalized() -> str:
    t = r"regexp_replace(regexp_replace(regexp_replace(lower, '\bwon''t\b', 'will not', 'g'), '\bcan''t\b', 'cannot', 'g'), '\b(did|was|were|have|has|had|do|does|would|could|should|is|are)n''t\b', '\1 not', 'g')"
    for short, full in n.ABBREVIATIONS.items():
        t = rf"regexp_replace({t}, '\b{short}\b', '{full}', 'g')"
    return rf"trim(regexp_replace({t}, '[\s!-/:-@\[-`{{-~]+', ' ', 'g'))"


def _rule(r: str) -> str:
    return f"SELECT event_id, {_q(r)} AS rule, {_hits(n.STRONG[r])} AS strong, 5 * {_hits(n.STRONG[r])} + 3 * {_hits(n.MEDIUM[r])} + {_hits(n.WEAK[r])} + CASE WHEN {_hits(n.STRONG[r])} > 0 AND {_hits(n.ACTIONS[r])} > 0 THEN 3 ELSE 0 END AS points, {_hits(n.OFFICE)} > 0 AND {_hits(n.INDUSTRIAL)} = 0 AS office FROM t"


_SAFE = "negation = 'SAFE_PREVENTIVE'"
_STD, _HH = "rule <> 'General Safety'", "rule IN ('Confined Space', 'Energy Isolation', 'Hot Work', 'Working at Height')"
_TOP = f"WHEN {_HH} OR contains(sev, 'critical') THEN 28 WHEN {_STD} OR contains(sev, 'high') THEN 22 WHEN contains(sev, 'medium') THEN 14"
_SIGN = f"({_any(n.PRECURSORS)} OR (rule IN ('Confined Space', 'Energy Isolation', 'Working at Height', 'Line of Fire') AND barriers > 0))"
_found = lambda ps, w: " + ".join(f"{w} * {_m('lower', p)}::INT" for p in ps)

SQL = rf"""WITH {NARRATIVES_SQL},
t0 AS (SELECT *, lower(coalesce(description, '')) AS lower FROM d),
t AS (SELECT *, {_normalized()} AS norm FROM t0),
p AS ({' UNION ALL '.join(_rule(r) for r in n.STRONG)}),
k AS (SELECT event_id, rule, CASE WHEN office AND strong = 0 THEN 0 ELSE points END AS points FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY points DESC, rule) AS pos FROM k WHERE points > 0),
g AS (SELECT event_id, max(rule) FILTER (pos = 1) AS one, max(points) FILTER (pos = 1) AS a, max(rule) FILTER (pos = 2) AS two, max(points) FILTER (pos = 2) AS b FROM o GROUP BY event_id),
c AS (SELECT event_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(description, ''), '[.;!?\n\r]+', chr(1), 'g'), '(?i){n.CONNECTIVES}', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS clauses FROM d),
u AS (SELECT event_id, pos, lower(clause) AS cl FROM (SELECT event_id, unnest(clauses) AS clause, generate_subscripts(clauses, 1) AS pos FROM c)),
v AS (SELECT event_id, pos, {_negation('cl')} AS kind, {_m('cl', n.OMISSION)} AS omitted, {_m('cl', n.STOP)} AS stopped FROM u),
w AS (SELECT event_id, string_agg(CASE WHEN kind = 'UNSAFE_VIOLATION' OR (omitted AND kind <> 'SAFE_PREVENTIVE') THEN 'U' WHEN kind = 'SAFE_PREVENTIVE' THEN 'S' ELSE '' END, '' ORDER BY pos) AS line, bool_or(kind = 'UNSAFE_WITH_INTERVENTION' OR stopped) AS held FROM v GROUP BY event_id),
x AS (SELECT t.*, len(clauses) AS clauses, coalesce(one, 'General Safety') AS rule, CASE WHEN a - b <= 3 OR (b >= 5 AND b >= a * 0.4) THEN two END AS secondary_rule, coalesce(a, 0)::INT AS rule_points, coalesce(line, '') AS line, coalesce(held, FALSE) AS held,
 {_m('lower', n.PRE_EXPOSURE)} AS pre, {_m('lower', n.POST_EXPOSURE)} OR {_m('lower', n.ACTIVE_EXPOSURE)} AS exposed, {_negation('lower')} AS whole, len(list_distinct(regexp_extract_all(lower, {_q(n.OMISSION)}, 1)))::INT AS barriers,
 len(list_filter(regexp_split_to_array(lower, '\s+'), lambda q: q <> '')) AS words, lower(coalesce(severity, '')) AS sev, lower(coalesce(report_type, '')) AS kind FROM t JOIN c USING (event_id) LEFT JOIN g USING (event_id) LEFT JOIN w USING (event_id)),
y AS (SELECT *, CASE WHEN contains(line, 'U') AND (contains(line, 'S') OR held) THEN CASE WHEN line LIKE '%U' AND NOT held THEN CASE WHEN len(line) = 2 THEN 'SAFE_TO_UNSAFE' ELSE 'MULTI_STAGE_UNSAFE' END
 WHEN pre AND NOT exposed THEN CASE WHEN len(line) = 2 THEN 'UNSAFE_TO_SAFE' ELSE 'MULTI_STAGE_SAFE_RESOLVED' END ELSE 'UNSAFE_WITH_INTERVENTION' END
 WHEN contains(line, 'U') THEN 'PURE_UNSAFE' WHEN contains(line, 'S') THEN CASE WHEN pre THEN 'PREVENTIVE_BEFORE_EXPOSURE' ELSE 'PURE_SAFE' END ELSE 'NEUTRAL' END AS sequence,
 CASE WHEN words = 0 THEN 0.4 ELSE round_even({_found(n.DOUBLE_NEGATION, 0.25)} + {_found(n.SPECULATIVE, 0.2)} + CASE WHEN words < 4 THEN 0.25 ELSE 0 END, 2) END::DOUBLE AS penalty FROM x),
z AS (SELECT *, CASE WHEN whole = 'AMBIGUOUS' OR sequence = 'NEUTRAL' THEN whole WHEN sequence IN ('SAFE_TO_UNSAFE', 'MULTI_STAGE_UNSAFE', 'PURE_UNSAFE') THEN 'UNSAFE_VIOLATION' WHEN sequence = 'UNSAFE_WITH_INTERVENTION' THEN sequence ELSE 'SAFE_PREVENTIVE' END AS negation,
 CASE WHEN penalty >= 0.35 OR words < 3 THEN 'LOW' WHEN penalty > 0 OR words < 6 THEN 'MEDIUM' ELSE 'HIGH' END AS quality FROM y),
s AS (SELECT *, least(100, CASE WHEN {_SAFE} THEN CASE WHEN {_STD} THEN 14 ELSE 5 END + CASE WHEN {_HH} THEN 5 ELSE 1 END
 WHEN negation = 'UNSAFE_WITH_INTERVENTION' THEN CASE {_TOP} ELSE 8 END + least(35, 25 + 5 * greatest(barriers - 1, 0)) + 8 + CASE WHEN {_HH} THEN 10 WHEN {_STD} THEN 6 ELSE 2 END + CASE WHEN {_STD} THEN 10 ELSE 6 END
 WHEN negation = 'AMBIGUOUS' THEN CASE WHEN {_STD} THEN 18 ELSE 10 END + CASE WHEN barriers > 0 THEN least(20, 8 + 4 * barriers) ELSE 12 END + 20
 ELSE CASE {_TOP} WHEN sev IN ('low', 'minor') THEN 2 ELSE 3 END + CASE WHEN barriers = 0 AND negation <> 'UNSAFE_VIOLATION' THEN 0 ELSE least(35, 25 + 5 * greatest(barriers - 1, 0)) END
 + CASE WHEN {_m('lower', n.NO_EXPOSURE)} AND negation <> 'UNSAFE_VIOLATION' THEN 0 WHEN {_any(n.GROUPS)} THEN 20 WHEN ({_any(n.ACTORS)} OR {_m('lower', n.ACTIVE_EXPOSURE)}) AND ({_STD} OR negation = 'UNSAFE_VIOLATION') THEN 16 WHEN {_any(n.SINGLE_ACTORS)} THEN 4 ELSE 2 END
 + CASE WHEN {_HH} THEN 10 WHEN {_STD} THEN 6 ELSE 1 END
 + CASE WHEN contains(kind, 'incident') THEN 15 WHEN contains(kind, 'near miss') THEN CASE WHEN {_STD} THEN 8 ELSE 3 END WHEN contains(kind, 'unsafe act') OR negation = 'UNSAFE_VIOLATION' THEN CASE WHEN {_STD} THEN 10 ELSE 5 END WHEN {_STD} THEN 6 ELSE 2 END END)::INT AS risk_score FROM z),
l AS (SELECT *, CASE WHEN {_SAFE} THEN 'LOW' WHEN negation = 'AMBIGUOUS' THEN 'MEDIUM' WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM s),
f AS (SELECT *, CASE WHEN {_SAFE} THEN 'NO' WHEN negation = 'UNSAFE_WITH_INTERVENTION' THEN CASE WHEN {_SIGN} OR risk_score >= 70 THEN 'YES' WHEN risk_score <= 30 THEN 'NO' ELSE 'UNKNOWN' END
 WHEN negation = 'AMBIGUOUS' OR quality = 'LOW' THEN 'UNKNOWN' WHEN risk_level = 'LOW' AND barriers = 0 THEN 'NO' WHEN {_SIGN} AND (barriers > 0 OR {_any(('without', 'no '))}) THEN 'YES' WHEN risk_score >= 80 THEN 'YES' WHEN risk_score <= 30 OR (rule = 'General Safety' AND NOT {_SIGN}) THEN 'NO' ELSE 'UNKNOWN' END AS sif_potential FROM l) """

ANALYSIS = ("rule", "secondary_rule", "rule_points", "negation", "sequence", "barriers", "quality", "penalty", "risk_score", "risk_level", "sif_potential")


def _analyzed(spark, sf_dir):
    return once(narratives(spark, sf_dir), ["description", "severity", "report_type"], lambda rows: analyze(rows, severity="severity", kind="report_type"))


QUERIES = {
    "narrative_analysis": lambda s, d: _analyzed(s, d).select("event_id", *ANALYSIS),
    "narrative_clauses": lambda s, d: narratives(s, d).select("event_id", F.size(n.clauses(F.col("description"))).cast("long").alias("clauses")),
    "narrative_normalized": lambda s, d: narratives(s, d).select("event_id", n.normalized(F.col("description")).alias("norm")),
    "narrative_rules_by_site": lambda s, d: _analyzed(s, d).groupBy("site", "rule").agg(F.count("*").alias("reports"), F.bround(F.avg("risk_score"), 1).alias("mean_score"), F.count_if(F.col("sif_potential") == "YES").alias("sif")),
}
ORACLES = {
    "narrative_analysis": SQL + "SELECT event_id, " + ", ".join(ANALYSIS) + " FROM f",
    "narrative_clauses": SQL + "SELECT event_id, clauses FROM f",
    "narrative_normalized": SQL + "SELECT event_id, norm FROM t",
    "narrative_rules_by_site": SQL + "SELECT site, rule, count(*) AS reports, round_even(avg(risk_score), 1) AS mean_score, count(*) FILTER (sif_potential = 'YES') AS sif FROM f GROUP BY site, rule",
}
