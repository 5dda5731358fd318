"""The quick look over all narratives, and SQL from the same fixed values."""

from __future__ import annotations

from hazardlens.functions import explain
from hazardlens.functions import quick as q
from hazardlens.operators.distinct import once
from hazardlens.sources.adapters import NARRATIVES_SQL, narratives


def _s(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _any(phrases, text: str = "low") -> str:
    return "(" + " OR ".join(f"contains({text}, {_s(p)})" for p in phrases) + ")"


def _first(groups: dict, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(p)} THEN {_s(n)}" for n, p in groups.items()) + f" ELSE {_s(other)} END"


def _m(p: str) -> str:
    return f"regexp_matches(low, {_s(p)})"


def _look(spark, sf_dir):
    rows = narratives(spark, sf_dir)
    out = once(rows, ["description", "severity", "report_type"], lambda keys: q.look(keys, severity="severity", kind="report_type"))
    return out.selectExpr("event_id", "quick_rule", "array_join(quick_barriers, ', ') AS quick_barriers", "quick_hazard", "quick_activity", "quick_negation", "quick_score", "quick_level", "quick_sif", "quick_confidence", "size(quick_actions) AS actions")


_hits = ", ".join(f"{{'n': len(list_filter([{', '.join(_s(w) for w in words)}], lambda w: contains(low, w))), 'at': {-k}, 'rule': {_s(rule)}}}" for k, (rule, words) in enumerate(q.RULES.items()))
_barriers = "list_filter([" + ", ".join(f"CASE WHEN {_any(p)} THEN {_s(b)} END" for b, p in q.BARRIERS.items()) + "], lambda b: b IS NOT NULL)"
_actions = "CASE rule " + " ".join(f"WHEN {_s(r)} THEN {len(a)}" for r, a in q.ACTIONS.items()) + " END"
SQL = rf"""WITH {NARRATIVES_SQL},
t AS (SELECT event_id, lower(coalesce(description, '')) AS low, lower(coalesce(severity, '')) AS sev, lower(coalesce(report_type, '')) AS kind FROM d),
h AS (SELECT *, list_max([{_hits}]) AS best, {_barriers} AS failed, {_m(q.STOP)} AS stop, {_m(q.NOT_STOPPED)} AS unstopped, {_m(q.OMISSION)} AS omits, {_m(q.UNCLEAR)} AS unclear FROM t),
r AS (SELECT *, CASE WHEN best.n > 0 THEN best.rule ELSE 'General Safety' END AS rule, len(failed) AS n,
  CASE WHEN trim(low) = '' THEN 'NONE' WHEN unclear THEN 'AMBIGUOUS' WHEN unstopped AND omits THEN 'UNSAFE_VIOLATION' WHEN stop AND NOT unstopped THEN 'SAFE_PREVENTIVE' WHEN omits THEN 'UNSAFE_VIOLATION' ELSE 'NONE' END AS negation FROM h),
s AS (SELECT *, rule <> 'General Safety' AS ruled, CASE negation WHEN 'SAFE_PREVENTIVE' THEN CASE WHEN rule <> 'General Safety' THEN 18 ELSE 13 END
  WHEN 'AMBIGUOUS' THEN CASE WHEN rule <> 'General Safety' THEN 38 ELSE 30 END + CASE WHEN n > 0 THEN least(20, 8 + 4 * n) ELSE 12 END
  ELSE least(100, CASE WHEN contains(sev, 'critical') OR rule <> 'General Safety' THEN 28 WHEN contains(sev, 'high') THEN 22 WHEN contains(sev, 'medium') THEN 14 WHEN contains(sev, 'low') THEN 6 ELSE 15 END
   + CASE WHEN n = 0 THEN CASE WHEN negation = 'UNSAFE_VIOLATION' THEN 25 ELSE 5 END ELSE least(35, 20 + 5 * n) END
   + CASE WHEN {_any(('two worker', 'crew', 'multiple'))} THEN 20 WHEN {_any(('worker', 'technician', 'operator'))} THEN 16 ELSE 8 END
   + CASE WHEN {_any(('confined space', 'energy isolation', 'hot work', 'working at height'))} OR rule IN ('Confined Space', 'Energy Isolation', 'Hot Work', 'Working at Height') THEN 10 ELSE 5 END
   + CASE WHEN contains(kind, 'incident') THEN 15 WHEN contains(kind, 'near miss') THEN 12 WHEN contains(kind, 'unsafe act') THEN 10 WHEN contains(kind, 'unsafe condition') THEN 8 ELSE 5 END) END::INT AS score,
  len(list_distinct(list_filter([{', '.join(_s(p) for p in q.EVIDENCE)}], lambda p: contains(low, p)) || regexp_extract_all(low, '(?:without|no|not|missing|absent)\s+\w+(?:\s+\w+)?'))) AS phrases,
  len(list_filter(regexp_split_to_array(low, '\s+'), lambda w: w <> '')) AS words, {_m(explain.ROLES)} AS role, {_m(explain.ACTS)} AS act FROM r)
SELECT event_id, rule AS quick_rule, array_to_string(failed, ', ') AS quick_barriers, {_first(q.HAZARDS, 'General Hazard')} AS quick_hazard, {_first(dict(explain.ACTIVITIES), 'General Maintenance')} AS quick_activity, negation AS quick_negation,
 score AS quick_score, CASE WHEN negation = 'SAFE_PREVENTIVE' THEN 'LOW' WHEN negation = 'AMBIGUOUS' THEN 'MEDIUM' WHEN score > 80 THEN 'CRITICAL' WHEN score > 60 THEN 'HIGH' WHEN score > 30 THEN 'MEDIUM' ELSE 'LOW' END AS quick_level,
 CASE WHEN negation = 'SAFE_PREVENTIVE' THEN 'NO' WHEN negation = 'AMBIGUOUS' THEN 'UNKNOWN' WHEN {_any(q.SERIOUS)} OR score >= 70 THEN 'YES' WHEN score <= 30 THEN 'NO' ELSE 'UNKNOWN' END AS quick_sif,
 least(98, greatest(20, 50 + CASE WHEN best.n >= 2 THEN 15 WHEN best.n = 1 THEN 8 ELSE -5 END + CASE WHEN n >= 2 THEN 15 WHEN n = 1 THEN 10 ELSE -5 END + CASE WHEN phrases >= 2 THEN 5 ELSE 0 END
  + CASE WHEN role AND act THEN 10 WHEN role OR act THEN 5 ELSE 0 END + CASE negation WHEN 'AMBIGUOUS' THEN -35 WHEN 'NONE' THEN 0 ELSE 5 END + CASE WHEN words < 4 THEN -20 ELSE 0 END)) / 100.0::DOUBLE AS quick_confidence, {_actions}::INT AS actions FROM s"""
QUERIES = {"quick_look": _look}
ORACLES = {"quick_look": SQL}
