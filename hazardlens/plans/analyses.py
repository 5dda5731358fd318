"""Queries over the whole analysis of narratives, and what they must give, worked out by hand for each fragment.

The narratives of the test tables are put together from fragments (`adapters.FRAGMENTS`):
who (5), what (7), how (11) and an end (3). The SQL states the outcome of each how,
and what a what or the office desk (who = 4) changes in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.functions import narrative as n
from hazardlens.functions.spelling import spelled, with_corrections
from hazardlens.operators.analysis import explained
from hazardlens.sources.adapters import NARRATIVES_SQL, narratives

# Every event with its fragments; a missing text and one too short to be analysed are left out.
_PARTS = f"""WITH {NARRATIVES_SQL},
e AS (SELECT event_id, description, severity, report_type, event_id % 5 AS who, event_id % 7 AS what, event_id % 11 AS how FROM d WHERE event_id % 97 <> 0 AND event_id % 89 <> 0),
"""

# The barrier that each how names, and the zone that is named by standing under a load (what = 5). Before a stop (what = 3) nobody was exposed, so
# `before gas testing` (how = 9) omits nothing there, nor in a clause of its own (what = 1). An office has no gas, lockout or fall protection, and weakens the others.
BARRIERS_SQL = _PARTS + """
named(how, barrier, confidence, method, evidence) AS (VALUES
  (0, 'Gas Testing Not Completed', 0.98, 'synonym', 'without gas testing | without gas test'),
  (2, 'Lockout/Tagout Not Completed', 0.95, 'synonym', 'tagout was not applied | loto was not applied | lockout tagout'),
  (3, 'Fall Protection Not Used', 0.98, 'synonym', 'no harness | with no harness'),
  (5, 'Isolation Not Applied', 0.98, 'synonym', 'without isolation'),
  (6, 'PPE Not Available', 0.98, 'synonym', 'without personal protective equipment | without ppe | personal protective equipment'),
  (9, 'Gas Testing Not Completed', 0.95, 'concept', 'before gas testing')),
own AS (
  SELECT event_id, who, what, how, barrier, CASE WHEN how = 9 AND what = 6 THEN 0.60 ELSE confidence END AS confidence,
    CASE WHEN how = 9 AND what = 6 THEN 'keyword' ELSE method END AS method, CASE WHEN how = 9 AND what = 6 THEN 'Keywords: gas + test + testing' ELSE evidence END AS evidence
  FROM e JOIN named USING (how)
  WHERE NOT (how = 9 AND what IN (1, 3)) AND NOT (who = 4 AND what IN (5, 6) AND how IN (0, 2, 3, 9))),
zone AS (SELECT event_id, who, what, how, 'Exclusion Zone Not Established' AS barrier, 0.92 AS confidence, 'synonym' AS method, 'stood under a suspended load' AS evidence FROM e WHERE what = 5 AND how <> 8),
every AS (SELECT * FROM own UNION ALL SELECT * FROM zone),
weighed AS (SELECT event_id, barrier, method, evidence,
  CASE WHEN who = 4 AND (barrier LIKE 'Exclusion%' OR (how = 6 AND what IN (5, 6))) THEN confidence - 0.40
    WHEN what = 5 AND how IN (0, 2, 3, 6, 9) AND who <> 4 THEN least(1.0, confidence + 0.05) ELSE confidence END AS confidence FROM every)
"""
SEQUENCES_SQL = _PARTS + """
told AS (SELECT *, CASE
  WHEN how IN (1, 4, 7, 10) THEN CASE what WHEN 5 THEN 'PURE_UNSAFE' WHEN 3 THEN 'PREVENTIVE_BEFORE_EXPOSURE' ELSE 'NEUTRAL' END
  WHEN how = 8 THEN CASE what WHEN 6 THEN 'NEUTRAL' WHEN 3 THEN 'PREVENTIVE_BEFORE_EXPOSURE' ELSE 'PURE_SAFE' END
  WHEN how = 5 THEN CASE what WHEN 3 THEN 'UNSAFE_WITH_INTERVENTION' ELSE 'PURE_UNSAFE' END
  ELSE CASE what WHEN 3 THEN 'UNSAFE_TO_SAFE' ELSE 'PURE_UNSAFE' END END AS sequence FROM e)
SELECT event_id, sequence, CASE sequence WHEN 'NEUTRAL' THEN 'NONE' WHEN 'PURE_UNSAFE' THEN 'UNSAFE_VIOLATION' WHEN 'UNSAFE_WITH_INTERVENTION' THEN sequence ELSE 'SAFE_PREVENTIVE' END AS negation,
  CASE sequence WHEN 'NEUTRAL' THEN 'NEUTRAL' WHEN 'PURE_UNSAFE' THEN CASE WHEN what = 5 AND how = 5 THEN 'UNSAFE > UNSAFE' ELSE 'UNSAFE' END
    WHEN 'UNSAFE_TO_SAFE' THEN 'SAFE > UNSAFE' WHEN 'UNSAFE_WITH_INTERVENTION' THEN 'SAFE > UNSAFE' ELSE CASE WHEN what = 3 AND how = 8 THEN 'SAFE > SAFE' ELSE 'SAFE' END END AS timeline
FROM told UNION ALL SELECT event_id, 'AMBIGUOUS', 'AMBIGUOUS', 'AMBIGUOUS' FROM d WHERE event_id % 97 = 0 OR event_id % 89 = 0"""

#: Misspelled words put into the narratives, and what they stand for.
MISSPELLED = (("gas testing", "gass testng"), ("permit", "permt"), ("harness", "harnes"), ("scaffold", "scafold"), ("isolation", "isloation"), ("welding", "weldng"))


def misspelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narratives with misspelled words, and their normal form with these corrected."""
    text = F.coalesce("description", F.lit(""))
    for right, wrong in MISSPELLED:
        text = F.replace(text, F.lit(right), F.lit(wrong))
    rows = narratives(spark, sf_dir).select("event_id", text.alias("text"))
    texts = with_corrections(rows.select("text").distinct(), "text", n.normalized(F.col("text")))
    return rows.join(texts, "text").select("event_id", spelled(n.normalized(F.col("text")), F.col("fixes")).alias("norm"))


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explained(narratives(spark, sf_dir), severity="severity", kind="report_type")


def _rows(df: DataFrame, items: str) -> DataFrame:
    return df.select("event_id", F.explode(items).alias("x")).select("event_id", "x.*")


QUERIES = {
    "barrier_evidence": lambda s, d: _rows(explained(narratives(s, d)), "barrier_items").withColumn("evidence", F.array_join("evidence", " | ")),
    "barriers_through_time": lambda s, d: explained(narratives(s, d)).select("event_id", "sequence", "negation", F.array_join("timeline", " > ").alias("timeline")),
    "barriers_in_force": lambda s, d: _rows(explained(narratives(s, d)), "barrier_items").groupBy("barrier").agg(F.count("*").alias("reports"), F.bround(F.avg("confidence"), 4).alias("mean_confidence")),
    "full_analysis": lambda s, d: analysed(s, d).select(
        "event_id", "rule", "negation", "risk_score", "risk_level", "sif_potential", F.array_join("barrier_names", ", ").alias("barrier_names"), "risk_reason",
        F.col("confidence.score").alias("confidence"), F.col("system_confidence.score").alias("system_confidence"), "fallback",
    ),
    "risk_factors": lambda s, d: _rows(analysed(s, d), "factors").withColumn("evidence", F.array_join("evidence", " | ")),
    "structured_evidence": lambda s, d: _rows(analysed(s, d), "structured_evidence"),
    "misspelled_narratives": misspelled,
}
ORACLES = {
    "barrier_evidence": BARRIERS_SQL + "SELECT event_id, barrier, confidence::DOUBLE AS confidence, method, evidence, CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM weighed",
    "barriers_in_force": BARRIERS_SQL + "SELECT barrier, count(*) AS reports, round_even(avg(confidence::DOUBLE), 4) AS mean_confidence FROM weighed GROUP BY barrier",
    "barriers_through_time": SEQUENCES_SQL,
    # `continued` shares 7 letters in blocks with `confined`: 14 of 17 is above the least likeness, so the rule takes it for that.
    "misspelled_narratives": f"""WITH {NARRATIVES_SQL} SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(description, '')), '\\bcontinued\\b', 'confined', 'g'),
'\\bdidn''t\\b', 'did not', 'g'), '\\bppe\\b', 'personal protective equipment', 'g'), '\\bloto\\b', 'lockout tagout', 'g'), '[^a-z0-9]+', ' ', 'g')) AS norm FROM d""",
}
