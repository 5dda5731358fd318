"""Queries over rows that are chosen so that rare rules apply: spikes, names, fallbacks, limits, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardlens.operators import aggregates, clusters, heatmap, listing, quality, retrieval, summaries, trends
from hazardlens.plans.listings import _foreign
from hazardlens.sources.adapters import NARRATIVES_SQL, REPORTS_SQL, narratives, reports, table
from hazardlens.streaming import events

QUERIES: dict = {}
ORACLES: dict = {}


def _on_reports(name: str, query, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(reports(spark, sf_dir))
    ORACLES[name] = f"WITH {REPORTS_SQL} {sql}"


# One report in twenty up to a month, all of that month, none after it.
_spike = "date < '2001-02-01' AND cast(report_id AS bigint) % 20 = 0 OR substr(date, 1, 7) = '2001-02'"
_on_reports(
    "month_spike", lambda r: trends.month_anomaly(trends.monthly(r.filter(_spike))),
    f""", m AS (SELECT substr(date, 1, 7) AS month, count(*) AS total FROM r WHERE {_spike} GROUP BY 1)
SELECT month, total, round_even(total / (SELECT avg(total) FROM m WHERE month < '2001-02'), 1) AS ratio FROM m WHERE month = '2001-02' AND total >= 3 AND total >= 1.5 * (SELECT avg(total) FROM m WHERE month < '2001-02')""",
)
_rare = "site = 'ASIA' OR cast(report_id AS bigint) % 10 = 0"
_on_reports(
    "site_spike", lambda r: trends.site_anomalies(r.filter(_rare)),
    f", m AS (SELECT site, count(*) AS total FROM r WHERE {_rare} GROUP BY 1) SELECT site, total, round_even(total / (SELECT avg(total) FROM m), 1) AS ratio FROM m WHERE site = 'ASIA'",
)
_on_reports("name_resolved", lambda r: listing.resolved(r, "site", " east").unionByName(listing.resolved(r, "unit", "NATION_1")), "SELECT 'MIDDLE EAST' AS value UNION ALL SELECT 'NATION_1' FROM r HAVING count(*) > 0")
_on_reports(
    "filtered_heatmap", lambda r: heatmap.summary(heatmap.nodes(heatmap.filtered(r, site=" ASIA ", unit="all", category="Hot Work"))).select("reports", "sif", "density"),
    "SELECT count(*)::BIGINT AS reports, count(*) FILTER (sif_potential = 'YES')::BIGINT AS sif, round_even(count(*) FILTER (sif_potential = 'YES') * 100.0 / count(*), 1)::DOUBLE AS density FROM r WHERE site = 'ASIA' AND category = 'Hot Work'",
)
_best = "ORDER BY sif_potential = 'YES' DESC, risk_score DESC, date DESC, report_id LIMIT 8"
_on_reports(
    "evidence_by_words", lambda r: retrieval.evidence_for(r, ["machinery", "nowhere"]).select("report_id", "by_words"),
    f"SELECT report_id, TRUE AS by_words FROM r WHERE description ILIKE '%machinery%' OR area ILIKE '%machinery%' {_best}",
)
_on_reports("evidence_without_words", lambda r: retrieval.evidence_for(r, ["nowhere"]).select("report_id", "by_words"), f"SELECT report_id, FALSE AS by_words FROM r {_best}")
_on_reports(
    "pattern_shares_of_all", lambda r: summaries.pattern_shares(aggregates.legacy_patterns(r), r.count()).select("name", "share"),
    """SELECT category || ' + ' || barrier_failure AS name, least(100, floor(count(*) * 100.0 / (SELECT count(*) FROM r) + 0.5))::INT AS share FROM r
WHERE category <> 'General Safety' AND barrier_failure <> 'Unknown Barrier Failure' GROUP BY 1 HAVING count(*) >= 2""",
)
QUERIES["dataset_profile"] = lambda s, d: quality.dataset(narratives(s, d)).withColumns({
    "warnings": F.array_join("warnings", " | "), "missing_values": F.array_join(F.transform(F.array_sort(F.map_entries("missing_values")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","),
})
ORACLES["dataset_profile"] = f"""WITH {NARRATIVES_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (description IS NULL) AS empty, sum(length(trim(coalesce(description, '')))) AS letters, count(DISTINCT lower(trim(coalesce(description, '')))) AS texts,
 count(DISTINCT coalesce(report_type, '')) AS types, count(DISTINCT site) AS sites, count(*) FILTER (severity IS NULL) AS no_severity, count(*) FILTER (report_type IS NULL) AS no_type FROM d)
SELECT n AS total_records, 5 AS total_columns, 'description=' || empty || ',event_id=0,report_type=' || no_type || ',severity=' || no_severity || ',site=0' AS missing_values, empty AS empty_reports, n - texts AS duplicate_records,
 types AS unique_report_types, 0::BIGINT AS unique_activities, sites AS unique_sites, 0::BIGINT AS unique_locations, FALSE AS has_sif_label, FALSE AS has_date, TRUE AS has_site, FALSE AS has_activity,
 floor(letters / (n - empty) + 0.5)::BIGINT AS avg_report_length,
 'No SIF label column detected. Running AI/rule-based prototype analysis mode. | No date column detected. Trend analysis will be unavailable. | No activity column detected. Activity-level analysis may be limited.'
  || CASE WHEN empty > 0 THEN ' | ' || empty || ' reports (' || floor(empty / n * 100 + 0.5)::BIGINT || '%) have missing or empty text.' ELSE '' END || CASE WHEN n > texts THEN ' | ' || (n - texts) || ' potential duplicate records detected.' ELSE '' END AS warnings,
 (80 - floor(empty / n * 20 + 0.5) - floor((n - texts) / n * 10 + 0.5))::INT AS health_score FROM c"""
QUERIES["label_distribution"] = lambda s, d: quality.labels(narratives(s, d), "severity")
ORACLES["label_distribution"] = f"WITH {NARRATIVES_SQL} SELECT coalesce(severity, 'Unknown') AS label, count(*) AS rows FROM d GROUP BY 1"
QUERIES["languages_by_script"] = lambda s, d: quality.languages(_foreign(s, d).withColumn("text", F.col("original_report_text")), "text")
ORACLES["languages_by_script"] = "SELECT ['hi', 'kn', 'unknown', 'en'][doc_id % 4 + 1] AS language, count(*) AS rows FROM documents GROUP BY 1"
QUERIES["trailing_requests"] = lambda s, d: events.recent(table(s, d, "events").select("event_id", "user_id", "ts"), 43_200, 2).select("event_id", "recent", "limited")
ORACLES["trailing_requests"] = """SELECT event_id, recent, recent > 2 AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) RANGE BETWEEN 43199 PRECEDING AND CURRENT ROW) AS recent FROM events)"""
_on_reports(
    "dashboard_bundle", lambda r: aggregates.dashboard_bundle(r).withColumn("by_category", F.array_join(F.transform(F.array_sort(F.map_entries("by_category")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")),
    """, c AS (SELECT category, count(*) AS n FROM r WHERE category <> '' GROUP BY category)
SELECT count(*) AS total, round_even(avg(risk_score), 1) AS mean_score, count(*) FILTER (sif_potential = 'YES') AS sif_yes, count(*) FILTER (sif_potential = 'NO') AS sif_no,
 round_even(count(*) FILTER (sif_potential = 'YES') * 100.0 / count(*), 1)::DOUBLE AS sif_percent, count(*) FILTER (risk_level = 'CRITICAL') AS critical, count(*) FILTER (risk_level = 'HIGH') AS high,
 count(*) FILTER (risk_level = 'MEDIUM') AS medium, count(*) FILTER (risk_level = 'LOW') AS low,
 CASE greatest(critical, high, medium, low) WHEN critical THEN 'CRITICAL' WHEN high THEN 'HIGH' WHEN medium THEN 'MEDIUM' ELSE 'LOW' END AS top_level,
 (SELECT string_agg(category || '=' || n, ',' ORDER BY category) FROM c) AS by_category, (SELECT category FROM c ORDER BY n DESC, category LIMIT 1) AS top_category FROM r""",
)
_on_reports(
    "patterns_of_any_shape",
    lambda r: clusters.as_patterns(r.groupBy("category").agg(F.count("*").cast("string").alias("count"), F.max("barrier_failure").alias("barrier"), F.sort_array(F.collect_set("site")).alias("sites"), F.lit("85").alias("confidence_level")).withColumns({"cluster_id": F.lit(" "), "name": F.col("category"), "theme": F.concat(F.lit("Hazards in "), "category")}))
    .select("pattern_id", "pattern_type", "description", "frequency", F.array_join("sites", ",").alias("sites"), F.array_join("barriers", ",").alias("barriers"), F.size("activities").alias("activities"), "confidence"),
    """SELECT category AS pattern_id, 'recurring_cluster' AS pattern_type, 'Hazards in ' || category AS description, count(*) AS frequency, string_agg(DISTINCT site, ',' ORDER BY site) AS sites, max(barrier_failure) AS barriers,
0 AS activities, 0.85::DOUBLE AS confidence FROM r GROUP BY category""",
)
