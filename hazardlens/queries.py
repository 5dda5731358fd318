"""All queries over reports and, under the same names, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardlens.functions import text
from hazardlens.operators import aggregates as ag
from hazardlens.operators import heatmap, quality, relations, retrieval, trends
from hazardlens.plans import analyses, ingest, listings, narratives, quick, reaching
from hazardlens.sources.adapters import ACTIONS_SQL, REPORTS_SQL, actions, reports, table
from hazardlens.streaming import events as ev

QUERIES: dict = {}
ORACLES: dict = {}


def _on_reports(name: str, query, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(reports(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = f"WITH {REPORTS_SQL} {sql}" if not sql.startswith(",") else f"WITH {REPORTS_SQL}{sql}"


def _on(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


_sif = "count(*) FILTER (sif_potential = 'YES')"
_crit = "count(*) FILTER (risk_level = 'CRITICAL')"


def _ranked(by: str) -> str:
    return f"""SELECT {by}, total, critical, sif, trunc(mean)::INT AS risk_score, CASE WHEN critical > 0 OR mean >= 75 THEN 'CRITICAL' WHEN mean >= 50 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level
FROM (SELECT {by}, count(*) AS total, {_crit} AS critical, {_sif} AS sif, round_even(avg(risk_score), 1) AS mean FROM r WHERE {by} IS NOT NULL AND {by} <> '' GROUP BY {by})"""


def _top(by: str, n: int) -> str:
    return f"SELECT {by}, count(*) AS reports, {_sif} AS sif, round_even(avg(risk_score), 1) AS mean_score FROM r WHERE {by} IS NOT NULL AND {by} <> '' GROUP BY {by} ORDER BY reports DESC, {by} LIMIT {n}"


_on_reports("site_stats", ag.site_stats, _ranked("site"))
_on_reports("activity_stats", ag.activity_stats, _ranked("activity"))
_on_reports("total_reports", ag.total, "SELECT count(*) AS total FROM r")
_on_reports("risk_distribution", ag.risk_distribution, "SELECT position::INT AS position, l.risk_level, count(r.risk_level) AS reports FROM (VALUES (1, 'CRITICAL'), (2, 'HIGH'), (3, 'MEDIUM'), (4, 'LOW')) l(position, risk_level) LEFT JOIN r ON r.risk_level = l.risk_level GROUP BY 1, 2")
_on_reports("sif_stats", ag.sif_stats, f"SELECT {_sif} AS sif_yes, count(*) FILTER (sif_potential = 'NO') AS sif_no, count(*) AS total, round_even({_sif} * 100.0 / count(*), 1)::DOUBLE AS sif_percent FROM r")
_on_reports("category_distribution", ag.category_distribution, "SELECT category, count(*) AS reports FROM r GROUP BY category")
_on_reports("dashboard_summary", ag.dashboard, f"""SELECT *, CASE greatest(critical, high, medium, low) WHEN critical THEN 'CRITICAL' WHEN high THEN 'HIGH' WHEN medium THEN 'MEDIUM' ELSE 'LOW' END AS top_level FROM
(SELECT count(*) AS total, round_even(avg(risk_score), 1) AS mean_score, {_sif} AS sif_yes, {_crit} AS critical, count(*) FILTER (risk_level = 'HIGH') AS high, count(*) FILTER (risk_level = 'MEDIUM') AS medium, count(*) FILTER (risk_level = 'LOW') AS low FROM r)""")
_on("command_center", lambda s, d: ag.command_center(reports(s, d), actions(s, d)), f"WITH {REPORTS_SQL}, {ACTIONS_SQL} SELECT {_crit} AS critical, {_sif} AS sif, count(DISTINCT site) FILTER (risk_level IN ('CRITICAL', 'HIGH')) AS sites_at_risk, (SELECT count(*) FROM a WHERE status = 'OPEN') AS open_actions, least({_crit}, 4) AS immediate FROM r")
_on_reports("field_population", ag.field_population, "SELECT " + ", ".join(f"count(*) FILTER ({c} IS NOT NULL AND {c} <> '') AS {c}" for c in ("site", "unit", "area", "activity", "category", "barrier_failure", "date")) + " FROM r")
_on_reports("dataset_version", ag.dataset_version, "SELECT count(*)::VARCHAR || '_' || strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS version FROM r")
_on_reports("site_ranking_top5", lambda r: ag.top_by(r, "site", 5), _top("site", 5))
_on_reports("category_ranking_top5", lambda r: ag.top_by(r, "category", 5), _top("category", 5))
_on_reports("barrier_frequency_top8", ag.barrier_frequency, "SELECT barrier_failure, count(*) AS reports, count(*) FILTER (sif_potential = 'YES') AS sif FROM r WHERE barrier_failure NOT IN ('Unspecified', 'Unknown', 'Unknown Barrier Failure') GROUP BY 1 ORDER BY reports DESC, barrier_failure LIMIT 8")
_on_reports("legacy_patterns", ag.legacy_patterns, """SELECT 'PAT-' || row_number() OVER (ORDER BY frequency DESC, name) AS pattern_id, name, frequency, sites, CASE WHEN share > 0.7 THEN 'CRITICAL' WHEN share > 0.4 THEN 'HIGH' WHEN share > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM (SELECT category || ' + ' || barrier_failure AS name, count(*) AS frequency, count(DISTINCT site) AS sites, count(*) FILTER (sif_potential = 'YES') / count(*) AS share FROM r WHERE category <> 'General Safety' AND barrier_failure <> 'Unknown Barrier Failure' GROUP BY 1 HAVING count(*) >= 2)""")
_on_reports("legacy_site_risk", ag.legacy_site_risk, f"""SELECT *, CASE WHEN risk_score > 50 THEN 'CRITICAL' WHEN risk_score > 35 THEN 'HIGH' WHEN risk_score > 15 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM
(SELECT site, count(*) AS total_reports, {_sif} AS sif_count, {_crit} AS critical_count, round_even({_sif} / count(*) * 70 + {_crit} / count(*) * 30, 0)::INT AS risk_score FROM r GROUP BY site)""")
_on_reports("activity_risk", ag.activity_risk, f"""SELECT *, CASE WHEN mean_score > 80 THEN 'CRITICAL' WHEN mean_score > 60 THEN 'HIGH' WHEN mean_score > 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM
(SELECT activity, count(*) AS reports, {_sif} AS sif, floor(coalesce(avg(risk_score) FILTER (risk_score > 0), 0) + 0.5)::INT AS mean_score FROM r WHERE activity IS NOT NULL AND activity <> '' GROUP BY activity)""")
_on_reports("barrier_histogram", ag.barrier_histogram, "SELECT barrier_failure, count(*) AS reports, floor(count(*) * 100.0 / sum(count(*)) OVER () + 0.5)::INT AS percent FROM r WHERE barrier_failure IS NOT NULL AND barrier_failure <> '' GROUP BY 1 ORDER BY reports DESC, barrier_failure LIMIT 10")
_on_reports("early_warnings", ag.early_warnings, f""", c AS (SELECT count(*) AS n, {_sif} AS sif, count(*) FILTER (category LIKE '%Confined Space%' OR coalesce(activity LIKE '%Confined Space%', FALSE)) AS confined, count(*) FILTER (category LIKE '%Energy Isolation%' OR coalesce(barrier_failure LIKE '%Isolation%', FALSE)) AS energy, {_crit} AS critical FROM r)
SELECT 'EW-001' AS warning_id, 'CRITICAL' AS kind, sif AS current_value, floor(sif * 0.7::DOUBLE + 0.5)::BIGINT AS previous_value, 30 AS change_percent FROM c WHERE sif > n * 0.4
UNION ALL SELECT 'EW-002', 'WARNING', confined, floor(confined * 0.65::DOUBLE + 0.5)::BIGINT, 35 FROM c WHERE confined >= 3
UNION ALL SELECT 'EW-003', 'WARNING', energy, floor(energy * 0.72::DOUBLE + 0.5)::BIGINT, 28 FROM c WHERE energy >= 3
UNION ALL SELECT 'EW-004', 'CRITICAL', critical, floor(critical * 0.75::DOUBLE + 0.5)::BIGINT, 25 FROM c WHERE critical > n * 0.25""")
_on_reports("zscore_guard", ag.z_scores, ", s AS (SELECT avg(risk_score) AS mean, stddev_samp(risk_score) AS sd FROM r) SELECT report_id, round_even(CASE WHEN sd < 5 THEN risk_score / 100.0 ELSE (risk_score - mean) / sd END, 2)::DOUBLE AS normalized_score, sd >= 5 AS normalized FROM r, s")
_on("action_counters", lambda s, d: ag.action_counters(actions(s, d)), f"WITH {ACTIONS_SQL} SELECT count(*) FILTER (status LIKE '%OPEN%') AS open, count(*) FILTER (status LIKE '%PROGRESS%') AS in_progress, count(*) FILTER (status LIKE '%COMPLETE%') AS completed FROM a")
_on_reports("rule_distribution", ag.rule_distribution, f"SELECT category, count(*) AS reports, {_sif} AS sif FROM r GROUP BY 1 ORDER BY reports DESC, category LIMIT 8")

_months = f", m AS (SELECT substr(trim(date), 1, 7) AS month, count(*) AS total, {_sif} AS sif, {_crit} AS critical FROM r WHERE regexp_matches(substr(trim(date), 1, 7), '^\\d{{4}}-\\d{{2}}$') GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY month) AS pos, count(*) OVER () AS n FROM m)"
_on_reports("monthly_trend", trends.monthly, _months + " SELECT * FROM m")
_on_reports("scoped_monthly_trend", trends.last_months, _months + " SELECT * FROM m ORDER BY month DESC LIMIT 12")
_on_reports("trend_class", lambda r: trends.trend(trends.monthly(r)), _months + """, h AS (SELECT max(n) AS periods, sum(total)::BIGINT AS total, avg(total) FILTER (pos <= greatest(1, n // 2)) AS early, avg(total) FILTER (pos > greatest(1, n // 2)) AS late, max(total) FILTER (pos = 1) AS first, max(total) FILTER (pos = n) AS last FROM n),
d AS (SELECT *, CASE WHEN early > 0 THEN (late - early) / early * 100 ELSE 0 END AS delta FROM h)
SELECT periods, total, round_even(delta, 4) AS delta_percent, CASE WHEN periods < 2 OR total < 10 THEN 'STABLE' WHEN delta >= 20 OR (last > first AND last >= 2 * first) THEN 'RISING RISK' WHEN delta <= -20 THEN 'IMPROVING' ELSE 'STABLE' END AS trend FROM d""")
_on_reports("assessed_trend", lambda r: trends.assessed_trend(trends.last_months(r)), _months.replace("FROM m)", "FROM (SELECT * FROM m ORDER BY month DESC LIMIT 12))") + """, h AS (SELECT count(*) AS months, sum(total)::BIGINT AS total, avg(total) FILTER (pos <= n // 2) AS early, avg(total) FILTER (pos > n // 2) AS late FROM n)
SELECT months, total, months >= 3 AND total >= 10 AS assessable, CASE WHEN months >= 3 AND total >= 10 THEN CASE WHEN (late - early) / early * 100 >= 20 THEN 'INCREASING' WHEN (late - early) / early * 100 <= -20 THEN 'DECREASING' ELSE 'STABLE' END END AS direction FROM h""")
_on_reports("month_anomaly", lambda r: trends.month_anomaly(trends.monthly(r)), _months + ", b AS (SELECT *, avg(total) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM n) SELECT month, total, round_even(total / baseline, 1) AS ratio FROM b WHERE pos = n AND n >= 3 AND baseline > 0 AND total >= 1.5 * baseline AND total >= 3")
_on_reports("site_anomaly", trends.site_anomalies, ", s AS (SELECT site, count(*) AS total FROM r WHERE site <> '' GROUP BY site), t AS (SELECT *, avg(total) OVER () AS mean, count(*) OVER () AS sites FROM s) SELECT site, total, round_even(total / mean, 1) AS ratio FROM t WHERE sites >= 2 AND total >= 1.8 * mean AND total >= 4")
_day = "try_cast(substr(trim(date), 1, 10) AS DATE)"
_pct = "CASE WHEN span >= 14 THEN CASE WHEN previous_sif > 0 THEN round_even((current_sif - previous_sif) / previous_sif * 100, 1) WHEN current_sif > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END END"
_windows = "count(*) FILTER (sif_potential = 'YES' AND day BETWEEN anchor - 29 AND anchor) AS current_sif, count(*) FILTER (sif_potential = 'YES' AND day >= anchor - 59 AND day < anchor - 29) AS previous_sif, max(anchor) - min(day) AS span"
_on_reports("period_trend_by_site", lambda r: trends.period_trend(r, ["site"]), f", d AS (SELECT *, {_day} AS day, max({_day}) OVER () AS anchor FROM r), g AS (SELECT site, {_windows} FROM d GROUP BY site) SELECT site, current_sif, previous_sif, {_pct} AS trend_percent FROM g")

_levels = ", ".join(heatmap.LEVELS)
_sets = ", ".join("(" + ", ".join(heatmap.LEVELS[: k + 1]) + ")" for k in range(6))
_named = ", ".join(f"coalesce(nullif(trim({c}), ''), '{heatmap.NAMES[c]}') AS {c}" for c in heatmap.LEVELS)
_tree = f""", d AS (SELECT {_named}, risk_score, risk_level, sif_potential, {_day} AS day, max({_day}) OVER () AS anchor FROM r),
g AS (SELECT {_levels}, 6 - bit_count(grouping({_levels})::INT) AS level, count(*) AS reports, {_sif} AS sif, {_crit} AS critical, round_even(avg(risk_score), 1) AS mean_score, {_windows} FROM d GROUP BY GROUPING SETS ({_sets})),
p AS (SELECT *, {_pct} AS trend_percent FROM g),
t AS (SELECT level::INT AS level, {_levels}, reports, sif, critical, round_even(sif * 100.0 / reports, 1)::DOUBLE AS density, mean_score, trend_percent, CASE WHEN trend_percent IS NULL THEN 'Insufficient data' WHEN previous_sif > 0 THEN CASE WHEN trend_percent > 0 THEN '+' ELSE '' END || trend_percent::DOUBLE::VARCHAR || '% vs prev 30d' WHEN current_sif > 0 THEN '+100% vs prev 30d' ELSE '0.0% vs prev 30d' END AS trend_label, CASE WHEN sif >= 3 OR mean_score >= 70 OR critical > 0 THEN 'HIGH' WHEN sif >= 1 AND trend_percent >= 15 THEN 'EMERGING' WHEN mean_score >= 50 OR sif >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS node_level FROM p)"""
_on_reports("heatmap_nodes", heatmap.nodes, _tree + " SELECT * FROM t")
_on_reports("heatmap_summary", lambda r: heatmap.summary(heatmap.nodes(r)), _tree + " SELECT sum(reports) FILTER (level = 1)::BIGINT AS reports, sum(sif) FILTER (level = 1)::BIGINT AS sif, count(*) FILTER (level <= 3 AND node_level = 'HIGH') AS high, count(*) FILTER (level <= 2 AND node_level = 'EMERGING') AS emerging, round_even(sum(sif) FILTER (level = 1) * 100.0 / sum(reports) FILTER (level = 1), 1)::DOUBLE AS density, (SELECT CASE WHEN level = 1 THEN site || ' (Risk: ' || node_level || ', SIF: ' || sif || ')' ELSE site || ' → ' || unit || ' (' || node_level || ')' END FROM t WHERE level <= 2 ORDER BY mean_score DESC, site, level, unit LIMIT 1) AS top_concentration FROM t")
_on_reports("top_barrier_by_site", lambda r: heatmap.top_barrier(r, "site"), ", c AS (SELECT site, trim(barrier_failure) AS b, count(*) AS n, min(p) AS seen FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, report_id) AS p FROM r) WHERE lower(trim(coalesce(barrier_failure, ''))) NOT IN ('not specified', 'unspecified', 'general unit', 'general area', 'general operation', 'unknown barrier failure', 'unknown barrier', 'unknown', '') GROUP BY 1, 2) SELECT site, b AS top_barrier FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, seen) AS pos FROM c) WHERE pos = 1")
_real = "lower(trim(coalesce(barrier_failure, ''))) NOT IN ('not specified', 'unspecified', 'general unit', 'general area', 'general operation', 'unknown barrier failure', 'unknown barrier', 'unknown', '')"
_nodes = f''', m AS (SELECT {_named}, CASE WHEN {_real} THEN trim(barrier_failure) END AS real, category AS rule, report_id, row_number() OVER (ORDER BY created_at DESC, report_id) AS p FROM r),
x AS (SELECT unnest([[site], [site, unit], [site, unit, area], [site, unit, area, activity], [site, unit, area, activity, category], [site, unit, area, activity, category, barrier_failure]]) AS path, real, rule, report_id, p FROM m)'''
_on_reports(
    "heatmap_detail", lambda r: heatmap.detailed(r, ids=3).select(F.concat_ws(" / ", *heatmap.LEVELS).alias("path"), "level", "reports", "top_barrier", F.array_join("report_ids", ",").alias("newest")),
    _nodes + ''', counted AS (SELECT path, real AS name, 0 AS rank, count(*) AS n, min(p) AS seen FROM x WHERE real IS NOT NULL GROUP BY ALL UNION ALL SELECT path, rule, 1, count(*), min(p) FROM x GROUP BY ALL),
best AS (SELECT path, name FROM counted QUALIFY row_number() OVER (PARTITION BY path ORDER BY rank, n DESC, seen) = 1),
newest AS (SELECT path, string_agg(report_id, ',' ORDER BY p) AS newest FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY path ORDER BY p) <= 3) GROUP BY path)
SELECT array_to_string(x.path, ' / ') AS path, len(x.path)::INT AS level, count(*) AS reports, CASE WHEN len(x.path) = 6 THEN x.path[6] ELSE max(best.name) END AS top_barrier, max(newest.newest) AS newest
FROM x LEFT JOIN best USING (path) JOIN newest USING (path) GROUP BY x.path''',
)
_on_reports(
    "heatmap_members", lambda r: heatmap.members(r).groupBy("path").agg(F.count("*").alias("reports"), F.min("report_id").alias("least"), F.max("report_id").alias("greatest")).withColumn("path", F.concat_ws(" / ", "path")),
    _nodes + " SELECT array_to_string(path, ' / ') AS path, count(*) AS reports, min(report_id) AS least, max(report_id) AS greatest FROM x GROUP BY path",
)

_on_reports("evidence_topk", lambda r: retrieval.evidence(r).select("report_id", "sif_potential", "risk_score", "date"), "SELECT report_id, sif_potential, risk_score, date FROM r ORDER BY (sif_potential <> 'YES'), risk_score DESC, date DESC, report_id LIMIT 8")
_on_reports("list_page", lambda r: retrieval.page(r, 20, 20).select("report_id", "site", "risk_level"), "SELECT report_id, site, risk_level FROM r ORDER BY created_at DESC, report_id LIMIT 20 OFFSET 20")
_on_reports("top20_high_priority", lambda r: retrieval.priority(r).select("report_id", "risk_level", "risk_score"), "SELECT report_id, risk_level, risk_score FROM r WHERE risk_level IN ('CRITICAL', 'HIGH') ORDER BY risk_score DESC, report_id LIMIT 20")
_on_reports(
    "multi_token_search", lambda r: retrieval.matching(r, ["urgent", "lockout"]).select("report_id", "site", "barrier_failure"),
    """SELECT report_id, site, barrier_failure FROM r WHERE description ILIKE '%urgent%' OR description ILIKE '%lockout%' OR site ILIKE '%urgent%' OR site ILIKE '%lockout%'
OR unit ILIKE '%urgent%' OR unit ILIKE '%lockout%' OR area ILIKE '%urgent%' OR area ILIKE '%lockout%' OR activity ILIKE '%urgent%' OR activity ILIKE '%lockout%'
OR category ILIKE '%urgent%' OR category ILIKE '%lockout%' OR coalesce(barrier_failure ILIKE '%urgent%' OR barrier_failure ILIKE '%lockout%', FALSE) OR report_id ILIKE '%urgent%' OR report_id ILIKE '%lockout%'""",
)
_on_reports("date_range_filter", lambda r: retrieval.scoped(r, "1996-01-01", "1996-12-31", site="ASIA").groupBy("category").agg(F.count("*").alias("reports")), "SELECT category, count(*) AS reports FROM r WHERE site = 'ASIA' AND date BETWEEN '1996-01-01' AND '1996-12-31' GROUP BY category")
_on_reports("in_notin_filter", lambda r: r.filter(F.col("risk_level").isin("CRITICAL", "HIGH") & ~F.col("barrier_failure").isin("Unspecified", "Unknown Barrier Failure")).groupBy("risk_level").agg(F.count("*").alias("reports")), "SELECT risk_level, count(*) AS reports FROM r WHERE risk_level IN ('CRITICAL', 'HIGH') AND barrier_failure NOT IN ('Unspecified', 'Unknown Barrier Failure') GROUP BY risk_level")
_on_reports("distinct_values", lambda r: r.select("site", "unit").distinct(), "SELECT DISTINCT site, unit FROM r")
_on_reports(
    "similar_reports", lambda r: retrieval.similar(r, 4),
    """, f AS (SELECT category, report_id AS similar_id, created_at, row_number() OVER (PARTITION BY category ORDER BY created_at DESC, report_id) AS nth FROM r), t AS (SELECT * FROM f WHERE nth <= 5)
SELECT report_id, similar_id, place FROM (SELECT r.report_id, t.similar_id, row_number() OVER (PARTITION BY r.report_id ORDER BY t.nth)::INT AS place FROM r JOIN t USING (category) WHERE t.similar_id <> r.report_id) WHERE place <= 4""",
)

_both = f"WITH {REPORTS_SQL}, {ACTIONS_SQL} "
_early = lambda r: r.filter("date < '1998-01-01'")
_on("reports_actions_left", lambda s, d: relations.with_actions(reports(s, d), actions(s, d)), _both + "SELECT r.report_id, count(a.report_id) AS actions, count(*) FILTER (a.status = 'OPEN') AS open FROM r LEFT JOIN a USING (report_id) GROUP BY r.report_id")
_on("orphan_anti", lambda s, d: relations.orphans(actions(s, d), _early(reports(s, d))).groupBy("status").agg(F.count("*").alias("actions")), _both + "SELECT status, count(*) AS actions FROM a WHERE report_id NOT IN (SELECT report_id FROM r WHERE date < '1998-01-01') GROUP BY status")
_on("exists_semi", lambda s, d: relations.with_report(actions(s, d), _early(reports(s, d))).groupBy("status").agg(F.count("*").alias("actions")), _both + "SELECT status, count(*) AS actions FROM a WHERE report_id IN (SELECT report_id FROM r WHERE date < '1998-01-01') GROUP BY status")
_on_reports("migration_mismatch", lambda r: relations.mismatches(r, r.withColumn("risk_score", F.when(F.col("risk_score") % 10 == 0, F.col("risk_score") + 1).otherwise(F.col("risk_score")))), "SELECT report_id, risk_score, sif_potential, risk_score + 1 AS other_score, sif_potential AS other_sif FROM r WHERE risk_score % 10 = 0")
_on_reports("except_ids", lambda r: r.select("report_id").subtract(_early(r).select("report_id")), "SELECT report_id FROM r EXCEPT SELECT report_id FROM r WHERE date < '1998-01-01'")
_on_reports("intersect_ids", lambda r: r.filter("risk_level = 'HIGH'").select("report_id").intersect(_early(r).select("report_id")), "SELECT report_id FROM r WHERE risk_level = 'HIGH' INTERSECT SELECT report_id FROM r WHERE date < '1998-01-01'")
_on("dedup_min_id", lambda s, d: relations.first_of_each(table(s, d, "documents").withColumn("hash", F.md5(F.lower(F.trim("text")))), "hash", "doc_id"), "SELECT md5(lower(trim(text, ' '))) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")

_docs = lambda s, d: table(s, d, "documents")
_on(
    "content_hash", lambda s, d: _docs(s, d).select("doc_id", text.content_hash(F.col("text"), F.expr("CASE WHEN doc_id % 3 > 0 THEN lang END"), F.expr("CASE WHEN doc_id % 4 > 0 THEN source END")).alias("hash")),
    r"""SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) || '|' || CASE WHEN doc_id % 3 > 0 THEN lower(lang) ELSE '' END || '|' || CASE WHEN doc_id % 4 > 0 THEN lower(source) ELSE 'site alpha' END) AS hash FROM documents""",
)
_on("email_mask", lambda s, d: _docs(s, d).select("doc_id", F.md5(text.masked_emails(F.col("text"))).alias("masked")), r"SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g')) AS masked FROM documents")
_on(
    "secret_scrub", lambda s, d: _docs(s, d).select("doc_id", F.md5(text.scrubbed(F.concat(F.lit("password: hunter2, \"token\"=\"a b\" postgresql://me:pw@host Bearer abc.def== "), F.col("text")))).alias("scrubbed")),
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('password: hunter2, "token"="a b" postgresql://me:pw@host Bearer abc.def== ' || text,
'(?i)("?(?:password|token|secret|jwt|groq_api_key|api_key)"?\s*[:=]\s*)"[^"]+"', '\1"[REDACTED]"', 'g'),
'(?i)("?(?:password|token|secret|jwt|groq_api_key|api_key)"?\s*[:=]\s*)[^\s,}'']+', '\1[REDACTED]', 'g'), '(?i)Bearer\s+[A-Za-z0-9\-\._~\+\/]+=*', 'Bearer [REDACTED]', 'g'),
'(?i)postgresql\+?[^:]*://[^:]+:[^@]+@', 'postgresql://[USER]:[REDACTED]@', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '[REDACTED_SSN]', 'g'), '\b(?:\d{4}[-\s]?){3}\d{4}\b', '[REDACTED_CARD]', 'g')) AS scrubbed FROM documents""",
)
_on("dataset_quality", lambda s, d: quality.profile(_docs(s, d), "text"), "SELECT count(*) AS rows, count(*) FILTER (trim(text) = '') AS empty, count(*) - count(DISTINCT md5(lower(trim(text)))) AS duplicates, round_even(sum(length(text)) / count(*), 1) AS mean_length FROM documents")
_on("lang_stats", lambda s, d: quality.languages(_docs(s, d), "text"), "SELECT CASE WHEN trim(text) = '' THEN 'unknown' ELSE 'en' END AS language, count(*) AS rows FROM documents GROUP BY 1")
_on("sif_label_norm", lambda s, d: table(s, d, "labels").select("doc_id", text.sif_label(F.expr("CASE WHEN quality = 1 AND toxic = 1 THEN 'yes' WHEN quality = 1 THEN '1' WHEN toxic = 1 THEN 'N' ELSE 'maybe' END")).alias("sif")), "SELECT doc_id, CASE WHEN quality = 1 THEN 'YES' WHEN toxic = 1 THEN 'NO' ELSE 'UNKNOWN' END AS sif FROM labels")
_on("history_last6", lambda s, d: retrieval.last_turns(table(s, d, "conversations")).select("conv_id", "turn", "role", "back"), "SELECT conv_id, turn, role, back::INT AS back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6")
_on("turns_per_conversation", lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns")), "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id")


def _nearest(s, d):
    vectors = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("report_id"), "embedding")
    query = vectors.filter("report_id = '0'").first()["embedding"]
    return retrieval.nearest(vectors, query, 10)


_on("vector_topk", _nearest, "SELECT vec_id::VARCHAR AS report_id, round_even(greatest(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 0), 6) AS score FROM embeddings ORDER BY score DESC, report_id LIMIT 10")
_events = lambda s, d: table(s, d, "events")
_on("events_tumbling", lambda s, d: ev.tumbling(_events(s, d)).withColumn("value", F.bround("value", 4)), "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS events, round_even(sum(value), 4) AS value FROM events GROUP BY 1, 2")
_on("events_sliding", lambda s, d: ev.sliding(_events(s, d)), "SELECT w AS window_start, user_id, count(*) AS events FROM (SELECT user_id, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1, 2")
_on("events_session", lambda s, d: ev.sessions(_events(s, d)), "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT min(ts) AS session_start, user_id, count(*) AS events FROM g GROUP BY user_id, s")
_on("events_dedup", lambda s, d: ev.deduplicated(_events(s, d)).groupBy("event_type").agg(F.count("*").alias("events")), "SELECT event_type, count(DISTINCT event_id) AS events FROM events GROUP BY event_type")

QUERIES |= narratives.QUERIES | listings.QUERIES | analyses.QUERIES | reaching.QUERIES | quick.QUERIES | ingest.QUERIES
ORACLES |= narratives.ORACLES | listings.ORACLES | analyses.ORACLES | reaching.ORACLES | quick.ORACLES | ingest.ORACLES
