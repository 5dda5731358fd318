"""Queries over lists, summaries, patterns, scopes and concepts, and their SQL, written by hand where SQL can say it."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from hazardlens.functions import text, translation, vocabularies
from hazardlens.functions.redaction import redacted
from hazardlens.lineage import cut
from hazardlens.operators import aggregates, analysis, clusters, concepts, heatmap, listing, retrieval, scope, summaries, trends
from hazardlens.schema import REPORT_COLUMNS
from hazardlens.sources import uploads
from hazardlens.sources.adapters import ACTIONS_SQL, REPORTS_SQL, actions, narratives, reports, table
from hazardlens.streaming import events as ev
from hazardlens.streaming import limits

QUERIES: dict = {}
ORACLES: dict = {}


def _on_reports(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(reports(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = f"WITH {REPORTS_SQL} {sql}"


def _on(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


_on_reports("point_lookup", lambda r: listing.by_id(r, "7").select("report_id", "site"), "SELECT report_id, site FROM r WHERE report_id = '7'")
_on_reports(
    "contains_filter", lambda r: listing.searched(r, " URGENT ", "critical").select("report_id", "description"),
    "SELECT report_id, description FROM r WHERE description ILIKE '%urgent%' AND risk_level = 'CRITICAL'",
)
_on_reports(
    "list_filter", lambda r: listing.listed(r, "Energy", sif="YES", level="all").select("report_id"),
    "SELECT report_id FROM r WHERE (lower(description) LIKE '%energy%' OR lower(report_id) LIKE '%energy%' OR lower(category) LIKE '%energy%') AND sif_potential = 'YES'",
)
_on_reports(
    "any_column_filter", lambda r: listing.any_column_contains(r.drop("created_at"), "Asia").groupBy("site").agg(F.count("*").alias("reports")),
    """SELECT site, count(*) AS reports FROM r WHERE lower(concat_ws(chr(1), report_id, description, site, unit, area, activity, category, barrier_failure, risk_score::VARCHAR, risk_level, sif_potential, date)) LIKE '%asia%' GROUP BY site""",
)
_on(
    "action_status", lambda s, d: actions(s, d).select(listing.status(F.expr("CASE WHEN line = 1 THEN concat(' ', lower(replace(status, '_', ' '))) WHEN line = 2 THEN ' Parked ' ELSE status END")).alias("status")).groupBy("status").agg(F.count("*").alias("actions")),
    f"WITH {ACTIONS_SQL} SELECT CASE WHEN line = 2 THEN 'Parked' ELSE status END AS status, count(*) AS actions FROM a GROUP BY 1",
)


def _decisions(s, d):
    rows = table(s, d, "labels").select("doc_id", F.expr("CASE WHEN quality = 1 AND toxic = 1 THEN 'confirmed' WHEN quality = 1 THEN ' Corrected' WHEN toxic = 1 THEN 'perhaps' END").alias("decision"))
    good, bad = listing.validated(rows, "decision")
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))


_on("review_decisions", _decisions, "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'CONFIRMED' WHEN quality = 1 THEN 'CORRECTED' WHEN toxic = 1 THEN 'perhaps' END AS decision, quality = 1 AS ok FROM labels")
_on_reports("resolved_value", lambda r: listing.resolved(r, "unit", " united "), "SELECT min(unit) AS value FROM r WHERE lower(unit) LIKE '%united%' HAVING count(*) > 0")
_on_reports("natural_sort", lambda r: listing.sorted_by(r, "report_id", True).limit(20).select("report_id", "site"), "SELECT report_id, site FROM r ORDER BY report_id::BIGINT DESC LIMIT 20")
_on_reports("newest_first", lambda r: listing.newest(r, ["report_id"]).limit(15).select("report_id"), "SELECT report_id FROM r ORDER BY created_at DESC, report_id LIMIT 15")
_on_reports("page_count", listing.pages, "SELECT count(*) AS total, ceil(count(*) / 20)::BIGINT AS pages FROM r")
_on_reports(
    "effective_date", lambda r: listing.effective_date(r.withColumn("date", F.expr("CASE WHEN risk_score % 3 = 0 THEN '' WHEN risk_score % 3 = 1 THEN date END"))).select("report_id", "date"),
    "SELECT report_id, strftime(created_at, '%Y-%m-%d') AS date FROM r",
)
_on(
    "row_ids", lambda s, d: listing.numbered_ids(table(s, d, "documents").select("doc_id"), "doc_id"),
    "SELECT doc_id, 'RPT-' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS report_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)",
)

_on_reports(
    "summary_totals", summaries.summary_totals,
    """SELECT count(*) AS total_reports, count(*) FILTER (sif_potential = 'YES') AS sif_potential, count(*) FILTER (risk_level = 'CRITICAL') AS critical_count,
round_even(count(*) FILTER (sif_potential = 'YES') * 100.0 / count(*), 1)::DOUBLE AS sif_percentage FROM r""",
)
_on_reports("summary_top_rules", lambda r: summaries.most_frequent(r, "category"), "SELECT category AS name, count(*) AS reports FROM r GROUP BY 1 ORDER BY reports DESC, name LIMIT 5")
_on_reports("summary_top_barriers", lambda r: summaries.most_frequent(r, "barrier_failure"), "SELECT coalesce(barrier_failure, 'Unknown') AS name, count(*) AS reports FROM r GROUP BY 1 ORDER BY reports DESC, name LIMIT 5")
_on_reports("top_category", summaries.top_category, "SELECT category AS top_category FROM r GROUP BY category ORDER BY count(*) DESC, category LIMIT 1")
_on_reports(
    "level_shares", summaries.level_shares,
    """SELECT list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], risk_level)::INT AS position, risk_level, count(*) AS reports, floor(count(*) * 100.0 / (SELECT count(*) FROM r) + 0.5)::INT AS percent FROM r GROUP BY risk_level""",
)
_on_reports(
    "sites_to_watch", lambda r: summaries.sites_to_watch(r).select("site", "total"), "SELECT site, count(*) AS total FROM r GROUP BY site ORDER BY total DESC, site LIMIT 5"
)
_on("open_actions", lambda s, d: summaries.open_actions(actions(s, d)).select("report_id", "line", "deadline"), f"WITH {ACTIONS_SQL} SELECT report_id, line, deadline FROM a WHERE status = 'OPEN' ORDER BY deadline, report_id, line LIMIT 5")
_on_reports(
    "pattern_shares", lambda r: summaries.pattern_shares(aggregates.legacy_patterns(r), 200).select("name", "share"),
    """SELECT category || ' + ' || barrier_failure AS name, least(100, floor(count(*) * 100.0 / 200 + 0.5))::INT AS share FROM r
WHERE category <> 'General Safety' AND barrier_failure <> 'Unknown Barrier Failure' GROUP BY 1 HAVING count(*) >= 2""",
)
_on_reports(
    "monthly_fallback", lambda r: trends.monthly_or_current(r.withColumn("date", F.lit("soon")), "2024-05-06"),
    "SELECT '2024-05' AS month, count(*) AS total, count(*) FILTER (sif_potential = 'YES') AS sif, count(*) FILTER (risk_level = 'CRITICAL') AS critical FROM r",
)
_on_reports("monthly_current", lambda r: trends.monthly_or_current(r, "2024-05-06"), "SELECT substr(date, 1, 7) AS month, count(*) AS total, count(*) FILTER (sif_potential = 'YES') AS sif, count(*) FILTER (risk_level = 'CRITICAL') AS critical FROM r GROUP BY 1")
_on_reports(
    "months_covered", summaries.months_covered,
    "SELECT min(substr(date, 1, 7)) AS first_month, max(substr(date, 1, 7)) AS last_month, count(*) FILTER (sif_potential = 'YES') AS sif, count(*) FILTER (risk_level = 'CRITICAL') AS critical FROM r",
)
_on_reports(
    "drill_down", lambda r: summaries.drill_down(heatmap.nodes(r), heatmap.LEVELS, site="ASIA").select("unit", "reports", "sif"),
    "SELECT unit, count(*) AS reports, count(*) FILTER (sif_potential = 'YES') AS sif FROM r WHERE site = 'ASIA' GROUP BY unit",
)
_on_reports(
    "factor_shares",
    lambda r: summaries.factor_shares(r.select("report_id", F.array(F.struct(F.lit("a").alias("name"), F.col("risk_score").alias("points")), F.struct(F.lit("b").alias("name"), F.lit(10).alias("points"))).alias("factors"))).select("report_id", "total", F.col("shares")[0]["percent"].alias("a"), F.col("shares")[1]["percent"].alias("b")),
    "SELECT report_id, risk_score + 10 AS total, floor(risk_score * 100.0 / (risk_score + 10) + 0.5)::INT AS a, floor(1000.0 / (risk_score + 10) + 0.5)::INT AS b FROM r",
)
_on_reports(
    "legacy_values", lambda r: summaries.legacy_values(r).select("report_id", "sif_potential", "risk_level"),
    """SELECT report_id, CASE WHEN risk_score >= 70 THEN 'YES' ELSE 'NO' END AS sif_potential, CASE WHEN risk_score > 80 THEN 'CRITICAL' WHEN risk_score > 60 THEN 'HIGH' WHEN risk_score > 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM r""",
)
_on_reports("gauge", lambda r: r.select("report_id", summaries.gauge(F.col("risk_score") * 3 - 100).alias("gauge")), "SELECT report_id, least(greatest(risk_score * 3 - 100, 0), 100) AS gauge FROM r")
_on_reports(
    "what_if", lambda r: summaries.what_if(r, F.array(F.lit("permit"), F.lit("supervisor"), F.lit("harness"), F.lit("permit"))).select("report_id", "simulated_score"),
    """SELECT report_id, greatest(5, floor(risk_score * (1 - CASE category WHEN 'Confined Space' THEN 20 WHEN 'Energy Isolation' THEN 10 WHEN 'Hot Work' THEN 25 WHEN 'Working at Height' THEN 28 WHEN 'Line of Fire' THEN 12 ELSE 10 END / 100::DOUBLE) + 0.5))::INT AS simulated_score FROM r""",
)
_on(
    "latest_versions", lambda s, d: summaries.latest_versions(table(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id"),
    "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
)


def _upserted(s, d):
    rows = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("report_id"), "embedding", "vec_id")
    stored = rows.filter("vec_id < 100").select("report_id", "embedding", F.lit("m").alias("model_id"), F.lit(1).alias("created_at"))
    new = rows.filter("vec_id BETWEEN 50 AND 149").select("report_id", F.when(F.col("vec_id") % 10 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("embedding"), F.lit("m").alias("model_id"), F.lit(2).alias("created_at"))
    return summaries.upserted(stored, new, 64, "m").select("report_id", "model_id", "created_at")


_on(
    "vector_upsert", _upserted,
    """SELECT vec_id::VARCHAR AS report_id, 'm' AS model_id, CASE WHEN vec_id >= 50 AND vec_id % 10 > 0 THEN 2 ELSE 1 END AS created_at FROM embeddings WHERE vec_id < 100 OR (vec_id < 150 AND vec_id % 10 > 0)""",
)
_on(
    "vector_topk_candidates", lambda s, d: retrieval.nearest_of(table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("report_id"), "embedding"), reports(s, d).filter("risk_level = 'HIGH'"), [0.1] * 64, 5),
    f"""WITH {REPORTS_SQL} SELECT report_id, round_even(greatest(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda x: 0.1::DOUBLE)), 0), 6) AS score, site, risk_level
FROM embeddings JOIN r ON report_id = vec_id::VARCHAR WHERE risk_level = 'HIGH' ORDER BY score DESC, report_id LIMIT 5""",
)
_on(
    "cascade_delete", lambda s, d: summaries.without_parents(actions(s, d), reports(s, d).filter("risk_level = 'LOW'")).groupBy("status").agg(F.count("*").alias("actions")),
    f"WITH {REPORTS_SQL}, {ACTIONS_SQL} SELECT status, count(*) AS actions FROM a WHERE report_id NOT IN (SELECT report_id FROM r WHERE risk_level = 'LOW') GROUP BY status",
)
_on_reports(
    "column_bootstrap", lambda r: summaries.with_columns_of(r.select("report_id", "description", "barrier_failure"), REPORT_COLUMNS).select("report_id", "barrier_failure", "unit", "risk_score", "pii_count", "date"),
    "SELECT report_id, coalesce(barrier_failure, 'Unspecified') AS barrier_failure, 'Not Specified' AS unit, 0 AS risk_score, 0 AS pii_count, NULL::VARCHAR AS date FROM r",
)
_on_reports(
    "refresh", lambda r: summaries.refreshed({"sites": aggregates.site_stats(r), "months": trends.monthly(r), "rules": aggregates.category_distribution(r)}),
    """SELECT 'sites' AS aggregate, count(DISTINCT site) AS rows FROM r UNION ALL SELECT 'months', count(DISTINCT substr(date, 1, 7)) FROM r UNION ALL SELECT 'rules', count(DISTINCT category) FROM r""",
)
_on(
    "legacy_hash", lambda s, d: table(s, d, "documents").select("doc_id", text.legacy_hash(F.col("text"), F.col("lang"), F.lit(None).cast("string")).alias("hash")),
    r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) || '|' || lower(lang) || '|') AS hash FROM documents",
)
_on(
    "trailing_minute", lambda s, d: ev.recent(table(s, d, "events").select("event_id", "user_id", F.date_trunc("hour", "ts").alias("ts"))).select("event_id", "recent", "limited"),
    """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('hour', ts)) RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS recent, FALSE AS limited FROM events""",
)


def _pairs(r):
    rows = r.select(F.col("report_id").cast("long").alias("k"), F.array_sort(F.array_distinct(F.array("site", "unit", "area"))).alias("tokens"), clusters.barriers(F.col("barrier_failure")).alias("barriers"), F.col("category").alias("rule"))
    one, two = rows.select("k", F.struct("tokens", "barriers", "rule").alias("a")), rows.select((F.col("k") - 9).alias("k"), F.struct("tokens", "barriers", "rule").alias("b"))
    return one.join(two, "k").select("k", clusters.similarity("a", "b").alias("similarity"))


_on_reports(
    "pair_similarity", _pairs,
    """, p AS (SELECT report_id::BIGINT AS k, list_distinct([site, unit, area]) AS t, CASE WHEN coalesce(barrier_failure, '') IN ('', 'Unknown Barrier Failure') THEN []::VARCHAR[] ELSE [barrier_failure] END AS b, category AS c FROM r)
SELECT x.k, round_even(0.5 * len(list_intersect(x.t, y.t)) / len(list_distinct(x.t || y.t)) + 0.3 * CASE WHEN len(x.b) + len(y.b) = 0 THEN 0.5 WHEN len(x.b) = 0 OR len(y.b) = 0 THEN 0 WHEN x.b = y.b THEN 1 ELSE 0 END
+ 0.2 * CASE WHEN x.c <> y.c THEN 0 WHEN x.c = 'General Safety' THEN 0.5 ELSE 1 END, 4)::DOUBLE AS similarity FROM p x JOIN p y ON y.k = x.k + 9""",
)
ORACLES["pair_similarity"] = ORACLES["pair_similarity"].replace(") , p AS", "), p AS")
_on_reports(
    "question_scope", lambda r: retrieval.scoped(r, **scope.scope_of(r, "How many critical confined space incidents in March 2000?", datetime.date(2001, 5, 1)).filters()).select("report_id"),
    "SELECT report_id FROM r WHERE risk_level = 'CRITICAL' AND category = 'Confined Space' AND date BETWEEN '2000-03-01' AND '2000-03-31'",
)
_on(
    "translation_counts", lambda s, d: translation.statistics(translation.processed(table(s, d, "documents").withColumn("text", F.when(F.col("doc_id") % 10 > 0, F.col("text"))), {"hi": {"लॉकआउट": "lockout"}}, "text")),
    """SELECT count(*) AS total, count(*) FILTER (doc_id % 10 > 0 AND trim(text) <> '') AS english, 0::BIGINT AS kannada, 0::BIGINT AS hindi, count(*) FILTER (doc_id % 10 = 0 OR trim(text) = '') AS unknown, 0::BIGINT AS translated,
count(*) FILTER (doc_id % 10 = 0 OR trim(text) = '') AS translation_errors FROM documents""",
)


def _foreign(s, d):
    """Documents, of which two in four are short reports in another language and one is blank."""
    of = lambda k: F.col("doc_id") % 4 == k
    where = F.coalesce("source", F.lit("-"))
    said = F.when(of(0), F.concat(F.lit("श्रमिक बिना अनुमति सीमित स्थान प्रवेश किया "), where)).when(of(1), F.concat(F.lit("ಕಾರ್ಮಿಕರು ಅನುಮತಿ ಇಲ್ಲದೆ ಸೀಮಿತ ಸ್ಥಳ ಪ್ರವೇಶಿಸಿದರು "), where)).when(of(2), F.lit(" ")).otherwise(F.concat(F.lit("no permit at "), where))
    words = s.createDataFrame([(lang, k, v) for lang, table_ in (("kn", vocabularies.KANNADA), ("hi", vocabularies.HINDI)) for k, v in table_.items()], "language string, phrase string, english string")
    return translation.processed(table(s, d, "documents").withColumn("text", said), translation.vocabulary(words), "text")


_on(
    "translated_reports", lambda s, d: _foreign(s, d).select("doc_id", "detected_language", "translation_method", "translation_error", "text"),
    """SELECT doc_id, ['hi', 'kn', 'unknown', 'en'][doc_id % 4 + 1] AS detected_language, CASE WHEN doc_id % 4 < 2 THEN 'offline_dict' ELSE 'passthrough' END AS translation_method,
CASE WHEN doc_id % 4 = 2 THEN 'Empty report text' END AS translation_error,
CASE doc_id % 4 WHEN 0 THEN 'worker without permit confined space entered ' || coalesce(source, '-') WHEN 1 THEN 'workers without permit confined space entered ' || coalesce(source, '-') WHEN 2 THEN ' ' ELSE 'no permit at ' || coalesce(source, '-') END AS text FROM documents""",
)
_on(
    "translation_statistics", lambda s, d: translation.statistics(_foreign(s, d)),
    """SELECT count(*) AS total, count(*) FILTER (doc_id % 4 = 3) AS english, count(*) FILTER (doc_id % 4 = 1) AS kannada, count(*) FILTER (doc_id % 4 = 0) AS hindi, count(*) FILTER (doc_id % 4 = 2) AS unknown,
count(*) FILTER (doc_id % 4 < 2) AS translated, count(*) FILTER (doc_id % 4 = 2) AS translation_errors FROM documents""",
)
_on(
    "admitted_requests", lambda s, d: limits.admitted(limits.requests(table(s, d, "events"), "user_id", "event_id", "ts", F.col("event_type").isin("signup", "purchase")), 21_600, 3, 1).select("client", "request", "admitted", "reason"),
    """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS client, event_id::VARCHAR AS request, epoch_us(ts) AS t, event_type IN ('signup', 'purchase') AS sensitive FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY t, request) AS n FROM e),
f AS (SELECT client, request, n, CASE WHEN FALSE THEN '' END AS reason, [t] AS held, CASE WHEN sensitive THEN [t] ELSE []::BIGINT[] END AS secret FROM o WHERE n = 1
  UNION ALL
  SELECT client, request, n, reason, CASE WHEN reason IS NULL THEN list_append(recent, t) ELSE recent END, CASE WHEN reason IS NULL AND sensitive THEN list_append(hidden, t) ELSE hidden END FROM (
    SELECT *, CASE WHEN len(recent) >= 3 THEN 'too many requests' WHEN sensitive AND len(hidden) >= 1 THEN 'too many sensitive requests' END AS reason FROM (
      SELECT o.*, list_filter(f.held, lambda x: x > o.t - 21600000000) AS recent, list_filter(f.secret, lambda x: x > o.t - 21600000000) AS hidden FROM f JOIN o ON o.client = f.client AND o.n = f.n + 1)))
SELECT client, request, reason IS NULL AS admitted, reason FROM f""",
)


# Not to be said in SQL; held against plain versions in the tests.
def _narratives(s, d):
    """Narratives with what clustering needs: rule, first barrier, score, SIF potential."""
    rows = analysis.explained(narratives(s, d), severity="severity", kind="report_type")
    return rows.select(F.col("event_id").alias("report_id"), "description", "site", F.col("rule").alias("category"), F.try_element_at("barrier_names", F.lit(1)).alias("barrier_failure"), "risk_score", "sif_potential")


_on("pii_full", lambda s, d: table(s, d, "documents").select("doc_id", redacted("text").alias("p")).select("doc_id", F.md5("p.text").alias("redacted_md5"), "p.count", F.array_join("p.types", ",").alias("types")))
_on("report_tokens", lambda s, d: narratives(s, d).select("event_id", F.array_join(clusters.tokens(F.col("description")), " ").alias("tokens")))
_on("leader_clusters", lambda s, d: clusters.clusters(_narratives(s, d), ["report_id"]).drop("sites", "sample_descriptions"))
_on("repeated_failures", lambda s, d: clusters.repeated(clusters.clusters(_narratives(s, d), ["report_id"])).select("cluster_id", "theme", "count", "risk_level"))
_on("cluster_counters", lambda s, d: clusters.counters(clusters.clusters(_narratives(s, d), ["report_id"])))
_on("cluster_evidence", lambda s, d: clusters.members(_narratives(s, d), ["report_id"]))
_on("tfidf_candidates", lambda s, d: concepts.candidates(narratives(s, d), "event_id", "description"))
_on("upload_dedup", lambda s, d: uploads.accepted(table(s, d, "documents").select(F.col("doc_id").alias("row_number"), (F.col("doc_id") % 700).cast("string").alias("report_id"), F.md5(F.lower(F.trim("text"))).alias("content_hash"))))


def _insights(s, d):
    r = reports(s, d)
    # One row a month, read by two of the parts.
    months = cut(trends.monthly(r))
    return clusters.insights(clusters.clusters(_narratives(s, d), ["report_id"]), trends.month_anomaly(months), trends.site_anomalies(r), trends.trend(months))


_on("insights", _insights)
