"""Queries over uploads, stores and merged values derived from the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.functions import barriers, text
from hazardlens.operators import analysis, clusters, concepts
from hazardlens.plans import evidence
from hazardlens.plans.narratives import _normalized
from hazardlens.sources import store, uploads
from hazardlens.sources.adapters import ACTIONS_SQL, NARRATIVES_SQL, REPORTS_SQL, actions, narratives, reports, table

QUERIES: dict = {}
ORACLES: dict = {}


def _on(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql




# One date in seven ways of writing it; the last is no date.
_WRITTEN = {0: "yyyy-MM-dd", 1: "yyyy/MM/dd", 2: "d MMM yyyy", 3: "MMMM d, yyyy", 4: "yyyy-MM-dd'T'HH:mm:ss", 5: "yyyyMMdd"}


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    written = F.lit("soon")
    for k, form in _WRITTEN.items():
        written = F.when(F.col("o_orderkey") % 7 == k, F.date_format("o_orderdate", form)).otherwise(written)
    return rows.select("o_orderkey", text.report_date(written, "2030-01-01").alias("date"))


_on("dates_as_written", _dated, "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN '2030-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")


def _uploaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an upload with headers of its own; one in five descriptions is too short, one in three has no id."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.when(F.col("doc_id") % 5 == 0, F.lit(" a  b ")).otherwise(F.col("text")).alias(" Observation "), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("U"), F.col("doc_id"))).otherwise(" ").alias("RPT_ID"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("plant"), F.lit("2024/03/05").alias("incident_date"), F.col("lang").alias("Task"),
    )
    return uploads.prepared(uploads.bind(rows), "2030-01-01")


_on(
    "upload_prepared", lambda s, d: _uploaded(s, d).select("report_id", F.length("description").alias("letters"), "site", "unit", "activity", "date", "content_hash"),
    r"""WITH u AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, CASE WHEN doc_id % 2 = 0 THEN coalesce(source, 'Site Alpha') ELSE 'Site Alpha' END AS site, coalesce(lang, 'General Operation') AS activity FROM documents WHERE doc_id % 5 > 0),
h AS (SELECT *, md5(lower(t) || '|2024-03-05|' || lower(site)) AS content_hash FROM u WHERE length(t) >= 5)
SELECT CASE WHEN doc_id % 3 > 0 THEN 'U' || doc_id ELSE content_hash END AS report_id, length(t)::INT AS letters, site, 'Not Specified' AS unit, activity, '2024-03-05' AS date, content_hash FROM h""",
)
_on(
    "upload_summary",
    lambda s, d: uploads.summary(reports(s, d).withColumn("pii_count", (F.col("report_id").cast("long") % 4).cast("int")), read=1_000_000, inserted=100),
    f"""WITH {REPORTS_SQL} SELECT 1000000::BIGINT AS total_rows, count(*) AS processed, 1000000 - count(*) AS skipped, 100::BIGINT AS inserted, count(*) - 100 AS duplicates, count(*) FILTER (risk_level = 'CRITICAL') AS critical,
count(*) FILTER (risk_level = 'HIGH') AS high, count(*) FILTER (risk_level = 'MEDIUM') AS medium, count(*) FILTER (risk_level = 'LOW') AS low, count(*) FILTER (sif_potential = 'YES') AS sif,
count(*) FILTER (report_id::BIGINT % 4 > 0) AS pii_rows, sum(report_id::BIGINT % 4)::BIGINT AS pii_total FROM r""",
)


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of which some ids and some contents are stored already."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("report_id"), F.md5(F.concat(F.lit("c"), F.col("doc_id"))).alias("content_hash"), F.col("doc_id").alias("row_number"))
    stored = docs.select(F.when(F.col("doc_id") % 4 == 0, F.col("report_id")).otherwise(F.concat(F.lit("x"), "report_id")).alias("report_id"), F.when(F.col("doc_id") % 6 == 1, F.col("content_hash")).otherwise(F.md5(F.concat(F.lit("y"), "report_id"))).alias("content_hash"))
    return uploads.new_rows(docs, stored).select("doc_id")


_on("new_to_store", _fresh, "SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 6 <> 1")


def _migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    a = actions(spark, sf_dir).withColumn("action_id", F.concat_ws("-", "report_id", "line"))
    out = None
    for name, missing in store.migration({"actions": a, "reports": r}, {"actions": a.filter("line > 2"), "reports": r.filter("risk_level <> 'LOW'")}):
        one = missing.agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


_on(
    "store_migration", _migrated,
    f"WITH {REPORTS_SQL}, {ACTIONS_SQL} SELECT 'reports' AS name, count(*) AS rows FROM r WHERE risk_level = 'LOW' UNION ALL SELECT 'actions', count(*) FROM a WHERE line <= 2",
)
_on(
    "store_restored", lambda s, d: store.restored(reports(s, d).filter("risk_level = 'LOW'").select("report_id", "site"), reports(s, d).select("report_id", F.lit("saved").alias("site")), "report_id"),
    f"WITH {REPORTS_SQL} SELECT report_id, CASE WHEN risk_level = 'LOW' THEN site ELSE 'saved' END AS site FROM r",
)
_on(
    "store_population", lambda s, d: store.population({"reports": reports(s, d), "actions": actions(s, d), "events": table(s, d, "events")}),
    f"WITH {REPORTS_SQL}, {ACTIONS_SQL} SELECT 'reports' AS \"table\", count(*) AS rows FROM r UNION ALL SELECT 'actions', count(*) FROM a UNION ALL SELECT 'events', count(*) FROM events",
)
_on(
    "barriers_backfilled",
    lambda s, d: store.backfilled(narratives(s, d).withColumn("barrier_failure", F.when(F.col("event_id") % 3 == 0, " Unspecified ").when(F.col("event_id") % 3 == 1, "Known")), lambda t: F.when(t.contains("harness"), "Fall Protection Not Used").when(t.contains("permit"), "Permit Not Obtained")).select("event_id", "barrier_failure"),
    f"""WITH {NARRATIVES_SQL} SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'Known' WHEN contains(coalesce(description, ''), 'harness') THEN 'Fall Protection Not Used'
WHEN contains(coalesce(description, ''), 'permit') THEN 'Permit Not Obtained' ELSE 'Unspecified' END AS barrier_failure FROM d""",
)
_on(
    "uploaded_values_win",
    lambda s, d: analysis.merged(reports(s, d).select("report_id", F.col("category").alias("rule"), "risk_level", F.array(F.lit("Found Barrier")).alias("barrier_names"), F.expr("CASE WHEN risk_score % 2 = 0 THEN ' high ' WHEN risk_score % 3 = 0 THEN 'odd' END AS severity"), F.expr("CASE WHEN risk_score % 5 = 0 THEN 'Near Miss' ELSE ' ' END AS report_type"), F.expr("CASE WHEN risk_score % 7 = 0 THEN barrier_failure END AS barrier_failure"))).select("report_id", "category", "risk_level", "barrier_failure"),
    f"""WITH {REPORTS_SQL} SELECT report_id, CASE WHEN risk_score % 5 = 0 THEN 'Near Miss' ELSE category END AS category, CASE WHEN risk_score % 2 = 0 THEN 'HIGH' ELSE risk_level END AS risk_level,
coalesce(CASE WHEN risk_score % 7 = 0 THEN barrier_failure END, 'Found Barrier') AS barrier_failure FROM r""",
)
_on(
    "scope_packet",
    lambda s, d: (lambda p: p["totals"].select("total", "sif_yes").crossJoin(p["levels"].agg(F.max("reports").alias("most_of_a_level"))).crossJoin(p["months"].agg(F.count("*").alias("months"))).crossJoin(p["evidence"].agg(F.max("risk_score").alias("worst"))))(evidence.packet(reports(s, d), site="ASIA", date_from="1998-01-01", date_to="1998-12-31")),
    f"""WITH {REPORTS_SQL}, q AS (SELECT * FROM r WHERE site = 'ASIA' AND date BETWEEN '1998-01-01' AND '1998-12-31')
SELECT count(*) AS total, count(*) FILTER (sif_potential = 'YES') AS sif_yes, (SELECT max(n) FROM (SELECT count(*) AS n FROM q GROUP BY risk_level)) AS most_of_a_level, count(DISTINCT substr(date, 1, 7)) AS months,
(SELECT max(risk_score) FROM (SELECT risk_score FROM q ORDER BY sif_potential = 'YES' DESC, risk_score DESC LIMIT 8)) AS worst FROM q""",
)


def _clustered(r: DataFrame) -> DataFrame:
    """Reports by rule in the columns of clusters."""
    found = r.groupBy("category").agg(
        F.count("*").alias("count"), F.count_if(F.col("sif_potential") == "YES").alias("sif_count"), F.bround(F.avg("risk_score"), 1).alias("avg_risk"), F.sort_array(F.collect_set("site")).alias("sites"), F.max("barrier_failure").alias("barrier")
    )
    return found.select(F.col("category").alias("cluster_id"), F.concat(F.lit("Hazards in "), "category").alias("theme"), "category", "barrier", "count", "sif_count", "avg_risk", "sites", F.lit("HIGH").alias("risk_level"), F.lit("seen").alias("insight"))


_on(
    "patterns_filtered", lambda s, d: clusters.sorted_patterns(clusters.filtered_patterns(_clustered(reports(s, d)), search="ASIA", level="HIGH", recurring=True, with_sif=True), "sif").select("category", "count"),
    f"WITH {REPORTS_SQL} SELECT category, count(*) AS count FROM r GROUP BY category HAVING count(*) >= 3 AND count(*) FILTER (sif_potential = 'YES') > 0 AND count(*) FILTER (site = 'ASIA') > 0",
)
_on(
    "insights_once",
    lambda s, d: clusters.last_of_equal(table(s, d, "events").select("event_id", F.col("event_type").alias("title"), (F.col("user_id") % 10).cast("string").alias("message")), "event_id").select("event_id", "title", "message"),
    "SELECT max(event_id) AS event_id, event_type AS title, (user_id % 10)::VARCHAR AS message FROM events GROUP BY 2, 3",
)


def _quoted(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _replaced(expression: str) -> str:
    for pattern, put in barriers.HYPHENS:
        expression = f"regexp_replace({expression}, {_quoted(pattern)}, {_quoted(put)}, 'g')"
    return expression


# Every second text writes a compound with a hyphen.
_on(
    "compounds_in_one_spelling", lambda s, d: narratives(s, d).select("event_id", barriers.hyphenless(F.when(F.col("event_id") % 2 == 0, F.replace("description", F.lit("gas testing"), F.lit("Gas-Testing"))).otherwise(F.col("description"))).alias("text")),
    f"""WITH {NARRATIVES_SQL}, h AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN replace(description, 'gas testing', 'Gas-Testing') ELSE description END AS t FROM d)
SELECT event_id, trim(regexp_replace({_replaced("trim(lower(coalesce(t, '')))")}, '\\s+', ' ', 'g')) AS text FROM h""",
)
_stops = "[" + ", ".join(_quoted(w) for w in sorted(concepts.STOPWORDS)) + "]"
_on(
    "folded_words", lambda s, d: narratives(s, d).select("event_id", F.array_join(concepts.folded(F.col("description")), " ").alias("words")),
    f"""WITH {NARRATIVES_SQL}, w AS (SELECT event_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(description, '')), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+'), lambda w: w <> '' AND NOT list_contains({_stops}, w)) AS words FROM d)
SELECT event_id, array_to_string(flatten(list_transform(words, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%ing' THEN [w, left(w, -3)] WHEN length(w) > 4 AND w LIKE '%ed' THEN [w, left(w, -2)]
 WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN [w, left(w, -1)] ELSE [w] END)), ' ') AS words FROM w""",
)

# report_tokens is registered with the lists; its canonical tokens are a table of word and token here.
_canon = ", ".join(f"({_quoted(w)}, {_quoted(c)})" for c, words in clusters.CANONICAL.items() for w in words)
ORACLES["report_tokens"] = f"""WITH {NARRATIVES_SQL}, canon(word, token) AS (VALUES {_canon}), t0 AS (SELECT event_id, lower(coalesce(description, '')) AS lower FROM d),
w AS (SELECT event_id, unnest(list_filter(string_split({_normalized()}, ' '), lambda w: length(w) > 2 AND NOT list_contains([{", ".join(_quoted(w) for w in clusters.STOPWORDS)}], w))) AS word FROM t0),
a AS (SELECT event_id, word AS token FROM w UNION SELECT event_id, token FROM w JOIN canon USING (word))
SELECT t0.event_id, coalesce(string_agg(DISTINCT a.token, ' ' ORDER BY a.token), '') AS tokens FROM t0 LEFT JOIN a USING (event_id) GROUP BY t0.event_id"""
