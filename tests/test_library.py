"""Operators that SQL doesn't express, and edge cases, on small tables with expectations written by hand."""

import datetime
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hazardlens.functions import text, translation
from hazardlens.functions.redaction import redact, redacted
from hazardlens.operators import analysis, clusters, concepts, listing, scope, summaries
from hazardlens.operators.ordinals import numbered
from hazardlens.sources import uploads
from hazardlens.streaming import events


def narratives(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "report_id long, description string")


def explained(spark, *texts):
    return {r["report_id"]: r for r in analysis.explained(narratives(spark, *texts)).collect()}


def test_named_barriers(spark):
    got = explained(
        spark, "Worker entered the vessel without gas testing and no permit was issued.", "Technician climbed the scaffold with no harness and without any harness; no harness", "Gas testing was completed before the worker entered the tank.",
        "No permit for the office desk", None, "",
    )
    assert got[0]["barrier_names"] == ["Gas Testing Not Completed", "Permit Not Obtained"]
    assert got[0]["barrier_items"][0]["band"] == "HIGH" and got[0]["barrier_items"][0]["confidence"] == 1.0
    assert got[1]["barrier_names"] == ["Fall Protection Not Used"]
    assert got[2]["barrier_names"] == []
    assert [x["confidence"] for x in got[3]["barrier_items"]] and got[3]["barrier_items"][0]["confidence"] < 0.7
    # Too short to be analysed: the cautious analysis, without evidence.
    assert [(got[k]["barrier_names"], got[k]["barrier_items"], got[k]["fallback"]) for k in (4, 5)] == [(["Unknown Barrier Failure"], [], True)] * 2


def test_paraphrases_score_alike(spark):
    got = explained(
        spark, "Worker entered confined space without gas testing.", "Technician went inside the vessel before atmospheric testing.", "Operator entered the tank without checking the atmosphere.", "Contractor stepped into the reactor without atmospheric monitoring."
    )
    assert {(r["risk_score"], r["risk_level"], r["sif_potential"]) for r in got.values()} == {(89, "CRITICAL", "YES")}
    assert all(sum(f["points"] for f in r["factors"]) == r["risk_score"] for r in got.values())
    assert got[0]["risk_reason"] == "Critical risk due to missing Gas Testing Not Completed during unsafe confined space activity"


def test_redaction(spark):
    out, count, kinds = redact("Worker Rahul Kumar (Employee ID 48392) called 555-123-4567 or mail r.k@site.org, 12 Baker Street. Then Mr. Jim Poe went home.")
    assert not re.search(r"Rahul|48392|555|r\.k@|Baker|Jim", out) and count == 6 and kinds == ["ADDRESS", "EMAIL", "EMPLOYEE_ID", "PHONE", "WORKER_NAME"]
    assert redact("The pump operator closed the valve in Tank Farm.") == ("The pump operator closed the valve in Tank Farm.", 0, [])
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "mail a@b.co")], "i int, t string").select("i", redacted("t").alias("p")).collect()
    assert [(r["p"]["text"], r["p"]["count"]) for r in rows] == [(None, 0), ("", 0), ("mail [EMAIL]", 1)]


def test_hash_dates_and_scrubbing(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    h = lambda *v: one(text.content_hash(*[F.lit(x).cast("string") for x in v]))
    assert h("a", None, "b") != h("a", "b", None) and h(" A  b", "x", "") == h("a B", "X", "site ALPHA")
    day = lambda v: one(text.report_date(F.lit(v), "2030-01-01"))
    assert [day(v) for v in ("03/04/2024", "13/04/2024", "2024-02-03T10:00:00", "5 March 2024", "soon", "")] == ["2024-03-04", "2024-04-13", "2024-02-03", "2024-03-05", "2030-01-01", "2030-01-01"]
    assert one(text.scrubbed(F.lit('api_key="abc" password=hunter2, postgresql://u:p@h 123-45-6789 1234 5678 9012 3456'))) == 'api_key=[REDACTED] password=[REDACTED], postgresql://[USER]:[REDACTED]@h [REDACTED_SSN] [REDACTED_CARD]'


def test_dates_by_shape(spark):
    """The same days as when every format is tried in its order; one attempt a format, each behind its shape."""
    formats = [f"{a}{s}{b}{s}{c}" for s, a, b, c in (("-", "yyyy", "MM", "dd"), ("/", "yyyy", "MM", "dd"), ("", "yyyy", "MM", "dd"), *((s, *x, "yyyy") for s in "/-." for x in ("Md", "dM")))]
    names = ["MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy"]
    whole = F.trim("v")
    day = F.regexp_extract(whole, r"^(\S+?)(?:[T ]\d{1,2}:.*)?$", 1)
    plain = F.coalesce(F.date_format(F.coalesce(*[F.try_to_date(whole, f) for f in formats + names], *[F.try_to_date(day, f) for f in formats]), "yyyy-MM-dd"), F.lit("2030-01-01"))
    some = [datetime.date(2024, 5, 3), datetime.date(1999, 12, 31), datetime.date(2023, 9, 13)]
    written = [d.strftime(f) + t for d in some for f in ("%Y-%m-%d", "%Y/%m/%d", "%Y%m%d", "%m/%d/%Y", "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%b %d, %Y", "%B %d, %Y", "%b %d %Y", "%B %d %Y", "%d %b %Y", "%d %B %Y") for t in ("", " ", "T10:00:00", " 9:05", "\n", "Z", " x")]
    odd = [None, "", " ", "soon", "-2024-01-02", "+2024-01-02", "+12024-01-02", "12024-01-02", "-20240102", "2024-1-2", "2024-02-30", "0003/0004/2024", "-3/4/2024", "3/4/-2024", "13/13/2024", "may 5, 2024", "MAY 5 2024", "5 \u017fep 2024", "Sept 5, 2024", "5 Mar  2024", "\u0663/4/2024", "3/4/24", "2024-01-02T1:\n", "1-2-3"]
    df = spark.createDataFrame([(v,) for v in written + odd], "v string")
    got = df.select("v", plain.alias("plain"), text.report_date(F.col("v"), "2030-01-01").alias("day"))
    assert [r for r in got.collect() if r["plain"] != r["day"]] == []
    plan = df.select(text.report_date(F.col("v"), "2030-01-01").alias("day"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("gettimestamp(") == len(formats + names) and plan.count(" THEN ") == len(text.DAY_FORMATS | text.NAMED_FORMATS)


def greedy(rows):
    ids, hashes, out = set(), set(), []
    for k, i, h in sorted(rows):
        if i not in ids and h not in hashes:
            ids.add(i)
            hashes.add(h)
            out.append(k)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_accepted_rows_equal_the_sequential_rule(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(k, f"i{rng.randrange(12)}", f"h{rng.randrange(12)}") for k in range(60)]
    df = spark.createDataFrame(rows, "row_number long, report_id string, content_hash string")
    assert sorted(r["row_number"] for r in uploads.accepted(df).collect()) == greedy(rows)
    assert uploads.accepted(df.limit(0)).count() == 0
    stored = df.filter("row_number < 5")
    assert uploads.new_rows(df, stored).join(stored, "report_id", "left_semi").count() == 0


def test_headers(spark, tmp_path):
    df = spark.createDataFrame([("x", "y", "z")], "`Observation ` string, plant string, location string")
    assert uploads.bind(df).select("description", "site").first() == ("x", "y")
    with pytest.raises(ValueError):
        uploads.bind(df.select("plant"))
    assert uploads.mapped(["Incident Narrative", "Work Zone", "lang"]) == {"report_text": "Incident Narrative", "area": "Work Zone"} | {k: v for k, v in uploads.mapped(["Incident Narrative", "Work Zone", "lang"]).items() if k not in ("report_text", "area")}
    for name, size in (("a.txt", 5), ("a.csv", 0), ("a.csv", 16 << 20)):
        with pytest.raises(ValueError):
            uploads.checked(name, size)
    uploads.checked("a.CSV", 10)
    (tmp_path / "l.csv").write_bytes("text,site\n\"caf\xe9, \"\"x\"\"\",a\n\n".encode("latin-1"))
    assert uploads.read_csv(spark, f"file://{tmp_path}/l.csv").collect() == [('café, "x"', "a")]
    assert uploads.files(spark, f"file://{tmp_path}/l.csv").count() == 1


def test_upload_summary(spark):
    rows = spark.createDataFrame([("CRITICAL", "YES", 2), ("LOW", "NO", 0), ("LOW", "NO", 1)], "risk_level string, sif_potential string, pii_count int")
    got = uploads.summary(rows, read=5, inserted=2).first().asDict()
    assert (got["total_rows"], got["processed"], got["skipped"], got["inserted"], got["duplicates"], got["critical"], got["low"], got["sif"], got["pii_rows"], got["pii_total"]) == (5, 3, 2, 2, 1, 1, 2, 1, 2, 3)


def leaders_by_hand(rows, least):
    """rows: (tokens, barriers, rule) in order."""

    def sim(a, b):
        over = lambda x, y, empty: len(x & y) / len(x | y) if x | y else empty
        same = (0.5 if a[2] == "General Safety" else 1.0) if a[2] == b[2] and a[2] else 0.0
        return round(0.5 * over(a[0], b[0], 0.0) + 0.3 * over(a[1], b[1], 0.5) + 0.2 * same, 4)

    first, out = [], []
    for k, r in enumerate(rows):
        lead = next((j for j in first if sim(rows[j], r) >= least), None)
        if lead is None:
            first.append(k)
        out.append(k if lead is None else lead)
    return out


@pytest.mark.parametrize("least", [0.5, 0.62, 0.8])
def test_leader_clusters_equal_the_sequential_rule(spark, least):
    import random

    rng = random.Random(7)
    words = ["harness", "ladder", "valve", "crane", "tank", "forklift", "weld"]
    rows = [(k, " ".join(rng.sample(words, rng.randrange(0, 5))), rng.choice([None, "A", "B", "Unknown Barrier Failure"]), rng.choice(["General Safety", "Hot Work", "Line of Fire"])) for k in range(120)]
    df = spark.createDataFrame(rows, "report_id long, description string, barrier_failure string, category string")
    prepared = clusters.prepared(df, ["report_id"])
    got = {r["at"]: r["leader"] for r in clusters.leaders(prepared, least).collect()}
    by = {r["at"]: (set(r["tokens"]), set(r["barriers"]), r["rule"]) for r in prepared.collect()}
    assert [got[k] for k in range(120)] == leaders_by_hand([by[k] for k in range(120)], least)


def test_clustering_prepares_texts_once_and_lone_reports_stay_out_of_the_graph(spark, monkeypatch):
    rows = [(k, None if k % 2 else "Worker entered the vesel", None, "General Safety" if k % 2 else "Confined Space") for k in range(60)]
    df = spark.createDataFrame(rows, "report_id long, description string, barrier_failure string, category string")
    prepared = clusters.prepared(df, ["report_id"])
    # Later steps read what is written, and neither number rows nor look at texts again.
    plan = prepared._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "Window" not in plan
    assert {tuple(r["tokens"]) for r in prepared.collect()} == {(), ("canon_action_entry", "canon_actor", "canon_confined_space", "entered", "vessel", "worker")}
    seen, edges = [], clusters.edges
    monkeypatch.setattr(clusters, "edges", lambda kinds, least: seen.append(kinds.count()) or edges(kinds, least))
    got = {r["at"]: r["leader"] for r in clusters.leaders(prepared, 0.5).collect()}
    assert got == {k: k if k % 2 else 0 for k in range(60)} and seen == [1]
    alone = clusters.leaders(prepared.filter("at % 2 = 1"), 0.5).collect()
    assert len(alone) == 30 and all(r["at"] == r["leader"] for r in alone)


def test_cluster_summary_and_insights(spark):
    text_ = "Worker entered the tank without gas testing"
    rows = [(k, text_, f"Site {k % 2}", "Confined Space", "Gas Testing Not Completed", 90, "YES") for k in range(5)]
    df = spark.createDataFrame(rows, "report_id long, description string, site string, category string, barrier_failure string, risk_score int, sif_potential string")
    found = clusters.clusters(df, ["report_id"])
    one = found.collect()
    assert len(one) == 1 and (one[0]["cluster_id"], one[0]["count"], one[0]["risk_level"], one[0]["trend"]) == ("CL-001", 5, "CRITICAL", "increasing")
    assert one[0]["theme"] == "Repeated Gas Testing Not Completed in Confined Space" and len(one[0]["sample_descriptions"]) == 3
    none = spark.createDataFrame([], "month string, total long, ratio double")
    kinds = [r["kind"] for r in clusters.insights(found, none, none.withColumnRenamed("month", "site"), spark.createDataFrame([("RISING RISK", 50.0)], "trend string, delta_percent double")).collect()]
    assert kinds == ["RECURRING_PATTERN", "CROSS_SITE_RISK", "TREND"]
    assert clusters.counters(found).first() == (1, 1, 1) and clusters.grounded(found).first()["frequency"] == 5
    assert clusters.filtered_patterns(found, search="gas", recurring=True, with_sif=True).count() == 1 and clusters.filtered_patterns(found, category="Hot Work").count() == 0
    twice = spark.createDataFrame([(1, "t", "m", "a"), (2, "t", "m", "b"), (3, "u", "m", "c")], "n int, title string, message string, kind string")
    assert sorted(r["kind"] for r in clusters.last_of_equal(twice, "n").collect()) == ["b", "c"]


def test_insights_read_the_clusters_from_a_table(spark):
    found = spark.range(5).selectExpr("row_number() OVER (ORDER BY id) AS count", "concat('CL-', id) AS cluster_id", "'t' AS theme", "array('a', 'b') AS sites", "'HIGH' AS risk_level", "1.0D AS avg_risk")
    none = spark.createDataFrame([], "month string, total long, ratio double")
    got = clusters.insights(found, none, none.withColumnRenamed("month", "site"), spark.createDataFrame([], "trend string, delta_percent double"))
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r["kind"] for r in got.collect()] == ["RECURRING_PATTERN"] * 3 + ["CROSS_SITE_RISK"]


@pytest.mark.parametrize("least", [0.5, 0.7])
def test_clusters_are_summed_by_form_and_equal_a_plain_computation(spark, least):
    import random
    from collections import defaultdict

    rng = random.Random(11)
    texts_ = [None, "", "harness ladder", "ladder valve crane", "valve", "crane tank harness weld", "tank"]
    rows = [(3 * k, rng.choice(texts_), rng.choice(["S1", "S2", "", None]), rng.choice([None, "A", "B", "Unknown Barrier Failure"]), rng.choice(["General Safety", "Hot Work"]), rng.choice([None, 10, 55, 90]), rng.choice(["YES", "no", None])) for k in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "report_id long, description string, site string, barrier_failure string, category string, risk_score int, sif_potential string")
    reports_, forms = clusters.formed(df, ["report_id"], ["report_id", "site"])
    # Reports keep numbers only, and neither rows nor forms are numbered or read as texts again.
    assert reports_.columns == ["report_id", "site", "at", "form"] and sorted(r["at"] for r in reports_.collect()) == list(range(200))
    rows.sort()
    assert forms.count() == len({(r[1] or "", r[3], r[4]) for r in rows}) and all(r["report_id"] == 3 * r["at"] for r in reports_.collect())
    by = {r["form"]: (set(r["tokens"]), set(r["barriers"]), r["rule"]) for r in forms.collect()}
    of = {r["at"]: by[r["form"]] for r in reports_.collect()}
    lead = leaders_by_hand([of[k] for k in range(200)], least)
    assert {r["at"]: r["leader"] for r in clusters.members(df, ["report_id"], least).collect()} == dict(enumerate(lead))
    groups = defaultdict(list)
    for k, at in enumerate(lead):
        groups[at].append(rows[k])
    want = set()
    for n, at in enumerate(sorted(groups), 1):
        g = groups[at]
        most = lambda values, none: max(Counter(v for v in values if v).items(), key=lambda p: (p[1], -[v for v in values].index(p[0])), default=(none, 0))[0]
        risks = [r[5] for r in g if r[5] is not None]
        want.add((f"CL-{n:03}", len(g), most([r[3] for r in g], "Control Verification"), most([r[4] for r in g], ""), round(sum(risks) / len(risks), 1) if risks else 50.0, sum(r[6] == "YES" for r in g), tuple(sorted({r[2] for r in g if r[2]}) or ["Site Alpha"]), tuple(r[1] for r in g[:3] if r[1])))
    got = clusters.clusters(df, ["report_id"], least).collect()
    assert {(r["cluster_id"], r["count"], r["barrier"], r["category"], r["avg_risk"], r["sif_count"], tuple(r["sites"]), tuple(r["sample_descriptions"])) for r in got} == want and len(got) == len(want)


def test_rows_are_numbered_in_ranges_without_a_window_over_them(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS k").repartition(5)
    got = numbered(df, ["k"], "at", 1)
    assert got.filter("at <> k + 1").count() == 0 and got.count() == 1000
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sampled_pairs():
    n = 40
    whole = [(i, j) for i in range(n) for j in range(i + 1, n)]
    step = max(1, len(whole) // 150)
    assert clusters.sampled_pairs(n) == whole[step - 1 :: step]
    assert clusters.sampled_pairs(2) == [(0, 1)] and clusters.sampled_pairs(1) == []


def test_tokens(spark):
    got = narratives(spark, "The worker wasn't wearing PPE", None).select(clusters.tokens(F.col("description")).alias("t")).collect()
    assert got[0]["t"] == sorted(["worker", "canon_actor", "not", "wearing", "personal", "protective", "equipment"]) and got[1]["t"] == []


def test_confidence_words(spark):
    rows = spark.createDataFrame([("high",), ("87",), ("0.5",), ("2.5",), ("odd",), (None,)], "c string").select(clusters.confidence(F.col("c")).alias("v")).collect()
    assert [r["v"] for r in rows] == [0.9, 0.87, 0.5, 0.025, None, None]


def test_concepts_equal_a_plain_computation(spark):
    text_ = "The crew was welding without a fire watch near flammable material"
    words = lambda t: (lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])])(concepts._folded(t))  # noqa: E731, B905
    docs = [Counter(words(f"{name} {body}")) for name, _, body in concepts.CONCEPTS]
    df = Counter(t for d in docs for t in d)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}
    vec = lambda c: {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q = vec(Counter(words(text_)))
    want = [sum(q.get(t, 0) * x for t, x in vec(d).items()) / size(vec(d)) / size(q) for d in docs]
    got = concepts.similarities(narratives(spark, text_, "zzz"), "report_id", "description").collect()
    assert len(got) == 1 and all(abs(a - b) < 1e-9 for a, b in zip(got[0]["cosines"], want, strict=True))
    best = concepts.candidates(narratives(spark, text_), "report_id", "description").orderBy("rank").collect()
    assert best[0]["concept"] == concepts.CONCEPTS[max(range(16), key=lambda k: want[k])][0] and best[0]["confidence"] == round(max(want), 4)
    pair = spark.createDataFrame([(1, text_, text_), (2, text_, "zzz")], "pair_id int, a string, b string")
    assert {r["pair_id"]: round(r["cosine"], 6) for r in concepts.pair_similarity(pair).collect()} == {1: 1.0, 2: 0.0}


def test_scope(spark):
    rows = [("Site Alpha", "Hot Work", "Fall Protection Not Used"), ("Site Beta", "Energy Isolation", "Gas Testing Not Completed"), ("Site Beta", "Hot Work", "Unknown")]
    df = spark.createDataFrame(rows, "site string, category string, barrier_failure string")
    day = datetime.date(2024, 3, 15)
    got = scope.scope_of(df, "Show high risk LOTO reports at beta with gas testing in the last 30 days, unit 4", day)
    assert (got.site, got.category, got.barrier_failure, got.risk_level, got.date_from, got.date_to) == ("Site Beta", "Energy Isolation", "Gas Testing Not Completed", "HIGH", "2024-02-14", "2024-03-15")
    assert got.unapplied == ["unit: no value named"] and "loto" in got.keywords
    assert scope.scope_of(df, "site omega non-sif", day).unapplied == ["site: Site Omega is not stored"]
    assert scope.scope_of(df, "site omega non-sif", day).sif_potential == "NO" and scope.scope_of(df, "nonsif", day).sif_potential is None
    assert scope.scope_of(df.limit(0), "hot work at site beta", day).filters() == {}
    assert scope.dates("last 4000 days", day) is None and scope.dates("past 2 months", day)[:2] == ("2024-01-15", "2024-03-15")
    assert scope.dates("last month", day) == ("2024-02-01", "2024-02-29", "last month")
    assert scope.dates("in may", day) == ("2023-05-01", "2023-05-31", "may") and scope.dates("never", day) is None


def test_translation(spark):
    df = spark.createDataFrame([("लॉकआउट के बिना काम किया", ""), ("plain words", "kn"), (" ", "")], "report_text string, lang string")
    got = translation.processed(df, {"hi": {"लॉकआउट": "lockout", "काम किया": "worked", "के बिना": "without"}, "kn": {"plain": "simple"}}, hint="lang").collect()
    assert [r["report_text"] for r in got] == ["lockout without worked", "simple words", " "]
    assert [r["detected_language"] for r in got] == ["hi", "kn", "unknown"] and got[2]["translation_error"] == "Empty report text"


def test_listing_edges(spark):
    df = spark.createDataFrame([("10", "b"), ("9", "a"), ("x", None)], "report_id string, v string")
    assert [r["report_id"] for r in listing.sorted_by(df, "report_id").collect()] == ["9", "10", "x"]
    assert listing.resolved(df, "v", "B").first()["value"] == "b" and listing.resolved(df, "v", "q").count() == 0
    assert summaries.summary_totals(df.limit(0).selectExpr("v AS sif_potential", "v AS risk_level")).count() == 0


def test_streams_equal_batches(spark, tmp_path):
    rows = [(k, datetime.datetime(2024, 1, 1, k // 4, 0), k % 3, "a" if k % 2 else "b", 1.0) for k in range(40)]
    df = spark.createDataFrame([*rows, rows[0]], "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = events.stream(spark, f"{tmp_path}/in", df.schema)
    for name, query, mode in (("t", events.tumbling, "complete"), ("d", events.distribution, "complete")):
        q = query(source).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, query(df).collect()))
    q = events.deduplicated(source).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once").count() == 40
    hashed = df.withColumn("content_hash", F.md5(F.col("event_id").cast("string")))
    for _ in range(2):
        events.append_new(hashed, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40


def test_store(spark, tmp_path):
    from hazardlens.sources import store

    reports = store.synthetic(spark, 30)
    assert reports.count() == 30 and reports.exceptAll(store.synthetic(spark, 30)).count() == 0
    path = f"{tmp_path}/backup"
    store.backup({"reports": reports}, path)
    assert [tuple(r) for r in store.verified(spark, path, {"reports": reports.schema}).collect()] == [("reports", True)]
    saved = spark.read.schema(reports.schema).json(f"{path}/reports")
    assert store.restored(reports.limit(10), saved, "report_id").count() == 30
    reports.limit(5).coalesce(1).write.mode("append").json(f"{path}/reports")
    assert store.verified(spark, path, {"reports": reports.schema}).first()["ok"] is False
    plan = store.migration({"reports": reports}, {"reports": reports.limit(12)})
    assert [(t, df.count()) for t, df in plan] == [("reports", 18)]
    rows = spark.createDataFrame([(1, "a", "Unspecified"), (2, "gas", None), (3, "gas", "X")], "i int, description string, barrier_failure string")
    got = store.backfilled(rows, lambda t: F.when(t == "gas", "Gas Testing Not Completed")).orderBy("i").collect()
    assert [r["barrier_failure"] for r in got] == ["Unspecified", "Gas Testing Not Completed", "X"]
    one = spark.createDataFrame([(0, "r1", "h1")], "row_number long, report_id string, content_hash string")
    one.drop("row_number").write.parquet(f"{tmp_path}/t")
    two = spark.createDataFrame([(0, "r1", "h9"), (1, "r2", "h2")], "row_number long, report_id string, content_hash string")
    assert store.insert(two, f"{tmp_path}/t") == 1 and spark.read.parquet(f"{tmp_path}/t").count() == 2
    store.log(rows, f"{tmp_path}/log")
    store.log(rows, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 6
    store.reset(spark, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 0 and store.population({"a": rows, "b": reports}).count() == 2


def test_answers(spark):
    from hazardlens.plans import answers, evidence
    from hazardlens.sources import store

    reports = store.synthetic(spark, 60).withColumn("barrier_failure", F.lit("Guard Removed"))
    text_ = answers.rendered(evidence.packet(reports, site="Site Beta"), {"site": "Site Beta"})
    assert text_.startswith("Scope: site = Site Beta\nReports: ") and "Guard Removed" in text_ and "[DEMO-" in text_
    assert answers.problems("High risk: Guard Removed.", ["a", "b", "c"], "HIGH", ["Guard Removed"]) == []
    assert len(answers.problems("Low risk.", ["a"], "HIGH", ["Guard Removed"])) == 3
    clock = [0.0]
    cache, made = answers.Cached(60, lambda: clock[0]), []
    make = lambda: made.append(1) or reports
    for version, at in (("1", 0), ("1", 30), ("2", 31), ("2", 200)):
        clock[0] = at
        cache.get("x", version, make)
    cache.drop()
    assert len(made) == 3
    embed = answers.embedder(lambda ts: [[float(len(t)), 1.0] for t in ts])
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "i int, t string").select("i", embed("t").alias("v")).orderBy("i").collect()
    assert rows[0]["v"] == [3.0, 1.0] and rows[1]["v"] is None
    answers.register_provider("few", lambda r, q: spark.createDataFrame([("p", 1), ("q", 2)], "pattern_id string, frequency int"))
    assert [r["pattern_id"] for r in answers.patterns("few", reports, "?").collect()] == ["q"]


def test_candidates_of_equal_texts_are_reckoned_once(spark, monkeypatch):
    rows = [(k, ("Worker entered the tank without gas testing", "No permit", None)[k % 3]) for k in range(30)]
    df = spark.createDataFrame(rows, "report_id long, description string")
    seen, similarities = [], concepts.similarities
    monkeypatch.setattr(concepts, "similarities", lambda texts, *rest: seen.append(texts.count()) or similarities(texts, *rest))
    got = [tuple(r) for r in concepts.candidates(df, "report_id", "description").collect()]
    assert seen == [3]
    one = sorted(r[1:] for r in got if r[0] == 0)
    assert one and all(sorted(r[1:] for r in got if r[0] == k) == one for k in range(0, 30, 3)) and not [r for r in got if r[0] % 3 == 2]


def test_names_are_looked_for_only_beside_what_a_match_needs(monkeypatch):
    from hazardlens.functions import redaction

    assert redaction.redact("Met john smith (Employee ID: A12); Ann Lee\nreported it")[0] == "Met john smith ([EMPLOYEE_ID]); [WORKER_NAME]\nreported it"
    monkeypatch.setattr(redaction, "_name_before_id", None)
    monkeypatch.setattr(redaction, "_name_before_verb", None)
    assert redaction.redact("Ann Lee and Mary Jones went home, at 555-123-4567")[1:] == (1, ["PHONE"])
