"""The whole analysis: spelling, barriers, clauses through time, evidence, factors; expectations worked out by hand."""

import difflib
import random

from pyspark.sql import functions as F

from hazardlens.functions import spelling
from hazardlens.functions.narrative import normalized
from hazardlens.operators import analysis


def explained(spark, texts, **more):
    rows = [(k, t, *more.values()) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ", ".join(["report_id long, description string", *[f"{c} string" for c in more]]))
    return [r for r in analysis.explained(df, **{c: c for c in more}).orderBy("report_id").collect()]


def likest(token):
    """The plain rule: every word of the vocabulary against the token."""
    if token in spelling.TYPOS:
        return spelling.TYPOS[token]
    if len(token) < 5 or token in spelling.KEPT:
        return token
    found = max((difflib.SequenceMatcher(None, w, token).ratio(), w) for w in spelling.VOCABULARY)
    return found[1] if found[0] >= 0.82 else token


def test_spelling_equals_the_plain_rule(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def spoiled(w):
        w = list(w)
        for _ in range(rng.randrange(0, 4)):
            at, what = rng.randrange(len(w)), rng.randrange(4)
            if what == 0:
                w.insert(at, rng.choice(letters))
            elif what == 1 and len(w) > 2:
                del w[at]
            elif what == 2:
                w[at] = rng.choice(letters)
            else:
                w[at], w[at - 1] = w[at - 1], w[at]
        return "".join(w)

    words = [*spelling.VOCABULARY, *spelling.TYPOS, *spelling.KEPT, "supervisor", "unauthorized", "atmosphere"]
    tokens = sorted({spoiled(rng.choice(words)) for _ in range(10_000)} | set(words))
    got = {r["token"]: r["word"] for r in spelling.corrections(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    assert {t: got.get(t, t) for t in tokens} == {t: likest(t) for t in tokens}
    assert spelling.corrections(spark.createDataFrame([(None,), ("",)], "token string")).count() == 0


def test_texts_get_their_corrections(spark):
    df = spark.createDataFrame([("The gass testng, no permt",), ("all fine",), ("",)], "text string")
    got = spelling.with_corrections(df, "text", normalized(F.col("text"))).select("text", spelling.spelled(normalized(F.col("text")), F.col("fixes")).alias("n"))
    assert {r["text"]: r["n"] for r in got.collect()} == {"The gass testng, no permt": "the gas testing no permit", "all fine": "all fine", "": ""}


SEQUENCES = [
    ("", "AMBIGUOUS", "AMBIGUOUS", ["Unknown Barrier Failure"]),
    ("The crew inspected the workshop in the morning", "NEUTRAL", "NONE", []),
    ("Worker entered the vessel without gas testing.", "PURE_UNSAFE", "UNSAFE_VIOLATION", ["Gas Testing Not Completed"]),
    ("Gas testing was completed and the permit was obtained.", "PURE_SAFE", "SAFE_PREVENTIVE", []),
    ("The supervisor stopped work before any entry into the pit.", "PREVENTIVE_BEFORE_EXPOSURE", "SAFE_PREVENTIVE", []),
    ("gas test was done at 9am but later technician entered vessel without testing", "SAFE_TO_UNSAFE", "UNSAFE_VIOLATION", ["Gas Testing Not Completed"]),
    ("Permit was obtained. Worker climbed with no harness. The circuit was isolated. Later the fire watch was not posted.", "MULTI_STAGE_UNSAFE", "UNSAFE_VIOLATION", ["Fall Protection Not Used", "Fire Watch Not Posted"]),
    ("There was no permit. The supervisor halted the job before entry.", "UNSAFE_TO_SAFE", "SAFE_PREVENTIVE", ["Permit Not Obtained"]),
    ("There was no permit. There was no gas test. The supervisor halted the job before entry.", "MULTI_STAGE_SAFE_RESOLVED", "SAFE_PREVENTIVE", ["Permit Not Obtained", "Gas Testing Not Completed"]),
    ("Worker entered the tank without gas testing. The supervisor stopped work after the entry.", "UNSAFE_WITH_INTERVENTION", "UNSAFE_WITH_INTERVENTION", ["Gas Testing Not Completed"]),
]


def test_sequences(spark):
    got = explained(spark, [s[0] for s in SEQUENCES])
    assert [(r["sequence"], r["negation"], r["barrier_names"]) for r in got] == [s[1:] for s in SEQUENCES]


def test_structured_evidence(spark):
    got = explained(spark, [
        "Worker entered the tank without gas testing.", "The atmosphere was verified safe. The breaker was locked out.", "A pallet lay near the scaffold tower and the pipeline",
        "The supervisor stopped work before any entry; there was no permit for the vessel", "The operator was standing under a suspended load while the area was barricaded",
    ])
    rows = [[tuple(x) for x in r["structured_evidence"]] for r in got]
    assert rows[0] == [
        ("entry_exposure", "entered the tank", "ENTRY_EXPOSURE", "ACTIVE_VIOLATION", None, "Confined Space"),
        ("gas_testing_missing", "without gas testing", "BARRIER_OMISSION", "ACTIVE_VIOLATION", "Gas Testing Not Completed", "Confined Space"),
    ]
    assert rows[1] == [
        ("gas_testing_verified", "atmosphere was verified", "POSITIVE_CONTROL", "POSITIVE_CONTROL", None, "Confined Space"),
        ("energy_isolation_verified", "breaker was locked out", "POSITIVE_CONTROL", "POSITIVE_CONTROL", None, "Energy Isolation"),
    ]
    assert rows[2] == [
        ("confined_space", "pipeline", "SPATIAL_ENTITY", "CONTEXT_ONLY", None, "Confined Space"),
        ("working_at_height", "scaffold", "SPATIAL_ENTITY", "CONTEXT_ONLY", None, "Working at Height"),
    ]
    assert ("permit_missing", "no permit", "BARRIER_OMISSION", "PREVENTED", "Permit Not Obtained", got[3]["rule"]) in rows[3]
    assert [(x[0], x[1]) for x in rows[4]] == [("line_of_fire_exposure", "standing under a suspended load"), ("exclusion_zone_verified", "area was barricaded")]


def test_factors_add_up_and_say_why(spark):
    r = explained(spark, ["Worker entered the tank without gas testing."], severity="High", kind="Near Miss")[0]
    assert [(f["name"], f["points"], f["most"]) for f in r["factors"]] == [("Hazard Severity", 28, 30), ("Barrier Failure", 25, 25), ("Exposure", 16, 20), ("Activity Criticality", 10, 10), ("Recurrence Weight", 8, 15)]
    assert [f["reason"] for f in r["factors"]] == [
        "Confined Space is classified as a high-hazard Life-Saving Rule.", "Required barrier was not implemented: Gas Testing Not Completed.", "Active operational exposure detected within hazard area.",
        "High-risk critical activity governed by Confined Space mandatory procedures.", "Near-miss event indicates elevated risk of future high-consequence recurrence.",
    ]
    # Two patterns of exposure match the same phrase.
    assert [f["evidence"] for f in r["factors"]] == [["entered the tank"] * 2, ["without gas testing", "without gas test"], ["entered the tank"] * 2, ["Confined Space"], ["near miss"]]
    assert r["risk_score"] == sum(f["points"] for f in r["factors"]) == 87


def test_misspelled_reports_score_like_right_ones(spark):
    a, b = explained(spark, ["Worker entered confined space without gas testing and no permit", "Worker entered confind space without gass testng and no permt"])
    assert (a["barrier_names"], a["risk_score"], a["rule"]) == (b["barrier_names"], b["risk_score"], b["rule"])


def test_repeated_nulls_and_other_columns_stay(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "Worker entered the vessel without gas testing.", None)], "rule long, description string, lower string")
    got = analysis.explained(df).select("lower", "sequence").collect()
    assert sorted((r["lower"] or "", r["sequence"]) for r in got) == [("", "PURE_UNSAFE"), ("x", "AMBIGUOUS"), ("x", "AMBIGUOUS")]
    assert analysis.explained(df.limit(0)).count() == 0


def test_the_plan_stays_small(spark):
    df = spark.createDataFrame([(1, "no permit")], "event_id long, description string")
    whole = analysis.explained(df)
    for one in (whole, whole.select(F.explode("barrier_items")), whole.groupBy("risk_level").count(), whole.filter("risk_level = 'HIGH' AND sif_potential = 'YES'")):
        assert len(one._jdf.queryExecution().optimizedPlan().toString()) < 300_000


def test_dominant_barriers_and_newest_reports(spark):
    import datetime
    from collections import Counter

    from hazardlens.operators import heatmap

    rng = random.Random(3)
    day = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    names = ["PPE Not Worn", "Guard Removed", " PPE Not Worn ", "Unspecified", None, ""]
    rows = [(f"R{k:03}", rng.choice("AB"), rng.choice(["u", None]), "x", "y", rng.choice(["Hot Work", "Line of Fire"]), rng.choice(names), 50, "LOW", "NO", "2024-01-01", rng.choice([None, day(rng.randrange(4))])) for k in range(60)]
    kinds = "report_id string, site string, unit string, area string, activity string, category string, barrier_failure string, risk_score int, risk_level string, sif_potential string, date string, created_at timestamp"
    df = spark.createDataFrame(rows, kinds)
    order = sorted(rows, key=lambda r: (r[-1] is None, -(r[-1] or day(0)).timestamp(), r[0]))
    fill = lambda r: (r[1], r[2] or "Not Specified", r[3], r[4], r[5], (r[6] or "").strip() or "Unspecified")
    want = {}
    for k in range(1, 7):
        for path in {fill(r)[:k] for r in rows}:
            group = [r for r in order if fill(r)[:k] == path]
            real = Counter(r[6].strip() for r in group if r[6] and r[6].strip() not in ("", "Unspecified"))
            mode = (real or Counter(r[5] for r in group)).most_common(1)[0][0]
            want[path] = (path[-1] if k == 6 else mode, [r[0] for r in group][:4])
    got = heatmap.detailed(df, ids=4).collect()
    assert {tuple(r[c] for c in heatmap.LEVELS[: r["level"]]): (r["top_barrier"], r["report_ids"]) for r in got} == want
    assert heatmap.members(df).count() == 6 * len(rows)
    assert heatmap.detailed(df.limit(0)).count() == 0


def test_newest_reports_of_a_place_are_found_in_one_pass(spark):
    """The rows of a path meet once, already limited by each task; the same reports where Spark doesn't limit them."""
    import datetime

    from hazardlens.operators import heatmap

    rng = random.Random(4)
    day = lambda k: None if k % 9 == 0 else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=rng.randrange(5))
    # One place holds most rows; ids, times and names are missing or come again.
    rows = [(None if k % 50 == 7 else f"R{k % 170:03}", rng.choice(["hot"] * 8 + [None, " ", "B"]), None, "", "y", rng.choice(["Hot Work", None, " "]), rng.choice(["Guard Removed", None, "Unknown"]), rng.choice([10, None]), "LOW", "NO", rng.choice(["2024-01-01", None, "x"]), day(k)) for k in range(200)]
    kinds = "report_id string, site string, unit string, area string, activity string, category string, barrier_failure string, risk_score int, risk_level string, sif_potential string, date string, created_at timestamp"
    df = spark.createDataFrame(rows, kinds).repartition(5)
    named = lambda v, other: (v or "").strip() or other
    places = lambda r: (named(r[1], "Site Alpha"), "Not Specified", "Not Specified", "y", named(r[5], "General Safety"), named(r[6], "Unspecified"))
    order = sorted(rows, key=lambda r: (r[-1] is None, -(r[-1] or day(1) or datetime.datetime(2024, 1, 1)).timestamp() if r[-1] else 0, r[0] is not None, r[0] or ""))
    want = {path: [r[0] for r in order if places(r)[: len(path)] == path][:4] for path in {places(r)[:k] for r in rows for k in range(1, 7)}}
    found = lambda: {tuple(r[c] for c in heatmap.LEVELS[: r["level"]]): r["report_ids"] for r in heatmap.detailed(df, ids=4).collect()}
    windows = lambda: heatmap.detailed(df, ids=4)._jdf.queryExecution().optimizedPlan().toString().count("Window [row_number()")
    assert found() == want and windows() == 2
    spark.conf.set(heatmap.LIMITED, "3")
    try:
        assert found() == want and windows() == 3
    finally:
        spark.conf.unset(heatmap.LIMITED)


def test_dataset_profile(spark):
    from hazardlens.operators import quality

    rows = [(" A fall ", "S1", "YES", ""), ("a FALL", "S1", "", "x"), (None, None, None, "x"), ("  ", "S2", "no", "y"), ("other", "S2", "no", "y")]
    df = spark.createDataFrame(rows, "Narrative string, Plant string, SIF string, Notes string")
    r = quality.dataset(df).first()
    assert (r["total_records"], r["total_columns"], r["empty_reports"], r["duplicate_records"], r["avg_report_length"], r["unique_sites"]) == (5, 4, 2, 2, 6, 3)
    assert r["missing_values"] == {"Narrative": 2, "Plant": 1, "SIF": 2, "Notes": 1}
    # No date (10 points) and no activity (none); 2 of 5 empty cost 8 points, 2 of 5 repeated cost 4.
    assert r["health_score"] == 78 and r["warnings"][-2:] == ["2 reports (40%) have missing or empty text.", "2 potential duplicate records detected."] and len(r["warnings"]) == 4
    assert {x["label"]: x["rows"] for x in quality.labels(df, "SIF").collect()} == {"YES": 1, "no": 2, "Unknown": 2}
    none = quality.dataset(df.limit(0)).first()
    assert (none["total_records"], none["health_score"], none["empty_reports"], none["avg_report_length"]) == (0, 90, 0, 0)
    assert quality.dataset(df.select("Notes")).first()["health_score"] == 45


def test_quick_look(spark):
    from hazardlens.functions import quick

    rows = [
        ("Two workers entered the vessel without gas test and no permit", "High", "Near Miss", None), ("The supervisor refused to start the hot work", None, None, "Welding"), ("It is unclear if the crane lift was checked", "low", "", ""),
        ("", None, None, None), (None, "critical", "incident", "Unknown"), ("Tools left near the desk", "low", "", None),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, description string, severity string, type string, activity string")
    got = [r for r in quick.look(df, severity="severity", kind="type", activity="activity").orderBy("k").collect()]
    one = got[0]
    assert (one["quick_rule"], one["quick_barriers"], one["quick_score"], one["quick_level"], one["quick_sif"]) == ("Confined Space", ["Gas Testing Not Completed", "Permit Not Obtained"], 28 + 30 + 20 + 10 + 12, "CRITICAL", "YES")
    assert one["quick_evidence"] == ["no permit", "without gas test"] and len(one["quick_actions"]) == 6 and one["quick_barrier"] == "Gas Testing Not Completed"
    assert [(r["quick_negation"], r["quick_score"], r["quick_level"], r["quick_sif"]) for r in got[1:]] == [
        ("SAFE_PREVENTIVE", 18, "LOW", "NO"), ("AMBIGUOUS", 18 + 12 + 20, "MEDIUM", "UNKNOWN"), ("NONE", 15 + 5 + 8 + 5 + 5, "MEDIUM", "UNKNOWN"), ("NONE", 28 + 5 + 8 + 5 + 15, "HIGH", "UNKNOWN"), ("NONE", 6 + 25 + 8 + 5 + 5, "MEDIUM", "UNKNOWN"),
    ]
    assert [r["quick_activity"] for r in got] == ["General Maintenance", "Welding", "Lifting Operations", "General Maintenance", "General Maintenance", "General Maintenance"]


def test_bundles_and_patterns_without_rows(spark):
    from hazardlens.operators import aggregates, clusters

    kinds = "category string, risk_score int, sif_potential string, risk_level string"
    none = aggregates.dashboard_bundle(spark.createDataFrame([], kinds)).first()
    assert (none["total"], none["mean_score"], none["top_level"], none["top_category"], none["by_category"]) == (0, 0.0, "N/A", "N/A", {})
    r = aggregates.dashboard_bundle(spark.createDataFrame([("B", 10, "YES", "LOW"), ("A", 20, "NO", "HIGH"), (None, None, "UNKNOWN", "HIGH"), ("", 30, "NO", "x")], kinds)).first()
    assert (r["total"], r["mean_score"], r["sif_yes"], r["sif_no"], r["sif_percent"], r["top_level"], r["by_category"], r["top_category"]) == (4, 20.0, 1, 2, 25.0, "HIGH", {"A": 1, "B": 1}, "A")
    rows = spark.createDataFrame([("P1", None, "many", "x", None, "high"), (None, "C2", "7", " ", ["a", ""], "45%"), ("", "", "3", "y", None, "1")], "pattern_id string, cluster_id string, frequency string, theme string, sites array<string>, confidence string")
    got = clusters.as_patterns(rows).collect()
    assert [(p["pattern_id"], p["description"], p["frequency"], p["sites"], p["barriers"], p["confidence"]) for p in got] == [("P1", "x", 0, [], [], 0.9)]
