from pyspark.sql import functions as F

from hazardlens.functions import narrative as n
from hazardlens.operators.analysis import analyze


def one(spark, text, **more):
    return analyze(spark.createDataFrame([(text, *more.values())], ", ".join(["description string", *[f"{k} string" for k in more]])), **{k: k for k in more}).first()


def test_blank_texts(spark):
    for text in (None, "", "  \n "):
        r = one(spark, text)
        assert (r.rule, r.quality, r.penalty, r.sequence, r.barriers) == ("General Safety", "LOW", 0.4, "NEUTRAL", 0)


def test_violation(spark):
    r = one(spark, "The technician entered the tank without gas testing.", kind="Near Miss")
    assert (r.rule, r.negation, r.sequence, r.barriers, r.risk_score, r.risk_level, r.sif_potential) == ("Confined Space", "UNSAFE_VIOLATION", "PURE_UNSAFE", 1, 28 + 25 + 16 + 10 + 8, "CRITICAL", "YES")


def test_stop_before_exposure(spark):
    r = one(spark, "The supervisor stopped the work before any entry into the pit.")
    assert (r.negation, r.risk_level, r.sif_potential) == ("SAFE_PREVENTIVE", "LOW", "NO")


def test_office_has_no_rule(spark):
    assert one(spark, "A cable lay across the office corridor near the desk.").rule == "General Safety"


def test_clauses_and_normalized(spark):
    r = spark.range(1).select(n.clauses(F.lit("Gas test done. But later entered, and then left!")).alias("c"), n.normalized(F.lit("They didn't wear PPE; can't isolate")).alias("t")).first()
    assert r.c == ["Gas test done", "But later entered,", "and then left"]
    assert r.t == "they did not wear personal protective equipment cannot isolate"
