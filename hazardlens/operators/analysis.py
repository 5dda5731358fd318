"""Analysis of narratives.

`explained` is the whole analysis: barriers by name, clauses in their order, evidence,
reasons. `analyze` is a light one that counts phrases and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.functions import barriers as b
from hazardlens.functions import explain as e
from hazardlens.functions import narrative as n
from hazardlens.functions.spelling import spelled, with_corrections
from hazardlens.schema import UNKNOWN_BARRIER

#: Letters of the shortest text that is analysed.
SHORTEST = 10


def analyze(df: DataFrame, text: str = "description", severity: str | None = None, kind: str | None = None, barriers: Column | None = None, domains: Column | None = None) -> DataFrame:
    """The rows with rule, secondary rule, rule points, negation, sequence, barriers, quality, score, level and SIF potential.

    A null or blank text is General Safety of quality LOW with the penalty 0.4. A barrier is
    a distinct phrase that names a missing control, unless another count is given. Columns of these names are replaced.
    """
    none = F.lit("")
    lower = F.lower(F.coalesce(F.col(text), none))
    out = df.withColumns({"_lower": lower, "_norm": n.normalized(F.col(text)), "_clauses": n.clauses(F.col(text))})
    out = out.withColumns({"_signals": n.rule_signals(F.col("_norm")), "_full": n.negation(F.col("_lower")), "_states": n.clause_states(F.col("_clauses")), "_words": F.size(F.filter(F.split("_lower", r"\s+"), lambda w: w != ""))})
    active = F.array_join(F.filter(F.transform("_states", lambda x: x["state"]), lambda x: x != "N"), "")
    out = out.withColumns({"_scores": n.rule_scores(F.col("_signals"), domains), "_active": active, "_stopped": F.exists("_states", lambda x: x["stopped"])})
    out = out.withColumn("sequence", n.sequence(F.col("_active"), F.col("_stopped"), F.col("_lower")))
    out = out.withColumns({
        "rule": n.primary_rule(F.col("_scores")), "secondary_rule": n.secondary_rule(F.col("_scores")), "rule_points": F.coalesce(F.try_element_at("_scores", F.lit(1))["score"], F.lit(0)),
        "negation": F.when(F.col("_full") == "AMBIGUOUS", F.col("_full")).otherwise(F.coalesce(n.effective(F.col("sequence")), "_full")),
        "barriers": F.size(n.omissions(F.col("_lower"))) if barriers is None else barriers, "penalty": F.when(F.col("_words") == 0, 0.4).otherwise(n.clarity_penalty(F.col("_lower"), F.col("_words"))),
    })
    out = out.withColumns({
        "quality": n.clarity(F.col("penalty"), F.col("_words")),
        "risk_score": n.raw_score(F.col("_lower"), F.col("rule"), F.col("negation"), F.col("barriers"), F.col(severity) if severity else none, F.col(kind) if kind else none),
    })
    out = out.withColumn("risk_level", n.level(F.col("risk_score"), F.col("negation")))
    out = out.withColumn("sif_potential", n.sif_potential(F.col("_lower"), F.col("rule"), F.col("negation"), F.col("barriers"), F.col("risk_score"), F.col("risk_level"), F.col("quality")))
    return out.drop("_lower", "_norm", "_clauses", "_signals", "_scores", "_full", "_states", "_active", "_stopped", "_words")


def pieces(texts: DataFrame) -> DataFrame:
    """text, fixes, pos and piece: the whole text at 0, its clauses from 1 on."""
    each = F.concat(F.array(F.col("text")), n.clauses(F.col("text")))
    return texts.select("text", "fixes", F.posexplode(each).alias("pos", "piece"))


def judged(rows: DataFrame) -> DataFrame:
    """Each piece with its signs: kind of negation, barrier items, controls left out, exposure. One projection after another."""
    rows = rows.withColumns({"lower": F.trim(F.lower("piece")), "safe": b.hyphenless(F.col("piece")), "norm": spelled(n.normalized(F.col("piece")), F.col("fixes"))})
    rows = b.detected(b.omissions(b.exposed(rows)))
    lower, signs = F.col("lower"), {"stops": n.STOP, "not_stopped": n.NEGATED_STOP, "pre": n.PRE_EXPOSURE, "post": n.POST_EXPOSURE, "active": n.ACTIVE_EXPOSURE, "unclear": n.AMBIGUOUS, "omits": n.OMISSION}
    rows = rows.withColumns({name: lower.rlike(pattern) for name, pattern in signs.items()}).withColumn("done", b.done(lower))
    lacks = F.col("omits") | (F.size("omissions") > 0)
    rows = rows.withColumn("lacks", lacks)
    kind = (
        F.when(F.col("unclear"), "AMBIGUOUS").when(F.col("not_stopped") & F.col("lacks"), "UNSAFE_VIOLATION")
        .when(F.col("stops") & ~F.col("not_stopped"), F.when((F.col("active") | F.col("post") | F.col("lacks")) & ~F.col("pre"), "UNSAFE_WITH_INTERVENTION").otherwise("SAFE_PREVENTIVE"))
        .when(F.col("lacks"), "UNSAFE_VIOLATION").otherwise("NONE")
    )
    return rows.withColumn("kind", kind)


#: What of a piece its text's fold needs.
SIGNS = ("pos", "kind", "stops", "done", "items", "pre", "post", "active", "lower", "safe", "norm", "omissions", "exposure", "is_exposed", "entry", "height", "energy", "fire", "near_height", "near_energy")


def firsts(items: Column) -> Column:
    """The first item of each barrier, in order."""
    names = F.transform(items, lambda x: x["barrier"])
    return F.filter(items, lambda x, i: F.array_position(names, x["barrier"]) == i + 1)


def through_time(clauses: Column, whole: Column) -> Column:
    """The clauses of a text folded in order: struct<line, last_unsafe, last_safe, stopped, unsafe_items, all_items>.

    line has U for an unsafe clause and S for a safe one; places count from 0, -1 is
    none. A clause is unsafe if it is a violation or names a failed barrier without
    preventing it, else safe if it prevents or says that a control was there.
    """
    none = F.filter(whole["items"], lambda _: F.lit(False))
    start = F.struct(F.lit("").alias("line"), F.lit(-1).alias("last_unsafe"), F.lit(-1).alias("last_safe"), F.lit(False).alias("stopped"), none.alias("unsafe_items"), none.alias("all_items"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        prevents, fails = x["kind"] == "SAFE_PREVENTIVE", F.size(x["items"]) > 0
        unsafe = (x["kind"] == "UNSAFE_VIOLATION") | (fails & ~prevents)
        safe = ~unsafe & (prevents | (x["done"] & ~fails))
        return F.struct(
            F.concat(acc["line"], F.when(unsafe, "U").when(safe, "S").otherwise("")).alias("line"), F.when(unsafe, acc["at"]).otherwise(acc["last_unsafe"]).alias("last_unsafe"),
            F.when(safe, acc["at"]).otherwise(acc["last_safe"]).alias("last_safe"), (acc["stopped"] | x["stops"] | (x["kind"] == "UNSAFE_WITH_INTERVENTION")).alias("stopped"),
            F.when(unsafe, F.concat(acc["unsafe_items"], x["items"])).otherwise(acc["unsafe_items"]).alias("unsafe_items"), F.concat(acc["all_items"], x["items"]).alias("all_items"), (acc["at"] + 1).alias("at"),
        )

    return F.aggregate(clauses, start, step)


def resolved(df: DataFrame) -> DataFrame:
    """df (with whole and clauses) and sequence, timeline, negation and barrier_items: what holds at the end.

    The last unsafe clause decides, unless a later safe one or an intervention does:
    then it matters whether that came before any exposure.
    """
    df = df.withColumn("fold", through_time(F.col("clauses"), F.col("whole")))
    df = df.withColumns({"line": F.col("fold.line"), "unsafe_items": firsts(F.col("fold.unsafe_items")), "clause_items": firsts(F.col("fold.all_items"))})
    df = df.withColumn("clause_items", F.when(F.size("clause_items") > 0, F.col("clause_items")).otherwise(F.col("whole.items")))
    unsafe, safe, stopped = F.col("fold.last_unsafe") >= 0, F.col("fold.last_safe") >= 0, F.col("fold.stopped") | F.col("whole.stops")
    two, pre = F.length("line") == 2, F.col("whole.pre")
    exposed = F.col("whole.post") | F.col("whole.active")
    mixed = (
        F.when((F.col("fold.last_unsafe") > F.col("fold.last_safe")) & ~stopped, F.when(two, "SAFE_TO_UNSAFE").otherwise("MULTI_STAGE_UNSAFE"))
        .when(pre & ~exposed, F.when(two, "UNSAFE_TO_SAFE").otherwise("MULTI_STAGE_SAFE_RESOLVED")).otherwise("UNSAFE_WITH_INTERVENTION")
    )
    sequence = (
        F.when(F.size("clauses") == 0, "EMPTY").when(unsafe & (safe | stopped), mixed).when(unsafe, "PURE_UNSAFE")
        .when(safe, F.when(pre, "PREVENTIVE_BEFORE_EXPOSURE").otherwise("PURE_SAFE")).otherwise("NEUTRAL")
    )
    df = df.withColumn("sequence", sequence)
    ends = lambda *names: F.col("sequence").isin(*names)
    none = F.filter("unsafe_items", lambda _: F.lit(False))
    held = (
        F.when(ends("SAFE_TO_UNSAFE", "MULTI_STAGE_UNSAFE", "PURE_UNSAFE", "UNSAFE_WITH_INTERVENTION"), F.col("unsafe_items"))
        .when(ends("UNSAFE_TO_SAFE", "MULTI_STAGE_SAFE_RESOLVED"), F.when(F.size("unsafe_items") > 0, F.col("unsafe_items")).otherwise(F.col("clause_items")))
        .when(ends("PREVENTIVE_BEFORE_EXPOSURE"), F.col("clause_items")).otherwise(none)
    )
    df = df.withColumns({"negation": F.coalesce(n.effective(F.when(F.col("sequence") != "EMPTY", F.col("sequence"))), F.lit("NONE")), "timeline": F.when(F.col("line") == "", F.array(F.lit("NEUTRAL"))).otherwise(F.transform(F.split("line", "(?<=.)(?=.)"), lambda c: F.when(c == "U", "UNSAFE").otherwise("SAFE")))})
    # Without barriers in force those of the whole text count, unless all was prevented.
    df = df.withColumn("barrier_items", held)
    found = F.when((F.size("barrier_items") == 0) & (F.col("negation") != "SAFE_PREVENTIVE"), F.col("whole.items")).otherwise(F.col("barrier_items"))
    return df.withColumn("barrier_items", found).drop("fold", "line", "unsafe_items", "clause_items")


def analysed_texts(texts: DataFrame) -> DataFrame:
    """One row for each of the distinct texts (column text), with all that follows from the text alone.

    Clauses are judged as rows of their own, together with the whole text, and folded
    back by text; texts are spread by their own hash, so a frequent text is one row.
    """
    texts = with_corrections(texts, "text", n.normalized(F.col("text")))
    folded = judged(pieces(texts)).groupBy("text").agg(F.array_sort(F.collect_list(F.struct(*SIGNS))).alias("found"))
    out = folded.select("text", F.col("found")[0].alias("whole"), F.slice("found", 2, F.size("found")).alias("clauses"))
    out = resolved(out).drop("clauses").select("*", *[f"whole.{c}" for c in SIGNS if c not in ("pos", "kind", "stops", "done", "items", "pre", "post", "active")]).drop("whole")
    lower = F.col("lower")
    out = out.withColumns({"controls": b.controls(F.col("safe")), "words": F.size(F.filter(F.split(lower, r"\s+"), lambda w: w != ""))})
    out = out.withColumns({"domains": b.domains(), "signals": n.rule_signals(F.col("norm"))})
    out = out.withColumns({"scores": n.rule_scores(F.col("signals"), F.col("domains")), "doubts": n.doubts(lower, F.col("words"))})
    out = out.withColumns({
        "rule": n.primary_rule(F.col("scores")), "secondary_rule": n.secondary_rule(F.col("scores")), "rule_points": F.coalesce(F.try_element_at("scores", F.lit(1))["score"], F.lit(0)),
        "penalty": n.clarity_penalty(lower, F.col("words")), "barrier_names": F.transform("barrier_items", lambda x: x["barrier"]),
    })
    prevented = F.col("negation") == "SAFE_PREVENTIVE"
    out = out.withColumns({"quality": n.clarity(F.col("penalty"), F.col("words")), "barriers": F.size("barrier_names"), "structured_evidence": b.structured(F.col("rule"), prevented)})
    phrases = F.concat(F.transform("omissions", lambda x: x["phrase"]), F.transform("controls", lambda x: x["phrase"]), F.col("exposure"))
    return out.withColumn("evidence", e.evidence(lower, phrases)).drop("signals", "scores", "safe", "norm", "omissions", "controls", "entry", "height", "energy", "fire", "near_height", "near_energy")


def explained(df: DataFrame, text: str = "description", severity: str | None = None, kind: str | None = None) -> DataFrame:
    """The rows with their whole analysis and what supports it.

    Adds rule, secondary_rule, rule_points, domains, negation, sequence, timeline, barrier_items
    (array<struct<barrier, confidence, method, evidence, band>>, the barriers in force at the end),
    barrier_names, barriers (their number), quality, penalty, risk_score, risk_level, sif_potential,
    factors, evidence, structured_evidence, risk_reason, confidence, system_confidence, fallback,
    shown_barriers and recommended_actions; columns of these names are replaced. A null text
    is an empty one. Different texts (with their severity and kind) are reckoned once
    and joined back; misspelled words are corrected for rules and barriers. A text shorter than
    SHORTEST letters, or with high-risk words and no barrier, gets the cautious analysis, without evidence.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    own = df.withColumns({"_text": told(text), "_severity": told(severity), "_kind": told(kind)})
    keys = ["_text", "_severity", "_kind"]
    distinct = own.select(*keys).distinct()
    known = weighed(analysed_texts(distinct.select(F.col("_text").alias("text")).distinct()).withColumnRenamed("text", "_text").join(distinct, "_text"))
    # An aggregate of single rows: filters on results stay above it and aren't spelled out in terms of all stages.
    known = known.groupBy(*keys).agg(*[F.first(c).alias(c) for c in known.columns if c not in keys])
    return own.drop(*(c for c in known.columns if c not in keys)).join(known, keys).drop(*keys)


def weighed(known: DataFrame) -> DataFrame:
    """Analysed texts with a severity and a kind of report each: factors, score, level, SIF potential, confidences, actions."""
    lower, rule, negation, count, names = (F.col(c) for c in ("lower", "rule", "negation", "barriers", "barrier_names"))
    phrases = F.array_distinct(F.flatten(F.transform("barrier_items", lambda x: x["evidence"])))
    out = known.withColumn("factors", e.factors(lower, rule, negation, names, phrases, F.col("exposure"), F.col("is_exposed"), F.col("_severity"), F.col("_kind")))
    out = out.withColumn("risk_score", F.least(F.lit(100), F.aggregate("factors", F.lit(0), lambda total, f: total + f["points"])))
    out = out.withColumn("risk_level", n.level(F.col("risk_score"), F.lit("")))
    out = out.withColumn("sif_potential", n.sif_potential(lower, rule, negation, count, F.col("risk_score"), F.col("risk_level"), F.col("quality")))
    sure = F.coalesce(F.array_max(F.transform("barrier_items", lambda x: x["confidence"])), F.lit(0.5))
    points = F.when(F.col("rule_points") > 0, F.col("rule_points")).otherwise(0.7)
    torn = F.col("sequence").isin("SAFE_TO_UNSAFE", "MULTI_STAGE_UNSAFE") & F.contains(lower, F.lit("maybe"))
    bare = (F.size("barrier_items") == 0) & (F.size("evidence") == 0)
    clear = F.greatest(F.lit(0.10), 1.0 - 0.25 * F.col("doubts") - F.when(F.col("words") < 6, 0.15).otherwise(0.0))
    out = out.withColumns({
        "fallback": e.fallback(lower, rule, negation, F.col("sif_potential"), count) | (F.length(lower) < SHORTEST), "risk_reason": e.reason(F.col("risk_level"), rule, negation, names),
        "confidence": e.confidence(lower, rule, negation, count, F.size("evidence"), F.col("words")),
        "system_confidence": e.system_confidence(sure, points, clear, F.least(F.lit(0.5), F.col("penalty")), torn, bare),
        "shown_barriers": e.shown_barriers(names, F.col("risk_score"), negation),
    })
    out = out.withColumn("recommended_actions", e.actions(negation, F.col("risk_level"), count, F.col("fallback")))
    cautious = {
        "risk_score": F.lit(50), "risk_level": F.lit("MEDIUM"), "sif_potential": F.lit("UNKNOWN"), "rule": F.lit("General Safety"), "negation": F.lit("AMBIGUOUS"), "sequence": F.lit("AMBIGUOUS"),
        "barrier_names": F.array(F.lit(UNKNOWN_BARRIER)), "shown_barriers": F.array(F.lit(UNKNOWN_BARRIER)), "quality": F.lit("LOW"),
        "risk_reason": F.lit(e.CAUTIOUS_REASON), "confidence": e.cautious_confidence(), "system_confidence": e.cautious_confidence(), "timeline": F.array(F.lit("AMBIGUOUS")),
        **{c: F.array().cast(out.schema[c].dataType) for c in ("barrier_items", "factors", "evidence", "structured_evidence")},
    }
    out = out.withColumns({c: F.when(F.col("fallback"), v).otherwise(F.col(c)) for c, v in cautious.items()})
    return out.drop("lower", "exposure", "is_exposed", "words", "doubts")


def merged(analysed: DataFrame) -> DataFrame:
    """Uploaded values over the analysis: the type over the rule, a named severity over the level only, the barrier over the detected one."""
    given = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    level = F.upper(given("severity"))
    return analysed.withColumns({
        "category": F.coalesce(given("report_type"), F.col("rule")), "risk_level": F.when(level.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), level).otherwise(F.col("risk_level")),
        "barrier_failure": F.coalesce(given("barrier_failure"), F.try_element_at("barrier_names", F.lit(1)), F.lit("Unspecified")),
    })
