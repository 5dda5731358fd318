"""Concepts near to a text: TF-IDF of words and pairs of words over a fixed bank of concepts.

Weights are fixed with the bank: inverse document frequency ln((1 + n) / (1 + df)) + 1,
term frequency 1 + ln(count), vectors of length one. The bank's weights are a small
table of some hundred terms that is joined to the terms of the texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words without weight, and the concepts with the words that describe them.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "for", "with", "was", "were", "is", "are", "be", "been", "by", "his", "her", "their",
    "while", "during", "before", "after", "without", "no", "not", "prior",
)
RULE, BARRIER = "life_saving_rule", "barrier_failure"
CONCEPTS = (
    ("Confined Space", RULE, "confined space entry tank vessel manhole pit sump chamber reactor column descend descended descend into climb down entered inside inside vessel inside tank atmosphere oxygen h2s toxic gas gas testing gas test air monitoring air quality ventilation hole watch pre entry clearance atmospheric test purge"),
    ("Working at Height", RULE, "working at height fall protection harness lanyard lifeline scaffold scaffolding ladder roof elevated platform ledge climb climbed up rack tower mast ascent descent tie off tied off anchor guardrail open edge drop unprotected edge fall arrest"),
    ("Energy Isolation", RULE, "energy isolation lockout tagout loto isolation de energize deenergize disconnect unplugged plugged plugged in powered power supply live circuit live electrical breaker switchgear energized electric shock stored pressure residual energy zero energy verify isolation servicing service maintenance overhaul repair"),
    ("Hot Work", RULE, "hot work welding welding torch grinding grinder cut cutting brazing spark sparks flame open flame igniting ignition source permit to work hot work permit fire watch combustible material cleared flammable near"),
    ("Line of Fire", RULE, "line of fire suspended load crane rigging hoist hoisted lifted lifting sling load above crew below struck by pinch point dropped object falling material barricade exclusion zone blind spot swing radius stored energy release"),
    ("Vehicle Movement", RULE, "vehicle movement forklift fork lift truck lorry excavator reversing reverse back backed backing spotter banksman flagman traffic management pedestrian walkway segregation seatbelt seat belt run over runover collision runover struck vehicle"),
    ("Chemical Handling", RULE, "chemical handling spill spilled splash splashed acid caustic alkali solvent transfer decant decanting pouring ppe goggles face shield gloves respirator chemical suit msds sds containment bund drip tray corrosive toxic substance exposure"),
    ("Fire Prevention", RULE, "fire prevention combustible flammable material storage ignition source extinguisher extinguishers housekeeping smoking cigarette hot surface surfaces oily rags waste accumulation fuel inheritance fire risk"),
    ("Gas Testing Not Completed", BARRIER, "gas testing not completed atmospheric test skipped no gas test before entry atmosphere unchecked oxygen level not measured air not tested entry prior clearance expired gas test certificate monitor not used"),
    ("Lockout/Tagout Not Completed", BARRIER, "lockout tagout not completed no lockout applied loto missing isolation not applied energy not isolated without lockout tag no padlock stored energy not secured circuit not de energized machine serviced powered"),
    ("Fall Protection Not Used", BARRIER, "fall protection not used harness not worn no harness lanyard not tied off lifeline missing fall arrest not secured unprotected working at height no anchor guardrail missing scaffold without guardrail"),
    ("Permit Not Obtained", BARRIER, "permit not obtained no permit to work ptw missing work started without permit clearance not issued authorization missing approval absent cold work permit hot work permit not raised"),
    ("Isolation Not Applied", BARRIER, "energy isolation not applied equipment not de energized supply not disconnected still connected to power energized during maintenance no isolation applied electrical isolation omitted pressure not released bled down"),
    ("PPE Not Available", BARRIER, "ppe not available personal protective equipment missing not worn safety glasses goggles helmet hard hat absent gloves not used respirator missing protective footwear high visibility vest missing"),
    ("Fire Watch Not Posted", BARRIER, "fire watch not posted no fire watch hot work without fire watch standby fire attendant absent extinguisher not available at work site post work monitoring not done fire guard missing"),
    ("Standby Person Not Assigned", BARRIER, "standby person not assigned no standby attendant missing hole watch missing entry watcher absent vehicle reversing without spotter banksman missing nobody directing traffic guide missing pedestrian uncontrolled"),
)
#: Least similarity of a candidate, and the margin below which two are ambiguous.
LEAST, MARGIN = 0.20, 0.05


def folded(text: Column) -> Column:
    """Words in lower case without stop words, each followed by its stem where it ends in -ing, -ed or -s."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]+", " "), r"\s+"), lambda w: (w != "") & ~w.isin(*STOPWORDS))
    n = F.length
    stem = lambda w: F.when((n(w) > 4) & w.endswith("ing"), F.array(w, w.substr(F.lit(1), n(w) - 3))).when((n(w) > 4) & w.endswith("ed"), F.array(w, w.substr(F.lit(1), n(w) - 2))).when((n(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.array(w, w.substr(F.lit(1), n(w) - 1))).otherwise(F.array(w))
    return F.flatten(F.transform(words, stem))


def terms(text: Column) -> Column:
    """Words and pairs of neighbouring words."""
    words = folded(text)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


def _folded(text: str) -> list[str]:
    """The same for the bank's few texts."""
    out = []
    for w in re.sub(r"[^a-z0-9\s]+", " ", text.lower()).split():
        if w not in STOPWORDS:
            out.append(w)
            for end, least in (("ing", 5), ("ed", 5), ("s", 4)):
                if len(w) >= least and w.endswith(end):
                    if not w.endswith("ss"):
                        out.append(w[: -len(end)])
                    break
    return out


def bank(spark: SparkSession, concepts=CONCEPTS) -> DataFrame:
    """term, idf and the weights of the term in each concept (array in the bank's order)."""
    counts = []
    for name, _, text in concepts:
        words = _folded(f"{name} {text}")
        counts.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    vectors = [{t: (1 + math.log(n)) * idf[t] for t, n in c.items()} for c in counts]
    size = [math.sqrt(sum(w * w for w in v.values())) for v in vectors]
    rows = [(t, idf[t], [v.get(t, 0.0) / s for v, s in zip(vectors, size, strict=True)]) for t in sorted(df)]
    return spark.createDataFrame(rows, "term string, idf double, weights array<double>")


def similarities(df: DataFrame, id_col: str, text: str, concepts=CONCEPTS) -> DataFrame:
    """id and the cosine with each concept (array) of the texts that share a term with the bank."""
    counts = df.select(id_col, F.explode(terms(F.col(text))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("n"))
    # The bank has some hundred terms, whatever the table's size.
    hits = counts.join(F.broadcast(bank(df.sparkSession, concepts)), "term").withColumn("w", (1 + F.log("n")) * F.col("idf"))
    sums = [F.sum(F.col("w") * F.get("weights", F.lit(k))).alias(f"s{k}") for k in range(len(concepts))]
    out = hits.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), *sums)
    return out.select(id_col, F.array(*[F.col(f"s{k}") / F.col("size") for k in range(len(concepts))]).alias("cosines"))


def candidates(df: DataFrame, id_col: str, text: str, k: int = 3, concepts=CONCEPTS) -> DataFrame:
    """Up to k concepts of each text with a cosine of LEAST or more: rank, concept, kind, confidence, runner-up, margin, ambiguous.

    A candidate's runner-up is the best other concept, so from the second on the
    margin is negative. Ties go to the bank's order. Different texts are reckoned
    once and joined back to the ids, which should be distinct.
    """
    keyed = df.select(id_col, F.sha2(F.col(text), 256).alias("_key"), F.col(text).alias("_text"))
    found = ranked(keyed.select("_key", "_text").distinct(), "_key", "_text", k, concepts)
    return keyed.select(id_col, "_key").join(found, "_key").drop("_key")


def ranked(texts: DataFrame, id_col: str, text: str, k: int, concepts) -> DataFrame:
    """The candidates of texts that all differ."""
    order = F.array_sort(F.transform("cosines", lambda c, i: F.struct((-c).alias("rank"), i.alias("at"))))
    name = F.array(*[F.lit(c[0]) for c in concepts])
    kind = F.array(*[F.lit(c[1]) for c in concepts])
    rows = similarities(texts, id_col, text, concepts).withColumn("best", F.slice(order, 1, max(k + 1, 2)))
    rows = rows.select(id_col, "best", F.posexplode(F.slice("best", 1, k)).alias("place", "c")).withColumn("confidence", -F.col("c.rank")).filter(F.col("confidence") >= LEAST)
    other = F.when(F.col("place") == 0, F.try_element_at("best", F.lit(2))).otherwise(F.try_element_at("best", F.lit(1)))
    rows = rows.withColumn("other", other).withColumn("margin", F.col("confidence") + F.col("other.rank"))
    ambiguous = (F.col("margin") < MARGIN) & (-F.col("other.rank") >= LEAST)
    return rows.select(
        id_col, (F.col("place") + 1).alias("rank"), F.get(name, F.col("c.at")).alias("concept"), F.get(kind, F.col("c.at")).alias("kind"), F.bround("confidence", 4).alias("confidence"),
        F.get(name, F.col("other.at")).alias("runner_up"), F.bround("margin", 4).alias("margin"), ambiguous.alias("ambiguous"),
    )


def affinity(a: Column, b: Column) -> Column:
    """Token overlap of two names."""
    x, y = F.array_distinct(folded(a)), F.array_distinct(folded(b))
    union = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def validated(found: DataFrame, analysed: DataFrame, id_col: str) -> DataFrame:
    """Candidates with `accepted`: rules that the classifier names first or gives 3 points, barriers that are detected.

    analysed has the id, rule, scores (array<struct<rule, score>>) and barrier_names (array<string>).
    """
    rows = found.join(analysed.select(id_col, "rule", "scores", "barrier_names"), id_col, "left")
    points = F.coalesce(F.try_element_at(F.filter("scores", lambda s: s["rule"] == F.col("concept")), F.lit(1))["score"], F.lit(0))
    near = F.coalesce(F.array_max(F.transform("barrier_names", lambda b: affinity(b, F.col("concept")))), F.lit(0.0))
    ok = F.when(F.col("kind") == RULE, F.coalesce(F.col("rule") == F.col("concept"), F.lit(False)) | (points >= 3)).otherwise(near >= 0.75)
    return rows.withColumn("accepted", ok).drop("rule", "scores", "barrier_names")


def pair_similarity(pairs: DataFrame, concepts=CONCEPTS) -> DataFrame:
    """Cosine of the two texts of each pair (pair_id, a, b) over the bank's terms; 0 without a common term."""
    one = pairs.select("pair_id", F.lit("a").alias("side"), F.explode(terms(F.col("a"))).alias("term"))
    two = pairs.select("pair_id", F.lit("b").alias("side"), F.explode(terms(F.col("b"))).alias("term"))
    counts = one.unionByName(two).groupBy("pair_id", "term").agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
    weight = lambda n: F.when(F.col(n) > 0, (1 + F.log(F.col(n))) * F.col("idf")).otherwise(0.0)
    hits = counts.join(F.broadcast(bank(pairs.sparkSession, concepts).select("term", "idf")), "term").withColumn("wa", weight("na")).withColumn("wb", weight("nb"))
    out = hits.groupBy("pair_id").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.sqrt(F.sum(F.col("wa") * F.col("wa"))).alias("x"), F.sqrt(F.sum(F.col("wb") * F.col("wb"))).alias("y"))
    cosine = F.when((F.col("x") > 0) & (F.col("y") > 0), F.col("dot") / (F.col("x") * F.col("y"))).otherwise(0.0)
    return pairs.select("pair_id").join(out, "pair_id", "left").select("pair_id", F.coalesce(cosine, F.lit(0.0)).alias("cosine"))


def hybrid(lexical: Column, cosine: Column) -> Column:
    """Six tenths of the lexical similarity and four of the cosine; the lexical one alone without a cosine."""
    return F.bround(F.coalesce(0.6 * lexical + 0.4 * cosine, lexical), 4)
