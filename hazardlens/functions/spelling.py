"""Misspelled words of safety language: a table of known ones, and likeness to a vocabulary.

The likeness is that of Ratcliff and Obershelp: twice the letters in matching
blocks (the longest common block, then the same to its left and right) over all
letters. It is reckoned once for each different token of a table, in tasks; texts
get their corrections by a join.
"""

from __future__ import annotations

import difflib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known misspellings, words that others are corrected to, words that stay.
TYPOS = {
    "gass": "gas", "gases": "gas", "scafold": "scaffold", "scafolding": "scaffold", "scaffld": "scaffold", "scaffolding": "scaffold",
    "harnes": "harness", "harnees": "harness", "harnesss": "harness", "isloation": "isolation", "isolaton": "isolation", "isolatn": "isolation",
    "isolt": "isolation", "isolat": "isolation", "deenergiz": "de-energized", "deenergized": "de-energized", "de-energise": "de-energized",
    "deenergise": "de-energized", "energised": "energized", "baricade": "barricade", "barricad": "barricade", "barakade": "barricade",
    "exclution": "exclusion", "exclusn": "exclusion", "extingusher": "extinguisher", "extingush": "extinguisher", "extingwisher": "extinguisher",
    "respirater": "respirator", "resprator": "respirator", "confind": "confined", "confinded": "confined", "vessle": "vessel", "vesel": "vessel",
    "vessl": "vessel", "depresurize": "depressurize", "depressurise": "depressurize", "depresurised": "depressurized", "depresur": "depressurize",
    "unauthoriz": "unauthorized", "unauthoris": "unauthorized", "linyard": "lanyard", "laynard": "lanyard", "chemcal": "chemical",
    "chemicl": "chemical", "breker": "breaker", "braker": "breaker",
}
VOCABULARY = (
    "scaffold", "scaffolding", "harness", "isolation", "barrier", "confined", "respirator", "extinguisher", "depressurize", "depressurized",
    "lockout", "tagout", "testing", "permit", "clearance", "barricade", "exclusion", "chemical", "hazard", "equipment", "welding", "atmospheric",
    "oxygen", "voltage", "switchgear", "circuit", "protective", "guardrail", "lifeline", "lanyard", "authorized", "authorization", "overhaul",
)
KEPT = ("without", "during", "before", "after", "worker", "contractor")
#: Least likeness, and the shortest token that is compared.
LIKENESS, SHORTEST = 0.82, 5
#: No token longer than this reaches LIKENESS with the longest word: 2 * n / (n + token) >= LIKENESS.
LONGEST = int(max(map(len, VOCABULARY)) * (2 - LIKENESS) / LIKENESS)


@lru_cache(maxsize=1 << 16)
def corrected(token: str) -> str:
    """The word that a token of a normal form stands for; of equally like ones the last by name."""
    if token in TYPOS:
        return TYPOS[token]
    if not SHORTEST <= len(token) <= LONGEST or token in KEPT:
        return token
    return next(iter(difflib.get_close_matches(token, VOCABULARY, n=1, cutoff=LIKENESS)), token)


def corrections(tokens: DataFrame) -> DataFrame:
    """token and word of the distinct tokens that are corrected. Nulls and tokens that stay have no row."""

    def run(batches):
        for batch in batches:
            pairs = [(t, corrected(t)) for t in batch.column(0).to_pylist()]
            changed = [(t, w) for t, w in pairs if t != w]
            yield pa.RecordBatch.from_pydict({"token": pa.array([t for t, _ in changed], pa.string()), "word": pa.array([w for _, w in changed], pa.string())})

    candidate = F.col("token").isin(*TYPOS) | (F.length("token").between(SHORTEST, LONGEST) & ~F.col("token").isin(*KEPT, *VOCABULARY))
    return tokens.select("token").filter(candidate).distinct().mapInArrow(run, "token string, word string")


def with_corrections(texts: DataFrame, key: str, normal: Column) -> DataFrame:
    """texts with `fixes`, the corrections of each text (map<token, word>; null where there are none).

    key is a column whose values are distinct; normal is the text's normal form. Each
    different token is compared once; only corrected ones are shuffled to their texts.
    """
    words = texts.select(key, F.explode(F.array_distinct(F.split(normal, " "))).alias("token"))
    fixes = words.join(corrections(words), "token").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "word"))).alias("fixes"))
    return texts.join(fixes, key, "left")


def spelled(normal: Column, fixes: Column) -> Column:
    """A normal form with its misspelled tokens corrected."""
    return F.when(fixes.isNull(), normal).otherwise(F.array_join(F.transform(F.split(normal, " "), lambda t: F.coalesce(F.try_element_at(fixes, t), t)), " "))
