"""What an answer in words is given and how one is checked: the packet as text, the validator, a cache, providers."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Most words of an explanation and number of actions that a valid answer has.
MOST_WORDS, ACTIONS = 120, 3


def rendered(packet: dict[str, DataFrame], scope: dict[str, str] | None = None) -> str:
    """The packet's small aggregates as lines of text; every part is bounded by its own limit."""
    lines = ["Scope: " + (", ".join(f"{k} = {v}" for k, v in sorted((scope or {}).items())) or "all reports")]
    total = packet["totals"].first()
    lines.append(f"Reports: {total['total']}, SIF: {total['sif_yes']} ({total['sif_percent']}%)")
    lines.append("Levels: " + ", ".join(f"{r['risk_level']} {r['reports']}" for r in packet["levels"].orderBy("position").collect()))
    for title, part, name in (("Sites", "sites", "site"), ("Rules", "categories", "category"), ("Barriers", "barriers", "barrier_failure")):
        lines.append(f"{title}: " + (", ".join(f"{r[name]} ({r['reports']}, SIF {r['sif']})" for r in packet[part].collect()) or "none"))
    lines.append("Months: " + (", ".join(f"{r['month']} {r['total']}" for r in packet["months"].orderBy("month").collect()) or "none"))
    trend = packet["trend"].first()
    lines.append(f"Trend: {trend['direction'] if trend['assessable'] else 'not assessable'}")
    lines += [f"[{r['report_id']}] {r['date']} {r['risk_level']} {r['risk_score']}: {r['description'] or ''}" for r in packet["evidence"].select("report_id", "date", "risk_level", "risk_score", "description").collect()]
    return "\n".join(lines)


def problems(explanation: str, actions: list[str], level: str, barriers: list[str]) -> list[str]:
    """What speaks against an answer from a language model; empty if nothing does."""
    out = []
    words = explanation.split()
    if not words or len(words) > MOST_WORDS:
        out.append(f"the explanation has {len(words)} words")
    if barriers and not any(b.lower() in explanation.lower() for b in barriers):
        out.append("no detected barrier is named")
    if len([a for a in actions if a.strip()]) != ACTIONS:
        out.append(f"there are {len(actions)} actions")
    named = {v for v in ("CRITICAL", "HIGH", "MEDIUM", "LOW") if re.search(rf"\b{v}\b", explanation, re.IGNORECASE)}
    if named and level not in named:
        out.append(f"it speaks of {', '.join(sorted(named))} where the level is {level}")
    return out


def fallback_text(level: Column, rule: Column, barriers: Column) -> Column:
    """The sentence that stands in for an answer that isn't valid."""
    missing = F.when(F.size(barriers) > 0, F.concat(F.lit(" with "), F.array_join(barriers, ", "))).otherwise("")
    return F.concat(F.initcap(level), F.lit(" risk under "), rule, missing, F.lit(". Verify the controls before work goes on."))


class Cached:
    """Results by name, kept while the data's version stays the same and for ttl seconds at most."""

    def __init__(self, ttl: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock = ttl, clock
        self.held: dict[str, tuple[str, float, DataFrame]] = {}

    def get(self, name: str, version: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The persisted result, made anew for a new version; the old one is released."""
        known = self.held.get(name)
        if known and known[0] == version and self.clock() - known[1] < self.ttl:
            return known[2]
        self.drop(name)
        df = make().persist()
        self.held[name] = (version, self.clock(), df)
        return df

    def drop(self, name: str | None = None) -> None:
        """Release one result, or all after a write."""
        for key in [name] if name else list(self.held):
            if key in self.held:
                self.held.pop(key)[2].unpersist()


def embedder(embed_batch: Callable[[list[str]], list[list[float]]]):
    """A provider's function on lists of texts as a column function, text to array<float>, one call per Arrow batch; null stays null."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            some = texts.dropna()
            found = pd.Series(embed_batch(some.tolist()), index=some.index, dtype=object) if len(some) else pd.Series([], dtype=object)
            yield found.reindex(texts.index).where(lambda s: s.notna(), None)

    return embed


_providers: dict[str, Callable[[DataFrame, str], DataFrame]] = {}


def register_provider(name: str, find: Callable[[DataFrame, str], DataFrame]) -> None:
    """A source of patterns for a question: (reports, question) to a DataFrame of patterns."""
    _providers[name] = find


def patterns(name: str, reports: DataFrame, question: str, most: int = 5) -> DataFrame:
    """A provider's patterns that were seen twice or more, the first few."""
    return _providers[name](reports, question).filter("frequency >= 2").limit(most)
