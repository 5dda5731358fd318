"""Reports in other scripts: detection by script, translation by a dictionary, merging back."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.functions.text import script_language

# Languages that a hint may name, with their display names.
NAMES = {"en": "English", "kn": "Kannada", "hi": "Hindi", "unknown": "Unknown"}


#: Most phrases of a vocabulary; it is sent to every task.
PHRASES = 1_000_000


def vocabulary(table: DataFrame) -> dict[str, dict[str, str]]:
    """Phrases and their English by language, from a table of language, phrase, english of at most PHRASES rows."""
    rows = table.filter("phrase IS NOT NULL AND phrase <> '' AND english IS NOT NULL").orderBy("language", "phrase", "english").limit(PHRASES + 1).collect()
    if len(rows) > PHRASES:
        raise ValueError(f"a vocabulary has at most {PHRASES} phrases")
    out: dict[str, dict[str, str]] = {}
    for r in rows:
        out.setdefault(r["language"], {}).setdefault(r["phrase"], r["english"])
    return out


def automaton(words: dict[str, str]) -> ahocorasick.Automaton:
    """All phrases in one automaton, with their rank: the longest first, equally long ones in the vocabulary's order."""
    out = ahocorasick.Automaton()
    for rank, (phrase, english) in enumerate(sorted(words.items(), key=lambda p: -len(p[0]))):
        out.add_word(phrase, (rank, len(phrase), english))
    out.make_automaton()
    return out


def replaced(text: str, phrases: ahocorasick.Automaton) -> str:
    """The text with its phrases replaced: by rank, then from the left, none over another."""
    found = sorted((rank, end - size + 1, end + 1, english) for end, (rank, size, english) in phrases.iter(text))
    taken, free = [], bytearray(len(text)) if found else b""
    for _, start, end, english in found:
        if not any(free[start:end]):
            free[start:end] = b"\1" * (end - start)
            taken.append((start, end, english))
    out, at = [], 0
    for start, end, english in sorted(taken):
        out += [text[at:start], english]
        at = end
    return "".join([*out, text[at:]])


def translated(text: Column, language: Column, vocabularies: dict[str, dict[str, str]]) -> Column:
    """Texts with the phrases of their language's vocabulary replaced; others as they are. The automata are built once a task."""
    cache: dict[str, ahocorasick.Automaton] = {}

    @F.pandas_udf("string")
    def run(texts: pd.Series, languages: pd.Series) -> pd.Series:
        def one(t, lang):
            if t is None or not vocabularies.get(lang):
                return t
            if lang not in cache:
                cache[lang] = automaton(vocabularies[lang])
            return replaced(t, cache[lang])

        return pd.Series([one(t, lang) for t, lang in zip(texts, languages, strict=True)], dtype=object)

    return run(text, language)


def processed(df: DataFrame, vocabularies: dict[str, dict[str, str]], text: str = "report_text", hint: str | None = None) -> DataFrame:
    """df with the language of each text and its English; the text column holds the English from here on.

    vocabularies: phrases and their English, by language. A hint column that names a
    known language wins over detection. Blank texts are unknown, with an error.
    """
    raw = F.coalesce(F.trim(text), F.lit(""))
    given = F.lower(F.trim(F.coalesce(F.col(hint), F.lit("")))) if hint else F.lit("")
    blank = raw == ""
    language = F.when(blank, "unknown").when(given.isin(*[k for k in NAMES if k != "unknown"]), given).otherwise(script_language(raw))
    out = df.withColumns({"original_report_text": raw, "detected_language": language})
    foreign = F.col("detected_language").isin(*vocabularies) if vocabularies else F.lit(False)
    out = out.withColumn("translated_report_text", translated(F.when(foreign, F.col("original_report_text")), F.col("detected_language"), vocabularies) if vocabularies else F.lit(None).cast("string"))
    english = F.coalesce("translated_report_text", "original_report_text")
    done = F.col("detected_language").isin(*vocabularies) if vocabularies else F.lit(False)
    name = F.when(blank, "Empty/Invalid").otherwise(F.try_element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), F.col("detected_language")))
    out = out.withColumns({"detected_language_name": name, "translated_report_text": english, "is_translated": done, "translation_method": F.when(done, "offline_dict").otherwise("passthrough"), "translation_error": F.when(blank, "Empty report text")})
    return out.withColumn(text, F.when(F.col("is_translated"), F.col("translated_report_text")).otherwise(F.col(text)))


def statistics(df: DataFrame) -> DataFrame:
    """Rows by language, translations and errors of processed rows."""
    is_ = lambda v: F.count_if(F.col("detected_language") == v)
    return df.agg(F.count("*").alias("total"), is_("en").alias("english"), is_("kn").alias("kannada"), is_("hi").alias("hindi"), is_("unknown").alias("unknown"), F.count_if("is_translated").alias("translated"), F.count_if(F.col("translation_error").isNotNull()).alias("translation_errors"))
