"""Documents to packed training sequences, in five stages.

Each stage reads all that the one before it kept, as a table in the shared
folder, and decides for the next. STAGES lists (name, function); a function takes
(spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import language, neardup, packing, suffixes, toxicity
from llm.bpe import default_path
from llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance does not find toxic; all of them, null and empty texts too, where there is nothing to learn from."""
    model = toxicity.fit(docs, toxicity.marks(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, COLUMNS).filter(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; null texts, those without letters and those far from every model go, all where no language was learned."""
    model = language.fit(docs.filter(~language.held_out()).select("text", "lang"))
    return language.identify(docs, model, COLUMNS).filter(~F.col("rejected")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, with the group's smallest id; of repeated rows one, a row without id counts as its own id."""
    return neardup.representatives(docs, list(COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur earlier; a character that loses a byte goes whole."""
    return suffixes.removed(docs, carry=("lang", "source"), readable=True).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place; a null text is empty, repeated rows are packed as they come."""
    return packing.packed_documents(docs, default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("packing", pack),
]

#: SQL has no compression distance, language model or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
