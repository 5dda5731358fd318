"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document gets the key -ln(u) / w from a number u that follows from its id and
text and from its quality weight w; the documents of a source in ascending order of
their keys are a weighted sample without replacement of any length. A source whose
target is above its size is taken whole as often as it fits; then documents are
taken by key while their running sum of words stays within the rest of the target.
The one document more whose size comes nearest to what is still missing closes the gap.

The running sum of a source isn't one task's work: the distribution of its keys,
which follows from its weights, cuts its order into ranges of about ROWS documents;
ranges are summed first, and only sums meet per source. Sources are ranked and
their targets shared out over one row a source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import Scratch, table

#: Weights of the sources in their order, repeating; share of all words to take; most times a source is taken.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Documents of a range; least and greatest weight of a document.
ROWS, LOW, HIGH = 5_000, 0.25, 4.0
#: Weights by whose numbers the distribution of a source's keys is judged: powers of the square root of 2.
CLASSES = tuple(range(-4, 5))
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """The columns of sizes and target: shares of SHARE by weight, none above MOST times its source, the excess with the others.

    In ascending order of limit by weight the sources at their limit come first:
    one is at its limit if what the earlier ones leave gives it that much.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))).withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST)
    ranked = ranked.withColumn("all", F.sum("source_size").over(everything) * SHARE)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    paid = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("full", F.col("cap") <= (F.col("all") - paid) * F.col("weight") / weights)
    left = F.col("all") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    open_ = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    return ranked.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(left * F.col("weight") / open_)).select(*sizes.columns, "target")


def keyed(df: DataFrame, quality: DataFrame | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size, digest, weight and key of every row; a document without a quality has weight 1, quality 0 to 1 gives 0.5 to 2."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(text.cast("binary")).alias("digest"))
    weight: Column = F.lit(1.0)
    if quality is not None:
        known = quality.groupBy("doc_id").agg(F.avg("quality").alias("quality"))
        rows = rows.join(known, "doc_id", "left")
        weight = F.coalesce(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), 0.5 + 1.5 * F.col("quality"))), F.lit(1.0))
    number = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "digest").cast("binary")), 1, 13), 16, 10).cast("long")
    rows = rows.select("doc_id", "source", "size", "digest", weight.alias("weight"), number.alias("number"))
    return rows.withColumn("key", -F.log((F.col("number") + 0.5) / float(1 << 52)) / F.col("weight")).drop("number")


def mix(df: DataFrame, quality: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of df.

    quality holds doc_id and a quality from 0 to 1; several for a document count as
    their mean. A null text has no words, and a document without words takes none;
    a null source is a source of its own, after the others; a null id is an id like
    others. Repeated rows are documents of their own, with the same key: which of them
    is taken makes no difference. An empty table gives none.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    rows = scratch.save(keyed(df, quality, id_col, text_col, source_col), "rows")
    class_ = F.round(2 * F.log2("weight")).cast("int")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), *[F.count_if(class_ == k).alias(f"of{k}") for k in CLASSES])
    sources = scratch.save(targets(sizes), "sources")
    told = lambda left, right: left.join(right.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # The share of a source's keys that are expected below this one.
    below = reduce(lambda a, b: a + b, [F.col(f"of{k}") * (1 - F.exp(-F.col("key") * 2.0 ** (k / 2))) for k in CLASSES]) / F.col("n")
    ranges = F.floor(below * F.ceil(F.col("n") / ROWS)).cast("long")
    ranged = told(rows, sources).withColumn("range", ranges)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("source", "range").agg(F.sum("size").alias("here")).select(F.col("source").alias("_s"), F.col("range").alias("_r"), F.coalesce(F.sum("here").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    placed = ranged.join(bases, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r"))).withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    placed = placed.withColumn("fits", F.col("before") + F.col("size") <= F.col("rest"))
    placed = scratch.save(placed.select("doc_id", "source", "size", "source_size", "target", "epochs", "rest", "key", "before", "fits"), "placed")
    # What the documents that fit leave open, and the one of the others that closes it best; `before` tells rows with words apart.
    gaps = placed.groupBy("source").agg((F.max("rest") - F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0))).alias("gap"))
    off = F.abs(F.col("gap") - F.col("size"))
    closing = told(placed.filter(~F.col("fits")), gaps).filter(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "key", "before")).alias("closing"))
    closing = closing.select(F.col("source").alias("_s"), F.col("closing.before").alias("_b"))
    out = placed.join(closing, F.col("source").eqNullSafe(F.col("_s")), "left")
    once = F.col("fits") | ((F.col("size") > 0) & F.coalesce(F.col("before") == F.col("_b"), F.lit(False)))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + once.cast("long"))).alias("taken"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
