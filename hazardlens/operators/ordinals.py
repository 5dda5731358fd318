"""Numbering the rows of a table without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlens.lineage import cut


def numbered(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """df with the place of each row in the order, without gaps from `first`; the order should be unique.

    Rows are dealt into ranges of the order, sorted there, and written with their place in the range; one count per range is gathered.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # The number of the range is above the lower 33 bits, the place in it, from 0, is these.
    rows = cut(rows.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_nth")).drop("_id"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # One row per range of the shuffle.
    return rows.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_nth") + first).drop("_part", "_nth", "_base")
