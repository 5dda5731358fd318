"""Sharding by balanced label propagation.

Documents are the vertices of a graph and equal texts its links. Every document
starts in a shard chosen by hash. In each round a group of linked documents
votes: its members move to the shard where most of its members already are, as
long as that shard's quota has room; the groups with most to gain go first.
A group of which no shard with room holds a member moves as a whole to one that
has room for all of it, so a group that fits is not left apart; one that is larger
than any room fills several shards. Every move brings more members of a group
together, so the rounds end by themselves when no move is left. Documents without links cost
nothing wherever they lie; in the end they are dealt out to make the row counts
of all shards differ by at most one (the law `rows`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import Scratch, table

SHARDS, PARTS = 16, 256


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str, parts: int = PARTS) -> DataFrame:
    """Rows numbered without gaps from 0 within `by`, in parts by hash so that no large class meets in one task."""
    df = df.withColumn("_part", F.pmod("spot", F.lit(parts)).cast("int"))
    sizes = df.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*by, "_part").orderBy(*order)
    return df.join(bases, [*by, "_part"]).withColumn(name, F.col("_base") + F.row_number().over(within) - 1).drop("_part", "_base")


def votes(members: DataFrame) -> DataFrame:
    """group, shard and how many of the group's members lie there."""
    return members.groupBy("link", "shard").agg(F.count("*").alias("here"))


def moved(members: DataFrame, quota: int, shards: int, scratch: Scratch, step: int) -> DataFrame:
    """One round: a group's members gather in its fullest shard that still has room."""
    used = {r["shard"]: r["count"] for r in members.groupBy("shard").count().collect()}
    room = {s: max(0, quota - used.get(s, 0)) for s in range(shards)}
    rooms = F.create_map(*[F.lit(x) for pair in room.items() for x in pair])
    count = scratch.save(votes(members), f"votes{step}")
    total = Window.partitionBy("link")
    # Shards without room can only be left; the target is the fullest one with room, or the fullest one as it is.
    open_ = F.try_element_at(rooms, "shard") > 0
    best = Window.partitionBy("link").orderBy(F.desc(open_), F.desc("here"), "shard")
    target = count.withColumn("size", F.sum("here").over(total)).withColumn("at", F.row_number().over(best)).filter("at = 1").select("link", F.col("shard").alias("target"), open_.alias("open"), "here", "size")
    # A split group without room in any of its shards goes as a whole to one of those that have room for all of it.
    order = sorted((s for s in room if room[s] > 0), key=lambda s: (-room[s], s))
    fits = sum((F.when(F.col("size") <= room[s], 1).otherwise(0) for s in order), F.lit(0))
    target = target.withColumn("fits", F.when(F.col("open") | (F.col("here") == F.col("size")), 0).otherwise(fits)).withColumn("whole", F.col("fits") > 0)
    other = F.try_element_at(F.array(*[F.lit(s) for s in order or [0]]), (F.pmod(F.xxhash64("link", F.lit(step)), F.greatest("fits", F.lit(1))) + 1).cast("int"))
    target = target.withColumn("target", F.when(F.col("whole"), other).otherwise(F.col("target")))
    # The move of a group's members from another shard gains if more of them are in the target than where they are;
    # of equals the smaller shard is the target, or the one that has room.
    tie = (F.col("here") == F.col("there")) & ((F.col("target") < F.col("shard")) | ~open_)
    wish = count.select("link", "shard", F.col("here").alias("there")).join(target, "link").filter(F.col("whole") | (F.col("open") & (F.col("shard") != F.col("target")) & ((F.col("here") > F.col("there")) | tie)))
    # Greatest gain first per member; the running demand of a target must fit in its room. The
    # groups are dealt into 64 gain classes, and within a class by hash into parts, so sums stay small.
    wish = wish.withColumn("rank", F.least(F.lit(63), F.floor(F.log2(F.when(F.col("whole"), F.col("size")).otherwise(F.col("here") + F.col("there")))).cast("int"))).withColumn("part", F.pmod(F.xxhash64("link"), F.lit(PARTS)).cast("int"))
    wish = scratch.save(wish, f"wish{step}")
    sums = wish.groupBy("target", "rank", "part").agg(F.sum("there").alias("need"))
    before = Window.partitionBy("target").orderBy(F.desc("rank"), "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("target", "rank", "part", F.coalesce(F.sum("need").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("target", "rank", "part").orderBy("link", "shard").rowsBetween(Window.unboundedPreceding, -1)
    go = wish.join(sums, ["target", "rank", "part"]).withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("there").over(within), F.lit(0)))
    left = F.try_element_at(rooms, "target") - F.col("ahead")
    # A whole group's wishes follow one another: its first one tells whether all of them fit.
    first = F.min("ahead").over(total) + F.col("size") <= F.try_element_at(rooms, "target")
    go = go.withColumn("take", F.when(F.col("whole"), F.when(first, F.col("there")).otherwise(0)).otherwise(F.least(F.col("there"), left))).filter("take > 0").select("link", "shard", "target", "take")
    ranked = numbered(members, ["link", "shard"], ["vertex"], "nth")
    return ranked.join(go, ["link", "shard"], "left").select("vertex", "spot", "link", F.when(F.col("nth") < F.col("take"), F.col("target")).otherwise(F.col("shard")).alias("shard"))


def assign(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, link, shard and slot of every row; row counts of shards differ by one at most.

    Where a row goes depends on the ids and texts in the table, not on its files;
    of repeated rows any may take either place. Null texts are linked with each
    other, not with empty ones. Repeated rows are rows of their own with equal texts. An empty table gives none. Only the
    row counts of the shards reach the driver.
    """
    scratch = Scratch(df.sparkSession, "sharding")
    text = F.col(text_col).cast("string")
    rows = df.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.when(text.isNull(), F.lit("null")).otherwise(F.md5(text.cast("binary"))).alias("link"),
    )
    # The last part of a vertex only tells repeated rows apart.
    vertex = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "link", F.monotonically_increasing_id().cast("string"))
    rows = scratch.save(rows.withColumn("vertex", vertex).withColumn("spot", F.xxhash64("doc_id", "link")), "rows")
    n = rows.count()
    groups = rows.groupBy("link").agg(F.count("*").alias("members")).filter("members > 1").select("link")
    start = F.pmod(F.xxhash64("spot"), F.lit(shards)).cast("int")
    members = scratch.save(rows.join(groups, "link").select("vertex", "spot", "link", start.alias("shard")), "round0")
    quota = n // shards
    together = lambda: votes(members).agg(F.sum(F.col("here") * F.col("here"))).first()[0]
    cut, now, step = None, together(), 0
    while now != cut:
        step, cut = step + 1, now
        members = scratch.save(moved(members, quota, shards, scratch, step), f"round{step}")
        scratch.drop(f"votes{step}", f"wish{step}", f"round{step - 1}")
        now = together()
    used = {r["shard"]: r["count"] for r in members.groupBy("shard").count().collect()}
    # Those beyond a quota (the start by hash is only even on average) leave their shard with the unlinked ones.
    want = {s: quota + (s < n % shards) for s in range(shards)}
    wanted = F.create_map(*[F.lit(x) for pair in want.items() for x in pair])
    if any(used.get(s, 0) > want[s] for s in want):
        keep = numbered(members, ["shard"], ["vertex"], "nth").filter(F.col("nth") < F.try_element_at(wanted, "shard")).select("vertex", "shard")
        keep = scratch.save(keep, "keep")
    else:
        keep = members.select("vertex", "shard")
    used = {r["shard"]: r["count"] for r in keep.groupBy("shard").count().collect()}
    ends, at = [], 0
    for s in range(shards):
        at += want[s] - used.get(s, 0)
        ends.append((at, s))
    free = numbered(rows.join(keep, "vertex", "left_anti").select("vertex", "spot", F.lit(0).alias("all")), ["all"], ["vertex"], "nth")
    deal = F.lit(shards - 1)
    for end, s in reversed(ends):
        deal = F.when(F.col("nth") < end, F.lit(s)).otherwise(deal)
    placed = keep.unionByName(free.select("vertex", deal.alias("shard")))
    return numbered(rows.join(placed, "vertex"), ["shard"], ["vertex"], "slot").select("doc_id", "size", "text_crc32", "link", "shard", "slot")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
