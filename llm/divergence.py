"""How far the sources of a language differ in their words, by systolic rotation.

Every group (language, source) has a vector of word counts. The terms of a
language are dealt into slices and its groups into blocks; a cell (language,
slice, block) holds the packed vectors of a few groups over a few terms. Cells
stay where they are, in partitions that are kept over all rounds. In round r the
packed vectors of block b visit block (r - b) mod K, so that in K rounds every two
blocks meet once; one meeting gives the value for both directions. Only the
visitors are shuffled. Sums over slices make the value of a pair. The terms that
tell a group from its language are ranked by a heap in each slice, and the
slices' heaps are merged.

No task holds more than two cells: GROUPS vectors over about TERMS terms each.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import Scratch, blocks, claim, table

#: A term is kept from this many documents of its language on; so many terms of a group are ranked.
LEAST, TOP = 10, 10
SCALE, SMOOTH = 1_000_000_000, 2
#: Terms of a slice and groups of a block, on average; counts a task holds before it hands them on; bytes of text cut into words at once.
TERMS, GROUPS, HELD, PIECE = 16_384, 8, 250_000, 1 << 20

#: Letters A to Z in lower case, other letters and bytes beyond ASCII as they are, all else a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def pieces(text: bytes) -> list[bytes]:
    """The folded text, cut at spaces into pieces of about PIECE bytes."""
    out, at = [], 0
    while len(text) - at > PIECE:
        end = text.find(b" ", at + PIECE)
        if end < 0:
            break
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def counted(batches):
    """Rows lang, source, term, n, docs of what a task has seen so far; term '' stands for the group itself, with its documents."""
    claim(__name__)
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0

    def rows():
        for (lang, source), (n, docs) in held.items():
            terms = [b"", *n]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(terms), pa.string()), "source": pa.array([source] * len(terms), pa.string()), "term": pa.array(terms, pa.binary()).cast(pa.string()),
                "n": pa.array([0, *n.values()], pa.int64()), "docs": pa.array([docs[t] for t in terms], pa.int64()),
            })

    for block in blocks(batches, "text", 1 << 20):
        for lang, source, text in zip(*(block.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen, before = {b""}, len(n)
            for piece in pieces(text.translate(FOLD)):
                words = piece.split()
                n.update(words)
                seen.update(words)
            docs.update(seen)
            entries += 1 + len(n) - before
            if entries >= HELD:
                yield from rows()
                held, entries = {}, 0
    yield from rows()


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), digit by digit so that no product leaves 64 bits."""
    left, out = counts.astype(np.int64) + SMOOTH, 0
    divisor = np.int64(total + SMOOTH * kept)
    whole, left = np.divmod(left, divisor)
    out = whole
    for _ in range(3):
        digit, left = np.divmod(left * 1000, divisor)
        out = out * 1000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def packed(numbers: np.ndarray, counts: np.ndarray) -> bytes:
    """A sparse vector as steps between term numbers and counts, compressed."""
    order = np.argsort(numbers)
    steps = np.diff(numbers[order], prepend=0).astype("<u4")
    return zstandard.compress(steps.tobytes() + counts[order].astype("<i8").tobytes())


def unpacked(data: bytes | None, width: int) -> np.ndarray:
    out = np.zeros(width, np.int64)
    if data:
        raw = zstandard.decompress(data)
        n = len(raw) // 12
        out[np.cumsum(np.frombuffer(raw, "<u4", n))] = np.frombuffer(raw, "<i8", n, n * 4)
    return out


def vector(rows: pa.Table) -> pa.Table:
    """One group in one slice: its packed vector, and a heap of the terms that it has more of than its language."""
    one = {c: rows.column(c)[0].as_py() for c in ("lang", "slice", "source", "total", "lang_total", "kept")}
    numbers, n, lang_n = (rows.column(c).to_numpy() for c in ("number", "n", "lang_n"))
    p, q = shares(n, one["total"], one["kept"]), shares(lang_n, one["lang_total"], one["kept"])
    more = np.flatnonzero(p > q)
    terms, value = rows.column("term").take(pa.array(more)).cast(pa.binary()).to_pylist(), apart(p[more], q[more]).tolist()
    best = heapq.nsmallest(TOP, zip((-v for v in value), terms, strict=True))
    return pa.table({
        "lang": pa.array([one["lang"]], pa.string()), "slice": pa.array([one["slice"]], pa.int32()), "source": pa.array([one["source"]], pa.string()), "packed": pa.array([packed(numbers, n)], pa.binary()),
        "terms": pa.array([[t.decode() for _, t in best]], pa.list_(pa.string())), "values": pa.array([[-v for v, _ in best]], pa.list_(pa.int64())),
    })


def meeting(home: pa.Table, guests: pa.Table) -> pa.Table:
    """Every pair of a resident group and a visiting one in one slice, in both directions."""
    out = {"lang": [], "source": [], "item": [], "value": []}
    if len(home) and len(guests):
        dense = lambda r: shares(unpacked(r["packed"], r["width"]), r["total"], r["kept"]) if r["width"] else np.zeros(0, np.int64)
        homes = [(r["source"], dense(r)) for r in home.to_pylist()]
        same = guests.column("block")[0].as_py() == home.column("block")[0].as_py()
        for g in guests.to_pylist():
            q = dense(g)
            for source, p in homes:
                if source < g["source"] or (source != g["source"] and not same):
                    value = int(apart(p, q).sum())
                    for a, b in ((source, g["source"]), (g["source"], source)):
                        for name, x in zip(out, (g["lang"], a, b, value), strict=True):
                            out[name].append(x)
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})


def rotated(cells: DataFrame, rounds: int, scratch: Scratch) -> DataFrame:
    """lang, source, item and value in each slice, after all blocks have met; a round's rows are written before the next begins."""
    keys = ["lang", "slice", "block"]
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    home = cells.repartition(parts, *keys).persist(StorageLevel.DISK_ONLY)
    try:
        for r in range(rounds):
            there = F.pmod(F.lit(r) - F.col("block"), F.col("blocks"))
            ahead = F.pmod(F.col("place") - F.col("block"), F.col("blocks"))
            # Of two blocks that swap places only one goes: the one whose way is shorter, the smaller one where both ways are equal.
            goes = (2 * ahead < F.col("blocks")) | ((2 * ahead == F.col("blocks")) & (F.col("block") < F.col("place")))
            guests = cells.filter(F.col("blocks") > r).withColumn("place", there).filter(goes)
            met = home.groupBy(*keys).cogroup(guests.groupBy("lang", "slice", "place")).applyInArrow(meeting, "lang string, source string, item string, value bigint")
            scratch.save(met, f"meetings/round={r}")
    finally:
        home.unpersist()
    return scratch.read("meetings").drop("round")


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank of all pairs of sources of a language and of the terms that stand out in a group.

    A null text, language or source is the empty one. A group without kept terms
    has pairs (of value 0 where its language keeps no term) and no terms; a language
    with one source has no pairs, an empty table no rows. Repeated rows are
    documents of their own. Equal values rank by the UTF-8 of their item.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "divergence")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    seen = docs.mapInArrow(counted, "lang string, source string, term string, n bigint, docs bigint")
    counts = scratch.save(seen.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    words = counts.filter("term <> ''")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= LEAST).drop("docs")
    kept = scratch.save(kept, "kept")
    all_kept = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = counts.filter("term = ''").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / GROUPS).cast("int").alias("blocks")).join(all_kept, "lang", "left").fillna(0)
    langs = scratch.save(langs.withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS)).cast("int")), "langs")
    # The terms of a slice are numbered in it; a slice holds about TERMS of them.
    slice_ = F.pmod(F.xxhash64("term"), F.col("slices")).cast("int")
    terms = kept.join(langs.select("lang", "slices"), "lang").select("lang", "term", "lang_n", slice_.alias("slice"))
    terms = scratch.save(terms.withColumn("number", F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1), "terms")
    used = scratch.save(words.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "used")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(langs, "lang").join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    groups = scratch.save(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")), "groups")
    vectors = used.join(groups.select("lang", "source", "total", "lang_total", "kept"), ["lang", "source"]).groupBy("lang", "slice", "source")
    vectors = scratch.save(vectors.applyInArrow(vector, "lang string, slice int, source string, packed binary, terms array<string>, values array<bigint>"), "vectors")
    widths = terms.groupBy("lang", "slice").agg(F.count("*").alias("width"))
    cells = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).join(widths, ["lang", "slice"], "left").join(vectors.drop("terms", "values"), ["lang", "slice", "source"], "left")
    cells = scratch.save(cells.select("lang", "slice", "block", "blocks", "source", "total", "kept", F.coalesce("width", F.lit(0)).alias("width"), "packed"), "cells")
    rounds = langs.agg(F.max("blocks")).first()[0] or 0
    columns = ["lang", "source", "part", "item", "value", "rank"]
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    pairs = rotated(cells, rounds, scratch) if rounds else spark.createDataFrame([], "lang string, source string, item string, value bigint")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair")).withColumn("rank", rank)
    heaps = vectors.select("lang", "source", F.explode(F.arrays_zip("terms", "values")).alias("t")).select("lang", "source", F.col("t.terms").alias("item"), F.col("t.values").alias("value"))
    heaps = heaps.withColumn("part", F.lit("term")).withColumn("rank", rank).filter(F.col("rank") <= TOP)
    return pairs.select(*columns).unionByName(heaps.select(*columns))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
