"""Best-fit packing of documents into sequences by linear grouping.

Lengths above a limit are sorted and dealt into groups of equal cardinality;
within a group every length counts as the group's largest. With so few sizes,
configurations (which sizes share a sequence) are found by subset sums and each
is used as often as the supply allows. The actual documents then take their
slots, and the small lengths go best-fit into the room that is left.

All of this happens on the histogram of lengths, which has at most `capacity`
rows however large the corpus is. The outcome is a list of placements, runs of
equal lengths over consecutive sequences; the documents themselves are numbered
within their length by Spark and look their place up.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.bpe import default_path, loaded
from llm.common import Scratch, mapped, table, texts

CAPACITY, GROUPS, SMALL, SALTS = 2048, 128, 256, 256


def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count), longest first, dealt into groups of equal cardinality."""
    total = sum(counts.values())
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = -(-total // groups)
            take = min(left, room)
            out[-1].append((length, take))
            left -= take
            room -= take
    return out


def fullest(first: int, sizes: list[int], supply: list[int], capacity: int) -> dict[int, int]:
    """The configuration with size `first` that fills the capacity best: subset sums over the supply."""
    room = capacity - sizes[first]
    how: list[tuple[int, int] | None] = [None] * (room + 1)
    reach = [False] * (room + 1)
    reach[0] = True
    for g in range(len(sizes)):
        most = supply[g] - (g == first)
        if most <= 0 or sizes[g] > room:
            continue
        used = [0] * (room + 1)
        for s in range(sizes[g], room + 1):
            back = s - sizes[g]
            if not reach[s] and reach[back] and used[back] < most:
                reach[s], used[s], how[s] = True, used[back] + 1, (g, back)
        if reach[room]:
            break
    best = max(s for s in range(room + 1) if reach[s])
    out = {first: 1}
    while best:
        g, best = how[best]
        out[g] = out.get(g, 0) + 1
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[np.ndarray, int]:
    """Placements (length, first rank, count, first sequence, offset) and the number of sequences."""
    ranks: dict[int, int] = defaultdict(int)
    placed: list[tuple[int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs (first sequence, count)
    made = 0

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        placed.append((length, ranks[length], count, sequence, offset))
        ranks[length] += count

    left = {n: c for n, c in histogram.items() if n < capacity and c}
    if full := histogram.get(capacity, 0):
        place(capacity, full, 0, 0)
        made = full
    bins = grouped({n: c for n, c in left.items() if n > small}, groups)
    sizes, supply = [g[0][0] for g in bins], [sum(c for _, c in g) for g in bins]
    runs = [list(g) for g in bins]
    for first in range(len(bins)):
        while supply[first]:
            used = fullest(first, sizes, supply, capacity)
            times = min(supply[g] // m for g, m in used.items())
            slots = []
            for g, m in used.items():
                supply[g] -= m * times
                for _ in range(m):
                    slot, need = [], times
                    while need:
                        length, count = runs[g].pop(0)
                        take = min(need, count)
                        slot.append((length, take))
                        need -= take
                        if count > take:
                            runs[g].insert(0, (length, count - take))
                    slots.append(slot)
            at = 0
            while at < times:
                step = min(slot[0][1] for slot in slots)
                offset = 0
                for slot in slots:
                    length, count = slot[0]
                    place(length, step, made + at, offset)
                    offset += length
                    slot[0] = (length, count - step)
                    if count == step:
                        slot.pop(0)
                rooms[capacity - offset].append((made + at, step))
                at += step
            made += times
    open_rooms = sorted(rooms)
    for length in sorted((n for n in left if 0 < n <= small), reverse=True):
        need = left[length]
        while need:
            k = bisect.bisect_left(open_rooms, length)
            if k == len(open_rooms):
                count = min(need, -(-need // (capacity // length)))
                rooms[capacity].append((made, count))
                open_rooms.append(capacity)
                made += count
                continue
            room = open_rooms[k]
            sequence, count = rooms[room].pop()
            if not rooms[room]:
                open_rooms.pop(k)
            take = min(need, count)
            place(length, take, sequence, capacity - room)
            need -= take
            for size, run in ((room, (sequence + take, count - take)), (room - length, (sequence, take))):
                if run[1] and size:
                    if not rooms[size]:
                        bisect.insort(open_rooms, size)
                    rooms[size].append(run)
    return np.array(placed, np.int64).reshape(-1, 5), made


def pack(items: DataFrame, keys: list[str], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """Add sequence_id and offset to items (key columns and `length`, 1 to capacity).

    Only the histogram of lengths (at most `capacity` rows) reaches the driver.
    Items of a length are numbered in salted parts, so that a length that a
    third of all documents share is spread over many tasks. Repeated rows are
    items of their own. An empty table gives an empty result.
    """
    histogram = {r[0]: r[1] for r in items.groupBy("length").count().collect()}
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    placed, _ = plan(histogram, capacity, groups, small)
    order = np.lexsort((placed[:, 1], placed[:, 0]))
    placed = placed[order]
    starts = placed[:, 0] * (1 << 48) + placed[:, 1]
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy(*keys)
    ranked = salted.join(parts, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.row_number().over(within) - 1).drop("_salt", "_base")
    names = [c for c in items.columns]

    def look_up(batches):
        for b in batches:
            length, rank = (np.asarray(b.column(c)).astype(np.int64) for c in ("length", "_rank"))
            k = np.searchsorted(starts, length * (1 << 48) + rank, side="right") - 1
            cols = {c: b.column(c) for c in names}
            cols |= {"sequence_id": pa.array(placed[k, 3] + rank - placed[k, 1]), "offset": pa.array(placed[k, 4])}
            yield pa.RecordBatch.from_pydict(cols)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)
    return ranked.select(*names, "_rank").mapInArrow(look_up, f"{kinds}, sequence_id long, offset long")


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, null unless with_ids) and their CRC-32 for every document's pieces of at most `capacity` tokens.

    A document is its ids and the id `end`; a null or empty text is that one id.
    """

    def make(block: pa.Table) -> dict:
        packed = loaded(path)[1]
        out: dict[str, list] = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
        close = int(end).to_bytes(4, "little")
        for row, text in enumerate(block.column("text").to_pylist()):
            ids = packed.encode(text) + close
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for c, v in zip(out, (row, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                    out[c].append(v)
        return {
            "doc_id": block.column("doc_id").combine_chunks().take(pa.array(out["row"], pa.int64())), "piece": pa.array(out["piece"], pa.int32()),
            "start": pa.array(out["start"], pa.int64()), "length": pa.array(out["length"], pa.int64()), "ids_crc32": pa.array(out["ids_crc32"], pa.int64()), "ids": pa.array(out["ids"], pa.binary()),
        }

    kind = df.schema[id_col].dataType.simpleString()
    return mapped(texts(df, id_col, text_col), make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary", most=1 << 20)


def packed_documents(df: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and place; ids as their CRC-32.

    The pieces' lengths and checksums are written once to the shared folder, so
    that texts are tokenised a single time; the texts aren't shuffled.
    """
    scratch = Scratch(df.sparkSession, "packing")
    items = pieces(df, path, capacity, with_ids=False).drop("ids")
    return pack(scratch.save(items, "pieces"), ["doc_id", "piece"], capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), default_path())


__all__ = ["op4_packing", "pack", "packed_documents", "pieces", "plan"]
