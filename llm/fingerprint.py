"""Document fingerprints as invertible Bloom lookup sketches.

A text is a multiset of paragraph digests: a paragraph is a line, and a longer
line is cut at content-defined points, some 48 bytes apart, so that an edit
changes few digests and every part of a text weighs the same. Each digest is added to three cells (count, XOR of
digests, XOR of check digests). Subtracting two sketches leaves only what
differs, and peeling cells that hold a single digest recovers it: which
paragraphs each version has and the other lacks. If peeling gets stuck, both
texts are sketched anew with four times the cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import blocks, claim, keeps, table, whole_ids

CELLS, HASHES = 48, 3
#: A piece ends where a hash of the last 8 bytes falls on 1 in PIECE.
PIECE = 48
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}
keeps(_powers.clear, "llm.fingerprint", "llm.suffixes", "llm.neardup")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and their inverses, at least n of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        base, inverse = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 2**64)
        for name, b in (("up", base), ("down", inverse)):
            p = np.empty(size, np.uint64)
            p[0] = 1
            p[1:] = np.uint64(b)
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = polynomial hash of bytes i to j - 1, times base^i (modulo 2^64)."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return (prefix[hi] - prefix[lo]) * down[lo]


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, digest) of all pieces of the texts; a repeated piece of a text gets a digest per repetition."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lens = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum(lens)
    rows, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    if len(data):
        prefix = prefix_hashes(data)
        # A piece ends after a line break, or where a hash of the last 8 bytes falls on 1 in PIECE.
        cut = data == 10
        if len(data) > 8:
            at = np.arange(len(data) - 7)
            cut[7:] |= mix(span_hashes(prefix, at, at + 8)) < np.uint64(2**64 // PIECE)
            # ... but not where those 8 bytes reach back into the text before.
            near = (ends - lens)[:, None] + np.arange(7)
            near = near[near < ends[:, None]]
            cut[near] = data[near] == 10
        hi = np.union1d(np.nonzero(cut)[0] + 1, ends[lens > 0])
        lo = np.concatenate([[0], hi[:-1]])
        rows.append(np.searchsorted(ends, lo, side="right"))
        values.append(mix(span_hashes(prefix, lo, hi) + (hi - lo).astype(np.uint64) * _A, 1))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    nth = (np.arange(len(row)) - first).astype(np.uint64)
    return row, mix(value + nth * _A, 2)


def cell_of(value: np.ndarray, which: int, cells: int) -> np.ndarray:
    """The cell in the which-th third of a sketch."""
    part = cells // HASHES
    return (mix(value, 3 + which) % np.uint64(part)).astype(np.int64) + which * part


def check(value: np.ndarray) -> np.ndarray:
    return mix(value, 11)


def sketch(row: np.ndarray, value: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest XORs and check XORs of n sketches, flat."""
    size = n * cells
    count, keys, checks = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    proof = check(value)
    for which in range(HASHES):
        at = row * cells + cell_of(value, which, cells)
        count += np.bincount(at, minlength=size)
        if len(at):
            order = np.argsort(at, kind="stable")
            cell = at[order]
            start = np.nonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))[0]
            keys[cell[start]] ^= np.bitwise_xor.reduceat(value[order], start)
            checks[cell[start]] ^= np.bitwise_xor.reduceat(proof[order], start)
    return count, keys, checks


def peel(count: np.ndarray, keys: np.ndarray, checks: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, digests and signs recovered from n differences, and which of them came out whole."""
    count, keys, checks = count.copy(), keys.copy(), checks.copy()
    rows, found, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    live = np.arange(len(count))
    for _ in range(4 * cells + 8):
        pure = live[(np.abs(count[live]) == 1)]
        pure = pure[check(keys[pure]) == checks[pure]]
        if not len(pure):
            break
        row, value, sign = pure // cells, keys[pure], count[pure]
        _, one = np.unique(np.stack([row.astype(np.uint64), value]), axis=1, return_index=True)
        row, value, sign = row[one], value[one], sign[one]
        proof = check(value)
        touched = []
        for which in range(HASHES):
            at = row * cells + cell_of(value, which, cells)
            np.subtract.at(count, at, sign)
            np.bitwise_xor.at(keys, at, value)
            np.bitwise_xor.at(checks, at, proof)
            touched.append(at)
        rows.append(row)
        found.append(value)
        signs.append(sign)
        live = np.unique(np.concatenate(touched))
    left = (count != 0) | (keys != 0) | (checks != 0)
    whole = ~left.reshape(n, cells).any(1)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(signs), whole


def compare(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For n pairs of digest multisets: digests only in a, only in b, and the cells that it took.

    Starts from `cells` and goes on with four times as many for the pairs whose
    difference did not peel, until every pair is done.
    """
    only_a, only_b, took = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    todo = np.arange(n)
    while len(todo):
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        parts = []
        for row, value in (a, b):
            keep = place[row] >= 0
            parts.append(sketch(place[row[keep]], value[keep], len(todo), cells))
        (ca, ka, xa), (cb, kb, xb) = parts
        rows, _, signs, whole = peel(ca - cb, ka ^ kb, xa ^ xb, len(todo), cells)
        plus = np.bincount(rows[signs > 0], minlength=len(todo))
        minus = np.bincount(rows[signs < 0], minlength=len(todo))
        done = todo[whole]
        only_a[done], only_b[done], took[done] = plus[whole], minus[whole], cells
        todo = todo[~whole]
        cells *= 4
    return only_a, only_b, took


def serialised(count: np.ndarray, keys: np.ndarray, checks: np.ndarray, n: int, cells: int) -> list[str]:
    """One hexadecimal string per sketch: cells, then count, digest and 32 bits of check of each."""
    packed = np.empty((n, cells), np.dtype([("count", "<u4"), ("key", "<u8"), ("check", "<u4")]))
    packed["count"], packed["key"], packed["check"] = count.reshape(n, cells), keys.reshape(n, cells), (checks & np.uint64(0xFFFFFFFF)).reshape(n, cells)
    return [f"iblt{cells}:" + p.tobytes().hex() for p in packed]


def likeness(size_a: np.ndarray, size_b: np.ndarray, only_a: np.ndarray, only_b: np.ndarray) -> np.ndarray:
    """Share of all pieces of both texts that are in both; 1 for two empty texts."""
    total = size_a + size_b
    return np.where(total > 0, 1 - (only_a + only_b) / np.maximum(total, 1), 1.0)


def fingerprints(texts: list[str], cells: int = CELLS) -> list[str]:
    row, value = digests(texts)
    return serialised(*sketch(row, value, len(texts), cells), len(texts), cells)


def edited(text: str, following: str) -> str:
    """The last quarter replaced by the beginning of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def successive(df: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """bucket, doc_id, text and whether the row only looks ahead: rows in ranges of the id.

    Every range also gets the first row of the next one (the last range that of
    the first), so a sorted pass over it knows each row's successor. Range bounds
    are quantiles; only they and the first ids of the ranges reach the driver.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter(F.col("doc_id").isNotNull())
    ids = rows.select(F.col("doc_id").cast("long").alias("i"))
    cuts = sorted({int(c) for c in ids.approxQuantile("i", [k / buckets for k in range(1, buckets)], 0.25 / buckets)}) if buckets > 1 else []
    bucket = lambda c: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= c)) if cuts else F.lit(0)
    heads = ids.groupBy(bucket(F.col("i").cast("long")).alias("bucket")).agg(F.min("i").alias("i")).orderBy("bucket").collect()
    own = rows.withColumn("bucket", bucket(F.col("doc_id").cast("long"))).withColumn("ahead", F.lit(False))
    if not heads:
        return own
    before = {h["i"]: heads[k - 1]["bucket"] for k, h in enumerate(heads)}
    place = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    # Repeated rows: of several with the first id, the one with the least text comes first.
    first = rows.filter(F.col("doc_id").cast("long").isin(list(before))).groupBy("doc_id").agg(F.min("text").alias("text"))
    ahead = first.withColumn("bucket", F.try_element_at(place, F.col("doc_id").cast("long"))).withColumn("ahead", F.lit(True))
    return own.unionByName(ahead)


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """Every row's text and edited text with their fingerprints and likenesses.

    Columns: doc_id, n_chars, edited_text, fingerprint, edited_fingerprint,
    near_edited, near_next, cells_edited (the cells with which the difference
    peeled). Ids are whole numbers. Null texts count as empty; rows without id have no order and are
    left out; repeated ids follow one another by text; a single row is its own
    successor; an empty table gives none.
    """
    whole_ids(df, id_col)
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = successive(df, id_col, text_col, 2 * parts).repartition(parts, "bucket").sortWithinPartitions("bucket", "ahead", "doc_id", "text")

    def run(batches):
        claim(__name__)
        held = None
        for block in blocks(batches, "text", 2 << 20):
            if held is not None:
                block = pa.concat_tables([held, block])
            bucket, ahead = block.column("bucket").to_pylist(), block.column("ahead").to_pylist()
            n = block.num_rows
            now = [k for k in range(n - 1) if not ahead[k] and bucket[k] == bucket[k + 1]]
            held = block.slice(n - 1, 1)
            if now:
                yield rows_of(block, now)

    def rows_of(block: pa.Table, now: list[int]) -> pa.RecordBatch:
        texts = block.column("text").to_pylist()
        olds, nexts = [texts[k] for k in now], [texts[k + 1] for k in now]
        news = [edited(a, b) for a, b in zip(olds, nexts, strict=True)]
        n = len(now)
        old, new, following = digests(olds), digests(news), digests(nexts)
        size = [np.bincount(r, minlength=n) for r, _ in (old, new, following)]
        gone, come, took = compare(old, new, n, cells)
        gone2, come2, _ = compare(old, following, n, cells)
        return pa.RecordBatch.from_pydict({
            "doc_id": block.column("doc_id").combine_chunks().take(pa.array(now)), "n_chars": pa.array([len(t) for t in olds], pa.int64()), "edited_text": news,
            "fingerprint": serialised(*sketch(*old, n, cells), n, cells), "edited_fingerprint": serialised(*sketch(*new, n, cells), n, cells),
            "near_edited": likeness(size[0], size[1], gone, come), "near_next": likeness(size[0], size[2], gone2, come2), "cells_edited": took,
        })

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, cells_edited long")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_edits(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "cells_edited")
