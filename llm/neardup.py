"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

A document's set holds the hashes of its distinct five-word shingles. Documents
with equal sets form a class, and one of each class goes on. MinHash values are
cut into bands; classes that agree in a band meet in a bucket. The MinHash values
are also folded into an odd sketch, a bitmap in which each value flips one bit:
the number of bits in which two sketches differ estimates high similarities
precisely, so pairs that are clearly too different are discarded before their
texts are read. What remains is confirmed on the full sets.

Only components are wanted, so no step writes out the pairs of a group. First
every class is held against one other, the smallest member of a bucket that it
meets most often. Classes that then share a component need nothing more, which is
how large groups of copies end. In buckets where several components remain, the
sketches are compared in tiles of bounded size, and the classes with a possible
partner in another component go on to an exact comparison of the same tiles,
which gives a spanning forest of the links, at most one per class and tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Scratch, claim, mapped, table, texts
from llm.fingerprint import mix, prefix_hashes, span_hashes

WORDS, BANDS, ROWS = 5, 48, 5
#: MinHash values folded into a sketch, and its bits.
SAMPLES, BITS = 720, 4096
#: A link needs 100 * |intersection| >= PERCENT * |union|.
PERCENT = 75
#: Pairs whose sketches put the similarity below this are discarded; over four standard errors below PERCENT, the bitmap's own collisions counted.
SKETCHED = 0.67
#: Members of a bucket's block, and bytes of their sets; two blocks are compared in one task.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Members of a star that are held against its centre in one group.
RAY = 1024
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_multipliers = (mix(np.arange(max(SAMPLES, BANDS * ROWS), dtype=np.uint64), 21) | np.uint64(1)).astype(np.uint64)


def shingles(texts_: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, ordered; fewer words than a shingle are one."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts_]
    # A space after each text ends its last word.
    data = _lower[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
    ends = np.cumsum([len(r) + 1 for r in raw])
    gap = _space[data]
    edge = np.diff(np.concatenate([[True], gap]).astype(np.int8))
    lo, hi = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = mix(span_hashes(prefix_hashes(data), lo, hi), 31) + mix((hi - lo).astype(np.uint64), 32)
    row = np.searchsorted(ends, lo, side="right")
    n = len(word)
    h = np.zeros(n, np.uint64)
    begin = np.searchsorted(row, row, side="left")
    count = np.searchsorted(row, row, side="right") - begin
    place = np.arange(n) - begin
    for k in range(words):
        at = np.arange(n) + k
        there = at < begin + count
        h = np.where(there, mix(h + word[np.minimum(at, n - 1)], 40 + k), h)
    keep = (place + words <= count) | ((count < words) & (place == 0))
    row, h = row[keep], h[keep]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
    return row[new], h[new]


def signatures(df: DataFrame, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """doc_id, digest and length of the text, n_shingles, two hashes of the whole set, the band keys and the odd sketch."""
    rows_of = df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("digest"), F.length("text").alias("length"))
    kind = df.schema["doc_id"].dataType.simpleString()

    def make(block: pa.Table) -> dict:
        n = block.num_rows
        row, h = shingles(block.column("text").to_pylist())
        size = np.bincount(row, minlength=n)
        some = np.nonzero(size)[0]
        start = np.concatenate([[0], np.cumsum(size[some])[:-1]]).astype(np.int64)
        a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        keys = np.zeros((n, bands), np.uint64)
        sketch = np.zeros((n, bits), np.uint8)
        if len(some):
            a[some], b[some] = np.add.reduceat(mix(h, 51), start), np.add.reduceat(mix(h, 52), start)
            least = np.empty((bands * rows, len(some)), np.uint64)
            flip = np.empty((SAMPLES, len(some)), np.int64)
            for k in range(len(_multipliers)):
                value = np.minimum.reduceat(h * _multipliers[k], start)
                if k < bands * rows:
                    least[k] = value
                if k < SAMPLES:
                    flip[k] = (mix(value, 60 + k) % np.uint64(bits)).astype(np.int64)
            for at in range(0, len(some), 256):
                part = flip[:, at : at + 256]
                cell = (part + np.arange(part.shape[1]) * bits).ravel()
                sketch[some[at : at + 256]] = (np.bincount(cell, minlength=part.shape[1] * bits) & 1).astype(np.uint8).reshape(-1, bits)
            for band in range(bands):
                key = np.full(len(some), band, np.uint64)
                for k in range(band * rows, (band + 1) * rows):
                    key = mix(key + least[k], 9)
                keys[some, band] = key
        signed = keys.view(np.int64)
        return {
            "doc_id": block.column("doc_id").combine_chunks(), "digest": block.column("digest").combine_chunks(), "length": block.column("length").combine_chunks(), "n_shingles": size.astype(np.int64), "set_a": a.view(np.int64), "set_b": b.view(np.int64),
            "bands": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(signed.ravel())), "sketch": pa.array([s.tobytes() for s in np.packbits(sketch, axis=1)], pa.binary()),
        }

    return mapped(rows_of, make, f"doc_id {kind}, digest long, length int, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary", most=1 << 20)


def differing_least(percent: float, values: int = SAMPLES, bits: int = BITS) -> int:
    """Most differing sketch bits expected at a similarity: flips fall on bits as balls in bins, in pairs they cancel."""
    flips = 2 * values * (1 - percent)
    return int(bits * (1 - (1 - 2 / bits) ** flips) / 2)


def sketched(pairs: DataFrame, heads: DataFrame, most: int) -> DataFrame:
    """Pairs (u, v) whose odd sketches differ in few enough bits."""
    one = heads.select(F.col("cls").alias("u"), F.col("sketch").alias("su"))
    two = heads.select(F.col("cls").alias("v"), F.col("sketch").alias("sv"))

    def near(batches):
        for b in batches:
            su, sv = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("su", "sv"))
            keep = np.bitwise_count(su ^ sv).sum(1) <= most
            yield b.select(["u", "v"]).filter(pa.array(keep))

    return pairs.join(one, "u").join(two, "v").select("u", "v", "su", "sv").mapInArrow(near, "u long, v long")


def by_group(batches, names: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each group of equal values in the columns `names`, by which they are sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in names])
        turn = [0, *(np.nonzero((key[:, 1:] != key[:, :-1]).any(0))[0] + 1), batch.num_rows]
        for lo, hi in zip(turn[:-1], turn[1:], strict=True):
            if held and last != tuple(key[:, lo]):
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(key[:, lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def tiled(rows: DataFrame, make: Callable[[pa.Table], dict | None], schema: str) -> DataFrame:
    """make() for the rows of each tile (key, i, j); a task holds one tile at a time."""

    def run(batches):
        claim(__name__)
        for tile in by_group(batches, ("key", "i", "j")):
            out = make(tile)
            if out is not None:
                yield pa.RecordBatch.from_pydict(out)

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def candidates(open_: DataFrame, heads: DataFrame, most: int) -> DataFrame:
    """(key, i, j, cls, comp): the classes of open buckets with a similar enough sketch in another component, by tile.

    A bucket's members are dealt by hash into blocks; every two blocks meet in
    one tile. A pair counts in the first band that it shares.
    """
    count = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / BLOCK_BYTES)).cast("int")
    dealt = open_.join(heads, "cls").withColumn("mine", F.pmod(F.xxhash64("cls"), count).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cls", "comp", "sketch", "bands", F.array_position("bands", F.col("key")).alias("band"))

    def compare(rows: pa.Table) -> dict | None:
        mine, cls, comp = (np.asarray(rows.column(c)) for c in ("mine", "cls", "comp"))
        i, j, key = (rows.column(c)[0].as_py() for c in ("i", "j", "key"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(cls), -1)
        band = rows.column("band")[0].as_py()
        bands = np.asarray(rows.column("bands").combine_chunks().flatten()).reshape(len(cls), -1)
        left, right = np.nonzero(mine == i)[0], np.nonzero(mine == j)[0]
        some = np.zeros(len(cls), bool)
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            differ = np.zeros((len(part), len(right)), np.int32)
            for word in range(sketch.shape[1]):
                differ += np.bitwise_count(sketch[part, word][:, None] ^ sketch[right, word][None])
            x, y = np.nonzero((differ <= most) & (comp[part][:, None] != comp[right][None]))
            x, y = part[x], right[y]
            for lo in range(0, len(x), 1 << 16):
                p, q = x[lo : lo + (1 << 16)], y[lo : lo + (1 << 16)]
                first = ~(bands[p, : band - 1] == bands[q, : band - 1]).any(1)
                some[p[first]] = some[q[first]] = True
        who = np.nonzero(some)[0]
        return {"key": np.full(len(who), key), "i": np.full(len(who), i, np.int32), "j": np.full(len(who), j, np.int32), "mine": mine[who], "cls": cls[who], "comp": comp[who]} if len(who) else None

    return tiled(dealt, compare, "key long, i int, j int, mine int, cls long, comp long")


def shingle_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """cls and set (the sorted hashes of its shingles) of the classes (cls, digest, length) wanted; repeated rows give one."""
    rows = docs.select("text", F.xxhash64("doc_id", "text").alias("digest"), F.length("text").alias("length"))
    rows = rows.join(wanted, ["digest", "length"]).groupBy("digest", "length", "cls").agg(F.min("text").alias("text"))

    def sets(block: pa.Table) -> dict:
        row, h = shingles(block.column("text").to_pylist())
        cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=block.num_rows))])
        return {"cls": block.column("cls").combine_chunks(), "set": pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())}

    return mapped(rows.select("cls", "text"), sets, "cls long, set binary")


def alike(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets of distinct values are similar enough, exactly."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    same = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * same >= percent * (len(x) + len(y) - same) > 0


def confirmed(stars: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough; every v has one u.

    A centre u goes once to each group of RAY of its members, so a star of any
    size is dealt out, and a task holds one centre's set and passes over the rest.
    """
    size = stars.groupBy("u").agg(F.ceil(F.count("*") / RAY).cast("int").alias("rays"))
    centres = size.withColumn("ray", F.explode(F.sequence(F.lit(0), F.col("rays") - 1))).select("u", "ray", F.lit(0).alias("is_ray"), F.col("u").alias("cls"))
    rays = stars.join(size, "u").select("u", F.pmod(F.xxhash64("v"), "rays").cast("int").alias("ray"), F.lit(1).alias("is_ray"), F.col("v").alias("cls"))
    rows = centres.unionByName(rays).join(sets, "cls")

    def exact(batches):
        here, centre = None, np.zeros(0, np.uint64)
        for b in batches:
            keep = []
            for u, ray, is_ray, raw in zip(*(b.column(c).to_pylist() for c in ("u", "ray", "is_ray", "set")), strict=True):
                if not is_ray:
                    here, centre = (u, ray), np.frombuffer(raw, np.uint64)
                keep.append(bool(is_ray) and here == (u, ray) and alike(centre, np.frombuffer(raw, np.uint64), percent))
            yield b.select(["u", "cls"]).rename_columns(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return rows.repartition("u", "ray").sortWithinPartitions("u", "ray", "is_ray").mapInArrow(exact, "u long, v long")


def forest(found: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) that join the components of each tile's classes as all of its links would, from the full sets."""

    def exact(rows: pa.Table) -> dict | None:
        mine, cls, comp = (np.asarray(rows.column(c)) for c in ("mine", "cls", "comp"))
        comp = np.unique(comp, return_inverse=True)[1]
        whole = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
        sets_ = [np.frombuffer(s, np.uint64) for s in rows.column("set").to_pylist()]
        size = np.array([len(s) for s in sets_], np.int64)
        start = np.cumsum(size) - size
        value = np.unique(np.concatenate(sets_), return_inverse=True)[1]
        mark = np.zeros(int(value.max()) + 1, np.uint8)
        u, v = [], []
        for k in range(len(cls)):
            other = (comp != comp[k]) & (100 * np.minimum(size, size[k]) >= percent * np.maximum(size, size[k]))
            if not whole:
                other &= mine != mine[k]
            if not other.any():
                continue
            mark[value[start[k] : start[k] + size[k]]] = 1
            same = np.add.reduceat(mark[value], start, dtype=np.int64)
            mark[value[start[k] : start[k] + size[k]]] = 0
            for m in np.nonzero(other & (100 * same >= percent * (size + size[k] - same)))[0]:
                if comp[m] != comp[k]:
                    u.append(min(cls[k], cls[m]))
                    v.append(max(cls[k], cls[m]))
                    comp[comp == comp[m]] = comp[k]
        return {"u": np.array(u, np.int64), "v": np.array(v, np.int64)} if u else None

    return tiled(found.join(sets, "cls"), exact, "u long, v long")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """vertex, comp (smallest vertex reachable) of the vertices of links (u, v): min labels with pointer jumping until none changes."""
    edges = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    edges = scratch.save(edges, f"{name}-edges")
    labels = scratch.save(edges.groupBy(F.col("u").alias("vertex")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), f"{name}-0")
    step, done = 0, False
    while not done:
        step += 1
        around = edges.join(labels.select(F.col("vertex").alias("v"), "comp"), "v").groupBy(F.col("u").alias("vertex")).agg(F.min("comp").alias("near"))
        lower = labels.join(around, "vertex").select("vertex", F.least("comp", "near").alias("next"), F.col("comp").alias("old"))
        # Pointer jumping: take the label of the label.
        jump = labels.select(F.col("vertex").alias("next"), F.col("comp").alias("far"))
        new = lower.join(jump, "next", "left").select("vertex", F.least("next", F.coalesce("far", "next")).alias("comp"), "old")
        new = scratch.save(new, f"{name}-{step}")
        done = new.filter(F.col("comp") != F.col("old")).isEmpty()
        scratch.drop(f"{name}-{step - 1}")
        labels = new.select("vertex", "comp")
    return labels


def placed_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest (of id and text), n_shingles, component_id and comp (the component's own key, null without shingles) of every row."""
    spark = df.sparkSession
    scratch = Scratch(spark, "neardup")
    docs = texts(df, id_col, text_col)
    sigs = signatures(docs).withColumn("row", F.monotonically_increasing_id())
    sigs = scratch.save(sigs, "signatures")
    same = ["n_shingles", "set_a", "set_b"]
    full = sigs.filter("n_shingles > 0")
    first = F.struct("row", "digest", "length")
    classes = full.groupBy(*same).agg(F.min(first).alias("first"), F.min("doc_id").alias("least"))
    classes = scratch.save(classes.select(*same, F.col("first.row").alias("cls"), "first.digest", "first.length", "least"), "classes")
    heads = full.select(F.col("row").alias("cls"), "bands", "sketch", "n_shingles").join(classes.select("cls"), "cls", "left_semi")
    buckets = heads.select(F.explode("bands").alias("key"), "cls", "n_shingles")
    shared = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("centre")).filter("n > 1").select("key", "centre")
    buckets = scratch.save(buckets.join(shared, "key"), "buckets")
    heads = scratch.save(heads.join(buckets.select("cls").distinct(), "cls", "left_semi").select("cls", "sketch", "bands"), "heads")
    most = differing_least(SKETCHED)
    met = buckets.filter("cls <> centre").groupBy("cls", "centre").agg(F.count("*").alias("times"))
    stars = met.groupBy("cls").agg(F.max(F.struct(F.col("times"), (-F.col("centre")).alias("u"))).alias("best"))
    stars = scratch.save(sketched(stars.select((-F.col("best.u")).alias("u"), F.col("cls").alias("v")), heads, most), "stars")
    reps = classes.select("cls", "digest", "length")
    sets = scratch.save(shingle_sets(reps.join(heads.select("cls"), "cls"), docs), "sets")
    links = scratch.save(confirmed(stars, sets), "links")
    label = components(links, scratch, "first")
    # What the stars leave apart: buckets in which more than one component remains.
    now = buckets.join(label, F.col("cls") == F.col("vertex"), "left").select("key", "cls", "n_shingles", F.coalesce("comp", "cls").alias("comp"))
    keys = now.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n"), (8 * F.sum("n_shingles")).alias("weight")).filter("a < b").select("key", "n", "weight")
    rest = scratch.save(now.drop("n_shingles").join(keys, "key"), "open")
    scratch.drop("buckets")
    found = scratch.save(candidates(rest, heads, most), "found")
    scratch.drop("open")
    more = scratch.save(forest(found, sets), "more")
    scratch.drop("found", "sets")
    if not more.isEmpty():
        label = components(links.unionByName(more), scratch, "second")
    placed = classes.join(label, F.col("cls") == F.col("vertex"), "left").withColumn("comp", F.coalesce("comp", "cls"))
    smallest = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    placed = scratch.save(placed.join(smallest, "comp").select(*same, "component_id", "comp"), "placed")
    out = sigs.select("doc_id", "digest", *same).join(placed, same, "left")
    linked = F.col("n_shingles") > 0
    return out.select("doc_id", "digest", "n_shingles", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linked, F.col("comp")).alias("comp"))



def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable over links) of every row.

    Null and empty texts have an empty set and are linked with nothing, so they
    are their own component. Rows are told apart by their sets: rows with one id
    and other texts are documents of their own, repeated rows get equal results.
    A null id is never the smallest; a component of such rows alone has a null id.
    Other columns are not read. An empty table gives none.
    """
    return placed_rows(df, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def representatives(df: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates: one with the group's smallest id, of several such texts the one with the least digest.

    Repeated rows are one document. Rows without id stay where no row of their
    group has one.
    """
    places = placed_rows(df, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Rows without shingles are groups of their own.
    keep = places.groupBy(F.coalesce("comp", "digest").alias("group"), F.col("comp").isNull().alias("alone")).agg(F.min("digest").alias("_digest")).select("_digest").distinct()
    rows = df.withColumn("_digest", F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return rows.join(keep, "_digest", "left_semi").dropDuplicates(["_digest"]).select(*columns)


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


__all__ = ["components", "near_duplicates", "op9_neardup", "representatives", "shingles"]
