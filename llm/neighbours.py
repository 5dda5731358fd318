"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner products become least distances: vectors get one more component
that lifts them all to the largest norm, queries are scaled to it. Each of the
tables hashes a vector by floor((a.x + b) / w) for a few Gaussian directions a.
A query visits its own bucket and the buckets next to it, in the order in which
they are estimated to hold neighbours: by the summed squares of its distances to
the borders that a perturbation crosses. Candidates of all tables are merged and
ranked by their exact inner products.

How many functions, tables and probes that takes depends on the vectors. It is
measured: the true neighbours of some queries are found over the whole table, and
of the layouts that reach enough of them the cheapest is taken; if there is none,
a table without functions, which is one bucket and reaches all. Queries with too few candidates are
compared with every point.

Equal vectors are one point of the index, so a vector that a third of all rows
share costs no more than any other.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import Scratch, blocks, table
from llm.fingerprint import mix

TABLES, PROBES, WIDTH, NEAREST = 12, 48, 2.1, 20
#: Least share of the true neighbours that the layout reaches on the sampled queries; a margin over the 0.9 that is promised.
RECALL = 0.95
#: Queries whose true neighbours are found to choose the layout, and points by which the sizes of buckets are judged.
JUDGED, WEIGHED = 64, 1_000
#: What a row that is dealt to a bucket costs against a pair that is scored.
ROW_COST = 200
#: Points of a bucket that one task holds; larger buckets are dealt out over several.
TOGETHER = 4_000
#: Positions in the order of border distances that perturbations use, and how many borders one crosses at most.
BORDERS, CROSSED = 12, 4


def most_functions(points: int) -> int:
    return max(2, int(round((np.log2(max(points, 2)) - 5.7) / np.log2(2.35))))


@dataclass
class Index:
    directions: np.ndarray  # tables x functions x dimensions
    offsets: np.ndarray
    width: float
    norm: float
    probes: int
    sets: np.ndarray  # perturbations as padded positions in the order of border distances

    @staticmethod
    def make(points: int, dims: int, norm: float, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, seed: int = 1, functions: int | None = None) -> Index:
        """Unless told otherwise, more points, more functions a table: the mean bucket keeps its size at every scale."""
        if functions is None:
            functions = most_functions(points)
        rng = np.random.default_rng(seed)
        directions = rng.standard_normal((tables, functions, dims + 1))
        borders = min(BORDERS, 2 * functions)
        sets = [s for k in range(CROSSED + 1) for s in itertools.combinations(range(borders), k) if sum(s) <= 3 * borders]
        padded = np.full((len(sets), CROSSED), 2 * functions)
        for i, s in enumerate(sets):
            padded[i, : len(s)] = s
        w = width * norm
        return Index(directions, rng.uniform(0, w, (tables, functions)), w, norm, min(probes, len(sets)), padded)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))[:, None]])

    def keys(self, t: int, slots: np.ndarray) -> np.ndarray:
        h = np.full(slots.shape[:-1], t, np.uint64)
        for k in range(slots.shape[-1]):
            h = mix(h + slots[..., k].astype(np.int64).view(np.uint64), 13)
        return h.view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table."""
        x = self.lifted(x)
        return np.stack([self.keys(t, np.floor((x @ a.T + b) / self.width)) for t, (a, b) in enumerate(zip(self.directions, self.offsets, strict=True))], 1)

    def visits(self, q: np.ndarray) -> np.ndarray:
        """Buckets to visit for each query, table by table, the likeliest first."""
        if not self.directions.shape[1]:
            return np.stack([self.keys(t, np.zeros((len(q), 0))) for t in range(len(self.directions))], 1)
        q = np.hstack([q * (self.norm / np.linalg.norm(q, axis=1))[:, None], np.zeros((len(q), 1))])
        out = []
        for t, (a, b) in enumerate(zip(self.directions, self.offsets, strict=True)):
            f = (q @ a.T + b) / self.width
            slots = np.floor(f)
            m = slots.shape[1]
            border = np.hstack([f - slots, slots + 1 - f])  # to the slot below, to the slot above
            order = np.argsort(border, axis=1)
            cost = np.hstack([np.take_along_axis(border, order, 1) ** 2, np.zeros((len(q), 1))])
            score = cost[:, self.sets].sum(2)
            which = np.hstack([order % m, np.full((len(q), 1), -1)])[:, self.sets]
            for i, j in itertools.combinations(range(CROSSED), 2):
                score[(which[..., i] == which[..., j]) & (which[..., i] >= 0)] = np.inf
            best = np.argsort(score, axis=1, kind="stable")[:, : self.probes]
            shift = np.zeros((len(q), self.probes, m + 1))
            side = np.hstack([np.where(order < m, -1.0, 1.0), np.zeros((len(q), 1))])[:, self.sets]
            rows = np.arange(len(q))[:, None]
            for i in range(CROSSED):
                w = which[rows, best, i]
                np.add.at(shift, (rows, np.arange(self.probes)[None], np.where(w < 0, m, w)), side[rows, best, i])
            out.append(self.keys(t, slots[:, None] + shift[..., :m]))
        return np.stack(out, 1).reshape(len(q), -1)


def layout(q: np.ndarray, near: np.ndarray, some: np.ndarray, points: int, asked: int, norm: float, tables: int, probes: int, width: float) -> tuple[Index, float]:
    """The given layout if it reaches RECALL, else the cheapest that does, of the true neighbours `near` (queries x neighbours x dimensions) of q, and what it reaches.

    Tables and probes begin at the given numbers and grow, functions go down; where nothing else reaches it, to none: one bucket.
    """
    dims = q.shape[1]
    chosen = Index.make(points, dims, norm, 1, 1, width, functions=0)
    least, reached = np.inf, 1.0
    for functions in range(most_functions(points), 0, -1):
        wide = Index.make(points, dims, norm, 2 * tables, 1 << 20, width, functions=functions)
        visits = wide.visits(q).reshape(len(q), 2 * tables, -1)
        most = visits.shape[2]
        at = lambda keys: np.stack([[places(visits[i, t], keys[i, :, t]) for t in range(2 * tables)] for i in range(len(q))])  # noqa: B023, E731
        hits = at(wide.buckets(near.reshape(-1, dims)).reshape(*near.shape[:2], -1))
        loads = at(np.broadcast_to(wide.buckets(some), (len(q), len(some), 2 * tables)))
        for t in (tables, 2 * tables):
            tries = [min(probes << k, most) for k in range(20) if k == 0 or probes << (k - 1) < most]
            for n in tries:
                recall = (hits[:, :t] < n).any(1).mean()
                pairs = asked * points * (loads[:, :t] < n).sum() / (len(q) * len(some))
                cost = pairs + ROW_COST * t * (points + asked * n)
                if recall >= RECALL and cost < least:
                    chosen = Index(wide.directions[:t], wide.offsets[:t], wide.width, norm, n, wide.sets)
                    least, reached = cost, float(recall)
                    if functions == most_functions(points) and t == tables and n == tries[0]:
                        return chosen, reached
    return chosen, reached


def places(visited: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands among the visited ones; beyond all if it is not there."""
    order = np.argsort(visited, kind="stable")
    pos = order[np.minimum(np.searchsorted(visited[order], keys), len(order) - 1)]
    return np.where(visited[pos] == keys, pos, 1 << 30)


def truth(points: DataFrame, q: np.ndarray, most: int) -> np.ndarray:
    """The vectors of the `most` points nearest to each q, over the whole table, as queries x most x dimensions."""

    def run(batches):
        score, near = np.zeros((len(q), 0)), np.zeros((len(q), 0, q.shape[1]))
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                x = np.asarray(part.column("vector").flatten()).reshape(part.num_rows, -1).astype(np.float64)
                new = q @ x.T
                top = np.argsort(-new, axis=1)[:, :most]
                score, near = np.hstack([score, np.take_along_axis(new, top, 1)]), np.concatenate([near, x[top]], 1)
                top = np.argsort(-score, axis=1)[:, :most]
                score, near = np.take_along_axis(score, top, 1), np.take_along_axis(near, top[..., None], 1)
        n = score.shape[1]
        if n:
            yield pa.RecordBatch.from_pydict({"q": np.repeat(np.arange(len(q)), n), "score": score.ravel(), "x": pa.array([v.tobytes() for v in near.reshape(-1, q.shape[1])], pa.binary())})

    rows = points.select("vector").mapInArrow(run, "q long, score double, x binary")
    by = Window.partitionBy("q").orderBy(F.desc("score"))
    got = rows.withColumn("at", F.row_number().over(by)).filter(F.col("at") <= most).orderBy("q", "at").collect()
    return np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float64).reshape(len(q), -1, q.shape[1])


def best(q: np.ndarray, v: np.ndarray, s: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `most` best different v of each q."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    order = np.lexsort((-s, v, q))
    new = np.concatenate([[True], (q[order][1:] != q[order][:-1]) | (v[order][1:] != v[order][:-1])]) if len(q) else np.zeros(0, bool)
    keep = np.sort(order[new])
    q, v, s = q[keep], v[keep], s[keep]
    first = np.searchsorted(q, q, side="left")
    top = np.arange(len(q)) - first < most
    return q[top], v[top], s[top]


def ranked(rows: DataFrame, kind: str, most: int) -> DataFrame:
    """Per task, the best points (q, v, score) of each query: rows come sorted by bucket, points before queries."""

    def run(batches):
        held_key, ids, points = None, np.zeros(0, np.int64), None
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0
        for block in blocks(batches, "vector", 8 << 20):
            key, salt, is_query, ident = (np.asarray(block.column(c)).astype(np.int64) for c in ("key", "salt", "is_query", "id"))
            vector = np.frombuffer(b"".join(block.column("vector").to_pylist()), kind).reshape(len(key), -1).astype(np.float64)
            turn = np.nonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))[0] + 1
            for lo, hi in zip([0, *turn], [*turn, len(key)], strict=True):
                here = (key[lo], salt[lo])
                middle = lo + int(np.searchsorted(is_query[lo:hi], 1))
                if here != held_key:
                    held_key, ids, points = here, ident[lo:middle], vector[lo:middle]
                elif middle > lo:
                    ids, points = np.concatenate([ids, ident[lo:middle]]), np.concatenate([points, vector[lo:middle]])
                if middle == hi or not len(ids):
                    continue
                for at in range(middle, hi, 512):
                    to = min(hi, at + 512)
                    score = vector[at:to] @ points.T
                    k = min(most, len(ids))
                    top = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < len(ids) else np.broadcast_to(np.arange(k), score.shape)
                    # Points that tie with the last one are kept, so that the smaller id can win.
                    last = np.take_along_axis(score, top, 1).min(1)
                    i, j = np.nonzero(score >= last[:, None])
                    got.append((ident[at:to][i], ids[j], score[i, j]))
                    waiting += len(i)
                if waiting > 1_000_000:
                    got = [best(*(np.concatenate(x) for x in zip(*got, strict=True)), most)]
                    waiting = len(got[0][0])
                    if waiting > 600_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in got[0]], ["q", "v", "score"])
                        got, waiting = [], 0
        if got:
            out = best(*(np.concatenate(x) for x in zip(*got, strict=True)), most)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["q", "v", "score"])

    return rows.mapInArrow(run, "q long, v long, score double")


def packed(points: DataFrame, kind: str) -> DataFrame:
    """id and vector (its bytes) of points."""

    def run(batches):
        for b in batches:
            raw = np.asarray(b.column("vector").flatten()).astype(kind).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1), kind)
            yield pa.RecordBatch.from_pydict({"id": b.column("point"), "vector": pa.array([x.tobytes() for x in raw], pa.binary())})

    return points.select("point", "vector").mapInArrow(run, "id long, vector binary")


def search(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH) -> DataFrame:
    """query_id, rank, vec_id and score: the nearest rows found for the ids in `queries` (column query_id).

    Vectors that are null, zero, of another length than most, or that hold null
    or non-finite components take no part, nor do rows without id. Of repeated
    ids the least vector counts. Ties go to the smaller id. An empty table gives
    none. The number of points, the largest norm, the usual length and the sampled
    vectors reach the driver. `tables` and `probes` are where the layout begins.
    """
    scratch = Scratch(df.sparkSession, "neighbours")
    element = df.schema[vector_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite & F.exists(vector_col, lambda x: x != 0))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vector_col).alias("vector"))
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not usual:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("vector") == usual[0]["n"])
    # One point for equal vectors; of its ids, those that can be among the nearest of any query.
    members = rows.join(rows.groupBy("vector").agg(F.min("id").alias("point")), "vector").select("id", "point", "vector")
    members = scratch.save(members, "members")
    points = members.filter("id = point").select("point", "vector")
    norm2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, norm = points.agg(F.count("*"), F.sqrt(F.max(norm2))).first()
    asked = members.join(queries.select(F.col("query_id").cast("long").alias("id")).distinct(), "id").select("id", "point")
    asked = scratch.save(asked, "asked")
    sampled = lambda rows_, n: rows_.orderBy(F.xxhash64("point", F.lit(7)), "point").limit(n)
    vectors = lambda rows_: np.array([r["vector"] for r in rows_.select("vector").collect()], np.float64)
    asked_points = asked.select("point").distinct()
    judged = vectors(points.join(F.broadcast(sampled(asked_points, JUDGED)), "point"))
    if not len(judged):
        return df.sparkSession.createDataFrame([], schema)
    # The first of a query's nearest is the query itself or one that ties with it.
    near = truth(points, judged, nearest + 1)[:, 1:]
    if near.shape[1]:
        index, _ = layout(judged, near, vectors(sampled(points, WEIGHED)), count, asked_points.count(), norm, tables, probes, width)
    else:
        index = Index.make(count, usual[0]["n"], norm, 1, 1, width, functions=0)

    def hashed(which: str):
        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    if not part.num_rows:
                        continue
                    raw = np.asarray(part.column("vector").flatten()).reshape(part.num_rows, -1)
                    keys = getattr(index, which)(raw.astype(np.float64))
                    n = keys.shape[1]
                    packed = pa.array([x.tobytes() for x in raw.astype(kind)], pa.binary())
                    yield pa.RecordBatch.from_pydict({"key": keys.ravel(), "id": np.repeat(np.asarray(part.column("point")), n), "vector": packed.take(pa.array(np.repeat(np.arange(part.num_rows), n)))})

        return run

    point_rows = points.mapInArrow(hashed("buckets"), "key long, id long, vector binary")
    query_rows = points.join(asked_points, "point").mapInArrow(hashed("visits"), "key long, id long, vector binary")
    large = point_rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > TOGETHER).select("key", F.ceil(F.col("n") / TOGETHER).cast("int").alias("shares"))
    large = scratch.save(large, "large")
    shares = F.coalesce("shares", F.lit(1))
    point_rows = point_rows.join(large, "key", "left").select("key", F.pmod(F.xxhash64("id"), shares).cast("int").alias("salt"), F.lit(0).alias("is_query"), "id", "vector")
    query_rows = query_rows.join(large, "key", "left").select("key", F.explode(F.sequence(F.lit(0), shares - 1)).alias("salt"), F.lit(1).alias("is_query"), "id", "vector")
    together = point_rows.unionByName(query_rows).repartition("key", "salt").sortWithinPartitions("key", "salt", "is_query")
    found = scratch.save(ranked(together, kind, nearest + 1), "found")
    # Queries that met too few points are compared with all of them.
    enough = found.groupBy("q").agg(F.count_distinct("v").alias("n")).filter(F.col("n") >= min(nearest + 1, count))
    short = scratch.save(asked_points.join(enough, F.col("point") == F.col("q"), "left_anti").select("point"), "short")
    if short.limit(1).count():
        parts = -(-count // TOGETHER)
        one = F.lit(0).cast("long").alias("key")
        every = packed(points, kind).select(one, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("salt"), F.lit(0).alias("is_query"), "id", "vector")
        them = packed(points.join(short, "point"), kind).select(one, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt"), F.lit(1).alias("is_query"), "id", "vector")
        rest = ranked(every.unionByName(them).repartition("key", "salt").sortWithinPartitions("key", "salt", "is_query"), kind, nearest + 1)
        found = found.unionByName(scratch.save(rest, "rest"))
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "v")
    found = found.groupBy("q", "v").agg(F.max("score").alias("score")).withColumn("at", F.row_number().over(by_score)).filter(F.col("at") <= nearest + 1)
    by_id = Window.partitionBy("point").orderBy("id")
    ids = members.select("point", "id").withColumn("at", F.row_number().over(by_id)).filter(F.col("at") <= nearest + 1)
    ids = ids.groupBy(F.col("point").alias("v")).agg(F.collect_list("id").alias("ids"))
    lists = found.join(ids, "v").select("q", F.explode("ids").alias("vec_id"), "score")
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = lists.withColumn("at", F.row_number().over(by_score)).filter(F.col("at") <= nearest + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("near"))
    out = asked.join(lists, F.col("point") == F.col("q")).select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, nearest)).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id")))
