"""k-means over whole numbers, each vector compared only with the centroids in its annulus.

The distance of a vector x to a centroid c is at least | |x| - |c| |. Centroids are
sorted by their norms; the distance u to one of them (the one that the first pass
found nearest) bounds the distance to the nearest from above, so a binary search
for the norms from |x| - u to |x| + u gives all that can be as near. Those are
compared exactly, in whole numbers, ties at the edge included: the annulus is
widened by more than norms are rounded by.

Vectors are written once, with the centroid that the first pass found. A round reads them, and
every task hands on one sum a cluster and component; K centroids are all that
reaches the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import Scratch, claim, table

#: Clusters, rounds, components of a vector, and what a component is multiplied by before it is rounded down.
K, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
#: Below this squared distances fit 64 bits, for fewer than 2,048 components; other numbers are compared as Python's integers.
SMALL = 1 << 25
#: Part of a norm by which the annulus is wider on each side; bits of a partial sum's digits.
MARGIN, BITS = 1e-9, 30
LONGEST = (1 << 63) - 1


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of an array of doubles, 64-bit where all of them are small."""
    if x.size == 0 or np.abs(x).max() < SMALL // SCALE - 1:
        return np.floor(x * SCALE).astype(np.int64)
    exact = lambda v: math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE
    return np.frompyfunc(exact, 1, 1)(x)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to c (one row, or one for each)."""
    d = x - c
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row (ties: the smaller number) and the squared distance, from a guess for each row."""
    if x.dtype == object or centroids.dtype == object:
        x, centroids, guess = x.astype(object), centroids.astype(object), np.zeros(len(x), int)
    best, number = squared(x, centroids[guess]), guess.copy()
    size = lambda v: np.array([float("inf") if n >= 1 << 1000 else math.sqrt(n) for n in (v * v).sum(axis=1).tolist()]) if v.dtype == object else np.sqrt((v * v).sum(axis=1).astype(float))
    norms, own = size(centroids), size(x)
    order = np.argsort(norms, kind="stable")
    norms = norms[order]
    reach = np.array([math.isqrt(int(b)) + 1.0 if b < 1 << 1000 else float("inf") for b in best.tolist()]) if x.dtype == object else np.sqrt(best.astype(float)) + 1
    reach = reach + MARGIN * (own + reach + norms[-1])
    # Where a norm is beyond doubles the annulus holds all centroids.
    with np.errstate(invalid="ignore"):
        low, high = np.nan_to_num(own - reach, nan=-np.inf, posinf=np.inf, neginf=-np.inf), own + reach
    first, last = np.searchsorted(norms, low, "left"), np.searchsorted(norms, high, "right")
    for at, c in enumerate(order.tolist()):
        rows = np.flatnonzero((first <= at) & (at < last) & (guess != c))
        if len(rows):
            d = squared(x[rows], centroids[c])
            better = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
            best[rows[better]], number[rows[better]] = d[better], c
    return number, best


def digits(value: int) -> Iterator[tuple[int, int]]:
    """A whole number as digits of BITS bits, the last one with the sign, so that sums of any size add up as 64-bit numbers."""
    at = 0
    while not -(1 << BITS) < value < 1 << BITS:
        yield at, value & ((1 << BITS) - 1)
        value, at = value >> BITS, at + 1
    yield at, value


def components(batch: pa.RecordBatch) -> np.ndarray:
    return whole(np.asarray(batch.column("vector").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1))


def summed(centroids: np.ndarray) -> Callable:
    """Rows cluster, component, digit, value of a task's sums; component -1 counts the vectors."""

    def run(batches):
        claim(__name__)
        k, dim = centroids.shape
        sums, counts = np.zeros((k, dim), object), [0] * k
        for batch in batches:
            if batch.num_rows:
                x = components(batch)
                number, _ = nearest(x, centroids, batch.column("guess").to_numpy())
                for c in np.unique(number).tolist():
                    sums[c] += x[number == c].sum(axis=0).astype(object)
                    counts[c] += int((number == c).sum())
        rows = [(c, j, at, v) for c in range(k) if counts[c] for j, total in [(-1, counts[c]), *enumerate(sums[c].tolist())] for at, v in digits(total)]
        cluster, component, digit, value = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(cluster, pa.int32()), "component": pa.array(component, pa.int32()), "digit": pa.array(digit, pa.int32()), "value": pa.array(value, pa.int64())})

    return run


def assigned(centroids: np.ndarray, write: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict]) -> Callable:
    """A task that gives every vector its nearest centroid; without a column `guess` the first one bounds the distance."""

    def run(batches):
        claim(__name__)
        for batch in batches:
            if batch.num_rows:
                x = components(batch)
                guess = batch.column("guess").to_numpy() if "guess" in batch.schema.names else np.zeros(len(x), np.int32)
                yield pa.RecordBatch.from_pydict(write(batch, *nearest(x, centroids, guess)))

    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact means, rounded down; those without vectors stay."""
    parts = vectors.select("vector", "guess").mapInArrow(summed(centroids), "cluster int, component int, digit int, value bigint")
    totals: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "component", "digit").agg(F.sum("value").alias("value")).collect():
        totals[r["cluster"], r["component"]] = totals.get((r["cluster"], r["component"]), 0) + (r["value"] << (BITS * r["digit"]))
    out = [[totals[c, j] // totals[c, -1] for j in range(centroids.shape[1])] if (c, -1) in totals else centroids[c].tolist() for c in range(len(centroids))]
    return fitting(out)


def fitting(rows: list[list[int]]) -> np.ndarray:
    """Whole numbers as 64-bit ones where squared distances fit."""
    return np.array(rows, np.int64 if all(abs(v) < SMALL for row in rows for v in row) else object)


def cluster(df: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of `dim` finite components.

    Null vectors, those of another length and those that hold null or a number
    that isn't finite take no part. With fewer than k vectors each starts a centroid; of equal hashes (repeated rows,
    or ids) the smaller vector comes first. Repeated rows are vectors of their own,
    a null id is hashed as an empty one; an empty table gives no rows. Distances and sums beyond 63 bits
    are given as the largest long number.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "centroids")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter((F.size("vector") == dim) & finite)
    key = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    start = kept.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    id_kind = kept.schema["vec_id"].dataType.simpleString()
    if not start:
        return spark.createDataFrame([], f"vec_id {id_kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    centroids = fitting([whole(np.array(r["vector"], float)).tolist() for r in start])
    guessed = assigned(centroids, lambda batch, number, _: {"vec_id": batch.column("vec_id"), "vector": batch.column("vector"), "guess": pa.array(number, pa.int32())})
    vectors = scratch.save(kept.mapInArrow(guessed, f"vec_id {id_kind}, vector array<double>, guess int"), "vectors")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    last = assigned(centroids, lambda batch, number, best: {"vec_id": batch.column("vec_id"), "cluster": pa.array(number, pa.int32()), "distance": pa.array([min(int(d), LONGEST) for d in best.tolist()], pa.int64())})
    out = scratch.save(vectors.mapInArrow(last, f"vec_id {id_kind}, cluster int, distance bigint"), "assigned")
    inertia = {r["cluster"]: int(r["inertia"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    everything = min(sum(inertia.values()), LONGEST)
    told = [(c, min(v, LONGEST), everything, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, v in inertia.items()]
    # One row a cluster, k at most.
    about = F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"))
    return out.join(about, "cluster").select(*names)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))
