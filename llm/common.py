"""Helpers shared by the operators: tables, shared scratch space, Arrow output."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to a Python worker at once: Spark's default, and what is set in its place, as rows here are whole texts.
BATCH, DEFAULT_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_ids(df: DataFrame, id_col: str) -> None:
    """Operators that need the order of ids take whole numbers."""
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be a whole number")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text as the empty one."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


class Scratch:
    """Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir).

    Where the setting is unset, a local temporary folder takes its place in local
    mode, as in tests; on a cluster that is an error. Tables go when dropped, the
    rest when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if root is None:
            if not regex.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="llm-")
        self.root = f"{root}/{name}-{uuid.uuid4().hex}"
        self._path(self.root)[0].deleteOnExit(self._path(self.root)[1])

    def _path(self, where: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write df once and read it back: lineage ends here and its shuffle files can go."""
        where = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            writer = df.write.option("compression", "zstd")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(where)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(where)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = self._path(f"{self.root}/{name}")
            fs.delete(path, True)


def blocks(batches: Iterable[pa.RecordBatch], size_of: str, most: int) -> Iterator[pa.Table]:
    """Cut or join the batches to blocks of about `most` bytes of column size_of."""
    held, weight = [], 0
    for batch in batches:
        at = 0
        col = batch.column(size_of)
        lens = np.asarray(pc.binary_length(col).fill_null(0)) if len(col) else np.zeros(0, int)
        ends = np.cumsum(lens)
        while at < len(col):
            room = most - weight + (ends[at - 1] if at else 0)
            to = max(at + 1, int(np.searchsorted(ends, room, side="right")))
            held.append(batch.slice(at, to - at))
            weight += int(ends[to - 1] - (ends[at - 1] if at else 0))
            at = to
            if weight >= most or at < len(col):
                yield pa.Table.from_batches(held)
                held, weight = [], 0
    if held:
        yield pa.Table.from_batches(held)


#: What modules keep in a worker between tasks: how to let go of it, and whose tasks need it.
_kept: list[tuple[Callable[[], None], frozenset[str]]] = []


def keeps(release: Callable[[], None], *users: str) -> None:
    """Register something that a worker keeps between the tasks of the modules `users`."""
    _kept.append((release, frozenset(users)))


def claim(module: str) -> None:
    """A task of a module begins: what only other modules' tasks need goes, so that a worker never holds the memory of several."""
    for release, users in _kept:
        if module not in users:
            release()
    pa.default_memory_pool().release_unused()
    # What the C library holds of memory that is free goes back to the system, where it can do that.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, make: Callable[[pa.Table], dict | None], schema: str, size_of: str = "text", most: int = 2 << 20) -> DataFrame:
    """mapInArrow over blocks of bounded bytes; make returns columns by name."""
    owner = make.__module__

    def run(batches):
        claim(owner)
        for block in blocks(batches, size_of, most):
            out = make(block)
            if out is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def annotated(df: DataFrame, carry: list[str], make: Callable[[list[str]], dict], added: str, text_col: str = "text", most: int = 1 << 20) -> DataFrame:
    """The columns `carry` of every row and those that make() gives for its text (a null one is empty).

    The session's batches are made smaller from here on, unless it has a size of its own.
    """
    if df.sparkSession.conf.get(BATCH) == DEFAULT_ROWS:
        df.sparkSession.conf.set(BATCH, ROWS)
    rows = df.select(*carry, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)

    def run(block: pa.Table) -> dict:
        return {c: block.column(c).combine_chunks() for c in carry} | make(block.column("_text").to_pylist())

    run.__module__ = make.__module__
    return mapped(rows, run, f"{kinds}, {added}", size_of="_text", most=most)
