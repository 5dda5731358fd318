"""The store around the tables: logs, backup and restore, migration, back-fill, synthetic rows, counts."""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hazardlens.schema import REPORT_COLUMNS, RULES
from hazardlens.sources.uploads import new_rows

#: Tables in the order in which they can be filled: parents before children.
ORDER = ("reports", "actions", "reviews", "embeddings")
KEYS = {"reports": "report_id", "actions": "action_id", "reviews": "review_id", "embeddings": "embedding_id"}


def log(rows: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    rows.write.mode("append").json(path)


def insert(row: DataFrame, path: str) -> int:
    """Append rows (with row_number) whose id and content are new; how many there were."""
    fresh = new_rows(row, row.sparkSession.read.parquet(path).select("report_id", "content_hash")).drop("row_number").cache()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _announce(spark: SparkSession, path: str, name: str, line: dict) -> None:
    """One small file, which must not be there yet: with it a commit counts."""
    fs, where = _folder(spark, f"{path}/{name}.json")
    out = fs.create(where, False)
    try:
        out.write(bytearray(json.dumps(line).encode()))
    finally:
        out.close()


def commit(rows: DataFrame, path: str, file_hash: str, filename: str) -> str:
    """Append an upload's rows and note its file, both or neither; gives the commit's name.

    Rows are written to a folder of their own, which no reader looks at until the
    commit is announced. The announcement holds the file's hash and name. A writer that is lost before it
    leaves rows that don't count, one that is lost within it a line that isn't read.
    """
    spark, name = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{path}/data/commit={name}")
    _announce(spark, f"{path}/commits", name, {"commit": name, "file_hash": file_hash, "filename": filename, "at": datetime.datetime.now(datetime.UTC).isoformat()})
    return name


def commits(spark: SparkSession, path: str) -> DataFrame:
    """commit, file_hash, filename and at of all announced commits."""
    fs, where = _folder(spark, f"{path}/commits")
    kind = "commit string, file_hash string, filename string, at string"
    if not fs.exists(where):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("mode", "DROPMALFORMED").json(f"{path}/commits").filter("commit IS NOT NULL AND file_hash IS NOT NULL")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file ever uploaded: its hash, and the name and time of the first upload."""
    first = F.min_by(F.struct("filename", "at"), F.struct("at", "commit")).alias("first")
    return commits(spark, path).groupBy("file_hash").agg(first).select("file_hash", "first.*")


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all announced commits; folders of others are pruned by the join where the plan allows it."""
    fs, where = _folder(spark, f"{path}/data")
    if not fs.exists(where):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, StructField("commit", StringType())])).parquet(f"{path}/data")
    return rows.join(commits(spark, path).select("commit"), "commit", "left_semi").drop("commit")


def reset(spark: SparkSession, path: str) -> None:
    """Leave a table without rows, of the same columns."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def checksum(df: DataFrame) -> DataFrame:
    """Rows and a digest of all of them that doesn't depend on their order."""
    # The sum of 60-bit digests; a decimal holds 10^20 of them.
    value = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(value), F.lit(0)).cast("string").alias("digest"))


def backup(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Every table as gzipped JSON lines, and their manifest (name, rows, digest), which is written beside them."""
    manifest = None
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")
        one = checksum(df).withColumn("name", F.lit(name))
        manifest = one if manifest is None else manifest.unionByName(one)
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def verified(spark: SparkSession, path: str, schemas: dict) -> DataFrame:
    """name and ok: whether each backed-up table still has the rows and the digest of the manifest."""
    noted = spark.read.schema("name string, rows long, digest string").json(f"{path}/manifest")
    found = None
    for name, schema in schemas.items():
        one = checksum(spark.read.schema(schema).json(f"{path}/{name}")).select(F.lit(name).alias("name"), F.col("rows").alias("found"), F.col("digest").alias("seen"))
        found = one if found is None else found.unionByName(one)
    same = (F.col("rows") == F.col("found")) & (F.col("digest") == F.col("seen"))
    return noted.join(found, "name", "left").select("name", F.coalesce(same, F.lit(False)).alias("ok"))


def restored(stored: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """The stored rows and those saved ones whose key isn't stored."""
    return stored.unionByName(saved.join(stored.select(key), key, "left_anti").select(*stored.columns))


def migration(source: dict[str, DataFrame], target: dict[str, DataFrame], keys: dict[str, str] | None = None) -> list[tuple[str, DataFrame]]:
    """Per table, parents first, the rows that the target lacks; nothing is written, so it is the dry run as well."""
    keys = KEYS if keys is None else keys
    return [(t, source[t].join(target[t].select(keys[t]), keys[t], "left_anti")) for t in ORDER if t in source]


def backfilled(df: DataFrame, detect: Callable[[Column], Column], column: str = "barrier_failure", text: str = "description") -> DataFrame:
    """Missing and unspecified barriers detected anew from the text; what isn't found stays Unspecified."""
    missing = F.coalesce(F.trim(column), F.lit("")).isin("", "Unspecified")
    return df.withColumn(column, F.when(missing, F.coalesce(detect(F.col(text)), F.lit("Unspecified"))).otherwise(F.col(column)))


def synthetic(spark: SparkSession, n: int = 250) -> DataFrame:
    """n made-up reports, the same in every run: all values follow from the row's number."""
    pick = lambda salt, values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    score = F.pmod(F.xxhash64("id", F.lit("score")), F.lit(101)).cast("int")
    level = F.when(F.col("risk_score") >= 80, "CRITICAL").when(F.col("risk_score") >= 60, "HIGH").when(F.col("risk_score") >= 30, "MEDIUM").otherwise("LOW")
    rows = spark.range(n).withColumn("risk_score", score).withColumns({
        "report_id": F.concat(F.lit("DEMO-"), F.lpad((F.col("id") + 1).cast("string"), 4, "0")), "category": pick("rule", RULES), "site": pick("site", ("Site Alpha", "Site Beta", "Site Gamma", "Site Delta")),
        "unit": pick("unit", ("Unit 1", "Unit 2", "Unit 3")), "risk_level": level, "sif_potential": F.when(F.col("risk_score") >= 70, "YES").otherwise("NO"),
        "date": F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit("day")), F.lit(365)).cast("int")), "yyyy-MM-dd"),
    })
    return rows.withColumn("description", F.concat(F.lit("Observation on "), F.lower("category"), F.lit(" at "), "site", F.lit(", "), "unit")).drop("id")


def population(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def empty_reports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t, _ in REPORT_COLUMNS))
