"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back from a table in the checkpoint folder that the session names; executors may be lost.

    In local mode without a folder, as in tests, a temporary one takes its place; on a cluster that is
    an error. Tables go when the application ends.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _local[0] if _local else _local.append(tempfile.mkdtemp(prefix="hazardlens-")) or _local[0]
    where = f"{folder}/hazardlens-{uuid.uuid4().hex}"
    df.write.parquet(where)
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)


#: The folder of a local session that names none.
_local: list[str] = []
