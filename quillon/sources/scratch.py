"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a local folder
    serves in local mode; on a cluster that is an error, as executors would not see
    each other's files."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'quillon-scratch')}"


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if the session is still there."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    if jvm is None or jsc is None:
        return
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended; the folder is scratch space
        return


class Scratch:
    """Tables written on the way to a result, and given back together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame) -> DataFrame:
        """``df`` written once and read back: a short plan, cut lineage, and later
        uses read only the columns they need. The files go with :meth:`clear`, or
        when the driver's process ends."""
        path = f"{shared_dir(self.spark)}/quillon-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        atexit.register(deleted, self.spark, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            deleted(self.spark, path)
        self.paths = []
