"""Tables and materialised intermediate results."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local session (tests) may leave it unset and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_WRITTEN: list[str] = []


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables written so far, in long sessions once the results of their queries have been used; the number removed."""
    done = 0
    while _WRITTEN:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True))
    return done


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation, and unlike an RDD checkpoint
    keeps the columnar form, so that later stages prune columns and know the size of what they join.
    The table is removed by release, at the latest when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
