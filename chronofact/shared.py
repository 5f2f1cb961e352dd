"""Tables that later steps read from the shared folder, whatever executors are lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only in local mode (tests on one machine) a temporary folder is made and
    set where the session names none; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        named = "file://" + tempfile.mkdtemp(prefix="chronofact-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def own_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there.

    Rows that were numbered or placed before the cut keep their numbers and places.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
