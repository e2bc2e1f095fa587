"""Places that the driver and every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, also set as the checkpoint folder.

    Only where the setting is missing and the session runs in one process is a
    temporary folder used instead; a cluster without the setting is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not at:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = context.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='spark-weftline-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Paths that written() has made in this process, oldest first.
_made: list[str] = []


def written(spark: SparkSession, df, name: str):
    """Write df as Parquet below the shared folder and read it back: lineage ends here."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the order of written tables, for drop_between()."""
    return len(_made)


def drop_between(spark: SparkSession, first: int, last: int) -> None:
    """Delete the tables written from one mark to another; nothing may still be computed from them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for i in range(first, last):
        if _made[i]:
            at = jvm.org.apache.hadoop.fs.Path(_made[i])
            at.getFileSystem(conf).delete(at, True)
            _made[i] = ""
