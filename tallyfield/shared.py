"""Tables in the folder that driver and executors share: they cut lineage and outlive lost executors.  Rows dealt over tasks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all run on this machine, a temporary folder, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over as many tasks as shuffles have: for rows that are few bytes and much work, which files and adaptive plans would leave to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
