"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm import _memory  # noqa: F401  sets how workers give memory back

#: A side of at most so many rows of a few fixed-size columns may be broadcast (about 32 bytes a row).
BROADCAST_ROWS = 2_000_000


#: Tables that this process has written, by application.
_TABLES: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset and all run on this machine (tests), a temporary one; on a cluster that raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def new_table(spark: SparkSession) -> str:
    """The path of a new table in the shared folder; `clear_tables` deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_tables(spark: SparkSession) -> int:
    """Delete the tables that operators have written in this application so far; results that still read them must be written before.  Gives their number."""
    paths = _TABLES.pop(spark.sparkContext.applicationId, [])
    kind = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        kind(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(kind(path), True)
    return len(paths)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder (columns can be pruned on reading)."""
    spark = df.sparkSession
    path = new_table(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the files of finished shuffles go: Spark deletes them once the driver has collected the plans that made them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sized_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows, else df as it is (then a shuffle join serves)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session: the cluster sets them by its input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bytes of one Arrow batch between the JVM and a worker (Spark's default bounds rows only, 10,000 whole texts).
BATCH_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, in a session that has not done so."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name
