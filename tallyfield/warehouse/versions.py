"""Dataset versions: content-addressed manifests over immutable Parquet partitions, with verify and rollback.

A manifest is a small JSON file of paths, sizes and digests; reading a version is
`spark.read.parquet` of its paths.  File digests are taken on the executors.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bronze(df: DataFrame, root: str, run: str) -> None:
    """All-text rows under source=/competition=/season=, a folder a run; nothing is overwritten."""
    if df.isEmpty():
        raise ValueError("bronze refuses an empty batch")
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    text.withColumn("run", F.lit(run)).write.mode("append").partitionBy("source", "competition", "season", "run").option("compression", "zstd").parquet(root)


def read_bronze(spark: SparkSession, root: str, **partition: str) -> DataFrame:
    """Rows of all runs by column name, in canonical order; partitions prune the scan."""
    df = spark.read.option("mergeSchema", True).option("basePath", root).parquet(root)
    for k, v in partition.items():
        df = df.filter(F.col(k) == v)
    order = [c for c in ("source", "competition", "season", "match_date", "source_id") if c in df.columns]
    return df.select(*[F.col(c).cast("string") for c in df.columns]).orderBy(*order)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of every file below a root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, root: str, identity_digest: str = "") -> dict:
    """The version's manifest; its id is the digest of the files' digests and the identity tables' digest."""
    rows = [r.asDict() for r in scan(spark, root).orderBy("path").toLocalIterator()]
    body = "\n".join(f"{r['sha256']} {r['length']}" for r in sorted(rows, key=lambda r: (r["sha256"], r["path"]))) + "\n" + identity_digest
    return {"version": hashlib.sha256(body.encode()).hexdigest()[:32], "root": root, "identity": identity_digest, "files": rows}


def save(spark: SparkSession, found: dict, folder: str) -> str:
    """Write a manifest as text through Spark's file systems; its path."""
    path = f"{folder.rstrip('/')}/{found['version']}"
    spark.createDataFrame([(json.dumps(found, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def load(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=False).first()[0])


def verify(spark: SparkSession, found: dict) -> list[str]:
    """Paths that are gone, changed or new since the manifest."""
    then = {r["path"]: r["sha256"] for r in found["files"]}
    now = {r["path"]: r["sha256"] for r in scan(spark, found["root"]).toLocalIterator()}
    return sorted(p for p in then.keys() | now.keys() if then.get(p) != now.get(p))


def read_version(spark: SparkSession, found: dict) -> DataFrame:
    """The rows of a version, whatever was added since: rolling back is reading an older manifest."""
    return spark.read.option("mergeSchema", True).option("basePath", found["root"]).parquet(*[r["path"] for r in found["files"]])
