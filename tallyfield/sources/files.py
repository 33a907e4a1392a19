"""JSON files as DataFrames: single documents, lines, folders and glob patterns.

Paths go to Spark's readers, so any Hadoop file system (s3a, gs, abfss, hdfs) serves.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Schema = T.StructType | str | None


def _reader(spark: SparkSession, schema: Schema):
    return spark.read.schema(schema) if schema is not None else spark.read


def read_json(spark: SparkSession, path: str, schema: Schema = None) -> DataFrame:
    """A file that holds a list of objects or one object."""
    return _reader(spark, schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: Schema = None) -> DataFrame:
    """An object a line; blank lines are skipped."""
    return _reader(spark, schema).json(path)


def _both(spark: SparkSession, path: str, schema: Schema, recursive: bool) -> DataFrame:
    parts = []
    for suffix, many in ((".json", True), (".jsonl", False)):
        reader = _reader(spark, schema).option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", recursive).option("multiLine", many)
        try:
            df = reader.json(path)
        except Exception as error:  # no file of this kind leaves nothing to infer from
            if "UNABLE_TO_INFER_SCHEMA" in str(error):
                continue
            raise
        if df.columns:
            parts.append(df)
    if not parts:
        raise FileNotFoundError(f"no .json or .jsonl files at {path}")
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_folder(spark: SparkSession, path: str, schema: Schema = None) -> DataFrame:
    """The .json and .jsonl files of a folder, not of those below it."""
    return _both(spark, path, schema, False)


def read_glob(spark: SparkSession, pattern: str, schema: Schema = None) -> DataFrame:
    """Files of a pattern; ** stands for any depth."""
    if "**" in pattern:
        root, _, rest = pattern.partition("**")
        name = rest.lstrip("/") or "*"
        parts = []
        for suffix in (".json", ".jsonl") if not re.search(r"\.jsonl?$", name) else ("",):
            reader = _reader(spark, schema).option("recursiveFileLookup", True).option("pathGlobFilter", name + suffix if suffix else name)
            try:
                df = reader.option("multiLine", not (name + suffix).endswith(".jsonl")).json(root)
            except Exception as error:
                if "UNABLE_TO_INFER_SCHEMA" in str(error):
                    continue
                raise
            if df.columns:
                parts.append(df)
        if not parts:
            raise FileNotFoundError(f"no files match {pattern}")
        out = parts[0]
        for df in parts[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return out
    if pattern.endswith(".jsonl"):
        return read_jsonl(spark, pattern, schema)
    if pattern.endswith(".json"):
        return read_json(spark, pattern, schema)
    return _both(spark, pattern, schema, False)
