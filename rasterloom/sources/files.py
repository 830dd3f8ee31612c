"""Bytes of files: whole columns by a binary scan and a join, or one path at a time behind an allow-list."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def allowed(path: str, roots) -> str:
    """The local path, if it lies below one of the roots; without roots none does."""
    plain = unquote(urlparse(path).path) if "://" in path or path.startswith("file:") else path
    real = os.path.realpath(plain)
    for root in roots or ():
        base = os.path.realpath(root)
        if real == base or real.startswith(base.rstrip("/") + "/"):
            return real
    raise ValueError(f"{path} is below none of the allowed roots")


def read_path(path: str, roots) -> bytes:
    scheme = urlparse(path).scheme
    if scheme not in ("", "file"):
        raise ValueError(f"{scheme} paths are read by read_bytes, through Spark's connectors")
    with open(allowed(path, roots), "rb") as f:
        return f.read()


def read_bytes(df: DataFrame, path: str, location: str | list[str], out: str = "bytes") -> DataFrame:
    """df with the bytes of the file that the column `path` names, null where there is none. The files are found by one
    binary scan of `location` (any file system Spark has a connector for) and joined on the path."""
    spark = df.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location)
    key = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/+", "/")
    files = files.select(key.alias("__file"), F.col("content").alias(out))
    return df.join(files, F.regexp_replace(F.col(path), "^[a-z0-9]+:/+", "/") == F.col("__file"), "left").drop("__file")


def image_files(spark: SparkSession, location: str | list[str]) -> DataFrame:
    """path, length and bytes of every file below location."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location).select("path", "length", F.col("content").alias("bytes"))
