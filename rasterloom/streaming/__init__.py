"""Streams of rows through the operators, and results in batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_files(spark: SparkSession, location: str, pattern: str = "*") -> DataFrame:
    """A stream of the files below a folder: path, modificationTime, length, content."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(location)


def windowed(stream: DataFrame, at: str, value: Column, *, every: str = "10 minutes", late: str = "30 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean and largest of a result in each time window; rows later than `late` behind the newest are let go, so
    the state stays bounded."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).withColumn("__value", value)
    out = rows.groupBy(F.window(at, every), *by).agg(F.count(F.lit(1)).alias("n"), F.avg("__value").alias("mean"), F.max("__value").alias("top"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "mean", "top")


def collect_batches(df: DataFrame, rows: int = 1024) -> Iterator[pa.Table]:
    """The result as Arrow tables of at most `rows` rows, one partition in the driver at a time."""
    schema = df.limit(0).toArrow().schema
    held: list[dict] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row.asDict(recursive=True))
        if len(held) == rows:
            yield pa.Table.from_pylist(held, schema)
            held = []
    if held:
        yield pa.Table.from_pylist(held, schema)
