"""Mixing sources to target weights by pivotal dependent rounding.

Every row starts with the fractional copy number target/size of its source. In groups of bounded size rows are
taken in pairs and words move between their fractional parts (size * change is equal and opposite, so the words
taken stay the same) until one of the two is a whole number; what is left of each group meets the others' rest
on the next level of a reduction tree, until a source has one rest, which is rounded at random.

Cases: a null text has size 0 and takes nothing; a null source is a source of its own, last in order; sources
without words have target 0; equal rows are rows of their own; empty input gives empty output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_RE, mix64, read, stage_table, U64

FAN_IN = 4096
#: Stands for a null doc_id while rows are rounded.
NO_ID = -(1 << 63)


def water_fill(sizes: list[float], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight, each at most cap times its size; what is cut off goes to the others by weight."""
    out, live = [0.0] * len(sizes), [i for i in range(len(sizes))]
    left = total
    while live:
        w = sum(weights[i] for i in live)
        over = [i for i in live if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in live:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        live = [i for i in live if i not in set(over)]
    return out


def _pair(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> int:
    """Round p in place by pairs; returns the index that is still fractional, or -1. Words sum(size * p) stay."""
    eps = 1e-9
    i = -1
    for j in range(len(p)):
        if not eps < p[j] < 1 - eps:
            p[j] = round(p[j])
            continue
        if i < 0:
            i = j
            continue
        a, b = size[i], size[j]
        up = min((1 - p[i]) * a, p[j] * b)
        down = min(p[i] * a, (1 - p[j]) * b)
        move = up if u[j] * (up + down) < down else -down
        p[i] += move / a
        p[j] -= move / b
        done_i, done_j = not eps < p[i] < 1 - eps, not eps < p[j] < 1 - eps
        if done_i:
            p[i] = round(p[i])
        if done_j:
            p[j] = round(p[j])
        i = -1 if done_i and done_j else j if done_i else i
    return i


ROW = "key bigint, src int, size bigint, tag bigint, row bigint, frac double, whole bigint, copies bigint, level int"


def _round_groups(seed: int, level: int):
    """Arrow function of one (src, bin) group: rows in a fixed order, rounded in pairs; `copies` is null for the rest."""

    def run(table: pa.Table) -> pa.Table:
        d = {c: table[c].to_numpy() for c in ("key", "size", "tag", "row", "frac", "whole")}
        order = np.lexsort((d["row"], d["tag"], d["size"], d["key"]))
        key, size, whole = d["key"][order], d["size"][order], d["whole"][order]
        p = d["frac"][order].astype(float)
        with np.errstate(over="ignore"):
            u = mix64(key.astype(U64) * U64(0x9E3779B97F4A7C15) + np.arange(len(key), dtype=U64) + U64(seed * 1000003 + level)) / 2.0**64
        rest = _pair(p, np.maximum(size, 1).astype(float), u)
        copies = (whole + p.round().astype(np.int64)).astype(object)
        if rest >= 0:
            copies[rest] = None
        src = pa.array(np.full(len(key), table["src"][0].as_py(), np.int32))
        return pa.Table.from_arrays(
            [pa.array(key), src, pa.array(size), pa.array(d["tag"][order]), pa.array(d["row"][order]), pa.array(p), pa.array(whole), pa.array(copies, pa.int64()), pa.array(np.full(len(key), level, np.int32))],
            names=["key", "src", "size", "tag", "row", "frac", "whole", "copies", "level"],
        )

    return run


def mix_copies(rows: DataFrame, targets: dict[int, tuple[int, float, int]], *, seed: int = 0) -> DataFrame:
    """rows (key, src, size, tag, row) with whole copy numbers; tag and row order rows of one key and size. targets: src -> (its size, its target, its rows)."""
    spark = rows.sparkSession
    plan = spark.createDataFrame([(s, t / z if z else 0.0, max(1, -(-n // FAN_IN))) for s, (z, t, n) in targets.items()] or [(-1, 0.0, 1)], "src int, rate double, bins int")
    live = (
        rows.join(F.broadcast(plan), "src")
        .withColumn("whole", F.floor("rate").cast("bigint")).withColumn("frac", F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(0.0))
        .withColumn("bin", F.pmod(F.xxhash64("key", "size"), F.col("bins")))
    )
    done, level = [], 0
    while True:
        out = live.groupBy("src", "bin").applyInArrow(_round_groups(seed, level), ROW)
        out = stage_table(out, f"mix{level}")
        done.append(out.where("copies is not null"))
        rest = out.where("copies is null")
        n = rest.groupBy("src").count().agg(F.max("count")).first()[0] or 0
        if n <= 1:
            u = F.pmod(F.xxhash64(F.lit(seed), "key", "size"), F.lit(1 << 30)) / float(1 << 30)
            done.append(rest.withColumn("copies", F.col("whole") + F.when(u < F.col("frac"), 1).otherwise(0)))
            break
        live = rest.drop("copies", "level").withColumn("bin", F.pmod(F.xxhash64("key", "size", F.lit(level + 1)), F.lit(-(-n // FAN_IN))))
        level += 1
    union = done[0]
    for d in done[1:]:
        union = union.unionByName(d)
    return union.select("key", "src", "size", "row", "copies")


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), volume: float = 1.5, cap: float = 2.0, seed: int = 0, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row of docs (doc_id, source, text).

    One row per source comes to the driver (its words and rows); targets are numbers per source. With `row`, a bigint
    column that tells all rows apart, that column comes along.
    """
    own = F.col(row) if row else F.lit(0).cast("bigint")
    tag = F.xxhash64("text") if row else F.lit(0).cast("bigint")  # rows of one doc_id and size go by their text
    sized = docs.select("doc_id", "source", tag.alias("tag"), own.alias("row"), F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("bigint").alias("size"))
    sized = stage_table(sized, "sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("z"), F.count(F.lit(1)).alias("n")).collect()
    per.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = water_fill([float(r["z"]) for r in per], [float(weights[i % len(weights)]) for i in range(len(per))], volume * sum(r["z"] for r in per), cap)
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, r["source"], r["z"], g) for i, (r, g) in enumerate(zip(per, goal, strict=True))], "src int, s string, source_size bigint, target double"))
    # a key for each row: its doc_id, the source being part of the group; equal rows are told apart by their order in it
    rows = sized.join(table, sized["source"].eqNullSafe(table["s"])).select(F.coalesce("doc_id", F.lit(NO_ID)).cast("bigint").alias("key"), "src", "size", "tag", "row")
    copies = mix_copies(rows, {i: (r["z"], g, r["n"]) for i, (r, g) in enumerate(zip(per, goal, strict=True))}, seed=seed)
    return copies.join(table.drop("s"), "src").select(F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *([F.col("row").alias(row)] if row else []))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents", "doc_id", "source", "text"))
