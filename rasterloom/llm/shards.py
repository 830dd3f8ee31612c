"""Sharding along a Hilbert curve over quantised metadata, all in DataFrame operations.

Each dimension is quantised to `bits` bits; the curve index of the cell orders the rows, equal texts follow each
other (they share the metadata of their smallest doc_id), and equal runs of that order are the shards, so a shard
covers few ranges of each dimension. Law `rows`: shard sizes differ by one row at most.

Cases: null text has size 1 and no crc; null metadata are a value of their own, lowest; repeated rows keep
separate slots; empty input gives empty output; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, read, stage_table


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Curve index of integer columns in [0, 2**bits), by Skilling's transform.

    The rounds are folds over constant arrays, so the expression's size does not depend on bits.
    """
    n = len(axes)
    zero = F.lit(0).cast("bigint")
    state = F.array(*[a.cast("bigint") for a in axes])
    steps = F.array(*[F.struct(F.lit(1 << q).cast("bigint").alias("bit"), F.lit(i + 1).alias("i")) for q in reversed(range(1, bits)) for i in range(n)])

    def turn(x, s):
        """Invert the low bits of the first axis, or exchange them with axis i."""
        low = s["bit"] - 1
        xi, x1 = F.element_at(x, s["i"]), F.element_at(x, 1)
        on = xi.bitwiseAND(s["bit"]) != 0
        t = F.when(on, zero).otherwise(x1.bitwiseXOR(xi).bitwiseAND(low))
        first = F.when(on, x1.bitwiseXOR(low)).otherwise(x1.bitwiseXOR(t))
        return F.transform(x, lambda v, j: F.when(j == 0, first).when(j == s["i"] - 1, v.bitwiseXOR(t)).otherwise(v))

    def with_(x: Column, f) -> Column:
        return F.element_at(F.transform(F.array(x), f), 1)

    if bits > 1:
        state = F.aggregate(steps, state, turn)
    gray = F.aggregate(state, F.array().cast("array<bigint>"), lambda acc, v: F.array_append(acc, F.when(F.size(acc) == 0, v).otherwise(v.bitwiseXOR(F.coalesce(F.try_element_at(acc, F.size(acc)), zero)))))
    down = F.array(*[F.lit(1 << q).cast("bigint") for q in reversed(range(1, bits))]) if bits > 1 else F.array().cast("array<bigint>")
    fix = lambda x: F.aggregate(down, zero, lambda t, q: F.when(F.element_at(x, n).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    done = with_(with_(gray, lambda x: F.struct(x.alias("x"), fix(x).alias("t"))), lambda s: F.transform(s["x"], lambda v: v.bitwiseXOR(s["t"])))
    order = F.array(*[F.struct(F.lit(1 << q).cast("bigint").alias("bit"), F.lit(j + 1).alias("j")) for q in reversed(range(bits)) for j in range(n)])
    return with_(done, lambda x: F.aggregate(order, zero, lambda h, o: h * 2 + F.when(F.element_at(x, o["j"]).bitwiseAND(o["bit"]) != 0, F.lit(1)).otherwise(F.lit(0))))


def global_rank(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """df with a gapless bigint column `name` in the order given, and the row count.

    Rows are range-partitioned, sorted and written once; only the partitions' counts reach the driver.
    """
    cols = df.columns
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = stage_table(laid.withColumn("__p", F.spark_partition_id()).withColumn("__r", F.monotonically_increasing_id() - F.spark_partition_id().cast("bigint") * F.lit(1 << 33)), "ranked")
    counts, base = sorted((r["__p"], r["n"]) for r in laid.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()), 0
    start = []
    for p, n in counts:
        start.append((p, base))
        base += n
    table = df.sparkSession.createDataFrame(start or [(-1, 0)], "__p int, __b bigint")
    return laid.join(F.broadcast(table), "__p").select(*cols, (F.col("__b") + F.col("__r")).alias(name)), base


def hilbert_shards(docs: DataFrame, *, shards: int = 8, bits: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, size, text_crc32, curve, rank, shard, slot for every row of docs; dimensions: size, lang, source."""
    raw = F.encode(F.col(text), "UTF-8")
    base = docs.select(
        F.col(key).cast("bigint").alias("k"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1).alias("size"), F.crc32(raw).cast("bigint").alias("crc"),
        F.xxhash64(text).alias("h1"), F.struct(F.col("lang").alias("lang"), F.col("source").alias("source")).alias("meta"),
    )
    # equal texts: one name from two hashes and the size
    base = stage_table(base.withColumn("g", F.concat_ws("-", F.hex("h1"), F.hex("crc"), F.hex("size"))), "shard-meta")
    groups = base.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min_by("meta", F.struct("k", "meta")).alias("lead")).where("n > 1")
    rows = join_hot(base, stage_table(groups, "shard-groups"), "g", "n").withColumn("lead", F.coalesce("lead", "meta"))
    top = (1 << bits) - 1
    level = F.least(F.floor(F.log2(F.col("size").cast("double")) * 10), F.lit(top))
    name = lambda c: F.when(F.col(c).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(c), F.lit(top)))
    rows = rows.withColumn("curve", hilbert_index([level, name("lead.lang"), name("lead.source")], bits))
    ranked, n = global_rank(rows.select("k", "size", "crc", "h1", "curve"), ["curve", "h1", "size", "k"], "rank")
    shard = F.floor((F.lit(shards) * (F.col("rank") + 1) - 1) / F.lit(max(n, 1))).cast("int")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - F.floor(F.col("shard") * F.lit(n) / F.lit(shards)).cast("bigint")).withColumnRenamed("k", key).withColumnRenamed("crc", "text_crc32")


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return out.select("doc_id", "size", F.coalesce("text_crc32", F.lit(0)).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
