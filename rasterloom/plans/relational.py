"""Compositions of the operators with joins, groups, windows, sorts and sets, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import pixel as P
from . import images as I
from .graph import cv


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average hash of each image's first 4 x 4 pixels: two bytes."""
    return I.images(spark, sf_dir).select("vec_id", I.byte().crop(height=4, width=4).perceptual_hash(algorithm="average", hash_size=16).sink("native").alias("h"))


_CORNER = "list_transform(range(0, 16), lambda k: u[(k // 4) * 8 + k % 4 + 1])"
_HASHES = f"SELECT vec_id, list_transform(q, lambda z: CASE WHEN z >= list_avg(q) THEN 1 ELSE 0 END) AS b FROM (SELECT vec_id, {_CORNER} AS q FROM ({I._BASE}))"


def hamming_pairs(left: DataFrame, right: DataFrame, key: str, code: str, most: int) -> DataFrame:
    """(a, b, distance) of rows whose hashes differ in at most `most` bits, which must be fewer than the hash has bytes:
    such hashes agree in a byte, so rows meet on (place, byte) and are verified; no all-pairs join is made."""
    band = lambda df, name: df.select(F.col(key).alias(name), F.col(code).alias(f"h_{name}"), F.posexplode(code).alias("place", "byte"))
    near = band(left, "a").join(band(right, "b"), ["place", "byte"]).where("a < b")
    d = near.select("a", "b", P.hamming_distance(F.col("h_a").cast("array<int>"), F.col("h_b").cast("array<int>")).alias("distance")).where(F.col("distance") <= most)
    return d.distinct()


def near_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of images whose hashes differ in at most one bit."""
    h = _hashed(spark, sf_dir)
    return hamming_pairs(h, h, "vec_id", "h", 1).select("a", "b", F.col("distance").cast("bigint").alias("distance"))


NEAR_SQL = f"""WITH h AS ({_HASHES}) SELECT * FROM (SELECT p.vec_id AS a, q.vec_id AS b,
 CAST(len(list_filter(range(1, 17), lambda k: p.b[k] <> q.b[k])) AS BIGINT) AS distance FROM h p JOIN h q ON p.vec_id < q.vec_id) WHERE distance <= 1"""


def bright_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter on a result: images whose mean byte is above 128."""
    return I.images(spark, sf_dir).withColumn("m", I.byte().reduce_mean().sink("native")).where("m > 128").select("vec_id", F.round("m", 6).alias("m"))


def pixels_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash aggregate over exploded pixels."""
    px = I.images(spark, sf_dir).select(F.explode(I.byte().reshape(shape=[64]).sink("list")).alias("v"))
    return px.groupBy((F.col("v") / 16).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max("v").cast("bigint").alias("top"))


def means_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group by over two outputs of one pass."""
    a = I.byte()
    out = a.merge_pipe(a.reduce_mean().alias("m"), a.reduce_max().alias("t")).sink({"m": "native", "t": "native"})
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.transform("embedding", lambda e: e.cast("double")).alias("x"))
    return v.select("label", out.alias("o")).groupBy("label").agg(F.round(F.avg("o.m"), 6).alias("m"), F.max("o.t").cast("bigint").alias("t"), F.count(F.lit(1)).alias("n"))


def size_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window over results: each image's brightness against the one before within its label."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.transform("embedding", lambda e: e.cast("double")).alias("x"))
    w = Window.partitionBy("label").orderBy("vec_id")
    s = v.select("vec_id", "label", I.byte().reduce_sum().sink("native").cast("bigint").alias("s"))
    return s.select("vec_id", "s", F.coalesce(F.lag("s").over(w), F.lit(-1)).alias("before"), F.row_number().over(w).alias("place"))


def brightest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k: the ten brightest images, ties by id."""
    s = I.images(spark, sf_dir).select("vec_id", I.byte().reduce_sum().sink("native").cast("bigint").alias("s"))
    return s.orderBy(F.desc("s"), "vec_id").limit(10)


def blob_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi join on blobs: images equal to a mirror image of an image."""
    a = I.images(spark, sf_dir).select("vec_id", I.byte().threshold(value=140.0).crop(height=2, width=4).sink("blob").alias("k"))
    b = I.images(spark, sf_dir).select(F.col("vec_id").alias("other"), I.byte().threshold(value=140.0).crop(height=2, width=4).flip_h().sink("blob").alias("k"))
    return a.join(b, "k").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))



BLOB_SQL = f"""WITH m AS (SELECT vec_id, list_transform([0, 1, 2, 3, 8, 9, 10, 11], lambda k: u[k + 1] > 140) AS a, list_transform([3, 2, 1, 0, 11, 10, 9, 8], lambda k: u[k + 1] > 140) AS b FROM ({I._BASE}))
SELECT p.vec_id, count(*) AS n FROM m p JOIN m q ON p.a = q.b GROUP BY p.vec_id"""


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's pixels above several thresholds: a broadcast list of four rows meets every row."""
    steps = F.broadcast(spark.createDataFrame([(float(t),) for t in (96, 128, 144, 160)], "t double"))
    s = I.images(spark, sf_dir).crossJoin(steps).select("vec_id", "t", (I.byte().threshold(value=F.col("t")).reduce_sum().sink("native") / 255).cast("bigint").alias("n"))
    return s.groupBy("t").agg(F.sum("n").alias("above"), F.max("n").alias("most"))


SWEEP_SQL = f"SELECT t, CAST(sum(n) AS BIGINT) AS above, max(n) AS most FROM (SELECT t, CAST(len(list_filter(u, lambda z: z > t)) AS BIGINT) AS n FROM ({I._BASE}), (VALUES (96.0::DOUBLE), (128.0::DOUBLE), (144.0::DOUBLE), (160.0::DOUBLE)) AS s(t)) GROUP BY t"


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str]) -> DataFrame:
    """Each row of left with the values of the last row of right at or before it, of one key; null where there is none.

    Both sides are merged and one window carries the last values forward, so keys are sorted once and nothing is paired.
    """
    a = left.select("*", F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values])
    b = right.select(*[(F.col(c) if c in (by, at) else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in left.columns], F.lit(0).alias("__side"), *[F.col(v).alias(f"__{v}") for v in values])
    w = Window.partitionBy(by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("__side") == 0, F.struct(*[F.col(f"__{v}").alias(v) for v in values])), ignorenulls=True).over(w)
    out = a.unionByName(b).withColumn("__last", carried).where("__side = 1")
    return out.select(*left.columns, *[F.col(f"__last.{v}").alias(v) for v in values])


def last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: every click with the value of the user's last earlier purchase."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    buys = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("paid"))
    return as_of(clicks, buys, "user_id", "ts", ["paid"]).select("event_id", "user_id", F.round("paid", 4).alias("paid"))


LAST_SQL = """WITH b AS (SELECT user_id, ts, max(value) AS paid FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT event_id, c.user_id, round(b.paid, 4) AS paid FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN b ON c.user_id = b.user_id AND c.ts >= b.ts"""


def united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of results of two branches."""
    d = I.images(spark, sf_dir)
    one = d.select("vec_id", F.lit("max").alias("what"), I.byte().reduce_max().sink("native").cast("double").alias("value"))
    return one.unionByName(d.select("vec_id", F.lit("min").alias("what"), I.byte().reduce_min().sink("native").cast("double").alias("value")))


def gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a line item that overlap another one of the order: an equi join with a condition, then counted."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    b = li.select("l_orderkey", "l_linenumber", G.bbox(F.col("l_quantity").cast("double"), F.lit(0.0), F.lit(5.0), F.lit(4.0)).alias("b"))
    o = b.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("b").alias("c"))
    hit = b.join(o, "l_orderkey").where((F.col("l_linenumber") < F.col("n")) & (G.bbox_iou(F.col("b"), F.col("c")) > 0.5))
    return hit.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pairs"))


GATHERED_SQL = """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x FROM lineitem), p AS (SELECT a.l_orderkey, greatest(5 - abs(a.x - b.x), 0) * 4 AS o FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
SELECT l_orderkey, count(*) AS pairs FROM p WHERE o / (40 - o) > 0.5 GROUP BY l_orderkey"""


def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter on header fields before anything is decoded, then decode and reduce."""
    png = I.byte().resize(height=(F.col("vec_id") % 5 + 1).cast("int"), width=4, filter="nearest").sink("png")
    d = I.images(spark, sf_dir).select("vec_id", png.alias("png"))
    tall = d.where(cv("png").height() > 3)
    return tall.select("vec_id", cv("png").image_info()["height"].alias("height"))


QUERIES = {
    "near_images": near_images, "bright_images": bright_images, "pixels_by_value": pixels_by_value, "means_by_label": means_by_label, "size_windows": size_windows, "brightest": brightest,
    "blob_join": blob_join, "threshold_sweep": threshold_sweep, "last_purchase": last_purchase, "united": united, "overlapping_lines": gathered, "image_headers": image_headers,
}
_S = f"SELECT e.vec_id, e.label, CAST(list_sum(u) AS BIGINT) AS s FROM embeddings e JOIN ({I._BASE}) i ON i.vec_id = e.vec_id"
ORACLE_SQL = {
    "near_images": NEAR_SQL,
    "bright_images": f"SELECT vec_id, round(list_avg(u), 6) AS m FROM ({I._BASE}) WHERE list_avg(u) > 128",
    "pixels_by_value": f"SELECT v // 16 AS bin, count(*) AS n, max(v) AS top FROM (SELECT unnest(u) AS v FROM ({I._BASE})) GROUP BY 1",
    "means_by_label": f"SELECT label, round(avg(list_avg(u)), 6) AS m, max(list_max(u)) AS t, count(*) AS n FROM embeddings e JOIN ({I._BASE}) i ON i.vec_id = e.vec_id GROUP BY label",
    "size_windows": f"SELECT vec_id, s, coalesce(lag(s) OVER w, -1) AS before, CAST(row_number() OVER w AS INTEGER) AS place FROM ({_S}) WINDOW w AS (PARTITION BY label ORDER BY vec_id)",
    "brightest": f"SELECT vec_id, s FROM ({_S}) ORDER BY s DESC, vec_id LIMIT 10",
    "blob_join": BLOB_SQL,
    "threshold_sweep": SWEEP_SQL,
    "last_purchase": LAST_SQL,
    "united": f"SELECT vec_id, 'max' AS what, CAST(list_max(u) AS DOUBLE) AS value FROM ({I._BASE}) UNION ALL SELECT vec_id, 'min', CAST(list_min(u) AS DOUBLE) FROM ({I._BASE})",
    "overlapping_lines": GATHERED_SQL,
    "image_headers": "SELECT vec_id, vec_id % 5 + 1 AS height FROM embeddings WHERE vec_id % 5 + 1 > 3",
}
