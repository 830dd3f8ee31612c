"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

w1 to w4 run over PNG images of 480 x 640 made from the vectors (not timed): decode, 224 x 224, grey to an array; a
thumbnail of 256 as JPEG of quality 85; size and perceptual hash to duplicate groups; a crop by row parameters and a resize.
"""

import json
import os
import shutil
import tempfile
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rasterloom.plans.catalog import QUERIES
from rasterloom.plans.graph import Pipeline, cv

HEADLINE = ("bbox_stats", "hash_distance", "normalize_minmax", "reduce_percentile", "pair_add", "u8_add_saturates", "resize_lanczos3", "box_nms", "near_images", "last_purchase")
IMAGES = 1200


def make_images(spark: SparkSession, sf_dir: str, folder: str) -> int:
    """Photograph-like images: a vector's 8 x 8 field in three channels, enlarged, with grain; some occur twice."""
    from rasterloom.operators.resample import resample
    from rasterloom.sources.codecs import encode_png

    def paint(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = np.asarray(v[:64], float).reshape(8, 8)
                f = np.stack((f, f.T, f[::-1]), 2)
                big = resample(f, 480, 640, "bilinear")
                big = (big - big.min()) / (big.max() - big.min() + 1e-9) * 230 + np.random.default_rng(i // 2).normal(0, 4, (480, 640, 1))
                out.append(encode_png(np.clip(big, 0, 255).astype(np.uint8), 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "png"])

    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").limit(IMAGES).repartition(4 * spark.sparkContext.defaultParallelism)
    v.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(paint, "vec_id bigint, png binary").write.parquet(folder)
    return spark.read.parquet(folder).count()


def workloads(spark: SparkSession, folder: str) -> dict:
    images = spark.read.parquet(folder).repartition(4 * spark.sparkContext.defaultParallelism).cache()
    images.count()
    src = Pipeline().source("image_bytes", dtype="u8")
    top, side = (F.col("vec_id") % 40).cast("int"), (200 + F.col("vec_id") % 100).cast("int")
    phash = cv("png").pipe(src.perceptual_hash()).sink("native")
    return {
        "w1_decode_resize_gray": lambda: images.select(cv("png").pipe(src.resize(height=224, width=224, filter="bilinear").grayscale()).sink("array", shape=[224, 224, 1])),
        "w2_thumbnail_jpeg": lambda: images.select(cv("png").pipe(src.resize_max(max_size=256, filter="bilinear")).sink("jpeg", quality=85)),
        "w3_phash_groups": lambda: images.select("vec_id", cv("png").width().alias("w"), phash.alias("h")).groupBy("w", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "w4_crop_resize": lambda: images.select(cv("png").pipe(src.crop(top=top, left=top, height=side, width=side).resize(height=224, width=224, filter="bilinear")).sink("blob")),
    }


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ[name] = "1"  # Spark's tasks are the threads
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}

    def best(name, make):
        for _ in range(3):
            t = time.time()
            make().write.format("noop").mode("overwrite").save()
            took[name] = round(min(took.get(name, float("inf")), time.time() - t), 3)

    for name in HEADLINE:
        best(name, lambda: QUERIES[name](spark, d))  # noqa: B023
    folder = tempfile.mkdtemp(prefix="rasterloom-bench-")
    try:
        n = make_images(spark, d, f"{folder}/images")
        runs = workloads(spark, f"{folder}/images")
        for name, make in runs.items():
            best(name, make)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    rate = {k: round(n / took[k], 1) for k in runs}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "images": n, "images_per_second": rate, "cpus": int(cpus), "sf": d}))


if __name__ == "__main__":
    main()
