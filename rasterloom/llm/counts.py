"""Token counts through a digest cache.

Normalised content (null becomes empty) and the tokenizer file each have a digest; counts found in the cache for
that pair are joined, only distinct texts that miss are encoded, and their counts are appended. The library
counts each distinct pre-token of a task once (special strings cut the text first, as the library does), and a
text's count is the sum over its pre-tokens.

Cases: null and empty texts have 0 tokens; copies share one entry; repeated rows each get their count; a cache
that does not exist yet is empty; empty input gives empty output.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import grouped
from .common import Known, distinct, freed, join_hot, read, shared_dir, stage_table
from .pretoken import pretoken_keys, pretokens

CACHE = "tokenizer string, digest string, n_tokens bigint"


class Counter:
    """Counts tokens by the tokenizers library, one call for each pre-token not in the worker's cache."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        self.lib = tokenizers.Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        plain = [t for t in added if not (t.get("lstrip") or t.get("rstrip") or t.get("single_word"))]
        # a tokenizer whose added tokens take their surroundings is left wholly to the library
        self.special = [t["content"].encode() for t in plain] if len(plain) == len(added) else None
        pre = str(json.load(open(path, encoding="utf-8")).get("pre_tokenizer"))
        if "ByteLevel" not in pre or "Sequence" in pre or "'add_prefix_space': True" in pre or json.load(open(path, encoding="utf-8")).get("normalizer"):
            self.special = None
        self.known = Known()

    def pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The part without special strings, the offsets of the pieces left, and how many specials each text had."""
        raw = data.tobytes()
        if not any(s in raw for s in self.special):
            return data, off, np.zeros(len(off) - 1, np.int64), np.arange(len(off))
        out, ends, n, which = [], [0], np.zeros(len(off) - 1, np.int64), [0]
        for i in range(len(off) - 1):
            chunk = [raw[off[i] : off[i + 1]]]
            for s in sorted(self.special, key=len, reverse=True):
                nxt = []
                for c in chunk:
                    found = c.split(s)
                    n[i] += len(found) - 1
                    nxt += found
                chunk = nxt
            for c in chunk:
                out.append(c)
                ends.append(ends[-1] + len(c))
            which.append(len(ends) - 1)
        return np.frombuffer(b"".join(out), np.uint8), np.asarray(ends, np.int64), n, np.asarray(which)

    def count_group(self, group: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        if self.special is None:
            return [np.asarray([len(e) for e in self.lib.encode_batch_fast([d[o[i] : o[i + 1]].tobytes().decode() for i in range(len(o) - 1)], add_special_tokens=False)], np.int64) for d, o in group]
        out = []
        for data, off in group:
            data, poff, extra, which = self.pieces(data, off)
            starts, toff = pretokens(data, poff)
            keys = pretoken_keys(data, starts)
            row = self.known.find(data, starts[:-1], starts[1:], keys)
            n = self.known.a[row].astype(np.int64)
            miss = np.flatnonzero(row < 0)
            if len(miss):
                first, back = distinct(data, starts[miss], starts[miss + 1], keys[miss])
                raw = data.tobytes()
                spans = [raw[i:j] for i, j in zip(starts[miss[first]].tolist(), starts[miss[first] + 1].tolist(), strict=True)]
                got = np.fromiter((len(x) for x in self.lib.encode_batch_fast([x.decode() for x in spans], add_special_tokens=False)), np.int64, len(spans))
                self.known.add(spans, keys[miss[first]], got, got)
                n[miss] = got[back]
            total = np.concatenate(([0], np.cumsum(n)))[toff[which]]
            out.append(np.diff(total) + extra)
        return out


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def count_tokens(docs: DataFrame, path: str, *, cache_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens of every row. The cache is a Parquet table in a folder that executors share."""
    spark = docs.sparkSession
    version = file_digest(path)
    cache_path = cache_path or f"{shared_dir(spark)}/token-counts"
    whole = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    digests = stage_table(whole.select("k", F.octet_length("t").cast("bigint").alias("n_bytes"), F.sha2("t", 256).alias("digest")), "digests")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    stored = spark.read.schema(CACHE).parquet(cache_path) if fs.exists(fs_path) else spark.createDataFrame([], CACHE)
    stored = stored.where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
    by_text = stage_table(digests.groupBy("digest").agg(F.min("k").alias("mk"), F.count(F.lit(1)).alias("n_rows")), "texts")
    # the row with the smallest key stands for each text that misses; rows that repeat it are counted as well
    miss = by_text.join(stored, "digest", "left_anti").select(F.col("digest").alias("md"), "mk")

    def run(batches):
        lib = counter(path)
        for batch in batches:
            for g in grouped(batch.column(1)):
                for (a, b, _, _), n in zip(g, lib.count_group([p[2:] for p in g]), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([version] * (b - a)), batch.column(0).slice(a, b - a), pa.array(n)], names=["tokenizer", "digest", "n_tokens"])

    rows = whole.withColumn("digest", F.sha2("t", 256)).join(miss, (F.col("digest") == F.col("md")) & F.col("k").eqNullSafe(F.col("mk")))
    fresh = rows.select("digest", "t").mapInArrow(freed(run), CACHE)
    fresh.write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    found = stage_table(by_text.select("digest", "n_rows").join(counts, "digest"), "counts")
    return join_hot(digests, found, "digest", "n_rows").select(F.col("k").alias(key), "n_bytes", "n_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # a cache of its own for each call: the query does the whole job whatever ran before it
    out = count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), cache_path=f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    return out.withColumn("over_limit", F.col("n_tokens") > 512)
