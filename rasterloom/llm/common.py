"""Shared pieces: vectorised byte/word tools over Arrow string batches, and written stage tables.

A *part* is a run of whole texts of one Arrow batch whose bytes stay under a limit, so the arrays made
from it stay small however many rows a batch has; one text longer than the limit is a part of its own.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = 1 << 18
U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_RE = r"[^\x20\x09-\x0D]+"


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64's)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


PLACES = 64
#: A pseudo-random number for each (place in a span, byte); later places get theirs computed.
CODES = _stream(1, PLACES * 256)
COEF = _stream(3, 64) | U64(1)
BLOCK = 1 << 17  # bytes that are hashed at once


def span_codes(place: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A pseudo-random number for each byte at its place in a span."""
    at = (place << 8) | b
    out = CODES[np.minimum(at, len(CODES) - 1)]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        out[far] = mix64((at[far].astype(U64) + U64(1 << 40)) * U64(0x9E3779B97F4A7C15))
    return out


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans data[s:e]: the sum of a pseudo-random number for each place and byte, then mixed with
    the length. Two spans that differ have equal hashes with probability 2**-64, whatever their structure."""
    size = e - s
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(len(s), U64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1)
        if j == i + 1 and size[i] > BLOCK:  # a long span goes piece by piece
            total = 0
            for a in range(0, int(size[i]), BLOCK):
                piece = data[s[i] + a : min(s[i] + a + BLOCK, e[i])].astype(np.int64)
                total += int(span_codes(np.arange(a, a + len(piece)), piece).sum(dtype=U64))
            out[i] = total & (1 << 64) - 1
        else:
            off = ends[i : j + 1] - ends[i]
            place = np.arange(off[-1]) - np.repeat(off[:-1], size[i:j])
            code = span_codes(place, data[place + np.repeat(s[i:j], size[i:j])].astype(np.int64))
            sums = np.concatenate((np.zeros(1, U64), np.cumsum(code, dtype=U64)))
            out[i:j] = sums[off[1:]] - sums[off[:-1]]
        i = j
    return mix64(out + size.astype(U64) * COEF[63])


PIECES = _stream(5, 32)  # a number for each place of a piece of 8 bytes
FIRST = np.asarray([(1 << 8 * i) - 1 for i in range(9)], U64)


def piece_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """As span_hashes, with other numbers and in fewer steps: the sum of the mixed pieces of 8 bytes, each with a number
    of its place, then mixed with the length. Spans of up to 8 bytes never clash with one another, others with
    probability 2**-64; those of more than 256 bytes go by span_hashes."""
    size = e - s
    wide = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    out = mix64((wide[s] & FIRST[np.minimum(size, 8)]) + PIECES[0])
    at = np.arange(len(s))
    for i in range(1, len(PIECES)):
        at = at[size[at] > 8 * i]
        if not len(at):
            break
        out[at] += mix64((wide[s[at] + 8 * i] & FIRST[np.minimum(size[at] - 8 * i, 8)]) + PIECES[i])
    out = mix64(out + size.astype(U64) * COEF[63])
    long = np.flatnonzero(size > 8 * len(PIECES))
    if len(long):
        out[long] = span_hashes(data, s[long], e[long])
    return out


def text_array(col) -> pa.Array:
    """The column as one string array; null texts become empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col, "")


def parts(col, limit: int = PART):
    """(first row, end row, bytes, offsets within the bytes) for whole texts, about `limit` bytes at a time."""
    col = text_array(col)
    n = len(col)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, buf = col.buffers()
    off = np.frombuffer(off, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and offsets of each text's words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word as it stands in data, and offsets of each text's words."""
    s, e, woff = word_bounds(data, off)
    return span_hashes(data, s, e), woff


def shingle_hashes(words: np.ndarray, woff: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, repeats included, and their offsets.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    counts = np.diff(woff)
    n = len(words)
    roll = np.zeros(n, U64)
    for j in range(min(k, n)):
        roll[: n - j] += words[j:] * COEF[j]
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    soff = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(woff[:-1] - soff[:-1], sizes) + np.arange(soff[-1])
    out = mix64(roll[at])
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        w = words[woff[i] : woff[i + 1]]
        out[soff[i]] = mix64(np.asarray([(w * COEF[: len(w)]).sum(dtype=U64) + U64(len(w))], U64))[0]
    return out, soff


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def freed(run):
    """A function over batches whose worker gives free memory back to the system after each batch and when the task ends:
    workers stay for later stages, and what one stage needed would otherwise add to the next one's."""

    def task(batches):
        def each():
            for batch in batches:
                yield batch
                _give_back()

        try:
            yield from run(each())
        finally:
            _give_back()

    return task


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, on one machine, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="rasterloom-"))
        base = _OWN[0]
    return base.rstrip("/")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Partitions for shuffles that Python code reads whole."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


#: The column that carries the columns of `keep` through Arrow functions, whatever their names are.
KEPT = "__kept"


def packed(docs: DataFrame, keep, text: str) -> DataFrame:
    """docs as (__kept: struct of the columns of keep, __text), so that no name can clash with a result's."""
    keep = list(dict.fromkeys(keep))
    body = F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]) if keep else F.struct(F.lit(None).cast("int").alias("_"))
    return docs.select(body.alias(KEPT), F.col(f"`{text}`").cast("string").alias("__text"))


def kept_type(df: DataFrame) -> str:
    return f"{KEPT} {df.schema[KEPT].dataType.simpleString()}"


def unpacked(df: DataFrame, keep, results) -> DataFrame:
    """The kept columns, but for those named like a result, then the results."""
    taken = {c.lower() for c in results}
    return df.select(*[F.col(f"{KEPT}.`{c}`").alias(c) for c in dict.fromkeys(keep) if c.lower() not in taken], *results)


def join_hot(left: DataFrame, right: DataFrame, key: str, count: str, *, hot: int = 20_000) -> DataFrame:
    """left joined (left outer) to right on the column `key`, which right holds once; `count` is the number of rows of
    left that have that key. Keys with more than `hot` rows, and more than one in 100,000 of all, are at most 100,000:
    they are broadcast, so their rows stay where they are; the others are shuffled. Both sides should be written
    tables, as each is read twice. Rows of left with a null key stay with nulls."""
    total = right.agg(F.sum(count)).first()[0] or 0
    limit = max(hot, total // 100_000)
    values = [c for c in right.columns if c not in (key, count)]
    name = "__right_key"
    side = right.withColumnRenamed(key, name)
    often = side.where(F.col(count) > limit).drop(count)
    if total <= hot or not often.head(1):
        return left.join(side.drop(count), F.col(key) == F.col(name), "left").drop(name)
    near = F.broadcast(often)
    out = left.join(near, F.col(key) == F.col(name)).drop(name)
    rest = left.join(F.broadcast(often.select(name)), F.col(key) == F.col(name), "left_anti")
    return out.unionByName(rest.join(side.where(F.col(count) <= limit).drop(count), F.col(key) == F.col(name), "left").drop(name)).select(*left.columns, *values)


class SlotCache:
    """Direct-mapped cache from a 64-bit key to a row number; memory is fixed, a clash overwrites."""

    def __init__(self, bits: int):
        self.key = np.zeros(1 << bits, U64)
        self.row = np.full(1 << bits, -1, np.int32)
        self.mask = U64((1 << bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys & self.mask).astype(np.int64)
        return np.where(self.key[slot] == keys, self.row[slot], -1)

    def put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        slot = (keys & self.mask).astype(np.int64)
        self.key[slot] = keys
        self.row[slot] = rows


def same_bytes(data: np.ndarray, s: np.ndarray, e: np.ndarray, other: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether data[s:e] is what other holds from begin on, for spans of one byte and more."""
    n = e - s
    off = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(off[-1])
    differ = data[at + np.repeat(s - off[:-1], n)] != other[at + np.repeat(begin - off[:-1], n)]
    return np.add.reduceat(differ, off[:-1]) == 0 if differ.any() else np.ones(len(s), bool)


def distinct(data: np.ndarray, s: np.ndarray, e: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one span for each text among data[s:e], and for each span which of those it is. Equal keys are looked
    at byte by byte; spans that share a key with another text stand for themselves."""
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    lead = first[back]
    same = (e - s) == (e - s)[lead]
    long = np.flatnonzero(same & (e - s > 7) & (lead != np.arange(len(s))))
    if len(long):
        same[long] = same_bytes(data, s[long], e[long], data, s[lead[long]])
    odd = np.flatnonzero(~same)
    back[odd] = len(first) + np.arange(len(odd))
    return np.concatenate((first, odd)), back


class Known:
    """Pre-tokens met before, with two numbers each: at most 2**bits of them and 16 bytes for each, then it starts anew.
    A hit counts only if the bytes agree: keys of spans under 8 bytes are the bytes themselves, longer spans are
    compared with the ones held."""

    LONGEST = 4096  # longer spans are not held

    def __init__(self, bits: int = 20):
        self.slots, self.most, self.full, self.bits = SlotCache(bits), 1 << bits, 16 << bits, bits
        self.begin, self.size, self.a, self.b = (np.zeros(1 << 12, np.int32) for _ in range(4))
        self.pool = np.zeros(1 << 16, np.uint8)
        self.rows = self.used = 0

    def room(self, n: int, total: int) -> bool:
        return self.rows + n <= self.most and self.used + total <= self.full

    def find(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The row of each span, or -1."""
        row = self.slots.get(keys)
        hit = np.flatnonzero(row >= 0)
        r, size = row[hit], (e - s)[hit]
        same = self.size[r] == size
        long = np.flatnonzero(same & (size > 7))
        if len(long):
            at = hit[long]
            same[long] = same_bytes(data, s[at], e[at], self.pool, self.begin[r[long]])
        row[hit[~same]] = -1
        return row

    def add(self, spans: list[bytes], keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        size = np.fromiter(map(len, spans), np.int64, len(spans))
        small = size <= self.LONGEST
        if not small.all():
            spans = [x for x, k in zip(spans, small.tolist(), strict=True) if k]
            keys, a, b, size = keys[small], a[small], b[small], size[small]
        n, total = len(spans), int(size.sum())
        if not self.room(n, total):
            self.__init__(self.bits)
        if not self.room(n, total):
            return
        if self.rows + n > len(self.a):
            more = max(self.rows + n, 2 * len(self.a)) - len(self.a)
            self.begin, self.size, self.a, self.b = (np.concatenate((x, np.zeros(more, np.int32))) for x in (self.begin, self.size, self.a, self.b))
        if self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(self.used + total, 2 * len(self.pool)) - len(self.pool), np.uint8)))
        new = slice(self.rows, self.rows + n)
        self.pool[self.used : self.used + total] = np.frombuffer(b"".join(spans), np.uint8)
        self.begin[new] = self.used + np.concatenate(([0], np.cumsum(size)))[:-1]
        self.size[new], self.a[new], self.b[new] = size, a, b
        self.slots.put(keys, np.arange(self.rows, self.rows + n))
        self.rows, self.used = self.rows + n, self.used + total
