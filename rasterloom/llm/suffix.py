"""Suffix-array dedup by two-stage sorting.

Removes every byte that a string of `size` bytes covers which also starts anywhere else in the corpus.

Windows of `size` bytes are dealt by content: the smallest hash of the GRAM-byte strings inside a window is its
anchor, equal windows have equal anchors at equal places, and the windows of one anchor are neighbours, so they
travel together as one extent of text. Anchors whose string stands once in the corpus are dropped by a bitmap sized
by their number (a false positive only costs work). Equal extents, byte by byte, are one string with a multiplicity:
their suffixes are neighbours with all of the extent in common, and every window of them is marked. A task sorts the
suffixes of its extents in blocks of whole anchor groups: suffixes smaller than their successors are sorted directly,
the others are induced by scanning the buckets of first bytes in order, and adjacent common prefixes of `size` bytes
mark both windows.

An anchor with more than HOT extents is split by the bytes around it: the windows that have it in their later half
share the bytes before it, the others those after it, so each half goes by its own, longer common string, and again
by halves where that is hot too, down to single windows. Before each count equal extents are merged on salted keys;
the first time beside the groups that are sorted at once, so that only extents of hot anchors are written and read again.
So no task holds more than HOT extents of a group, and all of them go through the suffix sort. Hashes only choose
anchors and lay rows side by side; what is equal is decided on bytes.

Cases: null text counts as empty; a text shorter than `size` is left alone; repeated rows are copies of each
other; strings are judged on the input; kept columns named like a result give way to it; empty input gives empty output.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEPT, PART, U64, _stream, freed, kept_type, mix64, packed, parts, read, stage_table, tasks, unpacked

GRAM = 32
HOT = 10_000  # extents of an anchor, summed over blocks of tasks, from which its group is split
BLOCK = 1 << 19  # bytes of extents sorted at once

BYTE_CODE = _stream(1, 256)
BASE = int(_stream(2, 1)[0]) | 1
BASE_INV = pow(BASE, -1, 1 << 64)


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown when a longer part needs them."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * PART)
            self.up, self.down = (np.concatenate(([U64(1)], np.cumprod(np.full(m - 1, b, U64), dtype=U64))) for b in (BASE, BASE_INV))
        return self.up[:n], self.down[:n]


powers = _Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums h with one more entry than data: (h[e] - h[s]) * BASE**-s rolls over data[s:e]. Strings may be built
    that share a hash, so it chooses anchors and an order, and never says that strings are equal."""
    h = np.zeros(len(data) + 1, U64)
    up, _ = powers(len(data) + 1)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], dtype=U64, out=h[1:])
    return h


def rolling(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    _, down = powers(len(h))
    return mix64((h[e] - h[s]) * down[s])


def anchors(data: np.ndarray, off: np.ndarray, size: int):
    """Of a part: prefix hashes; and for each anchor its text's row, first and last window start, place, and key."""
    n = len(data)
    h = prefix_hash(data)
    none = np.zeros(0, np.int64)
    lens = np.diff(off)
    valid = np.maximum(lens - size + 1, 0)
    total = int(valid.sum())
    if not total:
        return h, none, none, none, none, np.zeros(0, U64)
    at = np.arange(n - GRAM + 1)
    gram = rolling(h, at, at + GRAM)
    bits = U64(max(1, int(n).bit_length()))
    packed = ((gram >> bits) << bits) | at.astype(U64)
    w = size - GRAM + 1
    pad = (-len(packed)) % w
    rows = np.concatenate((packed, np.full(pad, ~U64(0)))).reshape(-1, w)
    left = np.minimum.accumulate(rows, 1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    doc = np.repeat(np.arange(len(lens)), valid)
    start = np.arange(total) + np.repeat(off[:-1] - np.concatenate(([0], np.cumsum(valid)))[:-1], valid)
    place = (np.minimum(right[start], left[start + w - 1]) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.append(cut[1:], total) - 1
    return h, doc[cut], start[cut], start[last], place[cut], gram[place[cut]]


def two_stage_sort(text: np.ndarray, bounds: np.ndarray, depth: int, real: np.ndarray | None = None) -> np.ndarray:
    """Positions of text (bytes 1..255; strings text[bounds[i]:bounds[i+1]], each with an end below every byte) in the
    order of their suffixes to `depth` bytes; with `real` those positions, and others where they are induced from."""
    n = len(text)
    follow = np.zeros(n, np.uint8)
    follow[:-1] = text[1:]
    follow[bounds[1:] - 1] = 0
    # a suffix is smaller than its successor if the first byte that differs from its own is larger
    differs = follow != text
    nearest = np.minimum.accumulate(np.where(differs, np.arange(n), n - 1)[::-1])[::-1]
    small = follow[nearest] > text
    first = np.zeros(n, bool)
    first[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    used = np.ones(n, bool)
    if real is not None:  # a suffix is induced from the next ones of its string, up to a smaller one
        begin = first.copy()
        begin[1:] |= small[:-1]
        met = np.cumsum(real)
        at = np.flatnonzero(begin)
        used = met > np.repeat(met[at] - real[at], np.diff(np.append(at, n)))
    pos = np.flatnonzero(small & used)
    sorted_small = pos[_direct_order(text, bounds, pos, depth)]
    begin = np.searchsorted(text[sorted_small], np.arange(257))  # sorted, so first bytes ascend
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    # a string's last position is followed by its end only: the smallest in its bucket, induced from the end
    tails = bounds[1:] - 1
    tails = tails[bounds[1:] > bounds[:-1]]
    tails = tails[used[tails]]
    out: list[np.ndarray] = []

    def induce(batch: np.ndarray, c: int) -> list[np.ndarray]:
        before = batch[~first[batch]] - 1
        before = before[~small[before]]
        if not len(before):
            return []
        ch = text[before]
        order = np.argsort(ch, kind="stable")
        before, ch = before[order], ch[order]
        edge = np.flatnonzero(np.concatenate(([True], ch[1:] != ch[:-1]))).tolist()
        same = []
        for a, b in zip(edge, [*edge[1:], len(ch)], strict=True):
            if ch[a] == c:
                same.append(before[a:b])
            else:
                waiting[ch[a]].append(before[a:b])
        return same

    for c in range(1, 256):
        own = tails[(text[tails] == c) & ~small[tails]]
        todo = [own, *waiting[c]]
        while todo:
            batch = np.concatenate(todo) if len(todo) > 1 else todo[0]
            if not len(batch):
                break
            out.append(batch)
            todo = induce(batch, c)
        batch = sorted_small[begin[c] : begin[c + 1]]
        if len(batch):
            out.append(batch)
            induce(batch, c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _same_as_last(text: np.ndarray, p: np.ndarray, size: int) -> np.ndarray:
    """Whether the `size` bytes from each place in p are those from the place before it in p; never the first."""
    same = np.zeros(len(p), bool)
    windows = np.lib.stride_tricks.sliding_window_view(text, size)
    for a in range(0, len(p) - 1, 5_000):
        w = windows[p[a : a + 5_001]]
        w = w.view(np.uint64) if size % 8 == 0 else w
        same[a + 1 : a + len(w)] = (w[1:] == w[:-1]).all(1)
    return same


def _direct_order(text: np.ndarray, bounds: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes at pos by their first `depth` bytes: eight bytes at a time, and of groups that still tie
    only those whose next bytes differ are sorted."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    words = np.ndarray((n + 8,), ">u8", padded, strides=(1,))  # the eight bytes from each position, as one number
    end = bounds[np.searchsorted(bounds, pos, "right")]

    def word(which: np.ndarray, done: int) -> np.ndarray:
        p = pos[which] + done
        left = end[which] - p
        v = words[np.minimum(p, n)].astype(U64)
        short = np.flatnonzero(left < 8)
        if len(short):
            keep = np.clip(left[short], 0, 8)
            drop = ((8 - keep) * 8).astype(U64)
            v[short] = np.where(keep == 0, U64(0), (v[short] >> np.minimum(drop, U64(63))) << np.minimum(drop, U64(63)))
        return v

    v = word(np.arange(len(pos)), 0)
    order = np.argsort(v)
    s = v[order]
    fresh = np.concatenate(([True], s[1:] != s[:-1]))  # a new group begins
    live = np.flatnonzero(~(fresh & np.concatenate((fresh[1:], [True]))))  # places in groups of two or more
    done = 8
    while done < depth and len(live):
        head = fresh[live]
        v = word(order[live], done)
        differ = np.zeros(len(live), bool)
        differ[1:] = ~head[1:] & (v[1:] != v[:-1])
        gid = np.cumsum(head) - 1
        mixed = np.zeros(gid[-1] + 1, bool)
        mixed[gid[differ]] = True
        sub = np.flatnonzero(mixed[gid])
        if len(sub):
            g, w = gid[sub], v[sub]
            by = np.argsort(w, kind="stable")
            by = by[np.argsort(g[by], kind="stable")]
            place = live[sub]
            order[place] = order[place][by]
            g, w = g[by], w[by]
            fresh[place] = np.concatenate(([True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])))
            last = np.concatenate((fresh[1:], [True]))
            live = live[~(fresh[live] & last[live])]
        done += 8
    return order


def repeated_windows(text: np.ndarray, bounds: np.ndarray, real: np.ndarray, size: int) -> np.ndarray:
    """Mask of the positions of text (bytes 1..255) whose window of `size` bytes stands elsewhere too; only windows at
    `real` positions count."""
    hit = np.zeros(len(text), bool)
    order = two_stage_sort(text, bounds, size, real)
    order = order[real[order]]
    twin = np.flatnonzero(_same_as_last(text, order, size)) if len(order) else order  # adjacent common prefixes
    hit[order[twin]] = hit[order[twin - 1]] = True
    # windows of one byte alone may lie apart, before and after the others of their bucket
    change = np.concatenate(([True], text[1:] != text[:-1]))
    change[bounds[:-1]] = True
    at = np.flatnonzero(change)
    length = np.diff(np.append(at, len(text)))
    if (length >= size).any():
        flat = [np.arange(a, a + m - size + 1) for a, m in zip(at[length >= size].tolist(), length[length >= size].tolist(), strict=True)]
        flat = np.concatenate(flat)
        flat = flat[real[flat]]
        for c in np.unique(text[flat]):
            mine = flat[text[flat] == c]
            if len(mine) > 1:
                hit[mine] = True
    return hit


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Bits of the keys (column key) in a table of fixed size."""
    got = keys.select(F.col("key").bitwiseAND(F.lit((1 << bits) - 1)).alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out.view(U64)


def _has(bitmap: np.ndarray, bits: int, key: np.ndarray) -> np.ndarray:
    s = key & U64((1 << bits) - 1)
    return (bitmap[(s >> U64(6)).astype(np.int64)] >> (s & U64(63))) & U64(1) != 0


#: times 0: a finished mark, n windows from start; else an extent (its anchor at byte rel) that stands so often (2: or
#: more). lo and hi: the places its anchor may have in a window.
EXTENT = "key bigint, ext bigint, uid bigint, uid2 bigint, start bigint, n int, rel int, lo int, hi int, times int, text binary"
NAMES = ["key", "ext", "uid", "uid2", "start", "n", "rel", "lo", "hi", "times", "text"]
MARK = "uid bigint, uid2 bigint, a bigint, b bigint"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _finished(uid, uid2, start, n) -> pa.RecordBatch:
    m = len(start)
    none = pa.nulls(m, pa.int64())
    return pa.RecordBatch.from_arrays([_signed(start), none, _signed(uid), _signed(uid2), _signed(start), pa.array(n, pa.int32()), *[pa.nulls(m, pa.int32())] * 3, pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.binary())], names=NAMES)


def _bytes_of(col: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a binary column without nulls."""
    _, off, buf = col.buffers()
    off = np.frombuffer(off, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8), off


def _equal_to_last(t: pa.Table, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows whose extent is, byte by byte, that of the row before, within one key."""
    key, ext, size = t["key"].to_numpy(), t["ext"].to_numpy(), np.diff(off)
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (ext[1:] == ext[:-1]) & (size[1:] == size[:-1])
    at = np.flatnonzero(same)
    if len(at):
        n = size[at]
        o = np.concatenate(([0], np.cumsum(n)))
        i = np.arange(o[-1])
        differ = data[i + np.repeat(off[at] - o[:-1], n)] != data[i + np.repeat(off[at - 1] - o[:-1], n)]
        same[at[np.add.reduceat(differ, o[:-1]) > 0]] = False
    return same


def _groups(batches, ready):
    """Tables of whole keys with about BLOCK bytes of extents; finished marks go to `ready` and what it gives is passed on."""
    pending, held = [], 0
    for batch in batches:
        times = batch.column(NAMES.index("times")).to_numpy()
        if (times == 0).any():
            yield False, ready(batch.filter(pa.array(times == 0)))
            batch = batch.filter(pa.array(times > 0))
        if batch.num_rows:
            pending.append(batch)
            held += batch.column(NAMES.index("text")).nbytes
        if held > BLOCK:
            t = pa.Table.from_batches(pending).combine_chunks()
            for a, b in (cuts := _cuts(t)):
                yield True, t.slice(a, b - a)
            t = t.slice(cuts[-1][1] if cuts else 0)
            pending = t.to_batches()
            held = sum(x.column(NAMES.index("text")).nbytes for x in pending)
    if pending:
        yield True, pa.Table.from_batches(pending).combine_chunks()


def _cuts(t: pa.Table) -> list[tuple[int, int]]:
    """First and end row of runs of whole keys with BLOCK bytes of extents or more, a batch being many times that; what
    may go on is left out."""
    key = t["key"].to_numpy()
    _, off = _bytes_of(t["text"].chunk(0))
    ends = np.flatnonzero(key[1:] != key[:-1]) + 1
    out, a = [], 0
    while (i := int(np.searchsorted(off[ends], off[a] + BLOCK))) < len(ends):
        out.append((a, int(ends[i])))
        a = out[-1][1]
    return out


def _merge(batches):
    """Rows by (key, ext): of extents met twice or more all rows are finished, and one goes on for them."""
    for open_, t in _groups(batches, lambda b: b):
        if open_:
            yield from _merged(t)
        else:
            yield t


def _merged(t: pa.Table):
    data, off = _bytes_of(t["text"].chunk(0))
    fresh = ~_equal_to_last(t, data, off)
    sid = np.cumsum(fresh) - 1
    total = np.bincount(sid, t["times"].to_numpy())
    many = total[sid] > 1
    if many.any():
        yield _finished(*(t[c].to_numpy()[many] for c in ("uid", "uid2", "start", "n")))
    t = t.filter(pa.array(fresh))
    yield from t.set_column(NAMES.index("times"), "times", pa.array(np.minimum(total, 2).astype(np.int32))).to_batches()


def _halves(size: int):
    """Arrow function: each extent as its windows with the anchor in the later and in the earlier half of its range."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                mid, w = (r["lo"] + r["hi"] + 1) // 2, size - GRAM
                first = min(r["n"], max(0, r["rel"] - mid + 1))  # windows that begin mid bytes or more before the anchor
                for i, n, lo, hi in ((0, first, mid, r["hi"]), (first, r["n"] - first, r["lo"], mid - 1)):
                    if n > 0:
                        rel, text = r["rel"] - i, r["text"][i : i + n + size - 1]
                        shared = text[rel - lo : rel + GRAM + w - hi]  # is in every window of this half
                        name = lambda *x: int.from_bytes(hashlib.blake2b(b"".join(x), digest_size=8).digest(), "little", signed=True)
                        rows.append((name(lo.to_bytes(2, "little"), hi.to_bytes(2, "little"), shared), name(text), r["uid"], r["uid2"], r["start"] + i, n, rel, lo, hi, r["times"], text))
            if rows:
                kinds = [pa.int64()] * 5 + [pa.int32()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)

    return run


def _split_hot(live: DataFrame, size: int) -> DataFrame:
    """Merged extents of hot anchors as extents of groups of at most HOT, and finished marks."""
    spark = live.sparkSession
    done: list[DataFrame] = []
    while True:
        hot = live.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("hi") - F.col("lo")).alias("w")).where((F.col("c") > HOT) & (F.col("w") > 0))
        hot = stage_table(hot.select(F.col("key").alias("hk")), "extents-hot")
        done.append(live.join(hot, F.col("key") == F.col("hk"), "left_anti"))
        if not hot.head(1):
            break
        rows = live.join(hot, F.col("key") == F.col("hk"), "left_semi").mapInArrow(freed(_halves(size)), EXTENT)
        salt = F.pmod(F.xxhash64("uid", "uid2", "start"), F.lit(tasks(spark)))
        laid = rows.repartition(tasks(spark), F.col("key"), salt).sortWithinPartitions("key", "ext")
        merged = stage_table(laid.mapInArrow(freed(_merge), EXTENT), "extents-merged")
        done.append(merged.where("times = 0"))
        live = merged.where("times > 0")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def repeat_marks(base: DataFrame, size: int) -> DataFrame:
    """base (uid, uid2, text) -> (uid, uid2, a, b): bytes a to b of that text are covered by repeated strings."""
    spark = base.sparkSession

    def census(batches):
        """Anchor keys of a block of a task with how often they stand and in how many extents."""
        held, n_held = [], 0

        def close():
            key, ext = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ext, key))
            key, ext = key[order], ext[order]
            fresh = np.concatenate(([True], key[1:] != key[:-1]))
            other = fresh | np.concatenate(([True], ext[1:] != ext[:-1]))
            at = np.flatnonzero(fresh)
            return pa.RecordBatch.from_arrays([_signed(key[at]), pa.array(np.diff(np.append(at, len(key)))), pa.array(np.add.reduceat(other.astype(np.int64), at))], names=["key", "c", "d"])

        for batch in batches:
            for _, _, data, off in parts(batch.column(2)):
                h, _, s, e, _, key = anchors(data, off, size)
                if len(s):
                    held.append((key, rolling(h, s, e + size)))
                    n_held += len(s)
            if n_held > 500_000:
                yield close()
                held, n_held = [], 0
        if held:
            yield close()

    keys = stage_table(base.mapInArrow(freed(census), "key bigint, c bigint, d bigint").groupBy("key").agg(F.sum("c").alias("c"), F.sum("d").alias("d")).where("c > 1"), "anchors")
    n_shared, n_hot = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("d") > HOT).cast("bigint")), F.lit(0))).first()
    shared_bits, hot_bits = (int(np.clip(np.ceil(np.log2(16 * n + 1)), 16, 28)) for n in (n_shared, n_hot))  # 32 MB at most
    shared = spark.sparkContext.broadcast(_bitmap(keys, shared_bits))
    hot = spark.sparkContext.broadcast(_bitmap(keys.where(F.col("d") > HOT), hot_bits))
    n_tasks = tasks(spark)

    def extents(batches):
        """Extents of shared anchors; what repeats within a block of a task is marked at once and sent on a single time."""
        held: list[tuple] = []
        texts: dict[bytes, int] = {}
        n_held = n_bytes = 0

        def close():
            tid, key, ext, uid, uid2, start, n, rel = (np.concatenate(x) for x in zip(*held, strict=True))
            times = np.bincount(tid, minlength=len(texts))
            many = times[tid] > 1
            if many.any():
                yield _finished(uid[many], uid2[many], start[many], n[many])
            at = np.zeros(len(texts), np.int64)
            at[tid[::-1]] = np.arange(len(tid))[::-1]  # the first of each
            ranges = [pa.array(np.full(len(at), x, np.int32)) for x in (0, size - GRAM)]
            yield pa.RecordBatch.from_arrays([_signed(key[at]), _signed(ext[at]), _signed(uid[at]), _signed(uid2[at]), _signed(start[at]), pa.array(n[at]), pa.array(rel[at]), *ranges, pa.array(np.minimum(times, 2).astype(np.int32)), pa.array(list(texts), pa.binary())], names=NAMES)

        def salted(out):
            """Rows of hot anchors are dealt by their place too; finished marks stay where they are."""
            if not n_hot:
                return out
            key, uid, start, times = (out.column(NAMES.index(c)).to_numpy() for c in ("key", "uid", "start", "times"))
            place = (mix64(uid.view(U64) + start.view(U64)) % U64(n_tasks)).astype(np.int32) + np.int32(1)
            many = _has(hot.value, hot_bits, key.view(U64)) & (times > 0)
            return out.append_column("salt", pa.array(np.where(many, place, np.int32(0))))

        for batch in batches:
            for a, b, data, off in parts(batch.column(2)):
                h, doc, s, e, p, key = anchors(data, off, size)
                live = _has(shared.value, shared_bits, key)
                if not live.any():
                    continue
                doc, s, e, p, key = (x[live] for x in (doc, s, e, p, key))
                raw = data.tobytes()
                tid = np.asarray([texts.setdefault(raw[i : j + size], len(texts)) for i, j in zip(s.tolist(), e.tolist(), strict=True)])
                uid, uid2 = (batch.column(c).slice(a, b - a).to_numpy()[doc] for c in (0, 1))
                held.append((tid, key, rolling(h, s, e + size), uid, uid2, s - off[doc], (e - s + 1).astype(np.int32), (p - s).astype(np.int32)))
                n_held += len(s)
                n_bytes += int((e - s).sum()) + size * len(s)
                if n_held > 50_000 or n_bytes > 16 << 20:
                    yield from map(salted, close())
                    held.clear()
                    texts.clear()
                    n_held = n_bytes = 0
        if n_held:
            yield from map(salted, close())

    def marks(batches):
        """Rows of one key follow each other, and of one extent: covered bytes of every row."""
        own = lambda b: pa.RecordBatch.from_arrays([b.column(2), b.column(3), b.column(4), pa.array(b.column(4).to_numpy() + b.column(5).to_numpy() - 1 + size)], names=["uid", "uid2", "a", "b"])
        for open_, t in _groups(batches, own):
            yield close(t) if open_ else t

    def close(t: pa.Table) -> pa.RecordBatch:
        data, off = _bytes_of(t["text"].chunk(0))
        fresh = ~_equal_to_last(t, data, off)
        sid = np.cumsum(fresh) - 1
        at = np.flatnonzero(fresh)  # the first row of each string
        key, n = t["key"].to_numpy(), t["n"].to_numpy().astype(np.int64)
        times = np.bincount(sid, t["times"].to_numpy())
        group = np.cumsum(np.concatenate(([True], key[at][1:] != key[at][:-1]))) - 1
        # a window has its twin in another string of its anchor, or in a copy of its own
        sort = np.flatnonzero(np.bincount(group)[group] > 1)
        run_a = run_b = np.zeros(0, np.int64)
        runs = np.zeros(len(at), np.int64)
        if len(sort):
            lens = np.diff(off)[at[sort]]
            bounds = np.concatenate(([0], np.cumsum(lens)))
            i = np.arange(bounds[-1]) + np.repeat(off[at[sort]] - bounds[:-1], lens)
            text = data[i] + np.uint8(1)  # no byte of UTF-8 is 255
            which = np.repeat(np.arange(len(sort)), lens)
            real = np.arange(len(text)) - bounds[which] < n[at[sort]][which]
            hit = (repeated_windows(text, bounds, real, size) | (times[sort] > 1)[which]) & real
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))  # strings end in windows that do not count
            run_a, run_b = edge[::2], edge[1::2]
            of = which[run_a]
            runs[sort] = np.bincount(of, minlength=len(sort))
            run_a, run_b = run_a - bounds[of], run_b - bounds[of]
        rest = np.ones(len(at), bool)
        rest[sort] = False
        begin = np.concatenate(([0], np.cumsum(runs)))
        take = np.where(rest[sid], 0, runs[sid])
        row = np.repeat(np.arange(len(sid)), take)
        which_run = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take) + begin[sid[row]]
        full = np.flatnonzero(rest[sid] & (times[sid] > 1))
        row, a, b = np.concatenate((row, full)), np.concatenate((run_a[which_run], np.zeros(len(full), np.int64))), np.concatenate((run_b[which_run], n[full]))
        start = t["start"].to_numpy()[row]
        return pa.RecordBatch.from_arrays([pa.array(t["uid"].to_numpy()[row]), pa.array(t["uid2"].to_numpy()[row]), pa.array(start + a), pa.array(start + b - 1 + size)], names=["uid", "uid2", "a", "b"])

    def first_marks(batches):
        """Marks of the anchors that are not hot, as finished rows, and merged extents of those that are."""
        for open_, t in _groups(batches, lambda b: b.select(NAMES)):
            if not open_:
                yield t
                continue
            salted = t["salt"].to_numpy() > 0
            t = t.select(NAMES)
            if salted.any():
                yield from _merged(t.filter(pa.array(salted)).combine_chunks())
                t = t.filter(pa.array(~salted)).combine_chunks()
            if t.num_rows:
                uid, uid2, a, b = (c.to_numpy() for c in close(t).columns)
                yield _finished(uid, uid2, a, b - a - size + 1)

    def dealt(rows, *by):
        return rows.repartition(n_tasks, *by).sortWithinPartitions("key", "ext")

    if not n_hot:
        return dealt(base.mapInArrow(freed(extents), EXTENT), "key").mapInArrow(freed(marks), MARK)
    laid = dealt(base.mapInArrow(freed(extents), EXTENT + ", salt int"), "key", "salt")
    most = stage_table(laid.mapInArrow(freed(first_marks), EXTENT), "extents-marked")
    split = dealt(_split_hot(most.where("times > 0"), size), "key").mapInArrow(freed(marks), MARK)
    ended = F.col("start") + F.col("n") - 1 + size
    return most.where("times = 0").select("uid", "uid2", F.col("start").alias("a"), ended.alias("b")).unionByName(split)


RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, *, size: int = 200, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_text: bool = True) -> DataFrame:
    """keep columns, n_bytes, n_removed, n_spans, kept_sha256, and kept_text (whole characters of what is left)."""
    results = [*RESULTS, *["kept_text"] * with_text]
    whole = packed(docs.withColumn(text, F.coalesce(F.col(text), F.lit(""))), keep, text)
    # a row goes by 128 bits of its columns; equal rows have equal spans
    whole = whole.withColumn("__uid", F.xxhash64(KEPT, "__text")).withColumn("__uid2", F.xxhash64(F.lit(1), "__text", KEPT))
    marks = repeat_marks(whole.select(F.col("__uid").alias("uid"), F.col("__uid2").alias("uid2"), F.col("__text").alias("text")), size)
    per = stage_table(marks, "marks").groupBy("uid", "uid2").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    rows = whole.join(per, (whole["__uid"] == per["uid"]) & (whole["__uid2"] == per["uid2"]), "left").select(KEPT, "__text", F.col("spans.a").alias("__a"), F.col("spans.b").alias("__b"))

    def cut(batches):
        for batch in batches:
            for x, y, data, off in parts(batch.column(1)):
                raw = data.tobytes()
                starts, ends = batch.column(2).slice(x, y - x).to_pylist(), batch.column(3).slice(x, y - x).to_pylist()
                n, gone, spans, sha, left = [], [], [], [], []
                for i in range(y - x):
                    t = raw[off[i] : off[i + 1]]
                    out, at, m = [], 0, 0
                    g = 0
                    until = -1
                    for a, b in zip(starts[i] or (), ends[i] or (), strict=True):
                        if a > until or until < 0:
                            m += 1
                            out.append(t[at:a])
                            g += b - a
                        elif b > until:
                            g += b - until
                        at = until = max(until, b)
                    out.append(t[at:])
                    kept = b"".join(out)
                    n.append(len(t))
                    gone.append(g)
                    spans.append(m)
                    sha.append(hashlib.sha256(kept).hexdigest())
                    left.append(kept.decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), *[pa.array(left, pa.string())] * with_text], names=[KEPT, *results])

    schema = ", ".join([kept_type(whole), "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", *["kept_text string"] * with_text])
    return unpacked(rows.mapInArrow(freed(cut), schema), keep, results)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"), with_text=False)
