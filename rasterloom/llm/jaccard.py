"""N-gram Jaccard join: a count-vector R-tree over the word shingles of documents.

Shingles are hashed into groups, a document is the point of its group counts, and the summed coordinate minima of
two points bound the overlap of their sets from above. An R-tree of such points (nodes keep coordinate maxima and
size ranges) yields the pairs that the bound lets through; each is verified on the sets.

How it is spread out: equal sets are one class, named by a hash of the set. Sets that link differ in d shingles at
most, d by their sizes; a set is cut into m > d buckets by hash, and at most d of them differ, so the two share one of
the first d + 1 buckets of each in one common order. Long texts have many shingles in common by chance, but hardly a
bucket of several, so they do not run together as the corpus grows. The order puts buckets of frequent shingles (by a
table of fixed size) last and those of many shingles first; m is one for all sizes from a power of two to the next, and
larger sets that reach down there are cut that way too. Below 70 % a bucket is one shingle, of the first n - ceil(t n) +
1. Tokens travel packed, a range of them in one row, and are sorted in arrays. Classes that share
a bucket are connected into clusters by sorted runs and a distributed component search. Inside clusters the R-tree first works on the group counts alone, which splits
clusters that share little; the sets travel only for what it leaves, where pairs are verified. Only texts whose hash is
that of a class with a cluster are cut into shingles for it. Large clusters are
dealt in pairs of blocks, bounded by members and by bytes, so no task holds more than two blocks.

Shingles are compared by 64-bit hashes (a pair of sets of n and m shingles gains a wrong common one with a
probability below n * m / 2**64); classes by 128 bits: where two sets share the first 64, the second 64 name them.

Cases: null or wordless text has no shingles, links with nothing and is its own component; ties and repeated rows
share a class; a null doc_id takes part but never names a component; extra columns are not read; empty input gives
empty output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U64, freed, join_hot, mix64, parts, piece_hashes, read, shingle_hashes, stage_table, tasks, word_bounds
from .graph import local_roots, star_components

LEVEL_BITS = 22  # slots of the frequency table
CLASS_BITS = 23  # bits of the table of texts that stand for the classes that have a cluster
DF_BLOCK = 2_000_000  # shingles a task counts at once
RANGE = 1 << 20  # shingles of classes for each range of tokens, at most
RANGES = 16  # ranges a task, at least
PACK = 1 << 21  # tokens that are packed at once
HELD = 1 << 22  # tokens of one range that are held before runs are cut down
PAIRS = 64  # the longest run of one token whose pairs are looked at one by one
WIDTH = 256  # groups of the points that go ahead of the sets
BLOCK = 2048  # members of a cluster that a task takes at once, twice
BLOCK_BYTES = 32 << 20  # and their sets' bytes


def doc_sets(data: np.ndarray, off: np.ndarray, k: int):
    """The sorted distinct shingle hashes of each text of a part."""
    data = LOWER[data]
    start, end, woff = word_bounds(data, off)
    words = piece_hashes(data, start, end)
    sh, soff = shingle_hashes(words, woff, k)
    for i in range(len(off) - 1):
        s = np.sort(sh[soff[i] : soff[i + 1]])
        if len(s) > 1:
            fresh = s[1:] != s[:-1]
            if not fresh.all():
                s = s[np.concatenate(([True], fresh))]
        yield s


def class_id(s: np.ndarray, doubtful: frozenset = frozenset()) -> int:
    """A 64-bit name of a set; of a set whose first name is doubtful, the second one."""
    first = class_names(s)
    return first[1] if first[0] in doubtful else first[0]


def class_names(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set."""
    m = mix64(s)
    x = (m ^ (m >> U64(32))) * U64(0x6A09E667F3BCC909)
    a, b = m.sum(dtype=U64), (x ^ (x >> U64(29))).sum(dtype=U64)
    a, b = int(a), int(b)
    mixed = lambda x, y: _mix(_mix((x * 0x9E3779B97F4A7C15 + len(s)) & _ALL) ^ y)
    one, two = mixed(a, b), mixed(b, a)
    return one - ((one >> 63) << 64), two - ((two >> 63) << 64)


_ALL = (1 << 64) - 1


def _mix(x: int) -> int:
    """mix64 of one number."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return x ^ (x >> 31)


def _most_apart(a: int, b: int, num: int, den: int) -> int:
    """Shingles that stand in one of two sets only, at most, if the sets are of sizes a and b and link."""
    return (a + b) * (den - num) // (den + num)


SALTS = mix64(np.arange(64, dtype=U64) << U64(40))


def bucket_tokens(s: np.ndarray, level: np.ndarray, num: int, den: int) -> np.ndarray:
    """Tokens of the sorted set s (level: how frequent its shingles are): two sets that link have one in common."""
    n = len(s)
    if 10 * num < 7 * den:
        t = np.sort((level.astype(U64) << U64(58)) | (s >> U64(6)))
        return t[: n - -(-num * n // den) + 1]
    out = []
    own = n.bit_length()
    # the smaller one's size says in which class two sets meet: sizes below 1 << c, of c bits
    for c in range(own, 0, -1):
        top = (1 << c) - 1
        if num * n > den * top:
            break
        m = _most_apart(top, den * top // num, num, den)
        m = max(m + 1, -(-6 * m // 5))
        take = _most_apart(n, den * n // num if c == own else top, num, den) + 1
        g = ((s >> U64(32)) * U64(m)) >> U64(32)  # ascends with s
        at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        size = np.diff(np.append(at, n))
        salt = SALTS[c : c + 1]
        name = mix64(np.add.reduceat(s, at) + salt)  # the shingles are hashes, and say which bucket it is
        t = (np.minimum.reduceat(level, at).astype(U64) << U64(58)) | ((63 - np.minimum(size, 63)).astype(U64) << U64(52)) | (name >> U64(12))
        if take > len(at):  # empty buckets come last
            empty = np.ones(m, bool)
            empty[g[at].astype(np.int64)] = False
            t = np.concatenate((t, (U64(63) << U64(58)) | (mix64(np.flatnonzero(empty).astype(U64) + salt) >> U64(6))))
        out.append(np.sort(t)[:take])
    return np.concatenate(out)


def packed(tok: np.ndarray, rid: np.ndarray, n: np.ndarray, ranges: int) -> pa.RecordBatch:
    """A row for each range of tokens (by their low bits, which are a hash's): range, number, and tokens, classes and
    sizes one after the other."""
    at = ((tok & U64(0xFFFFFFFF)) * U64(ranges)) >> U64(32)
    order = np.argsort(at.astype(np.uint16 if ranges < 1 << 16 else np.uint32), kind="stable")
    at, tok, rid = at[order], tok[order], rid[order]
    n = n[order].astype(np.uint16 if int(n.max()) < 1 << 16 else np.uint32)
    cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    ends = np.append(cut[1:], len(at))
    body = [tok[a:b].tobytes() + rid[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(at[cut].astype(np.int32)), pa.array((ends - cut).astype(np.int32)), pa.array(body, pa.binary())], names=["range", "count", "body"])


def unpacked(count: int, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, classes and sizes of a packed row."""
    wide = np.uint16 if len(body) == 18 * count else np.uint32
    return np.frombuffer(body, U64, count), np.frombuffer(body, np.int64, count, 8 * count), np.frombuffer(body, wide, count, 16 * count).astype(np.int64)


def meetings(tok: np.ndarray, rid: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of classes (u, v) of one token whose sizes allow a link, and the rows that rows to come may still need.

    Runs of one token longer than PAIRS are chained by size, which connects at least as much; of those one row for each
    size is enough to go on with.
    """
    order = np.argsort(tok)
    t = tok[order]
    same = t[1:] == t[:-1]
    met = np.concatenate((same, [False])) | np.concatenate(([False], same))
    alone, order = order[~met], order[met]
    order = order[np.lexsort((rid[order], n[order], tok[order]))]
    t, r, z = tok[order], rid[order], n[order]
    fresh = np.concatenate(([True], (t[1:] != t[:-1]) | (r[1:] != r[:-1])))[: len(t)]
    order, t, r, z = order[fresh], t[fresh], r[fresh], z[fresh]
    length = np.diff(np.append(np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))[: len(t)]), len(t)))
    long = np.repeat(length > PAIRS, length)
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, min(PAIRS, int(length.max(initial=1)) - 1) + 1):
        i = np.flatnonzero(t[d:] == t[:-d])
        if d > 1:
            i = i[~long[i]]
        i = i[(den * z[i] >= num * z[i + d]) & (r[i] != r[i + d])]
        u.append(r[i])
        v.append(r[i + d])
    again = np.concatenate(([False], (t[1:] == t[:-1]) & (z[1:] == z[:-1])))[: len(t)] & long
    return np.concatenate(u), np.concatenate(v), np.concatenate((alone, order[~again]))


class RTree:
    """Points are rows of group counts; a query yields the points whose bound reaches what the threshold needs."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        self.points, self.sizes = points, sizes
        order = np.argsort(sizes, kind="stable")
        slab = max(self.FAN, int(np.sqrt(len(order) / self.FAN)) * self.FAN)
        widest = int(np.argmax(points.var(0))) if len(points) else 0
        order = np.concatenate([c[np.argsort(points[c, widest], kind="stable")] for c in np.split(order, range(slab, len(order), slab))]) if len(order) > slab else order
        self.order = order
        tops, lo, hi = points[order], sizes[order], sizes[order]
        self.levels = [(tops, lo, hi)]
        while len(tops) > self.FAN:
            cut = np.arange(0, len(tops), self.FAN)
            tops, lo, hi = np.maximum.reduceat(tops, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
            self.levels.append((tops, lo, hi))

    def needed(self, a, b):
        """Least overlap of sets of sizes a and b that reaches num/den."""
        t = self.num * (a + b)
        return -(-t // (self.num + self.den))

    def query(self, q: int) -> np.ndarray:
        """Rows, q aside, that q may link with."""
        p, n = self.points[q], self.sizes[q]
        at = np.arange(len(self.levels[-1][0]))
        for d in range(len(self.levels) - 1, -1, -1):
            tops, lo, hi = self.levels[d]
            fit = (self.den * hi[at] >= self.num * n) & (self.num * lo[at] <= self.den * n)
            at = at[fit]
            if not len(at):
                return at
            least = np.maximum(lo[at], -(-self.num * n // self.den))
            at = at[np.minimum(tops[at], p).sum(1, dtype=np.int64) >= self.needed(n, least)]
            if d:
                at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                at = at[at < len(self.levels[d - 1][0])]
        out = self.order[at]
        return out[out != q]


def group_counts(s: np.ndarray, width: int) -> np.ndarray:
    return np.bincount((s & U64(width - 1)).astype(np.int64), minlength=width)


def _search(tree: RTree, accept, side: np.ndarray | None = None) -> np.ndarray:
    """For each point the first point of its component under the tree's pairs that accept(q, c) confirms; with `side`
    only pairs of different sides."""
    root = np.arange(len(tree.sizes))
    for q in range(1, len(root)):
        found = tree.query(q)
        found = found[(found < q) & (root[found] != root[q])]
        if side is not None:
            found = found[side[found] != side[q]]
        while len(found):
            c = int(found[0])
            if accept(q, c):
                a, b = root[q], root[c]
                root[root == max(a, b)] = min(a, b)
                found = found[root[found] != root[q]]
            else:
                found = found[1:]
    return root


def bound_groups(counts: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> np.ndarray:
    """Components by the R-tree's bound alone: sets that link are never apart."""
    points = np.stack(counts).astype(np.int32)
    return _search(RTree(points, points.sum(1, dtype=np.int64), num, den), lambda q, c: True, side)


def link_groups(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each set the index of the first set of its component under Jaccard >= num/den."""
    sizes = np.asarray([len(s) for s in sets], np.int64)
    width = 1 << int(np.clip(np.ceil(np.log2(max(1, np.median(sizes)) / 4)), 5, 11))
    points = np.stack([group_counts(s, width) for s in sets]).astype(np.int32)

    def verify(q: int, c: int) -> bool:
        x, y = (sets[q], sets[c]) if sizes[q] <= sizes[c] else (sets[c], sets[q])
        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        return den * both >= num * (len(x) + len(y) - both)

    return _search(RTree(points, sizes, num, den), verify, side)


def jaccard_components(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id for every row of docs."""
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    hashed = base.withColumn("h", F.xxhash64("t"))
    ints = lambda x: pa.array(np.asarray(x, U64).view(np.int64) if len(x) else np.zeros(0, np.int64))

    def first_pass(batches):
        """kind 0: a document's id, class, size and hash of the text; kind 1: a shingle met in two or more classes of this task, its count."""
        seen, held, n_held = set(), [], 0

        def frequent():
            s = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            n = np.diff(np.append(at, len(s)))
            h, n = s[at][n > 1], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int8)), ints(h), pa.array(n.astype(np.int64)), *[pa.nulls(len(h), pa.int64())] * 3], names=["kind", "a", "b", "c", "d", "e"])

        for batch in batches:
            for a, b, data, off in parts(batch.column(1)):
                rid, other, size = [], [], []
                for s in doc_sets(data, off, k):
                    r, r2 = class_names(s) if len(s) else (None, None)
                    rid.append(r)
                    other.append(r2)
                    size.append(len(s))
                    if r is not None and r not in seen:
                        seen.add(r)
                        held.append(s)
                        n_held += len(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b - a, np.int8)), batch.column(0).slice(a, b - a), pa.array(rid, pa.int64()), pa.array(size, pa.int64()), pa.array(other, pa.int64()), batch.column(2).slice(a, b - a)], names=["kind", "a", "b", "c", "d", "e"])
                if n_held > DF_BLOCK:
                    yield frequent()
                    held, n_held = [], 0
        if held:
            yield frequent()

    one = stage_table(hashed.mapInArrow(freed(first_pass), "kind tinyint, a bigint, b bigint, c bigint, d bigint, e bigint"), "shingle-pass")
    rows = one.where("kind = 0").select(F.col("a").alias("k"), F.col("b").alias("rid"), F.col("c").alias("n"), F.col("d").alias("rid2"), F.col("e").alias("h"))
    # 64-bit names that stand for several sets: about classes ** 2 / 2**65, so 3 among 10 billion
    classes = rows.where("rid is not null").groupBy("rid", "rid2").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"), F.min("h").alias("h"))
    classes = stage_table(classes, "classes")
    doubtful = frozenset(r[0] for r in classes.groupBy("rid").count().where("count > 1").select("rid").collect())
    if doubtful:
        named = lambda df: df.withColumn("rid", F.when(F.col("rid").isin(*doubtful), F.col("rid2")).otherwise(F.col("rid")))
        rows, classes = named(rows), named(classes)
    freq = one.where("kind = 1").groupBy("a").agg(F.sum("b").alias("f")).where("f >= 4")
    slots = freq.groupBy(F.col("a").bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)).cast("int").alias("slot")).agg(F.max(F.floor(F.log2("f"))).cast("tinyint").alias("l")).toArrow()
    level = np.zeros(1 << LEVEL_BITS, np.uint8)  # a table of fixed size
    level[slots["slot"].to_numpy()] = np.minimum(slots["l"].to_numpy(), 60)
    level_b = spark.sparkContext.broadcast(level)

    total = classes.agg(F.sum("n")).first()[0] or 0
    ranges = max(RANGES * tasks(spark), -(-total // RANGE))

    def prefixes(batches):
        table, seen = level_b.value, set()
        for batch in batches:
            tok, rid, size, count = [], [], [], []

            def flush():
                t, r, n = np.concatenate(tok), np.repeat(np.asarray(rid, np.int64), count), np.repeat(np.asarray(size, np.int64), count)
                for part in (tok, rid, size, count):
                    part.clear()
                for i in range(0, len(t), PACK):
                    yield packed(t[i : i + PACK], r[i : i + PACK], n[i : i + PACK], ranges)

            for _, _, data, off in parts(batch.column(1)):
                for s in doc_sets(data, off, k):
                    if not len(s) or (r := class_id(s, doubtful)) in seen:
                        continue
                    seen.add(r)
                    t = bucket_tokens(s, table[(s & U64((1 << LEVEL_BITS) - 1)).astype(np.int64)], num, den)
                    tok.append(t)
                    rid.append(r)
                    size.append(len(s))
                    count.append(len(t))
                if sum(count) > PACK:
                    yield from flush()
            if tok:
                yield from flush()

    def runs(batches):
        """Classes that may link for a token of a range, as edges to the smallest one they reach in it."""
        tag, held, n_held, most = None, [], 0, HELD

        def edges():
            nonlocal held, n_held
            tok, rid, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, v, keep = meetings(tok, rid, n, num, den)
            held, n_held = [(tok[keep], rid[keep], n[keep])], len(keep)
            if len(u):
                node, root = local_roots(u, v)
                off = node != root
                yield pa.RecordBatch.from_arrays([pa.array(node[off]), pa.array(root[off])], names=["u", "v"])

        for batch in batches:
            for at, count, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if at != tag:
                    if held:
                        yield from edges()
                    tag, held, n_held, most = at, [], 0, HELD
                held.append(unpacked(count, body.as_py()))
                n_held += count
                if n_held > most:
                    yield from edges()
                    most = max(HELD, 2 * n_held)
        if held:
            yield from edges()

    tokens = base.mapInArrow(freed(prefixes), "range int, count int, body binary").repartition(tasks(spark), "range").sortWithinPartitions("range")
    clusters = stage_table(star_components(tokens.mapInArrow(freed(runs), "u bigint, v bigint")), "clusters")

    def members(bits, vectors: bool):
        """Arrow function: each class of a text whose hash's bit is set, once a task, with its group counts or its whole set."""

        def run(batches):
            table, seen = bits.value, set()
            for batch in batches:
                slot = batch.column(2).to_numpy() & ((1 << CLASS_BITS) - 1)
                wanted = (table[slot >> 6] >> (slot & 63).astype(U64)) & U64(1) > 0
                for _, _, data, off in parts(batch.column(1).filter(pa.array(wanted))):
                    rid, body = [], []
                    for s in doc_sets(data, off, k):
                        if not len(s) or (r := class_id(s, doubtful)) in seen:
                            continue
                        seen.add(r)
                        rid.append(r)
                        body.append((group_counts(s, WIDTH).astype(np.uint32) if vectors else s).tobytes())
                    if rid:
                        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(body, pa.binary())], names=["rid", "body"])

        return run

    def link(vectors: bool):
        """Arrow function: rows of one (root, i, j) follow each other; what each group joins becomes edges. Two blocks
        that meet look only at pairs across them, as each block also meets itself."""

        def run(batches):
            tag, rid, body, side, out = None, [], [], [], []

            def close():
                if len(body) > 1:
                    sides = np.asarray(side) if tag[1] != tag[2] else None
                    first = bound_groups(body, num, den, sides) if vectors else link_groups(body, num, den, sides)
                    out.extend((rid[x], rid[f]) for x, f in enumerate(first.tolist()) if x != f)

            def flush():
                u, v = zip(*out, strict=True)
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in range(3)]
                own, ids, raw = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)
                for x, t in enumerate(zip(*cols, strict=True)):
                    if t != tag:
                        close()
                        tag, rid, body, side = t, [], [], []
                    if not rid or ids[x] != rid[-1]:
                        rid.append(ids[x])
                        side.append(own[x])
                        body.append(np.frombuffer(raw[x].as_py(), np.uint32 if vectors else U64))
                if out:
                    yield flush()
            close()
            if out:
                yield flush()

        return run

    def joined(clusters: DataFrame, vectors: bool) -> DataFrame:
        """Edges that hold inside clusters (node, root): by the bound of the group counts, or by the sets."""
        known = stage_table(clusters.join(classes.select(F.col("rid").alias("c"), "n", "h"), F.col("node") == F.col("c")).drop("c"), "cluster-members")
        words = known.select(F.col("h").bitwiseAND(F.lit((1 << CLASS_BITS) - 1)).alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
        bitmap = np.zeros(1 << (CLASS_BITS - 6), np.int64)  # a table of fixed size
        bitmap[words["w"].to_numpy()] = words["bits"].to_numpy()
        bits = spark.sparkContext.broadcast(bitmap.view(U64))
        by_bytes = F.lit(1) if vectors else F.ceil(F.sum("n") * 8 / BLOCK_BYTES)
        count = known.groupBy("root").agg(F.count(F.lit(1)).alias("size"), by_bytes.cast("int").alias("nb2")).withColumn("nb", F.greatest(F.ceil(F.col("size") / BLOCK).cast("int"), "nb2"))
        at = join_hot(clusters, stage_table(count.select("root", "size", "nb"), "cluster-sizes"), "root", "size")
        mine = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
        pair = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j")))
        at = at.select("node", "root", mine.alias("own"), F.inline(pair))
        held = hashed.mapInArrow(freed(members(bits, vectors)), "rid bigint, body binary").join(at, F.col("rid") == F.col("node")).select("root", "i", "j", "own", "rid", "body")
        held = held.repartition(tasks(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j", "rid")
        return stage_table(held.mapInArrow(freed(link(vectors)), "u bigint, v bigint"), "links")

    near = stage_table(star_components(joined(clusters, True)), "clusters")
    links = joined(near, False)
    final = star_components(links)
    named = classes.join(final, F.col("rid") == F.col("node"), "left").select("rid", "rows", "first", F.coalesce("root", "rid").alias("g"))
    names = named.groupBy(F.col("g").alias("gg")).agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = stage_table(named, "named")
    named = join_hot(named, stage_table(names.withColumnRenamed("gg", "g"), "names"), "g", "size")
    by_class = stage_table(named.select(F.col("rid"), F.col("rows").alias("n_rows"), "component_id"), "by-class")
    out = join_hot(rows, by_class, "rid", "n_rows")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("rid").isNull(), F.col("k")).otherwise(F.col("component_id")).alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents", "doc_id", "text"))
