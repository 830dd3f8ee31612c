"""Language-model scoring by logistic context mixing over bits.

Every bit of a text (bytes from the high bit down, with a closing zero byte) is predicted from hashed contexts of the
last 1 to 4 bytes; each context's counts of zeros and ones over all training texts give one prediction. The predictions are combined in the logistic domain by weights that a gate selects (bit place and how often
the longer contexts were met), and an adaptive probability map refines the result. Counts are summed over all training
texts in Spark into tables sized by the number of contexts met (up to LARGEST_BITS, a bound of memory). Weights and map
are learned over every bit of all training texts, text ends included, with the bit's own count taken out: equal (four
bytes, byte) have equal predictions, so rounds of Newton steps run over the counted events, each weighted by its count. Their sums are whole numbers of a fixed unit, so they do not depend on how rows are dealt out. Scoring keeps
the model as learned, so a text's score does not depend on the others.

The base score is the add-one unigram model over words: counts of the frequent words (at most FREQUENT) are
broadcast, the others are joined.

Cases: a null text counts as empty (one end token, one closing byte); without training texts N and V are 0 and
every bit has probability one half; repeated rows each have their score; extra columns are not read; empty input gives
empty output. Words are counted by 64-bit hashes: among V words a new one is taken for a known one with probability
V / 2**64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U64, SlotCache, freed, mix64, parts, read, stage_table, word_hashes
from .langid import crc_rest

ORDERS = (1, 2, 3, 4)  # bytes of context
#: Slots (as powers of two) that the tables of each order may have; order 1 is a plain table.
LARGEST_BITS = {1: 16, 2: 20, 3: 21, 4: 23}
PAIR, WORD = 4, 9  # kinds of counted rows: (last four bytes, byte), and words
FREQUENT = 1 << 19
ROUNDS = 12  # Newton steps at most
RIDGE = 1.0  # pull of a gate's weights to where they start
STEADY = 4.0  # weight of the identity in the probability map
CONF = np.asarray([0, 1, 2, 2, 3, 3, 3, 3] + [4] * 24 + [5] * 225, np.uint8)  # class of a count up to 255
GATES = 8 * 6 * 6


def streams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text and its closing zero one code, the last four bytes and the byte; and each text's
    offsets."""
    n, lens = len(off) - 1, np.diff(off)
    out = np.zeros(len(data) + 5 * n, np.uint8)
    base = off[:-1] + 5 * np.arange(n) + 4
    out[np.arange(len(data)) + np.repeat(base - off[:-1], lens)] = data
    x = out.astype(np.uint32)
    ctx = np.zeros(len(out), np.uint32)
    for j in range(4, 0, -1):
        ctx[j:] = (ctx[j:] << np.uint32(8)) | x[:-j] if len(out) > j else ctx[j:]
    toff = np.concatenate(([0], np.cumsum(lens + 1)))
    at = np.arange(toff[-1]) + np.repeat(base - toff[:-1], lens + 1)
    return (ctx[at].astype(U64) << U64(8)) | out[at].astype(U64), toff


def context(code: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes as a number."""
    return (code >> U64(8)) & U64((1 << 8 * k) - 1)


def start_of(bits: dict[int, int], k: int) -> int:
    return sum(1 << bits[j] for j in ORDERS if j < k)


def slots(c: np.ndarray, node: np.ndarray, k: int, bits: dict[int, int]) -> np.ndarray:
    """Place of (context, bits so far with a leading one) in the common table."""
    x = (c << U64(8)) | node.astype(U64)
    if k > 1:
        x = mix64(x + U64(k << 48)) & U64((1 << bits[k]) - 1)
    return x.astype(np.int64) + start_of(bits, k)


def _squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def _predict(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    a, b = n0.astype(float), n1.astype(float)
    return np.log((b + 0.05) / (a + 0.05))  # finite for any counts


def gate_of(bit: int, conf: dict[int, np.ndarray]) -> np.ndarray:
    return bit * 36 + conf[4].astype(np.int64) * 6 + conf[3]


class Refiner:
    """Adaptive probability map: for each node 25 points over the logistic domain, read by interpolation."""

    def __init__(self):
        self.t = np.tile(_squash(np.linspace(-12, 12, 25)), (256, 1))

    def at(self, node: np.ndarray, x: np.ndarray):
        pos = (np.clip(x, -11.999, 11.999) + 12)
        i = pos.astype(np.int64)
        f = pos - i
        return i, f, self.t[node, i] * (1 - f) + self.t[node, i + 1] * f


class Mixer:
    def __init__(self):
        self.w = np.full((GATES, len(ORDERS)), 0.3)
        self.apm = Refiner()


def training_bits(n0: np.ndarray, n1: np.ndarray, code: np.ndarray, bits: dict[int, int]):
    """For each bit place of the bytes: node, bit, predictions [rows, orders] and gate, without this very bit's count."""
    cs, byte = {k: context(code, k) for k in ORDERS}, (code & U64(255)).astype(np.int64)
    node = np.ones(len(byte), np.int64)
    for bit in range(8):
        y = (byte >> (7 - bit)) & 1
        x, conf = np.empty((len(byte), len(ORDERS))), {}
        for i, k in enumerate(ORDERS):
            s = slots(cs[k], node, k, bits)
            a, b = np.maximum(n0[s] - (1 - y), 0), np.maximum(n1[s] - y, 0)
            x[:, i] = _predict(a, b)
            if k > 2:
                conf[k] = CONF[np.minimum(a + b, 255).astype(np.int64)]
        yield node, y, x, gate_of(bit, conf)
        node = node * 2 + y


def _newton_sums(w: np.ndarray):
    """Fold for _summed: loss, gradient and upper half of the second derivatives of each gate, one after the other."""
    half = [(i, j) for i in range(len(ORDERS)) for j in range(i, len(ORDERS))]

    def fold(total, unit, node, y, x, g, n):
        mixed = (w[g] * x).sum(1)
        p = _squash(mixed)
        err, curve = n * (y - p), n * p * (1 - p)
        loss = n * np.logaddexp(0, np.where(y == 1, -mixed, mixed))
        for c, v in enumerate([loss, *(err * x[:, i] for i in range(len(ORDERS))), *(curve * x[:, i] * x[:, j] for i, j in half)]):
            total[c * GATES : (c + 1) * GATES] += np.bincount(g, np.rint(v * unit), GATES)

    return fold, half


def _map_sums(w: np.ndarray):
    """Fold for _summed: weights and weighted ones at each point of the probability map."""
    apm = Refiner()

    def fold(total, unit, node, y, x, g, n):
        i, f, _ = apm.at(node, (w[g] * x).sum(1))
        for j, part in ((i, n * (1 - f)), (i + 1, n * f)):
            part = np.rint(part * unit)
            total[:6400] += np.bincount(node * 25 + j, part, 6400)
            total[6400:] += np.bincount(node * 25 + j, part * y, 6400)

    return fold


def _summed(pairs: DataFrame, tables, fold, width: int, unit: float) -> np.ndarray:
    """Sums of fold over all pairs (code, n); each task sends one row of `width` numbers."""

    def run(batches):
        n0, n1, bits = tables.value
        total = np.zeros(width)
        for batch in batches:
            code, n = batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy().astype(float)
            for step in training_bits(n0, n1, code, bits):
                fold(total, unit, *step, n)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    got = pairs.mapInArrow(freed(run), "sums binary").toArrow()["sums"].to_pylist()
    return sum((np.frombuffer(x) for x in got), np.zeros(width)) / unit


def learn(pairs: DataFrame, n0: np.ndarray, n1: np.ndarray, bits: dict[int, int]) -> Mixer:
    """Weights and map over every training bit: pairs (code, n) of a byte after its contexts, and its count."""
    mixer, k = Mixer(), len(ORDERS)
    size = pairs.agg(F.sum("n")).first()[0] or 0
    unit = 2.0 ** (52 - int(256 * size).bit_length())  # no sum passes 2**53 units, so every order of adding gives the same
    tables = pairs.sparkSession.sparkContext.broadcast((n0, n1, bits))
    start = mixer.w.copy()
    best, best_loss, step = start.copy(), np.full(GATES, np.inf), np.zeros((GATES, k))
    w = start
    for _ in range(ROUNDS):
        fold, half = _newton_sums(w)
        got = _summed(pairs, tables, fold, (1 + k + len(half)) * GATES, unit).reshape(-1, GATES)
        loss = got[0] + RIDGE / 2 * ((w - start) ** 2).sum(1)
        grad = got[1 : 1 + k].T - RIDGE * (w - start)
        second = np.tile(RIDGE * np.eye(k), (GATES, 1, 1))
        for c, (i, j) in enumerate(half):
            second[:, i, j] += got[1 + k + c]
            if i != j:
                second[:, j, i] += got[1 + k + c]
        better = loss <= best_loss
        best[better], best_loss[better] = w[better], loss[better]
        step = np.where(better[:, None], np.linalg.solve(second, grad[:, :, None])[:, :, 0], step / 4)
        if np.abs(step).max() < 1e-3:
            break
        w = best + step
    mixer.w = best
    got = _summed(pairs, tables, _map_sums(best), 2 * 6400, unit).reshape(2, 256, 25)
    mixer.apm.t = (got[1] + STEADY * mixer.apm.t) / (got[0] + STEADY)
    tables.destroy()
    return mixer


class Model:
    """Fixed tables for scoring: prediction and count class of every slot."""

    def __init__(self, n0: np.ndarray, n1: np.ndarray, mixer: Mixer, bits: dict[int, int]):
        self.bits, self.st = bits, _predict(n0, n1).astype(np.float32)
        self.conf = CONF[np.minimum(n0 + n1, 255).astype(np.int64)]
        self.w, self.apm = mixer.w.astype(np.float32), mixer.apm
        self.known = None

    def __getstate__(self):
        return {**self.__dict__, "known": None}

    def bytes_cost(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each code's byte after its contexts."""
        out = np.zeros(len(code))
        node = np.ones(len(code), np.int64)
        cs = {k: context(code, k) for k in ORDERS}
        b = (code & U64(255)).astype(np.int64)
        for bit in range(8):
            y = (b >> (7 - bit)) & 1
            at = {k: slots(cs[k], node, k, self.bits) for k in ORDERS}
            conf = {k: self.conf[at[k]] for k in (3, 4)}
            w = self.w[gate_of(bit, conf)]
            x = sum(w[:, i] * self.st[at[k]] for i, k in enumerate(ORDERS))
            p = np.clip((_squash(x) + self.apm.at(node, x)[2]) / 2, 1e-6, 1 - 1e-6)
            out += np.log10(np.where(y == 1, p, 1 - p))
            node = node * 2 + y
        return out

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """log10 probability of each text of a part; bytes met in the same contexts before come from a cache."""
        if self.known is None:
            self.known, self.values = SlotCache(20), np.zeros(1 << 20)
        code, toff = streams(data, off)
        key = mix64(code)
        row = self.known.get(key)
        cost = self.values[row]
        miss = np.flatnonzero(row < 0)
        if len(miss):
            uniq, at, back = np.unique(key[miss], return_index=True, return_inverse=True)
            got = np.concatenate([self.bytes_cost(code[miss[at[i : i + (1 << 17)]]]) for i in range(0, len(at), 1 << 17)])
            cost[miss] = got[back]
            slot = (uniq & self.known.mask).astype(np.int64)
            self.known.put(uniq, slot)
            # of keys that clash the one that stayed has its value
            stays = self.known.key[slot] == uniq
            self.values[slot[stays]] = got[stays]
        return np.add.reduceat(cost, toff[:-1])


def _counted(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(np.concatenate(held))
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[at], np.diff(np.append(at, len(s)))


def gather(train: DataFrame) -> DataFrame:
    """train (text) -> (kind, code, n): counts of bytes after their contexts (codes of `streams`), and of words, over all
    texts."""

    def run(batches):
        held: dict[int, list[np.ndarray]] = {PAIR: [], WORD: []}
        size = 0

        def close():
            for kind, x in held.items():
                if x:
                    code, n = _counted(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), kind, np.int8)), pa.array(code.view(np.int64)), pa.array(n)], names=["kind", "code", "n"])
                    x.clear()

        for batch in batches:
            for _, _, data, off in parts(batch.column(0)):
                held[PAIR].append(streams(data, off)[0])
                held[WORD].append(word_hashes(LOWER[data], off)[0])
                size += len(data)
                if size > 8 << 20:
                    yield from close()
                    size = 0
        yield from close()

    return train.mapInArrow(run, "kind tinyint, code bigint, n bigint").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def by_order(pairs: DataFrame) -> DataFrame:
    """pairs (code, n) -> (kind, code, n): counts of (context, byte) for each order."""
    kinds = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("kind"), F.col("code").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("code")) for k in ORDERS])
    return pairs.select(F.inline(kinds), "n").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def table_bits(counts: DataFrame) -> dict[int, int]:
    """Slots for each order, as powers of two: sixteen for each (context, byte) met, which has eight bits, up to LARGEST_BITS."""
    met = {r["kind"]: r["v"] for r in counts.groupBy("kind").agg(F.count(F.lit(1)).alias("v")).collect()}
    return {k: top if k == 1 else int(np.clip(np.ceil(np.log2(16 * met.get(k, 0) + 1)), 10, top)) for k, top in LARGEST_BITS.items()}


def bit_tables(counts: DataFrame, bits: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of every slot of counts by order; one row for a slot at most reaches the driver."""

    def run(batches):
        for batch in batches:
            kind, code, n = (batch.column(i).to_numpy() for i in range(3))
            out = []
            for k in ORDERS:
                m = kind == k
                if not m.any():
                    continue
                c, byte, w = (code[m] >> 8).astype(U64), code[m] & 255, n[m].astype(float)
                node = np.ones(len(c), np.int64)
                for bit in range(8):
                    y = (byte >> (7 - bit)) & 1
                    out.append((slots(c, node, k, bits) * 2 + y, w))
                    node = node * 2 + y
            if out:
                at, w = (np.concatenate(x) for x in zip(*out, strict=True))
                u, back = np.unique(at, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int32)), pa.array(np.bincount(back, w).astype(np.float32))], names=["slot", "n"])

    got = counts.mapInArrow(run, "slot int, n float").groupBy("slot").agg(F.sum("n").cast("float").alias("n")).toArrow()
    both = np.zeros(2 * sum(1 << b for b in bits.values()), np.float32)
    for b in got.to_batches():
        both[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return both[::2].copy(), both[1::2].copy()


def fit(pairs: DataFrame) -> Model:
    """Tables, weights and map from pairs (code, n)."""
    counts = stage_table(by_order(pairs), "lm-orders")
    bits = table_bits(counts)
    n0, n1 = bit_tables(counts, bits)
    return Model(n0, n1, learn(pairs, n0, n1, bits), bits)


def lm_scores(docs: DataFrame, is_train, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score, and bits_per_byte (total bits by bytes, the closing one
    included) for every row of docs; learns from rows is_train."""
    spark = docs.sparkSession
    whole = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t"), F.coalesce(is_train, F.lit(False)).alias("tr"))
    train = whole.where("tr")
    counts = stage_table(gather(train.select("t")), "lm-counts")
    words = counts.where(F.col("kind") == WORD)
    n_docs = train.count()
    hist = words.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("s")).collect()
    n_total, v_total = sum(r["s"] for r in hist) + n_docs, sum(r["v"] for r in hist) + (n_docs > 0)
    low, have = 1 << 62, 0
    for r in sorted(hist, key=lambda r: -r["b"]):
        have += r["v"]
        if have > FREQUENT:
            break
        low = 1 << r["b"]
    often = words.where(F.col("n") >= low).select("code", "n").toArrow()
    f_key = often["code"].to_numpy().view(U64)
    f_order = np.argsort(f_key)
    f_key, f_n = f_key[f_order], often["n"].to_numpy()[f_order]
    pairs = counts.where(F.col("kind") == PAIR).select("code", "n")
    shared = spark.sparkContext.broadcast((f_key, f_n, fit(pairs)))

    names = ["row", "k", "n", "known", "log", "score", "rate", "word"]

    def run(batches):
        f_key, f_n, model = shared.value
        logs = np.log10(f_n + 1.0)
        row_id = TaskContext.get().partitionId() << 40
        end = np.log10(n_docs + 1.0)
        for batch in batches:
            for a, b, data, off in parts(batch.column(1)):
                score = model.score(data, off)
                wh, woff = word_hashes(LOWER[data], off)
                at = np.minimum(np.searchsorted(f_key, wh), max(0, len(f_key) - 1))
                hit = f_key[at] == wh if len(f_key) else np.zeros(len(wh), bool)
                total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[woff])  # noqa: E731, B023
                known = total(hit) + (n_docs > 0)
                log = total(np.where(hit, logs[at], 0.0)) + end if len(f_key) else np.full(b - a, end)
                ids = row_id + np.arange(b - a)
                row_id += b - a
                m = b - a
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0).slice(a, m), pa.array(np.diff(woff) + 1), pa.array(known.astype(np.int64)), pa.array(log), pa.array(score), pa.array(-score / np.log10(2) / (np.diff(off) + 1)), pa.nulls(m, pa.int64())], names=names)
                rest = np.flatnonzero(~hit)
                if len(rest):
                    doc = np.searchsorted(woff, rest, "right") - 1
                    order = np.lexsort((wh[rest], doc))
                    d, w = doc[order], wh[rest][order]
                    first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (w[1:] != w[:-1]))))
                    m = len(first)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[d[first]]), pa.nulls(m, pa.int64()), pa.array(np.diff(np.append(first, len(d)))), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.array(w[first].view(np.int64))], names=names)

    one = stage_table(whole.select(F.col("k").cast("bigint"), "t").mapInArrow(run, "row bigint, k bigint, n bigint, known bigint, log double, score double, rate double, word bigint"), "lm-rows")
    rare = one.where("word is not null").join(words.where(F.col("n") < low).select(F.col("code").alias("word"), F.col("n").alias("c")), "word")
    rare = rare.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_log"))
    out = one.where("word is null").join(rare, "row", "left")
    scale = float(np.log10(n_total + v_total + 1.0))
    return out.select(
        F.col("k").alias(key), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_total).cast("bigint").alias("train_tokens"),
        (F.col("log") + F.coalesce("more_log", F.lit(0.0)) - F.col("n") * F.lit(scale)).alias("base_score"), "score", F.col("rate").alias("bits_per_byte"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    out = lm_scores(docs, crc_rest("doc_id", 7) != 2)
    return out.select("doc_id", (crc_rest("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
