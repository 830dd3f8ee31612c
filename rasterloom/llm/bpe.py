"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens not seen before are laid end to end as one linked list of symbols. Every neighbouring pair that is a
token has its position in the bucket of the token's rank; a three-level bitmap of 64-bit words tells the lowest
non-empty bucket by find-first-set. A bucket is taken at once: positions whose pair has changed since are stale and
skipped, overlapping ones go left to right, merges put new pairs into their buckets (also into lower ones). As
pre-tokens never merge with each other, one queue serves them all, and a very long pre-token costs no more per byte
than short ones.

Cases: null and empty texts have no tokens; repeated rows and null ids come as they are; ids decode to the exact
bytes; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEPT, PART, U64, Known, distinct, freed, kept_type, packed, parts, read, unpacked
from .pretoken import pretoken_keys, pretokens

NONE = np.int64(-1)


def _ordered(pos: np.ndarray) -> np.ndarray:
    """Sorted, each position once."""
    pos = np.sort(pos)
    fresh = pos[1:] != pos[:-1]
    return pos if fresh.all() else pos[np.concatenate(([True], fresh))]


class RankQueue:
    """Buckets per rank; a set bit at each level says that something below is not empty."""

    def __init__(self, ranks: int):
        self.bucket: list[list] = [[] for _ in range(ranks)]
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0

    def push(self, rank: int, positions) -> None:
        b = self.bucket[rank]
        if not b:
            i = rank >> 6
            self.low[i] |= 1 << (rank & 63)
            self.mid[i >> 6] |= 1 << (i & 63)
            self.top |= 1 << (i >> 6)
        b.append(positions)

    def pop(self) -> tuple[int, list]:
        """The lowest rank that has positions, and its bucket, now empty; rank -1 if there is none."""
        if not self.top:
            return -1, []
        first = lambda x: (x & -x).bit_length() - 1
        k = first(self.top)
        j = (k << 6) + first(self.mid[k])
        r = (j << 6) + first(self.low[j])
        got, self.bucket[r] = self.bucket[r], []
        self.low[j] &= ~(1 << (r & 63))
        if not self.low[j]:
            self.mid[k] &= ~(1 << (j & 63))
            if not self.mid[k]:
                self.top &= ~(1 << k)
        return r, got


class Ranks:
    """A rank table: bytes of every token, and the rank of each pair of tokens whose bytes together are a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(table.values()) + 1
        self.bytes = [b""] * self.size
        for t, r in table.items():
            self.bytes[r] = t
        self.byte_id = np.asarray([table[bytes([i])] for i in range(256)], np.int64)
        # every split of every token into two tokens
        left, right, rank = [], [], []
        for t, r in table.items():
            for i in range(1, len(t)):
                a = table.get(t[:i])
                if a is not None and (b := table.get(t[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        key = (np.asarray(left, np.int64) << 20) | np.asarray(right, np.int64)
        bits = 20
        while True:  # a hash table without clashes inside four probes
            cap = 1 << bits
            self.keys, self.vals, self.mask = np.full(cap + 4, NONE), np.full(cap + 4, NONE), cap - 1
            todo = np.arange(len(key))
            slot = self._slot(key)
            for probe in range(4):
                at = slot[todo] + probe
                free = self.keys[at] == NONE
                cand, pos = todo[free], at[free]
                _, one = np.unique(pos, return_index=True)
                self.keys[pos[one]] = key[cand[one]]
                self.vals[pos[one]] = np.asarray(rank, np.int64)[cand[one]]
                todo = todo[self.keys[at] != key[todo]]
            if not len(todo):
                break
            bits += 1
        self.len = np.asarray([len(t) for t in self.bytes], np.int64)
        # a token that is the head or tail of a token of lower rank can give a lower pair: such a merge must go
        # one by one in each pre-token
        self.careful = np.zeros(self.size, bool)
        for t, r in table.items():
            for i in range(1, len(t)):
                for piece in (t[:i], t[i:]):
                    p = table.get(piece)
                    if p is not None and p > r:
                        self.careful[p] = True

    def _slot(self, key: np.ndarray) -> np.ndarray:
        x = key.astype(U64) * U64(0x9E3779B97F4A7C15)
        return ((x >> U64(32)) & U64(self.mask)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 20) | b
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.vals[slot], NONE)
        rest = np.flatnonzero((out < 0) & (self.keys[slot] != NONE))
        for probe in range(1, 4):
            at = slot[rest] + probe
            hit = self.keys[at] == key[rest]
            out[rest[hit]] = self.vals[at[hit]]
            rest = rest[~hit]
        return out

    def merge(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pre-tokens data[off[i]:off[i+1]], end to end, and their offsets."""
        n = len(data)
        kind = np.int32 if n < 1 << 30 else np.int64
        tok = self.byte_id[data].astype(np.int32)
        nxt = np.arange(1, n + 2, dtype=kind)
        prv = np.arange(-1, n, dtype=kind)
        word = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
        end = np.zeros(n + 1, bool)  # the last symbol of a pre-token
        end[off[1:] - 1] = True
        first = np.zeros(n + 1, bool)
        first[off[:-1]] = True
        alive = np.ones(n, bool)
        queue = RankQueue(self.size)
        pair_rank = np.full(n + 1, -1, np.int32)

        def put(pos: np.ndarray) -> None:
            """Rank the pairs that begin at pos and queue them."""
            pos = pos[~end[pos]]
            if not len(pos):
                return
            r = self.pair(tok[pos], tok[nxt[pos]])
            pair_rank[pos] = r
            ok = r >= 0
            pos, r = pos[ok], r[ok]
            if not len(pos):
                return
            if len(pos) == 1:
                queue.push(int(r[0]), pos)
                return
            order = np.argsort(r, kind="stable")
            pos, r = pos[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(r)], strict=True):
                queue.push(int(r[a]), pos[a:b])

        put(np.arange(n, dtype=kind))
        while True:
            rank, got = queue.pop()
            if rank < 0:
                break
            pos = np.concatenate(got) if len(got) > 1 else got[0]
            pos = pos[alive[pos] & (pair_rank[pos] == rank)]  # others are stale
            if not len(pos):
                continue
            if len(pos) > 1:
                pos = _ordered(pos)
                if self.careful[rank]:  # the leftmost of each pre-token; the others wait in the bucket
                    lead = np.ones(len(pos), bool)
                    lead[1:] = word[pos[1:]] != word[pos[:-1]]
                    if not lead.all():
                        queue.push(rank, pos[~lead])
                    pos = pos[lead]
                else:  # of pairs that overlap in a chain every second one, from the left
                    chain = np.zeros(len(pos), bool)
                    chain[1:] = nxt[pos[:-1]] == pos[1:]
                    if chain.any():
                        at = np.arange(len(pos))
                        head = np.maximum.accumulate(np.where(chain, 0, at))
                        pos = pos[(at - head) % 2 == 0]
            gone = nxt[pos]
            tok[pos] = rank
            alive[gone] = False
            after = nxt[gone]
            nxt[pos] = after
            prv[np.minimum(after, n)] = pos
            end[pos] = end[gone]
            pair_rank[pos] = NONE
            before = prv[pos][~first[pos]]
            put(_ordered(np.concatenate((before, pos))))
        keep = np.flatnonzero(alive)
        return tok[keep], np.searchsorted(keep, off)


@cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


class Encoder:
    """Encodes parts of texts; ids of pre-tokens met before come from a cache of bounded size that is emptied when full."""

    def __init__(self, path: str, *, slots: int = 20, full: int = 6_000_000):
        self.ranks, self.full = ranks(path), full
        self.known = Known(slots)
        self.ids = np.zeros(1 << 16, np.uint16 if self.ranks.size <= 1 << 16 else np.uint32)
        self.used = 0

    def encode_group(self, group: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each part (bytes, offsets) the ids of its texts end to end and each text's offsets; one queue merges
        the new pre-tokens of all parts of the group, each distinct one once."""
        held: list[tuple] = []
        fresh: dict[bytes, int] = {}
        fresh_keys: list[int] = []
        for data, off in group:
            starts, toff = pretokens(data, off)
            keys = pretoken_keys(data, starts)
            row = self.known.find(data, starts[:-1], starts[1:], keys)
            miss = np.flatnonzero(row < 0)
            first, back = distinct(data, starts[miss], starts[miss + 1], keys[miss])
            at = np.empty(len(first), np.int64)
            for m, (i, j, key) in enumerate(zip(starts[miss[first]].tolist(), starts[miss[first] + 1].tolist(), keys[miss[first]].tolist(), strict=True)):
                at[m] = fresh.setdefault(data[i:j].tobytes(), len(fresh))
                if at[m] == len(fresh_keys):
                    fresh_keys.append(key)
            which = at[back]
            held.append((row, miss, which, toff))
        spans = list(fresh)
        moff = np.concatenate(([0], np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)))))
        ids, ioff = self.ranks.merge(np.frombuffer(b"".join(spans), np.uint8), moff)
        own = ids.astype(self.ids.dtype)
        out = []
        for row, miss, which, toff in held:
            begin, count = self.known.a[row].astype(np.int64), self.known.b[row].astype(np.int64)
            begin[miss], count[miss] = ioff[which] + self.used, ioff[which + 1] - ioff[which]
            total = np.concatenate(([0], np.cumsum(count)))
            index = np.repeat(begin - total[:-1], count) + np.arange(total[-1])
            got = np.empty(len(index), np.uint32)
            old = index < self.used
            got[old] = self.ids[index[old]]
            got[~old] = own[index[~old] - self.used]
            out.append((got, total[toff]))
        self._hold(spans, fresh_keys, own, ioff)
        return out

    def _hold(self, spans: list[bytes], keys: list[int], own: np.ndarray, ioff: np.ndarray) -> None:
        if not spans or len(own) > self.full:
            return
        if self.used + len(own) > self.full or not self.known.room(len(spans), sum(map(len, spans))):
            self.known, self.used = Known(self.known.bits), 0
        need = self.used + len(own)
        if need > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(max(need, len(self.ids)), self.ids.dtype)))
        self.ids[self.used : need] = own
        self.known.add(spans, np.asarray(keys, U64), self.used + ioff[:-1], np.diff(ioff))
        self.used = need

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_group([(data, off)])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.ranks.bytes.__getitem__, ids.tolist()))


@cache
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


def grouped(col, limit: int = PART, parts_each: int = 16):
    """Lists of up to parts_each parts of a column."""
    group = []
    for part in parts(col, limit):
        group.append(part)
        if len(group) == parts_each or part[2].size > 2 * limit:
            yield group
            group = []
    if group:
        yield group


def bpe_encode(docs: DataFrame, path: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = True, digests: bool = False) -> DataFrame:
    """keep columns, n_tokens, ids (if asked), and with `digests` the sha256 of ids and of the decoded bytes. A kept
    column named like a result gives way to it."""
    results = ["n_tokens", *["ids"] * with_ids, *["ids_sha256", "decoded_sha256"] * digests]
    base = packed(docs, keep, text)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for a, b, ids, ioff in ((p[0], p[1], *r) for g in grouped(batch.column(1)) for p, r in zip(g, enc.encode_group([p[2:] for p in g]), strict=True)):
                cols = [batch.column(0).slice(a, b - a), pa.array(np.diff(ioff), pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(ioff, pa.int32()), pa.array(ids.astype(np.int32))))
                if digests:
                    each = [ids[ioff[i] : ioff[i + 1]] for i in range(b - a)]
                    cols.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string()))
                    cols.append(pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in each], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[KEPT, *results])

    schema = ", ".join([kept_type(base), "n_tokens bigint", *["ids array<int>"] * with_ids, *["ids_sha256 string, decoded_sha256 string"] * digests])
    return unpacked(base.mapInArrow(freed(run), schema), keep, results)


def bpe_decode(rows: DataFrame, path: str, *, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """keep columns (but for one named so) and the decoded bytes as `data`; a null list gives null, a null id nothing."""
    keep = [c for c in dict.fromkeys(keep) if c.lower() != "data"]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["data binary"])

    def run(batches):
        table = ranks(path).bytes
        for batch in batches:
            got = [None if x is None else b"".join(table[i] for i in x if i is not None) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(got, pa.binary())], names=[*keep, "data"])

    return rows.select(*keep, F.col(ids).alias("__ids")).mapInArrow(freed(run), schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_encode(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False, digests=True)
