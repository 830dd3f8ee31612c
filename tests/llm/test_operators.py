"""The corpus operators against brute force on small fixtures with nulls, empty and odd texts, copies and ties."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from rasterloom.llm import bpe, counts, jaccard, langid, lm, mixing, quality, shards, suffix, topk
from rasterloom.llm.common import parts, shingle_hashes

R = random.Random(5)
WORDS = ["ab", "Cd", "e", "fgh", "#x", "1", "ü", "the", " q"]
LONG = " ".join(R.choice(WORDS) for _ in range(120))
TEXTS = [None, "", " \n\t ", "one two", "One TWO", LONG, LONG, LONG + " tail", "x " + LONG, "é" * 150 + "q", "é" * 150 + "z", "a" * 450, "1 2 3 4 5\n1 2 3 4 5\n\n7"]
TEXTS += [" ".join(R.choice(WORDS) for _ in range(R.randint(0, 90))) for _ in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s0"][i % 3 if i % 5 else 1], 7, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_shingles int, size string")


def words(t):
    return (t or "").encode().lower().split()


def test_jaccard_components(docs):
    sets = [({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()) for w in map(words, TEXTS)]
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_shingles_of_parts_with_few_words(spark):
    w = np.arange(11, 18, dtype=np.uint64)
    long, _ = shingle_hashes(w, np.asarray([0, 7]))
    for n in range(8):
        got, off = shingle_hashes(w[:n], np.asarray([0, n]))
        assert off.tolist() == [0, max(n - 4, min(n, 1))] and len(set(got.tolist())) == len(got) == off[-1]
        assert n < 5 or got.tolist() == long[: n - 4].tolist()
    for cut in ([0, 1, 2], [0, 0, 2, 3], [0, 1, 3]):  # few words in several texts: as each alone
        got, off = shingle_hashes(w, np.asarray(cut))
        alone = [shingle_hashes(w[a:b], np.asarray([0, b - a]))[0].tolist() for a, b in zip(cut, cut[1:])]
        assert [got[a:b].tolist() for a, b in zip(off, off[1:])] == alone
    for t, n in (("one two", 1), ("one two three", 1), ("a b c d", 1), ("one", 1), ("", 0)):
        lone = spark.createDataFrame([(4, t)], "doc_id long, text string")
        assert [tuple(r) for r in jaccard.jaccard_components(lone).select("doc_id", "n_shingles", "component_id").collect()] == [(4, n, 4)]


def test_rtree_bound_loses_nothing():
    g = np.random.default_rng(1)
    base = g.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[: g.integers(200, 300)], g.integers(0, 2**63, g.integers(0, 60), dtype=np.uint64)))) for _ in range(80)]
    tree = jaccard.RTree(np.stack([jaccard.group_counts(s, 64) for s in sets]).astype(np.int32), np.asarray([len(s) for s in sets]), 80, 100)
    for i, a in enumerate(sets):
        found = set(tree.query(i).tolist())
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if i != j and 100 * both >= 80 * (len(a) + len(b) - both):
                assert j in found


def test_suffix_dedup(docs):
    raw = [(t or "").encode() for t in TEXTS]
    seen = Counter(t[p : p + 200] for t in raw for p in range(len(t) - 199))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs).collect()}
    for i, t in enumerate(raw):
        m = np.zeros(len(t), int)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                m[p : p + 200] = 1
        kept = bytes(c for c, x in zip(t, m, strict=True) if not x)
        assert got[i] == (len(t), m.sum(), (np.diff(np.concatenate(([0], m))) == 1).sum(), hashlib.sha256(kept).hexdigest())


def test_two_stage_sort_orders_suffixes():
    strings = [bytes(R.choice(b"ab\x00") for _ in range(R.randint(1, 60))) for _ in range(40)]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
    text = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
    order = suffix.two_stage_sort(text, bounds, 64)
    which = np.searchsorted(bounds, order, "right") - 1
    seq = [text[p : bounds[w + 1]].tobytes() for p, w in zip(order, which, strict=True)]
    assert len(order) == len(text) and seq == sorted(seq)


def test_quality_statistics_and_rules(spark, docs):
    rows = {r.doc_id: r for r in quality.text_stats(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        hit = {x for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for x in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        assert tuple(rows[i][c] for c in quality.STATS) == want
    x = np.random.default_rng(0).random((600, 2))
    bad = (x[:, 0] > 0.8) & (x[:, 1] < 0.5)
    rules = quality.learn_rules(x, bad, ["n_words", "mean_word"])
    hit = np.zeros(600, bool)
    for r in rules:
        hit |= quality._mask(x, ["n_words", "mean_word"], r)
    assert rules and (hit == bad).mean() > 0.97
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.quality_rules(docs, none).collect()
    assert len(out) == len(TEXTS) and all(r.kept != r.base_failed for r in out)


def test_mixing(docs):
    out = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    assert len(out) == len(TEXTS) and out == {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    assert sum({r.target for r in out.values()}) == pytest.approx(1.5 * sum(r.size for r in out.values()))
    per = {}
    for r in out.values():
        assert r.taken <= 2 * r.size and r.size == len(words(TEXTS[r.doc_id]))
        per.setdefault(r.target, []).append(r)
    for target, rows in per.items():
        assert abs(sum(r.taken for r in rows) - target) <= max(r.size for r in rows)


def test_bpe_and_counts(spark, docs):
    path = P.path("byte_bpe_50k.tiktoken")
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
    texts = TEXTS + ["".join(R.choice("ab cd's'tll're ve\n\t 09é漢!'’\x1c\x85😀") for _ in range(R.randint(0, 50))) for _ in range(3000)] + ["ab" * 5000, "etaoin" * 900]
    enc = bpe.Encoder(path)
    for a, b, data, off in parts(pa.array(texts)):
        ids, ioff = enc.encode(data, off)
        for i in range(b - a):
            own = ids[ioff[i] : ioff[i + 1]]
            assert own.tolist() == ref.encode_ordinary(texts[a + i] or "") and enc.decode(own) == (texts[a + i] or "").encode()
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    special = spark.createDataFrame([(99, "a<|endoftext|> b<|endoftext|>"), (100, None)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(special)
    want = {i: len(lib.encode(t or "", add_special_tokens=False)) for i, t in [*enumerate(TEXTS), (99, "a<|endoftext|> b<|endoftext|>"), (100, "")]}
    for _ in range(2):  # the second time from the cache
        assert {r.doc_id: r.n_tokens for r in counts.count_tokens(both, P.path("byte_bpe_50k.json")).collect()} == want


def test_topk(spark):
    g = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in g.normal(size=8).round(1)]) for i in range(300)] + [(300, None), (301, [1.0, None] * 4), (302, [math.nan] * 8), (303, []), (304, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.topk_inner(df, F.col("vec_id") % 50 == 0, block=64).collect()}
    x = np.floor(256 * np.asarray([v for _, v in rows[:300]], np.float32).astype(float))
    for q in range(0, 300, 50):
        s = x @ x[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, int(s[i])) for i in best]


def test_shards(docs):
    out = shards.hilbert_shards(docs, shards=4).collect()
    n = Counter(r.shard for r in out)
    assert max(n.values()) - min(n.values()) <= 1 and sum(n.values()) == len(TEXTS)
    for s in n:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n[s]))
    assert {r.doc_id: r.size for r in out} == {i: len((t or "").encode()) + 1 for i, t in enumerate(TEXTS)}


def test_lm_base_and_probabilities(docs):
    out = {r.doc_id: r for r in lm.lm_scores(docs, langid.crc_rest("doc_id", 7) != 2).collect()}
    c = Counter()
    for i, t in enumerate(TEXTS):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(TEXTS):
        w = [*words(t), None]
        assert out[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n) and out[i].score < 0


def test_language(spark):
    rows = [(i, " ".join(R.choice(("the and of", "der und ist")[i % 2].split()) for _ in range(30)), ("en", "de")[i % 2]) for i in range(120)]
    df = spark.createDataFrame([*rows, (500, None, None), (501, "12 !", "en")], "doc_id long, text string, lang string")
    names, net = langid.fit(df)
    got = {r.doc_id: r for r in langid.predict(df, names, net).collect()}
    assert sum(got[i].lang_pred == l for i, _, l in rows) >= 118 and got[500].lang_pred == got[501].lang_pred == "und"


def test_language_gradients():
    g = np.random.default_rng(3)
    net = langid.BiGRU(3, hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    b, label, weight = g.integers(0, 250, (5, 4)), np.asarray([0, 1, 2, 1]), np.ones(4)
    loss = lambda: -np.log(net.probabilities(b)[:, np.arange(4), label]).mean()
    grad = net.gradients(b, label, weight)
    for k, at in (("uf", (1, 4)), ("ub", (0, 8)), ("v", (2, 1)), ("xf", (int(b[1, 0]), 2)), ("xb", (int(b[3, 2]), 7))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = loss()
        net.p[k][at] = old - 1e-3
        down = loss()
        net.p[k][at] = old
        assert grad[k][at] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_lm_learns_from_every_byte(spark):
    texts = ["", "ab", "the cat", "the dog sat", "é漢!", None] + [" ".join(R.choice(WORDS) for _ in range(R.randint(1, 12))) for _ in range(60)]
    assert max(len((t or "").encode()) for t in texts) < 128
    df = spark.createDataFrame([(t or "",) for t in texts], "text string").repartition(3)
    pairs = lm.gather(df).where(f"kind = {lm.PAIR}").select("code", "n")
    raw = [b"\0" * 4 + (t or "").encode() + b"\0" for t in texts]
    want = Counter(int.from_bytes(t[j - 4 : j + 1], "big") for t in raw for j in range(4, len(t)))
    codes = {r.code: r.n for r in pairs.collect()}
    assert codes == want
    counts = lm.by_order(pairs)
    bits = lm.table_bits(counts)
    assert bits[1] == 16 and all(10 <= bits[k] <= lm.LARGEST_BITS[k] for k in (2, 3, 4))
    n0, n1 = lm.bit_tables(counts, bits)
    mixer = lm.learn(pairs, n0, n1, bits)
    again = lm.learn(pairs.repartition(5), n0, n1, bits)
    assert (mixer.w == again.w).all() and (mixer.apm.t == again.apm.t).all()
    # at the learned weights the slope over every byte of every text, one by one, is that of the ridge
    code = np.asarray([c for c, n in codes.items() for _ in range(n)], np.int64).view(np.uint64)
    slope = lm.RIDGE * (0.3 - mixer.w)
    for _, y, x, g in lm.training_bits(n0, n1, code, bits):
        np.add.at(slope, g, (y - lm._squash((mixer.w[g] * x).sum(1)))[:, None] * x)
    assert np.abs(slope).max() < 0.1 and np.abs(mixer.w - 0.3).max() > 0.1


def test_lm_learns_from_short_texts(spark, monkeypatch):
    rows = [(i, " ".join(R.choice(WORDS) for _ in range(R.randint(1, 12)))) for i in range(80)]
    seen = []
    made = lm.Model.__init__
    monkeypatch.setattr(lm.Model, "__init__", lambda self, n0, n1, mixer, bits: seen.append(mixer) or made(self, n0, n1, mixer, bits))
    lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), langid.crc_rest("doc_id", 7) != 2).count()
    assert np.abs(seen[0].w - 0.3).max() > 0.1 and np.abs(seen[0].apm.t - lm.Refiner().t).max() > 0.01
