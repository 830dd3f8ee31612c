"""Strings built against hashes, hot paths with lowered constants, clashing columns, repeated ids and whole queries."""

import base64
import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import bpe, counts, jaccard, langid, lm, mixing, quality, shards, suffix, topk
from rasterloom.llm.common import join_hot, span_hashes
from rasterloom.llm.queries import QUERIES

R = random.Random(23)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def thue_morse(n):
    s = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[c] for c in s), "".join("ba"[c] for c in s)


def ranks():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


@pytest.mark.parametrize("n", [1024, 4096])
def test_strings_that_break_polynomial_hashes(spark, n):
    import tokenizers

    x, y = thue_morse(n)
    data = np.frombuffer((x + y).encode(), np.uint8)
    assert len(set(span_hashes(data, np.asarray([0, n]), np.asarray([n, 2 * n])).tolist())) == 2
    docs = spark.createDataFrame([(1, x), (2, y), (3, f"p q r s {x}"), (4, f"p q r s {y}"), (5, f"{x}\n{y}\n{x}")], "doc_id long, text string").coalesce(1)
    texts = {r.doc_id: r.text for r in docs.collect()}
    enc, lib = ranks(), tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in bpe.bpe_encode(docs, P.path("byte_bpe_50k.tiktoken"), digests=True).collect():
        assert list(r.ids) == enc.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert {r.doc_id: r.n_tokens for r in counts.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()} == {i: len(lib.encode(t, add_special_tokens=False)) for i, t in texts.items()}
    assert [r.n_dup_lines for r in quality.text_stats(docs.where("doc_id = 5")).collect()] == [1]
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()} == {i: i for i in texts}
    out = {r.doc_id: r.n_known for r in lm.lm_scores(docs.where("doc_id < 3"), F.col("doc_id") == 1).collect()}
    assert out == {1: 2, 2: 1}
    removed = {r.doc_id: r.n_removed for r in suffix.remove_repeats(docs).collect()}
    assert removed == brute_removed(texts, 200)


def brute_removed(texts, size):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(t[p : p + size] for t in raw.values() for p in range(len(t) - size + 1))
    out = {}
    for i, t in raw.items():
        m = np.zeros(len(t), bool)
        for p in range(len(t) - size + 1):
            if seen[t[p : p + size]] > 1:
                m[p : p + size] = True
        out[i] = int(m.sum())
    return out


def noise(n):
    return "".join(R.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


@pytest.mark.parametrize("hot", [3, 10_000])
def test_hot_anchors_are_split_and_sorted(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    passages = [noise(k) for k in (60, 150, 195, 199, 200, 260, 500)] + ["a" * 230, "ab" * 130]
    texts = {i: noise(R.randint(0, 40)) + passages[i % len(passages)] + noise(R.randint(0, 300)) for i in range(90)}
    texts.update({100: None, 101: "", 102: passages[5], 103: passages[5]})
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    assert {r.doc_id: r.n_removed for r in suffix.remove_repeats(df).collect()} == brute_removed(texts, 200)


def test_clusters_over_several_blocks_and_long_runs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "PAIRS", 3)
    base = [noise(6) for _ in range(60)]
    rows = []
    for i in range(60):
        w = list(base) if i % 2 else [noise(6) for _ in range(30)] + base[:30]
        for _ in range(R.randint(0, 5)):
            w[R.randrange(len(w))] = noise(6)
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == root and len(set(root.values())) < 60


def test_doubtful_class_names(spark, monkeypatch):
    names = jaccard.class_names
    monkeypatch.setattr(jaccard, "class_names", lambda s: (7, names(s)[1]))
    texts = {i: noise(80) for i in range(4)} | {4: "x y z", 5: "x y z"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seven = jaccard.class_names(np.asarray([1], np.uint64))
    assert seven[0] == 7 and jaccard.class_id(np.asarray([1], np.uint64), frozenset([7])) == seven[1]
    monkeypatch.undo()
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4}


def test_hot_join_keeps_every_row(spark):
    left = spark.createDataFrame([(i, "hot" if i < 60 else f"k{i % 7}" if i < 90 else None) for i in range(100)], "i int, k string")
    right = left.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("m")).where("k <> 'k3'")
    want = {(r.i, r.m) for r in left.join(right, "k", "left").collect()}
    for hot in (10, 1000):
        assert {(r.i, r.m) for r in join_hot(left, right, "k", "n", hot=hot).collect()} == want


def test_large_scores_and_repeated_ids(spark):
    g = np.random.default_rng(4)
    rows = [(int(i) // 2, [float(x) for x in g.integers(-(2**28), 2**28, 6)]) for i in range(120)]
    rows += [(1000, [2.0**60, 2.0**60]), (1050, [2.0**60, 3.0]), (1100, [-(2.0**60), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = topk.topk_inner(df, F.col("vec_id") % 10 == 0, block=16, query_block=4, k=4).collect()
    want = []
    whole = [[int(256 * x) for x in v] for _, v in rows]
    for q, (qid, _) in enumerate(rows):
        if qid % 10 == 0:
            got = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), rows[c][0]) for c in range(len(rows)) if c != q and len(whole[c]) == len(whole[q]))[:4]
            want += [(qid, k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(got)]
    assert sorted(tuple(r) for r in out) == sorted(want)


def test_scores_past_38_digits_keep_their_order(spark):
    g = np.random.default_rng(5)
    rows = [(i, (g.normal(0, 1, 4) * 10.0 ** int(g.integers(0, 38))).astype("f4").tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    out = topk.topk_inner(df, F.col("vec_id") % 10 == 0, block=16, query_block=4, k=5).collect()
    whole, want = [[math.floor(256 * x) for x in v] for _, v in rows], []
    for q in range(0, 80, 10):
        got = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in range(80) if c != q)[:5]
        want += [(q, k + 1, c, max(-(2**63), min(2**63 - 1, -v))) for k, (v, c) in enumerate(got)]
    assert sorted(tuple(r) for r in out) == sorted(want)
    scores = [-(10**90), -(10**40), -(2**63) - 1, -(2**63), 0, 2**63 - 1, 2**63, 10**40, 10**90]
    assert sorted(scores, key=lambda v: (~max(-(2**63), min(2**63 - 1, v)), topk.beyond(v))) == scores[::-1]


def test_hilbert_curve_steps_to_neighbours(spark):
    bits, n = 3, 3
    cells = spark.range(1 << bits * n).select(*[(F.floor(F.col("id") / (1 << bits * i)) % (1 << bits)).cast("bigint").alias("xyz"[i]) for i in range(n)])
    got = {r.h: (r.x, r.y, r.z) for r in cells.select("*", shards.hilbert_index([F.col(c) for c in "xyz"], bits).alias("h")).collect()}
    assert sorted(got) == list(range(1 << bits * n))
    for h in range(1, 1 << bits * n):
        assert sum(abs(a - b) for a, b in zip(got[h], got[h - 1], strict=True)) == 1


def test_water_fill_stops_at_the_cap_and_reshares():
    assert mixing.water_fill([10.0, 100.0, 100.0], [5.0, 2.0, 1.0], 315.0, 2.0) == pytest.approx([20.0, 590 / 3, 295 / 3])
    assert mixing.water_fill([10.0, 10.0], [5.0, 1.0], 30.0, 2.0) == pytest.approx([20.0, 10.0])
    assert mixing.water_fill([0.0, 8.0], [5.0, 2.0], 12.0, 2.0) == pytest.approx([0.0, 12.0])


OUTPUTS = (
    "lang_pred score held_out n_shingles component_id n_tokens n_known train_tokens base_score n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept "
    "size source_size target taken copies n_bytes n_removed n_spans kept_sha256 kept_text ids ids_sha256 decoded_sha256 over_limit digest shard slot curve rank lead "
    "k t g n rid row mixed part __text"
).split()


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with every name that an operator gives as a column, null ids, repeated ids and repeated rows."""
    body = [" ".join(noise(5) for _ in range(70)) for _ in range(6)]
    rows = [(i, t, "en", s, 1) for i, t, s in [(1, body[0], "a"), (1, body[1], "b"), (None, body[2], None), (None, body[3], "a"), (4, body[4], "b"), (4, body[4], "b"), (5, None, "a"), (6, "", "b"), (7, "x y", None), (8, body[5], "a")]]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in OUTPUTS])


def test_stages_with_clashing_columns_null_and_repeated_ids(spark, clashing, tmp_path):
    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 0, 0), (8, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for docs in (clashing, clashing.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            if name == "bpe_encode":
                assert len(rows) == docs.count()
                continue
            assert out.columns == docs.columns and all(r[c] == f"own {c}" for r in rows for c in OUTPUTS)
            if rows and name == "quality_rules":
                assert len(rows) == 7
            if rows and name == "ngram_jaccard":  # equal rows are one, rows without words stay
                assert len(rows) == 9


def test_operators_with_clashing_columns(spark, clashing):
    d, keep = clashing, tuple(clashing.columns)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    names, net = langid.fit(d)
    vectors = spark.createDataFrame([(1, [1.0, 2.0], 3, 4), (50, [2.0, 1.0], 3, 4)], "vec_id long, embedding array<float>, rank int, score int")
    for x in (d, d.limit(0)):
        n = x.count()
        assert langid.predict(x, names, net, keep=keep).count() == n
        assert jaccard.jaccard_components(x).count() == n
        assert lm.lm_scores(x, F.lit(True)).count() == n
        assert quality.quality_rules(x, none, keep=keep).count() == n
        assert mixing.mix_sources(x).count() == n
        got = suffix.remove_repeats(x, keep=keep)
        assert got.count() == n and got.columns.count("n_bytes") == 1
        assert bpe.bpe_encode(x, P.path("byte_bpe_50k.tiktoken"), keep=keep, digests=True).count() == n
        assert counts.count_tokens(x, P.path("byte_bpe_50k.json")).count() == n
        assert shards.hilbert_shards(x).count() == n
        assert topk.topk_inner(vectors.limit(2 if n else 0), F.col("vec_id") % 50 == 0).count() == (1 if n else 0)


def test_decoding_gives_the_bytes_back(spark, clashing):
    path = P.path("byte_bpe_50k.tiktoken")
    ids = bpe.bpe_encode(clashing.select("doc_id", "text"), path, keep=("doc_id", "text"))
    for r in bpe.bpe_decode(ids.unionByName(ids.limit(1).withColumn("ids", F.lit(None).cast("array<int>"))), path, keep=("doc_id", "text", "ids")).collect():
        assert (r.data is None) == (r.ids is None) and (r.data is None or bytes(r.data) == (r.text or "").encode())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    langs = {"en": "the and of to in is was for".split(), "de": "der und ist das nicht ein zu mit".split()}
    rows = []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(R.choice(langs[lang]) + R.choice(["", " " + noise(5)]) for _ in range(R.randint(20, 700 if i % 40 == 0 else 90))), lang if i % 11 else None, ["s1", "s0", None][i % 3], 0))
    rows += [(160, None, "en", "s1", 0), (161, "", "de", "s0", 0), (162, "12 !", "en", "s1", 0)] + [(163 + j, rows[3][1], "de", "s0", 0) for j in range(3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 160, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    g = np.random.default_rng(6)
    spark.createDataFrame([(i, [float(v) for v in g.normal(size=8)], 0) for i in range(200)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, {r[0]: r for r in rows}


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_queries_through_their_contract(spark, folder):
    import tokenizers

    d, rows = folder
    out = {n: [r.asDict() for r in q(spark, d).collect()] for n, q in QUERIES.items()}
    text = {i: r[1] or "" for i, r in rows.items()}
    one = {r["doc_id"]: r for r in out["op1_lang_id"]}
    assert all(one[i]["held_out"] == (crc(i, 4) == 2) for i in rows) and one[160]["lang_pred"] == one[161]["lang_pred"] == one[162]["lang_pred"] == "und"
    known = [i for i in rows if rows[i][2] and i < 160]
    assert sum(one[i]["lang_pred"] == rows[i][2] for i in known) >= 0.97 * len(known)
    two = {r["doc_id"]: r for r in out["op2_ngram_jaccard"]}
    assert [two[i]["component_id"] for i in (3, 163, 164, 165)] == [3] * 4 and two[160]["n_shingles"] == 0
    three = {r["doc_id"]: r for r in out["op3_lm_score"]}
    c = Counter()
    for i, t in text.items():
        if crc(i, 7) != 2:
            c.update([*t.lower().split(), None])
    total, v = sum(c.values()), len(c)
    for i, t in text.items():
        w = [*t.lower().split(), None]
        assert (three[i]["held_out"], three[i]["n_tokens"], three[i]["n_known"], three[i]["train_tokens"]) == (crc(i, 7) == 2, len(w), sum(c[x] > 0 for x in w), total)
        assert three[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (total + v + 1)) for x in w))
    for r in out["op4_quality_rules"]:
        assert r["n_words"] == len(text[r["doc_id"]].split()) and r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    five = out["op5_mix_sources"]
    sizes = Counter()
    for i, r in rows.items():
        sizes[r[3]] += len(text[i].split())
    order = ["s0", "s1", None]
    goal = dict(zip(order, mixing.water_fill([float(sizes[s]) for s in order], [5.0, 2.0, 1.0], 1.5 * sum(sizes.values()), 2.0), strict=True))
    for r in five:
        assert r["source_size"] == sizes[rows[r["doc_id"]][3]] and r["target"] == pytest.approx(goal[rows[r["doc_id"]][3]]) and r["taken"] <= 2 * r["size"]
    six = {r["doc_id"]: r["n_removed"] for r in out["op6_suffix_dedup"]}
    assert six == brute_removed(text, 200)
    enc, lib = ranks(), tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in out["op7_bpe"]:
        ids = enc.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text[r["doc_id"]].encode()).hexdigest())
    assert len(out["op8_topk_inner"]) == 4 * 5
    for r in out["op9_token_counts"]:
        n = len(lib.encode(text[r["doc_id"]], add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text[r["doc_id"]].encode()), n, n > 512)
    ten = out["op10_hilbert_shards"]
    per = Counter(r["shard"] for r in ten)
    assert max(per.values()) - min(per.values()) <= 1 and all(sorted(r["slot"] for r in ten if r["shard"] == s) == list(range(per[s])) for s in per)
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["law"] == "rows" and r["grown_shard"] is None for r in ten)


def test_shards_cover_few_cells(spark):
    """Runs of the curve hold few of the (lang, source) cells, so a filter on both passes most shards by."""
    rows = [(i, "x" * (2 ** (i % 9)) + f" {i}", f"l{i // 9 % 4}", f"s{i // 36 % 4}") for i in range(1440)]
    out = shards.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("doc_id", "shard").collect()
    cells = {}
    for r in out:
        cells.setdefault(r.shard, set()).add(rows[r.doc_id][2:])
    found = sum(map(len, cells.values()))
    assert len(cells) == 8 and found <= 0.6 * 8 * 16, found


def test_learned_rules_decide_on_a_table(spark, folder):
    d, rows = folder
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    labels = docs.where("doc_id < 160").select("doc_id", (F.size(F.split("text", " ")) < 75).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    rules = quality.fit(docs, labels)
    assert rules and all(f in quality.FEATURES for r in rules for f, _, _ in r)
    feature = {
        "n_words": lambda r: float(r.n_words), "mean_word": lambda r: r.word_chars / max(r.n_words, 1), "symbol_share": lambda r: r.n_symbols / max(r.word_chars, 1),
        "dup_lines": lambda r: r.n_dup_lines / max(r.n_words, 1), "repeat_share": lambda r: r.n_repeat_words / max(r.n_words, 1),
    }
    verdicts = Counter()
    for r in quality.quality_rules(docs, labels).collect():
        bad = any(all(feature[f](r) >= t if up else feature[f](r) <= t for f, up, t in rule) for rule in rules)
        assert r.kept == (not r.base_failed and not bad)
        verdicts[r.kept, r.base_failed] += 1
    assert verdicts[True, False] and verdicts[False, False]


def test_very_long_texts(spark):
    """Texts of several parts: statistics, shingles, repeats, tokens and counts are those of the whole text."""
    import tokenizers

    rng = np.random.default_rng(8)
    words = np.asarray([noise(5).strip() or "x" for _ in range(4000)])
    long = " ".join(words[rng.integers(0, 4000, 260_000)].tolist())
    texts = {1: long, 2: long[:900_000] + " other end", 3: "x" * 1_200_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    stats = {r.doc_id: r for r in quality.text_stats(df).collect()}
    assert all(stats[i].n_words == len(t.split()) and stats[i].word_chars == sum(map(len, t.split())) for i, t in texts.items())
    got = {r.doc_id: r for r in jaccard.jaccard_components(df).collect()}
    for i, t in texts.items():
        w = t.split()
        assert got[i].n_shingles == len({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}) and got[i].component_id == i
    removed = {r.doc_id: r.n_removed for r in suffix.remove_repeats(df).collect()}
    shared = len(os.path.commonprefix([texts[1], texts[2]]))
    assert removed == {1: shared, 2: shared, 3: 1_200_000}
    enc, lib = ranks(), tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in bpe.bpe_encode(df.where("doc_id < 3"), P.path("byte_bpe_50k.tiktoken")).collect():
        assert list(r.ids) == enc.encode_ordinary(texts[r.doc_id])
    assert {r.doc_id: r.n_tokens for r in counts.count_tokens(df.where("doc_id = 2"), P.path("byte_bpe_50k.json")).collect()} == {2: len(lib.encode(texts[2], add_special_tokens=False))}


def test_model_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(" ".join(noise(4) for _ in range(20)),) for _ in range(30)], "text string")
    pairs = lm.gather(df).where(f"kind = {lm.PAIR}").select("code", "n")
    model = lm.fit(pairs)
    for ctx in (0, 0x61626364, 0x20, 0xFFFFFFFF):
        logs = model.bytes_cost((np.uint64(ctx) << np.uint64(8)) | np.arange(256, dtype=np.uint64))
        assert (10**logs).sum() == pytest.approx(1, abs=1e-5)


def test_long_texts_that_share_shingles_by_chance_do_not_run_together(spark, monkeypatch):
    """Each text shares a twentieth of its shingles with others, and none is near another but one pair."""
    rng = np.random.default_rng(5)
    pool = [" ".join(f"p{i}x{j}" for j in range(6)) for i in range(300)]
    texts = []
    for t in range(60):
        pieces = [" ".join(f"t{t}w{i}n{j}" for j in range(40)) for i in range(30)]
        for p in rng.choice(300, 30, replace=False):
            pieces.insert(int(rng.integers(0, len(pieces) + 1)), pool[p])
        texts.append(" ".join(pieces))
    texts.append(texts[7] + " and a little more of it")
    met, table = {}, jaccard.stage_table
    monkeypatch.setattr(jaccard, "stage_table", lambda df, name: met.setdefault(name, table(df, name)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()} == {i: 7 if i == 60 else i for i in range(61)}
    assert met["clusters"].count() == 2


@pytest.mark.parametrize("num, den", [(80, 100), (1, 1), (7, 10), (1, 2)])
def test_bucket_tokens_lose_no_link(num, den):
    rng = np.random.default_rng(num)
    linked = 0
    for turn in range(1500):
        n = int(rng.integers(1, 12 if turn % 2 else 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        apart = max(1, n * (den - num) // den) + 1
        b = np.union1d(a[rng.permutation(len(a))[: max(1, len(a) - int(rng.integers(0, apart)))]], rng.integers(0, 2**63, int(rng.integers(0, apart)), dtype=np.uint64))
        both = len(np.intersect1d(a, b))
        if den * both >= num * (len(a) + len(b) - both):
            linked += 1
            x, y = (jaccard.bucket_tokens(s, (s % np.uint64(7)).astype(np.uint8), num, den) for s in (a, b))
            assert len(np.intersect1d(x, y))
    assert linked > 300


def test_two_stage_sort_sorts_the_suffixes_that_count():
    rng = np.random.default_rng(11)
    strings = [rng.integers(97, 100, int(rng.integers(1, 300))).astype(np.uint8).tobytes() for _ in range(40)] + [b"", b"cba" * 80]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
    text = np.frombuffer(b"".join(strings), np.uint8)
    real = rng.random(len(text)) < 0.05
    order = suffix.two_stage_sort(text, bounds, 64, real)
    tail = lambda p: bytes(text[p : bounds[np.searchsorted(bounds, p, "right")]])[:64]
    assert set(np.flatnonzero(real).tolist()) <= set(order.tolist()) and len(set(order.tolist())) == len(order) < len(text) / 2
    assert [tail(p) for p in order] == sorted(map(tail, order))


def test_hot_anchors_leave_other_extents_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 20)
    met, table = [], suffix.stage_table

    def written(df, name):
        out = table(df, name)
        met.extend([name] * out.where("text is not null").count() if "times" in out.columns else [])
        return out

    monkeypatch.setattr(suffix, "stage_table", written)
    hot, some = noise(260), [noise(300) for _ in range(60)]
    texts = {i: noise(30) + some[i % 60] + noise(40) for i in range(180)} | {200 + i: noise(50) + hot + noise(50) for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.n_removed for r in suffix.remove_repeats(df).collect()} == brute_removed(texts, 200)
    assert met and met.count(met[0]) < 150  # extents of the hot passage alone; those of the others are several hundred


def test_groups_of_extents_stay_near_their_block():
    import pyarrow as pa

    key, n = np.repeat(np.arange(4000), 5), 20_000
    text = pa.array([bytes(260)] * n, pa.binary())
    ones = lambda kind: pa.array(np.ones(n), kind)
    cols = {c: ones(pa.int64() if c in ("ext", "uid", "uid2", "start") else pa.int32()) for c in suffix.NAMES} | {"key": pa.array(key), "text": text}
    batch = pa.RecordBatch.from_arrays([cols[c] for c in suffix.NAMES], names=suffix.NAMES)
    seen = [t for whole, t in suffix._groups([batch.slice(0, 9_998), batch.slice(9_998)], lambda b: b) if whole]
    assert np.array_equal(np.concatenate([t["key"].to_numpy() for t in seen]), key)
    assert all(a["key"][-1] != b["key"][0] for a, b in zip(seen, seen[1:], strict=False))
    assert max(t.num_rows * 260 for t in seen) < suffix.BLOCK + 10 * 260
