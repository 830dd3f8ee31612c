"""Quality rules: learned decision lists over text statistics.

Sequential covering grows and prunes conjunctions of thresholds for the class "low quality" from labelled
statistics; the ordered rules become one Spark conditional expression, so scoring needs no Python.

Cases: a null or empty text has zero counts and fails the base rule; rows repeat as they come; null labels are
left out; without labels of both classes the list is empty and keeps what the base rule keeps; a kept column
named like a result gives way to it, other columns are not read; equal lines are equal byte by byte, equal
three-word windows by 64-bit hashes (a text of n words gains a wrong one with a probability below n * n / 2**65).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import COEF, KEPT, SPACE, U64, freed, kept_type, mix64, packed, parts, read, span_hashes, unpacked, word_bounds

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that rules may test, as Spark SQL over the counts; each is defined for every row.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


def part_stats(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each text of a part."""
    n = len(off) - 1
    s, e, woff = word_bounds(data, off)
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[off])
    words = span_hashes(data, s, e)
    tri = mix64(words[:-2] * COEF[0] + words[1:-1] * COEF[1] + words[2:] * COEF[2]) if len(words) > 2 else np.zeros(0, U64)
    dup, rep = np.zeros(n, np.int64), np.zeros(n, np.int64)
    breaks = np.flatnonzero(data == 10)
    boff = np.searchsorted(breaks, off)
    wordy = np.concatenate(([0], np.cumsum(~SPACE[data])))
    for i in range(n):
        a, b = woff[i], woff[i + 1]
        if b - a > 3:
            t = tri[a : b - 2]
            order = np.argsort(t, kind="stable")
            same = t[order][1:] == t[order][:-1]
            if same.any():
                twice = np.zeros(len(t), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                hit = np.zeros(b - a, bool)
                hit[:-2] |= twice
                hit[1:-1] |= twice
                hit[2:] |= twice
                rep[i] = hit.sum()
        if boff[i + 1] > boff[i]:
            cut = breaks[boff[i] : boff[i + 1]]
            ls, le = np.concatenate(([off[i]], cut + 1)), np.concatenate((cut, [off[i + 1]]))
            full = wordy[le] > wordy[ls]
            lines = [data[x:y].tobytes() for x, y in zip(ls[full].tolist(), le[full].tolist(), strict=True)]
            dup[i] = len(lines) - len(set(lines))
    return {"n_words": np.diff(woff), "word_chars": total(~SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": total(SYMBOL[data]), "n_dup_lines": dup, "n_repeat_words": rep}


def text_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_text: bool = False) -> DataFrame:
    """The columns of `keep` and the counts of STATS for every row, from whole texts in Arrow batches; the text itself,
    if asked for, as __text."""
    base = packed(docs, keep, text)
    results = [*STATS, *["__text"] * with_text]

    def run(batches):
        for batch in batches:
            for a, b, data, off in parts(batch.column(1)):
                st = part_stats(data, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a)] + [pa.array(st[c], pa.int64()) for c in STATS] + [batch.column(1).slice(a, b - a)] * with_text, names=[KEPT, *results])

    return unpacked(base.mapInArrow(freed(run), ", ".join([kept_type(base), *[f"{c} bigint" for c in STATS], *["__text string"] * with_text])), keep, results)


Rule = list[tuple[str, bool, float]]


def _mask(x: np.ndarray, names: list[str], rule: Rule) -> np.ndarray:
    m = np.ones(len(x), bool)
    for f, up, t in rule:
        v = x[:, names.index(f)]
        m &= v >= t if up else v <= t
    return m


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], *, max_rules: int = 8, max_terms: int = 3, precision: float = 0.95, cover: int = 5) -> list[Rule]:
    """Sequential covering (grow on two thirds, prune on the rest); a rule stays if at least `precision` of what
    it covers in both parts is bad, over at least `cover` rows."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    grow = np.arange(len(x)) % 3 != 0
    while len(rules) < max_rules and (left & bad).any():
        rule: Rule = []
        mask = left & grow
        while len(rule) < max_terms and mask.any():
            p0, best = bad[mask].mean(), None
            n0 = bad[mask].sum()
            for j, f in enumerate(names):
                v = x[mask, j]
                y = bad[mask]
                order = np.argsort(v, kind="stable")
                sv, sy = v[order], y[order]
                edge = np.flatnonzero(np.diff(sv) > 0)
                if not len(edge):
                    continue
                pos, cnt = np.cumsum(sy)[edge], edge + 1
                cuts = (sv[edge] + sv[edge + 1]) / 2
                for up, p, n in ((False, pos, cnt), (True, n0 - pos, mask.sum() - cnt)):
                    gain = p * (np.log2((p + 1e-9) / n) - np.log2(p0 + 1e-9))  # FOIL's gain
                    k = int(np.argmax(gain))
                    if best is None or gain[k] > best[0]:
                        best = (gain[k], (f, up, float(cuts[k])))
            if best is None or best[0] <= 1e-9:
                break
            rule.append(best[1])
            mask = left & grow & _mask(x, names, rule)
            if bad[mask].all():
                break
        worth = lambda r: (bad[h].sum() + 1) / (h.sum() + 2) if (h := left & ~grow & _mask(x, names, r)).any() else 0.5  # noqa: B023, E731
        while len(rule) > 1 and max(worth(rule[:i] + rule[i + 1 :]) for i in range(len(rule))) >= worth(rule):
            rule = max((rule[:i] + rule[i + 1 :] for i in range(len(rule))), key=worth)
        hit = left & _mask(x, names, rule) if rule else np.zeros(len(x), bool)
        if hit.sum() < cover or bad[hit].mean() < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """The decision list as ordered conditions over the count columns: true where the first rule that fits says bad."""
    out = None
    for rule in rules:
        cond = F.lit(True)
        for f, up, t in rule:
            v = F.expr(FEATURES[f])
            cond = cond & (v >= t if up else v <= t)
        out = F.when(cond, True) if out is None else out.when(cond, True)
    return F.lit(False) if out is None else out.otherwise(False)


def labelled(labels: DataFrame, sample: int) -> DataFrame:
    """doc_id and q of at most `sample` labelled documents, the smallest by a hash of doc_id (a documented bound)."""
    lab = labels.select("doc_id", F.col("quality").cast("int").alias("q")).dropna().groupBy("doc_id").agg(F.min("q").alias("q"))
    return lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, **limits) -> list[Rule]:
    """Learn from at most `sample` labelled rows; their ids are few enough to broadcast, so no text is shuffled."""
    names = list(FEATURES)
    known = docs.select("doc_id", "text").join(F.broadcast(labelled(labels, sample)), "doc_id")
    rows = text_stats(known, ("doc_id", "q")).select("doc_id", "q", *[F.expr(FEATURES[f]).alias(f) for f in names]).orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(sample).toPandas()
    bad = (rows["q"].to_numpy() == 0) if len(rows) else np.zeros(0, bool)
    return learn_rules(rows[names].to_numpy(float).reshape(-1, len(names)), bad, names, **limits) if bad.any() and not bad.all() else []


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def quality_rules(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False, **limits) -> DataFrame:
    """Counts, base verdict and learned verdict for every row of docs, with the columns of `keep`."""
    rules = fit(docs, labels, **limits)
    keep = [c for c in keep if c.lower() not in ("base_failed", "kept")]
    return text_stats(docs, keep, with_text=with_text).withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & ~rules_column(rules))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels"))
