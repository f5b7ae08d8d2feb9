import math
import re
from collections import Counter
from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casebraid.llm import toxicity
from casebraid.llm.language import held_out
from casebraid.llm.toxicity import maximal_segments


def by_definition(scores):
    """Ruzzo and Tompa's definition: take the best segment (shortest, leftmost), then both sides, again."""
    out = []

    def split(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return
        i = -best[2]
        j = i - best[1]
        split(a, i)
        out.append((i, j, best[0]))
        split(j, b)

    split(0, len(scores))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=24))
def test_segments_equal_the_definition(scores):
    got = maximal_segments(np.array(scores, float))
    want = by_definition(scores)
    assert [round(s) for _, _, s in got] == [s for _, _, s in want]
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def corpus(spark, n=600):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("lan", "tor", "mis", "ner")]
    docs, labels = [], []
    for k in range(n):
        text = list(rng.choice(words, rng.integers(5, 120)))
        bad = int(k % 5 == 0)
        if bad:
            at = rng.integers(len(text))
            text[at:at] = list(rng.choice(["vileness", "vilex", "foulmouth", "scumbag"], 4))
        docs.append((k, " ".join(text), "x", 0.5))
        labels.append((k, 0, bad))
    docs += [(n, None, "x", 0.1), (n + 1, "", "x", 0.1), (None, "scumbag vilest scumbag foulmouth", "x", 0.1), (n + 2, "banlan " * 100_000, "x", 0.1), (0, docs[0][1], "x", 0.2)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame([*labels, (7, 0, 0), (None, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int")


def test_held_out_rows(spark):
    docs, labels = corpus(spark)
    apart = held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs, labels, ~apart)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.where(apart).collect()}
    got = [(truth[r.doc_id], r.score >= 0.7) for r in rows if truth.get(r.doc_id) is not None]
    assert np.mean([bool(t) == p for t, p in got]) > 0.98
    by_id = {r.doc_id: r for r in rows}
    assert by_id[None].score > 0.7 and by_id[600].score < 0.5 and by_id[601].score < 0.5 and by_id[602].score < 0.5
    assert by_id[600].best_start is None


def test_nothing_to_learn_from(spark):
    docs, labels = corpus(spark, 20)
    model = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_whole_table(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    apart = held_out(F.col("doc_id"), 3, 1)
    got = toxicity.score(docs, toxicity.fit(docs, labels, ~apart)).join(labels, "doc_id").where(apart & (F.col("toxic") == 0)).agg(F.avg((F.col("score") < 0.7).cast("double"))).first()[0]
    assert got > 0.97


def test_units_of_toxic_documents_alone_count():
    units = np.arange(400, dtype=np.uint64)
    toxic, clean = np.full(400, 4), np.full(400, 40)
    toxic[0], clean[0] = 8, 0  # in 8 toxic documents and in no clean one
    model = toxicity.ToxicWords(units, toxic, clean)
    assert model.units.tolist() == [0] and model.odds[0] > 2


def test_recall_of_held_out_toxic_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    apart = held_out(F.col("doc_id"), 3, 1)
    got = toxicity.score(docs, toxicity.fit(docs, labels, ~apart)).join(labels, "doc_id").where(apart & (F.col("toxic") == 1)).agg(F.avg((F.col("score") >= 0.7).cast("double"))).first()[0]
    assert got > 0.7


def test_keep_clean_keeps_nulls_and_columns(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels, F.lit(True))
    rows = spark.createDataFrame([(1, None, "a", 1.0), (2, "", "b", 2.0), (None, "banlan", None, None), (4, "scumbag vilest scumbag foulmouth", "c", 3.0)], docs.schema)
    assert sorted(map(tuple, toxicity.keep_clean(rows, model).collect()), key=str) == sorted([(1, None, "a", 1.0), (2, "", "b", 2.0), (None, "banlan", None, None)], key=str)
    assert toxicity.keep_clean(rows.limit(0), model).count() == 0


def plain_scores(texts, toxic, wanted):
    """Model and scores by the docstring of the module, over dictionaries of words; toxic of each text, None outside the sample."""
    split = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    units = lambda w: [w, *(w[:n] + "*" for n in toxicity.BEGINNINGS)]
    docs = [(split(t), y) for t, y in zip(texts, toxic, strict=True) if y is not None]
    counts = [Counter(u for words, y in docs if y == label for u in {u for w in words for u in units(w)}) for label in (1, 0)]
    kept = [u for u in {*counts[0], *counts[1]} if counts[0][u] >= 3 or counts[1][u] >= 20]
    n = [sum(c[u] for u in kept) for c in counts]
    weight, limit = toxicity.PRIOR * len(kept), NormalDist().inv_cdf(1 - toxicity.BY_CHANCE / max(len(kept), 20))
    odds, strength = {}, {}
    for u in kept:
        own = [c[u] for c in counts]
        x = [math.log((k + toxicity.PRIOR) / (total + weight - k - toxicity.PRIOR)) for k, total in zip(own, n, strict=True)]
        ratio = sum(k * math.log(k / (sum(own) * total / sum(n))) for k, total in zip(own, n, strict=True) if k)
        z = math.sqrt(2 * max(ratio, 0))
        if z >= limit:
            odds[u], strength[u] = max(x[0] - x[1], -2.0), z

    def scores(words):
        best = [max((u for u in units(w) if u in odds), key=strength.get, default=None) for w in words]
        return [-toxicity.PENALTY if u is None else odds[u] for u in best]

    clean = [scores(words) for words, y in docs if y == 0]
    bins = Counter(min(int((min(max(s, -2.0), 12.0) + 2) / 0.25), 55) for own in clean for s in own)
    law = [(-2 + 0.25 * k + 0.125, c / sum(bins.values())) for k, c in bins.items()]
    scale, log_k = 1.0, 0.0
    if any(s > 0 for s, _ in law) and sum(s * p for s, p in law) < 0:
        low, high = 1e-6, 20.0
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(p * math.exp(min(middle * s, 700)) for s, p in law) < 1 else (low, middle)
        scale = max(low, 0.05)
    passages = lambda own: [s for _, _, s in toxicity.maximal_segments(np.array(own))] if own else []
    best = [(max(passages(own), default=0.0), len(own)) for own in clean]
    found = sorted(scale * b - math.log(k) for b, k in best if b > 0)
    if len(found) >= 20:
        log_k = float(np.median(found)) + math.log(math.log(2))

    def features(words):
        normal = [scale * s - log_k - math.log(len(words)) for s in passages(scores(words))]
        first = max(normal) if normal else -log_k - math.log(len(words)) if words else -10.0
        return [1.0, min(max(first, -20), 40), math.log1p(sum(max(x, 0) for x in normal)), math.log1p(sum(x > 3 for x in normal))]

    x, y, w = np.array([features(words) for words, _ in docs]), np.array([y for _, y in docs], float), np.zeros(4)
    ridge = np.diag([1e-6, 1e-2, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ w)
    return [1 / (1 + math.exp(-float(np.clip(np.array(features(split(t))) @ w, -30, 30)))) for t in wanted]


def test_scores_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learn = ~held_out(F.col("doc_id"), 3, 1)
    rows = docs.join(labels.where(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", "left").select("doc_id", "text", "toxic").collect()
    want = dict(zip((r.doc_id for r in rows), plain_scores([r.text for r in rows], [r.toxic for r in rows], [r.text for r in rows]), strict=True))
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels, learn)).collect()}
    assert got.keys() == want.keys() and max(want.values()) > 0.9 and min(want.values()) < 0.1
    assert np.allclose([got[k] for k in want], list(want.values()), atol=1e-4)
