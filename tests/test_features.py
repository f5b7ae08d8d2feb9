"""Case features against plain dictionaries; the reduction against numpy."""

import math
from collections import Counter

import numpy as np
import pytest

from casebraid.operators.features import KINDS, case_features, feature_digests, reduced

DOCS = "case long, place int, embedding array<double>, digest string, numero string"
ACTS = "case long, ord int, unidade string, tipo string"


def tables(spark):
    docs = [(1, 1, [3.0, 4.0], "a", "1"), (1, 2, [0.0, 1.0], "b", "2"), (1, 3, None, None, "3"), (1, 4, [1.0], "d", "4"), (2, 1, [0.0, 0.0], "e", "5"), (None, 1, [1.0, 1.0], "f", "6")]
    acts = [(1, 1, "A", KINDS[3]), (1, 2, "A", "no such kind"), (1, 3, "B", None), (1, 4, None, KINDS[0]), (1, 5, "", KINDS[0]), (1, 6, "A", KINDS[3]), (2, 1, "b", KINDS[1]), (3, 1, "C", KINDS[1]), (3, 2, "A", KINDS[1]), (4, 1, None, None), (None, 1, "A", KINDS[0])]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(acts, ACTS)


def test_blocks_of_a_case(spark):
    found, columns = case_features(*tables(spark))
    names = {r.i: (r.block, r.name) for r in columns.collect()}
    assert [names[k] for k in range(2, 8)] == [("units", "a"), ("units", "b"), ("units", "c"), ("pairs", "a__b"), ("pairs", "b__a"), ("pairs", "c__a")]
    assert len(names) == 8 + len(KINDS) and names[8] == ("kinds", KINDS[0])
    got = {(r.case, names[r.i]): r.x for r in found.collect()}
    mean = np.array([3 * 3.0, 3 * 4.0 + 1.5 * 1.0])
    mean /= np.linalg.norm(mean)
    assert math.isclose(got[1, ("semantic", "0")], mean[0]) and math.isclose(got[1, ("semantic", "1")], mean[1])
    idf = lambda df: math.log((1 + 4) / (1 + df)) + 1
    length = math.hypot(idf(2), idf(2))
    assert math.isclose(got[1, ("units", "a")], idf(2) / length) and math.isclose(got[1, ("units", "b")], idf(2) / length)
    assert math.isclose(got[1, ("pairs", "a__b")], 1 / math.sqrt(2)) and got[3, ("pairs", "c__a")] == 1.0
    assert math.isclose(got[1, ("kinds", KINDS[0])], 2 / 6) and math.isclose(got[1, ("kinds", "OUTROS")], 2 / 6) and got[4, ("kinds", "OUTROS")] == 1.0
    assert {c for c, _ in got} == {1, 2, 3, 4} and (2, ("semantic", "0")) not in got


def test_most_terms_are_kept(spark):
    _, columns = case_features(*tables(spark), units=2, pairs=1)
    assert Counter(r.block for r in columns.collect()) == {"semantic": 2, "units": 2, "pairs": 1, "kinds": len(KINDS)}


def test_digest_changes_with_what_matters_only(spark):
    docs, acts = tables(spark)
    known = {r.case: r.digest for r in feature_digests(docs, acts).collect()}
    assert set(known) == {1, 2, 3, 4} and len(set(known.values())) == 4
    turned = {r.case: r.digest for r in feature_digests(docs.orderBy("place", ascending=False).repartition(3), acts.repartition(3)).collect()}
    assert turned == known
    again = {r.case: r.digest for r in feature_digests(docs, acts.unionByName(spark.createDataFrame([(1, 7, "A", KINDS[5])], ACTS))).collect()}
    assert again[1] != known[1] and again[2] == known[2]
    assert {r.case for r in feature_digests(docs, acts, "other weights").collect() if r.digest == known[r.case]} == set()


@pytest.mark.parametrize(("n", "width", "rank"), [(120, 40, 40), (60, 300, 6)])
def test_reduction_explains_what_numpy_explains(spark, n, width, rank):
    own = np.random.default_rng(n)
    a = own.normal(size=(n, rank)) @ (own.normal(size=(rank, width)) * (0.8 ** np.arange(rank))[:, None])
    a[own.random(a.shape) < 0.5] = 0
    rows = [(k, i, float(x)) for k, row in enumerate(a) for i, x in enumerate(row) if x]
    got = {r.case: r.vec for r in reduced(spark.createDataFrame(rows, "case long, i int, x double").repartition(3), components=10).collect()}
    unit = a / np.linalg.norm(a, axis=1, keepdims=True)
    s = np.linalg.svd(unit - unit.mean(axis=0), compute_uv=False)
    y = np.array([got[k] for k in range(n)])
    assert y.shape == (n, 10) and np.allclose(y.mean(axis=0), 0, atol=1e-9)
    assert (y**2).sum() >= 0.99 * (s[:10] ** 2).sum()
    assert np.allclose((y**2).sum(axis=0)[:3], s[:3] ** 2, rtol=0.01)


def test_few_cases(spark):
    schema = "case string, i int, x double"
    assert reduced(spark.createDataFrame([], schema)).count() == 0
    one = reduced(spark.createDataFrame([("a", 0, 2.0), ("a", None, 1.0), (None, 1, 1.0)], schema)).collect()
    assert [(r.case, r.vec) for r in one] == [("a", [0.0])]
    three = reduced(spark.createDataFrame([("a", 0, 2.0), ("b", 1, 1.0), ("c", 1, -1.0), ("c", 1, 0.0)], schema)).collect()
    assert {len(r.vec) for r in three} == {2}
