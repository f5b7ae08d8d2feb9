import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from casebraid.llm import centroids, queries
from casebraid.llm.centroids import cluster, distances, sums, whole


def plain(rows, dims, k=8, rounds=10):
    """The contract with Python's integers alone."""
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**53 else 1024 * int(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    at = [v for _, v in named[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in at]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [nearest(v)[0] for _, v in kept]
        at = [[sum(x) // own.count(c) for x in zip(*(v for (_, v), o in zip(kept, own, strict=True) if o == c), strict=True)] if c in own else old for c, old in enumerate(at)]
    found = [(i, *nearest(v)) for i, v in kept]
    fits = lambda x: x if -(2**63) <= x < 2**63 else None
    per = {c: sum(d for _, o, d in found if o == c) for c in range(len(at))}
    return [(i, c, fits(d), fits(per[c]), fits(sum(per.values())), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for i, c, d in found]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r])


@pytest.mark.parametrize("scale", [1.0, 3e4, 2e6, 1e12, 1e25])
def test_equals_brute_force_at_every_magnitude(spark, scale):
    own = random.Random(7)
    rows = [(k, [own.gauss(k % 5, 1) * scale for _ in range(6)]) for k in range(150)]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (200, None), (201, [1.0] * 5), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [math.nan] * 6), (204, [math.inf] + [0.0] * 5), (205, [])]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, cluster string").repartition(4)
    assert ordered(cluster(table, components=6, block=16).collect()) == ordered(plain(rows, 6))


def test_ties_few_rows_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    same = [(k, [0.5, -0.25]) for k in range(12)]
    assert ordered(cluster(spark.createDataFrame(same, schema), components=2).collect()) == ordered(plain(same, 2))
    few = [(k, [float(k), 1.0]) for k in range(3)]
    assert ordered(cluster(spark.createDataFrame(few, schema), components=2).collect()) == ordered(plain(few, 2))
    assert cluster(spark.createDataFrame([], schema), components=2).count() == 0
    assert cluster(spark.createDataFrame([(1, None)], schema), components=2).count() == 0


def test_distances_and_sums_are_exact_beyond_the_bounds():
    own = np.random.default_rng(1)
    for most in (1 << 10, 1 << 22, 1 << 29, 1 << 40):
        x, c = own.integers(-most, most, (40, 64)), own.integers(-most, most, (5, 64))
        want = [[sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) for w in c.tolist()] for v in x.tolist()]
        assert [[int(d) for d in row] for row in distances(x, c)] == want
        total, n = sums(x, np.arange(40) % 5, 5)
        assert total.tolist() == [[sum(col) for col in zip(*x.tolist()[k::5], strict=True)] for k in range(5)] and n.tolist() == [8] * 5
    assert whole(np.array([[-0.0001, 0.9999, -2.0]])).tolist() == [[-1, 1023, -2048]]


def test_query_equals_its_sql(spark):
    at = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{at}/embeddings.parquet')")
    got = queries.QUERIES["op13_centroids"](spark, at)
    found = duck.execute(queries.ORACLE_SQL["op13_centroids"])
    assert [d[0] for d in found.description] == got.columns
    assert ordered(got.collect()) == ordered(found.fetchall())
