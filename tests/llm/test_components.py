import random

from casebraid.llm.common import Scratch
from casebraid.llm.components import components


def test_equals_union_find(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(70)] + [(2000, 2000 + k) for k in range(60)] + [(5, 5), (None, 3), (7, 9), (7, 9)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {(x, find(x)) for x in root if find(x) != x}
    got = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "cc")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "cc")).count() == 0
