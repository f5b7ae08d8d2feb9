"""HDBSCAN by joins against a textbook version over all pairs, a stack of merges and a walk from the top."""

import math

import numpy as np
import pytest

from casebraid.operators import density
from casebraid.operators.density import density_clusters, two_levels

SCHEMA = "grp long, id long, vec array<double>, label string"


def textbook(points, least, neighbours=None):
    """(id, vector) to {id: (label, strength)}; ids count in their order."""
    points = sorted(points)
    n = len(points)
    if n < max(2, least):
        return {i: (-1, 0.0) for i, _ in points}
    x = np.array([v for _, v in points], float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(neighbours or least, n - 1)]
    reach = np.maximum(np.maximum(core[:, None], core[None, :]), d)
    edges = sorted((reach[a, b], a, b) for a in range(n) for b in range(a + 1, n))
    # single linkage: a node is a point or (weight, left, right)
    owner, size, tree = list(range(n)), [1] * n, list(range(n))

    def find(a):
        while owner[a] != a:
            owner[a] = owner[owner[a]]
            a = owner[a]
        return a

    for w, a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            owner[b], tree[a], size[a] = a, (w, tree[a], tree[b]), size[a] + size[b]

    def members(node):
        out, stack = [], [node]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack += node[1:]
        return out

    clusters = []  # birth, parent, rows (density, points that leave), children

    def walk(node, birth, parent):
        me = len(clusters)
        clusters.append({"birth": birth, "parent": parent, "rows": [], "children": []})
        if parent is not None:
            clusters[parent]["children"].append(me)
        while True:
            w, left, right = node
            lam = 1 / max(w, 1e-12)
            a, b = members(left), members(right)
            if len(a) >= least and len(b) >= least:
                clusters[me]["split"] = (lam, len(a) + len(b))
                walk(left, lam, me)
                walk(right, lam, me)
                return
            if len(a) < least and len(b) < least:
                clusters[me]["rows"] += [(lam, p) for p in a + b]
                return
            small, node = (a, right) if len(a) < least else (b, left)
            clusters[me]["rows"] += [(lam, p) for p in small]

    walk(tree[find(0)], 0.0, None)
    for c in clusters:
        c["stability"] = sum(lam - c["birth"] for lam, _ in c["rows"]) + (c["split"][1] * (c["split"][0] - c["birth"]) if "split" in c else 0)
        c["densest"] = max([lam for lam, _ in c["rows"]] + ([c["split"][0]] if "split" in c else []))
    wins = {}

    def value(k):
        below = sum(value(j) for j in clusters[k]["children"])
        wins[k] = not clusters[k]["children"] or clusters[k]["stability"] >= below
        return max(clusters[k]["stability"], below) if clusters[k]["children"] else clusters[k]["stability"]

    value(0)
    out = {}

    def tell(k, chosen):
        if chosen is None and k and wins[k]:
            chosen = k
        for lam, p in clusters[k]["rows"]:
            out[p] = (None, 0.0) if chosen is None else (chosen, min(1.0, lam / clusters[chosen]["densest"]))
        for j in clusters[k]["children"]:
            tell(j, chosen)

    tell(0, None)
    order = {}
    for p in range(n):
        if out[p][0] is not None:
            order.setdefault(out[p][0], len(order))
    return {points[p][0]: (order.get(out[p][0], -1), out[p][1]) for p in range(n)}


def blobs(seed, centers, each, dims, spread=1.0, noise=0, far=12.0):
    own = np.random.default_rng(seed)
    at = own.uniform(-far, far, (centers, dims))
    x = np.concatenate([at[k] + own.normal(0, spread * (0.5 + own.random()), (each, dims)) for k in range(centers)] + [own.uniform(-far, far, (noise, dims))])
    own.shuffle(x)
    return [(k * 3 + 1, v.tolist()) for k, v in enumerate(x)]


def same(got, want):
    assert got.keys() == want.keys()
    wrong = {k: (got[k], want[k]) for k in want if got[k][0] != want[k][0] or not math.isclose(got[k][1], want[k][1], rel_tol=1e-7, abs_tol=1e-9)}
    assert not wrong, list(wrong.items())[:5]


def run(spark, groups, least, **more):
    rows = [(g, i, v, "clash") for g, points in groups.items() for i, v in points]
    found = density_clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), least, **more).collect()
    assert len(found) == len(rows)
    return {g: {r.id: (r.label, r.strength) for r in found if r.grp == g} for g in groups}


@pytest.mark.parametrize("block", [1024, 40])
def test_groups_at_once_equal_the_textbook(spark, block):
    line = [(k, [float(k * k), 0.0, 0.0]) for k in range(60)]  # a chain that grows point by point
    same_place = [(k, [float(k % 3) * 5, 1.0, 2.0]) for k in range(45)]
    groups = {0: blobs(1, 5, 40, 3, noise=30), 7: blobs(2, 3, 12, 3, noise=50), -1: blobs(3, 1, 80, 3), 9: line, 11: same_place, 12: blobs(4, 2, 4, 3), 13: [(5, [1.0, 2.0, 3.0])], None: blobs(6, 2, 30, 3)}
    found = run(spark, groups, 8, block=block)
    for g, points in groups.items():
        same(found[g], textbook(points, 8))
    assert max(label for label, _ in found[0].values()) >= 3 and found[13] == {5: (-1, 0.0)}


def test_many_clusters_in_many_levels(spark):
    own = np.random.default_rng(11)
    x = np.concatenate([own.normal(0, 1, (6, 2)) + np.array([math.cos(k), math.sin(k)]) * (3.0**(k % 7)) * 4 for k in range(70)])
    points = [(k, v.tolist()) for k, v in enumerate(x)]
    found = run(spark, {1: points}, 3, block=150)
    same(found[1], textbook(points, 3))


def test_ties_of_a_grid(spark):
    points = [(k, [float(k % 12), float(k // 12)]) for k in range(144)] + [(200 + k, [40.0 + k % 5, float(k // 5)]) for k in range(25)]
    same(run(spark, {1: points}, 5, block=50)[1], textbook(points, 5))


def test_odd_vectors_few_points_and_no_rows(spark):
    good = blobs(5, 2, 12, 2)
    odd = [(900, None), (901, []), (902, [1.0]), (903, [1.0, None]), (904, [math.nan, 1.0]), (905, [math.inf, 1.0]), (None, [0.0, 0.0]), (1, [3.0, 3.0])]
    found = density_clusters(spark.createDataFrame([(1, i, v, "") for i, v in good + odd], SCHEMA), 4).collect()
    assert len(found) == len(good) + len(odd)
    assert all((r.label, r.strength) == (-1, 0.0) for r in found if r.id and r.id >= 900)
    few = density_clusters(spark.createDataFrame([(1, 1, [1.0], ""), (2, 2, [1.0], "")], SCHEMA), 1).collect()
    assert [(r.label, r.strength) for r in few] == [(-1, 0.0)] * 2
    assert density_clusters(spark.createDataFrame([], SCHEMA), 5).count() == 0
    assert density_clusters(spark.createDataFrame([(1, 1, None, "")], SCHEMA), 5).count() == 1


def test_second_level_takes_up_left_out_points(spark):
    points = blobs(21, 3, 40, 3, spread=0.6) + [(1000 + k, [60.0 + 30 * (k % 2) + 0.1 * k, 60.0 - 0.2 * (k % 3), 0.0]) for k in range(16)]
    found = {r.id: r for r in two_levels(spark.createDataFrame([(0, i, v, "") for i, v in points], SCHEMA), 20, 5).collect()}
    once = textbook(points, 20)
    same({k: (r.macro_label, r.macro_strength) for k, r in found.items()}, once)
    for label in {v[0] for v in once.values()}:
        mine = [(i, v) for i, v in points if once[i][0] == label]
        same({i: (found[i].micro_label, found[i].micro_strength) for i, _ in mine}, textbook(mine, 5))
    assert [k for k, r in found.items() if r.reclassificada] and all(r.reclassificada == (r.macro_label == -1 and r.micro_label != -1) for r in found.values())


def test_small_pieces_of_the_sums(spark, monkeypatch):
    """Running sums in runs of few edges."""
    monkeypatch.setattr(density, "RUN", 7)
    points = blobs(31, 3, 25, 2, noise=20)
    same(run(spark, {1: points}, 6)[1], textbook(points, 6))
