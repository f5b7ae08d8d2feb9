"""What two blocks tell one another, against all pairs: neighbours and edges, of which few are measured."""

import numpy as np
import pytest
from tests.test_density import blobs, run, same, textbook

from casebraid.operators import density


@pytest.fixture
def measured(monkeypatch):
    counts, plain = [], density._measured
    monkeypatch.setattr(density, "_measured", lambda x, y, i, j: counts.append(len(i)) or plain(x, y, i, j))
    return counts


@pytest.mark.parametrize(("scale", "shift"), [(1.0, 0.0), (1.0, 1e4), (1e-20, 0.0), (1e40, 0.0)])
def test_neighbours_of_a_block(measured, scale, shift):
    draw = np.random.default_rng(5)
    x, y = (draw.normal(0, 1, (n, 16)) * scale + shift for n in (300, 500))
    x[7:9], y[3:6] = x[7], x[7]
    every = np.concatenate([x, y])
    ids = np.arange(len(every))
    near, whose = density._nearest(x, ids[:300], 6)
    near, whose = near.copy(), whose.copy()
    density._nearer(x, near, whose, y, ids[300:])
    d = np.sqrt(((x[:, None] - every[None]) ** 2).sum(axis=2))
    assert np.array_equal(np.take_along_axis(d, whose, 1), near)
    np.fill_diagonal(d, np.inf)
    assert np.array_equal(near, np.sort(d, axis=1)[:, :6])
    assert sum(measured) < len(x) * len(y) / 10


def test_edges_between_blocks_are_those_lighter_than_the_way(measured):
    draw = np.random.default_rng(8)
    x = draw.normal(0, 1, (400, 12))
    core = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, 5]
    nodes = draw.permutation(400)
    gap = np.zeros(400, density._GAP)
    gap["r"], gap["w"], gap["u"], gap["v"] = draw.permutation(400), 0, -1, -1
    gap["w"] = np.sort(draw.choice(core, 400))[gap["r"]]
    block = lambda a, b: (a, nodes[a:b], x[a:b], core[a:b], np.zeros(b - a, np.int64), gap[a:b])
    over = gap[150:250][gap["r"][150:250].argmax()]
    host = dict(zip(density._GAP.names, over.tolist(), strict=True))

    def plain(of, to):
        found = set()
        for i in of:
            for j in to:
                if i < j:
                    u, v = sorted((nodes[i], nodes[j]))
                    w = max(core[i], core[j], np.sqrt(((x[i] - x[j]) ** 2).sum()))
                    top = gap[i + 1 : j + 1][gap["r"][i + 1 : j + 1].argmax()]
                    if (w, u, v) < (top["w"], top["u"], top["v"]):
                        found.add((int(u), int(v)))
        return found

    found = density._lighter_between(block(0, 150), block(250, 400), host)
    assert {(int(u), int(v)) for u, v in zip(*found[:2], strict=True)} == plain(range(150), range(250, 400))
    found = density._lighter_within(block(0, 150))
    assert {(int(u), int(v)) for u, v in zip(*found[:2], strict=True)} == plain(range(150), range(150))
    assert sum(measured) < 400 * 400 / 20


def test_several_trees_and_places_with_many_points(spark):
    """Clusters too far apart for neighbours to join them; points that lie on more others than count."""
    apart = [(1000 * c + i, [x + 40.0 * c for x in v]) for c in range(4) for i, v in blobs(c, 1, 30, 2, far=3.0)]
    draw = np.random.default_rng(2)
    places = draw.uniform(-9, 9, (14, 2))
    copies = [(k, places[int(draw.integers(14)) if k % 9 else k % 14].tolist()) for k in range(160)]
    groups = {1: apart, 2: copies}
    found = run(spark, groups, 5, block=25)
    for g, points in groups.items():
        same(found[g], textbook(points, 5))
