"""The forest of a team's edges against Kruskal, with equal weights."""

import numpy as np

from casebraid.operators.density import _forest


def test_forest_is_kruskals():
    draw = np.random.default_rng(4)
    for n, m in ((2, 1), (30, 200), (400, 900)):
        a, b = draw.integers(0, n, m), draw.integers(0, n, m)
        a, b = np.append(a, 0), np.append(b, 1)
        u, v, w = np.minimum(a, b) * 3, np.maximum(a, b) * 3, draw.integers(0, 6, m + 1).astype(float)
        u, v, w = u[u < v], v[u < v], w[u < v]
        of, kept = {}, []

        def root(x):
            while of.get(x, x) != x:  # noqa: B023
                x = of[x]  # noqa: B023
            return x

        for z, x, y in sorted(zip(w.tolist(), u.tolist(), v.tolist(), strict=True)):
            if root(x) != root(y):
                of[root(x)] = root(y)  # noqa: B023
                kept.append((x, y, z))
        assert sorted(kept) == sorted(zip(*(c.tolist() for c in _forest(u, v, w)), strict=True))
