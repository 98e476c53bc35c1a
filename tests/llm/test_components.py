"""Connected components: tasks' stars, results and rounds."""

import numpy as np

from tidemark.llm import components as module
from tidemark.llm.components import components, stars


def plain(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {x: top(x) for x in root}


def test_stars_against_loops():
    rng = np.random.default_rng(3)
    for n, m in ((5, 3), (40, 25), (300, 280), (1000, 3000)):
        e = rng.integers(-n, n, size=(m, 2))
        e = e[e[:, 0] != e[:, 1]]
        a, b = stars(e[:, 0], e[:, 1])
        want = plain(e.tolist())
        assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {x: y for x, y in want.items() if x != y}
    assert [len(x) for x in stars(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_a_long_path_in_few_rounds(spark, monkeypatch):
    """Nodes in random places of a path: its tasks draw their parts together before the first round, which few rounds then join."""
    ids = np.random.default_rng(4).permutation(4000).tolist()
    edges = list(zip(ids, ids[1:]))
    tables, write = [], module.written
    monkeypatch.setattr(module, "written", lambda df: tables.append(1) or write(df))
    got = components(spark.createDataFrame(edges, "a long, b long").coalesce(2))
    assert {r.node: r.label for r in got.collect()} == plain(edges)
    assert len(tables) <= 6
