"""Closures by ranges of nodes, with ranges of a few rows, against plain loops."""

from __future__ import annotations

import random

import pytest

from factloom.operators import callgraph, graph
from factloom.plans import fixpoint, fragments


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(fragments, "RANGE_ROWS", 40)


def near(seed: int, n: int = 120) -> list[tuple[int, int]]:
    """Edges that mostly stay near, as those of functions side by side."""
    r = random.Random(seed)
    return sorted({(i, j) for i in range(n) for j in (min(n - 1, i + r.randint(1, 3)), max(0, i - r.randint(0, 9))) if r.random() < 0.6} | {(3, n - 2), (n - 5, 7)})


def hops_from(edges, starts):
    best, layer, h = {}, set(starts), 0
    while layer:
        for v in layer:
            best.setdefault(v, h)
        layer, h = {b for a, b in edges if a in layer} - set(best), h + 1
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_closure_and_modsets(spark, small_ranges, seed):
    pairs = near(seed)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    node = lambda *x: spark.createDataFrame([(v,) for v in x], "node long")
    assert sorted(r.node for r in graph.reach(edges, node(5, 5)).collect()) == sorted(hops_from(pairs, [5]))
    wanted = sorted((a, b, 1 + h) for a in (5, 60) for b, h in hops_from(pairs, [b for x, b in pairs if x == a]).items())
    assert sorted(map(tuple, graph.closure(edges, node(5, 60)).select("src", "dst", "hops").collect())) == wanted
    assert sorted(map(tuple, graph.closure(edges, node(5, 60), depth=4).select("src", "dst", "hops").collect())) == [w for w in wanted if w[2] <= 4]
    own = spark.createDataFrame([(5, "x"), (60, "y"), (5, "x")], "function long, lval string")
    calls = edges.selectExpr("dst AS caller", "src AS callee")
    assert sorted(map(tuple, callgraph.modsets(calls, own).collect())) == sorted((v, x) for a, x in ((5, "x"), (60, "y")) for v in hops_from(pairs, [a]))


def test_levels_and_contexts(spark, small_ranges):
    pairs = [(a, b) for a, b in near(3) if a < b]
    level = {0: 0}
    for a, b in sorted(pairs):
        if a in level:
            level[b] = max(level.get(b, 0), level[a] + 1)
    found = graph.levels(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(0,)], "node long"))
    assert sorted(map(tuple, found.collect())) == sorted(level.items())
    with pytest.raises(ValueError):
        graph.levels(spark.createDataFrame([*pairs, (100, 90), (90, 100)], "src long, dst long"), spark.createDataFrame([(90,)], "node long"))
    moves = [(a, b, str(a % 3), ("call", "return", "stay")[(a + b) % 3]) for a, b in near(4)]
    seen, todo = set(), [(0, 0, ())]
    while todo:
        row = todo.pop()
        if row in seen:
            continue
        seen.add(row)
        for a, b, site, move in moves:
            if a == row[1] and (move != "return" or not row[2] or row[2][-1] == site):
                todo.append((0, b, (*row[2], site)[-2:] if move == "call" else row[2][:-1] if move == "return" else row[2]))
    found = graph.context_closure(spark.createDataFrame(moves, "source long, target long, site string, move string"), spark.createDataFrame([(0,)], "node long"), max_context=2)
    assert sorted(map(tuple, found.collect())) == sorted((s, t, "/".join(c)) for s, t, c in seen)


def test_near_paths_need_no_rounds_over_all_edges(spark, monkeypatch):
    # Every round shuffled all edges several times, however short the paths.
    monkeypatch.setattr(fixpoint, "_rounds", lambda *a, **k: pytest.fail("a round over all edges"))
    edges = spark.createDataFrame([(1000 * f + i, 1000 * f + i + 1) for f in range(50) for i in range(30)], "src long, dst long")
    starts = spark.createDataFrame([(1000 * f,) for f in range(50)], "node long")
    assert graph.reach(edges, starts).count() == 50 * 31
    assert graph.dominated(edges, starts, starts.selectExpr("node + 1 AS node")).count() == 50 * 30
    assert graph.closure(edges).count() == 50 * 31 * 30 // 2
