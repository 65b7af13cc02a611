"""Expressions, formulas, the solver, loops, guards, assertions and checks."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.functions import ir
from factloom.functions.solver import LinearSolver
from factloom.operators import cfg, symbolic

NAMES = "xyz"
leaf = st.integers(-6, 6).map(lambda n: (ir.num(n), lambda v, n=n: n)) | st.sampled_from(NAMES).map(lambda n: (ir.var(n), lambda v, n=n: v[n]))
MAKE = {"add": (ir.add, lambda p, q: p + q), "sub": (ir.sub, lambda p, q: p - q), "mul": (ir.mul, lambda p, q: p * q), "div": (ir.floor_div, lambda p, q: p // q if q else 0), "mod": (ir.mod, lambda p, q: p % q if q > 0 else 0)}
exps = st.recursive(leaf, lambda x: st.tuples(st.sampled_from(sorted(MAKE)), x, x).map(lambda t: (MAKE[t[0]][0](t[1][0], t[2][0]), lambda v, t=t: MAKE[t[0]][1](t[1][1](v), t[2][1](v)))), max_leaves=8)
points = st.fixed_dictionaries({n: st.integers(-9, 9) for n in NAMES})
COMPARE = {"<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q, "==": lambda p, q: p == q, "!=": lambda p, q: p != q}
tests = st.tuples(st.sampled_from(sorted(COMPARE)), exps, exps).map(lambda t: (ir.compare(t[0], t[1][0], t[2][0]), lambda v, t=t: COMPARE[t[0]](t[1][1](v), t[2][1](v))))
bits = st.recursive(tests, lambda x: st.tuples(st.sampled_from(["and", "or", "not"]), x, x).map(lambda t: {"and": (ir.conjoin(t[1][0], t[2][0]), lambda v, t=t: t[1][1](v) and t[2][1](v)), "or": (ir.disjoin(t[1][0], t[2][0]), lambda v, t=t: t[1][1](v) or t[2][1](v)), "not": (ir.negate(t[1][0]), lambda v, t=t: not t[1][1](v))}[t[0]]), max_leaves=5)


@settings(max_examples=300, deadline=None)
@given(exps, points)
def test_building_keeps_values(x, v):
    assert ir.evaluate(x[0], v) == x[1](v)


@settings(max_examples=300, deadline=None)
@given(bits, bits, points)
def test_formulas_keep_values(x, y, v):
    assert ir.evaluate(x[0], v) == x[1](v) and ir.evaluate(ir.negate(x[0]), v) != x[1](v)
    if y[1](v):
        assert ir.evaluate(ir.reduce(x[0], y[0]), v) == x[1](v)


def test_rewritings():
    p = ir.parse
    assert p("x + 0") == p("x * 1") == p("0 - (0 - x)") == p("(x + y) - y") == ir.var("x")
    assert p("3 - (x - 2)") == p("(3 - x) + 2") == p("5 - x") and p("2 * x + 2 * y") == p("2 * (x + y)")
    assert p("x < x") == ir.FALSE and p("x <= x") == ir.TRUE and p("x < 1") == p("x <= 0") and p("-1 < x") == p("0 <= x")
    assert p("4 * x <= 4 * y") == p("x <= y") and p("x + z < y + z") == p("x < y") and p("!(x > y)") == p("x <= y")
    assert p("(6 * x + 4) / 2") == p("3 * x + 2") and p("2 * x == 3") == ir.FALSE
    b = ir.var("b")
    assert ir.index(ir.index(b, "e", p("x")), "e", p("y")) == ir.index(b, "e", p("x + y")) and ir.index(b, "e", ir.num(0)) == b
    assert ir.field(ir.rfield(b, "f"), "f") == b == ir.rfield(ir.field(b, "f"), "f") and ir.field(ir.rfield(b, "f"), "g") != b
    assert ir.bound("ubound", ir.index(b, "e", p("x")), "e") == ir.sub(ir.bound("ubound", b, "e"), p("x"))
    assert ir.wrap(200, 8, True) == -56 and ir.wrap(-1, 16, False) == 65535
    assert ir.substitute(p("x * y + b[x]"), lambda a: ir.num(3) if a.args == ("x",) else None) == p("3 * y + b[3]")


def test_solver():
    s, p = LinearSolver(), ir.parse
    assert s.satisfiable(p("x < y & y < x")) is False and s.satisfiable(p("x < y & y < x + 1")) is False and s.satisfiable(p("x < y & y < x + 2")) is True
    assert s.implied(p("0 <= x & x < n & n <= m"), p("x < m")) and not s.implied(p("x < n"), p("x < n - 1"))
    assert s.valid(p("x <= 3 | x > 2")) and s.equivalent(p("!(x == y)"), p("x < y | y < x"))
    assert s.satisfiable(p("2 * x == 2 * y + 1")) is False and s.satisfiable(p("x != 3 & x >= 3 & x <= 4")) is True


@settings(max_examples=150, deadline=None)
@given(bits)
def test_solver_is_never_wrong(x):
    found = LinearSolver().satisfiable(x[0])
    if found is False:
        rng = random.Random(0)
        assert not any(x[1]({n: rng.randint(-12, 12) for n in NAMES}) for _ in range(200))


def test_loops():
    one, _, _ = cfg.loops_of([(0, 1), (1, 2), (2, 1), (1, 3)], 0)
    assert one == [(1, frozenset({1, 2}))]
    nested, _, _ = cfg.loops_of([(0, 1), (1, 2), (2, 3), (3, 2), (2, 4), (4, 1), (1, 5)], 0)
    assert nested == [(2, frozenset({2, 3})), (1, frozenset({1, 2, 3, 4}))]
    irreducible, edges, copies = cfg.loops_of([(0, 1), (0, 2), (1, 2), (2, 1), (1, 3)], 0)
    assert len(irreducible) == 1 and len(copies) == 1
    again, _, none = cfg.loops_of(edges, 0)
    assert len(again) == 1 and none == []
    assert cfg.topological([(0, 2), (0, 1), (1, 3), (2, 3)], [0, 1, 2, 3], {1: 9, 2: 5}) == [0, 2, 1, 3]


def test_loops_of_many_functions(spark):
    rows = [("f", 0, 1), ("f", 1, 2), ("f", 2, 1), ("f", 1, 3), ("g", 0, 1), ("h", 0, 1), ("h", 1, 2), ("h", 2, 3), ("h", 3, 2), ("h", 2, 1), ("h", 1, 9)]
    out = cfg.split_loops(spark.createDataFrame(rows, "function string, source int, target int"), spark.createDataFrame([(f, 0) for f in "fgh"], "function string, entry int"))
    assert sorted((r.function, r.head, r.size, r.depth, r.parent) for r in out.collect()) == [("f", 1, 2, 1, None), ("h", 1, 3, 1, None), ("h", 2, 2, 2, "loop#1")]


BRANCH = [(0, 1, "assume", "x < 0", None), (0, 2, "assume", "x >= 0", None), (1, 3, "assign", "y", "0 - x"), (2, 3, "assign", "y", "x"), (3, 4, "assign", "z", "b[y]"), (4, 5, "assume", "y < 10", None)]


def test_guards_and_values():
    block = symbolic.Block(BRANCH)
    assert block.guard[1] == ir.parse("x < 0") and block.guard[3] == ir.TRUE
    assert block.values(3, "y") == [(ir.parse("-x"), ir.parse("x < 0")), (ir.parse("x"), ir.parse("x >= 0"))]
    assert LinearSolver().equivalent(block.guard[5], ir.parse("-10 < x & x < 10"))


def test_classes_and_checks(spark):
    found = symbolic.classify(symbolic.Block(BRANCH), symbolic.assertions(symbolic.Block(BRANCH)))
    assert [(c, k) for c, k, _, _ in found] == [("check", "read_overflow"), ("trivial", "read_underflow")]
    twice = symbolic.Block([(0, 1, "assign", "z", "b[x + 1]"), (1, 2, "assign", "w", "b[x]")])
    assert [c for c, k, _, _ in symbolic.classify(twice, symbolic.assertions(twice)) if k == "read_overflow"] == ["check", "redundant"]
    rows = [("m", "f", 0, 1, "assign", "z", "b[arg]"), ("m", "good", 0, 1, "assume", "0 <= n & n < ubound(b)", None), ("m", "good", 1, 2, "call", "f", "n")]
    bad = [("k", "f", 0, 1, "assign", "z", "b[arg]"), ("k", "bad", 0, 1, "call", "f", "n")]
    df = spark.createDataFrame(rows + bad, "component string, " + symbolic.EDGES)
    out = sorted((r.component, r.kind, r.verdict) for r in symbolic.check_reports(df).collect())
    assert out == [("k", "read_overflow", "report"), ("k", "read_underflow", "report"), ("m", "read_overflow", "success"), ("m", "read_underflow", "success")]


@pytest.mark.parametrize("n", [3, 12])
def test_values_collapse_when_there_are_too_many(n):
    edges = []
    for i in range(n):
        edges += [(3 * i, 3 * i + 1, "assume", f"c{i} == 0", None), (3 * i, 3 * i + 2, "assume", f"c{i} != 0", None), (3 * i + 1, 3 * i + 3, "assign", "x", f"x + {3**i}"), (3 * i + 2, 3 * i + 3, "skip", None, None)]
    assert len(symbolic.Block(edges).values(3 * n, "x")) <= symbolic.MOST_VALUES


def test_invariants():
    body = symbolic.Block([(0, 1, "assume", "i < n", None), (1, 2, "assign", "i", "i + 1"), (2, 3, "assign", "j", "j + 3"), (3, 4, "assume", "c > 0", None), (3, 5, "assume", "c <= 0", None), (4, 6, "assign", "k", "k - 1"), (5, 6, "skip", None, None)])
    found = symbolic.loop_invariants(body)
    assert [t for t, _ in found] == ["monotonic", "monotonic", "monotonic", "linear", "tested"]
    bits = [b for _, b in found]
    assert ir.parse("k <= k__0") in bits and ir.parse("3 * (i - i__0) == j - j__0") in bits and ir.parse("i <= n") in bits
    assert symbolic.loop_invariants(symbolic.Block([(0, 1, "assign", "x", "x * x")])) == []


def bodies(spark, n):
    rows = [(f"f{i}", s, s + 1, k, a, b) for i in range(n) for s, k, a, b in ((0, "assume", "i < n", None), (1, "assign", "i", "i + 1"), (2, "assign", "z", "b[i]"))]
    return spark.createDataFrame(rows, symbolic.EDGES).coalesce(1)


@pytest.mark.parametrize("step", ["block_guards", "block_assertions", "inferred_invariants", "function_results"])
def test_functions_are_dealt_to_many_tasks(spark, step):
    # 600 rows are few bytes, but a symbolic run each: adaptive execution put them into one task.
    found = getattr(symbolic, step)(bodies(spark, 200))
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert found.select("function").distinct().count() == 200


def test_searches_are_dealt_to_many_tasks(spark, monkeypatch):
    seen, step = [], symbolic.map_groups
    monkeypatch.setattr(symbolic, "map_groups", lambda *a: seen.append(step(*a)) or seen[-1])
    edges = [(str(i), f, 0, 1, k, a, b) for i in range(40) for f, k, a, b in (("callee", "assign", "z", "b[arg]"), ("caller", "call", "callee", str(i % 3)))]
    found = symbolic.check_reports(spark.createDataFrame(edges, "component string, " + symbolic.EDGES).coalesce(1))
    assert found.filter("kind = 'read_underflow' AND verdict = 'success' AND path = 'callee < caller'").count() == 40
    assert len(seen) == 2 and all(df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism for df in seen)


def test_programs_of_suppliers_are_dealt_to_many_tasks(spark):
    # The table is one part of a file, so that one task ran every program.
    from factloom.plans import catalog_program

    found = catalog_program.other_assertions(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
