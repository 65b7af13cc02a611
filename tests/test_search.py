"""Symbolic blocks with calls and loops, the search beyond callers, invariants of functions, and solver contexts."""

from __future__ import annotations

from factloom.functions import ir
from factloom.functions.solver import SOLVERS, Context
from factloom.operators import symbolic as S

p = ir.parse


def test_calls_and_loops_in_blocks():
    edges = [(0, 1, "assign", "x", "arg0 + 1"), (1, 2, "call", "r = f", "x, 2"), (2, 3, "loop", "L", "x"), (3, 4, "assume", "x < 9", None)]
    block = S.Block(edges, effects={"f": {"g": "arg1 * 2", "h": None}})
    assert str(block.values(2, "r")[0][0]) == "ret(f, 1)" and block.values(2, "g") == [(ir.num(4), ir.TRUE)]
    assert str(block.values(2, "h")[0][0]) == "clobber(h, 1)" and str(block.values(3, "x")[0][0]) == "clobber(x, 2)"
    assert block.values(2, "x") == [(p("arg0 + 1"), ir.TRUE)]
    assert block.clobbered(edges[2], "x") == ir.TRUE and block.clobbered(edges[1], "g") == ir.FALSE
    assert block.preserved(p("arg0 + q")) and not block.preserved(p("x"))
    assert str(block.edge_guard(edges[3])) == "true" and block.translate(0, p("x"), "exit") == block.values(4, "x")
    assert block.translate_assign(1, p("y"), p("x * 2")) == [(p("y"), p("arg0 * 2 + 2"), ir.TRUE)]
    assert S.split_arguments("f(a, b), c[1, 2] ,d") == ["f(a, b)", "c[1, 2]", "d"] and S.callee_of("r = f") == ("r", "f")


def test_policies_and_hidden_values():
    edges = [(0, 1, "assume", "a < 0", None), (0, 2, "assume", "a >= 0", None), (1, 3, "assign", "x", "1"), (2, 3, "assign", "x", "2"), (3, 4, "assign", "y", "x + a")]
    assert len(S.Block(edges).values(4, "y")) == 2
    collapsed = S.Block(edges, policy="maximal")
    assert [v.terms[0][0].kind for v, _ in collapsed.values(3, "x")] == ["val"]
    assert [v for v, _ in collapsed.translate(3, p("x"), "remove_val")] == [ir.num(1), ir.num(2)] == [v for v, _ in collapsed.translate(3, p("x"), "try_remove_val")]
    result = S.Block([(0, 1, "assume", "n > 3", None), (0, 1, "skip", None, None), (1, 2, "assign", "result", "n - 5")])
    assert result.result_bit() == p("n != 5")


def search(edges, **kw):
    blocks = {f: S.Block(e) for f, e in edges.items()}
    calls = {}
    for f, e in edges.items():
        for x in e:
            if x[2] == "call":
                calls.setdefault(S.callee_of(x[3])[1], []).append((f, x[0], x[4]))
    return S.Search(blocks, calls, **kw)


def test_callee_results():
    edges = {"f": [(0, 1, "call", "n = size", "k"), (1, 2, "assign", "z", "b[n]")]}
    ask = p("n < ubound(b)")
    known = [("arg0", "arg0 < ubound(b)"), ("0", "ubound(b) > 0")]
    assert search(edges, results={"size": known}).check("f", 1, ask)[0] == "success"
    verdict, path = search(edges, results={"size": [*known, ("7", "true")]}).check("f", 1, ask)
    assert verdict == "report" and path == ["f", "size()"]
    assert search(edges).check("f", 1, ask) == ("report", ["f"])


def test_loops_run_or_not():
    edges = {"f": [(0, 1, "assign", "i", "0"), (1, 2, "assume", "0 < n & n <= ubound(b)", None), (2, 3, "loop", "L", "i"), (3, 4, "assign", "z", "b[i - 1]")]}
    ask = p("i - 1 < ubound(b)")
    assert search(edges, loops={"L": ["i <= n", "i__0 <= i"]}).check("f", 3, ask)[0] == "success"
    assert search(edges, loops={"L": ["i__0 <= i"]}).check("f", 3, ask) == ("report", ["f", "L"])
    assert search(edges, loops={"L": ["i <= n"]}).check("f", 3, p("i > 0")) == ("report", ["f", "skip L"])


def test_writers_of_the_heap():
    edges = {"f": [(0, 1, "assign", "z", "b[s[0]]")], "w": [(0, 1, "assume", "q < 5", None), (1, 2, "assign", "t", "q")], "v": [(0, 1, "assign", "t", "3")]}
    place = ir.show(next(iter(ir.atoms(p("s[0]")) - {a for a in ir.atoms(p("s[0]")) if a.kind != "drf"})).args[0])
    ask = p("s[0] < 5")
    assert search(edges, writers={place: [("w", 1, "q"), ("v", 0, "3")]}).check("f", 0, ask)[0] == "success"
    assert search(edges, writers={place: [("w", 1, "q + 1")]}).check("f", 0, ask) == ("report", ["f", "written by w"])


def test_sufficient_conditions():
    guard, keep = p("i < n & n <= m"), lambda a: a.args[0] != "i"
    assert p("n <= size") in S.sufficient(p("i < size"), guard, keep)
    assert S.sufficient(p("i != 3"), guard, keep) == []
    callee = [(0, 1, "loop", "L", "i"), (1, 2, "assume", "i < arg0", None), (2, 3, "assign", "z", "b[i]")]
    edges = {"g": callee, "f": [(0, 1, "assume", "n <= ubound(b)", None), (1, 2, "call", "g", "n")]}
    found = search(edges)
    assert found.conditions("g", 2, p("i < ubound(b)")) == [p("arg0 <= ubound(b)")]
    assert found.check("g", 2, p("i < ubound(b)"))[0] == "success"


def test_rounds_agree_with_the_search(spark):
    rows = [("callee", 0, 1, "assign", "z", "b[arg1]"), ("mid", 0, 1, "call", "callee", "0, k"), ("mid", 1, 2, "skip", None, None), ("top", 0, 1, "assume", "0 <= j & j < ubound(b)", None), ("top", 1, 2, "assign", "k", "j"), ("top", 2, 3, "call", "mid", "")]
    good = spark.createDataFrame(rows, S.EDGES)
    assert {r.kind: r.verdict for r in S.check_functions(good).collect()} == {"read_overflow": "report", "read_underflow": "report"}
    through = [(f, s, t, k, "callee" if a == "callee" else a, "0, arg0" if a == "callee" else "j" if a == "mid" else b) for f, s, t, k, a, b in rows]
    out = S.check_functions(spark.createDataFrame(through, S.EDGES)).collect()
    assert {r.kind: (r.verdict, r.path) for r in out} == {k: ("success", "callee < mid < top") for k in ("read_overflow", "read_underflow")}
    assert {r.verdict for r in S.check_functions(spark.createDataFrame(through, S.EDGES), depth=1).collect()} == {"report"}
    known = spark.createDataFrame([("f", "result", "size", "ubound(b) - 1", "ubound(b) > 0")], S.FACTS)
    one = spark.createDataFrame([("f", 0, 1, "call", "n = size", ""), ("f", 1, 2, "assign", "z", "b[n]")], S.EDGES)
    assert {r.verdict for r in S.check_functions(one, known).collect()} == {"success"}


def test_assertions_beyond_buffers():
    block = S.Block([(0, 1, "assume", "0 <= x & x < 200", None), (1, 2, "assign", "c", "x + 1"), (2, 3, "call", "alloc", ""), (3, 4, "assign", "y", "o")])
    found = S.integer_assertions(block, {"c": (8, False)})
    assert [(k, c) for c, k, _, _ in S.classify(block, found)] == [("integer_overflow", "trivial"), ("integer_underflow", "trivial")]
    assert [c for c, _, _, _ in S.classify(block, S.integer_assertions(block, {"c": (8, True)}))] == ["check", "trivial"]
    assert [b == ir.TRUE for _, _, b in S.gc_assertions(block, {"o"}, collects=frozenset({"alloc"}))] == [False]
    assert [b == ir.TRUE for _, _, b in S.gc_assertions(block, {"o"}, safe=frozenset({"o"}), collects=frozenset({"alloc"}))] == [True]


def test_invariants_of_functions_and_texts():
    block = S.Block([(0, 1, "assume", "arg0 < 0", None), (0, 2, "assume", "arg0 >= 0", None), (1, 3, "assign", "result", "0"), (2, 3, "assign", "result", "arg0")])
    assert sorted((t, str(b)) for t, b in S.function_invariants(block)) == [("bounded", "(-return <= 0)"), ("bounded", "(arg0 - return <= 0)")]
    scan = S.Block([(0, 1, "assume", "s[i] != 0", None), (1, 2, "assign", "i", "i + 1")])
    assert S.terminator_tests(scan) == [("s", ir.var("i"), 0)] or S.terminator_tests(scan)[0][1:] == (ir.var("i"), 0)
    assert S.compare_equalities(S.base_compares(p("x <= 3 & y != 2"))) == [("==", ir.var("x"), ir.num(3)), ("==", ir.var("x"), ir.num(4))]


def test_contexts_scopes_and_models():
    c = Context()
    c.assert_bit(0, p("x > 3 & y == x * 2"))
    c.push()
    c.assert_bit(0, p("y < 5"))
    assert c.satisfiable() is False
    c.pop()
    m = c.model()
    assert c.value(0, p("y - 2 * x"), m) == 0 and c.value(0, p("x > 3"), m)
    c.assert_equal(0, p("x"), 1, p("a"))
    c.assert_bit(1, p("a < 3"))
    assert c.satisfiable() is False
    product = Context()
    product.assert_bit(0, p("x * y == 12 & x > 1 & y > 1 & x < 10 & y < 10"))
    m = product.model()
    assert m["x@0"] * m["y@0"] == 12
    rest = Context()
    rest.assert_bit(0, p("x % 7 > 6"))
    assert rest.satisfiable() is False
    seen = []
    rest.register(lambda b: seen.append(b) or [])
    rest.assert_bit(0, p("z > 0"))
    assert len(seen) == 1
    assert [SOLVERS["both"]().satisfiable(p(t)) for t in ("x > 3 & x < 2", "x > 3")] == [False, True]


def test_expressions():
    x = ir.deref(ir.field(ir.index(ir.var("p"), "e", ir.num(3)), "f"))
    part = ir.remainder(x, ir.var("p"))
    assert ir.root(x) == "p" and ir.base_field(x) == "f" and ir.compose(ir.var("p"), part) == x and ir.remainder(x, ir.var("q")) is None
    assert ir.null_test(ir.atom("addr", "v")) == ir.FALSE and ir.null_test(ir.num(0)) == ir.TRUE and ir.null_test(ir.var("v")) == p("v == 0")
    assert ir.terminate(ir.index(ir.atom("text", "abc"), "e", ir.num(1)), "e") == ir.num(2)
    arrays = {"a": (10, 4), "tail": (1, 1)}
    assert ir.explicit_bound("ubound", ir.index(ir.atom("addr", "a"), "e", p("i")), 1, arrays) == p("40 - 4 * i")
    assert ir.explicit_bound("ubound", ir.atom("addr", "tail"), 1, arrays, frozenset({"tail"})) is None and ir.explicit_bound("lbound", ir.atom("addr", "tail"), 1, arrays) == ir.num(0)
    assert ir.scale_index(p("i"), 8, 4) == p("2 * i") and ir.scale_index(p("i"), 4, 8) is None
    assert ir.substitute_all(p("x + y"), lambda a: [ir.num(1), ir.num(2)] if a.args[0] == "x" else None) == [p("y + 1"), p("y + 2")]
    assert ir.substitute_all(p("x"), lambda a: [ir.num(i) for i in range(99)]) == []
    assert ir.has_directive(p("directive(skip_inference) > 0"), "skip_inference") and not ir.has_directive(p("x > 0"))
    assert [a.kind for a in ir.visit(p("b[i] + c"), "lval")] == ["drf"] and len(ir.visit(p("b[i] + c"), "leaf")) == 3
