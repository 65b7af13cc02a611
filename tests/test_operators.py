"""Semantics that the tables don't reach, against hand-made facts."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import callgraph, diff, escape, graph, guards, multimap, reporting, store
from factloom.plans import transaction as T
from factloom.sources import sinks, text


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_lookup_of_missing_and_empty(spark):
    kv = spark.createDataFrame([("a", "1"), ("b", "")], "key string, value string")
    asked = spark.createDataFrame([("a",), ("c",)], "key string")
    assert got(store.lookup(kv, asked, strict=True)) == [("a", "1"), ("c", "")]
    with pytest.raises(PySparkException):
        store.lookup(kv, spark.createDataFrame([("b",)], "key string"), strict=True).collect()


def test_multimap_keys_without_values(spark):
    log = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("b", 3, "y"), ("b", 4, "x")], "key string, seq long, value string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert got(multimap.lookup(log, asked)) == [("a", 0, ""), ("b", 2, "x,y"), ("c", 0, "")]
    assert got(multimap.is_member(log, asked)) == [("a", True), ("b", True), ("c", False)]
    assert got(multimap.insert_check(log).select("seq", "existed", "n_values")) == [(2, False, 1), (3, False, 2), (4, True, 2)]
    with pytest.raises(PySparkException):
        multimap.lookup_single(log, asked, strict=True).collect()


def test_reading_creates_a_multimap(spark):
    maps = multimap.Registry(spark)
    maps.all_keys("h")
    assert not maps.exists("h")
    assert maps.choose_key("h") == "" and maps.exists("h")


def test_counters():
    c = multimap.Counters()
    assert c.dec("missing") and c.value("missing") == 0
    c.inc("n")
    assert c.dec("n") and not c.dec("n")


def test_transactions(spark):
    t = T.Transaction(T.registry(multimap.Registry(spark), multimap.Counters()))
    t.run(T.Sequence([T.Assign("$l", ["a"]), T.Foreach("x", ["b", "c"], T.Call("list_push", (T.Var("$l"), T.Var("x")), "$l"))]))
    assert t.returned() == {"$l": ["a", "b", "c"]}
    for bad in (T.Call("nothing"), T.Assign("y", T.Var("unbound")), T.Test(1, T.Assign("z", 1)), T.Call("value_less", (1, -1), "r"), T.Call("counter_inc", ("n",), "r")):
        with pytest.raises(T.TransactionError):
            t.run(bad)


def test_claim_once(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "key string")
    todo, seen = diff.claim(a, spark.createDataFrame([("y",)], "key string"))
    assert got(todo) == [("x",)] and got(diff.claim(a, seen)[0]) == []


def test_staging_of_a_cycle_with_leaves(spark):
    calls = edges(spark, [("scc1", "scc2"), ("scc1", "callee1"), ("scc1", "indirect1"), ("scc2", "scc3"), ("scc2", "callee2"), ("scc2", "indirect2"), ("scc3", "scc1"), ("scc3", "callee3"), ("caller1", "scc1"), ("caller2", "scc2"), ("caller3", "scc3"), ("par_caller1", "caller1"), ("par_caller2", "caller2"), ("par_caller3", "caller3"), ("callee1", "outside")])
    every = nodes(spark, {x for r in calls.collect() for x in r} - {"outside"})
    out = dict(got(graph.stages(every, calls, nodes(spark, ["indirect1", "indirect2"]))))
    assert {n for n, s in out.items() if s == 0} == {"callee1", "callee2", "callee3"}
    assert sum(s == -1 for s in out.values()) == 11 and set(out.values()) == {0, -1}


def test_self_call_is_never_staged(spark):
    assert got(graph.stages(nodes(spark, ["a", "b"]), edges(spark, [("a", "a"), ("b", "a")]))) == [("a", -1), ("b", -1)]


def test_loop_with_two_back_edges(spark):
    e = edges(spark, [("in", "head"), ("head", "x"), ("x", "y"), ("y", "head"), ("x", "head"), ("head", "out"), ("out", "end")])
    entry, head = nodes(spark, ["in"]), nodes(spark, ["head"])
    assert got(graph.back_edges(e, entry, head)) == [("x", "head"), ("y", "head")]
    assert got(graph.loop_body(e, entry, head)) == [("head",), ("x",), ("y",)]
    assert got(graph.trim(edges(spark, [("in", "a"), ("a", "end"), ("in", "b"), ("b", "b")]), entry, nodes(spark, ["end"]))) == [("a",), ("end",), ("in",)]


def test_skip_chains_and_cycles(spark):
    skips = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "node string, next string")
    assert got(graph.follow(skips)) == [("a", "d"), ("b", "d"), ("c", "d")]


def test_context_must_match_on_return(spark):
    e = spark.createDataFrame([("a", "f", "1", "call"), ("b", "f", "2", "call"), ("f", "a_out", "1", "return"), ("f", "b_out", "2", "return")], "source string, target string, site string, move string")
    out = got(graph.context_closure(e, nodes(spark, ["a"])))
    assert ("a", "a_out", "") in out and not any(x[1] == "b_out" for x in out)


def test_virtual_dispatch(spark):
    bases = spark.createDataFrame([("B", "A"), ("C", "A"), ("D", "B")], "class string, base string")
    methods = spark.createDataFrame([("A", "Set", None), ("B", "Set", "B::Set"), ("C", "Set", "C::Set"), ("A", "a1", "A::a1"), ("D", "a1", "D::a1")], "class string, method string, function string")
    calls = spark.createDataFrame([("A", "Set"), ("A", "a1"), ("B", "a1")], "class string, method string")
    assert got(callgraph.virtual_targets(bases, methods, calls)) == [("A", "Set", "B::Set"), ("A", "Set", "C::Set"), ("A", "a1", "A::a1"), ("A", "a1", "D::a1"), ("B", "a1", "A::a1"), ("B", "a1", "D::a1")]


def test_recursive_modset(spark):
    calls = spark.createDataFrame([("foo", "foo", "*arg0", "*arg1"), ("foo", "foo", "*arg1", "*arg0")], "caller string, callee string, formal string, actual string")
    own = spark.createDataFrame([("foo", "*arg0")], "function string, lval string")
    assert got(callgraph.argument_modsets(calls, own)) == [("foo", "*arg0"), ("foo", "*arg1")]


def test_folding(spark):
    df = spark.createDataFrame([(-7, 2), (7, -2), (-8, 2), (7, 0), (-5, 70)], "a long, b long")
    out = got(df.select("a", "b", S.fold_binop("div", F.col("a"), F.col("b")).alias("d"), S.fold_binop("mod", F.col("a"), F.col("b")).alias("m"), S.fold_binop("shift_left", F.col("a"), F.col("b")).cast("string"), S.fold_binop("shift_right", F.col("a"), F.col("b")).cast("long")))
    assert out == sorted([(-7, 2, -4, 1, "-28", -1), (7, -2, -4, 0, "0", 0), (-8, 2, -4, 0, "-32", -2), (7, 0, 0, 0, "7", 7), (-5, 70, -1, 65, "0", 0)], key=str)
    with pytest.raises(PySparkException):
        df.select(S.value_less(F.col("a"), F.col("b"))).collect()


def test_names(spark):
    one = spark.range(1)
    path = lambda p, base="": one.select(S.normalize_file(F.lit(p), base)).first()[0]
    assert [path("/w/src/../a/./b.c", "/w/"), path("../x/y.c"), path("<builtin>"), path("/a//b/..")] == ["a/b.c", "../x/y.c", "<builtin>", "/a"]
    assert S.unescape_literal(r"a\n\x41\101\"") == b'a\nAA"' and S.unescape_literal("\\q") is None
    assert S.integer_range(8, True) == ("-128", "127") and S.integer_range(16, False) == ("0", "65535")


def test_last_report_is_dropped_by_default(spark):
    t = spark.createDataFrame([(1, "A x"), (1, "B y"), (2, "A x"), (3, "C z")], "report long, trait string")
    assert got(reporting.cluster(reporting.report_traits(t))) == [("A x", 2, 2)]
    assert got(reporting.cluster(reporting.report_traits(t, drop_last=False))) == [("A x", 2, 2), ("C z", 1, 1)]


def test_no_assertions_is_no_division_by_zero(spark):
    log = spark.createDataFrame([("Finished: 'f' FILE a.c REDUNDANT 0 ASSERTION 0 SUCCESS 0 REPORT 0",)], "line string")
    assert got(reporting.ratios(reporting.totals(log))) == [(0.0, 0.0)]
    assert got(reporting.rollup_directories(reporting.finished(log))) == []


def test_guards(spark):
    v = spark.createDataFrame([(1, "a", "p"), (1, "a", "q"), (1, "b", "long"), (2, "a", "p")], "k long, value string, guard string")
    assert got(guards.simplify(guards.combine(v, ["k"]), ["k"])) == [(1, "a", "!(long)"), (1, "b", "long")][::1] + [(2, "a", "true")]


def test_sources(spark, tmp_path):
    unit = spark.createDataFrame([("u", '# 1 "a.c"\nint x;\n# 1 "h.h"\nint h;\n# 2 "a.c"\nint y;')], "unit string, text string")
    assert got(text.split_preprocessed(unit).select("file", "line", "text")) == [("a.c", 1, "int x;"), ("a.c", 2, "int y;"), ("h.h", 1, "int h;")]
    lines = spark.createDataFrame(list(enumerate(["#new", "a.c$f", "a.c$g", "#old", "b.c$h"])), "line_no long, line string")
    assert got(text.parse_worklist(lines).select("stage", "function")) == [(0, "f"), (0, "g")]
    notes = spark.createDataFrame([("n", i, x) for i, x in enumerate(["hook1", "x > 0", "trusted", "", "hook2", "y"])], "file string, line_no long, line string")
    assert got(text.parse_annotations(notes)) == [("n", "hook1", "x > 0", True), ("n", "hook2", "y", False)]
    (tmp_path / "f.txt").write_bytes(b"abc\0def")
    assert text.read_whole(spark, str(tmp_path / "f.txt")).first()["text"] == "abc"


def test_report_xml(spark):
    frames = "array<struct<function:string,points:array<struct<file:string,line:int,text:string>>>>"
    r = spark.createDataFrame([("n<1>", "Timeout", [("f", [("a.c", 3, "x & y")])])], f"name string, kind string, frames {frames}")
    assert sinks.report_xml(r).first()["xml"] == "<path><name>n&lt;1&gt;</name><frame><function>f</function><point><file>a.c</file><line>3</line><text>x &amp; y</text></point></frame></path>"


def test_rows_and_partitions_dont_matter(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("d", "a"), ("c", "e")])
    n = nodes(spark, "abcde")
    assert got(graph.stages(n, e)) == got(graph.stages(n.repartition(7), e.repartition(3).orderBy(F.rand(1))))


def test_job_queue(spark, tmp_path):
    from factloom.streaming.jobs import watch_jobs

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"job":"a","kind":"k","payload":"p","submitted":"2024-01-01T00:00:00Z"}\n' * 2 + '{"job":"b","kind":"k","payload":"p","submitted":"2024-01-01T00:00:01Z"}\n')
    seen = []
    watch_jobs(spark, str(tmp_path / "in"), lambda df, n: seen.extend(r.job for r in df.collect()), str(tmp_path / "state")).awaitTermination()
    assert sorted(seen) == ["a", "b"]


def test_places_and_struct_copies(spark):
    out = spark.range(1).select(escape.matches(F.lit("v"), F.lit("a.b")).alias("m")).first()["m"]
    assert [tuple(x) for x in out] == [("b", 0), ("a.b", 1), ("v.a.b", 2)]
    assert [tuple(x) for x in spark.range(1).select(escape.matches(F.lit("v"), F.lit("")).alias("m")).first()["m"]] == [("v", 0)]
    fields = spark.createDataFrame([("S", "x", "int"), ("S", "t", "T"), ("T", "y", "int")], "type string, field string, field_type string")
    copies = spark.createDataFrame([("a", "b", "S"), ("i", "j", "int")], "source string, target string, type string")
    assert got(escape.expand_struct(copies, fields)) == [("a.t.y", "b.t.y", "int"), ("a.x", "b.x", "int"), ("i", "j", "int")]


def test_flows_and_heap_writes(spark):
    edges = spark.createDataFrame([("1", "assign", "p", "q", None, None), ("2", "call", "r", "q", "f", 0)], "site string, kind string, target string, value string, callee string, position int")
    assert got(escape.flows(edges, spark.createDataFrame([("f", 0, "f:x")], "callee string, position int, name string"))) == [("f:return", "r", "2", "return"), ("q", "f:x", "2", "call"), ("q", "p", "1", "stay")]
    writes = spark.createDataFrame([("f", "1", 0), ("v.f", "2", 0), ("v.f", "3", 0)], "place string, site string, version long")
    versions = spark.createDataFrame([("1", 0), ("2", 0), ("3", 1)], "site string, version long")
    assert got(escape.heap_writes(spark.createDataFrame([("r", "v", "f")], "read string, base string, chain string"), writes, versions)) == [("r", "f", "1"), ("r", "v.f", "2")]


def test_pages(spark):
    reports = spark.createDataFrame([("d/a.c", "r1"), ("d/a.c", "r2"), ("d/e/b.c", "r3")], "file string, name string")
    pages = dict(got(sinks.index_pages(reports)))
    assert pages["d"] == '<ul><li><a href="d/a.c">a.c</a> 2</li><li><a href="d/e">e</a> 1</li></ul>' and pages[""] == '<ul><li><a href="d">d</a> 3</li></ul>'
    out = sinks.source_pages(spark.createDataFrame([("r1", "a.c", 2)], "name string, file string, line int"), spark.createDataFrame([("a.c", "x\ny < z\nw")], "file string, text string"))
    assert out.first()["html"] == "<pre>x\n<b>y &lt; z</b>\nw</pre>"


def test_fixpoints_run_to_the_end(spark):
    n = 1_000
    chain = spark.range(n).selectExpr("id AS src", "id + 1 AS dst")
    start = spark.createDataFrame([(0,)], "node long")
    assert graph.reach(chain, start).count() == n + 1
    assert graph.closure(chain, start).agg({"hops": "max"}).first()[0] == n
    ring = chain.unionByName(spark.createDataFrame([(n, 0)], "src long, dst long"))
    assert graph.closure(ring, start).filter("dst = 0").first().hops == n + 1
    assert graph.reach(ring, spark.createDataFrame([(5,)], "node long"), avoid=spark.createDataFrame([(3,)], "node long")).count() == n - 1
    full = spark.range(80).selectExpr("id AS src").crossJoin(spark.range(80).selectExpr("id AS dst"))
    assert graph.closure(full).count() == 6_400
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long"), start)
    assert graph.closure(chain, start, depth=7).count() == 7


def test_struct_nested_deep(spark):
    fields = spark.createDataFrame([(f"t{i}", "f", f"t{i + 1}") for i in range(20)], "type string, field string, field_type string")
    copies = spark.createDataFrame([("a", "b", "t0")], "source string, target string, type string")
    (row,) = escape.expand_struct(copies, fields).collect()
    assert row.type == "t20" and row.source == "a" + ".f" * 20
    with pytest.raises(ValueError, match="holds itself"):
        escape.expand_struct(copies, fields.unionByName(spark.createDataFrame([("t9", "g", "t2")], fields.schema)))


def test_contexts_forget_the_oldest_site(spark):
    rows = [(f"n{i}", f"n{i + 1}", str(i), "call") for i in range(6)] + [(f"n{i}", f"n{i + 1}", str(11 - i), "return") for i in range(6, 12)]
    edges = spark.createDataFrame(rows, "source string, target string, site string, move string")
    found = {r.target: r.context for r in graph.context_closure(edges, nodes(spark, ["n0"]), max_context=2).collect()}
    assert found["n6"] == "4/5" and found["n8"] == "" and found["n12"] == ""
    assert graph.context_closure(edges.unionByName(spark.createDataFrame([("n3", "n0", "9", "call")], edges.schema)), nodes(spark, ["n0"]), max_context=2).filter("target = 'n12'").count() >= 1


def test_rows_of_a_round_are_written_once(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "key string, v int")
    with pytest.raises(PySparkException):
        diff.deferred(rows, ["key"]).collect()
    assert diff.deferred(rows.limit(1), ["key"]).count() == 1
    with pytest.raises(PySparkException):
        store.by_tag(spark.createDataFrame([(9,)], "tag int"), {1: "cfg"}).collect()
    assert store.by_tag(spark.createDataFrame([(1,)], "tag int"), {1: "cfg"}).first().kind == "cfg"


def test_values_are_carried_over_ranges(spark):
    from factloom.plans.order import carried

    rows = [(i, i if i % 700 == 5 else None) for i in range(5_000)]
    out = carried(spark.createDataFrame(rows, "at long, mark long"), ["at"], "mark", "last")
    assert all(r["last"] == (None if r["at"] < 5 else (r["at"] - 5) // 700 * 700 + 5) for r in out.collect())


def test_places_and_nested_loops(spark):
    from factloom.operators.cfg import loop_graphs

    column = lambda x: F.lit(x)
    out = spark.range(1).select(*(escape.place_of(column(t)).alias(f"c{i}") for i, t in enumerate(("*p->next[3].val", "&x", "f(y)", "3 + y", "(*a).b")))).first()
    assert tuple(out) == ("p.next.val", "x", None, None, None) or tuple(out)[:4] == ("p.next.val", "x", None, None)
    graphs, same = loop_graphs([(0, 1), (1, 2), (2, 2), (2, 1), (1, 5), (2, 6)], 0)
    assert {g for g, *_ in graphs} == {"func", "func/loop#1", "func/loop#1/loop#0"} and [k for *_, k in graphs].count("loop") >= 2
    assert all(a != b for _, a, b, _ in graphs) and {o for _, _, o in same} == {1, 2, *[o for _, _, o in same if o > 6]}


def test_report_pages_with_values_traits_and_neighbours(spark):
    shape = "name string, kind string, file string, frames array<struct<function string, points array<struct<file string, line int, text string, values array<struct<name string, value int>>>>>>, traits array<string>"
    point = ("a.c", 3, "x < y", [("x", 5)])
    rows = [(f"k$a.c$f{i}$loop$0", "k", "a.c", [(f"f{i}", [point])], ["Field x"]) for i in range(3)]
    reports = spark.createDataFrame(rows, shape)
    xml = sinks.report_xml(reports).first().xml
    assert "<value><name>x</name><is>5</is></value>" in xml and "<trait>Field x</trait>" in xml and "x &lt; y" in xml
    pages = {r.name: r for r in sinks.report_pages(reports, spark.createDataFrame([(rows[0][0],)], "name string"), "2024-01-02").collect()}
    first, second = pages[rows[0][0]], pages[rows[1][0]]
    assert "(new)" not in first.html and "(new)" in second.html and "previous" not in first.html and second.html.count("href") == 2
    assert "<i>x = 5</i>" in second.html and "2024-01-02" in second.html and second.page.startswith("f1_")


def test_indirect_targets_are_told_apart_as_lists(spark):
    # A row per site and target went through the last exchange; lists of few sites are enough.
    sites = spark.createDataFrame([(1, "p", 1, None, None), (1, "p", 1, None, None), (2, "p", 1, None, None), (2, "q", 1, None, None), (2, "q", 0, None, None), (3, None, None, "C", "m"), (3, None, None, "C", "m"), (None, "p", 1, None, None)], "site long, pointer string, arity int, class string, method string")
    flows = spark.createDataFrame([("f", "x"), ("g", "x"), ("x", "p"), ("g", "q"), ("h", "q"), ("g", "q")], "source string, target string")
    functions = spark.createDataFrame([("f", 1), ("g", 1), ("g", 0), ("h", 0), ("h", 0)], "function string, arity int")
    found = callgraph.all_targets(sites, flows, functions, spark.createDataFrame([("C", "m", "C::m")], "class string, method string, function string"))
    assert got(found) == sorted([(1, "f", "pointer"), (1, "g", "pointer"), (2, "f", "pointer"), (2, "g", "pointer"), (2, "h", "pointer"), (3, "C::m", "virtual"), (None, "f", "pointer"), (None, "g", "pointer")], key=str)
    single = callgraph.all_targets(sites, flows, functions.filter("function <> 'g' OR arity = 1"), spark.createDataFrame([("C", "m", "C::m")], "class string, method string, function string"))
    assert got(single) == got(found)
    assert "_distinct(flatten" in found._jdf.queryExecution().optimizedPlan().toString()
