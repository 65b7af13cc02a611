"""Queries of operators on program facts: joins by function, accesses, dispatch, side effects, search steps, invariants."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import ir
from factloom.functions.solver import Context
from factloom.operators import callgraph, escape, graph, joins, library, symbolic
from factloom.plans.catalog import query
from factloom.plans.tables import FLOW, STEPS, entry_and_head, flow, points, steps, table, written_points
from factloom.session import dealt


def put(*xs):
    """Texts and columns as one text."""
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))


# --- joins


@query("""SELECT 'f' || p_partkey AS function, CASE WHEN p_size > 10 THEN p_type END AS cfg, CASE WHEN p_size % 2 = 0 THEN p_brand END AS memory, m.body AS modset, p_name AS summary
FROM part LEFT JOIN (SELECT l_partkey, CAST(max(l_suppkey) AS VARCHAR) AS body FROM lineitem GROUP BY l_partkey) AS m ON l_partkey = p_partkey""")
def function_facts(spark, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("function", put("f", F.col("p_partkey")))
    fact = lambda body, cond="true": part.filter(cond).select("function", F.col(body).alias("body"))
    modset = table(spark, sf_dir, "lineitem").groupBy(put("f", F.col("l_partkey")).alias("function")).agg(F.max("l_suppkey").cast("string").alias("body"))
    return joins.by_function(part, cfg=fact("p_type", "p_size > 10"), memory=fact("p_brand", "p_size % 2 = 0"), modset=modset, summary=fact("p_name"))


@query("SELECT DISTINCT l_orderkey AS site, 'g' || l_suppkey AS name, 'g > ' || s_nationkey AS bit FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0")
def global_invariants(spark, sf_dir: str) -> DataFrame:
    writes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("site"), put("g", F.col("l_suppkey")).alias("name"))
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(put("g", F.col("s_suppkey")).alias("name"), put("g > ", F.col("s_nationkey")).alias("bit"))
    return joins.globals_at_writes(writes, known)


@query("SELECT DISTINCT l_orderkey AS site, 'v' || l_suppkey AS object, 'v' || l_suppkey || '.f' || i || ' <= v' || l_suppkey || '.n' AS bit FROM lineitem JOIN part ON p_partkey = l_partkey, range(3) AS t(i) WHERE l_linenumber IN (i + 1, i + 2)")
def read_invariants(spark, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    reads = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("site"), put("v", F.col("l_suppkey")).alias("object"), F.col("p_brand").alias("owner"), F.col("l_linenumber").cast("string").alias("field"))
    i = F.col("i")
    known = part.select(F.col("p_brand").alias("owner")).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("owner", F.array((i + 1).cast("string"), (i + 2).cast("string")).alias("fields"), put("this.f", i, " <= this.n").alias("bit"))
    return joins.invariants_at_reads(reads, known)


@query("""WITH a AS (SELECT DISTINCT o_custkey AS c, o_orderkey % 10 AS k FROM orders WHERE o_orderstatus = 'F')
SELECT DISTINCT 'f' || (o_custkey % 50) AS function, o_orderkey AS point, 'note' || k AS name FROM orders JOIN a ON c = o_custkey AND k = o_orderkey % 10""")
def annotation_points(spark, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    function, k = put("f", F.col("o_custkey") % 50).alias("function"), F.col("o_orderkey") % 10
    edges = orders.select(function, F.col("o_orderkey").alias("point"), put("  x", F.col("o_custkey"), "  =\t", k, " ; ").alias("text"))
    notes = orders.filter("o_orderstatus = 'F'").select(function, put("x", F.col("o_custkey"), " = ", k).alias("text"), put("note", k).alias("name"))
    return joins.annotations_at_points(edges, notes)


@query("""WITH p AS (SELECT DISTINCT conv_id, turn FROM conversations), b AS (
  SELECT conv_id, turn, 'c' || role AS bit, 'callee' AS origin FROM conversations UNION ALL SELECT conv_id, turn, 'inv' || conv_id % 3, 'invariant' FROM p
  UNION ALL SELECT conv_id, turn, 'c' || role, 'annotation' FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, 'inv0', 'summary' FROM p WHERE conv_id % 2 = 0)
SELECT conv_id AS function, turn AS point, bit, min(origin) AS origin FROM b GROUP BY ALL""")
def assumed_bits(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("function"), F.col("turn").alias("point"), put("c", F.col("role")).alias("bit"))
    functions, nowhere = turns.select("function").distinct(), F.lit(None).cast("long").alias("point")
    invariant = functions.select("function", nowhere, put("inv", F.col("function") % 3).alias("bit"))
    summary = functions.filter("function % 2 = 0").select("function", nowhere, F.lit("inv0").alias("bit"))
    return joins.assumed_bits(turns.select("function", "point").distinct(), callee=turns, invariant=invariant, annotation=turns.filter("point % 2 = 0"), summary=summary)


@query("SELECT p_brand AS owner, 'f' || p_size AS field, bool_or(p_partkey % 5 = 0) AS safe FROM part GROUP BY ALL")
def safe_fields(spark, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    known = part.select(F.col("p_brand").alias("owner"), F.when(F.col("p_partkey") % 5 == 0, put("gcsafe(this.f", F.col("p_size"), ")")).otherwise(F.lit("this.f0 < 3")).alias("bit"))
    return joins.safe_fields(part.select(F.col("p_brand").alias("owner"), put("f", F.col("p_size")).alias("field")), known)


# --- accesses, dispatch, side effects


@query("""WITH e AS (SELECT l_orderkey AS site, l_returnflag AS flag, l_suppkey AS s, l_linenumber AS n FROM lineitem),
w AS (SELECT site, 'write' AS kind, place, field FROM e, LATERAL (VALUES ('A', 'g', 'g'), ('A', 'f' || n || '.g', 'g'), ('A', 'o' || s || '.f' || n || '.g', 'g'), ('N', 'h', 'h'), ('N', 'a.h', 'h'), ('R', 'p', NULL)) AS v(f, place, field) WHERE f = flag)
SELECT DISTINCT * FROM (SELECT * FROM w UNION ALL SELECT site, 'read', 'x' || n, NULL FROM e WHERE flag <> 'R')""")
def access_facts(spark, sf_dir: str) -> DataFrame:
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    target = F.when(flag == "A", put("(*o", F.col("l_suppkey"), "->f", n, "[3].g)")).when(flag == "N", put("a[", F.col("l_partkey"), "].h")).otherwise(F.lit("*p"))
    return escape.accesses(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("site"), target.alias("target"), F.when(flag == "R", "3 + y").otherwise(put("&x", n)).alias("value")))


@query("""SELECT 'C' || c_custkey AS class, 'N' || c_nationkey AS base FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 2 UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation WHERE n_regionkey < 2""")
def base_class_edges(spark, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    r = put("R", F.col("n_regionkey"))
    bases = table(spark, sf_dir, "customer").select(put("C", F.col("c_custkey")).alias("class"), put("N", F.col("c_nationkey")).alias("base")).unionByName(nation.select(put("N", F.col("n_nationkey")).alias("class"), r.alias("base"))).unionByName(region.select(put("R", F.col("r_regionkey")).alias("class"), F.lit("World").alias("base")))
    return escape.base_class_edges(bases, region.filter("r_regionkey < 2").select(put("R", F.col("r_regionkey")).alias("class"), F.lit("m").alias("method")))


@query("""SELECT DISTINCT p_partkey AS formula, place FROM part, LATERAL (VALUES ('f'), ('o' || p_size || '.f'), ('g'), ('i' || p_size), ('y'), ('x.y')) AS v(place)""")
def update_places(spark, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return escape.update_places(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("formula"), put("o", size, "->f + g[i", size, "] <= len(x.y) & 3 < ", size).alias("text")))


@query("""WITH t AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p, p_size % 3 AS arity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'O')
SELECT DISTINCT l_orderkey AS site, 'fn' || p AS function, 'pointer' AS how FROM lineitem JOIN t ON s = l_suppkey AND arity = l_linenumber % 3 WHERE l_returnflag = 'R'
UNION SELECT -c_custkey, 'R' || n_regionkey || '::' || c_mktsegment, 'virtual' FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def indirect_calls(spark, sf_dir: str) -> DataFrame:
    lines, customer, nation = (table(spark, sf_dir, t) for t in ("lineitem", "customer", "nation"))
    both = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    none = F.lit(None).cast("string")
    through = lines.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("site"), put("p", F.col("l_suppkey")).alias("pointer"), (F.col("l_linenumber") % 3).alias("arity"), none.alias("class"), none.alias("method"))
    on = both.select((-F.col("c_custkey")).alias("site"), none.alias("pointer"), F.lit(None).cast("int").alias("arity"), put("R", F.col("n_regionkey")).alias("class"), F.col("c_mktsegment").alias("method"))
    live = lines.filter("l_linestatus = 'O'")
    flows = live.select(put("fn", F.col("l_partkey")).alias("source"), put("q", F.col("l_suppkey")).alias("target")).unionByName(live.select(put("q", F.col("l_suppkey")).alias("source"), put("p", F.col("l_suppkey")).alias("target")))
    functions = table(spark, sf_dir, "part").select(put("fn", F.col("p_partkey")).alias("function"), (F.col("p_size") % 3).alias("arity"))
    virtual = both.select(put("R", F.col("n_regionkey")).alias("class"), F.col("c_mktsegment").alias("method")).distinct().withColumn("function", F.concat("class", F.lit("::"), "method"))
    return callgraph.all_targets(through.unionByName(on), flows, functions, virtual)


@query("""SELECT 'R' || r_regionkey AS class, 'R' || r_regionkey AS sub, 'this.x' AS receiver FROM region UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey, 'rfld(this, reg).x' FROM nation
UNION ALL SELECT 'R' || n_regionkey, 'C' || c_custkey, 'rfld(rfld(this, reg), nat).x' FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def receiver_chains(spark, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    bases = customer.select(put("C", F.col("c_custkey")).alias("class"), put("N", F.col("c_nationkey")).alias("base"), F.lit("nat").alias("field")).unionByName(nation.select(put("N", F.col("n_nationkey")).alias("class"), put("R", F.col("n_regionkey")).alias("base"), F.lit("reg").alias("field")))
    found = callgraph.receiver_chains(bases, table(spark, sf_dir, "region").select(put("R", F.col("r_regionkey")).alias("class")))
    return found.select("class", "sub", callgraph.adjust_receiver(F.lit("this.x"), F.col("chain")).alias("receiver"))


@query("""WITH a AS (SELECT 'f' || l_suppkey AS function, l_returnflag = 'A' AS t, CASE l_linenumber % 6 WHEN 0 THEN '*arg0' WHEN 1 THEN '**arg1' WHEN 2 THEN 'glob:g.f' || l_partkey % 9 WHEN 3 THEN 'local' WHEN 4 THEN 'this.a.b.c.d.e.f.g' ELSE 'arg2[3]' END AS lval,
  CASE WHEN l_partkey % 9 < 5 THEN CAST(l_partkey % 4 AS VARCHAR) ELSE 'x' || l_partkey % 4 END AS value FROM lineitem),
k AS (SELECT function, lval, list_sort(list(DISTINCT value)) AS vs FROM a WHERE lval = '*arg0' OR starts_with(lval, 'glob') OR (lval = '**arg1' AND t) GROUP BY ALL)
SELECT function, lval, CASE WHEN len(vs) <= 2 OR len(list_filter(vs, lambda v: starts_with(v, 'x'))) = 0 THEN array_to_string(vs, ' | ') END AS exact FROM k""")
def updated_lvals(spark, sf_dir: str) -> DataFrame:
    n, p = F.col("l_linenumber") % 6, F.col("l_partkey")
    lval = F.when(n == 0, "*arg0").when(n == 1, "**arg1").when(n == 2, put("glob:g.f", p % 9)).when(n == 3, "local").when(n == 4, "this.a.b.c.d.e.f.g").otherwise("arg2[3]")
    value = F.when(p % 9 < 5, (p % 4).cast("string")).otherwise(put("x", p % 4))
    return callgraph.updated_lvals(table(spark, sf_dir, "lineitem").select(put("f", F.col("l_suppkey")).alias("function"), lval.alias("lval"), value.alias("value"), (F.col("l_returnflag") == "A").alias("terminator")))


# --- known library functions


def _calls(spark, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    function = F.when(k == 0, "a.c:strcpy(char*, char*)").when(k == 1, "strcat").when(k == 2, "malloc").otherwise("strlen")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("site"), function.alias("function"), F.array(put("b", F.col("l_suppkey")), put("s", F.col("l_partkey"))).alias("args"))


@query("SELECT l_orderkey AS site, 'b' || l_suppkey AS target, CASE WHEN l_linenumber % 4 = 0 THEN 'strlen(s' || l_partkey || ')' ELSE 'strlen(b' || l_suppkey || ') + strlen(s' || l_partkey || ')' END AS ends FROM lineitem WHERE l_linenumber % 4 < 2")
def library_terminators(spark, sf_dir: str) -> DataFrame:
    return library.terminator_effects(_calls(spark, sf_dir))


@query("SELECT l_orderkey AS site, CASE l_linenumber % 4 WHEN 2 THEN 'malloc' ELSE 'strlen' END AS name, CASE l_linenumber % 4 WHEN 2 THEN 'return == 0 | ubound(return) >= b' || l_suppkey ELSE 'return == term(b' || l_suppkey || ')' END AS bit FROM lineitem WHERE l_linenumber % 4 >= 2")
def library_postconditions(spark, sf_dir: str) -> DataFrame:
    return library.postconditions(_calls(spark, sf_dir))


@query("SELECT p_brand AS owner, 'f' || p_partkey AS field, CASE WHEN p_size % 2 = 0 THEN 'const struct T' || p_size || ' **' ELSE 'T' || p_size END AS type, p_size % 3 = 0 AS collected FROM part")
def collected_types(spark, sf_dir: str) -> DataFrame:
    part, size = table(spark, sf_dir, "part"), F.col("p_size")
    fields = part.select(F.col("p_brand").alias("owner"), put("f", F.col("p_partkey")).alias("field"), F.when(size % 2 == 0, put("const struct T", size, " **")).otherwise(put("T", size)).alias("type"))
    return library.collected_types(fields, part.filter(size % 3 == 0).select(put("T", size).alias("name")))


# --- expressions, solver, assertions, search, invariants: a small program per supplier, whose numbers are the supplier's


def _numbers(spark, sf_dir: str) -> DataFrame:
    """A row for each program, dealt out: a small table is one part of a file, but each of its rows is work for Python."""
    return dealt(table(spark, sf_dir, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 50).cast("int").alias("k"))


@query("""SELECT s_suppkey AS key, 40 - 4 * (s_suppkey % 50) AS bound, 2 * (s_suppkey % 50) AS scaled, 9 - s_suppkey % 50 AS ends, 'p' AS root, 'drf(fld(index(q, e, ' || s_suppkey % 50 || '), f))' AS composed, 's.x != 0' AS tested FROM supplier WHERE s_suppkey % 50 > 0
UNION ALL SELECT s_suppkey, 40, 0, 9, 'p', 'drf(fld(q, f))', 's.x != 0' FROM supplier WHERE s_suppkey % 50 = 0""")
def expression_algebra(spark, sf_dir: str) -> DataFrame:
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for key, k in zip(frame.key, frame.k, strict=True):
                at = ir.num(int(k))
                whole = ir.deref(ir.field(ir.index(ir.var("p"), "e", at), "f"))
                moved = ir.compose(ir.var("q"), ir.remainder(whole, ir.var("p")))
                number = lambda x: x.const if not x.terms else None
                bound = ir.explicit_bound("ubound", ir.index(ir.atom("addr", "a"), "e", at), 1, {"a": (10, 4)})
                ends = ir.terminate(ir.index(ir.atom("text", "some text"), "e", at), "e")
                rows.append((key, number(bound), number(ir.scale_index(at, 8, 4)), number(ends), ir.root(whole), str(moved), "s.x != 0" if not ir.null_test(ir.field(ir.var("s"), "x")).args else "?"))
            yield pd.DataFrame(rows, columns=["key", "bound", "scaled", "ends", "root", "composed", "tested"])

    return _numbers(spark, sf_dir).mapInPandas(build, "key long, bound long, scaled long, ends long, root string, composed string, tested string")


@query("SELECT s_suppkey AS key, s_suppkey % 50 AS total, true AS apart, true AS feasible, false AS with_more, s_suppkey % 50 < 3 AS equal_frames, CASE WHEN s_suppkey % 50 % 2 = 0 THEN (s_suppkey % 50) * 2 ELSE 0 END AS product FROM supplier")
def solver_contexts(spark, sf_dir: str) -> DataFrame:
    """Scopes, frames and models: x + y is the number and x > y >= 0; a scope that asks for more fails and is given up."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for key, k in zip(frame.key.tolist(), frame.k.tolist(), strict=True):
                c = Context()
                c.assert_bit(0, ir.parse(f"x + y == {k} & x >= y & y >= 0"))
                model = c.model()
                c.push()
                c.assert_bit(0, ir.parse(f"x > {k}"))
                more = c.satisfiable()
                c.pop()
                feasible = c.satisfiable()
                c.push()
                c.assert_bit(1, ir.parse("a < 3"))
                c.assert_equal(0, ir.parse("x + y"), 1, ir.parse("a"))
                frames = c.satisfiable()
                c.pop()
                p = Context()
                p.assert_bit(0, ir.parse(f"u * v == {2 * k} & u == 2 & v >= 0"))
                found = p.model() if k % 2 == 0 else {"u@0": 0, "v@0": 0}
                rows.append((key, c.value(0, ir.parse("x + y"), model), bool(c.value(0, ir.parse("x >= y"), model)), feasible, more, frames, found["u@0"] * found["v@0"]))
            yield pd.DataFrame(rows, columns=["key", "total", "apart", "feasible", "with_more", "equal_frames", "product"])

    return _numbers(spark, sf_dir).mapInPandas(solve, "key long, total long, apart boolean, feasible boolean, with_more boolean, equal_frames boolean, product long")


def _program(spark, sf_dir: str, functions: dict[str, list[tuple]]) -> DataFrame:
    """Edges of functions by name, a copy for each supplier, with ``{k}`` as the supplier's number and ``{i}`` as its key."""
    fill = lambda c: F.regexp_replace(F.regexp_replace(c, r"\{k\}", F.col("k").cast("string")), r"\{i\}", F.col("key").cast("string"))
    rows = [(f, s, t, kind, a, b) for f, edges in functions.items() for s, t, kind, a, b in edges]
    template = F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for v, n, t in zip(r, ("function", "source", "target", "kind", "a", "b"), ("string", "int", "int", "string", "string", "string"), strict=True))) for r in rows))
    each = _numbers(spark, sf_dir).select("key", "k", F.explode(template).alias("e")).select("key", "k", "e.*")
    return each.select(fill(F.col("function")).alias("function"), "source", "target", "kind", fill(F.col("a")).alias("a"), fill(F.col("b")).alias("b"))


@query("""WITH s AS (SELECT s_suppkey AS i, s_suppkey % 50 AS k FROM supplier)
SELECT 'callee' || i AS function, 'read_overflow' AS kind, CASE WHEN k < 25 THEN 'success' ELSE 'report' END AS verdict FROM s UNION ALL SELECT 'callee' || i, 'read_underflow', 'success' FROM s
UNION ALL SELECT 'loop' || i, 'read_overflow', CASE WHEN k < 25 THEN 'success' ELSE 'report' END FROM s UNION ALL SELECT 'loop' || i, 'read_underflow', 'success' FROM s
UNION ALL SELECT 'leaf' || i, 'read_overflow', CASE WHEN k <= 25 THEN 'success' ELSE 'report' END FROM s UNION ALL SELECT 'leaf' || i, 'read_underflow', 'report' FROM s""")
def check_steps(spark, sf_dir: str) -> DataFrame:
    """Into a callee's result, past a loop, and to a caller by a condition that suffices: each depends on the number."""
    edges = _program(spark, sf_dir, {
        "callee{i}": [(0, 1, "assume", "ubound(b) == 25", None), (1, 2, "call", "n = size{i}", ""), (2, 3, "assign", "z", "b[n]")],
        "loop{i}": [(0, 1, "assume", "ubound(b) == 25", None), (1, 2, "assign", "i", "0"), (2, 3, "loop", "L{i}", "i"), (3, 4, "assign", "z", "b[i]")],
        "leaf{i}": [(0, 1, "loop", "M{i}", "i"), (1, 2, "assume", "i < arg0", None), (2, 3, "assign", "z", "b[i]")],
        "caller{i}": [(0, 1, "assume", "ubound(b) == 25", None), (1, 2, "call", "leaf{i}", "{k}")],
    })
    numbers = _numbers(spark, sf_dir)
    none = F.lit(None).cast("string")
    results = numbers.select(put("callee", F.col("key")).alias("function"), F.lit("result").alias("kind"), put("size", F.col("key")).alias("name"), F.col("k").cast("string").alias("a"), none.alias("b"))
    loops = numbers.select(put("loop", F.col("key")).alias("function"), F.lit("loop").alias("kind"), put("L", F.col("key")).alias("name"), F.explode(F.array(put("i <= ", F.col("k")), F.lit("i__0 <= i"))).alias("a"), none.alias("b"))
    return symbolic.check_functions(edges, results.unionByName(loops)).select("function", "kind", "verdict")


@query("SELECT s_suppkey AS key, CASE WHEN s_suppkey % 50 * 9 <= 255 THEN 'trivial' ELSE 'check' END AS overflow, 'trivial' AS underflow, s_suppkey % 2 = 0 AS unsafe_read, 2 AS scanned FROM supplier")
def other_assertions(spark, sf_dir: str) -> DataFrame:
    """Integer ranges, reads of collected objects, and terminators that a scan tests for."""

    def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for key, k in zip(frame.key.tolist(), frame.k.tolist(), strict=True):
                b = symbolic.Block([(0, 1, "assume", f"0 <= x & x < {9 * k}", None), (1, 2, "assign", "c", "x + 1"), (2, 3, "call", "alloc" if key % 2 == 0 else "other", ""), (3, 4, "assign", "y", "o"), (4, 5, "assume", f"s[i] != {k} & s[i + 1] != 0", None)])
                found = {kind: c for c, kind, _, _ in symbolic.classify(b, symbolic.integer_assertions(b, {"c": (8, False)}))}
                reads = symbolic.gc_assertions(b, {"o"}, collects=frozenset({"alloc"}))
                rows.append((key, found["integer_overflow"], found["integer_underflow"], reads[0][2] != ir.TRUE, len(symbolic.terminator_tests(b))))
            yield pd.DataFrame(rows, columns=["key", "overflow", "underflow", "unsafe_read", "scanned"])

    return _numbers(spark, sf_dir).mapInPandas(generate, "key long, overflow string, underflow string, unsafe_read boolean, scanned long")


@query("""SELECT 'c' || s_suppkey AS function, 'fixed' AS template, CASE s_suppkey % 50 WHEN 0 THEN '(return == 0)' ELSE '(return - ' || s_suppkey % 50 || ' == 0)' END AS bit FROM supplier
UNION ALL SELECT 'm' || s_suppkey, 'bounded', CASE s_suppkey % 50 WHEN 0 THEN '(-return <= 0)' ELSE '(-return + ' || s_suppkey % 50 || ' <= 0)' END FROM supplier
UNION ALL SELECT 'm' || s_suppkey, 'bounded', '(arg0 - return <= 0)' FROM supplier""")
def function_invariants(spark, sf_dir: str) -> DataFrame:
    """A constant, and the larger of the argument and a constant."""
    edges = _program(spark, sf_dir, {"c{i}": [(0, 1, "assign", "result", "{k}")], "m{i}": [(0, 1, "assume", "arg0 < {k}", None), (0, 2, "assume", "arg0 >= {k}", None), (1, 3, "assign", "result", "{k}"), (2, 3, "assign", "result", "arg0")]})
    return symbolic.function_results(edges)


# --- loops as graphs, stored rows


@query("""WITH c AS (SELECT 'f' || conv_id AS function, max(turn) AS n FROM conversations GROUP BY conv_id HAVING max(turn) >= 2)
SELECT function, 'func' AS graph, 0 AS source, 1 AS target, 'edge' AS kind FROM c UNION ALL SELECT function, 'func', 1, 100002, 'loop' FROM c UNION ALL SELECT function, 'func', 100002, 100000, 'edge' FROM c
UNION ALL SELECT function, 'func/loop#0', t, t + 1, 'edge' FROM c, range(1, 200) AS r(t) WHERE t < n UNION ALL SELECT function, 'func/loop#0', n, 100001, 'edge' FROM c UNION ALL SELECT function, 'func/loop#0', 100002, 1, 'same' FROM c""")
def loop_graphs(spark, sf_dir: str) -> DataFrame:
    """A loop over the turns of each conversation, left at its head."""
    last = table(spark, sf_dir, "conversations").groupBy(put("f", F.col("conv_id")).alias("function")).agg(F.max("turn").alias("n")).filter("n >= 2")
    edge = lambda a, b: last.select("function", a.cast("long").alias("source"), b.cast("long").alias("target"))
    line = last.select("function", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("source")).withColumn("target", F.col("source") + 1)
    edges = line.unionByName(edge(F.col("n"), F.lit(1))).unionByName(edge(F.lit(1), F.lit(100_000)))
    from factloom.operators import cfg

    return cfg.split_graphs(edges, last.select("function", F.lit(0).alias("entry")))


@query("SELECT place, key FROM (SELECT row_number() OVER (ORDER BY min(event_id)) - 1 AS place, CAST(user_id AS VARCHAR) AS key FROM events GROUP BY user_id)")
def kv_key_at(spark, sf_dir: str) -> DataFrame:
    from factloom.operators import store
    from factloom.plans.tables import kv_log

    log = kv_log(spark, sf_dir)
    return store.key_at(log, spark.range(log.select("key").distinct().count()).select(F.col("id").alias("place")))


@query("SELECT doc_id AS key, sha256(text) AS digest FROM documents")
def kv_inflated(spark, sf_dir: str) -> DataFrame:
    """Texts that are stored compressed by turns."""
    import zlib

    from factloom.operators import store

    @F.pandas_udf("binary")
    def stored(key: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([zlib.compress(t.encode()) if k % 2 else t.encode() for k, t in zip(key, text, strict=True)])

    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("key"), F.sha2(store.inflated(stored("doc_id", "text")), 256).alias("digest"))


@query("SELECT DISTINCT 'click' AS tag, user_id FROM events WHERE event_type = 'click' UNION ALL SELECT DISTINCT 'view', user_id FROM events WHERE event_type = 'view'")
def routed_rows(spark, sf_dir: str) -> DataFrame:
    from factloom.operators import diff

    found = diff.routed(table(spark, sf_dir, "events").select(F.col("event_type").alias("tag"), "user_id"), ["click", "view"])
    return diff.deferred(diff.pending(*(df.withColumn("tag", F.lit(t)) for t, df in found.items())), ["tag", "user_id"]).select("tag", "user_id")


@query("""SELECT DISTINCT l_orderkey AS owner, l_partkey AS name FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'A')
AND (l_orderkey, l_partkey) NOT IN (SELECT (l_orderkey, l_partkey) FROM lineitem WHERE l_returnflag <> 'A')""")
def retired_annotations(spark, sf_dir: str) -> DataFrame:
    from factloom.operators import diff

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("name"), "l_returnflag")
    return diff.retired(rows.filter("l_returnflag = 'A'").select("owner", "name"), rows.filter("l_returnflag <> 'A'").select("owner", "name"), "owner", ["owner", "name"]).distinct().select("owner", "name")


@query("""SELECT 'C' || c_custkey AS name, 0 AS place FROM customer WHERE c_acctbal < 0 UNION ALL SELECT DISTINCT 'N' || c_nationkey, 1 FROM customer WHERE c_acctbal < 0
UNION ALL SELECT DISTINCT 'R' || n_regionkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal < 0 UNION ALL SELECT DISTINCT 'World', 3 FROM customer WHERE c_acctbal < 0""")
def declaration_order(spark, sf_dir: str) -> DataFrame:
    """What the world's regions, nations and customers need of each other, the customers first."""
    from factloom.operators import diff

    customer, nation = table(spark, sf_dir, "customer").filter("c_acctbal < 0"), table(spark, sf_dir, "nation")
    world, r, n, c = F.lit("World"), put("R", F.col("n_regionkey")), put("N", F.col("n_nationkey")), put("C", F.col("c_custkey"))
    both = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    uses = both.select(world.alias("src"), r.alias("dst")).unionByName(both.select(r.alias("src"), n.alias("dst"))).unionByName(both.select(n.alias("src"), c.alias("dst"))).distinct()
    return diff.declarations(uses.filter("src = 'World'").select(F.col("src").alias("node")).distinct(), uses)


# --- skips, entries into loops


@query(f"""WITH {STEPS}, skip AS (SELECT node FROM points AS p WHERE flag = 'N' AND place < n),
hops AS (SELECT node, min(t.target) AS target FROM skip JOIN (SELECT p.node AS target, p.first FROM points AS p WHERE p.node NOT IN (SELECT node FROM skip)) AS t ON t.target > skip.node AND t.first = (skip.node // 1000) * 1000 + 1 GROUP BY node)
SELECT DISTINCT src, coalesce(target, dst) AS dst FROM edges LEFT JOIN hops ON hops.node = dst WHERE src NOT IN (SELECT node FROM skip)""")
def flatten_skips(spark, sf_dir: str) -> DataFrame:
    """Points with flag N do nothing but go on."""
    p = written_points(spark, sf_dir)
    return graph.flatten_skips(steps(spark, sf_dir, p), p.filter("flag = 'N' AND place < n").select("node", (F.col("node") + 1).alias("next")))


@query(f"WITH {FLOW}, inside AS (SELECT node, first FROM points WHERE place BETWEEN 2 AND 4) SELECT DISTINCT src, dst FROM edges WHERE dst IN (SELECT node FROM inside) AND src NOT IN (SELECT node FROM inside) AND dst NOT IN (SELECT node FROM points WHERE place = 2)")
def loop_reentries(spark, sf_dir: str) -> DataFrame:
    return graph.reentered(flow(spark, sf_dir), points(spark, sf_dir).filter("place BETWEEN 2 AND 4").select("node"), entry_and_head(spark, sf_dir)[1])


@query("""WITH e AS (SELECT l_orderkey AS site, l_returnflag AS flag, 'v' || l_suppkey AS value, 'f' || l_suppkey AS callee, 'o' || l_partkey AS o FROM lineitem)
SELECT DISTINCT o AS source, callee || ':this' AS target, site, 'call' AS move FROM e WHERE flag = 'R' UNION ALL SELECT DISTINCT value, 't', site, 'stay' FROM e WHERE flag = 'A'""")
def instance_flows(spark, sf_dir: str) -> DataFrame:
    flag, none = F.col("l_returnflag"), F.lit(None).cast("string")
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.select(F.col("l_orderkey").alias("site"), F.when(flag == "A", "assign").otherwise("call").alias("kind"), F.when(flag == "A", "t").alias("target"), F.when(flag == "A", put("v", F.col("l_suppkey"))).alias("value"), put("f", F.col("l_suppkey")).alias("callee"), F.lit(0).alias("position"), F.when(flag == "R", put("o", F.col("l_partkey"))).otherwise(none).alias("instance"))
    return escape.flows(edges, edges.select("callee", "position", F.lit("p").alias("name")).limit(0))


@query("""SELECT p_partkey AS name, CASE WHEN p_size % 7 = 0 THEN NULL ELSE '(' || CASE WHEN p_size = 3 THEN '(x <= 0)' WHEN p_size > 3 THEN '(x + ' || p_size - 3 || ' <= 0)' ELSE '(x - ' || 3 - p_size || ' <= 0)' END || ' & (y - 2 != 0))' END AS bit, p_size % 7 = 0 AS failed FROM part""")
def annotation_bits(spark, sf_dir: str) -> DataFrame:
    """Texts of annotations, some of which aren't formulas."""
    size = F.col("p_size")
    text = F.when(size % 7 == 0, put("x + ", size, " <= import(")).otherwise(put("x + ", size, " <= 3 & !(y == 2)"))
    found = symbolic.annotation_bits(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), text.alias("text")))
    return found.select("name", "bit", F.col("error").isNotNull().alias("failed"))
