"""Guards and values of acyclic blocks, assertions with their classes, and the search for paths to a failing one.

A block is a list of edges (source, target, kind, a, b): skip; assume a (a formula); assign a := b; call a (a function's name,
or ``r = name`` where r takes what it returns) with b as its arguments, split by commas, for the parameters ``arg`` or
``arg0``, ``arg1`` …; loop a (a loop's name), after which the variables b, split by commas, may have changed. Every point gets
a guard over the block's entry state, and every variable a list of (value, guard). What a call or loop may have changed,
by the callee's side effects, is an unknown of its own (``clobber``) unless the effect is an exact value; what a call
returns is another (``ret``).
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import ir
from factloom.functions.ir import FALSE, TRUE, Bit, Lin
from factloom.functions.solver import SOLVERS, LinearSolver, Recorded
from factloom.operators.cfg import topological
from factloom.session import dealt, map_groups, materialize, once

#: Values of one variable beyond which they collapse into an unknown.
MOST_VALUES = 20


def split_arguments(text: str | None) -> list[str]:
    """Arguments at the commas outside of parentheses."""
    out, depth = [""], 0
    for c in text or "":
        depth += (c in "([") - (c in ")]")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out if x.strip()]


def callee_of(a: str) -> tuple[str | None, str]:
    """Variable that takes the result, and the function, of a call edge."""
    result, eq, name = a.partition("=")
    return (result.strip(), name.strip()) if eq else (None, a.strip())


#: When the values of a variable are taken together as one unknown: never below so many.
POLICIES = {"none": MOST_VALUES + 1, "group4": 4, "maximal": 2}


class Block:
    """``effects`` gives for a function's name the globals that it changes: {name: text of the exact value over its parameters, or None}."""

    def __init__(self, edges: list[tuple], entry: int = 0, effects: dict[str, dict[str, str | None]] | None = None, policy: str = "none"):
        self.edges, self.entry, self.effects, self.most = edges, entry, effects or {}, min(POLICIES[policy], MOST_VALUES + 1)
        points = sorted({entry, *(e[0] for e in edges), *(e[1] for e in edges)})
        self.order = topological([(e[0], e[1]) for e in edges], points, {})
        self.into = defaultdict(list)
        for e in edges:
            self.into[e[1]].append(e)
        self.guard: dict[int, Bit] = {entry: TRUE}
        self.state: dict[int, dict[str, list[tuple[Lin, Bit]]]] = {entry: {}}
        self.hidden: dict[tuple[str, int], list[tuple[Lin, Bit]]] = {}
        for p in self.order:
            if p != entry:
                self._enter(p)

    @property
    def exit(self) -> int:
        return self.order[-1] if self.order else self.entry

    def values(self, point: int, name: str) -> list[tuple[Lin, Bit]]:
        return self.state[point].get(name, [(ir.var(name), TRUE)])

    def translate(self, point: int, x: Lin, kind: str = "point") -> list[tuple[Lin, Bit]]:
        """Values of an expression at a point, over the entry state: one for each choice of its variables' values.

        kind ``exit`` reads it at the block's exit; ``remove_val`` also takes unknowns that stand for several values apart,
        and ``try_remove_val`` does so unless that makes more than MOST_VALUES.
        """
        point = self.exit if kind == "exit" else point
        names = sorted({a.args[0] for a in ir.atoms(x) if a.kind == "var"} & set(self.state[point]))
        out = [({}, TRUE)]
        for n in names:
            out = [(d | {n: v}, g) for d, h in out for v, k in self.values(point, n) if (g := ir.conjoin(h, k)) != FALSE]
        found = combine([(ir.substitute(x, lambda a, d=d: d.get(a.args[0]) if a.kind == "var" else None), g) for d, g in out])
        if kind in ("remove_val", "try_remove_val"):
            apart = self._apart(found)
            return found if kind == "try_remove_val" and len(apart) > MOST_VALUES else apart
        return found

    def _apart(self, values: list[tuple[Lin, Bit]]) -> list[tuple[Lin, Bit]]:
        out = []
        for v, g in values:
            known = next((a for a in sorted(ir.atoms(v), key=ir.show) if a.kind == "val" and a.args in self.hidden), None)
            if known is None:
                out.append((v, g))
            else:
                out += self._apart([(ir.substitute(v, lambda a, w=w: w if a == known else None), h) for w, k in self.hidden[known.args] if (h := ir.conjoin(g, k)) != FALSE])
        return combine(out)

    def translate_bit(self, point: int, b: Bit) -> Bit:
        if b.kind in ir.OPS:
            return ir.disjoin(*(ir.conjoin(g, ir.compare(ir.OPS[b.kind], v, ir.num(0))) for v, g in self.translate(point, b.args[0])))
        return (ir.conjoin if b.kind == "and" else ir.disjoin)(*(self.translate_bit(point, x) for x in b.args)) if b.args else b

    def translate_assign(self, point: int, left: Lin, right: Lin, when: Bit = TRUE) -> list[tuple[Lin, Lin, Bit]]:
        """(target, value, guard) of an assignment at a point, over the entry state; a plain variable is its own target."""
        a = left.terms[0][0] if len(left.terms) == 1 and not left.const else None
        targets = [(left, TRUE)] if a is not None and a.kind == "var" else self.translate(point, left)
        held = self.translate_bit(point, when)
        return [(t, v, g) for t, h in targets for v, k in self.translate(point, right) if (g := ir.conjoin(h, k, held)) != FALSE]

    def receivers(self, point: int, pointer: str) -> list[tuple[Lin, Bit]]:
        """What a call through a pointer at a point may run, under what guards."""
        return self.values(point, pointer)

    def changed_by(self, edge: tuple) -> dict[str, list[tuple[Lin, Bit]] | None]:
        """Variables that an edge may change, with their values after it over the state at its source; None for an unknown."""
        source, _, kind, a, b = edge
        if kind == "assign" and "[" not in a and "." not in a:
            return {a: [(ir.parse(b), TRUE)]}
        if kind == "loop":
            return dict.fromkeys(split_arguments(b))
        if kind == "call":
            result, name = callee_of(a)
            arguments = split_arguments(b)
            out: dict[str, list[tuple[Lin, Bit]] | None] = {}
            for lval, value in self.effects.get(name, {}).items():
                out[lval] = None if value is None else [(actual_for_formal(ir.parse(value), arguments), TRUE)]
            if result:
                out[result] = [(ir.atom("ret", name, source), TRUE)]
            return out
        return {}

    def transfer(self, edge: tuple, name: str) -> list[tuple[Lin, Bit]]:
        """Values of a variable after an edge, over the entry state."""
        source = edge[0]
        changed = self.changed_by(edge)
        if name not in changed:
            return self.values(source, name)
        if changed[name] is None:
            return [(ir.atom("clobber", name, source), TRUE)]
        return combine([(v, ir.conjoin(g, h)) for x, g in changed[name] for v, h in self.translate(source, x)])

    def clobbered(self, edge: tuple, name: str) -> Bit:
        """Under what guard an edge leaves a variable unknown."""
        changed = self.changed_by(edge)
        return self.guard.get(edge[0], FALSE) if name in changed and changed[name] is None else FALSE

    def preserved(self, x: Lin | Bit) -> bool:
        """Whether an expression or formula has the same value at exit as on entry."""
        if self.exit not in self.state:
            return False
        return all(self.values(self.exit, a.args[0]) == [(ir.var(a.args[0]), TRUE)] for a in ir.atoms(x) if a.kind == "var")

    def edge_guard(self, edge: tuple) -> Bit:
        """The guard that an edge adds to where it leads, without what holds there anyway."""
        source, target, kind, a, _ = edge
        guard = self.guard.get(source, FALSE)
        if kind == "assume":
            guard = ir.conjoin(guard, self.translate_bit(source, ir.parse(a)))
        return ir.reduce(guard, self.guard.get(target, FALSE))

    def result_bit(self, name: str = "result") -> Bit:
        """The formula that an annotation's block stands for: that its result isn't zero at exit."""
        return ir.disjoin(*(ir.conjoin(g, ir.compare("!=", v, ir.num(0))) for v, g in self.values(self.exit, name)))

    def _enter(self, p: int) -> None:
        guards, merged = [], defaultdict(list)
        incoming = [e for e in self.into[p] if e[0] in self.guard]
        names = {n for e in incoming for n in self.state[e[0]]} | {n for e in incoming for n in self.changed_by(e)}
        for e in incoming:
            source, _, kind, a, _ = e
            guard = self.guard[source]
            if kind == "assume":
                guard = ir.conjoin(guard, self.translate_bit(source, ir.parse(a)))
            guards.append(guard)
            for n in names:
                merged[n] += [(v, ir.conjoin(guard, g)) for v, g in self.transfer(e, n)]
        if not guards:
            return
        self.guard[p] = ir.disjoin(*guards)
        state = {}
        for n in names:
            state[n] = simplify(combine(merged[n]), self.guard[p])
            if len(state[n]) >= self.most:
                self.hidden[n, p] = state[n]
                state[n] = [(ir.atom("val", n, p), TRUE)]
        self.state[p] = state


def actual_for_formal(x: Lin | Bit, arguments: list[str]) -> Lin | Bit:
    """An expression or formula over parameters with the arguments put in; a missing argument stays a parameter."""
    values = {f"arg{i}": ir.parse(a) for i, a in enumerate(arguments)}
    if arguments:
        values["arg"] = values["arg0"]
    return ir.substitute(x, lambda a: values.get(a.args[0]) if a.kind == "var" else None)


def combine(values: list[tuple[Lin, Bit]]) -> list[tuple[Lin, Bit]]:
    """Equal values under the disjunction of their guards, in order of value; false ones go."""
    by: dict[Lin, list[Bit]] = defaultdict(list)
    for v, g in values:
        if g != FALSE:
            by[v].append(g)
    return [(v, ir.disjoin(*by[v])) for v in sorted(by, key=ir.show)]


def simplify(values: list[tuple[Lin, Bit]], base: Bit) -> list[tuple[Lin, Bit]]:
    """Guards where base holds: a single value's is true."""
    return [(values[0][0], TRUE)] if len(values) == 1 else [(v, ir.reduce(g, base)) for v, g in values]


def accesses(x: Lin) -> list[tuple[Lin, Lin]]:
    """(buffer, place) of every indexed access in an expression."""
    return [(a.args[0].terms[0][0].args[0], a.args[0].terms[0][0].args[2]) for a in sorted(ir.atoms(x), key=ir.show) if a.kind == "drf" and a.args[0].terms and a.args[0].terms[0][0].kind == "index"]


def assertions(block: Block) -> list[tuple[str, int, Bit]]:
    """(kind, point, formula): every access is at or above the lower bound, zero, and below the upper bound of its buffer."""
    found = {}
    for source, _, kind, a, b in block.edges:
        if kind != "assign":
            continue
        sides = [("write", ir.parse(a) if "[" in a else None), ("read", ir.parse(b))]
        for side, x in sides:
            for buffer, at in accesses(x) if x is not None else ():
                found[f"{side}_underflow", source, ir.compare("<=", ir.num(0), at)] = 1
                found[f"{side}_overflow", source, ir.compare("<", at, ir.bound("ubound", buffer, "e"))] = 1
    return sorted(found, key=lambda x: (x[0], x[1], ir.show(x[2])))


def integer_assertions(block: Block, widths: dict[str, tuple[int, bool]]) -> list[tuple[str, int, Bit]]:
    """(kind, point, formula): values given to variables of a width (bits, sign) are in its range."""
    found = []
    for source, _, kind, a, b in block.edges:
        if kind == "assign" and a in widths and ir.parse(b).terms:
            bits, sign = widths[a]
            low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if sign else (0, (1 << bits) - 1)
            found.append(("integer_underflow", source, ir.compare("<=", ir.num(low), ir.parse(b))))
            found.append(("integer_overflow", source, ir.compare("<=", ir.parse(b), ir.num(high))))
    return sorted(dict.fromkeys(found), key=lambda x: (x[0], x[1], ir.show(x[2])))


def gc_assertions(block: Block, collected: set[str], safe: frozenset[str] = frozenset(), collects: frozenset[str] = frozenset()) -> list[tuple[str, int, Bit]]:
    """(kind, point, formula): a variable that holds a collected object and was set before a call that may collect is safe
    when it is read. Safe ones (by declaration) are trivially true."""
    found = []
    for source, _, kind, a, b in block.edges:
        if kind not in ("assign", "assume"):
            continue
        reads = {x.args[0] for x in ir.atoms(ir.parse(b if kind == "assign" else a)) if x.kind == "var"} & collected
        for name in sorted(reads):
            risky = any(e[2] == "call" and callee_of(e[3])[1] in collects and e[1] <= source for e in block.edges)
            found.append(("gc_safe", source, TRUE if name in safe or not risky else ir.compare("==", ir.gc_safe(ir.var(name)), ir.num(1))))
    return list(dict.fromkeys(found))


def base_compares(b: Bit) -> list[tuple[str, Lin, Lin]]:
    """(operator, left, right) of every comparison in a formula, with what is added on one side and taken away on the other."""
    if b.kind not in ir.OPS:
        return [x for part in b.args for x in base_compares(part)]
    x = b.args[0]
    left = Lin(max(x.const, 0), tuple((a, c) for a, c in x.terms if c > 0))
    right = Lin(max(-x.const, 0), tuple((a, -c) for a, c in x.terms if c < 0))
    return [(ir.OPS[b.kind], left, right)]


def compare_equalities(compares: list[tuple[str, Lin, Lin]]) -> list[tuple[str, Lin, Lin]]:
    """Comparisons as the equalities at their edge: the place where <= or >= turns."""
    out = [("==", x, y) for op, x, y in compares if op in ("==", "<=")] + [("==", x, ir.add(y, ir.num(1))) for op, x, y in compares if op == "<="]
    return list(dict.fromkeys(out))


def function_invariants(block: Block, result: str = "result", solver: LinearSolver | None = None) -> list[tuple[str, Bit]]:
    """(template, formula) about a function's result that hold at its exit: fixed, copied from a parameter or beside it by a
    constant, not negative, not zero, and within what its tests compare it with."""
    solver = solver or LinearSolver()
    if block.exit not in block.guard:
        return []
    r = ir.var("return")
    values = block.values(block.exit, result)
    guard = block.guard[block.exit]
    guesses: list[tuple[str, Bit]] = [("fixed", ir.compare("==", r, ir.num(v.const))) for v, _ in values if not v.terms]
    guesses += [("copied", ir.compare("==", r, v)) for v, _ in values if v.terms and not any(a.kind != "var" for a in ir.atoms(v))]
    for _, x, y in (c for b in (guard, *(g for _, g in values)) for c in base_compares(b)):
        guesses += [("bounded", ir.compare(op, r, z)) for z in (x, y) for op in ("<=", ">=")]
    guesses += [("sign", ir.compare(">=", r, ir.num(0))), ("nonzero", ir.compare("!=", r, ir.num(0)))]
    found: list[tuple[str, Bit]] = []
    for template, guess in dict.fromkeys(guesses):
        holds = all(solver.implied(ir.conjoin(guard, g, *(ir.substitute(b, lambda a, v=v: v if a == r.terms[0][0] else None) for _, b in found)), ir.substitute(guess, lambda a, v=v: v if a == r.terms[0][0] else None)) for v, g in values)
        implied = solver.implied(ir.conjoin(*(b for _, b in found)), guess) if found else solver.valid(guess)
        if holds and not implied:
            found.append((template, guess))
    for x in list(found):  # what a later one has made needless
        others = [b for y in found if y != x for b in (y[1],)]
        if others and solver.implied(ir.conjoin(*others), x[1]):
            found.remove(x)
    return found


def terminator_tests(block: Block) -> list[tuple[str, Lin, int]]:
    """(text, index, value): reads of an element that are compared with a constant, which may be the text's terminator."""
    out = []
    for _, _, kind, a, _ in block.edges:
        if kind != "assume":
            continue
        for op, x, y in base_compares(ir.parse(a)):
            for side, other in ((x, y), (y, x)):
                a0 = side.terms[0][0] if len(side.terms) == 1 else None
                if op in ("==", "!=") and a0 is not None and a0.kind == "drf" and not other.terms and (found := accesses(side)):
                    out.append((ir.show(found[0][0]), found[0][1], other.const))
    return list(dict.fromkeys(out))


def terminator_invariant(text: Lin, index: Lin, start: Lin, value: int = 0) -> Bit:
    """If a text has its terminator at or after where a scan began, it has it at or after where the scan is."""
    ends = ir.terminate(text, "e", value)
    return ir.implies(ir.compare(">=", ir.sub(ends, start), ir.num(0)), ir.compare(">=", ir.sub(ends, index), ir.num(0)))


def classify(block: Block, asserts: list[tuple[str, int, Bit]], solver: LinearSolver | None = None) -> list[tuple[str, str, int, Bit]]:
    """(class, kind, point, formula): trivial if the guard implies it, redundant if with others of the kind that aren't redundant
    themselves, in order; else check."""
    solver, out = solver or LinearSolver(), []
    live = {}
    for n, (kind, point, bit) in enumerate(asserts):
        if point in block.guard:
            live[n] = (kind, point, ir.implies(block.guard[point], block.translate_bit(point, bit)))
    classes = {}
    for n, (_, _, b) in live.items():
        classes[n] = "trivial" if solver.valid(b) else "check"
    for n, (kind, _, b) in live.items():
        if classes[n] == "check":
            others = [live[m][2] for m in live if m != n and classes[m] == "check" and live[m][0] == kind]
            if others and solver.implied(ir.conjoin(*others), b):
                classes[n] = "redundant"
    for n, (kind, point, bit) in enumerate(asserts):
        out.append((classes.get(n, "trivial"), kind, point, bit))
    return out


def parameters(b: Bit) -> set[str]:
    return {a.args[0] for a in ir.atoms(b) if a.kind == "var" and str(a.args[0]).startswith("arg") and (a.args[0] == "arg" or str(a.args[0])[3:].isdigit())}


def sufficient(safe: Bit, guard: Bit, keep: Callable[[Any], bool]) -> list[Bit]:
    """Stronger formulas that make ``safe`` hold under ``guard`` and speak of atoms to keep alone, by adding multiples of what
    the guard says: from i < n and the wish i < size the wish n <= size."""
    if safe.kind != "le":
        return []
    known = [g.args[0] for g in (guard.args if guard.kind == "and" else (guard,)) if g.kind == "le"]
    known += [x for g in (guard.args if guard.kind == "and" else (guard,)) if g.kind == "eq" for x in (g.args[0], ir.neg(g.args[0]))]
    out, todo = [], [safe.args[0]]
    for _ in range(4):
        after = []
        for wish in todo:
            other = next(((a, c) for a, c in wish.terms if not keep(a)), None)
            if other is None:
                found = ir.compare("<=", wish, ir.num(0))
                if found not in (*out, safe, FALSE):
                    out.append(found)
                continue
            a, c = other
            for k in known:
                d = dict(k.terms).get(a, 0)
                if d and c % d == 0 and c // d > 0:
                    after.append(ir.sub(wish, ir.scale(k, c // d)))
        todo = after[:100]
    return out


class Search:
    """The search for a path to a failing assertion, backward through callers, callees, loops and writers of the heap.

    blocks: function to its Block. calls: callee to (caller, point, arguments). results: function to its values (text, formula) over
    its parameters, of which one is returned. loops: loop to formulas over the variables that hold whenever it is left, in
    which ``x__0`` is x before it. writers: place (text) to (function, point, value).
    """

    def __init__(self, blocks: dict[str, Block], calls: dict[str, list[tuple[str, int, str]]], *, results: dict[str, list[tuple[str, str]]] | None = None, loops: dict[str, list[str]] | None = None, writers: dict[str, list[tuple[str, int, str]]] | None = None, depth: int = 3, solver: LinearSolver | None = None):
        self.blocks, self.calls, self.results, self.loops, self.writers = blocks, calls, results or {}, loops or {}, writers or {}
        self.depth, self.solver = depth, solver or LinearSolver()
        self.failed: Bit | None = None  # what a report couldn't refute

    def check(self, function: str, point: int, bit: Bit, depth: int | None = None) -> tuple[str, list[str]]:
        """('success' or 'report', path): whether the formula holds at a point.

        It holds if its negation can't be satisfied under the point's guard. Otherwise the question goes on where what it
        speaks of comes from, the nearest first: into a callee whose result it is, behind a loop that changed it, to the
        writers of a place that was read, to every call of the function. Nothing to go on with, the depth, or a solver
        that doesn't know make a report.
        """
        depth = self.depth if depth is None else depth
        block = self.blocks[function]
        if point not in block.guard:
            return "success", [function]
        verdict, path = self._refute(function, ir.conjoin(block.guard[point], block.translate_bit(point, ir.negate(bit))), depth, [function])
        if verdict == "report" and any(self._refute(function, ir.conjoin(block.guard[point], ir.negate(s)), depth, [function])[0] == "success" for s in self.conditions(function, point, bit)):
            return "success", [function]
        return verdict, path

    def conditions(self, function: str, point: int, bit: Bit) -> list[Bit]:
        """Conditions that suffice for the formula at a point and speak of what the function was given alone."""
        block = self.blocks[function]
        own = lambda a: a.kind not in ("clobber", "ret", "val", "left")
        found = block.translate_bit(point, bit)
        return sufficient(found, block.guard[point], own) if any(not own(a) for a in ir.atoms(found)) else []

    def directions(self, bad: Bit) -> list[tuple[str, Any]]:
        """Where to go on with a formula, best first: callee, loop, heap, caller."""
        found = sorted(ir.atoms(bad), key=ir.show)
        out = [("callee", a) for a in found if a.kind == "ret" and a.args[0] in self.results]
        out += [("loop", a) for a in found if a.kind == "clobber"]
        out += [("heap", a) for a in found if a.kind == "drf" and ir.show(a.args[0]) in self.writers]
        return out + ([("caller", None)] if parameters(bad) else [])

    def _refute(self, function: str, bad: Bit, depth: int, path: list[str]) -> tuple[str, list[str]]:
        if self.solver.satisfiable(bad) is False:
            return "success", path
        ways = self.directions(bad) if depth > 0 else []
        if not ways:
            self.failed = bad
            return "report", path
        way, a = ways[0]
        if way == "callee":
            return self._callee(function, bad, a, depth, path)
        if way == "loop":
            return self._loop(function, bad, a, depth, path)
        return self._heap(function, bad, a, depth, path) if way == "heap" else self._callers(function, bad, depth, path)

    def _callee(self, function: str, bad: Bit, a: Any, depth: int, path: list[str]) -> tuple[str, list[str]]:
        """Every value that the callee may return, in turn."""
        name, point = a.args
        arguments = next((split_arguments(e[4]) for e in self.blocks[function].edges if e[0] == point and e[2] == "call" and callee_of(e[3])[1] == name), []) if function in self.blocks else []
        block = self.blocks[function]
        for text, when in self.results[name]:
            for value, g in block.translate(point, actual_for_formal(ir.parse(text), arguments)):
                held = block.translate_bit(point, actual_for_formal(ir.parse(when), arguments)) if when else TRUE
                here = ir.conjoin(g, held, ir.substitute(bad, lambda x, v=value: v if x == a else None))
                verdict, found = self._refute(function, here, depth - 1, [*path, f"{name}()"])
                if verdict == "report":
                    return verdict, found
        return "success", path

    def _loop(self, function: str, bad: Bit, a: Any, depth: int, path: list[str]) -> tuple[str, list[str]]:
        """The loop not run at all, then left with what is known of it."""
        block = self.blocks[function]
        source = a.args[1]
        edge = next((e for e in block.edges if e[0] == source and e[2] == "loop"), None)
        if edge is None:  # a call's effect, of which no more is known
            rest = ir.substitute(bad, lambda x: ir.atom("unknown", *x.args) if x == a else None)
            return self._refute(function, rest, depth - 1, path)
        changed = split_arguments(edge[4])
        before = lambda x: ir.var(f"{x.args[0]}") if x.kind == "clobber" and x.args[1] == source else None
        skipped = block.translate_bit(source, ir.substitute(bad, before))
        verdict, found = self._refute(function, skipped, depth - 1, [*path, f"skip {edge[3]}"])
        if verdict == "report":
            return verdict, found
        after = lambda x: ir.atom("left", x.args[0], source) if x.kind == "var" and x.args[0] in changed else None
        known = [ir.parse(t) for t in self.loops.get(edge[3], [])]
        held = []
        for k in known:
            k = ir.substitute(k, after)
            start = ir.substitute(k, lambda x: ir.var(str(x.args[0]).removesuffix("__0")) if x.kind == "var" and str(x.args[0]).endswith("__0") else None)
            held.append(block.translate_bit(source, start))
        left = ir.substitute(bad, lambda x: ir.atom("left", x.args[0], source) if x.kind == "clobber" and x.args[1] == source else None)
        return self._refute(function, ir.conjoin(left, *held), depth - 1, [*path, edge[3]])

    def _heap(self, function: str, bad: Bit, a: Any, depth: int, path: list[str]) -> tuple[str, list[str]]:
        """Every value that a writer of the place gives it."""
        for writer, point, text in self.writers[ir.show(a.args[0])]:
            block = self.blocks[writer]
            if point not in block.guard:
                continue
            for value, g in block.translate(point, ir.parse(text)):
                own = lambda x: ir.var(f"{x.args[0]}@{writer}") if x.kind == "var" else None
                here = ir.conjoin(ir.substitute(ir.conjoin(g, block.guard[point]), own), ir.substitute(bad, lambda x, v=ir.substitute(value, own): v if x == a else None))
                verdict, found = self._refute(function, here, depth - 1, [*path, f"written by {writer}"])
                if verdict == "report":
                    return verdict, found
        return "success", path

    def _callers(self, function: str, bad: Bit, depth: int, path: list[str]) -> tuple[str, list[str]]:
        sites = self.calls.get(function, [])
        if not sites:
            return "report", path
        for caller, at, arguments in sites:
            safe = actual_for_formal(ir.negate(bad), split_arguments(arguments))
            verdict, found = self.check(caller, at, safe, depth - 1)
            if verdict == "report":
                return verdict, [*path, *found]
        return "success", path


def check(blocks: dict[str, Block], calls: dict[str, list[tuple[str, int, str]]], function: str, point: int, bit: Bit, *, depth: int = 3, solver: LinearSolver | None = None) -> tuple[str, list[str]]:
    """Search.check() through callers alone."""
    return Search(blocks, calls, depth=depth, solver=solver).check(function, point, bit)


def initial(name: str) -> Lin:
    """A variable's value when its loop was entered."""
    return ir.var(f"{name}__0")


def loop_invariants(body: Block, solver: LinearSolver | None = None) -> list[tuple[str, Bit]]:
    """(template, formula) that hold whenever a loop's body starts over, by guess and check.

    monotonic: a variable that never moves one way stays on its side of its first value. linear: two variables with fixed
    steps move in proportion; linear_weak: one with several steps moves no faster than its largest. tested: a comparison
    that guards the whole body, weakened by the step of what it tests; implied: the same where it held at first. assigned:
    bounds by a constant that the body gives; ran: the first value or that constant. terminator: a text scanned up to its
    end has its end ahead. A guess holds if it does on entry, where variables have their first values, and if an iteration keeps it, given
    those accepted before.
    """
    solver = solver or LinearSolver()
    if not body.order or body.order[-1] not in body.guard:
        return []
    end = body.order[-1]
    after = {n: body.state[end][n] for n in sorted(body.state[end])}
    steps: dict[str, list[int]] = {}
    for n, values in after.items():
        moves = [ir.sub(v, ir.var(n)) for v, _ in values]
        if all(not m.terms for m in moves):
            steps[n] = [m.const for m in moves]
    guesses: list[tuple[str, Bit]] = []
    for n, by in steps.items():
        if min(by) >= 0 and any(by):
            guesses.append(("monotonic", ir.compare("<=", initial(n), ir.var(n))))
        if max(by) <= 0 and any(by):
            guesses.append(("monotonic", ir.compare("<=", ir.var(n), initial(n))))
    fixed = [(n, by[0]) for n, by in steps.items() if len(set(by)) == 1 and by[0]]
    for i, (x, dx) in enumerate(fixed):
        for y, dy in fixed[i + 1 :]:
            guesses.append(("linear", ir.compare("==", ir.scale(ir.sub(ir.var(x), initial(x)), dy), ir.scale(ir.sub(ir.var(y), initial(y)), dx))))
    parts = lambda b: set(b.args) if b.kind == "and" else {b}
    paths = body.guard[end].args if body.guard[end].kind == "or" else (body.guard[end],)
    for g in sorted(set.intersection(*map(parts, paths)), key=ir.show):  # what every path has tested
        if g.kind == "le":
            slack = max((abs(c * s) for a, c in g.args[0].terms if a.kind == "var" for s in steps.get(a.args[0], [0])), default=0)
            if slack:
                guesses.append(("tested", ir.compare("<=", g.args[0], ir.num(slack))))
    for g in sorted(set.intersection(*map(parts, paths)), key=ir.show):
        for n, by in steps.items():  # a test of a variable that moves by one way only, from where it began
            if g.kind in ("le", "ne") and any(a.kind == "var" and a.args[0] == n for a, _ in g.args[0].terms) and any(by) and (min(by) >= 0 or max(by) <= 0):
                shifted = ir.substitute(g, lambda a, n=n: initial(n) if a.kind == "var" and a.args[0] == n else None)
                edge = ir.substitute(g, lambda a, n=n, k=by[0]: ir.sub(ir.var(n), ir.num(k)) if a.kind == "var" and a.args[0] == n else None)
                guesses.append(("implied", ir.disjoin(ir.negate(shifted), edge, ir.compare("==", ir.var(n), initial(n)))))
    for n, values in after.items():  # what was tested and then assigned: a bound of what the assigned value can be
        for v, _ in values:
            if not v.terms and n not in steps:
                guesses += [("assigned", ir.compare(op, ir.var(n), ir.num(v.const))) for op in ("<=", ">=")]
                guesses.append(("ran", ir.disjoin(ir.compare("==", ir.var(n), initial(n)), ir.compare("==", ir.var(n), ir.num(v.const)))))
    for i, (x, dx) in enumerate(fixed):  # weaker than in proportion
        for y, by in sorted(steps.items()):
            if y != x and any(by) and len(set(by)) > 1 and min(by) >= 0 and dx > 0:
                guesses.append(("linear_weak", ir.compare("<=", ir.scale(ir.sub(ir.var(y), initial(y)), dx), ir.scale(ir.sub(ir.var(x), initial(x)), max(by)))))
    for text, at, value in terminator_tests(body):
        for n in sorted(a.args[0] for a, _ in at.terms if a.kind == "var"):
            guesses.append(("terminator", terminator_invariant(ir.var(text), at, ir.substitute(at, lambda a, n=n: initial(n) if a.kind == "var" and a.args[0] == n else None), value)))
    found: list[tuple[str, Bit]] = []
    for template, guess in dict.fromkeys(guesses):
        on_entry = ir.substitute(guess, lambda a: ir.var(a.args[0].removesuffix("__0")) if a.kind == "var" and str(a.args[0]).endswith("__0") else None)
        entered = on_entry == ir.TRUE or (template == "tested" and solver.implied(body.guard[end], on_entry))
        known = ir.conjoin(body.guard[end], guess, *(b for _, b in found))
        if found and solver.implied(ir.conjoin(*(b for _, b in found)), guess):
            continue  # says no more
        if entered and solver.implied(known, body.translate_bit(end, guess)):
            found.append((template, guess))
    return found


# --- over tables

EDGES = "function string, source int, target int, kind string, a string, b string"
_BODY = ["source", "target", "kind", "a", "b"]
#: Edges and facts of bodies whose results a task keeps.
MOST_KEPT = 200_000


def kept(memo: dict, key: tuple, size: int, make: Callable[[], Any]) -> Any:
    """What was made for the key before in this task, or make(); a full memo starts anew. Equal bodies have equal results, whatever
    function they belong to."""
    if key not in memo:
        if memo.get("size", 0) + size > MOST_KEPT:
            memo.clear()
        memo[key], memo["size"] = make(), memo.get("size", 0) + size
    return memo[key]


def _per_body(edges: DataFrame, solve: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """(function, …): rows that solve makes of the edges of every function; equal bodies are solved once in a task."""

    def start(memo: dict) -> Callable:
        def one(function: str, rows: Iterator[tuple]) -> Iterator[tuple]:
            body = tuple(rows)
            return ((function, *r) for r in kept(memo, body, len(body), lambda: solve(list(body))))

        return one

    return map_groups(edges.select("function", *_BODY), "function", _BODY, start, schema)


def block_guards(edges: DataFrame) -> DataFrame:
    """(function, point, guard) as text; edges as in EDGES, the entry is point 0."""

    def solve(body: list[tuple]) -> list[tuple]:
        block = Block(body)
        return [(p, str(block.guard[p])) for p in sorted(block.guard)]

    return _per_body(edges, solve, "function string, point int, guard string")


def block_assertions(edges: DataFrame) -> DataFrame:
    """(function, cls, kind, point, bit) of every function's accesses."""

    def solve(body: list[tuple]) -> list[tuple]:
        block = Block(body)
        return [(c, k, p, str(b)) for c, k, p, b in classify(block, assertions(block))]

    return _per_body(edges, solve, "function string, cls string, kind string, point int, bit string")


FACTS = "function string, kind string, name string, a string, b string"
_STATE = "name string, kind string, point int, state string, function string, bad binary, path string, formula string, assigns string, queries string"


def mentions_bound(b: Bit, of: str) -> bool:
    """Whether a formula speaks of a bound of the named buffer or type."""
    return any(a.kind in ("ubound", "lbound") and of in ir.show(a) for a in ir.atoms(b))


class _OneFunction(Search):
    """A search that stops where it would have to go to callers, and keeps the formula to ask there."""

    def __init__(self, edges: list[tuple], facts: list[tuple], depth: int, solver: str = "linear", explain: str = ""):
        results: dict[str, list] = defaultdict(list)
        loops: dict[str, list] = defaultdict(list)
        for kind, name, a, b in facts:
            if kind == "result":
                results[name].append((a, b))
            else:
                loops[name].append(a)
        inner = SOLVERS[solver]()
        super().__init__({"": Block(edges)}, {}, results=results, loops=loops, depth=depth, solver=Recorded(inner, explain == "constraints") if explain else inner)
        self.block = self.blocks[""]
        self.asked: list[Bit] = []
        self.explain = explain

    def _callers(self, function: str, bad: Bit, depth: int, path: list[str]) -> tuple[str, list[str]]:
        self.asked.append(bad)
        return "success", path

    def outcome(self, at: int, bit: Bit) -> list[tuple]:
        """What becomes of an assertion here: success, a report, or formulas that no call may satisfy; (state, bad, path within
        the function, formula, assigns, queries)."""
        self.asked, self.failed = [], None
        verdict, found = self.check("", at, bit)
        queries = None
        if self.explain:
            queries, self.solver.log = "\n".join(self.solver.log), []

        def row(state: str, bad: Bit | None) -> tuple:
            model = self.solver.model(bad) if self.explain and bad is not None else None
            assigns = ", ".join(f"{ir.show(a)} = {v}" for a, v in sorted(model.items(), key=lambda x: ir.show(x[0]))) if model else None
            return (state, pickle.dumps(bad) if state == "ask" else None, found[1:], str(bad) if self.explain and bad is not None else None, assigns, queries)

        if verdict == "report":
            return [row("report", self.failed)]
        return [row("ask", bad) for bad in dict.fromkeys(self.asked)] or [row("success", None)]


def _state_row(name: str, kind: str, point: int, function: str, before: str, found: tuple) -> tuple:
    state, bad, path, formula, assigns, queries = found
    return (name, kind, point, state, function, bad, " < ".join(x for x in (before, function, *path) if x), formula, assigns, queries)


def check_functions(edges: DataFrame, facts: DataFrame | None = None, depth: int = 3, *, kinds: list[str] | None = None, bound: str | None = None, functions: list[str] | None = None, solver: str = "linear", explain: str = "") -> DataFrame:
    """(function, kind, point, verdict, path, formula, assigns, queries) of every assertion of class check; edges as in EDGES.

    ``kinds``, ``bound`` (a buffer or type whose bound is spoken of) and ``functions`` choose assertions. With ``explain`` a report has the
    formula that couldn't be refuted, values that satisfy it and the solver's queries (``constraints``: and their side conditions).

    facts are as in FACTS: ``result`` (name of a callee, a value that it returns, a formula under which it does) and ``loop``
    (name, a formula that holds when it is left), for the functions that hold the call or loop. The search goes from callee to
    caller in rounds, one step of the call graph each: a round's open formulas meet the calls of their function, and every
    caller is one small task with the formulas that reach it. So no task holds more than a function and what is asked
    of it, however large the call graph's components are. An assertion is a report if any call is. Where edges have a column
    ``callee``, it names the function that a call runs, and the name in ``a`` is what the caller knows it by.
    """
    spark = edges.sparkSession
    edges = once(edges, "check-edges")
    facts = once(facts if facts is not None else spark.createDataFrame([], FACTS), "check-facts")
    callee = F.col("callee") if "callee" in edges.columns else F.regexp_replace("a", r"^.*=\s*", "")
    calls = edges.filter("kind = 'call'").select(callee.alias("callee"), F.col("function").alias("caller"), F.col("source").alias("at"), F.col("b").alias("arguments"))

    def searched(memo: dict, body: tuple, known: tuple) -> _OneFunction:
        return kept(memo, ("body", body, known), len(body) + len(known), lambda: _OneFunction(list(body), [(k, n, a, b) for _, _, k, a, b, n in known], depth, solver, explain))

    def first(memo: dict) -> Callable:
        def generate(body: tuple, known: tuple) -> list[tuple]:
            one = searched(memo, body, known)
            live = [(kind, point, bit) for cls, kind, point, bit in classify(one.block, assertions(one.block)) if cls == "check" and (kinds is None or kind in kinds) and (bound is None or mentions_bound(bit, bound))]
            return [(kind, point, found) for kind, point, bit in live for found in one.outcome(point, bit)]

        def solve(function: str, rows: Iterator[tuple]) -> Iterator[tuple]:
            every = list(rows)
            body, known = tuple(r[1:6] for r in every if r[0] == 0), tuple(r[1:] for r in every if r[0] == 1)
            if body and (functions is None or function in functions):
                for kind, point, found in kept(memo, ("all", body, known), len(body), lambda: generate(body, known)):
                    yield _state_row(function, kind, point, function, "", found)

        return solve

    def further(memo: dict) -> Callable:
        def solve(function: str, rows: Iterator[tuple]) -> Iterator[tuple]:
            body, known, one = [], [], None
            for fact, source, target, kind, a, b, name, at, arguments, bad, point, path in rows:  # its edges, its facts, then what is asked of it
                if fact == 0:
                    body.append((source, target, kind, a, b))
                elif fact == 1:
                    known.append((source, target, kind, a, b, name))
                elif body:
                    key = (tuple(body), tuple(known)) if one is None else key
                    one = one or searched(memo, *key)
                    safe = lambda: actual_for_formal(ir.negate(pickle.loads(bad)), split_arguments(arguments))  # noqa: B023, E731
                    for found in kept(memo, (key, at, arguments, bad), len(body), lambda: one.outcome(at, safe())):  # noqa: B023
                        yield _state_row(name, kind, point, function, path, found)

        return solve

    none = lambda t: F.lit(None).cast(t)
    body = edges.select("function", F.lit(0).alias("fact"), *_BODY, none("string").alias("name"))
    body = body.unionByName(facts.select("function", F.lit(1).alias("fact"), F.lit(0).alias("source"), F.lit(0).alias("target"), "kind", "a", "b", "name"))
    order = ["fact", *_BODY, "name"]
    state = materialize(map_groups(body, "function", order, first, _STATE), "check-0", count=True)
    done = state.filter("state <> 'ask'")
    for n in range(depth):
        asks = state.filter("state = 'ask'").select("name", "kind", "point", F.col("function").alias("callee"), "bad", "path", "formula", "assigns", "queries")
        if asks.isEmpty():
            break
        met = materialize(asks.join(calls, "callee", "left"), f"check-asks-{n}")
        alone = met.filter("caller IS NULL").select("name", "kind", "point", F.lit("report").alias("state"), F.col("callee").alias("function"), "bad", "path", "formula", "assigns", "queries")
        live = met.filter("caller IS NOT NULL").select(F.col("caller").alias("function"), F.lit(2).alias("fact"), F.lit(0).alias("source"), F.lit(0).alias("target"), "kind", none("string").alias("a"), none("string").alias("b"), "name", "at", "arguments", "bad", "point", "path")
        wanted = body.join(live.select("function").distinct(), "function", "left_semi")
        wanted = wanted.select("*", none("int").alias("at"), none("string").alias("arguments"), none("binary").alias("bad"), none("int").alias("point"), none("string").alias("path"))
        state = materialize(map_groups(wanted.unionByName(live), "function", [*order, "point", "path"], further, _STATE), f"check-{n + 1}")
        done = done.unionByName(alone).unionByName(state.filter("state <> 'ask'"))
    left = state.filter("state = 'ask'").withColumn("state", F.lit("report"))  # beyond the depth
    worst = F.min(F.struct(F.when(F.col("state") == "report", 0).otherwise(1).alias("rank"), "path", "formula", "assigns", "queries")).alias("w")
    out = done.unionByName(left).groupBy("name", "kind", "point").agg(worst)
    return out.select(F.col("name").alias("function"), "kind", "point", F.when(F.col("w.rank") == 0, "report").otherwise("success").alias("verdict"), "w.path", "w.formula", "w.assigns", "w.queries")


def check_reports(edges: DataFrame, component: str = "component", depth: int = 3) -> DataFrame:
    """check_functions() of programs side by side: (component, function, kind, point, verdict, path), with calls within a component."""
    named = F.concat_ws("\x1f", component, "function")
    callee = F.when(F.col("kind") == "call", F.concat(F.col(component), F.lit("\x1f"), F.regexp_replace("a", r"^.*=\s*", "")))
    found = check_functions(edges.select(named.alias("function"), "source", "target", "kind", "a", "b", callee.alias("callee")), depth=depth)
    own = F.split("function", "\x1f")
    return found.select(own.getItem(0).alias("component"), own.getItem(1).alias("function"), "kind", "point", "verdict", F.regexp_replace("path", "[^< ]*\x1f", "").alias("path"))


def inferred_invariants(edges: DataFrame) -> DataFrame:
    """(function, template, bit) of loop bodies; edges as in EDGES, one body per function, from point 0."""
    return _per_body(edges, lambda body: [(t, str(b)) for t, b in loop_invariants(Block(body))], "function string, template string, bit string")


def function_results(edges: DataFrame) -> DataFrame:
    """(function, template, bit): what holds of every function's ``result``; edges as in EDGES."""
    return _per_body(edges, lambda body: [(t, str(b)) for t, b in function_invariants(Block(body))], "function string, template string, bit string")


def sufficient_conditions(edges: DataFrame) -> DataFrame:
    """(function, kind, point, sufficient): for assertions of class check, conditions over what a function was given that suffice."""

    def solve(body: list[tuple]) -> list[tuple]:
        block = Block(body)
        search = Search({"": block}, {})
        return [(kind, point, " or ".join(map(str, search.conditions("", point, bit)))) for cls, kind, point, bit in classify(block, assertions(block)) if cls == "check"]

    return _per_body(edges, solve, "function string, kind string, point int, sufficient string")


def annotation_bits(annotations: DataFrame) -> DataFrame:
    """(name, bit, error) of annotations (name, text): their formula in normal form, or why the text is none.

    The grammar is that of ir.parse(): arithmetic, comparisons, & | !, names, fields, elements, bounds and terminators. Nothing is run.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for name, text in zip(frame.name, frame.text, strict=True):
                try:
                    b = ir.parse(text or "")
                    b = b if isinstance(b, Bit) else ir.nonzero(b)
                    rows.append((name, str(b), None))
                except (SyntaxError, ValueError, KeyError, AttributeError, TypeError, RecursionError) as e:
                    rows.append((name, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["name", "bit", "error"])

    kind = annotations.schema["name"].dataType.simpleString()
    return dealt(annotations.select("name", "text"), "name").mapInPandas(read, f"name {kind}, bit string, error string")
