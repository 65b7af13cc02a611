"""Operators on the control-flow graphs of functions, one group per function.

A function's graph has 10 to 1,000 points, so a group fits a task; functions are what is spread. Edges are
(function, source, target, kind, cond, lhs, rhs); kind is skip, assume, assign, call or loop.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame


def _reach(succ: dict, start, avoid=None) -> set:
    seen, todo = set(), deque([start] if start != avoid else [])
    while todo:
        p = todo.popleft()
        if p not in seen:
            seen.add(p)
            todo.extend(q for q in succ.get(p, ()) if q != avoid)
    return seen


def loops_of(edges: list[tuple[int, int]], entry: int) -> tuple[list[tuple[int, frozenset]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Natural loops (head, body), inner ones first; the edges after nodes of irreducible loops were duplicated; and pairs
    (copy, original).

    A loop that can be entered elsewhere than at its head gets copies of the nodes that the other entries lead to, which
    leaves it reducible; then the search starts again.
    """
    edges, copies = list(dict.fromkeys(edges)), []
    for _ in range(64):
        succ, pred = defaultdict(list), defaultdict(list)
        for a, b in edges:
            succ[a].append(b)
            pred[b].append(a)
        every = _reach(succ, entry)
        # Depth-first order gives the edges that go back; such a target is a head if it dominates the source.
        state, order, retreating = {}, [], []
        stack = [(entry, iter(succ[entry]))]
        state[entry] = 1
        while stack:
            p, rest = stack[-1]
            q = next(rest, None)
            if q is None:
                state[p] = 2
                order.append(p)
                stack.pop()
            elif q not in state:
                state[q] = 1
                stack.append((q, iter(succ[q])))
            elif state[q] == 1:
                retreating.append((p, q))
        bodies: dict[int, set] = {}
        bad = None
        for p, head in retreating:
            body, todo = {head}, [p]
            while todo:
                x = todo.pop()
                if x not in body and x in every:
                    body.add(x)
                    todo.extend(pred[x])
            if entry in body and head != entry or p in _reach(succ, entry, avoid=head):
                bad = bad or (p, head)
            else:
                bodies.setdefault(head, set()).update(body)
        if bad is None:
            return sorted(((h, frozenset(b)) for h, b in bodies.items()), key=lambda x: (len(x[1]), x[0])), edges, copies
        # Duplicate what is reached without the head but lies on the cycle.
        p, head = bad
        cycle = _reach(succ, head) & _reach(pred, p)
        outside = cycle & _reach(succ, entry, avoid=head)
        new, fresh = {}, max(max(a, b) for a, b in edges) + 1
        for x in sorted(outside - {head}):
            new[x] = fresh
            copies.append((fresh, x))
            fresh += 1
        moved = []
        for a, b in edges:
            if b in new and a not in cycle:
                moved.append((a, new[b]))  # the other entries lead to the copies
            else:
                moved.append((a, b))
            if a in new:
                moved.append((new[a], new.get(b, b)))
        edges = list(dict.fromkeys(moved))
    raise ValueError("loops stay irreducible")


def loop_graphs(edges: list[tuple[int, int]], entry: int) -> tuple[list[tuple[str, int, int, str]], list[tuple[str, int, int]]]:
    """The acyclic graphs of a function and of each of its loops: (graph, source, target, kind), and (graph, copy, original).

    Loops are taken out from the inside to the outside. A loop's graph has the edges of its body, with those back to the head
    led to a point of its own, the end. Where the loop was, an edge of kind ``loop`` leads from the head to a copy of it, from
    which copies of the body's points lead out: the last time round, left before its end. These copies have the same code
    as points of the loop. Graphs are named by the way from the function inward: ``func``, ``func/loop#1``, ``func/loop#1/loop#0``.
    """
    loops, now, _ = loops_of(edges, entry)
    now = {(a, b, "edge") for a, b in now}
    fresh = max((max(a, b) for a, b, _ in now), default=entry) + 1
    taken: list[tuple[int, set, list]] = []
    copies: list[tuple[int, int, int]] = []
    for n, (head, _) in enumerate(loops):
        succ = _succ(now)
        free = _reach(succ, entry, avoid=head)
        body, todo = {head}, [a for a, b, _ in now if b == head and a not in free]  # edges back come from what the head dominates
        pred = defaultdict(list)
        for a, b, _ in now:
            pred[b].append(a)
        while todo:
            x = todo.pop()
            if x not in body and x not in free:
                body.add(x)
                todo.extend(pred[x])
        inner = {(a, b, k) for a, b, k in now if a in body and b in body}
        back = {(a, b, k) for a, b, k in inner if b == head}
        end, fresh = fresh, fresh + 1
        taken.append((head, body, sorted({(a, end if b == head else b, k) for a, b, k in inner})))
        out = {(a, b, k) for a, b, k in now if a in body and b not in body}
        onward = inner - back
        leaves = {a for a, _, _ in out}
        alive = {x for x in _reach(_succ(onward), head) if leaves & _reach(_succ(onward), x)} | {head}
        new = {}
        for x in [head, *sorted(alive - {head})]:
            new[x], fresh = fresh, fresh + 1
            copies.append((n, new[x], x))
        now = {e for e in now if e[0] not in body}
        now |= {(head, new[head], "loop")} | {(new[a], new[b], k) for a, b, k in onward if a in alive and b in alive} | {(new[a], b, k) for a, b, k in out if a in alive}
    name = {}
    for n in reversed(range(len(loops))):
        outer = next((m for m in range(n + 1, len(loops)) if loops[n][0] in taken[m][1]), None)
        name[n] = f"{'func' if outer is None else name[outer]}/loop#{n}"
    rows = [("func", a, b, k) for a, b, k in sorted(now)]
    for n, (_, _, inside) in enumerate(taken):
        rows += [(name[n], a, b, k) for a, b, k in inside]
    return rows, [(name[n], copy, original) for n, copy, original in copies]


def _succ(edges) -> dict:
    out = defaultdict(list)
    for a, b, *_ in edges:
        out[a].append(b)
    return out


def topological(edges: list[tuple[int, int]], points: list[int], line: dict[int, int]) -> list[int]:
    """An order of points after all that lead to them; of those that are ready the one with the smallest line comes first."""
    import heapq

    waits = {p: 0 for p in points}
    for _, b in edges:
        waits[b] += 1
    ready = [(line.get(p, 0), p) for p in points if not waits[p]]
    heapq.heapify(ready)
    out, succ = [], defaultdict(list)
    for a, b in edges:
        succ[a].append(b)
    while ready:
        _, p = heapq.heappop(ready)
        out.append(p)
        for q in succ[p]:
            waits[q] -= 1
            if not waits[q]:
                heapq.heappush(ready, (line.get(q, 0), q))
    return out


def split_loops(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(function, loop, head, size, depth, parent, copied): loops of every function, named by their place among its loops.

    edges (function string, source int, target int), entries (function, entry).
    """

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["function", "loop", "head", "size", "depth", "parent", "copied"]
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series(dtype="object" if c in ("function", "loop", "parent") else "int64") for c in columns})
        loops, _, copies = loops_of(list(zip(left.source.tolist(), left.target.tolist(), strict=True)), int(right.entry.iloc[0]))
        rows = []
        for n, (head, body) in enumerate(loops):
            outer = [m for m, (h, b) in enumerate(loops) if m != n and h != head and head in b and body < b | {head}]
            parent = min(outer, key=lambda m: len(loops[m][1]), default=None)
            rows.append((key[0], f"loop#{n}", head, len(body), 1 + len(outer), None if parent is None else f"loop#{parent}", len(copies)))
        return pd.DataFrame(rows, columns=columns)

    return edges.select("function", "source", "target").groupBy("function").cogroup(entries.select("function", "entry").groupBy("function")).applyInPandas(solve, "function string, loop string, head long, size long, depth long, parent string, copied long")


def split_graphs(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(function, graph, source, target, kind) as loop_graphs() gives them; of kind ``same`` are the points copied from a loop,
    with the copy as source and the original as target."""

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            graphs, copies = loop_graphs(list(zip(left.source.tolist(), left.target.tolist(), strict=True)), int(right.entry.iloc[0]))
            rows = [(key[0], *r) for r in graphs] + [(key[0], g, a, b, "same") for g, a, b in copies]
        return pd.DataFrame(rows, columns=["function", "graph", "source", "target", "kind"])

    return edges.select("function", "source", "target").groupBy("function").cogroup(entries.select("function", "entry").groupBy("function")).applyInPandas(solve, "function string, graph string, source long, target long, kind string")


def topological_order(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(function, point, place) of acyclic functions; points (function, point, line)."""

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        order = topological(list(zip(left.source.tolist(), left.target.tolist(), strict=True)), right.point.tolist(), dict(zip(right.point, right.line, strict=True)))
        return pd.DataFrame({"function": [key[0]] * len(order), "point": order, "place": range(len(order))})

    return edges.select("function", "source", "target").groupBy("function").cogroup(points.select("function", "point", "line").groupBy("function")).applyInPandas(solve, "function string, point long, place long")
