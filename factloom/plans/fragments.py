"""Closures inside fragments of a graph: edges and rows are dealt by ranges of their nodes, and each task closes its own range.

Graphs of programs are local: a function's points have keys beside each other, and few edges lead out of a range. One pass
finds what paths inside ranges reach, whatever their length, and what leaves a range; only that goes on in rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.session import materialize, python_tasks, rows

#: Edges and rows of a range, and rows below which no more ranges are made.
RANGE_ROWS, LEAST_ROWS = 250_000, 20_000
_BATCH = 20_000
#: Types whose order in Python is that of Spark's ranges.
_ORDERED = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.StringType)

#: Rows of a range to rows that it closes: from edges (node to list of (to, label)) and from (at, other columns) of the rows given.
Close = Callable[[dict, list[tuple]], Iterator[tuple]]


def can_deal(*types: T.DataType) -> bool:
    return all(t == types[0] and isinstance(t, _ORDERED) for t in types) and getattr(types[0], "collation", "UTF8_BINARY") in (None, "UTF8_BINARY")


def in_ranges(edges: DataFrame, given: DataFrame, at: str, close: Close, schema: T.StructType, name: str) -> DataFrame:
    """Written rows of ``schema`` and ``_out``, whether their first column is outside the range that made them.

    edges (node, to, and labels) and given are written tables. close gets a range's edges and the rows given at its nodes, each with
    ``at`` first, and makes rows with a node first; a node of another range has no edges there.
    """
    labels = [c for c in edges.columns if c not in ("node", "to")]
    others = [c for c in given.columns if c != at]
    nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(f"_{c}")
    left = edges.select(F.col("node").alias("_key"), F.lit(True).alias("_edge"), F.col("to").alias("_to"), *(F.col(c).alias(f"_l{c}") for c in labels), *(nothing(given, c) for c in others))
    right = given.select(F.col(at).alias("_key"), F.lit(False).alias("_edge"), F.lit(None).cast(edges.schema["to"].dataType).alias("_to"), *(F.lit(None).cast(edges.schema[c].dataType).alias(f"_l{c}") for c in labels), *(F.col(c).alias(f"_{c}") for c in others))
    n = rows(edges) + rows(given)
    parts = max(-(-n // RANGE_ROWS), min(python_tasks(edges.sparkSession), -(-n // LEAST_ROWS)), 1)
    full = T.StructType([*schema.fields, T.StructField("_out", T.BooleanType())])
    arrow, width = to_arrow_schema(full), len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        succ: dict = {}
        starts: list[tuple] = []
        low = high = None
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            keys = [k for k in columns[0] if k is not None]
            if keys:
                low, high = min(keys if low is None else (low, min(keys))), max(keys if high is None else (high, max(keys)))
            ways = zip(columns[2], *columns[3 : 3 + width], strict=True)
            for key, edge, way, other in zip(columns[0], columns[1], ways, zip(*columns[3 + width :], strict=True) if others else (() for _ in columns[0]), strict=True):
                if not edge:
                    starts.append((key, *other))
                elif key is not None:
                    succ.setdefault(key, []).append(way)
        if not starts:
            return
        out: list[tuple] = []
        for row in close(succ, starts):
            at_node = row[0]
            # A node without a key joins nothing; where it was given it belongs to its row's range.
            out.append((*row, at_node is not None and not low <= at_node <= high if low is not None else False))
            if len(out) == _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return materialize(left.unionByName(right).repartitionByRange(parts, "_key").mapInArrow(run, full), name, narrow=True)


def reached(hops: int | None, limit: int | None) -> Close:
    """Closes rows (at, payload…) by moves along edges; ``hops`` is the place in a row of a count of moves, of which the least stays."""

    def close(succ: dict, starts: list[tuple]) -> Iterator[tuple]:
        groups: dict[tuple, dict] = {}
        for at, *rest in starts:
            h = rest.pop(hops - 1) if hops is not None else 0
            found = groups.setdefault(tuple(rest), {})
            if at not in found or h < found[at]:
                found[at] = h
        for payload, seen in groups.items():
            if hops is None:
                todo = list(seen)
                while todo:
                    for (w,) in succ.get(todo.pop(), ()):
                        if w not in seen:
                            seen[w] = 0
                            todo.append(w)
                for v in seen:
                    yield (v, *payload)
                continue
            layers: dict[int, list] = {}
            for v, h in seen.items():
                layers.setdefault(h, []).append(v)
            while layers:
                h = min(layers)
                layer = layers.pop(h)
                if limit is not None and h >= limit:
                    continue
                for v in layer:
                    if seen[v] == h:
                        for (w,) in succ.get(v, ()):
                            if w not in seen or h + 1 < seen[w]:
                                seen[w] = h + 1
                                layers.setdefault(h + 1, []).append(w)
            for v, h in seen.items():
                yield (v, *payload[: hops - 1], h, *payload[hops - 1 :])

    return close


def longest(succ: dict, starts: list[tuple]) -> Iterator[tuple]:
    """Closes rows (node, least) where a move takes one away: the most edges of a path as a number below zero. A cycle gives a null."""
    best: dict = {}
    for v, h in starts:
        best[v] = min(h, best.get(v, h))
    order, state = [], {}
    for root in best:
        if root in state:
            continue
        state[root], stack = 1, [(root, iter(succ.get(root, ())))]
        while stack:
            v, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                state[v] = 2
                order.append(v)
                stack.pop()
            elif w[0] not in state:
                state[w[0]] = 1
                stack.append((w[0], iter(succ.get(w[0], ()))))
            elif state[w[0]] == 1:
                yield (v, None)
                return
    for v in reversed(order):
        for (w,) in succ.get(v, ()):
            best[w] = min(best[v] - 1, best.get(w, best[v] - 1))
    yield from best.items()


def contexts(most: int) -> Close:
    """Closes rows (at, source, context) over edges with (to, site, move), as context_closure() says."""

    def close(succ: dict, starts: list[tuple]) -> Iterator[tuple]:
        seen = set(starts)
        todo = list(seen)
        while todo:
            at, source, context = todo.pop()
            for to, site, move in succ.get(at, ()):
                sites = [s for s in context.split("/") if s] if context else []
                if move == "call":
                    new = None if site is None else "/".join([*sites, site][-most:] if most > 0 else [])
                elif move == "return":
                    new = context if not sites else "/".join(sites[:-1]) if sites[-1] == site else None
                else:
                    new = context
                row = (to, source, new)
                if new is not None and row not in seen:
                    seen.add(row)
                    todo.append(row)
        yield from seen

    return close
