"""Graph operators on edge tables (src, dst); all iterate by whole frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from factloom.plans.fixpoint import iterate, leave_ranges, spread
from factloom.plans.fragments import can_deal, contexts, in_ranges, longest
from factloom.session import drop, materialize, once, rows


def _over(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Columns of a written table of edges as (node, to), which stays one."""
    out = edges.select(F.col(a).alias("node"), F.col(b).alias("to"))
    out._factloom_path = edges._factloom_path
    out._factloom_rows = getattr(edges, "_factloom_rows", None)
    return out


def reach(edges: DataFrame, seeds: DataFrame, *, backward: bool = False, avoid: DataFrame | None = None) -> DataFrame:
    """Nodes reachable from seeds, seeds included, over paths that don't enter ``avoid``."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    over = _over(once(edges, "edges"), a, b)
    start = seeds.select("node")
    if avoid is not None:
        over = materialize(over.join(avoid.select(F.col("node").alias("to")), "to", "left_anti").select("node", "to"), "edges", narrow=True)
        start = start.join(avoid.select("node"), "node", "left_anti")
    return spread(start, over)


def dominated(edges: DataFrame, entry: DataFrame, head: DataFrame) -> DataFrame:
    """Nodes that every path from entry reaches through head, head included."""
    edges, entry, head = once(edges, "edges"), once(entry, "entry"), once(head, "head")
    return reach(edges, entry).join(reach(edges, entry, avoid=head), "node", "left_anti")


def _into_head(edges: DataFrame, inside: DataFrame, head: DataFrame) -> DataFrame:
    return edges.join(head.select(F.col("node").alias("dst")), "dst", "left_semi").join(inside.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst")


def back_edges(edges: DataFrame, entry: DataFrame, head: DataFrame) -> DataFrame:
    """Edges into head from nodes that it dominates."""
    edges, entry, head = once(edges, "edges"), once(entry, "entry"), once(head, "head")
    return _into_head(edges, dominated(edges, entry, head), head)


def loop_body(edges: DataFrame, entry: DataFrame, head: DataFrame) -> DataFrame:
    """Nodes of the natural loop of head: those that reach a back edge's source without passing through head, and head."""
    edges, entry, head = once(edges, "edges"), once(entry, "entry"), once(head, "head")
    reached = reach(edges, entry)
    back = materialize(_into_head(edges, reached.join(reach(edges, entry, avoid=head), "node", "left_anti"), head), "back-edges")
    inside = reach(edges, back.select(F.col("src").alias("node")), backward=True, avoid=head)
    within = inside.join(reached, "node", "left_semi")
    return within.unionByName(head.join(back.select(F.col("dst").alias("node")), "node", "left_semi").select("node")).distinct()


def trim(edges: DataFrame, entry: DataFrame, exits: DataFrame) -> DataFrame:
    """Nodes on a path from entry to an exit. What can't leave, such as an endless loop, goes."""
    edges = once(edges, "edges")
    return reach(edges, entry).join(reach(edges, exits, backward=True), "node", "left_semi")


def flatten_skips(edges: DataFrame, skips: DataFrame) -> DataFrame:
    """(src, dst) of edges with nodes whose only way on is a skip edge (node, next) left out: edges lead to where the skips end.

    A node with more than one skip, or with another edge beside it, stays.
    """
    edges = once(edges.select("src", "dst").distinct(), "edges")
    single = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).filter("n = 1")
    plain = skips.select(F.col("node").alias("src"), F.col("next").alias("dst")).distinct().join(single.select("src", "dst"), ["src", "dst"])
    ends = once(follow(plain.select(F.col("src").alias("node"), F.col("dst").alias("next"))), "ends")
    kept = edges.join(ends.select(F.col("node").alias("src")), "src", "left_anti")
    return kept.join(ends.select(F.col("node").alias("dst"), "target"), "dst", "left").select("src", F.coalesce("target", "dst").alias("dst")).distinct()


def reentered(edges: DataFrame, body: DataFrame, head: DataFrame) -> DataFrame:
    """(src, dst): edges that enter a loop's body elsewhere than at its head."""
    inside = body.select("node").distinct()
    into = edges.join(inside.select(F.col("node").alias("dst")), "dst", "left_semi").join(head.select(F.col("node").alias("dst")), "dst", "left_anti")
    return into.join(inside.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst").distinct()


def closure(edges: DataFrame, seeds: DataFrame | None = None, *, depth: int | None = None) -> DataFrame:
    """(src, dst, hops): nodes that a path of at least one edge (at most ``depth``, if given) leads to, with the fewest edges."""
    edges = once(edges, "edges")
    first = edges if seeds is None else edges.join(seeds.select(F.col("node").alias("src")), "src", "left_semi")
    start = first.select("src", "dst", F.lit(1).cast("long").alias("hops"))
    return spread(start, _over(edges, "src", "dst"), "dst", hops="hops", bound=None if depth is None else depth - 1, start=1)


def bounded_closure(edges: DataFrame, seeds: DataFrame, *, depth: int) -> tuple[DataFrame, bool]:
    """closure() to a depth, and whether it found everything."""
    edges = once(edges, "edges")
    found = materialize(closure(edges, seeds, depth=depth), "closure")
    return found, found.filter(F.col("hops") == depth).join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").join(found.select("src", F.col("dst").alias("to")), ["src", "to"], "left_anti").isEmpty()


def context_closure(edges: DataFrame, seeds: DataFrame, *, max_context: int = 4) -> DataFrame:
    """(source, target, context) over edges (source, target, site, move): a call pushes its site, a return must match the last one.

    move is 'call', 'return' or 'stay'. A return from an empty context is free. A context holds its last ``max_context``
    sites: an older one is forgotten, so that a return to it is free. That bounds contexts under recursion, and no flow is lost by it.
    """
    edges = once(edges, "edges", count=True)
    over = edges.select(F.col("source").alias("target"), F.col("target").alias("to"), "site", "move")
    start = seeds.select(F.col("node").alias("source"), F.col("node").alias("target"), F.lit("").alias("context"))

    def step(new: DataFrame, few: bool = False) -> DataFrame:
        met = over.join(F.broadcast(new), "target") if few else new.join(over, "target")
        sites = F.filter(F.split("context", "/"), lambda s: s != "")
        depth = F.size(sites)
        pushed = F.array_join(F.slice(F.concat(F.when(depth >= max_context, F.slice(sites, depth - max_context + 2, F.lit(max_context))).otherwise(sites), F.array("site")), 1, max_context), "/")
        popped = F.array_join(F.slice(sites, 1, F.greatest(depth - 1, F.lit(0))), "/")
        back = F.when(depth == 0, F.col("context")).when(F.element_at(sites, -1) == F.col("site"), popped)
        context = F.when(F.col("move") == "call", pushed).when(F.col("move") == "return", back).otherwise(F.col("context"))
        return met.select("source", F.col("to").alias("target"), context.alias("context")).filter("context IS NOT NULL")

    types = [edges.schema[c].dataType for c in ("source", "target")]
    if max_context > 0 and can_deal(*types, start.schema["target"].dataType) and isinstance(edges.schema["site"].dataType, StringType):
        start = once(start, "start", count=True)
        closed = in_ranges(edges.select(F.col("source").alias("node"), F.col("target").alias("to"), "site", "move"), start, "target", contexts(max_context), StructType([start.schema[c] for c in ("target", "source", "context")]), "contexts")
        found = leave_ranges(closed, start.columns, None, step)
        if found is not None:
            return found
    return iterate(start, step)


def stages(nodes: DataFrame, edges: DataFrame, indirect: DataFrame | None = None, *, n_stages: int = 5) -> DataFrame:
    """(node, stage): layered staging of callers after their callees; -1 for the final stage.

    A node enters stage k when all its callees that are nodes have entered earlier ones and it has no indirect call. A node
    that calls itself never does. A node misses stage k if it has an indirect call or a callee that missed stage k - 1; the
    first stage that it doesn't miss is its own. So the stages are joins of one written table with what missed the stage before, written too:
    a later stage doesn't run the earlier ones again.
    """
    pending = materialize(nodes.select("node").distinct(), "pending", narrow=True)
    live = edges.select("src", "dst").distinct().join(pending.select(F.col("node").alias("dst")), "dst", "left_semi")
    live = materialize(live.join(pending.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst"), "live")
    never = materialize(pending.limit(0) if indirect is None else indirect.select("node").join(pending, "node", "left_semi").distinct(), "never", narrow=True)
    missed, every = None, None
    for k in range(n_stages):
        above = live if missed is None else live.join(missed.select(F.col("node").alias("dst")), "dst", "left_semi")
        missed = materialize(above.select(F.col("src").alias("node")).unionByName(never).distinct(), "missed", narrow=True)
        part = missed.withColumn("k", F.lit(k + 1))
        every = part if every is None else every.unionByName(part)
    if every is None:
        return pending.withColumn("stage", F.lit(-1))
    last = every.groupBy("node").agg(F.max("k").alias("k"))
    return pending.join(last, "node", "left").select("node", F.when(F.col("k") == n_stages, -1).otherwise(F.coalesce("k", F.lit(0))).alias("stage"))


def levels(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, level) in an acyclic graph: the most edges on a path from a seed. Raises where seeds lead to a cycle."""
    over = _over(once(edges, "edges", count=True), "src", "dst")
    found = _levels_in_ranges(over, seeds) if can_deal(over.schema["node"].dataType, over.schema["to"].dataType, seeds.schema["node"].dataType) else None
    if found is not None:
        return found
    over = once(over.distinct(), "edges", count=True)
    most = lambda df: df.groupBy("node").agg(F.max("level").alias("level"))
    known = new = materialize(seeds.select("node", F.lit(0).cast("long").alias("level")).distinct(), "levels-0", count=True)
    done, steps = 0, 4
    while rows(new):
        if done > rows(over):  # a path longer than there are edges
            raise ValueError("the graph has a cycle")
        layer, every = new, None
        for _ in range(steps):
            layer = most(layer.join(over, "node").select(F.col("to").alias("node"), (F.col("level") + 1).alias("level")))
            every = layer if every is None else every.unionByName(layer)
        done += steps
        old = known.select("node", F.col("level").alias("was"))
        new = materialize(most(every).join(old, "node", "left").filter("was IS NULL OR level > was").drop("was"), f"levels-{done}", count=True)
        if rows(new):
            both = materialize(most(known.unionByName(new)), "levels-known", count=True)
            drop(known)
            known = both
    return known


def _levels_in_ranges(over: DataFrame, seeds: DataFrame) -> DataFrame | None:
    """levels() by ranges of nodes, as least numbers below zero; None at a cycle in one, or where paths run through many."""
    start = materialize(seeds.select("node", F.lit(0).cast("long").alias("least")), "levels", count=True, narrow=True)
    closed = in_ranges(over, start, "node", longest, StructType([start.schema["node"], StructField("least", LongType())]), "ranges")
    if not closed.filter("least IS NULL").isEmpty():
        return None

    def move(new: DataFrame, few: bool) -> DataFrame:
        return over.join(F.broadcast(new) if few else new, "node").select(F.col("to").alias("node"), (F.col("least") - 1).alias("least"))

    found = leave_ranges(closed, ["node", "least"], "least", move)
    return None if found is None else found.select("node", (-F.col("least")).alias("level"))


def follow(skips: DataFrame) -> DataFrame:
    """(node, target): where chains of skip edges (node, next) lead, by pointer jumping; a cycle of skips leads nowhere.

    Jumps double, so what still moves after as many rounds as the number of skips has binary digits is on a cycle or leads to one.
    """
    now = materialize(skips.select("node", F.col("next").alias("target")), "skips", count=True)
    for n in range(rows(now).bit_length() + 1):
        onward = now.select(F.col("node").alias("target"), F.col("target").alias("further"))
        new = materialize(now.join(onward, "target", "left").select("node", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")), f"skips-{n}")
        drop(now)
        now = new
        if new.filter("moved").isEmpty():
            return now.select("node", "target")
    return now.join(now.select(F.col("node").alias("target")), "target", "left_anti").select("node", "target")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each undirected component, by label propagation with pointer jumping until nothing changes."""
    both = materialize(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    now = materialize(both.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("was"), F.col("node").alias("root")), "roots")
    while True:
        labels = now.select("node", "root")
        near = both.join(labels.select(F.col("node").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        step = materialize(step.join(jump, "root").select("node", "was", F.least("root", "up").alias("root")), "roots")
        drop(now)
        now = step
        if step.filter("was <> root").isEmpty():
            return step.select("node", "root")


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, n_out, targets): outgoing neighbours of each node, in order, as text."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string")), ",").alias("targets"))


def fingerprint(edges: DataFrame, block: str = "block") -> DataFrame:
    """(block, digest): equal for blocks of equal edges, whatever their order."""
    columns = [c for c in edges.columns if c != block]
    rows = F.array_sort(F.collect_list(F.concat_ws(":", *(F.col(c).cast("string") for c in columns))))
    return edges.groupBy(block).agg(F.sha2(F.array_join(rows, "|"), 256).alias("digest"))
