"""Where values flow: abstract places, facts from control-flow edges, struct copies, readers and writers of the heap.

A place is (base, fields): a variable or type and the chain of fields taken from it, as text joined by dots. A fact about a
place also concerns the less specific places that leave out leading steps of its chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.fixpoint import iterate, spread
from factloom.session import materialize, once


def matches(base: Column, chain: Column) -> Column:
    """Array of (place, ordinal) that a place matches: suffixes of its chain, the shortest first, and the place itself last."""
    steps = F.filter(F.split(chain, "\\."), lambda x: x != "")
    n = F.size(steps)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(steps, n - i + 1, i), "."))
    whole = F.when(n > 0, F.concat(base, F.lit("."), chain)).otherwise(base)
    every = F.concat(F.when(n > 0, suffixes).otherwise(F.array().cast("array<string>")), F.array(whole))
    return F.transform(every, lambda p, i: F.struct(p.alias("place"), i.cast("int").alias("ordinal")))


def expand_struct(copies: DataFrame, fields: DataFrame) -> DataFrame:
    """(source, target, type) of copies, with struct types (type, field, field_type) taken apart down to fields that aren't structs.

    A type that holds itself has no finite size: it raises.
    """
    parts = once(fields.select("type", "field", "field_type"), "fields")
    nested = parts.join(parts.select(F.col("type").alias("field_type")).distinct(), "field_type", "left_semi").select(F.col("type").alias("node"), F.col("field_type").alias("to")).distinct()
    nested = materialize(nested, "nested")
    inside = spread(nested.select(F.col("node").alias("outer"), F.col("to").alias("node")), nested)
    if not inside.filter("outer = node").isEmpty():
        raise ValueError("a struct type holds itself")

    def step(new: DataFrame) -> DataFrame:
        met = new.join(parts, "type")
        return met.select(F.concat("source", F.lit("."), "field").alias("source"), F.concat("target", F.lit("."), "field").alias("target"), F.col("field_type").alias("type"))

    every = iterate(copies.select("source", "target", "type"), step)
    return every.join(parts.select("type").distinct(), "type", "left_anti").select("source", "target", "type")


def place_of(expression: Column) -> Column:
    """The place of an expression as text: indexes go, ``->`` and ``.`` are steps, a leading dereference or address is none;
    null for what isn't a place (numbers, texts, calls, sums)."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(expression), r"^[*&(\s]+", ""), r"[)\s]+$", "")
    steps = F.regexp_replace(F.regexp_replace(bare, r"\[[^\[\]]*\]", ""), r"->", ".")
    return F.when(steps.rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)*$"), steps)


def split_place(place: Column) -> tuple[Column, Column]:
    """Base and chain of fields of a place as text."""
    return F.substring_index(place, ".", 1), F.regexp_replace(F.regexp_replace(place, r"^[^.]*", ""), r"^\.", "")


def accesses(edges: DataFrame) -> DataFrame:
    """(site, kind, place, field): reads and writes of edges (site, target, value), one for each place that the accessed one matches.

    field is the last step of the accessed place, if it has one.
    """
    each = [edges.select("site", F.lit(kind).alias("kind"), place_of(F.col(column)).alias("place")) for kind, column in (("read", "value"), ("write", "target"))]
    met = each[0].unionByName(each[1]).filter("place IS NOT NULL")
    base, chain = split_place(F.col("place"))
    field = F.when(F.contains("place", F.lit(".")), F.substring_index("place", ".", -1))
    return met.select("site", "kind", F.explode(matches(base, chain)).alias("m"), field.alias("field")).select("site", "kind", "m.place", "field").distinct()


def base_class_edges(bases: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, base) of bases that have a virtual method (class, method) of their own or inherited: what dispatch follows."""
    over = once(bases.select(F.col("base").alias("node"), F.col("class").alias("to")).distinct(), "bases")
    virtual = spread(methods.select(F.col("class").alias("node")).distinct(), over)
    return bases.select("class", "base").distinct().join(virtual.select(F.col("node").alias("base")), "base", "left_semi").select("class", "base")


def update_places(formulas: DataFrame) -> DataFrame:
    """(formula, place): places of which an update may change a formula (formula, text), with all that they match."""
    name = F.lit(r"[A-Za-z_]\w*(?:(?:->|\.)[A-Za-z_]\w*)*(?!\w*\()")
    inside = F.array_join(F.regexp_extract_all("text", F.lit(r"\[([^\[\]]*)\]"), F.lit(1)), " , ")
    names = F.regexp_extract_all(F.concat(F.regexp_replace("text", r"\[[^\[\]]*\]", ""), F.lit(" , "), inside), name, F.lit(0))
    place = formulas.select("formula", F.explode(names).alias("x")).select("formula", place_of(F.col("x")).alias("place")).filter("place IS NOT NULL")
    base, chain = split_place(F.col("place"))
    return place.select("formula", F.explode(matches(base, chain)).alias("m")).select("formula", "m.place").distinct()


def flows(edges: DataFrame, parameters: DataFrame) -> DataFrame:
    """(source, target, site, move) from edges (site, kind, target, value, callee, position): an assignment flows from value to
    target; an argument into its parameter (callee, position, name); what is returned out to the call's target; where edges have
    an ``instance``, the object of a call into the callee's ``this``."""
    assign = edges.filter(F.col("kind") == "assign").select(F.col("value").alias("source"), "target", "site", F.lit("stay").alias("move"))
    calls = edges.filter(F.col("kind") == "call")
    passed = calls.filter("value IS NOT NULL").join(parameters, ["callee", "position"]).select(F.col("value").alias("source"), F.col("name").alias("target"), "site", F.lit("call").alias("move"))
    back = calls.filter("target IS NOT NULL").select(F.concat("callee", F.lit(":return")).alias("source"), "target", "site", F.lit("return").alias("move"))
    out = assign.unionByName(passed).unionByName(back)
    if "instance" in edges.columns:
        out = out.unionByName(calls.filter("instance IS NOT NULL").select(F.col("instance").alias("source"), F.concat("callee", F.lit(":this")).alias("target"), "site", F.lit("call").alias("move")))
    return out.distinct()


def heap_writes(reads: DataFrame, writes: DataFrame, versions: DataFrame, *, first_run: bool = True) -> DataFrame:
    """(read, place, site): writers of a place that is read, or of one that it matches, at sites whose version is current.

    reads (read, base, chain), writes (place, site, version), versions (site, version). After the first run writes of
    ``kind`` initializer, if there is such a column, don't count: they were met in it.
    """
    if not first_run:
        writes = writes.filter("kind <> 'initializer'")
    wanted = reads.select("read", F.explode(matches(F.col("base"), F.col("chain"))).alias("m")).select("read", "m.place")
    now = writes.join(versions, ["site", "version"], "left_semi")
    return wanted.join(now.select("place", "site"), "place").select("read", "place", "site").distinct()


def to_reanalyze(preconditions: DataFrame, calls: DataFrame, invariants: DataFrame, writes: DataFrame) -> DataFrame:
    """Functions to analyse again: callers of those with a new precondition, and writers of a place with a new invariant."""
    callers = calls.join(preconditions.select(F.col("node").alias("callee")), "callee", "left_semi").select(F.col("caller").alias("node"))
    writers = writes.join(invariants.select("place"), "place", "left_semi").select("node")
    return callers.unionByName(writers).distinct()
