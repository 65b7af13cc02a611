"""Joins of facts by function, invariants at reads and writes, annotations by the text of an edge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_function(functions: DataFrame, **facts: DataFrame) -> DataFrame:
    """(function, <name> …): each function with its row of every table (function, body), null where it has none.

    All tables meet on the function, so that one exchange of each is enough however many there are.
    """
    named = [df.select("function", F.col("body").alias(name)) for name, df in facts.items()]
    return reduce(lambda a, b: a.join(b, "function", "left"), named, functions.select("function").distinct())


def globals_at_writes(writes: DataFrame, invariants: DataFrame) -> DataFrame:
    """(site, name, bit): invariants (name, bit) of the global that is written (site, name)."""
    return writes.join(invariants, "name").select("site", "name", "bit").distinct()


def invariants_at_reads(reads: DataFrame, invariants: DataFrame) -> DataFrame:
    """(site, object, bit): invariants (owner, fields, bit) of the type whose field is read (site, object, owner, field), about that object.

    In the invariant's text ``this`` is the object. One of several fields counts wherever any of them is read.
    """
    met = reads.join(invariants, "owner").filter(F.expr("array_contains(fields, field)"))
    return met.select("site", "object", F.regexp_replace("bit", r"\bthis\b", F.col("object")).alias("bit")).distinct()


def plain_text(text: Column) -> Column:
    """Text of an edge without differences of white space and of a closing semicolon."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r" ?;$", "")


def annotations_at_points(edges: DataFrame, annotations: DataFrame) -> DataFrame:
    """(function, point, name): annotations (function, text, name) at the edges (function, point, text) whose printed text is theirs."""
    wanted = annotations.select("function", plain_text(F.col("text")).alias("_text"), "name")
    return edges.select("function", "point", plain_text(F.col("text")).alias("_text")).join(wanted, ["function", "_text"]).select("function", "point", "name").distinct()


def assumed_bits(points: DataFrame, **sources: DataFrame) -> DataFrame:
    """(function, point, bit, origin): what may be assumed where, from tables (function, point, bit) by name of origin.

    A point of null stands for every point of the function. An assumption that several tables make is named by the first
    of them in order of name.
    """
    every = None
    for origin, df in sorted(sources.items()):
        here = df.filter("point IS NOT NULL").select("function", "point", "bit")
        anywhere = points.join(df.filter("point IS NULL").select("function", "bit"), "function").select("function", "point", "bit")
        part = here.unionByName(anywhere).withColumn("origin", F.lit(origin))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("function", "point", "bit").agg(F.min("origin").alias("origin"))


def safe_fields(fields: DataFrame, invariants: DataFrame) -> DataFrame:
    """(owner, field, safe): whether an invariant (owner, bit) declares the field safe from collection."""
    declared = invariants.select("owner", F.regexp_extract("bit", r"^gcsafe\(this\.(\w+)\)$", 1).alias("field")).filter("field <> ''").distinct().withColumn("safe", F.lit(True))
    return fields.select("owner", "field").distinct().join(declared, ["owner", "field"], "left").select("owner", "field", F.coalesce("safe", F.lit(False)).alias("safe"))
