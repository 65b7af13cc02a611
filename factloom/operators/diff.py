"""Set operations between runs: claims, differences, merges, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claim(asked: DataFrame, seen: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """The keys that nobody has claimed, each once, and what is claimed from now on."""
    todo = asked.select(key).distinct().join(seen.select(key), key, "left_anti")
    return todo, seen.select(key).unionByName(todo)


def run_diff(current: DataFrame, previous: DataFrame, key: list[str]) -> DataFrame:
    """Rows of this run whose key the previous one lacks."""
    return current.join(previous.select(key), key, "left_anti")


def merge_sets(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Set union of facts."""
    return stored.unionByName(new).distinct()


def merge_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Set union of (source, target, block, kind, point); points of one initializer count as equal, the first of them stays."""
    both = stored.unionByName(new)
    at = F.when(F.col("kind") == "initializer", F.lit(-1)).otherwise(F.col("point"))
    return both.groupBy("source", "target", "block", "kind", at.alias("at")).agg(F.min("point").alias("point")).drop("at")


def override(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace stored ones of the same key; other stored ones stay."""
    return new.unionByName(stored.join(new.select(key), key, "left_anti"))


def incremental_versions(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """(key, version, state) from stored (key, version, digest) and this run's (key, digest).

    same: equal digest, version kept. changed: version + 1. new: version 0. deleted: stored but not seen, version + 1.
    """
    both = stored.select("key", "version", F.col("digest").alias("was")).join(seen.select("key", F.col("digest").alias("now")), "key", "full")
    state = F.when(F.col("version").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    version = F.when(state == "new", F.lit(0)).when(state == "same", F.col("version")).otherwise(F.col("version") + 1)
    return both.select("key", version.cast("long").alias("version"), state.alias("state"))


def changed_files(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """(file, changed): new files, and files whose preprocessed text differs."""
    was = stored.select("file", F.sha2("preprocessed", 256).alias("was"))
    now = seen.select("file", F.sha2("preprocessed", 256).alias("now"))
    return now.join(was, "file", "left").select("file", (~F.coalesce(F.col("was") == F.col("now"), F.lit(False))).alias("changed"))


def incremental_worklist(versions: DataFrame, reanalyze: DataFrame) -> DataFrame:
    """(key, section): 'new' for what changed, appeared, went or has to be analysed again; 'old' for the rest."""
    again = reanalyze.select("key").distinct().withColumn("again", F.lit(True))
    fresh = (F.col("state") != "same") | F.coalesce("again", F.lit(False))
    return versions.join(again, "key", "left").select("key", F.when(fresh, "new").otherwise("old").alias("section"))


def current_only(facts: DataFrame, versions: DataFrame) -> DataFrame:
    """Facts recorded at a version of their site that is still the current one."""
    return facts.join(versions.select("key", "version"), ["key", "version"], "left_semi")


def intern(objects: DataFrame, columns: list[str]) -> DataFrame:
    """Different objects with an id from their content."""
    return objects.select(*columns).distinct().withColumn("id", F.sha2(F.to_json(F.struct(*columns)), 256))


def routed(rows: DataFrame, tables: list[str]) -> dict[str, DataFrame]:
    """The rows (tag, …) of each table, every one once; rows of one batch may be for several."""
    return {t: rows.filter(F.col("tag") == t).drop("tag").distinct() for t in tables}


def deferred(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows that a round writes for the next one; a key that was written twice is an error when they are read."""
    n = F.count("*").over(Window.partitionBy(*key))
    checked = F.when(n > 1, F.raise_error(F.concat_ws(" ", F.lit("written twice:"), *(F.col(k).cast("string") for k in key))).cast("boolean")).otherwise(True)
    return rows.withColumn("_once", checked).filter("_once").drop("_once")


def retired(old: DataFrame, new: DataFrame, owner: str, key: list[str]) -> DataFrame:
    """Rows of old whose owner was written again without them: they move to the removed ones."""
    return old.join(new.select(owner).distinct(), owner, "left_semi").join(new.select(key), key, "left_anti")


def pending(*batches: DataFrame) -> DataFrame:
    """The rows of several batches that weren't sent yet, every one once."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out.distinct()


def declarations(roots: DataFrame, uses: DataFrame) -> DataFrame:
    """(name, place): everything that roots (node) use, directly or not, with a place after whatever it uses itself.

    uses (src, dst): src needs the declaration of dst. Raises where names need each other.
    """
    from factloom.operators import graph

    needed = graph.reach(uses, roots)
    inside = uses.join(needed.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst")
    turned = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    leaves = needed.join(inside.select(F.col("src").alias("node")), "node", "left_anti")
    return graph.levels(turned, leaves).select(F.col("node").alias("name"), F.col("level").alias("place"))


def value_order(kind: str = "kind") -> list[Column]:
    """Order of modified values: by place, then by kind, none first."""
    return [F.col("lval").asc(), F.col(kind).asc_nulls_first()]


def assign_order() -> list[Column]:
    """Order of guarded assignments: by target, value and guard."""
    return [F.col("left").asc(), F.col("right").asc(), F.col("guard").asc()]
