"""Guarded values: (value, guard) lists with guards as text in disjunctive form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine(values: DataFrame, key: list[str]) -> DataFrame:
    """Group by value, join the guards by or; a true guard absorbs the others."""
    guards = F.array_sort(F.collect_set("guard"))
    whole = F.when(F.array_contains(guards, "true"), F.lit("true")).otherwise(F.array_join(guards, " | "))
    return values.groupBy(*key, "value").agg(whole.alias("guard"))


def simplify(values: DataFrame, key: list[str]) -> DataFrame:
    """One value holds under true; of two the one with the longer guard holds under the negation of the other's."""
    rank = F.struct(F.length("guard").alias("n"), "guard", "value")
    lists = values.groupBy(*key).agg(F.array_sort(F.collect_list(rank)).alias("l"))
    one = F.transform("l", lambda x: F.struct(x["value"].alias("value"), F.lit("true").alias("guard")))
    first = F.element_at("l", 1)["guard"]
    two = F.transform("l", lambda x, i: F.struct(x["value"].alias("value"), F.when(i == 0, first).otherwise(F.concat(F.lit("!("), first, F.lit(")"))).alias("guard")))
    rest = F.transform("l", lambda x: F.struct(x["value"].alias("value"), x["guard"].alias("guard")))
    done = F.when(F.size("l") == 1, one).when(F.size("l") == 2, two).otherwise(rest)
    return lists.select(*key, F.explode(done).alias("x")).select(*key, "x.value", "x.guard")
