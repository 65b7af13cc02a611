"""Named multimaps as logs of (key, seq, value); a null value inserts the key alone.

Values of a key are a set in order of first insertion. A key may have no values: it is a member, and looks up as nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entries(log: DataFrame) -> DataFrame:
    """(key, value, seq): each value once, at its first insertion."""
    return log.filter("value IS NOT NULL").groupBy("key", "value").agg(F.min("seq").alias("seq"))


def keys(log: DataFrame) -> DataFrame:
    return log.select("key").distinct()


def insert_check(log: DataFrame) -> DataFrame:
    """For each insertion whether the value was there, its ordinal, and how many values the key has after it."""
    rows = log.filter("value IS NOT NULL").select("key", "seq", "value").distinct()
    new = F.col("seq") == F.min("seq").over(Window.partitionBy("key", "value"))
    upto = Window.partitionBy("key").orderBy("seq").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = F.array_sort(F.collect_list(F.when(F.col("_new"), F.struct("seq", "value"))).over(upto))
    return rows.withColumn("_new", new).select(
        "key", "seq", "value", (~F.col("_new")).alias("existed"),
        F.count(F.when(F.col("_new"), 1)).over(upto).alias("n_values"),
        F.concat_ws(",", F.transform(firsts, lambda x: x["value"])).alias("all_values"),
    )


def lookup(log: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, n_values, all_values): values in order of insertion, none for a key that is absent or has none."""
    lists = entries(log).groupBy("key").agg(F.count("*").alias("n"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"])).alias("l"))
    return asked.select("key").join(lists, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n_values"), F.coalesce("l", F.lit("")).alias("all_values"))


def lookup_single(log: DataFrame, asked: DataFrame, *, strict: bool = False) -> DataFrame:
    """(key, value): an error, or null unless strict, where a key hasn't exactly one value."""
    one = entries(log).groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("v"))
    bad = F.raise_error(F.lit("a key must have one value")).cast("string") if strict else F.lit(None).cast("string")
    return asked.select("key").join(one, "key", "left").select("key", F.when(F.col("n") == 1, F.col("v")).otherwise(bad).alias("value"))


def is_member(log: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.select("key").join(keys(log).withColumn("m", F.lit(True)), "key", "left").select("key", F.coalesce("m", F.lit(False)).alias("is_member"))


def remove(log: DataFrame, gone: DataFrame) -> DataFrame:
    return log.join(gone.select("key"), "key", "left_anti")


def choose_key(log: DataFrame) -> DataFrame:
    """The smallest key, or the empty string: a choice that doesn't depend on how rows are dealt."""
    return log.agg(F.coalesce(F.min("key"), F.lit("")).alias("key"))


class Registry:
    """Named multimaps of a session. Any operation creates the multimap that it names, except exists and all_keys."""

    def __init__(self, spark):
        self.spark, self.logs = spark, {}

    def _log(self, name: str) -> DataFrame:
        return self.logs.setdefault(name, self.spark.createDataFrame([], "key string, seq long, value string"))

    def exists(self, name: str) -> bool:
        return name in self.logs

    def clear(self, name: str) -> None:
        self.logs.pop(name, None)
        self._log(name)

    def is_empty(self, name: str) -> bool:
        return self._log(name).isEmpty()

    def insert(self, name: str, rows: DataFrame) -> None:
        self.logs[name] = self._log(name).unionByName(rows)

    def remove(self, name: str, gone: DataFrame) -> None:
        self.logs[name] = remove(self._log(name), gone)

    def lookup(self, name: str, asked: DataFrame) -> DataFrame:
        return lookup(self._log(name), asked)

    def is_member(self, name: str, asked: DataFrame) -> DataFrame:
        return is_member(self._log(name), asked)

    def choose_key(self, name: str) -> str:
        return choose_key(self._log(name)).first()["key"]

    def all_keys(self, name: str) -> DataFrame:
        log = self.logs.get(name)
        return keys(log) if log is not None else self.spark.createDataFrame([], "key string")


class Counters:
    """Named counters. Going below zero fails; taking from a counter that doesn't exist is accepted and does nothing."""

    def __init__(self):
        self.values: dict[str, int] = {}

    def inc(self, name: str) -> None:
        self.values[name] = self.values.get(name, 0) + 1

    def dec(self, name: str) -> bool:
        if name not in self.values:
            return True
        if self.values[name] == 0:
            return False
        self.values[name] -= 1
        return True

    def value(self, name: str) -> int:
        return self.values.get(name, 0)


def counter_values(log: DataFrame) -> DataFrame:
    """(key, value): sums of deltas by counter, for logs in which no counter goes below zero."""
    return log.groupBy("key").agg(F.sum("delta").cast("long").alias("value"))
