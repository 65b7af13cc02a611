"""Order-dependent columns over whole tables without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import materialize


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df dealt to partitions by ranges of the order; ``_pid`` grows with it."""
    return materialize(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "ranged")


def numbered(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """Adds the place of each row, from 1. The only unpartitioned window is over one row per partition."""
    dealt = ranged(df, order)
    counts = dealt.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_pid").withColumn(name, F.col("_before") + F.col("_own")).drop("_pid", "_own", "_before")


def neighbours(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """Adds ``previous`` and ``next``: the value of the rows before and after in the whole order."""
    dealt = ranged(df, order)
    line = Window.partitionBy("_pid").orderBy(*order)
    key = F.struct(*order, F.col(value).alias("_value"))
    edges = dealt.groupBy("_pid").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    pids = Window.orderBy("_pid")
    edges = edges.select("_pid", F.lag("_last._value").over(pids).alias("_p"), F.lead("_first._value").over(pids).alias("_n"))
    out = dealt.withColumn("_lag", F.lag(value).over(line)).withColumn("_lead", F.lead(value).over(line)).join(F.broadcast(edges), "_pid")
    return out.withColumn("previous", F.coalesce("_lag", "_p")).withColumn("next", F.coalesce("_lead", "_n")).drop("_pid", "_lag", "_lead", "_p", "_n")


def carried(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the last value that isn't null up to each row in the whole order. Ranges carry theirs to the next one."""
    dealt = ranged(df, order)
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_value")))).alias("_last")
    ends = dealt.groupBy("_pid").agg(last)  # a row per range
    before = F.last("_last._value", ignorenulls=True).over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("_own", own).join(F.broadcast(ends.select("_pid", before.alias("_before"))), "_pid").withColumn(name, F.coalesce("_own", "_before")).drop("_pid", "_own", "_before")
