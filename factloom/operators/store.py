"""A keyed store as a log of (key, seq, value): later rows win, order of insertion is order of seq."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.order import numbered


def replace(log: DataFrame) -> DataFrame:
    """(key, value): the last write of each key."""
    return log.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def append(log: DataFrame) -> DataFrame:
    """(key, value): all writes of a key, concatenated in order."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "value")))
    return log.groupBy("key").agg(F.concat_ws("", F.transform(parts, lambda x: x["value"])).alias("value"))


def add(store: DataFrame, new: DataFrame) -> DataFrame:
    """Store (key, seq, value) with the first of new's rows for each key that it lacks."""
    first = new.groupBy("key").agg(F.min(F.struct("seq", "value")).alias("x")).select("key", "x.seq", "x.value")
    return store.unionByName(first.join(store.select("key"), "key", "left_anti"))


def lookup(store: DataFrame, keys: DataFrame, *, strict: bool = False) -> DataFrame:
    """(key, value): the empty string for a missing key. A stored empty value is an error if strict."""
    found = keys.select("key").join(store.select("key", "value"), "key", "left")
    value = F.coalesce("value", F.lit(""))
    if strict:
        value = F.when(F.col("value") == "", F.raise_error(F.lit("stored value is empty")).cast("string")).otherwise(value)
    return found.select("key", value.alias("value"))


def has_key(store: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, found)"""
    return keys.select("key").join(store.select("key").distinct().withColumn("found", F.lit(True)), "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))


def all_keys(log: DataFrame) -> DataFrame:
    """(key, seq): every key with the place of its first write; order by seq for the order of insertion."""
    return log.groupBy("key").agg(F.min("seq").alias("seq"))


def key_at(log: DataFrame, places: DataFrame) -> DataFrame:
    """(place, key): the key that was inserted as the n-th, from 0; places (place). None beyond the last."""
    found = numbered(all_keys(log), ["seq", "key"], "_n").select((F.col("_n") - 1).alias("place"), "key")
    return places.select("place").join(found, "place", "left").select("place", "key")


def inflated(value: Column) -> Column:
    """Bytes of a stored value: what it is compressed from, or itself where it isn't compressed."""

    @F.pandas_udf("binary")
    def inflate(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None or v[:1] != b"\x78":
                return v
            try:
                return zlib.decompress(v)
            except zlib.error:
                return v

        return values.map(one)

    return inflate(value)


def by_tag(rows: DataFrame, kinds: dict[int, str]) -> DataFrame:
    """rows (tag, …) with ``kind`` by the tag; a tag that isn't known is an error."""
    known = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    return rows.withColumn("kind", F.coalesce(F.try_element_at(known, F.col("tag")), F.raise_error(F.concat(F.lit("unknown tag "), F.col("tag").cast("string"))).cast("string")))


def clear(store: DataFrame) -> DataFrame:
    return store.limit(0)


def stats(store: DataFrame) -> DataFrame:
    """Number of keys, and bytes of keys and values."""
    return store.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).cast("long").alias("key_bytes"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("long").alias("value_bytes"))
