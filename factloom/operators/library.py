"""What calls of known library functions do: allocate, copy, fill, or nothing worth following.

The tables below name functions of the C and C++ runtime; a project's own are further rows. A call (function, args) meets
its row by the function's bare name: without a ``file:`` prefix and from the opening parenthesis on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, how the size is made (arg, product, sum or fixed), and the arguments or bytes that make it.
ALLOCATORS = (
    ("malloc", "arg", 0, None),
    ("realloc", "arg", 1, None),
    ("void* operator new", "arg", 0, None),
    ("void* operator new []", "arg", 0, None),
    ("calloc", "product", 0, 1),
)
#: Name, and the arguments that are target, source and length.
COPIES = (("memcpy", 0, 1, 2), ("memmove", 0, 1, 2))
#: Name, and the arguments that are target, value and length.
FILLS = (("memset", 0, 1, 2),)
#: Functions that move the terminator of a text: name, the argument whose text changes, and where its end then is
#: (over the arguments; None for somewhere).
ENDS = (("strcpy", 0, "strlen(arg1)"), ("strcat", 0, "strlen(arg0) + strlen(arg1)"), ("strncpy", 0, None), ("strncat", 0, None), ("sprintf", 0, None), ("snprintf", 0, None), ("gets", 0, None), ("fgets", 0, None))
#: What holds after a call, over its arguments and ``return``.
RETURNS = (
    ("malloc", "return == 0 | ubound(return) >= arg0"),
    ("calloc", "return == 0 | ubound(return) >= arg0 * arg1"),
    ("realloc", "return == 0 | ubound(return) >= arg1"),
    ("strlen", "return == term(arg0)"),
    ("strchr", "return == 0 | return - arg0 <= term(arg0)"),
    ("strrchr", "return == 0 | return - arg0 <= term(arg0)"),
    ("read", "return <= arg2"),
    ("abs", "return >= 0"),
)
#: How a call of an ignored function counts: dropped, never returning, or returning zero.
IGNORE = ("drop", "unreachable", "return_zero")


def bare_name(function: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(function, r"^[^:(]*[^:(]:(?!:)", ""), r"\(.*$", "")


def _met(calls: DataFrame, rows: tuple, schema: str) -> DataFrame:
    """Calls with their row; the tables are short parameters and are broadcast."""
    table: SparkSession = calls.sparkSession
    known = table.createDataFrame(list(rows), schema)
    return calls.withColumn("name", bare_name(F.col("function"))).join(F.broadcast(known), "name")


def _arg(i: str) -> Column:
    return F.try_element_at("args", F.col(i) + 1)


def allocations(calls: DataFrame, extra: tuple = ()) -> DataFrame:
    """(site, name, size): the size as text over the arguments."""
    met = _met(calls, ALLOCATORS + extra, "name string, how string, one int, two int")
    size = F.when(F.col("how") == "fixed", F.col("one").cast("string")).when(F.col("how") == "product", F.concat(_arg("one"), F.lit(" * "), _arg("two"))).when(F.col("how") == "sum", F.concat(_arg("one"), F.lit(" + "), _arg("two"))).otherwise(_arg("one"))
    return met.select("site", "name", size.alias("size"))


def copies(calls: DataFrame, extra: tuple = ()) -> DataFrame:
    """(site, target, source, length)"""
    met = _met(calls, COPIES + extra, "name string, t int, s int, n int")
    return met.select("site", _arg("t").alias("target"), _arg("s").alias("source"), _arg("n").alias("length"))


def zeroed(calls: DataFrame, extra: tuple = ()) -> DataFrame:
    """(site, target, length) of fills whose value is the literal 0."""
    met = _met(calls, FILLS + extra, "name string, t int, v int, n int")
    return met.filter(_arg("v") == "0").select("site", _arg("t").alias("target"), _arg("n").alias("length"))


def followed(calls: DataFrame, ignored: tuple = ()) -> DataFrame:
    """Calls with ``treat``: follow, or as the ignored function's row (name, how) says."""
    if not ignored:
        return calls.withColumn("treat", F.lit("follow"))
    table = calls.sparkSession.createDataFrame(list(ignored), "name string, how string")
    return calls.withColumn("name", bare_name(F.col("function"))).join(F.broadcast(table), "name", "left").withColumn("treat", F.coalesce("how", F.lit("follow"))).drop("name", "how")


def terminator_effects(calls: DataFrame, extra: tuple = ()) -> DataFrame:
    """(site, target, ends): texts that a call changes, and where they end after it (null: not known)."""
    met = _met(calls, ENDS + extra, "name string, t int, ends string")
    return met.select("site", _arg("t").alias("target"), _with_arguments(F.col("ends")).alias("ends"))


def postconditions(calls: DataFrame, extra: tuple = ()) -> DataFrame:
    """(site, name, bit): what holds after a call, with its arguments put in."""
    met = _met(calls, RETURNS + extra, "name string, bit string")
    return met.select("site", "name", _with_arguments(F.col("bit")).alias("bit"))


def _with_arguments(text: Column) -> Column:
    """A text over arg0 to arg9 with a call's arguments instead; a missing one stays."""
    parts = F.regexp_extract_all(text, F.lit(r"arg[0-9]|(?:(?!arg[0-9]).)+"), F.lit(0))
    put = lambda p: F.when(p.rlike("^arg[0-9]$"), F.coalesce(F.try_element_at("args", F.substring(p, 4, 1).try_cast("int") + 1), p)).otherwise(p)
    return F.when(text.isNotNull(), F.array_join(F.transform(parts, put), ""))


def collected_types(fields: DataFrame, collected: DataFrame) -> DataFrame:
    """(owner, field, type, collected): whether a field's type, behind any pointers, is managed by a collector (types ``name``)."""
    bare = F.trim(F.regexp_replace("type", r"[*&]|\bconst\b|\bstruct\b", ""))
    known = collected.select(F.col("name").alias("_bare")).distinct().withColumn("_c", F.lit(True))
    return fields.withColumn("_bare", bare).join(known, "_bare", "left").select("owner", "field", "type", F.coalesce("_c", F.lit(False)).alias("collected"))
