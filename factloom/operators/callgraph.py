"""Call graph operators: direct and indirect edges, virtual dispatch, side effects over calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.fixpoint import iterate, spread
from factloom.session import materialize, once


def direct_calls(calls: DataFrame) -> DataFrame:
    """(caller, callee) of calls (caller, callee, kind) that name their target."""
    return calls.filter((F.col("kind") == "direct") & F.col("callee").isNotNull()).select("caller", "callee").distinct()


def has_indirect(calls: DataFrame) -> DataFrame:
    """Callers with a call through a pointer."""
    return calls.filter(F.col("kind") == "indirect").select(F.col("caller").alias("node")).distinct()


def indirect_targets(sites: DataFrame, escapes: DataFrame, functions: DataFrame) -> DataFrame:
    """(pointer, arity, function): functions that reach a pointer and take as many arguments as are passed."""
    known = escapes.join(functions, "function").select("pointer", "arity", "function").distinct()
    return sites.select("pointer", "arity").distinct().join(known, ["pointer", "arity"])


def all_targets(sites: DataFrame, flows: DataFrame, functions: DataFrame, virtual: DataFrame, *, depth: int = 100) -> DataFrame:
    """(site, function, how) of calls without a name: through a pointer, functions from which a value flows to it and that take
    as many arguments; on an object, what dispatch finds.

    sites (site, pointer, arity, class, method) have a pointer or a class; flows (source, target) of values; functions
    (function, arity); virtual (class, method, function). Flows are followed backward, at most ``depth`` of them.
    """
    back = once(flows.select(F.col("target").alias("node"), F.col("source").alias("to")).distinct(), "flows")
    asked = sites.filter("pointer IS NOT NULL").select("pointer", F.col("pointer").alias("node")).distinct()
    found = spread(asked.withColumn("moves", F.lit(0)), back, hops="moves", bound=depth).select("pointer", F.col("node").alias("function"))
    known = found.join(functions.select("function", "arity").distinct(), "function").groupBy("pointer", "arity").agg(F.collect_set("function").alias("functions"))
    known = materialize(known, "targets", narrow=True)
    one_arity = functions.groupBy("function").agg(F.countDistinct("arity").alias("n")).filter("n > 1").isEmpty()
    direct = _targets_at_sites(sites.filter("pointer IS NOT NULL").select("site", "pointer", "arity").distinct(), known, ["site", "arity"] if one_arity else ["site"])
    through = sites.filter("class IS NOT NULL").select("site", "class", "method").join(virtual, ["class", "method"])
    return direct.select("site", "function", F.lit("pointer").alias("how")).unionByName(through.select("site", "function", F.lit("virtual").alias("how")).distinct())


def _targets_at_sites(pairs: DataFrame, known: DataFrame, apart: list[str]) -> DataFrame:
    """(site, function), once each, of distinct pairs (site, pointer, arity) and the functions of each pointer and arity.

    Functions go as a list for a pair, and rows are made of the lists last: where a site has one pair they are distinct as they
    are, and only lists of sites with several pairs meet to be told apart. ``apart``: columns of pairs, site among them, of which
    pairs that differ in them share no function.
    """
    counted = materialize(pairs.withColumn("_n", F.count("*").over(Window.partitionBy(*apart))), "pairs", narrow=True)
    met = counted.join(known, ["pointer", "arity"])
    several = met.filter("_n > 1").groupBy(*apart).agg(F.array_distinct(F.flatten(F.collect_list("functions"))).alias("functions"))
    return met.filter("_n = 1").select("site", F.explode("functions").alias("function")).unionByName(several.select("site", F.explode("functions").alias("function")))


def receiver_chains(bases: DataFrame, calls: DataFrame) -> DataFrame:
    """(class, sub, chain): for every class at or below that of a call, the fields that lead from the base part of an object
    back to the whole, the innermost first.

    bases (class, base, field): field is where an object of class holds its base. A class reached over several ways has several chains.
    """
    over = once(bases.select("base", F.col("class").alias("next"), "field"), "bases")
    loops = spread(over.select(F.col("base").alias("from"), F.col("next").alias("node")).distinct(), over.select(F.col("base").alias("node"), F.col("next").alias("to")))
    if not loops.filter("from = node").isEmpty():
        raise ValueError("a class is its own base")
    start = calls.select("class", F.col("class").alias("sub"), F.lit("").alias("chain")).distinct()

    def step(new: DataFrame) -> DataFrame:
        met = new.join(over, new["sub"] == over["base"])
        return met.select("class", F.col("next").alias("sub"), F.when(F.col("chain") == "", F.col("field")).otherwise(F.concat_ws(".", "chain", "field")).alias("chain"))

    return iterate(start, step)


def adjust_receiver(expression: Column, chain: Column) -> Column:
    """An expression over ``this`` of a base class as one over the whole object: each field of the chain is taken back."""
    back = F.aggregate(F.filter(F.split(chain, "\\."), lambda f: f != ""), F.lit("this"), lambda a, f: F.concat(F.lit("rfld("), a, F.lit(", "), f, F.lit(")")))
    return F.regexp_replace(expression, r"\bthis\b", back)


#: Steps beyond which a modified place isn't followed into callers.
MOST_DEREFERENCES, MOST_TERMINATOR_DEREFERENCES, MOST_FIELDS, MOST_VALUES = 1, 2, 6, 2


def updated_lvals(assigns: DataFrame) -> DataFrame:
    """(function, lval, exact): what callers have to know of assigns (function, lval, value, terminator), and the values as text, if they are few.

    Only places that start at an argument, a global, the receiver or the return value count, and not those behind an
    index, a reverse field, a clobbered or an unknown value, more than one dereference (two for terminators) or six
    fields. Exact values are given where there are two at most or all are constants.
    """
    lval = F.col("lval")
    derefs = F.length(F.regexp_replace(lval, r"[^*]", ""))
    rooted = lval.rlike(r"^\**\(?(?:arg[0-9]+|this|return|glob:\w+)\b")
    shallow = derefs <= F.when(F.col("terminator"), MOST_TERMINATOR_DEREFERENCES).otherwise(MOST_DEREFERENCES)
    plain = ~lval.rlike(r"\[|rfld\(|clobber\(|val\(") & (F.size(F.split(lval, "\\.")) - 1 <= MOST_FIELDS)
    kept = assigns.filter(rooted & shallow & plain).groupBy("function", "lval").agg(F.array_sort(F.collect_set("value")).alias("values"))
    few = (F.size("values") <= MOST_VALUES) | F.forall("values", lambda v: v.rlike("^-?[0-9]+$"))
    return kept.select("function", "lval", F.when(few, F.array_join("values", " | ")).alias("exact"))


def virtual_targets(bases: DataFrame, methods: DataFrame, calls: DataFrame) -> DataFrame:
    """(class, method, function): what a virtual call on an object of static type class may run.

    bases (class, base), methods (class, method, function; function null if pure), calls (class, method). Objects may be of
    the class or anything below it; each runs the nearest implementation at or above its own class.
    """
    bases, methods = once(bases, "bases"), once(methods, "methods")
    up = bases.select(F.col("class").alias("at"), F.col("base").alias("to"))
    classes = bases.select("class").unionByName(bases.select(F.col("base").alias("class"))).unionByName(methods.select("class")).unionByName(calls.select("class")).distinct()
    below = iterate(calls.select(F.col("class").alias("top"), "method", F.col("class").alias("class")), lambda new: new.join(bases.select(F.col("base").alias("class"), F.col("class").alias("sub")), "class").select("top", "method", F.col("sub").alias("class")))
    # For each class and method, walk up until a class declares it.
    declared = methods.select(F.col("class").alias("at"), "method", "function")
    wanted = below.select("class", "method").distinct().join(classes, "class", "left_semi").select("class", "method", F.col("class").alias("at"))

    def step(new: DataFrame) -> DataFrame:
        return new.join(declared.select("at", "method"), ["at", "method"], "left_anti").join(up, "at").select("class", "method", F.col("to").alias("at"))

    found = iterate(wanted, step).join(declared, ["at", "method"]).filter("function IS NOT NULL")
    return below.join(found.select("class", "method", "function"), ["class", "method"]).select(F.col("top").alias("class"), "method", "function").distinct()


def callers_of(calls: DataFrame, changed: DataFrame) -> DataFrame:
    """Callers of changed callees: the next worklist."""
    return calls.join(changed.select(F.col("node").alias("callee")), "callee", "left_semi").select(F.col("caller").alias("node")).distinct()


def modsets(calls: DataFrame, own: DataFrame, *, passes: int | None = None) -> DataFrame:
    """(function, lval): what a function modifies itself or through its callees, to the fixpoint or as far as so many calls deep."""
    over = once(calls.select(F.col("callee").alias("node"), F.col("caller").alias("to")), "calls", count=True)
    return spread(own.select("function", "lval"), over, "function", bound=passes)


def argument_modsets(calls: DataFrame, own: DataFrame) -> DataFrame:
    """(function, lval) where an argument's lval is renamed at each call by passes (caller, callee, formal, actual); others pass as they are."""
    over = once(calls.select("caller", F.col("callee").alias("function"), F.col("formal").alias("lval"), "actual"), "calls")
    return iterate(own.select("function", "lval"), lambda new: new.join(over, ["function", "lval"]).select(F.col("caller").alias("function"), F.col("actual").alias("lval")))


def can_collect(calls: DataFrame, roots: DataFrame) -> DataFrame:
    """Functions that call a root, at any depth, and the roots."""
    return spread(roots.select("node"), once(calls.select(F.col("callee").alias("node"), F.col("caller").alias("to")), "calls", count=True))


def summary_at_calls(calls: DataFrame, assumes: DataFrame) -> DataFrame:
    """Assumptions of callees at each call site; through an indirect call they hold only if the receiver is that callee."""
    met = calls.join(assumes.withColumnRenamed("function", "callee"), "callee")
    return met.select("caller", "site", "callee", F.when(F.col("kind") == "indirect", F.concat(F.lit("receiver="), "callee", F.lit(" => "), "bit")).otherwise(F.col("bit")).alias("bit")).distinct()


def invariants_at_writes(writes: DataFrame, invariants: DataFrame) -> DataFrame:
    """Invariants (owner, fields, bit) of the type written (owner, field, site) that mention the field."""
    return writes.join(invariants, "owner").filter(F.expr("array_contains(fields, field)")).select("site", "owner", "field", "bit").distinct()
