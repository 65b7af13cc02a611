"""Reporting over analysis logs: totals, kinds, failures, roll-ups, clusters, ordered indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.order import neighbours

#: The lines of a log that are read.
FINISHED = r"^Finished: '([^']*)' FILE (\S+) REDUNDANT (\d+) ASSERTION (\d+) SUCCESS (\d+) REPORT (\d+)"
REPORT = r"^REPORT (\S+) '([^']*)'"
TERMINATED = r"terminated with code"
COUNTS = ("redundant", "assertion", "success", "report")


def finished(log: DataFrame) -> DataFrame:
    """(function, file, redundant, assertion, success, report) of Finished lines."""
    line = log.filter(F.col("line").rlike(FINISHED))
    parts = [F.regexp_extract("line", FINISHED, i) for i in range(1, 7)]
    return line.select(parts[0].alias("function"), parts[1].alias("file"), *(p.cast("long").alias(n) for p, n in zip(parts[2:], COUNTS, strict=True)))


def totals(log: DataFrame, prefix: str = "") -> DataFrame:
    """Sums over Finished lines of files under a prefix."""
    rows = finished(log).filter(F.startswith("file", F.lit(prefix)))
    return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS))


def ratios(total: DataFrame) -> DataFrame:
    """success / assertion, and with redundant ones on both sides; no assertions count as one."""
    n = F.when(F.col("assertion") == 0, F.lit(1)).otherwise(F.col("assertion"))
    return total.select(((F.col("success") + F.col("redundant")) / (n + F.col("redundant"))).alias("all_ratio"), (F.col("success") / n).alias("ratio"))


def kinds(log: DataFrame) -> DataFrame:
    """Number of reports of each kind, whatever their file."""
    return log.filter(F.col("line").rlike(REPORT)).groupBy(F.regexp_extract("line", REPORT, 1).alias("kind")).agg(F.count("*").alias("n"))


def failures(log: DataFrame) -> DataFrame:
    """(cause, n) of terminations in logs (log, line_no, line): what was seen since the last termination, in order of precedence."""
    order = Window.partitionBy("log").orderBy("line_no")
    ends = F.col("line").contains(TERMINATED)
    after = F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = lambda text: F.max(F.when(F.lower("line").contains(text), 1).otherwise(0))
    runs = log.withColumn("run", after).groupBy("log", "run").agg(seen("assertion failed").alias("a"), seen("timeout").alias("t"), seen("conflict").alias("c"), F.max(F.when(ends, 1).otherwise(0)).alias("ended"))
    cause = F.when(F.col("a") == 1, "assert").when(F.col("t") == 1, "timeout").when(F.col("c") == 1, "conflict").otherwise("crash")
    return runs.filter("ended = 1").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


def failure_total(causes: DataFrame) -> DataFrame:
    """Failures without conflicts."""
    return causes.agg(F.coalesce(F.sum(F.when(F.col("cause") != "conflict", F.col("n"))), F.lit(0)).cast("long").alias("failures"))


def ancestors(path: Column, *, itself: bool) -> Column:
    """Every directory above a path, and the path if ``itself``."""
    steps = F.split(path, "/")
    n = F.size(steps) if itself else F.size(steps) - 1
    upto = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    return F.when(n > 0, upto).otherwise(F.array().cast("array<string>"))


def rollup_directories(rows: DataFrame) -> DataFrame:
    """(directory, reports, checked) over every directory above each file, without empty ones; rows as of finished()."""
    up = rows.select(F.explode(ancestors(F.col("file"), itself=False)).alias("directory"), "report", (F.col("redundant") + F.col("assertion")).alias("c"))
    return up.groupBy("directory").agg(F.sum("report").cast("long").alias("reports"), F.sum("c").cast("long").alias("checked")).filter("checked <> 0")


def index_counts(reports: DataFrame) -> DataFrame:
    """(node, n): reports (file) under every directory and file."""
    return reports.select(F.explode(ancestors(F.col("file"), itself=True)).alias("node")).groupBy("node").agg(F.count("*").alias("n"))


def index_neighbours(reports: DataFrame) -> DataFrame:
    """(name, previous, next) in order of file and name."""
    return neighbours(reports.select("file", "name"), ["file", "name"], "name").select("name", "previous", "next")


def number_duplicates(reports: DataFrame) -> DataFrame:
    """(name, label): the printable form, with #k where a file has several of the same."""
    same = Window.partitionBy("file", "printable")
    k, n = F.row_number().over(same.orderBy("name")), F.count("*").over(same)
    return reports.select("name", F.when(n > 1, F.concat("printable", F.lit(" #"), k.cast("string"))).otherwise(F.col("printable")).alias("label"))


def bands(reports: DataFrame, n: int = 4) -> DataFrame:
    """(name, band): every n-th report in order goes to the same band."""
    from factloom.plans.order import numbered

    return numbered(reports.select("name"), ["name"]).select("name", F.pmod(F.col("ordinal") - 1, F.lit(n)).alias("band"))


def report_traits(traits: DataFrame, *, include: list[str] = (), exclude: list[str] = (), families: list[str] = (), drop_last: bool = True) -> DataFrame:
    """(report, trait) after filters. By default the last report of the log is left out, as the log is only flushed by a next one."""
    rows = traits.filter(~F.split("trait", " ").getItem(0).isin(*families)) if families else traits
    for pattern in exclude:
        rows = rows.filter(~F.col("trait").rlike(pattern))
    if include:
        rows = rows.filter(F.col("trait").rlike("|".join(f"(?:{p})" for p in include)))
    if drop_last:
        last = traits.agg(F.max("report").alias("last"))
        rows = rows.join(F.broadcast(last)).filter(F.col("report") != F.col("last")).drop("last")  # one row
    return rows.distinct()


def cluster(traits: DataFrame) -> DataFrame:
    """(trait, n, assigned): each report goes to its most common trait (ties: the first by name)."""
    counts = traits.groupBy("trait").agg(F.count("*").alias("n"))
    best = traits.join(counts, "trait").groupBy("report").agg(F.min(F.struct((-F.col("n")).alias("m"), "trait")).alias("b"))
    chosen = best.groupBy(F.col("b.trait").alias("trait")).agg(F.count("*").alias("assigned"))
    return counts.join(chosen, "trait").select("trait", "n", "assigned")


def assertion_names(asserts: DataFrame) -> DataFrame:
    """(name) kind$file$function$loop$index of asserts (file, function, loop, kind, cls, point, bit): the index counts the checks of a
    kind in a block."""
    block = Window.partitionBy("file", "function", "loop", "kind").orderBy("point", "bit")
    rows = asserts.filter(F.col("cls") == "check").dropDuplicates(["file", "function", "loop", "kind", "point", "bit"])
    return rows.select(F.concat_ws("$", "kind", "file", "function", "loop", (F.row_number().over(block) - 1).cast("string")).alias("name"))
