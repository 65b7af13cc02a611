"""Command line over stored fact tables, analysis logs and programs.

    python -m factloom.cli keys STORE [--print-stats]
    python -m factloom.cli find STORE KEY [--plain-text | --raw-tags]
    python -m factloom.cli stats STORE
    python -m factloom.cli scan LOG [--prefix DIR] [--split]
    python -m factloom.cli cluster LOG [--include PATTERN] [--exclude PATTERN] [--keep-last]
    python -m factloom.cli worklist CALLS [--stages N]
    python -m factloom.cli source FILES STORE [--basedir DIR] [--initial]
    python -m factloom.cli effects EDGES [--pass-limit N] [--print-cfgs] [--print-memory] [--print-indirect] [--print-escape]
    python -m factloom.cli infer EDGES [--print-invariants] [--print-cfgs] [--print-memory]
    python -m factloom.cli check EDGES [--check-kind KIND] [--check-type NAME] [--check-file FILE] [--ck-depth N] [--ck-verbose]
        [--ck-assigns] [--ck-dump] [--ck-sufficient] [--xml-out PATH] [--solver NAME] [--solver-verbose] [--solver-constraint]

STORE is Parquet with key, seq and value; LOG is text; CALLS is Parquet with src and dst; EDGES is Parquet as in
operators.symbolic.EDGES. All commands take --timeout SECONDS (running jobs are cancelled after it), --log FILE (a line
for each command and its time), and, when run as a program, --remote URL (Spark's master), --spawn-count N (executors) and
--memory-limit MB (of each).
"""

from __future__ import annotations

import argparse
import sys
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import callgraph, escape, graph, reporting, store, symbolic
from factloom.plans.order import carried
from factloom.session import local_session
from factloom.sources import sinks

#: Families of traits that say nothing about a report's cause.
TRAIT_FAMILIES = ("Block", "BlockCount", "BoundType", "Unsatisfiable", "HeapPropagate")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(block, line_no, line): lines in order of block and line_no, read in parallel."""
    return spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def traits_of(log: DataFrame) -> DataFrame:
    """(report, trait): a trait line belongs to the last report line before it; reports are told apart by their place."""
    is_report = F.col("line").rlike(reporting.REPORT)
    lines = log.filter(is_report | F.startswith("line", F.lit("TRAIT: ")))
    own = carried(lines.withColumn("_report", F.when(is_report, F.struct("block", "line_no"))), ["block", "line_no"], "_report", "report")
    return own.filter(~is_report & F.col("report").isNotNull()).select("report", F.substring("line", 8, 1 << 20).alias("trait"))


def parser() -> argparse.ArgumentParser:
    whole = argparse.ArgumentParser(prog="factloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = whole.add_subparsers(dest="command", required=True)
    flags = {
        "keys": ["print-stats"], "find": ["plain-text", "raw-tags"], "stats": [], "scan": ["split"], "cluster": ["keep-last"], "worklist": [], "source": ["initial"],
        "effects": ["print-cfgs", "print-memory", "print-indirect", "print-escape"], "infer": ["print-invariants", "print-cfgs", "print-memory"],
        "check": ["ck-verbose", "ck-assigns", "ck-dump", "ck-sufficient", "solver-verbose", "solver-constraint"],
    }
    values = {
        "scan": [("prefix", str, "")], "worklist": [("stages", int, 5)], "source": [("basedir", str, "")], "effects": [("pass-limit", int, 0)],
        "check": [("check-kind", str, ""), ("check-type", str, None), ("check-file", str, None), ("ck-depth", int, 3), ("xml-out", str, None), ("solver", str, "linear")],
    }
    for name, options in flags.items():
        p = sub.add_parser(name)
        p.add_argument("path")
        for extra in {"find": ["key"], "source": ["store"]}.get(name, []):
            p.add_argument(extra)
        for option in options:
            p.add_argument(f"--{option}", action="store_true")
        for option, kind, default in values.get(name, []):
            p.add_argument(f"--{option}", type=kind, default=default)
        if name == "cluster":
            p.add_argument("--include", action="append", default=[])
            p.add_argument("--exclude", action="append", default=[])
        for option, kind in (("timeout", float), ("log", str), ("remote", str), ("spawn-count", int), ("memory-limit", int)):
            p.add_argument(f"--{option}", type=kind)
    return whole


def _cfgs(edges: DataFrame) -> DataFrame:
    return edges.select(F.lit("cfg").alias("what"), "function", F.concat_ws(" ", F.concat("source", F.lit("->"), "target"), "kind", "a", "b").alias("text"))


def _memory(edges: DataFrame) -> DataFrame:
    return symbolic.block_guards(edges).select(F.lit("memory").alias("what"), "function", F.concat_ws(" ", "point", "guard").alias("text"))


def _calls(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'call'").select(F.col("function").alias("caller"), F.regexp_replace("a", r"^.*=\s*", "").alias("callee"))


def effects(edges: DataFrame, a: argparse.Namespace) -> DataFrame:
    """(what, function, text): modified variables, and on demand control flow, guards, calls through pointers and accesses."""
    own = edges.filter("kind = 'assign'").select("function", F.col("a").alias("lval"))
    out = callgraph.modsets(_calls(edges), own, passes=a.pass_limit or None).select(F.lit("modset").alias("what"), "function", F.col("lval").alias("text"))
    if a.print_cfgs:
        out = out.unionByName(_cfgs(edges))
    if a.print_memory:
        out = out.unionByName(_memory(edges))
    if a.print_indirect:
        through = _calls(edges).filter(F.startswith("callee", F.lit("*")))
        out = out.unionByName(through.select(F.lit("indirect").alias("what"), F.col("caller").alias("function"), F.col("callee").alias("text")).distinct())
    if a.print_escape:
        sites = edges.filter("kind = 'assign'").select(F.col("function").alias("site"), F.col("a").alias("target"), F.col("b").alias("value"))
        out = out.unionByName(escape.accesses(sites).select(F.lit("escape").alias("what"), F.col("site").alias("function"), F.concat_ws(" ", "kind", "place").alias("text")))
    return out.orderBy("what", "function", "text")


def infer(edges: DataFrame, a: argparse.Namespace) -> DataFrame:
    """(what, function, text): assertions with their class, and on demand invariants, control flow and guards."""
    out = symbolic.block_assertions(edges).select(F.lit("assertion").alias("what"), "function", F.concat_ws(" ", "cls", "kind", "point", "bit").alias("text"))
    if a.print_invariants:
        found = symbolic.inferred_invariants(edges).unionByName(symbolic.function_results(edges))
        out = out.unionByName(found.select(F.lit("invariant").alias("what"), "function", F.concat_ws(" ", "template", "bit").alias("text")))
    if a.print_cfgs:
        out = out.unionByName(_cfgs(edges))
    if a.print_memory:
        out = out.unionByName(_memory(edges))
    return out.orderBy("what", "function", "text")


def check(edges: DataFrame, a: argparse.Namespace) -> DataFrame:
    """(function, kind, point, verdict) and what is asked for besides."""
    spark = edges.sparkSession
    names = [r.value.strip() for r in spark.read.text(a.check_file).collect() if r.value.strip()] if a.check_file else None  # a list that a user writes
    explain = "constraints" if a.solver_constraint else "yes" if a.solver_verbose or a.ck_assigns or a.ck_dump else ""
    found = symbolic.check_functions(edges, depth=a.ck_depth, kinds=[a.check_kind] if a.check_kind else None, bound=a.check_type, functions=names, solver=a.solver, explain=explain)
    if a.xml_out:
        point = F.struct(F.lit("").alias("file"), F.col("point").alias("line"), F.coalesce("path", F.lit("")).alias("text"))
        reports = found.filter("verdict = 'report'").select(F.concat_ws("$", "kind", "function", "point").alias("name"), "kind", F.array(F.struct("function", F.array(point).alias("points"))).alias("frames"))
        sinks.report_xml(reports).write.mode("overwrite").json(a.xml_out)
    shown = ["function", "kind", "point", "verdict"]
    shown += ["path"] * a.ck_verbose + ["assigns"] * a.ck_assigns + ["formula"] * a.ck_dump + ["queries"] * (a.solver_verbose or a.solver_constraint)
    if a.ck_sufficient:
        found = found.join(symbolic.sufficient_conditions(edges), ["function", "kind", "point"], "left")
        shown.append("sufficient")
    return found.select(*shown).orderBy("function", "kind", "point")


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    a = parser().parse_args(argv)
    start = time.time()
    timer = threading.Timer(a.timeout, spark.sparkContext.cancelAllJobs) if a.timeout else None
    if timer:
        timer.daemon = True
        timer.start()
    try:
        return _run(spark, a)
    finally:
        if a.log:
            with open(a.log, "a") as f:
                f.write(f"{a.command} {a.path} {time.time() - start:.1f} s\n")


def _run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.command in ("keys", "find", "stats"):
        log = spark.read.schema("key string, seq long, value string").parquet(a.path)
        if a.command == "stats" or (a.command == "keys" and a.print_stats):
            return store.stats(store.replace(log))
        if a.command == "keys":
            return store.all_keys(log).orderBy("seq").select("key")
        found = store.lookup(store.replace(log.filter(F.col("key") == a.key)), spark.createDataFrame([(a.key,)], "key string"))
        if a.raw_tags:
            return found.select("key", F.hex(F.encode("value", "UTF-8")).alias("value"))
        return found.select("value") if a.plain_text else found
    if a.command == "scan":
        log = read_log(spark, a.path)
        if a.split:
            return reporting.rollup_directories(reporting.finished(log)).orderBy("directory")
        total = reporting.totals(log, a.prefix)
        return total.join(reporting.ratios(total))
    if a.command == "cluster":
        rows = reporting.report_traits(traits_of(read_log(spark, a.path)), include=a.include, exclude=a.exclude, families=list(TRAIT_FAMILIES), drop_last=not a.keep_last)
        return reporting.cluster(rows).orderBy(F.desc("assigned"), "trait")
    if a.command == "source":
        files = spark.read.option("wholetext", True).text(a.path).select(F.input_file_name().alias("file"), F.col("value"))
        plain = F.regexp_replace("file", "^file:/+", "/")
        rows = files.select(scalars.normalize_file(plain, a.basedir).alias("key"), F.monotonically_increasing_id().alias("seq"), "value")
        rows.write.mode("overwrite" if a.initial else "append").parquet(a.store)
        return spark.read.parquet(a.store).groupBy().agg(F.countDistinct("key").alias("files"))
    if a.command in ("effects", "infer", "check"):
        edges = spark.read.schema(symbolic.EDGES).parquet(a.path)
        return {"effects": effects, "infer": infer, "check": check}[a.command](edges, a)
    calls = spark.read.parquet(a.path).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    nodes = calls.select(F.col("src").alias("node")).unionByName(calls.select(F.col("dst").alias("node"))).distinct()
    return graph.stages(nodes, calls, n_stages=a.stages).orderBy("stage", "node")


def session(argv: list[str]) -> SparkSession:
    """A session as the options ask for it: local, or of a cluster's master with so many executors of so much memory."""
    a = parser().parse_args(argv)
    memory = {"spark.driver.memory": f"{a.memory_limit}m"} if a.memory_limit and not a.remote else {}
    if not a.remote:
        return local_session(a.spawn_count or "*", **memory)
    builder = SparkSession.builder.master(a.remote).appName("factloom").config("spark.sql.session.timeZone", "UTC")
    if a.spawn_count:
        builder = builder.config("spark.executor.instances", str(a.spawn_count))
    if a.memory_limit:
        builder = builder.config("spark.executor.memory", f"{a.memory_limit}m")
    return builder.getOrCreate()


if __name__ == "__main__":
    for row in run(session(sys.argv[1:]), sys.argv[1:]).toLocalIterator():
        print(*row, sep="\t")
