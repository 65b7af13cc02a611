"""Sources of text: whole files, preprocessor output, worklists and annotation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.plans.order import carried

LINE_MARK = r'^# (\d+) "([^"]*)"'


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): each file as one string, up to its first NUL."""
    rows = spark.read.option("wholetext", True).text(path)
    return rows.select(F.input_file_name().alias("file"), F.split("value", "\0").getItem(0).alias("text"))


def split_preprocessed(units: DataFrame) -> DataFrame:
    """(unit, file, line, text) of preprocessor output (unit, text): each line under the file and line of the mark before it.

    Where a file comes back to a line that it has passed, the later text of the line counts.
    """
    lines = units.select("unit", F.posexplode(F.split("text", "\n")).alias("place", "text"))
    mark = F.col("text").rlike(LINE_MARK)
    run = Window.partitionBy("unit").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    when = lambda c: F.last(F.when(mark, c), ignorenulls=True).over(run)
    placed = lines.withColumn("file", when(F.regexp_extract("text", LINE_MARK, 2))).withColumn("_from", when(F.regexp_extract("text", LINE_MARK, 1).cast("long"))).withColumn("_at", when(F.col("place"))).withColumn("_mark", mark)
    own = placed.filter(~F.col("_mark") & F.col("file").isNotNull()).withColumn("line", F.col("_from") + F.col("place") - F.col("_at") - 1)
    return own.groupBy("unit", "file", "line").agg(F.max_by("text", "place").alias("text"))


def parse_worklist(lines: DataFrame) -> DataFrame:
    """(stage, header, file, function) of worklist lines (line_no, line): '#' opens a stage, others are file$function.

    If the first header is #new, what follows #old is left out.
    """
    head = F.startswith("line", F.lit("#"))
    heads = lines.filter(head).select(F.col("line_no").alias("first"), F.col("line").alias("header"))
    order = Window.orderBy("first")  # over headers only, which name stages
    heads = heads.select((F.row_number().over(order) - 1).alias("stage"), "header", "first", F.first("header").over(order).alias("opening"))
    under = carried(lines.withColumn("_head", F.when(head, F.col("line_no"))), ["line_no"], "_head", "first")
    rows = under.filter(~head & F.col("line").contains("$")).join(heads, "first")
    rows = rows.filter(~((F.col("opening") == "#new") & (F.col("header") == "#old")))
    return rows.select("stage", "header", F.split("line", "\\$").getItem(0).alias("file"), F.regexp_extract("line", r"^[^$]*\$(.*)$", 1).alias("function"))


def parse_annotations(lines: DataFrame) -> DataFrame:
    """(file, hook, text, trusted) of annotation files (file, line_no, line): blocks between blank lines, the hook first, then
    text, then 'trusted' if it is."""
    blank = F.trim("line") == ""
    run = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("block", F.sum(F.when(blank, 1).otherwise(0)).over(run)).filter(~blank)
    listed = rows.groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    body = F.transform(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(1))), lambda x: x["line"])
    trusted = F.array_contains(body, "trusted")
    return listed.select("file", F.element_at("l", 1)["line"].alias("hook"), F.array_join(F.filter(body, lambda x: x != "trusted"), "\n").alias("text"), trusted.alias("trusted"))


def write_worklist(staged: DataFrame) -> DataFrame:
    """(section, line): file$function, to be ordered by section and line."""
    return staged.select(F.when(F.col("stage") < 0, F.lit("#final")).otherwise(F.concat(F.lit("#stage"), F.col("stage").cast("string"))).alias("section"), F.concat_ws("$", "file", "function").alias("line"))
