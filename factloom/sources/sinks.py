"""Sinks of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xml_escape(s: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(sign), F.lit(name))
    return s


def _has(reports: DataFrame, column: str, *path: str) -> bool:
    """Whether a column has a field inside its arrays of structs."""
    kind = reports.schema[column].dataType if column in reports.columns else None
    for name in path:
        kind = kind.elementType if hasattr(kind, "elementType") else kind
        kind = kind[name].dataType if name in kind.fieldNames() else None
        if kind is None:
            return False
    return kind is not None


def report_xml(reports: DataFrame) -> DataFrame:
    """(kind, name, xml) from (name, kind, frames array<struct<function, points array<struct<file, line, text>>>>).

    Points may have ``values``, array<struct<name, value>>, and reports ``traits``, array<string>.
    """
    def value(v: Column) -> Column:
        return F.concat(F.lit("<value><name>"), xml_escape(v["name"]), F.lit("</name><is>"), xml_escape(v["value"].cast("string")), F.lit("</is></value>"))

    def point(p: Column) -> Column:
        values = F.array_join(F.transform(p["values"], value), "") if _has(reports, "frames", "points", "values") else F.lit("")
        return F.concat(F.lit("<point><file>"), xml_escape(p["file"]), F.lit("</file><line>"), p["line"].cast("string"), F.lit("</line><text>"), xml_escape(p["text"]), F.lit("</text>"), F.coalesce(values, F.lit("")), F.lit("</point>"))

    frame = lambda f: F.concat(F.lit("<frame><function>"), xml_escape(f["function"]), F.lit("</function>"), F.array_join(F.transform(f["points"], point), ""), F.lit("</frame>"))
    body = F.array_join(F.transform("frames", frame), "")
    traits = F.coalesce(F.array_join(F.transform("traits", lambda t: F.concat(F.lit("<trait>"), xml_escape(t), F.lit("</trait>"))), ""), F.lit("")) if "traits" in reports.columns else F.lit("")
    return reports.select("kind", "name", F.concat(F.lit("<path><name>"), xml_escape(F.col("name")), F.lit("</name>"), body, traits, F.lit("</path>")).alias("xml"))


def report_pages(reports: DataFrame, previous: DataFrame | None = None, date: str = "") -> DataFrame:
    """(name, page, html): a page per report (name, file, kind, frames as of report_xml, traits) with the steps of its path, values and
    traits, links to the reports before and after it, and a mark where the previous run (name) lacks it."""
    from factloom.functions.scalars import report_file, report_printable
    from factloom.operators.reporting import index_neighbours

    link = lambda name, text: F.when(name.isNotNull(), F.concat(F.lit('<a href="'), report_file(name), F.lit(f'.html">{text}</a> '))).otherwise("")
    item = lambda p: F.concat(F.lit("<li>"), xml_escape(F.concat_ws(":", p["file"], p["line"].cast("string"))), F.lit(" "), xml_escape(p["text"]), _listed(p) if _has(reports, "frames", "points", "values") else F.lit(""), F.lit("</li>"))
    frame = lambda f: F.concat(F.lit("<h3>"), xml_escape(f["function"]), F.lit("</h3><ol>"), F.array_join(F.transform(f["points"], item), ""), F.lit("</ol>"))
    traits = F.concat(F.lit("<p>"), xml_escape(F.array_join("traits", ", ")), F.lit("</p>")) if "traits" in reports.columns else F.lit("")
    rows = reports.join(index_neighbours(reports), "name")
    if previous is not None:
        rows = rows.join(previous.select("name").distinct().withColumn("_old", F.lit(True)), "name", "left")
    new = F.when(F.col("_old").isNull(), " (new)").otherwise("") if previous is not None else F.lit("")
    head = F.concat(F.lit("<h2>"), xml_escape(report_printable(F.col("name"))), new, F.lit("</h2><p>"), F.lit(date), F.lit(" "), link(F.col("previous"), "previous"), link(F.col("next"), "next"), F.lit("</p>"))
    return rows.select("name", report_file(F.col("name")).alias("page"), F.concat(head, F.array_join(F.transform("frames", frame), ""), F.coalesce(traits, F.lit(""))).alias("html"))


def _listed(p: Column) -> Column:
    pairs = F.transform(p["values"], lambda v: F.concat_ws(" = ", xml_escape(v["name"]), xml_escape(v["value"].cast("string"))))
    return F.coalesce(F.concat(F.lit(" <i>"), F.array_join(pairs, ", "), F.lit("</i>")), F.lit(""))


def store_reports(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per kind of report."""
    report_xml(reports).write.mode(mode).partitionBy("kind").parquet(path)


def index_pages(reports: DataFrame) -> DataFrame:
    """(directory, html): a page per directory with its entries, how many reports each holds, and links; reports (file, name)."""
    from factloom.operators.reporting import ancestors

    above = reports.select(F.explode(ancestors(F.col("file"), itself=True)).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    parent = F.regexp_replace("node", "/?[^/]*$", "")
    item = F.concat(F.lit('<li><a href="'), xml_escape(F.col("node")), F.lit('">'), xml_escape(F.regexp_replace("node", "^.*/", "")), F.lit("</a> "), F.col("n").cast("string"), F.lit("</li>"))
    entries = above.select(parent.alias("directory"), F.struct("node", item.alias("item")).alias("e"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["item"]), "")
    return entries.groupBy("directory").agg(F.concat(F.lit("<ul>"), listed, F.lit("</ul>")).alias("html"))


def source_pages(points: DataFrame, files: DataFrame) -> DataFrame:
    """(name, file, html): the lines of each file that a report's path visits, the visited ones marked.

    points (name, file, line), files (file, text).
    """
    marked = points.groupBy("name", "file").agg(F.collect_set(F.col("line").cast("int")).alias("marks"))
    lines = F.transform(F.split(F.col("text"), "\n"), lambda x, i: F.when(F.array_contains("marks", i + 1), F.concat(F.lit("<b>"), xml_escape(x), F.lit("</b>"))).otherwise(xml_escape(x)))
    return marked.join(files, "file").select("name", "file", F.concat(F.lit("<pre>"), F.array_join(lines, "\n"), F.lit("</pre>")).alias("html"))
