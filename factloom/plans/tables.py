"""The fixtures that queries make from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes: key user, seq event, value event type."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))


KV = "kv AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, event_type AS value FROM events)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to look up, of which some are missing."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))


ASKED = "asked AS (SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer)"


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive parts of an order, as calls."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).filter("dst IS NOT NULL").distinct()


EDGES = f"""edges AS (SELECT DISTINCT src, dst FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS dst
  FROM lineitem) WHERE dst IS NOT NULL)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))


#: Line items as points of a function per order: a point is 1000 * order + place, an order has n points.
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, first, place, n, part, flag) of every line item."""
    order = Window.partitionBy("l_orderkey")
    base = F.col("l_orderkey") * 1000
    place = F.row_number().over(order.orderBy(*LINE_ORDER))
    lines = table(spark, sf_dir, "lineitem").select(base.alias("first"), place.alias("place"), F.count("*").over(order).alias("n"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))
    return lines.select((F.col("first") + F.col("place")).alias("node"), (F.col("first") + 1).alias("first"), "place", "n", "part", "flag")


POINTS = f"""points AS (SELECT l_orderkey * 1000 + place AS node, l_orderkey * 1000 + 1 AS first, place, n, part, flag FROM (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS place, count(*) OVER (PARTITION BY l_orderkey) AS n,
  l_partkey AS part, l_returnflag AS flag FROM lineitem))"""


def steps(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> DataFrame:
    """Edges to the next point, and from points with flag A to the one after it; no cycles."""
    p = points(spark, sf_dir) if p is None else p
    onward = F.when(F.col("flag") == "A", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return p.select("node", "place", "n", F.explode(onward).alias("by")).filter("place + by <= n").select(F.col("node").alias("src"), (F.col("node") + F.col("by")).alias("dst"))


STEPS = f"""{POINTS}, edges AS (SELECT node AS src, node + b AS dst FROM points, (VALUES (1), (2)) AS v(b) WHERE place + b <= n AND (b = 1 OR flag = 'A'))"""


def written_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points() as a written table: the windows over orders run once for all that a query makes of them."""
    return materialize(points(spark, sf_dir), "points", count=True, narrow=True)


def flow(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> DataFrame:
    """Edges to the next point, and jumps from points with flag R to a point that their part picks; with cycles.

    A point's edges are made in its row, so that equal ones are told there.
    """
    p = points(spark, sf_dir) if p is None else p
    none = F.array().cast("array<bigint>")
    onward = F.when(F.col("place") < F.col("n"), F.array(F.col("node") + 1)).otherwise(none)
    jump = F.when(F.col("flag") == "R", F.array(F.col("first") + F.pmod("part", "n"))).otherwise(none)
    ways = F.array_distinct(F.concat(onward, jump))
    return p.select(F.col("node").alias("src"), F.explode(ways).alias("dst"))


FLOW = f"""{POINTS}, edges AS (SELECT node AS src, node + 1 AS dst FROM points WHERE place < n UNION SELECT node, first + part % n FROM points WHERE flag = 'R')"""


def entry_and_head(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The first point of every function, and the second as the head of its loop."""
    p = points(spark, sf_dir) if p is None else p
    return p.filter("place = 1").select("node"), p.filter("place = 2").select("node")


ENTRY = f"""{FLOW}, entry AS (SELECT node FROM points WHERE place = 1), head AS (SELECT node FROM points WHERE place = 2)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over documents: some have another key in each run, and the second has changed texts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "text", "lang", "source", "n_chars")
    renamed = lambda cond, prefix: F.when(cond, F.concat(F.lit(prefix), "key")).otherwise(F.col("key")).alias("key")
    old = docs.select(renamed(F.col("lang") == "es", "old"), "text", (F.col("n_chars") % 3).alias("version"))
    new = docs.select(renamed(F.col("source") == "src1", "new"), F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return old, new


SNAPSHOTS = """old AS (SELECT CASE WHEN lang = 'es' THEN 'old' ELSE '' END || doc_id AS key, text, n_chars % 3 AS version FROM documents),
new AS (SELECT CASE WHEN source = 'src1' THEN 'new' ELSE '' END || doc_id AS key, CASE WHEN lang = 'fr' THEN text || '!' ELSE text END AS text FROM documents)"""


def analysis_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each event, in a log per user."""
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    line = F.when(kind == "error", F.concat(F.lit("worker terminated with code "), n)).when(kind == "purchase", F.concat(F.lit("Assertion failed at "), n)).when(kind == "signup", F.lit("Timeout: solver")).when(kind == "click", F.lit("Conflict: solver")).otherwise(F.concat(F.lit("view "), n))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), line.alias("line"))


LOG = """log AS (SELECT user_id AS log, event_id AS line_no, CASE event_type WHEN 'error' THEN 'worker terminated with code ' || event_id
  WHEN 'purchase' THEN 'Assertion failed at ' || event_id WHEN 'signup' THEN 'Timeout: solver' WHEN 'click' THEN 'Conflict: solver'
  ELSE 'view ' || event_id END AS line FROM events)"""


def finished_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished lines, one per part, with files in folders by brand and size."""
    p = table(spark, sf_dir, "part")
    n = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("Finished: 'f"), n("p_partkey"), F.lit("' FILE src/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("/d"), (F.col("p_size") % 7).cast("string"), F.lit("/f"), (F.col("p_partkey") % 20).cast("string"), F.lit(".c REDUNDANT "), (F.col("p_partkey") % 5).cast("string"), F.lit(" ASSERTION "), n("p_size"), F.lit(" SUCCESS "), F.floor(F.col("p_size") / 2).cast("string"), F.lit(" REPORT "), (F.col("p_size") % 3).cast("string"))
    return p.select(F.lit(0).cast("long").alias("log"), F.col("p_partkey").alias("line_no"), line.alias("line"))


FINISHED = """fin AS (SELECT 'f' || p_partkey AS function, 'src/' || replace(p_brand, '#', '_') || '/d' || (p_size % 7) || '/f' || (p_partkey % 20) || '.c' AS file,
  p_partkey % 5 AS redundant, p_size AS assertion, p_size // 2 AS success, p_size % 3 AS report FROM part)"""


def path_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, name, printable) of reports, from pages' URLs."""
    file = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(file.alias("file"), F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("name"), F.concat(F.lit("p"), (F.col("page_id") % 3).cast("string")).alias("printable"))


REPORTS = """reports AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS file, 'r' || page_id AS name, 'p' || (page_id % 3) AS printable FROM pages)"""


def doc_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(report, trait): language, source and size class of documents."""
    d = table(spark, sf_dir, "documents")
    traits = F.array(F.concat(F.lit("Field "), "lang"), F.concat(F.lit("Block "), "source"), F.concat(F.lit("Size "), F.floor(F.col("n_chars") / 1000).cast("string")))
    return d.select(F.col("doc_id").alias("report"), F.explode(traits).alias("trait"))


TRAITS = """traits AS (SELECT doc_id AS report, unnest(['Field ' || lang, 'Block ' || source, 'Size ' || (n_chars // 1000)]) AS trait FROM documents)"""
