"""URL filtering against dated lists by a temporal join.

A list is a log of entries (key, action, since): from that day on the key is blocked, allowed or, with action ``remove``,
no longer listed. An entry is valid from its day until the next entry of its key; these intervals are joined as of each
capture's day. A key is a domain (it covers its subdomains) or a host and first path segment (``host/segment``). Of the
entries active at fetch time the longest key decides. Hosts are compared in lower case and without trailing dots, segments
as they are; an IP address, of version 4 or 6 (in brackets), has no parents.

A verdict depends only on host, first segment and day, so captures are first reduced to these triples; only they meet the
intervals, on (key, span of ``SPAN_DAYS`` days) so that neither a busy host nor a key with a long history makes a large
group. Intervals are cut to the captures' own first and last day, so an open entry makes as many spans as the captures
cover and no more. The verdicts go back to the captures by an equi-join in which a busy host can be split. Nothing is
broadcast by hand but that one row of two days.

Nulls and odd input: a capture with no host or no day has verdict ``none``. Entries with a null key, action or day are
ignored. Of several entries of a key on a day the strictest holds (block, then allow, then remove). Repeated captures
each get their row. A host over 253 characters is no domain name and matches by itself only. Empty lists give ``none``
everywhere, and empty captures an empty result. Other columns of the captures are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_DAYS = 64
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#@]*\]|[^/:?#@\[\]]+)"
ADDRESS = r"^(?:[0-9.]+|\[.*\])$"
SEGMENT = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))


def segment_of(url: Column) -> Column:
    return F.regexp_extract(url, SEGMENT, 1)


def _span(day: Column) -> Column:
    return F.floor(F.unix_date(day) / F.lit(SPAN_DAYS)).cast("int")


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, till): till is the day of the key's next entry, and null for the last."""
    rank = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).when(F.col("action") == "remove", 0)
    host = F.substring_index("key", "/", 1)  # a segment's case counts
    key = F.concat(F.rtrim(F.lower(host), F.lit(".")), F.substr("key", F.length(host) + 1))
    known = entries.select(key.alias("key"), rank.alias("rank"), F.col("since").cast("date").alias("since")).dropna()
    daily = known.groupBy("key", "since").agg(F.max("rank").alias("rank"))
    ends = F.lead("since").over(Window.partitionBy("key").orderBy("since"))
    dated = daily.withColumn("till", ends).filter("rank > 0")
    return dated.select("key", F.when(F.col("rank") == 2, "block").otherwise("allow").alias("action"), "since", "till")


def keys_of(host: Column, segment: Column) -> Column:
    """Every key that covers a host and first segment: the domain and its parents of two labels or more, and host/segment."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat_ws(".", F.slice(labels, i, n)))
    domains = F.when((F.length(host) <= 253) & ~host.rlike(ADDRESS), parents).otherwise(F.array(host))
    return F.array_distinct(F.concat(domains, F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))))


def filter_urls(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """A row per capture: id, host, day, verdict (block, allow, none), and the deciding key with the day of its entry."""
    seen = captures.select(F.col(id_col).alias("id"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.coalesce(segment_of(F.col(url_col)), F.lit("")).alias("segment"), F.col(day_col).cast("date").alias("day"))
    triples = seen.filter((F.col("host") != "") & F.col("day").isNotNull()).select("host", "segment", "day").distinct()
    asked = triples.withColumn("key", F.explode(keys_of(F.col("host"), F.col("segment")))).withColumn("span", _span(F.col("day")))
    valid = intervals(entries)
    seen_days = triples.agg(F.min("day").alias("earliest"), F.max("day").alias("latest"))  # one row
    valid = valid.join(F.broadcast(seen_days)).filter("since <= latest AND (till IS NULL OR till > earliest)")
    first, last = F.greatest("since", "earliest"), F.least(F.date_sub("till", 1), F.col("latest"))  # least skips nulls
    valid = valid.withColumn("span", F.explode(F.sequence(_span(first), _span(last)))).drop("earliest", "latest")
    met = asked.join(valid, ["key", "span"]).filter("since <= day AND (till IS NULL OR day < till)")
    best = F.max(F.struct(F.length("key").alias("n"), "key", "action", "since")).alias("best")
    verdicts = met.groupBy("host", "segment", "day").agg(best)
    decided = seen.join(verdicts, ["host", "segment", "day"], "left")
    return decided.select(F.col("id").alias(id_col), "host", F.col("day").alias(day_col), F.coalesce("best.action", F.lit("none")).alias("verdict"), F.col("best.key").alias("key"), F.col("best.since").alias("since"))


# --- the query: the tables hold neither fetch times nor lists, so both follow from ids and names by fixed rules


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def captures_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.pmod(F.col("page_id"), F.lit(365)) * 37, F.lit(365)).cast("int")).alias("fetched_on"))


def dated_list(pages: DataFrame) -> DataFrame:
    """Four dated entries for each host, its parent domain and each of its first segments."""
    host, segment = host_of(F.col("url")), segment_of(F.col("url"))
    names = pages.select(F.explode(F.array(host, F.regexp_replace(host, "^[^.]*\\.", ""), F.when(segment != "", F.concat(host, F.lit("/"), segment)))).alias("key"))
    names = names.filter("key <> ''").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    n = _number(F.concat("key", F.lit("#"), F.col("i").cast("string")))
    action = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("remove")), (F.pmod(n, F.lit(3)) + 1).cast("int"))
    return names.select("key", action.alias("action"), F.date_add(F.lit("2023-11-01").cast("date"), F.pmod(F.floor(n / 3), F.lit(425)).cast("int")).alias("since"))


def op5_url_lists(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = filter_urls(captures_of(pages), dated_list(pages))
    return found.withColumns({c: F.col(c).cast("string") for c in ("fetched_on", "since")})


ORACLE = f"""
WITH c AS (
  SELECT page_id, coalesce(rtrim(lower(regexp_extract(url, '{HOST}', 1)), '.'), '') AS host,
    coalesce(regexp_extract(url, '{SEGMENT}', 1), '') AS segment,
    CAST(DATE '2024-01-01' + CAST((((page_id % 365) + 365) % 365 * 37) % 365 AS INT) AS DATE) AS fetched_on
  FROM pages),
names AS (
  SELECT DISTINCT key FROM (
    SELECT host AS key FROM c UNION ALL SELECT regexp_replace(host, '^[^.]*\\.', '') FROM c
    UNION ALL SELECT host || '/' || segment FROM c WHERE segment <> '') WHERE key <> ''),
numbered AS (
  SELECT key, CAST('0x' || substr(md5(key || '#' || i), 1, 6) AS BIGINT) AS n FROM names, range(4) AS t(i)),
entries AS (
  SELECT key, 2 - n % 3 AS rank, CAST(DATE '2023-11-01' + CAST((n // 3) % 425 AS INT) AS DATE) AS since FROM numbered),
daily AS (SELECT key, since, max(rank) AS rank FROM entries GROUP BY ALL),
valid AS (
  SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since) AS till FROM daily),
met AS (
  SELECT c.host, c.segment, c.fetched_on, v.key, v.rank, v.since,
    row_number() OVER (PARTITION BY c.host, c.segment, c.fetched_on ORDER BY length(v.key) DESC, v.key DESC) AS place
  FROM (SELECT DISTINCT host, segment, fetched_on FROM c WHERE host <> '') AS c
  JOIN valid AS v ON v.rank > 0 AND v.since <= c.fetched_on AND (v.till IS NULL OR c.fetched_on < v.till)
    AND (v.key = c.host OR (contains(v.key, '.') AND ends_with(c.host, '.' || v.key) AND NOT regexp_matches(c.host, '{ADDRESS}')) OR v.key = c.host || '/' || c.segment))
SELECT c.page_id, c.host, CAST(c.fetched_on AS VARCHAR) AS fetched_on, CASE m.rank WHEN 2 THEN 'block' WHEN 1 THEN 'allow' ELSE 'none' END AS verdict,
  m.key, CAST(m.since AS VARCHAR) AS since
FROM c LEFT JOIN met AS m ON m.place = 1 AND m.host = c.host AND m.segment = c.segment AND m.fetched_on = c.fetched_on
"""
