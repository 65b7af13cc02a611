"""Queries over the driver's tables, one or more for each operator, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import callgraph, cfg, diff, escape, graph, guards, library, multimap, reporting, store, symbolic
from factloom.plans import transaction
from factloom.plans.tables import ASKED, EDGES, ENTRY, FINISHED, FLOW, KV, LOG, REPORTS, SNAPSHOTS, STEPS, TRAITS, analysis_log, asked, doc_traits, entry_and_head, finished_log, flow, kv_log, part_edges, path_reports, snapshots, steps, table, written_points
from factloom.session import materialize

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- keyed store


@query(f"WITH {KV}, {ASKED}, last AS (SELECT key, arg_max(value, seq) AS value FROM kv GROUP BY key) SELECT a.key, coalesce(value, '') AS value FROM asked AS a LEFT JOIN last USING (key)")
def kv_lookup(spark, sf_dir: str) -> DataFrame:
    return store.lookup(store.replace(kv_log(spark, sf_dir)), asked(spark, sf_dir))


@query(f"WITH {KV}, {ASKED} SELECT a.key, a.key IN (SELECT key FROM kv) AS found FROM asked AS a")
def kv_has_key(spark, sf_dir: str) -> DataFrame:
    return store.has_key(kv_log(spark, sf_dir), asked(spark, sf_dir))


@query(f"WITH {KV} SELECT key, min(seq) AS seq FROM kv GROUP BY key")
def kv_all_keys(spark, sf_dir: str) -> DataFrame:
    return store.all_keys(kv_log(spark, sf_dir))


@query(f"WITH {KV} SELECT key, arg_max(value, seq) AS value FROM kv GROUP BY key")
def kv_replace_last_wins(spark, sf_dir: str) -> DataFrame:
    return store.replace(kv_log(spark, sf_dir))


@query(f"WITH {KV} SELECT key, string_agg(value, '' ORDER BY seq) AS value FROM kv GROUP BY key")
def kv_append_concat(spark, sf_dir: str) -> DataFrame:
    return store.append(kv_log(spark, sf_dir))


@query(f"""WITH {KV}, old AS (SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM kv WHERE value = 'signup' GROUP BY key),
new AS (SELECT key, min(seq) AS seq, arg_min(value, seq) AS value FROM kv WHERE value <> 'signup' GROUP BY key)
SELECT key, seq, value FROM old UNION ALL SELECT key, seq, value FROM new WHERE key NOT IN (SELECT key FROM old)""")
def kv_add_if_absent(spark, sf_dir: str) -> DataFrame:
    log = kv_log(spark, sf_dir)
    old = log.filter("value = 'signup'").groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
    return store.add(old, log.filter("value <> 'signup'"))


@query(f"WITH {KV} SELECT key, seq, value FROM kv WHERE false")
def kv_clear(spark, sf_dir: str) -> DataFrame:
    return store.clear(kv_log(spark, sf_dir))


@query(f"WITH {KV}, s AS (SELECT key, arg_max(value, seq) AS value FROM kv GROUP BY key) SELECT count(*) AS n_keys, CAST(sum(strlen(key)) AS BIGINT) AS key_bytes, CAST(sum(strlen(value)) AS BIGINT) AS value_bytes FROM s")
def kv_stats(spark, sf_dir: str) -> DataFrame:
    return store.stats(store.replace(kv_log(spark, sf_dir)))


# --- named multimaps

MM = f"{KV}, mm AS (SELECT key, value, min(seq) AS seq FROM kv GROUP BY key, value)"


@query(f"WITH {MM} SELECT key, value, seq FROM mm")
def hash_insert_value(spark, sf_dir: str) -> DataFrame:
    return multimap.entries(kv_log(spark, sf_dir))


@query(f"WITH {KV} SELECT DISTINCT key FROM kv")
def hash_insert_key(spark, sf_dir: str) -> DataFrame:
    return multimap.keys(kv_log(spark, sf_dir).withColumn("value", F.lit(None).cast("string")))


@query(f"""WITH {MM} SELECT k.key, k.seq, k.value, (min(m.seq) FILTER (m.value = k.value)) < max(k.seq) AS existed, count(*) AS n_values,
string_agg(m.value, ',' ORDER BY m.seq) AS all_values FROM kv AS k JOIN mm AS m ON m.key = k.key AND m.seq <= k.seq GROUP BY k.key, k.seq, k.value""")
def hash_insert_check(spark, sf_dir: str) -> DataFrame:
    return multimap.insert_check(kv_log(spark, sf_dir))


@query(f"""WITH {MM}, {ASKED} SELECT a.key, count(m.key) AS n_values, coalesce(string_agg(m.value, ',' ORDER BY m.seq), '') AS all_values
FROM asked AS a LEFT JOIN mm AS m USING (key) GROUP BY a.key""")
def hash_lookup(spark, sf_dir: str) -> DataFrame:
    return multimap.lookup(kv_log(spark, sf_dir), asked(spark, sf_dir))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS value FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def hash_lookup_single(spark, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("key"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_returnflag").alias("value"))
    return multimap.lookup_single(log, table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key")))


@query(f"WITH {KV}, {ASKED} SELECT key, key IN (SELECT key FROM kv) AS is_member FROM asked")
def hash_is_member(spark, sf_dir: str) -> DataFrame:
    return multimap.is_member(kv_log(spark, sf_dir), asked(spark, sf_dir))


@query(f"WITH {KV} SELECT key, seq, value FROM kv WHERE key NOT IN (SELECT key FROM kv WHERE value = 'error')")
def hash_remove(spark, sf_dir: str) -> DataFrame:
    log = kv_log(spark, sf_dir)
    return multimap.remove(log, log.filter("value = 'error'").select("key").distinct())


@query(f"WITH {KV} SELECT DISTINCT key FROM kv")
def hash_all_keys(spark, sf_dir: str) -> DataFrame:
    return multimap.keys(kv_log(spark, sf_dir))


@query(f"WITH {KV} SELECT coalesce(min(key), '') AS key FROM kv")
def hash_choose_key(spark, sf_dir: str) -> DataFrame:
    return multimap.choose_key(kv_log(spark, sf_dir))


@query("SELECT false AS before_read, true AS after_read, true AS is_empty, false AS after_insert, false AS by_all_keys")
def hash_exists_and_empty(spark, sf_dir: str) -> DataFrame:
    maps = multimap.Registry(spark)
    before = maps.exists("h")
    empty = maps.is_empty("h")
    after = maps.exists("h")
    maps.insert("h", kv_log(spark, sf_dir))
    filled = maps.is_empty("h")
    maps.all_keys("other")
    return spark.createDataFrame([(before, after, empty, filled, maps.exists("other"))], "before_read boolean, after_read boolean, is_empty boolean, after_insert boolean, by_all_keys boolean")


@query("SELECT event_type AS key, CAST(sum(CASE WHEN value >= 0 THEN 1 ELSE -1 END) AS BIGINT) AS value FROM events GROUP BY event_type")
def counter_value(spark, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.when(F.col("value") >= 0, 1).otherwise(-1).alias("delta"))
    return multimap.counter_values(log)


# --- scalars


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber < l_quantity AS less, l_linenumber <= l_quantity AS less_equal, l_linenumber = l_quantity AS equal FROM lineitem")
def value_compare(spark, sf_dir: str) -> DataFrame:
    a, b = F.col("l_linenumber"), F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.value_less(a, b).alias("less"), S.value_less_equal(a, b).alias("less_equal"), S.value_equal(a, b).alias("equal"))


@query("SELECT page_id, length(regexp_extract(url, '#(.*)$', 1)) = 0 AS is_empty, strpos(url, chr(0)) = 0 AS is_valid FROM pages")
def string_is_empty(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.string_is_empty(F.regexp_extract("url", "#(.*)$", 1)).alias("is_empty"), S.valid_string(F.col("url")).alias("is_valid"))


@query("SELECT conv_id, turn, role || ',' || turn || ',end' AS items FROM conversations")
def list_push(spark, sf_dir: str) -> DataFrame:
    items = S.list_push(S.list_create(F.col("role"), F.col("turn").cast("string")), F.lit("end"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(items, ",").alias("items"))


@query("SELECT page_id, place, part FROM (SELECT page_id, unnest(string_split(url, '/')) AS part, generate_subscripts(string_split(url, '/'), 1) - 1 AS place FROM pages)")
def split_strings(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(S.split_strings(F.col("url"), "/")).alias("place", "part")).withColumn("place", F.col("place").cast("long"))


FOLD_IN = "f AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice) AS BIGINT) - 30000 AS a, CAST(l_linenumber - 3 AS BIGINT) AS b, CAST(l_linenumber * 11 - 15 AS BIGINT) AS s FROM lineitem)"


@query(f"""WITH {FOLD_IN} SELECT l_orderkey, l_linenumber, l_partkey, -a AS neg, ~a AS inverted, a + b AS plus, a - b AS minus, a * b AS mult,
CASE WHEN b = 0 THEN 0 ELSE CAST(floor(a / CAST(b AS DOUBLE)) AS BIGINT) END AS quotient, CASE WHEN b > 0 THEN ((a % b) + b) % b ELSE 0 END AS remainder,
CASE WHEN s BETWEEN 0 AND 64 THEN CAST(CAST(a AS HUGEINT) * (CAST(1 AS HUGEINT) << CAST(s AS INT)) AS VARCHAR) ELSE '0' END AS shifted_left,
CASE WHEN s BETWEEN 0 AND 64 THEN CAST(CAST(a AS HUGEINT) // (CAST(1 AS HUGEINT) << CAST(s AS INT)) AS BIGINT) ELSE 0 END AS shifted_right,
a & b AS bit_and, a | b AS bit_or, xor(a, b) AS bit_xor, least(a, b) AS least, greatest(a, b) AS most FROM f""")
def const_fold(spark, sf_dir: str) -> DataFrame:
    a, b, s = F.floor("l_extendedprice") - 30000, (F.col("l_linenumber") - 3).cast("long"), (F.col("l_linenumber") * 11 - 15).cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", a.alias("a"), b.alias("b"), s.alias("s"))
    a, b, s = F.col("a"), F.col("b"), F.col("s")
    names = {"plus": "plus", "minus": "minus", "mult": "mult", "quotient": "div", "remainder": "mod", "bit_and": "and", "bit_or": "or", "bit_xor": "xor", "least": "min", "most": "max"}
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", S.fold_unop("neg", a).alias("neg"), S.fold_unop("bitwise_not", a).alias("inverted"), *(S.fold_binop(k, a, b).cast("long").alias(n) for n, k in names.items()), S.fold_binop("shift_left", a, s).cast("string").alias("shifted_left"), S.fold_binop("shift_right", a, s).cast("long").alias("shifted_right"))


@query("SELECT o_orderkey, CAST(((w + 128) % 256 + 256) % 256 - 128 AS BIGINT) AS int8, CAST(w % 65536 AS BIGINT) AS uint16 FROM (SELECT o_orderkey, o_orderkey * 977 AS w FROM orders)")
def wrap_integer(spark, sf_dir: str) -> DataFrame:
    w = F.col("o_orderkey") * 977
    return table(spark, sf_dir, "orders").select("o_orderkey", S.wrap_integer(w, 8, True).cast("long").alias("int8"), S.wrap_integer(w, 16, False).cast("long").alias("uint16"))


@query("SELECT p_partkey, 'src/' || p_size || '/f.c' AS file FROM part")
def normalize_file(spark, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("/base/src/./"), F.col("p_brand"), F.lit("/../"), F.col("p_size").cast("string"), F.lit("//f.c"))
    return table(spark, sf_dir, "part").select("p_partkey", S.normalize_file(raw, "/base/").alias("file"))


NAMES = """names AS (SELECT p_partkey, (CASE p_size % 8 WHEN 0 THEN 'kind$a.c$foo' || p_partkey || '(int, char*)$loop$0' WHEN 1 THEN 'k$src/a.c$static int fn' || p_partkey || '(struct x *)$loop$1'
  WHEN 2 THEN 'k$a.cc$void* operator new' || p_partkey || '(unsigned)$x$' || p_size WHEN 3 THEN 'k$a.c$a.c:foo' || p_partkey || '$func$0' WHEN 4 THEN 'k$a$virtual const List<a b> ns::fn' || p_partkey || '(!x)(int)$l$2'
  WHEN 5 THEN 'k$' || p_name || '$static virtual T f' || p_partkey || '(' WHEN 6 THEN 'kind$file' || p_partkey ELSE 'k$a.c$const struct s *a::b' || p_partkey || 'é(T (*)(int))$func$1' END) AS name FROM part)"""


def _names(spark, sf_dir: str) -> DataFrame:
    key, put = F.col("p_partkey").cast("string"), lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    forms = (
        put("kind$a.c$foo", key, "(int, char*)$loop$0"), put("k$src/a.c$static int fn", key, "(struct x *)$loop$1"), put("k$a.cc$void* operator new", key, "(unsigned)$x$", F.col("p_size").cast("string")), put("k$a.c$a.c:foo", key, "$func$0"),
        put("k$a$virtual const List<a b> ns::fn", key, "(!x)(int)$l$2"), put("k$", F.col("p_name"), "$static virtual T f", key, "("), put("kind$file", key), put("k$a.c$const struct s *a::b", key, "é(T (*)(int))$func$1"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*forms), (F.col("p_size") % 8 + 1).cast("int")).alias("name"))


@query(f"WITH {NAMES} SELECT p_partkey, CASE WHEN len(string_split(name, '$')) >= 4 THEN string_split(name, '$')[3] END AS function FROM names")
def assert_function(spark, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", S.assert_function(F.col("name")).alias("function"))


# DuckDB's regexp_replace replaces the first match alone.
PRINTABLE = "name"
for _pattern, _rest in ((r"^[^$]*\\$[^$]*\\$", ""), (r"\\$.*$", ""), (r"\\([^!].*$", ""), ("^static ", ""), ("^virtual ", ""), ("^const ", ""), ("[^ <]* ", ""), (r"^[^:(]*:([^:])", r"\\1")):
    PRINTABLE = f"regexp_replace({PRINTABLE}, '{_pattern}', '{_rest}')".replace("\\\\", "\\")
PRINTABLE = f"""{NAMES}, bytes AS (SELECT p_partkey, name, list_transform(range(0, octet_length(encode(name))), lambda i: CAST(CAST('0x' || substr(hex(encode(name)), CAST(2 * i + 1 AS INT), 2) AS INT) AS HUGEINT)) AS codes FROM names),
hashed AS (SELECT p_partkey, name, list_reduce(list_prepend(CAST(0 AS HUGEINT), codes), lambda h, c: (h * 31 + c) % 18446744073709551616) AS h FROM bytes),
printed AS (SELECT p_partkey, {PRINTABLE} AS printable, CAST(CASE WHEN h >= 9223372036854775808 THEN 18446744073709551616 - h ELSE h END AS VARCHAR) AS hash FROM hashed)"""


@query(f"WITH {PRINTABLE} SELECT p_partkey, printable, hash, regexp_replace(printable, '[^a-zA-Z0-9]', '_', 'g') || '_' || hash AS file FROM printed")
def report_printable(spark, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return _names(spark, sf_dir).select("p_partkey", S.report_printable(name).alias("printable"), S.string_hash(name).cast("string").alias("hash"), S.report_file(name).alias("file"))


@query("SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped, true AS same FROM pages")
def html_escape(spark, sf_dir: str) -> DataFrame:
    escaped = S.html_escape(F.col("html"))
    plain = F.replace("html", F.lit("&quot;"), F.lit("''"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(escaped, 256).alias("escaped"), (S.html_unescape(S.html_escape(plain)) == plain).alias("same"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'func:s' || l_suppkey WHEN 'N' THEN 'glob:s' || l_suppkey ELSE 'comp:s' || l_suppkey || ':f' || l_linenumber END AS trace FROM lineitem")
def trace_key(spark, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "func").when(F.col("l_returnflag") == "N", "glob").otherwise("comp")
    n = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.trace_key(kind, n("s", "l_suppkey"), n("f", "l_linenumber")).alias("trace"))


@query("SELECT p_partkey, true AS static_name, true AS call_name, false AS longer, true AS scoped FROM part")
def text_name_match(spark, sf_dir: str) -> DataFrame:
    fn = F.concat(F.lit("fn"), F.col("p_partkey").cast("string"))
    put = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    return table(spark, sf_dir, "part").select("p_partkey", S.text_name_match(put("a.c:", fn), fn).alias("static_name"), S.text_name_match(put(fn, "(int)"), fn).alias("call_name"), S.text_name_match(put(fn, "x"), fn).alias("longer"), S.text_name_match(put("ns::", fn, "()"), put("ns::", fn)).alias("scoped"))


@query("SELECT p_partkey, length(p) - length(replace(p, '/', '')) AS nesting FROM (SELECT p_partkey, 'a/b' || repeat('/c', p_size % 5) AS p FROM part)")
def directory_nesting(spark, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("a/b"), F.expr("repeat('/c', p_size % 5)"))
    return table(spark, sf_dir, "part").select("p_partkey", S.directory_nesting(path).cast("long").alias("nesting"))


@query("SELECT p_partkey, p_partkey AS decimal, p_partkey AS hex, -p_size AS octal, CAST(NULL AS BIGINT) AS other FROM part")
def string_to_int(spark, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    read = lambda s, n: S.string_to_int(s).cast("long").alias(n)
    return table(spark, sf_dir, "part").select("p_partkey", read(F.concat(key.cast("string"), F.lit("UL")), "decimal"), read(F.concat(F.lit("0x"), F.hex(key)), "hex"), read(F.concat(F.lit("-0"), F.conv(size.cast("string"), 10, 8)), "octal"), read(F.concat(key.cast("string"), F.lit("z")), "other"))


# --- transactions


@query(f"WITH {KV}, {ASKED} SELECT a.key, coalesce(arg_max(value, seq), '') AS value FROM asked AS a LEFT JOIN kv USING (key) GROUP BY a.key")
def txn_pop_batch(spark, sf_dir: str) -> DataFrame:
    return transaction.pop_batch(asked(spark, sf_dir), store.replace(kv_log(spark, sf_dir)))


@query(f"WITH {KV} SELECT DISTINCT key FROM kv")
def txn_create_keys(spark, sf_dir: str) -> DataFrame:
    t = transaction.Transaction(transaction.registry(multimap.Registry(spark), multimap.Counters()))
    keys = store.all_keys(kv_log(spark, sf_dir)).withColumn("value", F.lit(None).cast("string"))
    t.run(transaction.Sequence([transaction.create_keys("todo", keys), transaction.create_keys("todo", keys), transaction.Call("hash_all_keys", ("todo",), "$keys")]))
    return t.returned()["$keys"]


@query("SELECT 1 AS runs_when_empty, 0 AS runs_when_filled, 1 AS clears_when_absent, 0 AS clears_when_present")
def txn_conditions(spark, sf_dir: str) -> DataFrame:
    counters, maps = multimap.Counters(), multimap.Registry(spark)
    t = transaction.Transaction(transaction.registry(maps, counters))
    t.run(transaction.run_if_empty("a", transaction.Call("counter_inc", ("empty",))))
    maps.insert("b", kv_log(spark, sf_dir))
    t.run(transaction.run_if_empty("b", transaction.Call("counter_inc", ("filled",))))
    t.run(transaction.clear_store_if_absent("c", transaction.Call("counter_inc", ("absent",))))
    t.run(transaction.clear_store_if_absent("b", transaction.Call("counter_inc", ("present",))))
    return spark.createDataFrame([tuple(counters.value(n) for n in ("empty", "filled", "absent", "present"))], "runs_when_empty int, runs_when_filled int, clears_when_absent int, clears_when_present int")


# --- differences and versions


@query(f"WITH {SNAPSHOTS} SELECT DISTINCT key FROM new WHERE key NOT IN (SELECT key FROM old)")
def claim_once(spark, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    return diff.claim(new, old)[0]


@query(f"WITH {SNAPSHOTS} SELECT key, sha256(text) AS digest FROM new WHERE (key, text) NOT IN (SELECT key, text FROM old)")
def run_diff(spark, sf_dir: str) -> DataFrame:
    old, new = (x.select("key", F.sha2("text", 256).alias("digest")) for x in snapshots(spark, sf_dir))
    return diff.run_diff(new, old, ["key", "digest"])


FACTS = "facts AS (SELECT l_suppkey AS source, l_partkey AS target, l_orderkey AS block, CASE WHEN l_returnflag = 'A' THEN 'initializer' ELSE 'function' END AS kind, l_linenumber AS point FROM lineitem)"


@query(f"WITH {FACTS} SELECT source, target, block, kind, min(point) AS point FROM facts GROUP BY source, target, block, kind, CASE WHEN kind = 'initializer' THEN -1 ELSE point END")
def merge_edges(spark, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "initializer").otherwise("function")
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("block"), kind.alias("kind"), F.col("l_linenumber").alias("point"))
    return diff.merge_edges(facts.filter("source <= 5"), facts.filter("source > 5 OR point < 3"))


VERSIONS = f"""{SNAPSHOTS}, versions AS (SELECT key, CASE WHEN o.key IS NULL THEN 'new' WHEN n.key IS NULL THEN 'deleted' WHEN o.text = n.text THEN 'same' ELSE 'changed' END AS state,
CASE WHEN o.key IS NULL THEN 0 WHEN n.key IS NOT NULL AND o.text = n.text THEN o.version ELSE o.version + 1 END AS version FROM old AS o FULL JOIN new AS n USING (key))"""


def _versions(spark, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    digest = F.sha2("text", 256).alias("digest")
    return diff.incremental_versions(old.select("key", "version", digest), new.select("key", digest))


@query(f"WITH {VERSIONS} SELECT key, version, state FROM versions")
def incremental_versions(spark, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir)


@query(f"WITH {VERSIONS} SELECT key, CASE WHEN state <> 'same' OR key IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'de') THEN 'new' ELSE 'old' END AS section FROM versions")
def stage_incremental(spark, sf_dir: str) -> DataFrame:
    again = table(spark, sf_dir, "documents").filter("lang = 'de'").select(F.col("doc_id").cast("string").alias("key"))
    return diff.incremental_worklist(_versions(spark, sf_dir), again)


@query(f"WITH {SNAPSHOTS} SELECT n.key AS file, coalesce(o.text <> n.text, true) AS changed FROM new AS n LEFT JOIN old AS o USING (key)")
def file_changed(spark, sf_dir: str) -> DataFrame:
    old, new = (x.select(F.col("key").alias("file"), F.col("text").alias("preprocessed")) for x in snapshots(spark, sf_dir))
    return diff.changed_files(old, new)


@query(f"WITH {SNAPSHOTS} SELECT key, sha256(text) AS digest FROM new UNION ALL SELECT key, sha256(text) FROM old WHERE key NOT IN (SELECT key FROM new)")
def annotation_merge(spark, sf_dir: str) -> DataFrame:
    old, new = (x.select("key", F.sha2("text", 256).alias("digest")) for x in snapshots(spark, sf_dir))
    return diff.override(old, new, ["key"])


@query(f"WITH {VERSIONS}, facts AS (SELECT CAST(doc_id AS VARCHAR) AS key, n_chars % 4 AS version FROM documents) SELECT f.key, f.version FROM facts AS f SEMI JOIN versions AS v USING (key, version)")
def current_facts(spark, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), (F.col("n_chars") % 4).alias("version"))
    return diff.current_only(facts, _versions(spark, sf_dir))


@query("SELECT count(*) AS n_objects, count(DISTINCT (p_brand, p_size)) AS n_interned FROM part")
def intern_objects(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_size")
    return p.agg(F.count("*").alias("n_objects")).join(diff.intern(p, ["p_brand", "p_size"]).agg(F.countDistinct("id").alias("n_interned")))


# --- graphs


def _edges_entry_head(spark, sf_dir: str):
    p = written_points(spark, sf_dir)
    return materialize(flow(spark, sf_dir, p), "edges", count=True, narrow=True), *entry_and_head(spark, sf_dir, p)


@query(f"WITH RECURSIVE {ENTRY}, r AS (SELECT node FROM entry UNION SELECT e.dst FROM r JOIN edges AS e ON e.src = r.node) SELECT node FROM r")
def reach_from_entry(spark, sf_dir: str) -> DataFrame:
    edges, entry, _ = _edges_entry_head(spark, sf_dir)
    return graph.reach(edges, entry)


DOMINATED = f"""{ENTRY}, r AS (SELECT node FROM entry UNION SELECT e.dst FROM r JOIN edges AS e ON e.src = r.node),
avoiding AS (SELECT node FROM entry WHERE node NOT IN (SELECT node FROM head) UNION SELECT e.dst FROM avoiding AS a JOIN edges AS e ON e.src = a.node WHERE e.dst NOT IN (SELECT node FROM head)),
dom AS (SELECT node FROM r WHERE node NOT IN (SELECT node FROM avoiding))"""


@query(f"WITH RECURSIVE {DOMINATED} SELECT node FROM dom")
def dominated_by(spark, sf_dir: str) -> DataFrame:
    return graph.dominated(*_edges_entry_head(spark, sf_dir))


BACK = f"""{DOMINATED}, back AS (SELECT src, dst FROM edges WHERE dst IN (SELECT node FROM head) AND src IN (SELECT node FROM dom))"""


@query(f"WITH RECURSIVE {BACK} SELECT src, dst FROM back")
def back_edges(spark, sf_dir: str) -> DataFrame:
    return graph.back_edges(*_edges_entry_head(spark, sf_dir))


@query(f"""WITH RECURSIVE {BACK}, inside AS (SELECT src AS node FROM back WHERE src NOT IN (SELECT node FROM head)
UNION SELECT e.src FROM inside AS i JOIN edges AS e ON e.dst = i.node WHERE e.src NOT IN (SELECT node FROM head))
SELECT node FROM inside WHERE node IN (SELECT node FROM r) UNION SELECT dst FROM back""")
def loop_body(spark, sf_dir: str) -> DataFrame:
    return graph.loop_body(*_edges_entry_head(spark, sf_dir))


@query(f"""WITH RECURSIVE {ENTRY}, r AS (SELECT node FROM entry UNION SELECT e.dst FROM r JOIN edges AS e ON e.src = r.node),
b AS (SELECT dst AS node FROM edges WHERE dst NOT IN (SELECT src FROM edges) UNION SELECT e.src FROM b JOIN edges AS e ON e.dst = b.node) SELECT node FROM r WHERE node IN (SELECT node FROM b)""")
def trim_unreachable(spark, sf_dir: str) -> DataFrame:
    edges, entry, _ = _edges_entry_head(spark, sf_dir)
    return graph.trim(edges, entry, edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti"))


@query(f"WITH RECURSIVE {STEPS}, l AS (SELECT node, 0 AS level FROM points WHERE place = 1 UNION SELECT e.dst, l.level + 1 FROM l JOIN edges AS e ON e.src = l.node) SELECT node, max(level) AS level FROM l GROUP BY node")
def topo_level(spark, sf_dir: str) -> DataFrame:
    p = written_points(spark, sf_dir)
    return graph.levels(steps(spark, sf_dir, p), entry_and_head(spark, sf_dir, p)[0])


def _stage_sql() -> str:
    withs = [f"{STEPS}, indirect AS (SELECT node FROM points WHERE part % 97 = 0), s0 AS (SELECT node, 0 AS stage FROM points WHERE node NOT IN (SELECT src FROM edges) AND node NOT IN (SELECT node FROM indirect))"]
    for k in range(1, 5):
        done = " UNION ALL ".join(f"SELECT node FROM s{i}" for i in range(k))
        withs.append(f"d{k} AS ({done}), s{k} AS (SELECT node, {k} AS stage FROM points WHERE node NOT IN (SELECT node FROM d{k}) AND node NOT IN (SELECT node FROM indirect) AND node NOT IN (SELECT src FROM edges WHERE dst NOT IN (SELECT node FROM d{k})))")
    every = " UNION ALL ".join(f"SELECT node, stage FROM s{i}" for i in range(5))
    return f"WITH {', '.join(withs)}, staged AS ({every}) SELECT node, coalesce(stage, -1) AS stage FROM points LEFT JOIN staged USING (node)"


@query(_stage_sql())
def stage_worklist(spark, sf_dir: str) -> DataFrame:
    """A function per line item that calls the next ones; some parts are called through pointers."""
    p = written_points(spark, sf_dir)
    return graph.stages(p.select("node"), steps(spark, sf_dir, p), p.filter("part % 97 = 0").select("node"))


@query("""SELECT conv_id, turn, (SELECT min(b.turn) FROM conversations AS b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.role <> 'user') AS target
FROM conversations AS a WHERE role = 'user' AND target IS NOT NULL""")
def skip_contract(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    point = lambda t: F.struct("conv_id", F.col(t).alias("turn"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    skips = turns.filter("role = 'user'").join(after, ["conv_id", "turn"], "left_semi").select(point("turn").alias("node"), F.struct("conv_id", (F.col("turn") + 1).alias("turn")).alias("next"))
    out = graph.follow(skips)
    ends = turns.filter("role <> 'user'").select(point("turn").alias("target"))
    return out.join(ends, "target", "left_semi").select("node.conv_id", "node.turn", F.col("target.turn").alias("target"))


@query(f"WITH {EDGES} SELECT src AS node, count(*) AS n_out, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS targets FROM edges GROUP BY src")
def outgoing_edges(spark, sf_dir: str) -> DataFrame:
    return graph.adjacency(part_edges(spark, sf_dir))


@query("WITH e AS (SELECT DISTINCT l_orderkey AS block, l_partkey || ':' || l_suppkey AS x FROM lineitem) SELECT block, sha256(string_agg(x, '|' ORDER BY x)) AS digest FROM e GROUP BY block")
def graph_fingerprint(spark, sf_dir: str) -> DataFrame:
    return graph.fingerprint(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block"), "l_partkey", "l_suppkey").distinct())


@query(f"""WITH RECURSIVE {EDGES}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
c AS (SELECT src AS node, src AS root FROM u WHERE src NOT IN (SELECT src FROM u WHERE dst < src) UNION SELECT u.dst, c.root FROM c JOIN u ON u.src = c.node) SELECT node, min(root) AS root FROM c GROUP BY node""")
def connected_parts(spark, sf_dir: str) -> DataFrame:
    return graph.components(part_edges(spark, sf_dir))


# --- calls, escapes, side effects

CALLS = f"{EDGES}, calls AS (SELECT src AS caller, dst AS callee FROM edges)"


def _calls(spark, sf_dir: str) -> DataFrame:
    return part_edges(spark, sf_dir).select(F.col("src").alias("caller"), F.col("dst").alias("callee"))


@query("SELECT DISTINCT l_suppkey AS caller, l_partkey AS callee FROM lineitem WHERE l_returnflag = 'A'")
def call_edges(spark, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"), F.when(F.col("l_returnflag") == "A", "direct").otherwise("indirect").alias("kind"))
    return callgraph.direct_calls(calls)


@query("SELECT DISTINCT l_suppkey AS node FROM lineitem WHERE l_returnflag <> 'A'")
def indirect_callers(spark, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"), F.when(F.col("l_returnflag") == "A", "direct").otherwise("indirect").alias("kind"))
    return callgraph.has_indirect(calls)


@query("""SELECT DISTINCT s.pointer, s.arity, e.function FROM (SELECT DISTINCT l_suppkey AS pointer, l_linenumber % 4 AS arity FROM lineitem WHERE l_returnflag = 'R') AS s
JOIN (SELECT DISTINCT l_suppkey AS pointer, l_partkey AS function, p_size % 4 AS arity FROM lineitem JOIN part ON p_partkey = l_partkey) AS e USING (pointer, arity)""")
def indirect_targets_arity(spark, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    sites = lines.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("pointer"), (F.col("l_linenumber") % 4).alias("arity"))
    escapes = lines.select(F.col("l_suppkey").alias("pointer"), F.col("l_partkey").alias("function"))
    functions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("function"), (F.col("p_size") % 4).alias("arity"))
    return callgraph.indirect_targets(sites, escapes, functions)


VIRTUAL = """m AS (SELECT 'N' || c_nationkey AS class, c_mktsegment AS method, 'N' || c_nationkey || '::' || c_mktsegment AS function FROM customer WHERE c_acctbal > 9000 GROUP BY ALL
UNION ALL SELECT 'R' || n_regionkey, c_mktsegment, 'R' || n_regionkey || '::' || c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal < 0 GROUP BY ALL),
calls AS (SELECT DISTINCT 'R' || n_regionkey AS class, c_mktsegment AS method FROM customer JOIN nation ON n_nationkey = c_nationkey),
sub AS (SELECT 'R' || n_regionkey AS class, 'N' || n_nationkey AS sub, 'R' || n_regionkey AS base FROM nation UNION ALL SELECT 'R' || r_regionkey, 'R' || r_regionkey, NULL FROM region)"""


@query(f"""WITH {VIRTUAL} SELECT DISTINCT c.class, c.method, coalesce(own.function, up.function) AS function FROM calls AS c JOIN sub USING (class)
LEFT JOIN m AS own ON own.class = sub.sub AND own.method = c.method LEFT JOIN m AS up ON up.class = sub.base AND up.method = c.method WHERE coalesce(own.function, up.function) IS NOT NULL""")
def virtual_callees(spark, sf_dir: str) -> DataFrame:
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    n, r = F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))
    both = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    own = lambda c, cond: both.filter(cond).select(c.alias("class"), F.col("c_mktsegment").alias("method"), F.concat(c, F.lit("::"), "c_mktsegment").alias("function")).distinct()
    methods = own(n, "c_acctbal > 9000").unionByName(own(r, "c_acctbal < 0"))
    calls = both.select(r.alias("class"), F.col("c_mktsegment").alias("method")).distinct()
    return callgraph.virtual_targets(nation.select(n.alias("class"), r.alias("base")), methods, calls)


@query(f"WITH {CALLS} SELECT DISTINCT caller AS node FROM calls WHERE callee IN (SELECT p_partkey FROM part WHERE p_size > 45)")
def callers_to_reanalyze(spark, sf_dir: str) -> DataFrame:
    return callgraph.callers_of(_calls(spark, sf_dir), table(spark, sf_dir, "part").filter("p_size > 45").select(F.col("p_partkey").alias("node")))


@query(f"WITH RECURSIVE {FLOW}, c AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM c JOIN edges AS e ON e.src = c.dst) SELECT src, dst FROM c")
def escape_closure(spark, sf_dir: str) -> DataFrame:
    return graph.closure(flow(spark, sf_dir)).select("src", "dst")


@query(f"WITH RECURSIVE {FLOW}, c AS (SELECT src, dst, 1 AS hops FROM edges UNION SELECT c.src, e.dst, c.hops + 1 FROM c JOIN edges AS e ON e.src = c.dst WHERE c.hops < 3) SELECT src, dst, min(hops) AS hops FROM c GROUP BY src, dst")
def escape_bounded(spark, sf_dir: str) -> DataFrame:
    p = written_points(spark, sf_dir)
    return graph.bounded_closure(flow(spark, sf_dir, p), p.select("node"), depth=3)[0]


@query(f"""WITH RECURSIVE {FLOW}, moves AS (SELECT src, dst, CASE (src + dst) % 3 WHEN 0 THEN 'call' WHEN 1 THEN 'return' ELSE 'stay' END AS move, CAST((src * 7 + dst) % 5 AS VARCHAR) AS site FROM edges),
c AS (SELECT node AS source, node AS target, CAST([] AS VARCHAR[]) AS context FROM points WHERE place = 1
UNION SELECT c.source, m.dst, CASE WHEN m.move = 'call' THEN list_append(c.context, m.site)[-2:] WHEN m.move = 'return' THEN c.context[:-2] ELSE c.context END
FROM c JOIN moves AS m ON m.src = c.target WHERE m.move <> 'return' OR len(c.context) = 0 OR c.context[-1] = m.site)
SELECT source, target, array_to_string(context, '/') AS context FROM c""")
def escape_closure_context(spark, sf_dir: str) -> DataFrame:
    move = F.when(F.expr("(src + dst) % 3 = 0"), "call").when(F.expr("(src + dst) % 3 = 1"), "return").otherwise("stay")
    p = written_points(spark, sf_dir)
    edges = flow(spark, sf_dir, p).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.expr("CAST((src * 7 + dst) % 5 AS STRING)").alias("site"), move.alias("move"))
    return graph.context_closure(edges, entry_and_head(spark, sf_dir, p)[0], max_context=2)


def _point_calls(spark, sf_dir: str, p: DataFrame) -> DataFrame:
    return flow(spark, sf_dir, p).select(F.col("src").alias("caller"), F.col("dst").alias("callee"))


@query(f"WITH RECURSIVE {FLOW}, m AS (SELECT node AS function, p_brand AS lval FROM points JOIN part ON p_partkey = part UNION SELECT e.src, m.lval FROM m JOIN edges AS e ON e.dst = m.function) SELECT function, lval FROM m")
def modset_fixpoint(spark, sf_dir: str) -> DataFrame:
    """A function per line item, which writes its part's brand."""
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("lval"))
    p = written_points(spark, sf_dir)
    return callgraph.modsets(_point_calls(spark, sf_dir, p), p.join(brands, "part").select(F.col("node").alias("function"), "lval"))


@query(f"WITH RECURSIVE {FLOW}, m AS (SELECT node FROM points JOIN part ON p_partkey = part WHERE p_size = 1 UNION SELECT e.src FROM m JOIN edges AS e ON e.dst = m.node) SELECT node FROM m")
def can_gc_propagation(spark, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("part"))
    p = written_points(spark, sf_dir)
    return callgraph.can_collect(_point_calls(spark, sf_dir, p), p.join(roots, "part").select("node"))


@query("""SELECT DISTINCT l_suppkey AS caller, l_orderkey AS site, l_partkey AS callee, CASE WHEN l_returnflag = 'N' THEN 'receiver=' || l_partkey || ' => ' || p_type ELSE p_type END AS bit
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25""")
def summary_join(spark, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("caller"), F.col("l_orderkey").alias("site"), F.col("l_partkey").alias("callee"), F.when(F.col("l_returnflag") == "N", "indirect").otherwise("direct").alias("kind"))
    assumes = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("function"), F.col("p_type").alias("bit"))
    return callgraph.summary_at_calls(calls, assumes)


@query("SELECT DISTINCT l_orderkey AS site, p_brand AS owner, CAST(l_linenumber AS VARCHAR) AS field, 'inv' || i AS bit FROM lineitem JOIN part ON p_partkey = l_partkey, range(3) AS t(i) WHERE l_linenumber IN (i + 1, i + 2)")
def invariant_join(spark, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    writes = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("site"), F.col("p_brand").alias("owner"), F.col("l_linenumber").cast("string").alias("field"))
    invariants = part.select(F.col("p_brand").alias("owner")).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("owner", F.array((F.col("i") + 1).cast("string"), (F.col("i") + 2).cast("string")).alias("fields"), F.concat(F.lit("inv"), F.col("i").cast("string")).alias("bit"))
    return callgraph.invariants_at_writes(writes, invariants)


CHAINS = "ch AS (SELECT page_id, 'v' || (page_id % 7) AS base, string_split(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/$', ''), '/') AS st FROM pages)"


def _places(spark, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), "/$", "")
    chain = F.replace(F.replace(path, F.lit("."), F.lit("_")), F.lit("/"), F.lit("."))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("v"), (F.col("page_id") % 7).cast("string")).alias("base"), chain.alias("chain"))


@query(f"""WITH {CHAINS}, m AS (SELECT page_id, replace(array_to_string(list_slice(st, len(st) - i + 1, len(st)), '/'), '.', '_') AS p, i - 1 AS ordinal FROM ch, range(1, 20) AS r(i) WHERE i <= len(st))
SELECT page_id, replace(p, '/', '.') AS place, CAST(ordinal AS INT) AS ordinal FROM m UNION ALL SELECT page_id, base || '.' || replace(replace(array_to_string(st, '/'), '.', '_'), '/', '.'), CAST(len(st) AS INT) FROM ch""")
def trace_matches(spark, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).select("page_id", F.explode(escape.matches(F.col("base"), F.col("chain"))).alias("m")).select("page_id", "m.place", "m.ordinal")


@query("""SELECT 'a' || p_partkey || '.' || r_name || '.' || n_name AS source, 'b' || p_partkey || '.' || r_name || '.' || n_name AS target, 'int' AS type FROM part, region JOIN nation ON n_regionkey = r_regionkey""")
def struct_copies(spark, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    name = F.concat(F.lit("R"), F.col("r_regionkey").cast("string"))
    outer = region.select(F.lit("world").alias("type"), F.col("r_name").alias("field"), name.alias("field_type"))
    inner = nation.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("type"), F.col("n_name").alias("field"), F.lit("int").alias("field_type"))
    key = F.col("p_partkey").cast("string")
    copies = table(spark, sf_dir, "part").select(F.concat(F.lit("a"), key).alias("source"), F.concat(F.lit("b"), key).alias("target"), F.lit("world").alias("type"))
    return escape.expand_struct(copies, outer.unionByName(inner))


FLOW_IN = """e AS (SELECT l_orderkey AS site, l_returnflag AS flag, 't' || l_partkey AS target, 'v' || l_suppkey AS value, 'f' || l_suppkey AS callee, l_linenumber AS position FROM lineitem)"""


@query(f"""WITH {FLOW_IN} SELECT DISTINCT value AS source, target, site, 'stay' AS move FROM e WHERE flag = 'A'
UNION ALL SELECT DISTINCT value, callee || ':' || position, site, 'call' FROM e WHERE flag <> 'A' UNION ALL SELECT DISTINCT callee || ':return', target, site, 'return' FROM e WHERE flag <> 'A'""")
def escape_flows(spark, sf_dir: str) -> DataFrame:
    put = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    kind = F.when(F.col("l_returnflag") == "A", "assign").otherwise("call")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("site"), kind.alias("kind"), put("t", "l_partkey").alias("target"), put("v", "l_suppkey").alias("value"), put("f", "l_suppkey").alias("callee"), F.col("l_linenumber").alias("position"))
    parameters = edges.select("callee", "position").distinct().withColumn("name", F.concat_ws(":", "callee", F.col("position").cast("string")))
    return escape.flows(edges, parameters)


@query("""WITH w AS (SELECT 'v' || l_suppkey AS place, l_orderkey AS site, l_linenumber % 2 AS version FROM lineitem), cur AS (SELECT o_orderkey AS site, o_custkey % 2 AS version FROM orders),
r AS (SELECT s_suppkey AS read, 'v' || s_suppkey AS place FROM supplier) SELECT DISTINCT r.read, w.place, w.site FROM r JOIN w USING (place) SEMI JOIN cur ON cur.site = w.site AND cur.version = w.version""")
def heap_write_join(spark, sf_dir: str) -> DataFrame:
    text = lambda c: F.concat(F.lit("v"), c.cast("string"))
    writes = table(spark, sf_dir, "lineitem").select(text(F.col("l_suppkey")).alias("place"), F.col("l_orderkey").alias("site"), (F.col("l_linenumber") % 2).cast("long").alias("version"))
    versions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site"), (F.col("o_custkey") % 2).alias("version"))
    reads = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("read"), text(F.col("s_suppkey")).alias("base"), F.lit("").alias("chain"))
    return escape.heap_writes(reads, writes, versions)


@query(f"""WITH {CALLS} SELECT DISTINCT node FROM (SELECT caller AS node FROM calls WHERE callee IN (SELECT p_partkey FROM part WHERE p_size > 45)
UNION ALL SELECT l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0))""")
def mark_reanalyzed(spark, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "part").filter("p_size > 45").select(F.col("p_partkey").alias("node"))
    invariants = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("place"))
    writes = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("place"), F.col("l_partkey").alias("node"))
    return escape.to_reanalyze(new, _calls(spark, sf_dir), invariants, writes)


def _library_calls(spark, sf_dir: str) -> DataFrame:
    """A call for each line item: an allocation, a copy or a fill by its flag."""
    flag = F.col("l_returnflag")
    function = F.when(flag == "A", "a.c:calloc(unsigned, unsigned)").when(flag == "N", "memcpy").otherwise("memset(void*, int, unsigned)")
    n = lambda c: F.col(c).cast("string")
    args = F.when(flag == "A", F.array(n("l_linenumber"), n("l_suppkey"))).when(flag == "N", F.array(F.lit("p"), F.lit("q"), n("l_suppkey"))).otherwise(F.array(F.lit("p"), (F.col("l_linenumber") - 1).cast("string"), n("l_suppkey")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("site"), function.alias("function"), args.alias("args"))


@query("SELECT l_orderkey AS site, 'calloc' AS name, l_linenumber || ' * ' || l_suppkey AS size FROM lineitem WHERE l_returnflag = 'A'")
def library_allocations(spark, sf_dir: str) -> DataFrame:
    return library.allocations(_library_calls(spark, sf_dir))


@query("SELECT l_orderkey AS site, 'p' AS target, 'q' AS source, CAST(l_suppkey AS VARCHAR) AS length FROM lineitem WHERE l_returnflag = 'N'")
def library_copies(spark, sf_dir: str) -> DataFrame:
    return library.copies(_library_calls(spark, sf_dir))


@query("SELECT l_orderkey AS site, 'p' AS target, CAST(l_suppkey AS VARCHAR) AS length FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1")
def library_zeroed(spark, sf_dir: str) -> DataFrame:
    return library.zeroed(_library_calls(spark, sf_dir))


@query("SELECT CASE l_returnflag WHEN 'A' THEN 'drop' ELSE 'follow' END AS treat, count(*) AS n FROM lineitem GROUP BY 1")
def library_followed(spark, sf_dir: str) -> DataFrame:
    return library.followed(_library_calls(spark, sf_dir), (("calloc", "drop"),)).groupBy("treat").agg(F.count("*").alias("n"))


# --- reporting


@query(f"WITH {FINISHED} SELECT CAST(sum(redundant) AS BIGINT) AS redundant, CAST(sum(assertion) AS BIGINT) AS assertion, CAST(sum(success) AS BIGINT) AS success, CAST(sum(report) AS BIGINT) AS report FROM fin")
def scan_totals(spark, sf_dir: str) -> DataFrame:
    return reporting.totals(finished_log(spark, sf_dir))


@query(f"WITH {FINISHED}, t AS (SELECT sum(redundant) AS r, greatest(sum(assertion), 1) AS a, sum(success) AS s FROM fin WHERE starts_with(file, 'src/Brand_1')) SELECT round((s + r) / (a + r), 9) AS all_ratio, round(s / a, 9) AS ratio FROM t")
def scan_ratio(spark, sf_dir: str) -> DataFrame:
    out = reporting.ratios(reporting.totals(finished_log(spark, sf_dir), "src/Brand_1"))
    return out.select(F.round("all_ratio", 9).alias("all_ratio"), F.round("ratio", 9).alias("ratio"))


@query("SELECT l_returnflag || l_linestatus AS kind, count(*) AS n FROM lineitem GROUP BY ALL")
def scan_kinds(spark, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("REPORT "), "l_returnflag", "l_linestatus", F.lit(" 'r"), F.col("l_orderkey").cast("string"), F.lit("'"))
    return reporting.kinds(table(spark, sf_dir, "lineitem").select(line.alias("line")))


FAILURES = f"""{LOG}, runs AS (SELECT *, coalesce(sum(CASE WHEN line LIKE '%terminated with code%' THEN 1 ELSE 0 END) OVER (PARTITION BY log ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM log),
ended AS (SELECT log, run, CASE WHEN bool_or(line LIKE '%Assertion failed%') THEN 'assert' WHEN bool_or(line LIKE '%Timeout%') THEN 'timeout' WHEN bool_or(line LIKE '%Conflict%') THEN 'conflict' ELSE 'crash' END AS cause
FROM runs GROUP BY log, run HAVING bool_or(line LIKE '%terminated with code%'))"""


@query(f"WITH {FAILURES} SELECT cause, count(*) AS n FROM ended GROUP BY cause")
def scan_failures(spark, sf_dir: str) -> DataFrame:
    return reporting.failures(analysis_log(spark, sf_dir))


@query(f"WITH {FAILURES} SELECT count(*) AS failures FROM ended WHERE cause <> 'conflict'")
def scan_failure_total(spark, sf_dir: str) -> DataFrame:
    return reporting.failure_total(reporting.failures(analysis_log(spark, sf_dir)))


@query(f"""WITH {FINISHED}, up AS (SELECT array_to_string(string_split(file, '/')[1:i], '/') AS directory, report, redundant + assertion AS c FROM fin, range(1, 9) AS t(i) WHERE i < len(string_split(file, '/')))
SELECT directory, CAST(sum(report) AS BIGINT) AS reports, CAST(sum(c) AS BIGINT) AS checked FROM up GROUP BY directory HAVING sum(c) <> 0""")
def scan_split_rollup(spark, sf_dir: str) -> DataFrame:
    return reporting.rollup_directories(reporting.finished(finished_log(spark, sf_dir)))


KEPT = f"{TRAITS}, kept AS (SELECT DISTINCT report, trait FROM traits WHERE report <> (SELECT max(report) FROM traits) AND NOT starts_with(trait, 'Size ') AND NOT regexp_matches(trait, 'src1$') AND regexp_matches(trait, 'Field|src'))"


def _traits(spark, sf_dir: str) -> DataFrame:
    return reporting.report_traits(doc_traits(spark, sf_dir), include=["Field", "src"], exclude=["src1$"], families=["Size"])


@query(f"WITH {KEPT} SELECT report, trait FROM kept")
def cluster_traits(spark, sf_dir: str) -> DataFrame:
    return _traits(spark, sf_dir)


@query(f"""WITH {KEPT}, n AS (SELECT trait, count(*) AS n FROM kept GROUP BY trait), best AS (SELECT report, trait, row_number() OVER (PARTITION BY report ORDER BY n DESC, trait) AS place FROM kept JOIN n USING (trait))
SELECT trait, n.n, count(*) AS assigned FROM best JOIN n USING (trait) WHERE place = 1 GROUP BY ALL""")
def cluster_greedy(spark, sf_dir: str) -> DataFrame:
    return reporting.cluster(_traits(spark, sf_dir))


@query(f"""WITH {REPORTS}, up AS (SELECT array_to_string(string_split(file, '/')[1:i], '/') AS node FROM reports, range(1, 12) AS t(i) WHERE i <= len(string_split(file, '/'))) SELECT node, count(*) AS n FROM up GROUP BY node""")
def index_counts(spark, sf_dir: str) -> DataFrame:
    return reporting.index_counts(path_reports(spark, sf_dir))


@query(f"WITH {REPORTS} SELECT name, lag(name) OVER (ORDER BY file, name) AS previous, lead(name) OVER (ORDER BY file, name) AS next FROM reports")
def index_prev_next(spark, sf_dir: str) -> DataFrame:
    return reporting.index_neighbours(path_reports(spark, sf_dir))


@query(f"""WITH {REPORTS}, r AS (SELECT regexp_replace(file, '/.*$', '') AS file, name, printable FROM reports)
SELECT name, CASE WHEN count(*) OVER (PARTITION BY file, printable) > 1 THEN printable || ' #' || row_number() OVER (PARTITION BY file, printable ORDER BY name) ELSE printable END AS label FROM r""")
def index_dup_number(spark, sf_dir: str) -> DataFrame:
    return reporting.number_duplicates(path_reports(spark, sf_dir).withColumn("file", F.regexp_replace("file", "/.*$", "")))


@query(f"WITH {REPORTS} SELECT name, (row_number() OVER (ORDER BY name) - 1) % 4 AS band FROM reports")
def index_bands(spark, sf_dir: str) -> DataFrame:
    return reporting.bands(path_reports(spark, sf_dir))


ASSERTS = """a AS (SELECT DISTINCT 's' || l_suppkey || '.c' AS file, 'f' || (l_partkey % 50) AS function, 'func' AS loop, l_returnflag AS kind, l_linenumber AS point, l_quantity AS bit FROM lineitem WHERE l_linestatus = 'O')"""


@query(f"WITH {ASSERTS} SELECT kind || '$' || file || '$' || function || '$' || loop || '$' || (row_number() OVER (PARTITION BY file, function, loop, kind ORDER BY point, bit) - 1) AS name FROM a")
def assert_names(spark, sf_dir: str) -> DataFrame:
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    cls = F.when(F.col("l_linestatus") == "O", "check").otherwise("trivial")
    asserts = table(spark, sf_dir, "lineitem").select(text("s", F.col("l_suppkey"), ".c").alias("file"), text("f", F.col("l_partkey") % 50).alias("function"), F.lit("func").alias("loop"), F.col("l_returnflag").alias("kind"), cls.alias("cls"), F.col("l_linenumber").alias("point"), F.col("l_quantity").alias("bit"))
    return reporting.assertion_names(asserts)


GUARDED = "g AS (SELECT o_custkey AS block, o_orderstatus AS value, 'g' || (o_orderkey % 4) AS guard FROM orders)"
COMBINED = f"{GUARDED}, combined AS (SELECT block, value, CASE WHEN bool_or(guard = 'g0') THEN 'true' ELSE string_agg(DISTINCT guard, ' | ' ORDER BY guard) END AS guard FROM g GROUP BY block, value)"


def _guarded(spark, sf_dir: str) -> DataFrame:
    guard = F.when(F.col("o_orderkey") % 4 == 0, "true").otherwise(F.concat(F.lit("g"), (F.col("o_orderkey") % 4).cast("string")))
    return guards.combine(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("block"), F.col("o_orderstatus").alias("value"), guard.alias("guard")), ["block"])


@query(f"WITH {COMBINED} SELECT block, value, guard FROM combined")
def guard_combine(spark, sf_dir: str) -> DataFrame:
    return _guarded(spark, sf_dir)


@query(f"""WITH {COMBINED}, r AS (SELECT *, count(*) OVER (PARTITION BY block) AS n, row_number() OVER (PARTITION BY block ORDER BY length(guard), guard, value) AS place,
first_value(guard) OVER (PARTITION BY block ORDER BY length(guard), guard, value) AS first FROM combined)
SELECT block, value, CASE WHEN n = 1 THEN 'true' WHEN n = 2 AND place = 2 THEN '!(' || first || ')' ELSE guard END AS guard FROM r""")
def guard_simplify(spark, sf_dir: str) -> DataFrame:
    return guards.simplify(_guarded(spark, sf_dir), ["block"])


# --- control flow, symbolic state, checks

CHAIN = "c AS (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY conv_id)"


def _chains(spark, sf_dir: str) -> DataFrame:
    """A function per conversation: its turns in a row and an edge from the last back to turn 1."""
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("n"))
    line = last.filter("n > 0").select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("source")).select("conv_id", "source", (F.col("source") + 1).alias("target"))
    back = last.filter("n >= 2").select("conv_id", F.col("n").alias("source"), F.lit(1).cast("long").alias("target"))
    return line.unionByName(back).withColumn("function", F.concat(F.lit("f"), F.col("conv_id").cast("string")))


@query(f"WITH {CHAIN} SELECT 'f' || conv_id AS function, 'loop#0' AS loop, 1 AS head, n AS size, 1 AS depth FROM c WHERE n >= 2")
def split_loops(spark, sf_dir: str) -> DataFrame:
    edges = _chains(spark, sf_dir)
    entries = edges.select("function").distinct().withColumn("entry", F.lit(0))
    return cfg.split_loops(edges, entries).select("function", "loop", "head", "size", "depth")


@query(f"WITH {CHAIN} SELECT 'f' || conv_id AS function, t AS point, t AS place FROM c, range(100) AS r(t) WHERE t <= n AND n > 0")
def topological_order(spark, sf_dir: str) -> DataFrame:
    edges = _chains(spark, sf_dir).filter("source < target")
    points = edges.select("function", F.col("source").alias("point")).unionByName(edges.select("function", F.col("target").alias("point"))).distinct().withColumn("line", F.lit(0))
    return cfg.topological_order(edges, points)


def _functions(spark, sf_dir: str) -> DataFrame:
    """A component per part: an access b[arg], and a caller that guards its argument if the part's size is even."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("component"), "p_size")
    edge = lambda f, s, t, kind, a, b: F.struct(F.lit(f).alias("function"), F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(kind).alias("kind"), (a if not isinstance(a, str) else F.lit(a)).alias("a"), F.lit(b).cast("string").alias("b"))
    guard = F.when(F.col("p_size") % 2 == 0, "0 <= n & n < ubound(b)").otherwise("0 <= n")
    rows = F.array(edge("callee", 0, 1, "assign", "z", "b[arg]"), edge("caller", 0, 1, "assume", guard, None), edge("caller", 1, 2, "call", "callee", "n"))
    return p.select("component", F.explode(rows).alias("e")).select("component", "e.*")


@query("SELECT p_partkey || '/' || f AS function, CAST(point AS INT) AS point, CASE WHEN f = 'callee' OR point = 0 THEN 'true' WHEN p_size % 2 = 0 THEN 'guarded' ELSE 'partly' END AS guard FROM part, (VALUES ('callee', 0), ('callee', 1), ('caller', 0), ('caller', 1), ('caller', 2)) AS v(f, point)")
def block_guards(spark, sf_dir: str) -> DataFrame:
    edges = _functions(spark, sf_dir).withColumn("function", F.concat_ws("/", "component", "function")).drop("component")
    guard = F.when(F.col("guard") == "true", "true").when(F.col("guard").contains("ubound"), "guarded").otherwise("partly")
    return symbolic.block_guards(edges).select("function", "point", guard.alias("guard"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS function, 'check' AS cls, kind, 0 AS point FROM part, (VALUES ('read_overflow'), ('read_underflow')) AS v(kind)")
def assert_generate(spark, sf_dir: str) -> DataFrame:
    edges = _functions(spark, sf_dir).filter("function = 'callee'").withColumn("function", F.col("component")).drop("component")
    return symbolic.block_assertions(edges).select("function", "cls", "kind", "point")


@query("SELECT CAST(p_partkey AS VARCHAR) AS component, 'callee' AS function, kind, CASE WHEN kind = 'read_underflow' OR p_size % 2 = 0 THEN 'success' ELSE 'report' END AS verdict FROM part, (VALUES ('read_overflow'), ('read_underflow')) AS v(kind)")
def check_reports(spark, sf_dir: str) -> DataFrame:
    return symbolic.check_reports(_functions(spark, sf_dir)).select("component", "function", "kind", "verdict")


@query("SELECT CAST(p_partkey AS VARCHAR) AS function, template, n FROM part, (VALUES ('linear', 1), ('monotonic', 2), ('tested', 1)) AS v(template, n)")
def loop_invariants(spark, sf_dir: str) -> DataFrame:
    """A loop per part: i goes up by one and j by the part's size while i < n."""
    edge = lambda s, t, kind, a, b: F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(kind).alias("kind"), F.lit(a).alias("a"), b.alias("b"))
    step = F.concat(F.lit("j + "), F.col("p_size").cast("string"))
    body = F.array(edge(0, 1, "assume", "i < n", F.lit(None).cast("string")), edge(1, 2, "assign", "i", F.lit("i + 1")), edge(2, 3, "assign", "j", step))
    edges = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("function"), F.explode(body).alias("e")).select("function", "e.*")
    return symbolic.inferred_invariants(edges).groupBy("function", "template").agg(F.count("*").cast("int").alias("n"))


from factloom.plans import catalog_program  # noqa: E402, F401  its queries register themselves
