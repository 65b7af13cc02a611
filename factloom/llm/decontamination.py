"""Benchmark decontamination by template windows, with DataFrame functions only.

Both sides are canonicalised: white space is one space, numbers, names and units after numbers become typed placeholders, the rest
lower-case words. What a name is can't be seen where a sentence opens or in text of one case, so a window has up to three
templates: capitalised words inside a sentence as names, all capitalised words as names, and none. Two windows meet by any of
them; along a diagonal two words are equal when one of the three makes them so. Documents are cut into consecutive windows of ``WINDOW`` words; the benchmark's
windows start at every word. A run of 2 * WINDOW - 1 equal words holds a whole window of any such cutting, so a hash join
of the two finds every run of that length, with one window per WINDOW words of the corpus instead of one per word.

A hit (document, item, diagonal) is then measured along its diagonal. What counts is a run of equal template words whose slots
are all consistent: a value of the item stands for one value of the document and the other way round, which tells a
re-parameterised question from an unrelated sentence of the same form. A stretch of a run without a changed value counts
whatever follows or precedes it. A document is contaminated by an item when the longest of all these has ``LEAST_RUN`` words, or
all of an item shorter than that (of 2 * WINDOW - 1 words at least). The result says whether any slot's value was changed.

Scale: the corpus' windows meet a table of the benchmark's windows. Where that table is within ``BROADCAST_BYTES`` by its
own count it is broadcast and the corpus isn't shuffled; beyond that the join is by shuffled hash of the window, which can
be split where a window is frequent. Only hits go on, with a slice of the document's words as long as the item, not the
document. Frequent passages make one hit per document and window; hits are reduced per (document, item, diagonal) before
anything is measured.

An item of fewer than 2 * WINDOW - 1 words need not hold a whole window of a document. It is compared whole and literally (case
and signs between words aside): so few words with placeholders would meet unrelated sentences. Where a benchmark has such
items, documents are also cut at every word into as many lengths as these have, eight at most.

Nulls and odd input: null texts are empty and match nothing; a null id is kept apart by place; repeated documents each
match; repeated items each match; items without words match nothing. Empty tables give an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, LEAST_RUN = 5, 13
SHORTEST = 2 * WINDOW - 1
BROADCAST_BYTES = 16 << 20
#: Unit words that count after a number.
UNITS = "mm|cm|km|meters?|metres?|miles?|inch(?:es)?|feet|foot|mg|kg|grams?|pounds?|lbs?|ml|l|liters?|litres?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|percent|dollars?|cents?|euros?|mph|kmh|kwh"
MARK = "\x01"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*+"


def marked(text: Column) -> Column:
    """Words with a space after each: lower case, slots as a mark, their type and their value.

    Types are n and u for numbers and units, p for capitalised words inside a sentence, q for other capitalised words.
    """
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\S\x20]\s*+|\x20\s++", " ")
    named = F.regexp_replace(text, r"(?<=[a-z0-9,;:]\x20)([A-Z][a-z]+)(?![A-Za-z])", f"{MARK}p$1")
    named = F.regexp_replace(named, r"([A-Z](?<![\p{L}\p{N}].)[a-z]+)(?![A-Za-z])", f"{MARK}q$1")
    has = text.rlike("[0-9]")
    numbered = F.regexp_replace(named, rf"(?<![\p{{L}}0-9.,])({NUMBER})(?![\p{{L}}0-9])", f" {MARK}n$1 ")
    united = F.regexp_replace(numbered, rf"(?i)(?<=[0-9]\x20)(\x20*)({UNITS})(?![\p{{L}}0-9])", f"$1{MARK}u$2")
    spaced = F.regexp_replace(F.lower(united), rf"(?:[^\p{{L}}\p{{N}}{MARK}.,]|[.,](?![0-9])|(?<![0-9])[.,])+", " ")
    plain = F.regexp_replace(F.lower(named), rf"[^\p{{L}}\p{{N}}{MARK}]+", " ")
    return F.concat(F.ltrim(F.when(has, spaced).otherwise(plain)), F.lit(" "))


def hashes(words: Column) -> Column:
    """Of each template, once: names inside sentences as placeholders, all capitalised words as placeholders, none."""
    typed = F.when(F.contains(words, F.lit(MARK)), F.regexp_replace(words, rf"{MARK}([nu])[^ ]*+", f"{MARK}$1")).otherwise(words)
    bare = lambda w, t: F.replace(w, F.lit(MARK + t), F.lit(""))
    inside = F.regexp_replace(bare(typed, "q"), rf"{MARK}p[^ ]*+", f"{MARK}p")
    every = F.regexp_replace(typed, rf"{MARK}[pq][^ ]*+", f"{MARK}p")
    several = F.array_distinct(F.array(*(F.xxhash64(t) for t in (inside, every, bare(bare(typed, "q"), "p")))))
    return F.when(typed.rlike(f"{MARK}[pq]"), several).otherwise(F.array(F.xxhash64(typed)))


def words_of(marked_text: Column) -> Column:
    return F.filter(F.split(marked_text, " +"), lambda w: w != "")


def _windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """A row for each template of the window at every word of an item: its hash, and the words from one window before to one after it."""
    items = benchmark.select(F.monotonically_increasing_id().alias("item_tag"), F.col(item_col).alias("item"), words_of(marked(F.col(text_col))).alias("words"))
    n = F.size("words")
    at = items.filter(n >= SHORTEST).select("item_tag", "item", "words", n.alias("item_words"), F.explode(F.sequence(F.lit(0), n - WINDOW)).alias("at"))
    own = F.concat(F.array_join(F.slice("words", F.col("at") + 1, WINDOW), " "), F.lit(" "))
    near = F.transform(F.sequence(F.lit(-WINDOW), F.lit(2 * WINDOW - 1)), lambda j: F.when(F.col("at") + j >= 0, F.try_element_at("words", F.col("at") + j + 1)))
    return at.select(F.explode(hashes(own)).alias("h"), "item_tag", "item", "item_words", "at", near.alias("near"))


def _tiles(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each template of the consecutive windows of a document; ``tiles`` holds them all."""
    docs = documents.select(F.monotonically_increasing_id().alias("doc_tag"), F.col(id_col).alias("doc"), marked(F.col(text_col)).alias("m"))
    docs = docs.select("doc_tag", "doc", F.regexp_extract_all("m", F.lit(rf"(?:[^ ]++ ){{1,{WINDOW}}}+"), F.lit(0)).alias("tiles"))
    every = F.flatten(F.transform("tiles", lambda t, i: F.transform(hashes(t), lambda h: F.struct(i.alias("tile"), h.alias("h")))))
    return docs.select("doc_tag", "doc", "tiles", F.explode(every).alias("at")).select("doc_tag", "doc", "tiles", "at.tile", "at.h")


def _around(hits: DataFrame) -> DataFrame:
    """The tile before, the tile and the tile after as text, instead of all tiles."""
    tile = F.col("tile")
    before = F.when(tile > 0, F.try_element_at("tiles", tile)).otherwise("")
    text = F.concat(before, F.element_at("tiles", tile + 1), F.coalesce(F.try_element_at("tiles", tile + 2), F.lit("")))
    return hits.withColumn("text", text).drop("tiles")


def _short_items(documents: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, broadcast_bytes: int) -> DataFrame | None:
    """Documents that hold all words of an item of fewer than SHORTEST in a row; None if there are no such items."""
    literal = lambda text: words_of(F.regexp_replace(marked(text), f"{MARK}[nupq]", ""))
    items = benchmark.select(F.monotonically_increasing_id().alias("item_tag"), F.col(item_col).alias("item"), literal(F.col(item_text_col)).alias("words"))
    items = items.select("item_tag", "item", F.size("words").alias("n"), F.array_join("words", " ").alias("key")).filter(F.col("n").between(1, SHORTEST - 1))
    sizes = items.groupBy("n").agg(F.sum(F.length("key") + 60).alias("bytes")).collect()  # SHORTEST - 1 rows at most
    if not sizes:
        return None
    docs = documents.select(F.monotonically_increasing_id().alias("doc_tag"), F.col(id_col).alias("doc"), literal(F.col(text_col)).alias("words"))

    def cuts(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.struct(F.lit(n).alias("n"), i.alias("at"), F.array_join(F.slice("words", i + 1, n), " ").alias("key")))
        return F.when(F.size("words") >= n, each).otherwise(F.array().cast("array<struct<n:int,at:int,key:string>>"))

    runs = F.concat(*(cuts(r.n) for r in sizes))
    met = docs.select("doc_tag", "doc", F.explode(runs).alias("r")).select("doc_tag", "doc", "r.*").join(F.broadcast(items) if sum(r["bytes"] for r in sizes) <= broadcast_bytes else items, ["n", "key"])
    first = met.groupBy("doc_tag", "doc", "item_tag", "item", "n").agg(F.min("at").cast("long").alias("doc_start"))
    zero = F.lit(0).cast("long")
    return first.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("n").cast("long").alias("run"), F.col("n").cast("long").alias("item_words"), "doc_start", zero.alias("slots"), zero.alias("changed"))


def contaminated(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row per document and item: id, item, run (words), item_words, doc_start (word), slots, changed (slots of another value)."""
    known, tiles = _windows(benchmark, item_col, item_text_col), _tiles(documents, id_col, text_col)
    size = known.agg(F.sum(F.length(F.array_join("near", " ")) + 120).alias("n")).first()["n"] or 0
    if size <= broadcast_bytes:  # only tiles that meet a window are written out, with their neighbours
        hits = _around(tiles.join(F.broadcast(known), "h"))
    else:
        hits = _around(tiles).join(known, "h")

    first = F.col("tile") * WINDOW - F.when(F.col("tile") > 0, WINDOW).otherwise(0)  # the text's first word
    shift = first - F.col("tile") * WINDOW + WINDOW  # of the document's words against ``near``
    both = F.transform(F.split(F.rtrim("text"), " "), lambda w, i: F.struct((first + i).alias("pos"), w.alias("w"), F.try_element_at("near", shift + i + 1).alias("b")))
    kind = lambda w: F.when(F.startswith(w, F.lit(MARK)), F.substring(w, 2, 1)).otherwise("")
    value = lambda w: F.when(kind(w).isin("p", "q"), F.substring(w, 3, 1 << 30)).otherwise(w)
    pair = lambda x: F.struct(x["pos"].alias("pos"), kind(x["w"]).alias("dk"), kind(x["b"]).alias("bk"), value(x["w"]).alias("d"), value(x["b"]).alias("b"))
    both = F.transform(F.filter(both, lambda x: x["b"].isNotNull()), pair)
    name = lambda k: k.isin("p", "q")
    same = F.filter(both, lambda x: (x["d"] == x["b"]) | ((x["dk"] == x["bk"]) & (x["dk"] != "")) | (name(x["dk"]) & name(x["bk"])))
    # a slot of names inside sentences, numbers and units, and equal by these alone
    strict = lambda x: (x["dk"] == x["bk"]) & x["dk"].isin("p", "n", "u")
    alone = lambda x: strict(x) | ((x["d"] == x["b"]) & ~(x["dk"] == "p") & ~(x["bk"] == "p"))
    slot = lambda x: F.when((x["dk"] != "") | (x["bk"] != ""), F.struct(x["d"].alias("d"), x["b"].alias("b")))
    same = F.transform(same, lambda x: F.struct(x["pos"].alias("pos"), slot(x).alias("slot"), strict(x).alias("strict"), alone(x).alias("alone")))
    diagonal = (F.col("tile") * WINDOW - F.col("at")).alias("diagonal")
    lines = hits.groupBy("doc_tag", "doc", "item_tag", "item", "item_words", diagonal).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(same)))).alias("same"))

    def barred(words: Column, is_slot) -> Column:
        """With the latest earlier slot that a slot contradicts: one side is the same there and the other isn't."""
        slots = F.filter(words, is_slot)
        against = lambda x: F.filter(slots, lambda s: (s["pos"] < x["pos"]) & ((s["slot"]["d"] == x["slot"]["d"]) != (s["slot"]["b"] == x["slot"]["b"])))
        bar = lambda x: F.when(is_slot(x), F.array_max(F.transform(against(x), lambda s: s["pos"])))
        return F.transform(words, lambda x: F.struct(x["pos"].alias("pos"), F.coalesce(bar(x), F.lit(-1)).alias("bar"), F.coalesce(x["slot"]["d"] != x["slot"]["b"], F.lit(False)).alias("odd")))

    stretch = lambda n, at: F.struct(n.cast("int").alias("n"), (-at).cast("int").alias("start"))
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("at"), F.lit(False).alias("ok"), F.lit(0).alias("as_is"), stretch(F.lit(0), F.lit(0)).alias("best"))
    whole = lambda a: stretch(F.when(a["ok"], a["last"] - a["at"] + 1).otherwise(0), a["at"])

    def longest(a: Column, x: Column) -> Column:
        """Ends a run where a word differs; ``as_is`` is where the words without changed values began."""
        new = x["pos"] != a["last"] + 1
        at = F.when(new, x["pos"]).otherwise(a["at"])
        as_is = F.when(x["odd"], x["pos"] + 1).when(new, x["pos"]).otherwise(a["as_is"])
        best = F.greatest(a["best"], F.when(new, whole(a)).otherwise(a["best"]), stretch(x["pos"] - as_is + 1, as_is))
        return F.struct(x["pos"].alias("last"), at.alias("at"), ((new | a["ok"]) & (x["bar"] < at)).alias("ok"), as_is.alias("as_is"), best.alias("best"))

    best_of = lambda words: F.aggregate(words, start, longest, lambda a: F.greatest(a["best"], whole(a)))
    every = best_of(barred(F.col("same"), lambda x: x["slot"].isNotNull()))
    inside = best_of(barred(F.filter("same", lambda x: x["alone"]), lambda x: x["strict"]))
    runs = lines.withColumn("best", F.greatest(every, inside))
    runs = runs.withColumn("run", F.struct(F.col("best.n").alias("n"), (-F.col("best.start")).alias("best"))).drop("best")
    slots = F.transform(F.filter("same", lambda x: x["slot"].isNotNull() & x["pos"].between(F.col("run.best"), F.col("run.best") + F.col("run.n") - 1)), lambda x: x["slot"])
    runs = runs.withColumn("slots", slots)
    found = runs.filter((F.col("run.n") >= LEAST_RUN) | (F.col("run.n") == F.col("item_words")))
    changed = F.size(F.filter("slots", lambda s: s["d"] != s["b"])).cast("long")
    best = F.max(F.struct(F.col("run.n").alias("run"), (-F.col("run.best")).alias("start"), F.size("slots").cast("long").alias("slots"), changed.alias("changed"))).alias("best")
    out = found.groupBy("doc_tag", "doc", "item_tag", "item", "item_words").agg(best)
    long_of = lambda c, n: F.col(c).cast("long").alias(n)
    out = out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), long_of("best.run", "run"), long_of("item_words", "item_words"), (-F.col("best.start")).cast("long").alias("doc_start"), F.col("best.slots").alias("slots"), F.col("best.changed").alias("changed"))
    short = _short_items(documents, benchmark, id_col, text_col, item_col, item_text_col, broadcast_bytes)
    return out if short is None else out.unionByName(short)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
