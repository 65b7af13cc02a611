"""Exact removal of repeated strings by two-stage suffix sorting.

Every byte that is covered by a string of ``span`` bytes which also starts anywhere else is removed; strings don't cross
documents, and are judged on the input.

1. Each text is cut into anchor contexts (see ``anchors``): each start of a string belongs to one anchor, and equal strings
   have equal anchors at equal distance. So strings are only to be compared within a group of equal anchors; groups of
   one fall away. This is exact: nothing is sampled.
2. Equal contexts are counted, and one of each is kept with its count. Where a group has but one context, which then occurs
   more than once, all its strings occur again.
3. The bytes of the other contexts are fetched and dealt out by group, and each task sorts the suffixes of a batch of contexts in
   two stages: suffixes smaller than their successors are sorted directly; all others are induced in one scan over the
   buckets of first bytes, since such a suffix follows from its successor, which is in order already. Order and common
   prefixes count up to ``span`` bytes. Adjacent common prefixes of ``span`` bytes tell the strings that occur again.
4. The strings go back to all documents with the same context, as ranges, and the ranges of a document are merged.

Scale: the shuffles carry numbers per anchor, about one in 65 bytes of text, and the text of documents with repeats
only. Anchors are first reduced to those whose hash occurs twice. A group in which more than ``MOST_CONTEXTS`` different
contexts meet (a passage that very many documents share between different neighbours) isn't given to one task: its
strings are dealt out one by one by their digest with counts added up before the shuffle, and equal ones are found there. Joins
on hot groups are plain equi-joins that can be split.

Nulls and odd input: a null text is empty; texts under ``span`` bytes lose nothing; a null id is kept; repeated rows are documents of
their own, so each is a repeat of the other; long runs of one byte repeat themselves. Empty tables give an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.anchors import anchors, mix
from factloom.session import materialize

SPAN, GRAM = 200, 64
#: Contexts that one task may sort together: at most 16,384 of at most 2 * SPAN bytes, 6.5 MB.
MOST_CONTEXTS = 16_384
#: Bytes that are laid end to end at once for anchors, and sorted at once. A longer text is cut where no string is lost.
BLOCK, SORT_BYTES = 1 << 20, 2 << 20
BROADCAST_ROWS = 100_000


# --- two-stage suffix sorting


def suffix_order(data: bytes, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Starts of suffixes in order of their first ``depth`` bytes (the end of the data counts as smallest).

    Given ``wanted`` starts, only these are ordered, with the few that follow a run of them up to the next suffix that is
    sorted directly; all others are left out of both stages.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    t = np.frombuffer(data, np.uint8).astype(np.int16)
    follow = np.append(t[1:], -1)
    # Whether a suffix is larger than its successor: by the first byte that differs from the next; runs take it from their end.
    change = np.flatnonzero(t != follow)
    nearest = change[np.searchsorted(change, np.arange(n))]
    larger = t[nearest] > follow[nearest]

    small = np.flatnonzero(~larger)
    use = np.ones(n, dtype=bool)
    if wanted is not None:  # a larger suffix needs its successors up to a smaller one
        ends = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
        stops = np.append(small, n - 1)[np.searchsorted(small, ends)]
        use = np.cumsum(np.bincount(np.concatenate([ends, [n]]), minlength=n + 1) - np.bincount(np.concatenate([stops, [n]]), minlength=n + 1))[:n] > 0
        use |= wanted
        use[stops] = True
        small = small[use[small]]
    small = np.array(sorted(small.tolist(), key=lambda i: data[i : i + depth]), dtype=np.int64)  # stage one: direct
    bounds = np.searchsorted(t[small], np.arange(257))

    # Stage two: bucket by bucket, first the larger suffixes (induced), then the smaller ones (sorted).
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    induced = larger & use

    def induce(done: np.ndarray, bucket: int) -> np.ndarray:
        """Hand the predecessors of suffixes in order to their buckets; those of this bucket are returned."""
        before = done[done > 0] - 1
        before = before[induced[before]]
        first = t[before]
        for c in np.unique(first):
            if c != bucket:
                waiting[c].append(before[first == c])
        return before[first == bucket]

    if use[n - 1]:  # the last suffix is larger than the empty one that follows it
        waiting[t[n - 1]].append(np.array([n - 1]))
    for c in range(256):
        queue = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64)
        while len(queue):  # a run of one byte induces within its bucket, one byte of it at a time
            out.append(queue)
            queue = induce(queue, c)
        part = small[bounds[c] : bounds[c + 1]]
        if len(part):
            out.append(part)
            induce(part, c)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def common_prefixes(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to depth; t is padded by depth bytes."""
    out, left, step = np.zeros(len(a), dtype=np.int64), np.arange(len(a)), 8
    windows = np.lib.stride_tricks.sliding_window_view(t, step)
    for at in range(0, depth, step):
        if not len(left):
            break
        same = windows[a[left] + at] == windows[b[left] + at]
        whole = same.all(axis=1)
        out[left] = at + np.where(whole, step, np.argmin(same, axis=1))
        left = left[whole]
    return np.minimum(out, depth)


def repeated_starts(contexts: list[bytes], counts: list[int], span: int) -> list[np.ndarray]:
    """For each context, whether the string at each start occurs again, in any context or by the context's own count."""
    ends = np.cumsum([len(c) for c in contexts])
    begin = ends - [len(c) for c in contexts]
    data = b"".join(contexts)
    whole = np.repeat(ends, ends - begin) - np.arange(len(data)) >= span  # strings that lie within a context
    order = suffix_order(data, span, whole)
    order = order[whole[order]]
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(span + 8, np.uint8)])
    equal = common_prefixes(padded, order[:-1], order[1:], span) >= span
    again = np.zeros(len(data), dtype=bool)
    again[order[:-1][equal]] = True
    again[order[1:][equal]] = True
    return [again[b : e - span + 1] | (n > 1) for b, e, n in zip(begin, ends, counts, strict=True)]


def ranges_of(flags: np.ndarray) -> list[int]:
    """Starts and ends, in turn, of the runs of true values."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]))).tolist()


# --- the distributed steps


def _key(id_col: str, text: Column) -> list[Column]:
    """Two longs that tell documents apart by id and text; equal rows share them and what becomes of them."""
    return [F.xxhash64(F.lit(1), F.col(id_col), text).alias("k1"), F.xxhash64(F.lit(2), text, F.col(id_col)).alias("k2")]


def _blocks(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[list, list[bytes], list[int]]]:
    """Texts in groups of about BLOCK bytes: keys, parts and their offsets. Parts of a longer text overlap by span - 1 bytes."""
    keys, parts, offsets, size = [], [], [], 0
    for batch in batches:
        for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = (text.as_py() or "").encode()
            for at in range(0, max(1, len(data) - span + 1), BLOCK):
                part = data[at : at + BLOCK + span - 1]
                keys.append((k1, k2))
                parts.append(part)
                offsets.append(at)
                size += len(part)
                if size >= BLOCK:
                    yield keys, parts, offsets
                    keys, parts, offsets, size = [], [], [], 0
    if parts:
        yield keys, parts, offsets


def find_anchors(texts: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(h, c, k1, k2, low, n) for each anchor: group, context, document, first start and number of starts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, parts, offsets in _blocks(batches, span):
            ends = np.cumsum([len(p) for p in parts])
            h, c, low, n, text = anchors(np.frombuffer(b"".join(parts), np.uint8), ends, span, gram)
            starts = ends - [len(p) for p in parts]
            k = np.array(keys, dtype=np.int64).reshape(-1, 2)
            low = low - starts[text] + np.array(offsets)[text]
            columns = [h.view(np.int64), c.view(np.int64), k[text, 0], k[text, 1], low, n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "c", "k1", "k2", "low", "n"])

    return texts.mapInArrow(scan, "h long, c long, k1 long, k2 long, low long, n int")


def _cut_contexts(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """(h, c, copies, data) from (text, array of (h, c, copies, low, n))."""
    for batch in batches:
        for text, wanted in zip(*batch.columns, strict=True):
            data = (text.as_py() or "").encode()
            rows = [(x["h"], x["c"], x["copies"], data[x["low"] : x["low"] + x["n"] - 1 + span]) for x in wanted.as_py()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["h", "c", "copies", "data"])


def _sort_contexts(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """(c, h, ranges of starts that occur again) from contexts in order of h; a batch ends between groups."""

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        found = [(h, c, ranges_of(f)) for (h, c, _, _), f in zip(rows, repeated_starts([r[3] for r in rows], [r[2] for r in rows], span), strict=True) if f.any()]
        columns = list(zip(*found, strict=True)) if found else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["h", "c", "ranges"])

    rows, size, seen = [], 0, set()
    for batch in batches:
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if rows and row[0] != rows[-1][0]:
                seen = set()
                if size >= SORT_BYTES:
                    yield solved(rows)
                    rows, size = [], 0
            if row[1] not in seen:  # equal rows give a context more than once
                seen.add(row[1])
                rows.append(row)
                size += len(row[3])
    if rows:
        yield solved(rows)


def _deal_strings(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """(h, c, at, s1, s2, copies): the digest of the string at every start of the contexts of a crowded group."""
    for batch in batches:
        for h, c, copies, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            n = len(data) - span + 1
            words = np.frombuffer(b"".join(hashlib.blake2b(data[i : i + span], digest_size=16).digest() for i in range(n)), np.int64).reshape(-1, 2)
            columns = [np.full(n, h), np.full(n, c), np.arange(n, dtype=np.int32), words[:, 0], words[:, 1], np.full(n, copies)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "c", "at", "s1", "s2", "copies"])


def repeated_ranges(texts: DataFrame, span: int = SPAN, gram: int = GRAM, most: int = MOST_CONTEXTS) -> DataFrame:
    """(k1, k2, start, end): ranges of bytes covered by repeated strings, not merged."""
    spark = texts.sparkSession
    found = find_anchors(texts, span, gram)
    twice = materialize(found.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h"), "twice")
    met = materialize(found.join(twice, "h"), "anchors")
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets go of the shuffle files behind what is written now

    one = F.min(F.struct("k1", "k2", "low", "n")).alias("one")
    contexts = met.groupBy("h", "c").agg(F.count("*").alias("copies"), one)
    contexts = materialize(contexts, "contexts")
    groups = materialize(contexts.groupBy("h").agg(F.count("*").alias("kinds")), "groups")
    contexts = materialize(contexts.join(groups, "h"), "contexts")
    # A group of one context, which occurs more than once: all its strings do. The others are sorted.
    alone = contexts.filter("kinds = 1").select("h", "c", F.lit(0).alias("first"), F.col("one.n").alias("past"))
    wanted = contexts.filter("kinds > 1").select("one.k1", "one.k2", F.struct("h", "c", "copies", "one.low", "one.n", "kinds").alias("x"))
    per_text = wanted.groupBy("k1", "k2").agg(F.collect_list("x").alias("wanted"))  # as long as the text, at most
    fetched = materialize(_with(texts, per_text).select("text", "wanted").mapInArrow(lambda b: _cut_contexts(b, span), "h long, c long, copies long, data binary"), "cuts")
    crowded = groups.filter(F.col("kinds") > most).select("h")
    calm = fetched.join(crowded, "h", "left_anti").repartition("h").sortWithinPartitions("h")
    sorted_out = calm.mapInArrow(lambda b: _sort_contexts(b, span), "h long, c long, ranges array<int>")
    runs = F.transform(F.sequence(F.lit(0), (F.size("ranges") / 2 - 1).cast("int")), lambda i: F.struct(F.element_at("ranges", (2 * i + 1).cast("int")).alias("first"), F.element_at("ranges", (2 * i + 2).cast("int")).alias("past")))
    marked = sorted_out.select("h", "c", F.explode(runs).alias("r")).select("h", "c", "r.first", "r.past")

    dealt = fetched.join(crowded, "h", "left_semi").dropDuplicates(["h", "c"]).mapInArrow(lambda b: _deal_strings(b, span), "h long, c long, at int, s1 long, s2 long, copies long")
    dealt = materialize(dealt, "strings")
    often = dealt.groupBy("s1", "s2").agg(F.sum("copies").alias("m")).filter("m > 1").select("s1", "s2")
    marked = marked.unionByName(dealt.join(often, ["s1", "s2"]).select("h", "c", F.col("at").alias("first"), (F.col("at") + 1).alias("past")))
    marked = materialize(marked.unionByName(alone), "marked")
    return met.join(marked, ["h", "c"]).select("k1", "k2", (F.col("low") + F.col("first")).alias("start"), (F.col("low") + F.col("past") - 1 + span).alias("end"))


def _with(texts: DataFrame, per_text: DataFrame) -> DataFrame:
    """Inner join of texts with rows by document. Where these are few, by their count, they are found without a shuffle of all texts."""
    per_text = materialize(per_text, "by-text")
    keys = per_text.select("k1", "k2")
    if keys.count() <= BROADCAST_ROWS:  # 16 bytes each
        texts = texts.join(F.broadcast(keys), ["k1", "k2"], "left_semi")
    return texts.join(per_text, ["k1", "k2"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the merged ranges, removed bytes and what is left."""
    for batch in batches:
        ids, texts, found = batch.columns
        rows = []
        for text, spans in zip(texts, found.to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            merged: list[list[int]] = []
            for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            edges = [0, *(x for m in merged for x in m), len(data)]
            kept = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(data), len(data) - len(kept), [{"start": s, "end": e} for s, e in merged], kept))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), span, pa.binary()), strict=True))], ["id", "n_bytes", "n_removed", "removed", "kept"])


def remove_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, most: int = MOST_CONTEXTS) -> DataFrame:
    """Per document: id, n_bytes, n_removed, removed (array of byte ranges) and kept (the bytes that are left)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = documents.select(*_key(id_col, text), text.alias("text"), F.col(id_col).alias("id"))
    ranges = repeated_ranges(keyed.select("k1", "k2", "text"), span, gram, most)
    per_text = materialize(ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("found")), "ranges")
    kind = documents.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary"
    if per_text.count() <= BROADCAST_ROWS:
        touched = keyed.join(F.broadcast(per_text.select("k1", "k2")), ["k1", "k2"], "left_semi").join(per_text, ["k1", "k2"])
        others = keyed.join(F.broadcast(per_text.select("k1", "k2")), ["k1", "k2"], "left_anti")
        whole = others.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"), F.encode("text", "UTF-8").alias("kept"))
        out = touched.select("id", "text", "found").mapInArrow(_kept, shape).unionByName(whole)
    else:
        out = keyed.join(per_text, ["k1", "k2"], "left").select("id", "text", "found").mapInArrow(_kept, shape)
    return out.withColumnRenamed("id", id_col)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
