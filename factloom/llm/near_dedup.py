"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words (a shorter text has one shingle of all its words). Its weight is its count times its inverse
document frequency ln((N + 1) / (df + 1)) + 1, where df counts the documents with a shingle of the same one of
``DF_BUCKETS`` hash buckets: rare shingles weigh alike, and boilerplate that many documents share weighs less. Similarity
is weighted Jaccard, the sum of minima over the sum of maxima.

Improved consistent weighted sampling (Ioffe) draws ``BANDS * ROWS`` samples of a text: the shingle k with the least
ln a = ln c - r (t - beta) - r, where r, c ~ Gamma(2, 1) and beta ~ U(0, 1) depend on k and the sample's number, and
t = floor(ln w / r + beta). Two texts draw the same (k, t) with a chance equal to their similarity. ROWS samples make a band; texts that share a band
are candidates: at 0.8 all but 0.08 % of pairs, and more for closer ones.

Equal texts are one candidate with a membership. Of two texts that share a band, those are compared whose sketches agree in
at least ``LEAST_AGREE`` of the samples (at 0.8 all but 0.02 % of pairs). A band's bucket of at most ``CELL`` different texts
yields such pairs, in the first band they share. A larger bucket is dealt to a triangle of cells, each of two blocks of
about CELL / 2 texts, at first with sketches alone; only texts that agree with another one in a cell meet there again with
their shingles, and a cell then computes all its similarities as one matrix product and yields a spanning forest of
its links. So every candidate link counts, while rows out of any bucket grow no faster than its blocks, and a bucket of
unlike texts that share a passage moves sketches and little more.
Pairs are verified by exact weighted Jaccard similarity on the texts' shingles. Classes are connected components of
verified links, found by distributed alternating stars.

Scale: two passes over texts for frequencies and samples, a third over candidate texts only. Shuffled: sketches and keys, and
shingles of candidates. The driver and the workers hold DF_BUCKETS frequencies, whatever the corpus.

Nulls and odd input: a null text is empty; equal texts, empty ones too, are in one class; a text without words is like
its equals only; a null id counts as largest; repeated rows share a class and each give a row. Very long texts are taken
whole. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.anchors import mix
from factloom.llm.components import connected
from factloom.session import drop, materialize, small_batches

WORDS, LEAST, BANDS, ROWS = 5, 0.8, 10, 3
DF_BUCKETS, CELL, LEAST_AGREE = 1 << 17, 256, 15
BROADCAST_ROWS = 100_000
WORD = re.compile(r"\w+")
_HASHES: dict[str, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    words = WORD.findall((text or "").lower())
    if new := {w for w in words if w not in _HASHES}:
        if len(_HASHES) + len(new) > 150_000:
            _HASHES.clear()
            new = set(words)
        _HASHES.update([(w, int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")) for w in new])
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(texts: list[np.ndarray], idf: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count, idf) of every text's different shingles, in order of text and hash."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.concatenate([*texts, np.zeros(words - 1, np.uint64)])
    ends = np.cumsum(lengths)
    counts = np.where(lengths >= words, lengths - words + 1, (lengths > 0).astype(np.int64))
    text = np.repeat(np.arange(len(texts)), counts)
    at = np.repeat(ends - lengths, counts) + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    size = np.minimum(lengths, words)[text]
    h = np.zeros(len(at), np.uint64)
    for i in range(words):
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(i < size, flat[at + i] | np.uint64(1), np.uint64(0))
    h = mix(h)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])[: len(h)])
    count = np.diff(np.concatenate([new, [len(h)]]))
    return text[new], h[new], count, idf[(h[new] & np.uint64(len(idf) - 1)).astype(np.int64)].astype(np.float64)


@functools.cache
def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at 65,536 even chances, and its logarithm."""
    x = np.concatenate([np.geomspace(1e-5, 1, 200_000), np.linspace(1, 40, 400_000)[1:]])
    r = np.interp((np.arange(65536) + 0.5) / 65536, 1 - (1 + x) * np.exp(-x), x)
    return r.astype(np.float32), np.log(r).astype(np.float32)


def samples(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n_texts: int, n: int) -> np.ndarray:
    """n samples of each text, as hashes of (shingle, t); 0 for texts without shingles."""
    out = np.zeros((n_texts, n), dtype=np.uint64)
    if not len(h):
        return out
    gamma, log_gamma = _quantiles()
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    log_weight = np.log(weight).astype(np.float32)
    place = np.arange(len(h), dtype=np.uint64)
    low = np.uint64(0xFFFF)
    for j in range(n):
        z = (h ^ np.uint64((j + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        r, log_c = gamma[(z >> np.uint64(48)).astype(np.int64)], log_gamma[((z >> np.uint64(32)) & low).astype(np.int64)]
        beta = ((z >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
        t = np.floor(log_weight / r + beta)
        log_a = log_c - r * (t - beta) - r
        bits = log_a.view(np.uint32)
        ordered = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000))
        best = (np.minimum.reduceat((ordered.astype(np.uint64) << np.uint64(32)) | place, starts) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out[text[best], j] = mix(h[best] + t[best].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return out


def bands_of(drawn: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each group of ``rows`` samples."""
    out = np.zeros((len(drawn), drawn.shape[1] // rows), dtype=np.uint64)
    for i in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + drawn[:, i::rows][:, : out.shape[1]])
    return out


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links among (a[i], b[i]) that first join two groups."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def similarities(features: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarity of all pairs; a feature set is (hash, count, idf).

    Minima of counts times idf are inner products once a shingle's n-th occurrence counts as a feature of its own.
    """
    n = len(features)
    text = np.repeat(np.arange(n), [int(c.sum()) for _, c, _ in features])
    parts = [(np.repeat(h, c), np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c), np.repeat(w, c)) for h, c, w in features]
    h = np.concatenate([mix(h + k.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) for h, k, _ in parts])
    w = np.concatenate([w for _, _, w in parts]).astype(np.float64)
    total = np.bincount(text, weights=w, minlength=n)
    _, column, seen = np.unique(h, return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    text, column, w = text[shared], column[shared], w[shared]
    both = np.zeros((n, n))
    order = np.argsort(column, kind="stable")
    text, w = text[order], w[order]
    column = np.unique(column[order], return_inverse=True)[1]
    for low in range(0, int(column.max(initial=-1)) + 1, 4096):  # by blocks of columns
        here = slice(np.searchsorted(column, low), np.searchsorted(column, low + 4096))
        block = np.zeros((n, min(4096, int(column[-1]) + 1 - low)))
        block[text[here], column[here] - low] = np.sqrt(w[here])
        both += block @ block.T
    union = total[:, None] + total[None, :] - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0)


# --- the distributed steps


def _batched(batches: Iterator[pa.RecordBatch], texts: int = 256) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, texts):
            part = batch.slice(at, texts)
            yield part, [word_hashes(x.as_py()) for x in part.column("text")]


def _idf(texts: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DF_BUCKETS, dtype=np.int64), 0
        for part, hashed in _batched(batches):
            n += part.num_rows
            text, h, _, _ = shingles(hashed, np.ones(1))
            inside = np.unique(text * DF_BUCKETS + (h & np.uint64(DF_BUCKETS - 1)).astype(np.int64)) % DF_BUCKETS  # once a text
            df += np.bincount(inside, minlength=DF_BUCKETS)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "df"])

    rows = texts.mapInArrow(count, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    with small_batches(texts.sparkSession):
        found = rows.toArrow()  # DF_BUCKETS + 1 rows at most
    buckets, df = found.column("bucket").to_numpy(), found.column("df").to_numpy()
    n = df[buckets == -1].sum()
    out = np.zeros(DF_BUCKETS)
    out[buckets[buckets >= 0]] = df[buckets >= 0]
    return (np.log((n + 1) / (out + 1)) + 1).astype(np.float32)


def _sketch(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """Adds weight (total), bands and sketch to (id, t1, t2)."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hashed in _batched(batches):
            text, h, count, rare = shingles(hashed, idf)
            drawn = samples(text, h, count * rare, len(hashed), BANDS * ROWS)
            total = np.bincount(text, weights=count * rare, minlength=len(hashed)).astype(np.float64)
            bands = bands_of(drawn, ROWS).view(np.int64)
            keys = pa.array([b.tolist() if w > 0 else [] for b, w in zip(bands, total, strict=True)], pa.list_(pa.int64()))
            short = (drawn >> np.uint64(32)).astype("<u4")
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("t1"), part.column("t2"), pa.array(total), keys, pa.array([x.tobytes() for x in short], pa.binary())], ["id", "t1", "t2", "weight", "bands", "sketch"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(draw, f"id {kind}, t1 long, t2 long, weight double, bands array<long>, sketch binary")


def _close_pairs(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(a, b) from buckets' members (node, weight, sketch): pairs near enough by sketch, in the first band they share."""
    for batch in batches:
        left: list[bytes] = []
        right: list[bytes] = []
        for band, listed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            members = listed.as_py()
            nodes = [m["node"] for m in members]
            weight = np.array([m["weight"] for m in members])
            sketch = np.frombuffer(b"".join(m["sketch"] for m in members), "<u4").reshape(len(members), -1)
            for i in range(len(members) - 1):
                same = sketch[i + 1 :] == sketch[i]
                shared = same.reshape(len(same), BANDS, ROWS).all(axis=2)
                near = (same.sum(axis=1) >= LEAST_AGREE) & (np.argmax(shared, axis=1) == band)
                near &= np.minimum(weight[i], weight[i + 1 :]) >= least * np.maximum(weight[i], weight[i + 1 :]) * (1 - 1e-9)
                for j in np.flatnonzero(near):
                    left.append(nodes[i])
                    right.append(nodes[i + 1 + j])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])


def _features(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(node, f): the different shingles of a text with counts and idf, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hashed in _batched(batches):
            text, h, count, rare = shingles(hashed, idf)
            cuts = np.searchsorted(text, np.arange(len(hashed) + 1))
            packed = [b"".join((h[s:e].tobytes(), count[s:e].astype("<i4").tobytes(), rare[s:e].astype("<f8").tobytes())) for s, e in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(packed, pa.binary())], ["node", "f"])

    return texts.select("node", "text").mapInArrow(pack, "node binary, f binary")


def _unpack(f: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(f) // 20
    return np.frombuffer(f, np.uint64, n), np.frombuffer(f, "<i4", n, 8 * n).astype(np.int64), np.frombuffer(f, "<f8", n, 12 * n)


def jaccard(x: tuple, y: tuple) -> float:
    """Weighted Jaccard similarity of two feature sets, whose hashes are in order."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = float(np.sum(np.minimum(x[1][i], y[1][j]) * x[2][i]))
    union = float(np.sum(x[1] * x[2]) + np.sum(y[1] * y[2])) - both
    return both / union if union > 0 else 0.0


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, fa, fb = batch.columns
        ok = [jaccard(_unpack(x.as_py()), _unpack(y.as_py())) >= least for x, y in zip(fa, fb, strict=True)]
        yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _agreeing(sketches: list[bytes]) -> np.ndarray:
    """Which pairs agree in LEAST_AGREE samples."""
    drawn = np.frombuffer(b"".join(sketches), "<u4").reshape(len(sketches), -1)
    agree = np.zeros((len(drawn), len(drawn)), dtype=np.int16)
    for column in drawn.T:
        agree += column[:, None] == column[None, :]
    return agree >= LEAST_AGREE


def _cell_members(table: pa.Table) -> pa.Table:
    """Of a cell (cell, node, sketch) the texts that agree with another."""
    near = _agreeing(table.column("sketch").to_pylist())
    np.fill_diagonal(near, False)
    return table.filter(pa.array(near.any(axis=1)))


def _cell_links(table: pa.Table, least: float) -> pa.Table:
    """A spanning forest of the links within a cell (node, sketch, f)."""
    nodes = table.column("node").to_pylist()
    alike = similarities([_unpack(f) for f in table.column("f").to_pylist()])
    a, b = np.nonzero(np.triu((alike >= least) & _agreeing(table.column("sketch").to_pylist()), 1))
    links = forest(a, b)
    return pa.table({"a": pa.array([nodes[x] for x, _ in links], pa.binary()), "b": pa.array([nodes[y] for _, y in links], pa.binary())})


def classes(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, cell: int = CELL) -> DataFrame:
    """A row per document: id, t1 and t2 (two hashes of the text), and ``first``, the smallest id in its class."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = documents.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"), text.alias("text"))
    idf = _idf(texts.select("text"))
    drawn = materialize(_sketch(texts, idf), "sketches")
    node = F.unhex(F.concat(F.lpad(F.hex("t1"), 16, "0"), F.lpad(F.hex("t2"), 16, "0"))).alias("node")
    different = drawn.groupBy("t1", "t2").agg(F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).select(node, "weight", "bands", "sketch")
    rows = different.select("node", "weight", "sketch", F.posexplode("bands").alias("band", "key"))
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialize(rows.join(sizes, ["band", "key"]), "buckets")

    small = met.filter(F.col("n") <= cell).groupBy("band", "key").agg(F.collect_list(F.struct("node", "weight", "sketch")).alias("m"))
    pairs = materialize(small.select("band", "m").mapInArrow(lambda b: _close_pairs(b, least), "a binary, b binary"), "pairs")
    large = met.filter(F.col("n") > cell).select("band", "key", "node", "sketch", F.ceil(F.col("n") / (cell // 2)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", "sketch")
    cells = materialize(cells.groupBy("cell").applyInArrow(_cell_members, "cell long, node binary, sketch binary"), "cells")

    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(cells.select("node")).distinct()
    noded = texts.select(node, "text")
    noded = noded.join(F.broadcast(wanted), "node", "left_semi") if wanted.count() <= BROADCAST_ROWS else noded.join(wanted, "node", "left_semi")
    features = materialize(_features(noded.dropDuplicates(["node"]), idf), "features")
    fa, fb = (features.select(F.col("node").alias(c), F.col("f").alias(f"f{c}")) for c in "ab")
    linked = pairs.join(fa, "a").join(fb, "b").select("a", "b", "fa", "fb").mapInArrow(lambda b: _verify(b, least), "a binary, b binary")
    crowd = cells.join(features, "node").groupBy("cell").applyInArrow(lambda t: _cell_links(t, least), "a binary, b binary")
    roots = connected(linked.unionByName(crowd))
    drop(met, pairs, cells, features)  # connected() has written the links

    members = drawn.select("id", "t1", "t2", node).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), "t1", "t2")
    # Written first, so that the join with a class of very many documents can be split.
    heads = materialize(members.groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("size")), "heads")
    return members.join(heads, "root").select(F.col("id").alias(id_col), "t1", "t2", "first", "size")


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.col("first.id").alias("class_id"), F.col("size").cast("long").alias("class_size"))
