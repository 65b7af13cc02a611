"""Quality selection by importance resampling with hashed n-gram models.

Two generative models over hashed word and word-pair buckets: the target's from documents labelled good, the raw one from
all documents. A document's log weight is the log ratio of its likelihoods, the sum over its n-grams of
log(p_target / p_raw). Gumbel top-k draws k documents without replacement with chances by weight: to each log weight comes
Gumbel noise made from the document's id, and the k largest keys stay. k is the number of documents whose log weight reaches a threshold; the
threshold is the one that tells labelled good from labelled bad best. The target model learns from one half of the labelled
rows and the threshold from the other, since documents weigh more under a model that has seen them.

What is bounded: the labelled rows used, at most ``MOST_LABELS`` (those with the smallest hash of their id), and the models,
``BUCKETS`` numbers each. All counts, weights and the k-th largest key cover every document. That key is found exactly by four
rounds of counts by 16 bits of the keys' order, so nothing is sorted as a whole and the driver sees at most 65,536
counts a round. Texts aren't shuffled; the labelled ids are broadcast, at most 16 bytes for each of ``MOST_LABELS``.

Nulls, ties, sizes: a null or empty text has log weight 0; a null id gets the noise of null; repeated rows have equal keys and
stay or go together, and rows that tie with the k-th key all stay. Without labelled good documents all weights are 0 and
everything stays; without labelled bad ones everything that weighs no less than the lightest good one stays. A document with two labels counts
by the lower; a labelled id that several documents have counts once for the threshold, by the lightest of them. Empty tables give an empty result. Other columns are carried along in one struct, ``row``, so that none can
clash with those of this module, whatever it is called.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import materialize, small_batches

BUCKETS, MOST_LABELS, SEED = 1 << 14, 20_000, 1
TOKEN = re.compile(r"\w+|[^\w\s]")
_HASHES: dict[str, int] = {}


def ngrams(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each word or sign in lower case, and of each pair of neighbours; all words in capitals share one more, and
    so do all pairs of a word with itself."""
    words = TOKEN.findall(text or "")
    if new := {w for w in words if w not in _HASHES}:
        if len(_HASHES) + len(new) > 60_000:
            _HASHES.clear()
            new = set(words)
        _HASHES.update([(w, zlib.crc32(w.lower().encode("utf-8", "replace")) | (len(w) > 1 and w.isupper()) << 32) for w in new])
    both = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    one, capitals = both & np.uint64(0xFFFFFFFF), int(np.sum(both >> np.uint64(32)))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    hashed = np.concatenate([one * np.uint64(0xBF58476D1CE4E5B9), two * np.uint64(0x94D049BB133111EB)]) >> np.uint64(40)
    same = int(np.sum(one[:-1] == one[1:]))
    return np.concatenate([hashed.astype(np.int64) % (buckets - 2), np.repeat([buckets - 1, buckets - 2], [capitals, same])])


def labelled(labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", most: int = MOST_LABELS) -> DataFrame:
    """(_id, _label, _fold): at most ``most`` labelled ids, those with the smallest hash, in two folds."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    return one.orderBy(F.xxhash64("_id"), "_id").limit(most).withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(2)).cast("int"))


def log_ratios(documents: DataFrame, *, buckets: int = BUCKETS) -> np.ndarray:
    """log(p_target / p_raw) by bucket of documents (text, _label, _fold); the target's have _label 1 and _fold 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text, label, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = np.bincount(ngrams(text.as_py(), buckets), minlength=buckets)
                raw += found
                if label == 1 and fold == 0:
                    target += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    counted = documents.select("text", "_label", "_fold").mapInArrow(count, "bucket long, raw long, target long")
    with small_batches(documents.sparkSession):
        totals = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows at most
    raw, target = np.ones(buckets), np.ones(buckets)
    for row in totals:
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    if target.sum() == buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def threshold(scores: list[tuple[float, int]]) -> float:
    """The log weight that parts labelled good from bad with the fewest errors; half-way to the next lower weight, and of
    equal choices the lowest."""
    good = np.sort([s for s, label in scores if label == 1])
    bad = np.sort([s for s, label in scores if label != 1])
    if not len(good):
        return -math.inf
    if not len(bad):
        return float(good[0])
    cuts = np.unique(np.concatenate([good, bad]))
    errors = np.searchsorted(good, cuts) + len(bad) - np.searchsorted(bad, cuts)
    at = int(np.argmin(errors))
    return float(cuts[0] - 1 if at == 0 else (cuts[at - 1] + cuts[at]) / 2)


def weigh(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, most: int = MOST_LABELS, buckets: int = BUCKETS) -> DataFrame:
    """(row, id, log_weight, _label, _fold): row is a struct of all columns, or of those to ``carry``; _label and _fold are
    set for the labelled rows used. Written to the shared folder."""
    known = F.broadcast(labelled(labels, id_col=id_col, most=most))  # of bounded size
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns if carry is None or c in carry)) if carry != [] else F.lit(None)
    marked = documents.select(row.alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, F.col("id") == F.col("_id"), "left").drop("_id")
    ratios = log_ratios(marked, buckets=buckets)

    @F.pandas_udf("double")
    def weight(texts: pd.Series) -> pd.Series:
        return pd.Series([float(ratios[ngrams(t, buckets)].sum()) for t in texts], dtype="float64")

    return materialize(marked.withColumn("log_weight", weight(F.col("text"))).select(*(["row"] if carry != [] else []), "id", "log_weight", "_label", "_fold"), "weights")


def gumbel_key(weight: Column, key: Column, seed: int = SEED) -> Column:
    """Log weight plus Gumbel noise from the id, in millionths as a long: the keys' order."""
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.round((weight - F.log(-F.log(u))) * 1e6).cast("long")


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of a column of longs; None where there are fewer. Counts by 16 bits at a time."""
    if k <= 0:
        return None
    column = keys.columns[0]
    held = keys.select(F.col(column).alias("x"))
    top, left = None, k
    for shift in (48, 32, 16, 0):
        here = held if top is None else held.filter(F.shiftright("x", shift + 16) == top)
        counts = sorted(((r.p, r.n) for r in here.groupBy(F.shiftright("x", shift).alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 65,536 at most
        for p, n in counts:
            if n >= left:
                top = p
                break
            left -= n
        else:
            return None
    return top


def resample(weighed: DataFrame, *, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The k rows of weigh() with the largest keys, with ``key``; by default k is the number of weights that reach the labelled rows' threshold."""
    keyed = weighed.withColumn("key", gumbel_key(F.col("log_weight"), F.col("id"), seed))
    if k is None:
        used = weighed.filter("_label IS NOT NULL").groupBy("id", "_label", "_fold").agg(F.min("log_weight").alias("w")).collect()  # MOST_LABELS rows at most
        held = [(r.w, r["_label"]) for r in used if r["_fold"] == 1]
        sample = held if any(label == 1 for _, label in held) else [(r.w, r["_label"]) for r in used]
        k = weighed.filter(F.col("log_weight") >= F.lit(threshold(sample))).count()
    cut = kth_largest(keyed.select("key"), k)
    if cut is None:
        return keyed.filter(F.lit(False)) if k <= 0 else keyed
    return keyed.filter(F.col("key") >= cut)


def op3_resampling(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weighed = weigh(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=[])
    return resample(weighed).select(F.col("id").alias("doc_id"), "log_weight", (F.col("key") / 1e6).alias("key"))
