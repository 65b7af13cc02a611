from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import resampling as R

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.id for r in R.resample(R.weigh(docs, labels.filter("doc_id % 2 = 0"), carry=[])).select("id").collect()}
    held = [(r.doc_id in kept, r.quality == 1) for r in labels.filter("doc_id % 2 = 1").collect()]
    assert sum(a == b for a, b in held) / len(held) >= 0.95


def test_weights_and_order_against_plain_sums(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [r for r in R.weigh(docs, labels).select("row.text", "log_weight", "_label", "_fold").collect()]
    raw, target = np.ones(R.BUCKETS), np.ones(R.BUCKETS)
    for r in rows:
        np.add.at(raw, R.ngrams(r.text), 1)
        if r["_label"] == 1 and r["_fold"] == 0:
            np.add.at(target, R.ngrams(r.text), 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert all(abs(r.log_weight - ratio[R.ngrams(r.text)].sum()) < 1e-6 for r in rows)
    weighed = R.weigh(docs, labels)
    keys = sorted((r.key for r in weighed.select(R.gumbel_key(F.col("log_weight"), F.col("id")).alias("key")).collect()), reverse=True)
    for k in (0, 1, 7, 59, 60, 99):
        assert sorted((r.key for r in R.resample(weighed, k=k).collect()), reverse=True) == keys[:k]


def test_kth_largest(spark):
    values = [-5, 3, 3, 3, 2**40, -(2**40), 0, 7]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    assert [R.kth_largest(df, k) for k in range(10)] == [None, *sorted(values, reverse=True), None]


def test_chances_follow_weights(spark):
    """With equal weights Gumbel top-k is a uniform sample."""
    df = spark.range(20_000).select("id", F.lit(0.0).alias("log_weight"), F.lit(None).cast("int").alias("_label"), F.lit(None).cast("int").alias("_fold"))
    low = R.resample(df, k=5_000).filter("id < 10000").count()
    assert abs(low - 2_500) < 200


def test_odd_input(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = R.resample(R.weigh(odd, labels))  # no good document: all weigh the same
    assert out.select("row.*").columns == odd.columns and out.count() == 6 and out.filter("row.key = 'clash' AND row.log_weight = 'clash'").count() == 6
    good = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    assert [r.id for r in R.resample(R.weigh(odd, good, carry=["key"])).collect()].count(1) in (0, 2)
    assert R.resample(R.weigh(none, labels)).count() == 0
    assert R.weigh(spark.createDataFrame([(1, "w " * 200_000)], "doc_id long, text string"), good).count() == 1


def test_repeated_labelled_ids_count_once(spark):
    rows = [(1, "good words here")] * 3_000 + [(2, "bad signs there")] * 5 + [(i, "good words here" if i % 2 else "bad signs there") for i in range(3, 40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    kept = R.resample(R.weigh(spark.createDataFrame(rows, "doc_id long, text string"), labels, carry=[]), seed=3)
    assert kept.filter("id = 1").count() in (0, 3_000) and kept.count() >= 3_000
