from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import near_dedup as N
from factloom.llm.components import connected


def brute(rows, idf):
    """Classes by all pairs of texts that share a shingle."""
    texts = sorted({t or "" for _, t in rows})
    features = [N.shingles([N.word_hashes(t)], idf)[1:] for t in texts]
    up, met = list(range(len(texts))), defaultdict(list)
    for i, (h, _, _) in enumerate(features):
        for x in h.tolist():
            met[x].append(i)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in {(a, b) for g in met.values() for a in g for b in g if a < b}:
        if N.jaccard(features[a], features[b]) >= N.LEAST:
            up[max(root(a), root(b))] = min(root(a), root(b))
    out = defaultdict(list)
    for i, t in rows:
        out[root(texts.index(t or ""))].append(str(i))
    return sorted(sorted(g) for g in out.values())


@pytest.mark.parametrize("cell", [N.CELL, 16])
def test_classes_against_all_pairs(spark, cell):
    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    base = docs.filter("length(text) > 600").first().text.split(" ")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, max(1, len(words) // 60))):
            words[rng.randrange(len(words))] = f"zq{rng.randrange(10**6)}"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(-1, None), (-2, ""), (-3, "two words"), (-4, "Two, words!"), (-5, " ".join(base)), (-5, " ".join(base)), (None, " ".join(base)), (-6, "x " * 3_000), (-7, "!!!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    idf = N._idf(df.select(F.coalesce("text", F.lit("")).alias("text")))
    out = defaultdict(list)
    for r in N.classes(df, cell=cell).collect():
        out[r.first].append(str(r.doc_id))
    assert sorted(sorted(g) for g in out.values()) == brute(rows, idf)


def test_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(5)
    idf = rng.uniform(1, 6, N.DF_BUCKETS).astype(np.float32)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = a.copy()
    b[::40] = rng.integers(0, 2**63, len(b[::40]), dtype=np.uint64)
    text, h, count, weight = N.shingles([a, b], idf)
    drawn = N.samples(text, h, count * weight, 2, 2_000)
    one = lambda i: (h[text == i], count[text == i], weight[text == i])
    assert abs(np.mean(drawn[0] == drawn[1]) - N.jaccard(one(0), one(1))) < 0.04
    assert abs(N.similarities([one(0), one(1)])[0, 1] - N.jaccard(one(0), one(1))) < 1e-9


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 102), (101, 102), (200, 201)]
    out = {r.node: r.root for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(51)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_odd_input(spark, odd, none):
    out = N.classes(odd).select("doc_id", "first.id", "size").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, [(1, 1, 2), (1, 1, 2), (2, 2, 2), (3, 2, 2), (4, 4, 1), (None, None, 1)]))
    assert N.classes(none).count() == 0
