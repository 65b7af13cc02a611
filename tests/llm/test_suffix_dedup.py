from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import suffix_dedup as S


def test_order_against_sorting():
    rng = random.Random(1)
    for k in range(600):
        n = rng.randint(1, 80)
        data = bytes(rng.choices(b"ab\x00c" if k % 2 else b"aab", k=n))
        assert S.suffix_order(data, 200).tolist() == sorted(range(n), key=lambda i: data[i:])
        wanted = np.zeros(n, bool)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(n)
            wanted[at : at + rng.randint(1, 20)] = True
        order = [i for i in S.suffix_order(data, 200, wanted).tolist() if wanted[i]]
        assert order == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: data[i:])


def test_common_prefixes():
    data = b"abcabcabcabx" + b"\0" * 28
    t = np.frombuffer(data, np.uint8)
    assert S.common_prefixes(t, np.array([0, 0, 1]), np.array([3, 1, 4]), 20).tolist() == [8, 0, 7]


def brute(rows, span):
    seen, data = Counter(), [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[k : k + span] for k in range(len(b) - span + 1))
    out = []
    for i, b in data:
        cover = np.zeros(len(b) + 1, int)
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                cover[k] += 1
                cover[k + span] -= 1
        gone = np.cumsum(cover)[: len(b)] > 0
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("most", [S.MOST_CONTEXTS, 1])
def test_against_brute_force(spark, most):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 60").collect()]
    a, b = docs[0][1], docs[1][1]
    docs += [(-1, "a" * 1_000), (-2, None), (-3, ""), (-4, "x" * 199), (-5, a), (-5, a), (-6, "ab" * 300 + "tail"), (-7, "q" + b[20:320] + "z" * 50), (None, "é" * 150 + "unique")]
    out = S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), most=most)
    found = out.select("doc_id", "n_bytes", "n_removed", F.size("removed"), F.sha2("kept", 256)).collect()
    assert sorted(str(tuple(r)) for r in found) == brute(docs, S.SPAN)


def test_long_text_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    part = "".join(rng.choices("abcdefgh", k=300))
    docs = [(1, "".join(rng.choices("ijkl", k=2_500)) + part + "".join(rng.choices("mnop", k=700))), (2, "x" + part + "y" * 150)]
    cut = [(k, p, o) for k, p, o in S._blocks(iter([__import__("pyarrow").RecordBatch.from_arrays([__import__("pyarrow").array(v) for v in ([1], [2], [docs[0][1]])], ["a", "b", "c"])]), 200)]
    assert "".join(p.decode() for _, ps, _ in cut for p in ps)[:3_500] == docs[0][1]
    out = S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(str(tuple(r)) for r in out.select("doc_id", "n_bytes", "n_removed", F.size("removed"), F.sha2("kept", 256)).collect()) == brute(docs, 200)


def test_odd_input(odd, none):
    assert S.remove_repeats(odd).filter("n_removed = 0").count() == 6 and S.remove_repeats(none).count() == 0
