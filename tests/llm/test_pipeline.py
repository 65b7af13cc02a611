from __future__ import annotations

import math
import re
import struct
import sys
import zlib
from collections import Counter
from pathlib import Path

import xxhash

import corpus_pipeline as C
from factloom.llm import decontamination, near_dedup, personal_data, registry
from factloom.session import materialize

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_near_dedup import brute as near_duplicate_classes  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in registry.QUERIES} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in C.STAGES[:4]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0.6 * counts[0]
    assert near_dedup.classes(docs).filter("size > 1").count() == 0
    assert decontamination.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    left = personal_data.digest(personal_data.find_spans(docs.select("doc_id", "text"))).selectExpr("sum(n_email + n_ip + n_card + n_phone) AS n").first().n
    assert left == 0
    pieces = C.STAGES[4][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_odd_input(spark, odd, none):
    docs = odd
    for _, stage in C.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
    assert docs.filter("doc_id = 1").count() <= 1
    for _, stage in C.STAGES:
        assert stage(spark, none, SF).count() == 0


def ngram_buckets(text, buckets=1 << 14):
    """The classifier's features, number by number."""
    mask, out = 2**64 - 1, []
    words = re.findall(r"\w+|[^\w\s]", text or "")
    codes = [zlib.crc32(w.lower().encode()) for w in words]
    out += [((c * 0xBF58476D1CE4E5B9 & mask) >> 40) % (buckets - 2) for c in codes]
    for a, b in zip(codes, codes[1:]):
        out.append((((a * 0x9E3779B97F4A7C15 + b) * 0x94D049BB133111EB & mask) >> 40) % (buckets - 2))
        if a == b:
            out.append(buckets - 2)
    return out + [buckets - 1 for w in words if len(w) > 1 and w.isupper()]


def gumbel(doc_id):
    h = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), seed=42)
    u = (xxhash.xxh64_intdigest((1).to_bytes(4, "little"), seed=h) % 2**52 + 0.5) / 2**52
    return -math.log(-math.log(u))


def brute_quality(docs, labels):
    known = {}
    for r in labels:
        if r.doc_id is not None and r.quality is not None:
            known[r.doc_id] = min(r.quality, known.get(r.doc_id, 9))
    fold = lambda i: (lambda h: h - 2**64 if h >= 2**63 else h)(xxhash.xxh64_intdigest((5).to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed=42))) % 2
    raw, target = Counter(), Counter()
    grams = {r.doc_id: ngram_buckets(r.text) for r in docs}
    for i, g in grams.items():
        raw.update(g)
        if known.get(i) == 1 and fold(i) == 0:
            target.update(g)
    n = 1 << 14
    all_raw, all_target = sum(raw.values()) + n, sum(target.values()) + n
    weight = {i: sum(math.log((target[b] + 1) / all_target) - math.log((raw[b] + 1) / all_raw) for b in g) for i, g in grams.items()}
    held = [(weight[i], y) for i, y in known.items() if i in weight and fold(i) == 1]
    cuts = sorted({w for w, _ in held})
    errors = [sum(y == 1 and w < c for w, y in held) + sum(y != 1 and w >= c for w, y in held) for c in cuts]
    at = errors.index(min(errors))
    line = cuts[0] - 1 if at == 0 else (cuts[at - 1] + cuts[at]) / 2
    keys = sorted(((weight[i] + gumbel(i), i) for i in weight), reverse=True)
    return {i for _, i in keys[: sum(w >= line for w in weight.values())]}


def test_run_against_brute_force(spark):
    """All five stages by plain means on the smallest tables."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    kept = brute_quality(docs, spark.read.parquet(f"{SF}/labels.parquet").collect())
    left = [r for r in docs if r.doc_id in kept]
    idf = near_dedup._idf(spark.createDataFrame([(r.text or "",) for r in left], "text string"))
    first = {g[0] for g in (sorted(map(int, g)) for g in near_duplicate_classes([(r.doc_id, r.text) for r in left], idf))}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        runs |= {" ".join(w[i : i + 13]) for i in range(max(1, len(w) - 12))}
    left = [r for r in left if r.doc_id in first and not any(" ".join(w[i : i + 13]) in runs for w in [words(r.text)] for i in range(max(1, len(w) - 12)))]
    spans = {r.doc_id: r.spans for r in personal_data.digest(personal_data.find_spans(spark.createDataFrame(left))).collect()}
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = {}
    for r in left:
        text, at, out = r.text or "", 0, ""
        places = sorted((int(s), int(e), personal_data.KINDS.index(k), k) for k, s, e in (x.split(":") for x in spans[r.doc_id].split(",") if x))
        merged = []
        for s, e, _, k in places:
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e, k])
        for s, e, k in merged:
            out, at = out + text[at:s] + f"<{k}>", e
        ids = [*whole.encode(out + text[at:], add_special_tokens=False).ids, 2]
        for start in range(0, len(ids), 4096):
            piece = ids[start : start + 4096]
            wanted[r.doc_id, start] = (len(piece), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)), len(ids))
    got = C.run(spark, SF).collect()
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in got} == wanted and len(got) == len(wanted)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 4096
