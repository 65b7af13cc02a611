from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a\tb c d\x1ce", "It's <|endoftext|>don't\n\nHE'LL ΣΑΣ İi é é ́x J̌", "x" * 5_000, "1234 5!?.\r\n", "word, word. 'tis..", "ÀÉ Straße ŒUVRE ŉ"]


def test_encoder_equals_whole_texts(spark):
    whole, encode = Tokenizer.from_file(PATH), P.Encoder(PATH)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + ODD
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text[:50]


def test_encoder_forgets_and_stays_right():
    whole, encode = Tokenizer.from_file(PATH), P.Encoder(PATH, memory=20)
    for text in ["the cat sat, on the mat.", "another one here and there are many words to learn at once in this text", "the cat"] * 3:
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_patterns_cover_the_demand():
    rng = np.random.default_rng(1)
    for capacity in (8, 32, 256):
        demand = rng.integers(0, 500, capacity)
        patterns = P.solve(demand, capacity)
        assert all(int(p @ np.arange(1, capacity + 1)) <= capacity for p, _ in patterns)
        assert (sum(n * p for p, n in patterns) == demand).all()
        least = demand @ np.arange(1, capacity + 1) / capacity
        assert sum(n for _, n in patterns) <= 1.04 * least + capacity / 2
    assert P.solve(np.zeros(8, dtype=int), 8) == []


def check(pieces, docs, seq_len=4096):
    whole = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for key, text in docs:
        ids, at = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= seq_len
    return sum(r.length for r in pieces) / (seq_len * len(by_seq))


def test_pieces_and_sequences(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert check(P.op8_packing(spark, "/root/testdata/sf0.01").collect(), docs) > 0.97


def test_odd_input(spark, odd, none):
    pieces = P.pack(P.tokenise(odd, PATH))
    assert pieces.count() == 6 and pieces.select("sequence_id", "offset").distinct().count() == 6
    assert P.pack(P.tokenise(none, PATH)).count() == 0
    docs = [(i, t) for i, t in enumerate(ODD)]
    check(P.pack(P.tokenise(spark.createDataFrame(docs, "doc_id long, text string"), PATH)).collect(), docs)


def test_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    packed = P.pack(P.tokenise(docs, PATH, seq_len=64, keep_ids=True), seq_len=64)
    rows = P.sequences(packed, seq_len=64, pad_id=0).withColumn("n", F.length("ids")).collect()
    assert sum(r.n_ids for r in rows) == 7 and all(r.n == 4 * (r.n_ids if r.n_ids.bit_count() == 1 else 64) for r in rows)


def test_ids_of_letters_that_compose():
    """Letters whose lower case or composed form is a letter and a mark, beside marks, stops and contractions."""
    import random

    encode = P.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    pool = "aeisxAEIZ.,.,'' \n\t0129-İıſßẞŉǰÀéœ²½٣ΣςΑΐКйЙ中文한가ΩÅʼnDžLj़ׁ̧́̇" + "".join(map(chr, [*range(0x958, 0x960), *range(0xFB1D, 0xFB4F)]))
    draw = random.Random(1)
    texts = ["SABAH GAZETESİ. son", "GAZETESİ, x", "हक़.", "השׁ.", *("".join(draw.choices(pool, k=draw.randint(0, 14))) for _ in range(20_000))]
    wanted = encode.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, w in zip(texts, wanted, strict=True) if np.frombuffer(encode(t), "<u4").tolist() != w.ids] == []


def test_equal_pieces_are_spread(spark):
    n = 100_000
    pieces = spark.range(n, numPartitions=4).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "0L AS start", "1L AS length", "7L AS ids_crc32", "1L AS doc_tokens")
    packed = P.pack(pieces)
    got = packed.groupBy("sequence_id").agg(F.count("*").alias("n"), F.min("offset").alias("low"), F.max("offset").alias("high"), F.countDistinct("offset").alias("places")).collect()
    assert sum(r.n for r in got) == n and all(r.low == 0 and r.high == r.n - 1 and r.places == r.n for r in got) and len(got) <= n // 256 + 1
