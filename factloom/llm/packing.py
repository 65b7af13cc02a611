"""Packing by cutting-stock column generation.

A document's ids, with the end id, are cut at multiples of the sequence length; only the last piece is shorter. Lengths
are rounded up to ``UNIT`` ids, which gives a histogram of at most seq_len / UNIT classes whatever the corpus' size. A
linear program over patterns (multisets of classes that fit a sequence) minimises the number of sequences: the simplex
method keeps a basis of one pattern per class, and an unbounded knapsack by dynamic programming prices the classes'
duals into the best new pattern, until none improves. Pattern counts are rounded down, and the few pieces that are left
(fewer than patterns x pieces per pattern) are packed first-fit decreasing. Patterns are then assigned to the pieces by
rank within class.

Scale: one pass over the texts in Python (tokenizers), no text or ids shuffled, only a short row per piece. The solver on the
driver sees the histogram alone. Ranks come from (class, salt) groups with offsets by running sums; the salt is a hash of
the place at which a piece was written, so groups are of bounded size even where very many pieces are equal, and a class
that holds a third of all pieces doesn't meet in one task. The pattern table that is broadcast has at most one row per class and
a bounded number of segments.

Nulls and odd input: a null or empty text is the end id alone; a null id is kept. Repeated rows are packed each. Very long
texts are encoded whole, by their chunks between spaces. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import materialize

SEQ_LEN, UNIT, END_ID = 4096, 16, 2
#: Entries in a worker's memory of encoded chunks, about 150 MB; beyond it the memory starts anew. It changes speed alone.
MEMORY = 800_000
#: Outside this range characters can compose, or lower case depends on context.
COMPOSES = re.compile("[^\x00-\u012f\u0131-\u017f]")
#: Words of letters that are composed as they are and whose lower case is one letter: such a word is one pre-token, whatever follows.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
SALT_ROWS, LEAST_SALTS = 10_000, 64


class Encoder:
    """Ids of a text as little-endian 32-bit bytes, equal to encoding it whole.

    The vocabulary's pre-tokeniser drops white space and no token spans it, so chunks between spaces or newlines can be
    encoded apart and remembered. It also cuts between a letter and a full stop or comma, so a plain word is remembered
    once with and without these (letters of which composing or lower case makes a letter and a mark are not plain: the
    mark joins what follows); and it lowers case after composing characters, which can be done first where nothing composes.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.memory = Tokenizer.from_file(path), {}, memory
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, chunks: list[str]) -> None:
        part = [c for c in chunks if c not in self.known]
        words = [c for c in part if PLAIN.fullmatch(c)]
        groups = [words[at : at + 50] for at in range(0, len(words), 50)]
        for some, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)  # a plain word ends with its only word end
            if len(cuts) == len(some):
                data, bounds = ids.tobytes(), [0, *cuts.tolist()]
                self.known.update([(w, data[s:e]) for w, s, e in zip(some, bounds, bounds[1:], strict=False)])
        part = [c for c in part if c not in self.known]
        for at in range(0, len(part), 10_000):
            for chunk, found in zip(part[at : at + 10_000], self.tokenizer.encode_batch_fast(part[at : at + 10_000], add_special_tokens=False), strict=True):
                self.known[chunk] = np.array(found.ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        chunks = (text if COMPOSES.search(text) else text.lower()).replace("\n", " ").split(" ")
        if new := {c for c in chunks if c not in self.known}:
            if len(self.known) + len(new) > self.memory:
                self.known, new = {}, set(chunks)
            ended = [c for c in new if c[-1:] in (".", ",") and PLAIN.fullmatch(c, 0, len(c) - 1)]
            self._learn([*{".", ",", *(c[:-1] for c in ended), *new.difference(ended)}])
            self.known.update([(c, self.known[c[:-1]] + self.known[c[-1]]) for c in ended])
        return b"".join(map(self.known.__getitem__, chunks))


@functools.cache
def encoder(path: str, memory: int) -> Encoder:
    """One per worker process, so that later tasks find what earlier ones have learnt."""
    return Encoder(path, memory)


def tokenise(documents: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, end_id: int = END_ID, keep_ids: bool = False, memory: int = MEMORY) -> DataFrame:
    """Pieces of documents: id, start, length, ids_crc32, doc_tokens and, on demand, the ids as little-endian bytes."""
    kind = documents.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary, memory), end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, seq_len):
                    piece = ids[4 * start : 4 * (start + seq_len)]
                    rows.append((key, start, len(piece) // 4, zlib.crc32(piece), n, *[piece] * keep_ids))
            types = [batch.schema.field(0).type, *[pa.int64()] * 4, *[pa.binary()] * keep_ids]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return documents.select(id_col, text_col).mapInArrow(cut, schema)


def price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of highest dual value: an unbounded knapsack over class sizes 1 to capacity."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=int)
    for room in range(1, capacity + 1):
        values = best[room - 1 :: -1][: len(duals)] + duals[:room]  # class of size s leaves room - s
        at = int(np.argmax(values))
        if values[at] > best[room - 1] + 1e-12:
            best[room], last[room] = values[at], at + 1
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(duals), dtype=int), capacity
    while room > 0:
        if size := last[room]:
            pattern[size - 1] += 1
        room -= max(1, size)
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, capacity: int, rounds: int = 20_000) -> list[tuple[np.ndarray, int]]:
    """(pattern, copies) covering demand[s - 1] pieces of every size s, each pattern's sizes adding up to capacity at most."""
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return []
    n = len(sizes)
    basis = [np.bincount([s - 1], [capacity // s], minlength=capacity).astype(int) for s in sizes]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    copies = inverse @ demand[sizes - 1]
    for _ in range(rounds):
        duals = np.zeros(capacity)
        duals[sizes - 1] = inverse.sum(axis=0)
        value, pattern = price(np.maximum(duals, 0), capacity)
        if value <= 1 + 1e-9:
            break
        way = inverse @ pattern[sizes - 1]
        ratios = np.where(way > 1e-9, copies / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(ratios))
        if not np.isfinite(ratios[out]):
            break
        step = ratios[out]
        copies -= step * way
        copies[out] = step
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        basis[out] = pattern
    found, left = [], demand.astype(np.int64).copy()
    for pattern, x in sorted(zip(basis, copies, strict=True), key=lambda p: -p[1]):
        used = pattern > 0
        whole = min(int(np.floor(x + 1e-6)), int((left[used] // pattern[used]).min()))
        if whole > 0:
            found.append((pattern, whole))
            left -= whole * pattern
    while left.any():  # first-fit decreasing; equal fills are taken at once
        room, pattern = capacity, np.zeros(capacity, dtype=int)
        for s in np.flatnonzero(left)[::-1] + 1:
            if s <= room:
                k = min(room // s, int(left[s - 1]))
                pattern[s - 1] += k
                room -= k * s
        used = pattern > 0
        whole = int((left[used] // pattern[used]).min())
        found.append((pattern, whole))
        left -= whole * pattern
    return found


def segments(patterns: list[tuple[np.ndarray, int]]) -> list[tuple]:
    """For each class, in order of rank: first rank, pieces per sequence, first sequence and place in it."""
    out: dict[int, list[list[int]]] = {}
    first, taken = 0, {}
    for pattern, copies in patterns:
        place = 0
        for size in np.flatnonzero(pattern)[::-1] + 1:
            per, at = int(pattern[size - 1]), taken.get(size, 0)
            out.setdefault(int(size), [[], [], [], []])
            for column, value in zip(out[int(size)], (at, per, first, place), strict=True):
                column.append(value)
            taken[size] = at + per * copies
            place += per
        first += copies
    return [(size, *columns) for size, columns in sorted(out.items())]


def pack(pieces: DataFrame, *, seq_len: int = SEQ_LEN, unit: int = UNIT, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Adds sequence_id and offset to pieces, whose length is 1 to seq_len."""
    spark, capacity, columns = pieces.sparkSession, seq_len // unit, pieces.columns
    # Written with their places: equal pieces are told apart by these, in every later read alike.
    classed = materialize(pieces.withColumn("_class", F.ceil(F.col("length") / unit).cast("int")).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = classed.groupBy("_class").count().collect()  # a row per class at most
    demand = np.zeros(capacity, dtype=np.int64)
    for row in histogram:
        demand[row["_class"] - 1] = row["count"]
    table = segments(solve(demand, capacity))
    shape = "_class int, _rank0 array<long>, _per array<long>, _seq0 array<long>, _place0 array<long>"
    table = spark.createDataFrame(table, shape).coalesce(1)

    salts = max(LEAST_SALTS, int(demand.sum()) // SALT_ROWS)
    salted = classed.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    counts = salted.groupBy("_class", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_class").orderBy("_salt")) - F.col("_n")
    offsets = counts.select("_class", "_salt", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_class", "_salt").orderBy(*order, "_row")) - 1
    ranked = salted.withColumn("_within", within).join(offsets, ["_class", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_within"))

    # At most one row per class and a bounded number of segments: its size doesn't depend on the corpus.
    placed = ranked.join(F.broadcast(table), "_class")
    at = F.size(F.filter("_rank0", lambda r: r <= F.col("_rank")))
    take = lambda name: F.element_at(name, F.col("_at"))
    placed = placed.withColumn("_at", at).withColumn("_in", F.col("_rank") - take("_rank0"))
    placed = placed.withColumn("sequence_id", take("_seq0") + F.floor(F.col("_in") / take("_per"))).withColumn("_place", take("_place0") + F.pmod("_in", take("_per")))
    line = Window.partitionBy("sequence_id").orderBy("_place")
    offset = F.sum("length").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return placed.select(*columns, "sequence_id", "_place").withColumn("offset", offset).drop("_place")


def sequences(packed: DataFrame, *, seq_len: int = SEQ_LEN, pad_id: int = 0) -> DataFrame:
    """Training rows from packed pieces with their ids: sequence_id, n_ids, and ids padded unless a power of two long."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_ids"))
    hexed = F.concat_ws("", F.transform("p", lambda x: F.hex(x["ids"])))
    power = F.expr("bit_count(n_ids) = 1")
    pad = F.repeat(F.lit(pad_id.to_bytes(4, "little").hex().upper()), F.when(power, 0).otherwise(F.lit(seq_len) - F.col("n_ids")).cast("int"))
    return joined.select("sequence_id", "n_ids", F.unhex(F.concat(hexed, pad)).alias("ids"))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = tokenise(documents, public_tokenizers.path("word_bpe_49k.json"))
    packed = pack(pieces)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
