"""The corpus pipeline: raw documents to training sequences in five stages, each written as Parquet and read again.

1. quality: importance resampling keeps the documents that are like those labelled good.
2. near_duplicates: one document of each class of near copies stays, that with the smallest id.
3. decontamination: documents that hold a benchmark question go.
4. personal_data: spans of personal data are replaced by the names of their kinds, and n_chars follows.
5. packing: what is left is tokenised and packed.

All stages but the last return the columns of their documents, whatever these are called: a row travels as one struct, so
that no column of a stage's own can meet one of the table's. Null ids and texts, repeated rows and empty tables mean in
each stage what its operator says; of repeated rows near_duplicates keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontamination, near_dedup, packing, personal_data, resampling
from factloom.session import materialize

#: Chunks that packing remembers in a worker, which other stages have filled too.
PACKING_MEMORY = 400_000
#: Keys of this many documents may be broadcast: 16 bytes each.
BROADCAST_ROWS = 100_000


def _rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): row has all columns but the text, which goes beside it once."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "doc_id", "text")


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def _key() -> list:
    """Two longs that tell rows apart by id and text, null or not."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(F.col("doc_id"), text).alias("k1"), F.xxhash64(text, F.lit(3), F.col("doc_id")).alias("k2")]


def _by_key(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows with or without a key among keys. Few keys, by their count, are broadcast and the texts stay in place."""
    keys = materialize(keys.select("k1", "k2").distinct(), "keys")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    return rows.select("*", *_key()).join(keys, ["k1", "k2"], how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return resampling.resample(resampling.weigh(docs, labels)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _rows(docs)
    found = near_dedup.classes(rows.select("doc_id", "text"))
    same = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2"))
    # The operator's hashes of a text stand for the text in the keys of both sides.
    text = F.coalesce("text", F.lit(""))
    keyed = rows.withColumn("t1", F.xxhash64(text)).withColumn("t2", F.xxhash64(F.lit(2), text))
    key = [F.xxhash64("doc_id", "t1", "t2").alias("k1"), F.xxhash64("t2", "t1", "doc_id").alias("k2")]
    told = materialize(found.select(*key, same.alias("stays")), "told")
    gone = told.filter("NOT stays").select("k1", "k2").distinct()
    again = told.filter("stays").groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k1", "k2")
    keyed = keyed.select("row", "text", *key)

    def few(keys: DataFrame) -> DataFrame:
        keys = materialize(keys, "keys")
        return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys

    left, again = keyed.join(few(gone), ["k1", "k2"], "left_anti"), few(again)
    # Of rows of one id and text that differ elsewhere the first by its columns' text stays.
    one = left.join(again, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min_by(F.struct("row", "text"), F.to_json("row")).alias("x")).select("x.row", "x.text", "k1", "k2")
    once = left.join(again, ["k1", "k2"], "left_anti").unionByName(one)
    return _back(once, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, benchmark = _rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named = rows.select(F.struct(*_key()).alias("k"), "text")
    found = decontamination.contaminated(named, benchmark, id_col="k", text_col="text")
    return _back(_by_key(rows, found.select("k.k1", "k.k2"), "left_anti"), docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = _back(personal_data.redact(personal_data.find_spans(docs)), docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.tokenise(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), memory=PACKING_MEMORY)
    return packing.pack(pieces)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Sampling, tokenising and packing aren't SQL; tests hold run() against its stages and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
