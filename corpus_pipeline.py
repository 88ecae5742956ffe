"""The corpus pipeline: documents to packed training sequences, in five stages.

Every stage works on all rows that its predecessor kept. Its result is written as Parquet and read
again as the next one's input.

What all stages but the last hold to: the result has the columns of ``docs``, whatever they are called and
however many there are. Null and empty texts and null ids are rows like others. Texts of any length count whole.
An empty table of documents gives an empty table; empty tables of labels or of the benchmark leave every
document alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm import decontaminate, packing, queries, scratch, simhash, substring_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model learns from the labels of the documents at hand. Null and empty
    texts score 0 and stay; repeated rows go or stay together; ties at 0.5 go. Without labels of both kinds all
    stay."""
    return toxicity.passing(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the one with the smallest id, of equal ids the one
    with the smallest hash of its text, of rows that repeat both any one. Rows without an id come after those
    with one. Null and empty texts have one fingerprint, so one of them stays."""
    groups = simhash.near_duplicates(docs)
    # Rows that repeat id and text are one group: one of them stays.
    key = ["id_key", "text_key"]
    hashed = lambda text: (F.xxhash64("doc_id").alias("id_key"), F.coalesce(text, F.lit(0)).alias("text_key"))
    keepers = groups.where("keeper").select(*hashed(F.col("text_hash"))).distinct()
    columns = docs.columns
    packed = docs.select(F.struct(*columns).alias("row"), *hashed(F.xxhash64("text")))
    kept = packed.join(keepers, key, "left_semi").groupBy(*key).agg(F.first("row").alias("row"))
    return kept.select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur twice lose their words; documents without repeats keep
    their text as it is, null and empty ones too, and documents of which nothing is left go. Rows that repeat id
    and text repeat each other."""
    found = substring_dedup.without_repeats(docs)
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept"), "n_chars": F.length("kept")}
    out = found.where(~changed | (F.col("kept") != ""))
    return out.select(*[F.when(changed, new[c]).otherwise(F.col("row")[c]).cast(kind).alias(c) if c in new else F.col("row")[c].alias(c) for c, kind in docs.dtypes])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and empty items are in no document, null and empty texts
    contain none; repeated rows go or stay together."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences. A null or empty text is its end id alone;
    repeated rows are packed each; ties for places go by id, start and checksum."""
    return packing.pack(docs, queries.tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can't express the trained classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.materialise(stage(spark, docs, sf_dir), name)
    return docs
