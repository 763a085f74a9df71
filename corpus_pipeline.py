"""A training corpus from ``documents``: judged, deduplicated, cleared of secrets, mixed and packed.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a frame. ``run`` writes what each stage returns as Parquet in the
shared folder and gives it to the next. Empty tables give empty ones; columns
beyond those of ``documents`` stay until the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import mixing, near, packing, quality, secrets
from gridloom.llm.scratch import staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, a score of 0.5 among them; null and empty texts are judged like others, repeated rows alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id.

    Repeated rows count once; rows without an id, null and empty texts, and
    different texts under one id all stay.
    """
    first = near.join(docs).where("doc_id = class_id").select(F.col("doc_id").alias("kept")).distinct()
    # a row travels as one column, so that no name of its own can clash with ours; copies of a row meet before they move
    rows = docs.where("doc_id IS NOT NULL").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("same"))
    one = rows.dropDuplicates(["id", "same"]).join(first, F.col("id") == F.col("kept"), "left_semi")
    return one.select(*(F.col("row")[c].alias(c) for c in docs.columns)).unionByName(docs.where("doc_id IS NULL"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each secret replaced by a mark; ``n_chars`` follows the text. Null texts stay null."""
    clean = secrets.redact(docs, secrets.scan(docs))
    if "n_chars" not in clean.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.contains("text", F.lit("[secret]")), F.length("text").cast(kind)).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row at least once, those of small sources more often (twice at most); null and empty texts once."""
    return mixing.mix_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces with the sequence and the offset that hold them; a null or empty text is one piece of the end id."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("mixing_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Training, hashing and tokenising can't be said in SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
