"""The corpus pipeline: language ID, near-duplicate removal, decontamination, secret redaction, BPE round trip.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; `run` writes each stage's result as Parquet in the shared
folder, reads it back as the next one's documents, and removes what only the stage before had to read. All stages but the last give the
columns of `documents`; further columns of their input are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefleet.llm import bpe_chunks, decontamination, language_id, near_dedup, secrets
from bytefleet.llm.common import shared_folder
from bytefleet.llm.tokenizers_io import public_path

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't express the first stage (a trained model), so the pipeline as a whole is tested stage by stage against brute force.
ORACLE_SQL = None
#: A document is rejected if its language is unknown, or if the likeliest one has less than this posterior probability.
LEAST_CERTAIN = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those whose language is in doubt. Learns from labelled documents that aren't held out."""
    return language_id.keep_identified(docs, language_id.train(docs.filter(~language_id.held_out())), LEAST_CERTAIN).select(*DOCUMENTS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Rows are judged by id and text, so different texts under one id are decided on each by itself, and a row that is
    repeated stays once. Rows without an id are in no group and stay.
    """
    return near_dedup.one_of_each(docs.select(*DOCUMENTS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go: rows that share an id are one document, rows without an id are judged each by its own text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2("text", 256))))
    leaks = decontamination.contained_items(keyed, items, doc_col="_key").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(leaks, "_key", "left_anti").select(*DOCUMENTS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark inside the texts; no document goes."""
    return secrets.redacted(docs, secrets.train(docs)).select(*DOCUMENTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of the ids and of what they decode to."""
    return bpe_chunks.roundtrip(docs, public_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", languages),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("bpe", encode),
]


def _removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from its folder in the shared one; the folders of the stages before are gone by then."""
    docs, folder, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            _removed(spark, last)
        last = path
    return docs
