"""The driver's tables seen as files: a file has an image, a name, an order in its image and a payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefleet.plans.tables import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("image"), F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string")).alias("file_name"), F.col("doc_id").alias("ord"), "doc_id", "lang", "text", F.encode("text", "UTF-8").alias("data"), F.coalesce("lang", F.lit("")).alias("file_type"))


#: The same in SQL, as a CTE `f`.
DOCUMENTS_SQL = "f AS (SELECT source AS image, coalesce(lang, '') || '/' || doc_id AS file_name, doc_id AS ord, doc_id, lang, text, encode(text) AS data, coalesce(lang, '') AS file_type FROM documents)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("image"), F.col("p_name").alias("file_name"), F.col("p_partkey").alias("ord"), "p_partkey")


UP = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def up(column: str) -> str:
    return UP.format(column)
