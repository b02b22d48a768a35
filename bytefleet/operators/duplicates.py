"""Digest catalogues, groups of equal files, and how much of each directory is found elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefleet.functions.scalars import percent
from bytefleet.operators.ordinals import row_numbers


def digests(files: DataFrame, path: str, data: str, directory: str) -> DataFrame:
    """(path, dir, length, hash): what duplicate search needs of a file."""
    return files.select(F.col(path).alias("path"), F.col(directory).alias("dir"), F.octet_length(data).cast("bigint").alias("length"), F.upper(F.sha2(data, 256)).alias("hash"))


def write_catalog(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").parquet(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def refreshed(catalog: DataFrame, current: DataFrame, key: tuple[str, ...] = ("path", "modified", "length")) -> tuple[DataFrame, DataFrame]:
    """(rows of the catalogue that are still valid, current files that must be hashed anew): a file is known by path, time and length."""
    return catalog.join(current, list(key), "left_semi"), current.join(catalog, list(key), "left_anti")


def groups(catalog: DataFrame, least: int = 2) -> DataFrame:
    """(hash, length, n_files, first_path) of files that are there `least` times or more."""
    return catalog.groupBy("hash", "length").agg(F.count("*").alias("n_files"), F.min("path").alias("first_path")).filter(F.col("n_files") >= least)


def partners(probe: DataFrame, known: DataFrame) -> DataFrame:
    """Each probed file with the first equal file of the other side, if any: (path, dir, hash, length, partner)."""
    first = known.groupBy("hash", "length").agg(F.min("path").alias("partner"))
    return probe.join(first, ["hash", "length"], "left")


def coverage(probe: DataFrame, known: DataFrame) -> DataFrame:
    """(dir, total, matches, pct): how many of a directory's files are known by content and length."""
    return partners(probe, known).groupBy("dir").agg(F.count("*").alias("total"), F.count("partner").alias("matches")).withColumn("pct", percent(F.col("matches"), F.col("total")))


def nearly_complete(probe: DataFrame, known: DataFrame, over: int = 95) -> DataFrame:
    """(dir, path): the files that aren't known, in directories of which more than `over` percent are."""
    rows = partners(probe, known)
    pct = coverage(probe, known).filter(F.col("pct") > over).select("dir")
    return rows.filter(F.col("partner").isNull()).join(pct, "dir", "left_semi").select("dir", "path")


def unknown(probe: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose contents the other side doesn't have at all."""
    return probe.join(known, "hash", "left_anti")


def suffixed(rows: DataFrame, target: str, order: str) -> DataFrame:
    """target, or target with `_n` for the n-th further row of the same target."""
    n = F.col("_n") - 1
    return row_numbers(rows, target, order, "_n").withColumn("target", F.when(n == 0, F.col(target)).otherwise(F.concat(F.col(target), F.lit("_"), n.cast("string")))).drop("_n")
