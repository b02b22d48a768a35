"""Comparing two containers file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytefleet.functions.text import ascii_upper


def _side(files: DataFrame, n: int) -> DataFrame:
    return files.select(*[F.col(c).alias(f"{c}{n}") for c in ("path", "name", "type", "size", "digest")])


def _alone(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files of either side whose path the other doesn't have."""
    return a.join(b, a["path1"] == b["path2"], "left_anti"), b.join(a, a["path1"] == b["path2"], "left_anti")


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """(kind, path1, path2, type1, type2, size1, size2) of two relations (path, name, type, size, digest).

    `differs`: the same path with other contents. `moved`: no such path on the other side, but a file of the same name (case
    aside) and contents that has none either. `missing1`, `missing2`: absent from the first or the second and not moved. Each finding once.
    """
    a, b = _side(first, 1), _side(second, 2)
    cols = ("path1", "path2", "type1", "type2", "size1", "size2")
    differs = a.join(b, a["path1"] == b["path2"]).filter(~F.col("digest1").eqNullSafe(F.col("digest2"))).select(F.lit("differs").alias("kind"), *cols)
    only1, only2 = _alone(a, b)
    same = (ascii_upper(F.col("name1")) == ascii_upper(F.col("name2"))) & F.col("digest1").eqNullSafe(F.col("digest2"))
    moved = only1.join(only2, same).select(F.lit("moved").alias("kind"), *cols)
    none = F.lit(None)
    missing2 = only1.join(only2, same, "left_anti").select(F.lit("missing2").alias("kind"), "path1", none.cast("string").alias("path2"), "type1", none.cast("string").alias("type2"), "size1", none.cast("bigint").alias("size2"))
    missing1 = only2.join(only1, same, "left_anti").select(F.lit("missing1").alias("kind"), none.cast("string").alias("path1"), "path2", none.cast("string").alias("type1"), "type2", none.cast("bigint").alias("size1"), "size2")
    return differs.unionByName(moved).unionByName(missing1).unionByName(missing2)


def moved_classes(first: DataFrame, second: DataFrame) -> DataFrame:
    """(side, path, type, size, class_path, links): the files that `compare` finds moved, one row for each file rather than each pair.

    Files of one name (case aside) and equal contents whose path the other side lacks are one class, named by the least path of
    the first side; links counts the class's files on the other side, at least one.
    """
    alone = zip((1, 2), _alone(_side(first, 1), _side(second, 2)), strict=True)
    one, two = (df.select(F.lit(n).alias("side"), *(F.col(f"{c}{n}").alias(c) for c in ("path", "type", "size", "digest")), ascii_upper(F.col(f"name{n}")).alias("key")) for n, df in alone)
    files, on = one.unionByName(two).filter("key is not null"), [F.col("side") == n for n in (1, 2)]
    counts = files.groupBy("key", "digest").agg(F.min(F.when(on[0], F.col("path"))).alias("class_path"), *(F.count_if(s).alias(f"n{k}") for k, s in enumerate(on, 1)))
    classes = counts.filter("n1 > 0 and n2 > 0").select(F.col("key").alias("class_key"), F.col("digest").alias("class_digest"), "class_path", "n1", "n2")
    same = (F.col("key") == F.col("class_key")) & F.col("digest").eqNullSafe(F.col("class_digest"))
    return files.join(classes, same).select("side", "path", "type", "size", "class_path", F.when(on[0], F.col("n2")).otherwise(F.col("n1")).alias("links"))
