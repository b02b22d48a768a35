"""Listings, path lookup, subtrees and the ordered repairs of directories."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytefleet.functions.scalars import pad_right
from bytefleet.functions.text import ascii_lower, ascii_upper
from bytefleet.operators.lineage import cut
from bytefleet.operators.ordinals import running_sums


def list_lines(path: Column, kind: Column) -> Column:
    """`path,t`: the first letter of the type."""
    return F.concat_ws(",", path, F.substring(ascii_lower(kind), 1, 1))


def dir_lines(blocks: Column, name: Column, kind: Column) -> Column:
    """Blocks to five places, the quoted name to 24, the type."""
    return F.concat(pad_right(blocks.cast("string"), 5), pad_right(F.concat(F.lit('"'), name, F.lit('"')), 24), ascii_lower(kind))


def lookup(files: DataFrame, path: str, wanted: str, partition: str | None = None) -> DataFrame:
    """The file with the path, exact before case-insensitive, one for each partition (or in all)."""
    hits = files.filter(ascii_upper(F.col(path)) == F.lit(wanted.upper()))
    order = [(F.col(path) == wanted).desc(), F.col(path)]
    if partition is None:
        return hits.orderBy(*order).limit(1)
    return hits.withColumn("_rank", F.row_number().over(Window.partitionBy(partition).orderBy(*order))).filter("_rank = 1").drop("_rank")


def subtree(files: DataFrame, path: str, root: str) -> DataFrame:
    """All below a directory, at any depth."""
    return files.filter(F.startswith(F.col(path), F.lit(root.rstrip("/") + "/")))


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth) below the roots along (node, parent), by one join for each level; a node is reached once, so cycles end.

    Each level is checkpointed, so that a level costs its own join alone however deep the tree is.
    """
    found = front = cut(roots.select("node", F.lit(0).alias("depth")))
    for depth in count(1):
        front = cut(edges.join(front.select(F.col("node").alias("parent")), "parent").select("node").distinct().join(found, "node", "left_anti").select("node", F.lit(depth).alias("depth")))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def within_depth(path: Column, base: str, depth: int) -> Column:
    """At most `depth` directories below the base."""
    rest = F.substr(path, F.lit(len(base.rstrip("/")) + 2))
    return F.startswith(path, F.lit(base.rstrip("/") + "/")) & (F.size(F.split(rest, "/")) - 1 <= depth)


def masked(name: Column, mask: str) -> Column:
    """The whole name matches a regular expression."""
    return F.rlike(name, F.lit(f"^(?:{mask})$"))


def excluded(path: Column, *masks: str) -> Column:
    """Some mask is found anywhere in the path."""
    hit = F.lit(False)
    for mask in masks:
        hit = hit | F.rlike(path, F.lit(mask))
    return hit


def glob(name: Column, mask: str) -> Column:
    """`*` and `?` masks, case aside."""
    import re

    return F.rlike(ascii_upper(name), F.lit("(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in mask.upper()) + "$"))


def repaired_ends(entries: DataFrame, group: str, start: str, end: str, size: Column, broken: int = 50118) -> DataFrame:
    """Entries with a known bad end address end where the next distinct start begins, the last ones at the file's size; ends count inclusively."""
    starts = entries.select(group, start).distinct().withColumn("_next", F.lead(start).over(Window.partitionBy(group).orderBy(start)))
    joined = entries.join(starts, [group, start])
    fixed = F.when(F.col(end) == broken, F.coalesce(F.col("_next") - 1, size - 1)).otherwise(F.col(end))
    return joined.withColumn("end_fixed", fixed).drop("_next")


def offsets(entries: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """Where each member of a solid archive begins: the sizes before it."""
    return running_sums(entries, group, order, {"offset": F.col(size).cast("bigint")}, before=True)


def report_order(rows: DataFrame, *columns: str) -> DataFrame:
    """By columns with case folded."""
    return rows.orderBy(*[ascii_lower(F.col(c)) for c in columns])


def distinct_lines(rows: DataFrame, line: str) -> DataFrame:
    """Each line of a report once."""
    return rows.select(line).filter(F.col(line).isNotNull()).distinct()


def unused(total: DataFrame, used: DataFrame) -> DataFrame:
    """Blocks that no extent has."""
    return total.join(used, "block", "left_anti")
