"""Command line over the operators: `python -m bytefleet.cli COMMAND ...`. Prints rows as tab-separated lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefleet.functions import scalars as X
from bytefleet.operators import compare, duplicates, integrity, listing, matching, rewrite, search
from bytefleet.sources import containers


def files_in(spark: SparkSession, folder: str, with_data: bool = True, depth: int | None = None, mask: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """All files of all containers under a folder, one row each, with image, path, name and payload as text of single-byte characters."""
    found = containers.scan(spark, folder)
    base = folder if folder.startswith("file:") else f"file:{folder}"
    if depth is not None:
        found = found.filter(listing.within_depth(F.col("path"), base, depth))
    if mask is not None:
        found = found.filter(listing.masked(X.base_name(F.col("path")), mask))
    if exclude:
        found = found.filter(~listing.excluded(F.col("path"), *exclude))
    packed = F.rlike("path", F.lit(r"(^|/)[1-6]!!?[^/]+$"))
    entries = containers.expand(found.filter(~packed)).unionByName(containers.unpacked_volumes(found.filter(packed)))
    rows = containers.parse(entries, with_data).withColumn("image", X.lineage(F.col("container"), F.when(F.col("entry") != X.base_name(F.col("container")), F.col("entry"))))
    return rows.withColumn("id", F.concat_ws("#", "image", "ord")).withColumn("path", F.when(F.col("file_path") == "", F.col("file_name")).otherwise(F.col("file_path")))


def contents(rows: DataFrame) -> DataFrame:
    """Rows with a payload, digested."""
    return rows.filter("ord >= 0 and data is not null").withColumn("digest", F.upper(F.sha2("data", 256))).withColumn("text", F.decode("data", "ISO-8859-1"))


def run_search(spark, a) -> DataFrame:
    rows = files_in(spark, a.folder).filter("ord >= 0 and data is not null").withColumn("text", F.decode("data", "ISO-8859-1"))
    if a.hex:
        from bytefleet.functions.text import hex_inside

        hits = rows.filter(hex_inside(F.col("data"), a.pattern))
    else:
        hits = search.search(rows, a.pattern, name="file_name", text="text", data="data", inside=a.inside, case_sensitive=a.case_sensitive, platforms=tuple(a.platform or ()))
    return hits.select("image", "path", "file_type", "size", F.upper(F.md5("data")).alias("md5"))


def run_catalog(spark, a) -> DataFrame:
    rows = files_in(spark, a.folder).filter("ord >= 0")
    return search.catalog(rows.filter("data is not null"), name="path")


def run_compare(spark, a) -> DataFrame:
    def side(folder: str) -> DataFrame:
        rows = files_in(spark, folder).filter("ord >= 0 and path not in ('/', '*BAM*')")
        return rows.select("path", F.col("file_name").alias("name"), F.col("file_type").alias("type"), "size", F.sha2("data", 256).alias("digest"))

    return compare.compare(side(a.first), side(a.second))


def run_match(spark, a) -> DataFrame:
    one, two = (contents(files_in(spark, p, depth=a.depth, mask=a.mask, exclude=tuple(a.exclude or ()))).withColumn("name", F.col("file_name")) for p in (a.first, a.second))
    return matching.classify(one, two, a.approximate, place="container", binary=True)


def run_duplicates(spark, a) -> DataFrame:
    one, two = (duplicates.digests(contents(files_in(spark, p)).withColumn("dir", X.directory(F.col("container"))).withColumn("place", F.concat_ws(":", "image", "path")), "place", "data", "dir") for p in (a.first, a.second))
    return duplicates.nearly_complete(one, two, a.over) if a.missing else duplicates.coverage(one, two)


def run_list(spark, a) -> DataFrame:
    rows = files_in(spark, a.folder, with_data=False).filter("ord >= 0")
    if a.below:
        rows = listing.subtree(rows, "path", a.below)
    if a.dir:
        return rows.select("image", listing.dir_lines(F.col("blocks"), F.col("file_name"), F.col("file_type")).alias("line"))
    return rows.filter("path not in ('/', '*BAM*')").select("image", listing.list_lines(F.col("path"), F.col("file_type")).alias("line"))


def _entries(spark, folder: str) -> DataFrame:
    return containers.expand(containers.scan(spark, folder))


def run_check(spark, a) -> DataFrame:
    entries = _entries(spark, a.folder)
    files = containers.parse(entries, with_data=False)
    used = containers.used_sectors(files)
    bam = containers.bitmaps(entries).select(F.concat_ws("@", "container", "entry").alias("image"), "track", "sector", "is_free")
    marks = integrity.allocation(bam, used)
    if a.bitmap:
        return marks.filter("mark in ('0', '#')")
    own = files.filter("ord >= 0 and file_path not in ('/', '*BAM*') and file_type not in ('DIR', 'CBM')")
    own = own.select(F.concat_ws("@", "container", "entry").alias("image"), F.col("file_path").alias("file"), "blocks")
    return integrity.file_issues(own, marks, used.filter("file not in ('/', '*BAM*')"))


def run_extract(spark, a) -> DataFrame:
    return rewrite.extracted(files_in(spark, a.folder).filter("ord >= 0"), a.target, a.with_type, F.regexp_replace(X.base_name(F.col("image")), r"\.[^.]*$", ""))


def run_lynx(spark, a) -> DataFrame:
    packed = rewrite.lynx_archives(files_in(spark, a.folder).filter("ord >= 0"))
    rows = packed.select(F.concat(X.base_name(F.col("image")), F.lit(".lnx")).alias("file_path"), F.col("content").alias("data"), F.lit(0).alias("ord"), F.lit("LNX").alias("file_type"))
    return rewrite.extracted(rows, a.target)


def run_change(spark, a) -> DataFrame:
    found = containers.scan(spark, a.folder)
    entries = containers.expand(found)
    if a.command == "insert":
        with open(a.file, "rb") as f:
            changed = rewrite.insert(entries, a.name, f.read(), a.type)
    elif a.command == "scratch":
        changed = rewrite.scratch(entries, a.name)
    else:
        changed = rewrite.repair_bitmap(entries)
    whole = rewrite.put_back(found, changed.filter("content is not null"))  # what can't be changed stays as it is
    rows = whole.select(X.base_name(F.col("path")).alias("file_path"), F.col("content").alias("data"), F.lit(0).alias("ord"), F.lit("IMG").alias("file_type"))
    return rewrite.extracted(rows, a.target)


def run_messages(spark, a) -> DataFrame:
    return search.messages(files_in(spark, a.folder, with_data=False))


def run_partitions(spark, a) -> DataFrame:
    return containers.partitions(spark, a.drive).select("number", "name", "type_name", X.long_hex(F.col("start")).alias("start"), "len")


def run_convert(spark, a) -> DataFrame:
    found = containers.scan(spark, a.folder)
    if a.unwrap:
        rows = rewrite.unwrapped(found).filter("ok").select(F.col("name").alias("file_path"), F.col("content").alias("data"), F.lit(0).alias("ord"), F.lit("PRG").alias("file_type"))
    else:
        made = rewrite.loose_files(containers.parse(containers.expand(found)).filter("ord >= 0"), as_p00=True)
        rows = made.select(F.col("target").alias("file_path"), F.col("content").alias("data"), F.lit(0).alias("ord"), F.lit("PRG").alias("file_type"))
    return rewrite.extracted(rows, a.target)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="bytefleet", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *places: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for place in places:
            p.add_argument(place)
        return p

    p = command("search", run_search, "folder", "pattern")
    p.add_argument("--inside", action="store_true")
    p.add_argument("--hex", action="store_true")
    p.add_argument("--case-sensitive", action="store_true")
    p.add_argument("--platform", action="append", choices=sorted(X.PLATFORMS))
    command("catalog", run_catalog, "folder")
    command("compare", run_compare, "first", "second")
    p = command("match", run_match, "first", "second")
    p.add_argument("--approximate", type=int)
    p.add_argument("--depth", type=int)
    p.add_argument("--mask")
    p.add_argument("--exclude", action="append")
    p = command("duplicates", run_duplicates, "first", "second")
    p.add_argument("--missing", action="store_true")
    p.add_argument("--over", type=int, default=95)
    p = command("list", run_list, "folder")
    p.add_argument("--dir", action="store_true")
    p.add_argument("--below")
    p = command("check", run_check, "folder")
    p.add_argument("--bitmap", action="store_true")
    p = command("extract", run_extract, "folder", "target")
    p.add_argument("--with-type", action="store_true")
    command("lynx", run_lynx, "folder", "target")
    p = command("insert", run_change, "folder", "target", "name", "file")
    p.add_argument("--type", default="PRG")
    command("scratch", run_change, "folder", "target", "name")
    command("repair", run_change, "folder", "target")
    command("messages", run_messages, "folder")
    p = command("partitions", run_partitions)
    p.add_argument("drive", nargs="+")
    p = command("convert", run_convert, "folder", "target")
    p.add_argument("--unwrap", action="store_true")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("bytefleet").getOrCreate()
    rows = a.run(spark, a)
    print("\t".join(rows.columns))
    for row in rows.toLocalIterator():  # a partition at a time: a report of any length fits
        print("\t".join("" if v is None else str(v) for v in row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
