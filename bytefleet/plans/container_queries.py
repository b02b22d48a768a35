"""Packers, loose files and archives over the driver's texts as payloads, each written and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from bytefleet.operators import rewrite
from bytefleet.plans.tables import table
from bytefleet.plans.views import documents
from bytefleet.sources import containers
from bytefleet.sources.formats import archives, volumes
from bytefleet.sources.formats.disk import Disk, formatted


def rle_roundtrip(spark, sf_dir):
    f = documents(spark, sf_dir).select("doc_id", "data", F.md5("data").alias("before"))
    back = rewrite.rle(rewrite.rle(f, "data"), "data", pack=False)
    return back.select("doc_id", (F.md5("data") == F.col("before")).alias("same"), F.octet_length("data").cast("bigint").alias("size"))


def p00_roundtrip(spark, sf_dir):
    f = documents(spark, sf_dir).withColumn("file_type", F.lit("PRG")).withColumn("raw_name", F.encode(F.upper(F.concat(F.lit("doc"), "doc_id")), "US-ASCII"))
    wrapped = rewrite.loose_files(f.withColumn("file_name", F.concat(F.lit("doc"), "doc_id")), as_p00=True)
    return rewrite.unwrapped(wrapped.withColumnRenamed("target", "path")).select("path", "name", "ok", F.octet_length("content").cast("bigint").alias("size"), F.md5("content").alias("md5"))


def lnx_roundtrip(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").filter("text is not null and text <> ''")
    f = t.select(F.col("conv_id").cast("string").alias("image"), F.col("turn").alias("ord"), F.encode(F.concat(F.lit("TURN"), F.col("turn").cast("string")), "US-ASCII").alias("raw_name"), F.lit("SEQ").alias("file_type"), F.encode("text", "UTF-8").alias("data"))
    packed = rewrite.lynx_archives(f).select(F.col("image").alias("container"), F.concat("image", F.lit(".lnx")).alias("entry"), "content", F.lit(None).cast("string").alias("error"))
    return containers.parse(packed).select(F.col("container").alias("image"), "file_name", "size", F.md5("data").alias("md5"))


_ENTRY = "container string, entry string, content binary, error string"


def _built(spark, sf_dir, build, ending):
    """One container for each conversation: its turns are the members. A conversation's turns meet in one group, as they do in the container."""

    def run(key, group):
        rows = group.sort_values("turn")
        members = [(f"TURN{t}", d.encode()) for t, d in zip(rows["turn"], rows["text"], strict=True)]
        return pd.DataFrame([(str(key[0]), f"{key[0]}{ending}", build(members), None)], columns=["container", "entry", "content", "error"])

    t = table(spark, sf_dir, "conversations").filter("text is not null and text <> ''").select("conv_id", "turn", "text")
    return t.groupBy("conv_id").applyInPandas(run, _ENTRY)


def _disk(members):
    image = formatted("D64")
    for name, data in members:
        image = Disk(image, "D64").inserted(name, data, "SEQ")
    return image


def _shown(files):
    return files.filter("data is not null").select(F.col("container").alias("image"), F.lower("file_name").alias("file_name"), "size", F.md5("data").alias("md5"))


def disk_roundtrip(spark, sf_dir):
    return _shown(containers.parse(_built(spark, sf_dir, _disk, ".d64")))


def disk_scratch(spark, sf_dir):
    return _shown(containers.parse(rewrite.scratch(_built(spark, sf_dir, _disk, ".d64"), "TURN0")))


def disk_free_blocks(spark, sf_dir):
    from bytefleet.operators import integrity

    bam = containers.bitmaps(_built(spark, sf_dir, _disk, ".d64")).withColumnRenamed("container", "image")
    return integrity.total_free(bam, skip=(18,))


def disk_check(spark, sf_dir):
    from bytefleet.operators import integrity

    entries = _built(spark, sf_dir, _disk, ".d64")
    bam = containers.bitmaps(entries).select(F.concat_ws("@", "container", "entry").alias("image"), "track", "sector", "is_free")
    return integrity.allocation_counts(integrity.allocation(bam, containers.used_sectors(containers.parse(entries, with_data=False))))


def arc_roundtrip(spark, sf_dir):
    return _shown(containers.parse(_built(spark, sf_dir, lambda m: archives.write_arc([(n.encode(), "SEQ", d) for n, d in m], 2), ".arc")))


def library_roundtrip(spark, sf_dir):
    return _shown(containers.parse(_built(spark, sf_dir, lambda m: archives.write_library([(n.encode(), "SEQ", d) for n, d in m]), ".lbr")))


def crunched_roundtrip(spark, sf_dir):
    return _shown(containers.parse(_built(spark, sf_dir, lambda m: b"".join(archives.write_wraptor(n.encode(), "SEQ", d) for n, d in m), ".wra")))


def volume_roundtrip(spark, sf_dir):
    disks = _built(spark, sf_dir, _disk, ".d64")

    def split(batches):
        for batch in batches:
            yield pd.DataFrame([(f"/{c}/{k}!disk", pack) for c, content in zip(batch["container"], batch["content"], strict=True) for k, pack in enumerate(volumes.pack_four(bytes(content)), 1)], columns=["path", "content"])

    packs = disks.select("container", "content").mapInPandas(split, "path string, content binary")
    whole = containers.unpacked_volumes(packs).withColumn("container", F.regexp_extract("container", "^/([^/]*)/", 1))
    return _shown(containers.parse(whole))


QUERIES = {f.__name__: f for f in (rle_roundtrip, p00_roundtrip, lnx_roundtrip, disk_roundtrip, disk_scratch, disk_free_blocks, disk_check, arc_roundtrip, library_roundtrip, crunched_roundtrip, volume_roundtrip)}
_TURNS = "SELECT CAST(conv_id AS VARCHAR) AS image, 'turn' || turn AS file_name, octet_length(encode(text)) AS size, md5(text) AS md5 FROM conversations WHERE text <> ''"
ORACLE_SQL = {
    "rle_roundtrip": "SELECT doc_id, true AS same, octet_length(encode(text)) AS size FROM documents",
    "p00_roundtrip": "SELECT 'doc' || doc_id || '.P00' AS path, 'doc' || doc_id AS name, true AS ok, octet_length(encode(text)) AS size, md5(text) AS md5 FROM documents",
    "lnx_roundtrip": _TURNS,
    "disk_roundtrip": _TURNS,
    "disk_scratch": _TURNS + " AND turn <> 0",
    "disk_free_blocks": "SELECT CAST(conv_id AS VARCHAR) AS image, CAST(664 - sum((octet_length(encode(text)) + 253) // 254) AS BIGINT) AS free FROM conversations WHERE text <> '' GROUP BY conv_id",
    "disk_check": "SELECT DISTINCT conv_id || '@' || conv_id || '.d64' AS image, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS under FROM conversations WHERE text <> ''",
    "arc_roundtrip": _TURNS,
    "library_roundtrip": _TURNS,
    "crunched_roundtrip": _TURNS,
    "volume_roundtrip": _TURNS,
}
