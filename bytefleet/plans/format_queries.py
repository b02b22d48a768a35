"""Sources, sinks and changes that read back what they wrote, and the byte rules that they rest on, over the driver's tables."""

from __future__ import annotations

import gzip
import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from bytefleet.functions import scalars as X
from bytefleet.operators import duplicates, listing, matching, rewrite, search
from bytefleet.plans.container_queries import _TURNS, _built, _disk, _shown
from bytefleet.plans.tables import table
from bytefleet.plans.views import DOCUMENTS_SQL, documents
from bytefleet.sources import containers
from bytefleet.sources.formats import archives, volumes
from bytefleet.sources.formats.disk import TYPES, Disk, formatted

# zip and gzip


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (name, data) in enumerate(members):
            z.writestr(f"{name}.seq.gz" if k % 2 else f"{name}.seq", gzip.compress(data, mtime=0) if k % 2 else data)
    return out.getvalue()


def _expanded(spark, sf_dir, build):
    return containers.expand(_built(spark, sf_dir, build, ".zip"), path="entry")


def _conversation(files):
    return files.withColumn("container", F.regexp_extract("container", r"^(-?\d+)\.", 1))


def zip_roundtrip(spark, sf_dir):
    return _shown(_conversation(containers.parse(_expanded(spark, sf_dir, _zip))))


def zip_listing(spark, sf_dir):
    rows = _conversation(_expanded(spark, sf_dir, _zip))
    return rows.select(F.col("container").alias("image"), F.regexp_replace("entry", r"\.seq(\.gz)?$", "").alias("member"), F.octet_length("content").cast("bigint").alias("size"), F.col("error").isNull().alias("ok"))


def _zipped_disk(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("notes.seq", b"kept as it is")
        z.writestr("disk.d64", _disk(members))
    return out.getvalue()


def zip_changed(spark, sf_dir):
    files = _built(spark, sf_dir, _zipped_disk, ".zip").select(F.col("entry").alias("path"), "content")
    changed = rewrite.scratch(containers.expand(files).filter("entry = 'disk.d64'"), "TURN0")
    return _shown(_conversation(containers.parse(containers.expand(rewrite.put_back(files, changed)))))


# tapes and loose files


def _tape(members):
    return archives.write_tape([(name, 0x4141, data) for name, data in members])


def tape_roundtrip(spark, sf_dir):
    return _shown(containers.parse(_built(spark, sf_dir, _tape, ".t64")))


def tape_scratch(spark, sf_dir):
    return _shown(containers.parse(rewrite.scratch(_built(spark, sf_dir, _tape, ".t64"), "/TURN0")))


def tape_insert(spark, sf_dir):
    return _shown(containers.parse(rewrite.insert(_built(spark, sf_dir, _tape, ".t64"), "EXTRA", b"AAfurther", "PRG")))


def loose_roundtrip(spark, sf_dir):
    f = documents(spark, sf_dir).select(F.lit("folder").alias("container"), F.concat(F.lit("Doc"), "doc_id", F.lit(".seq")).alias("entry"), F.col("data").alias("content"), F.lit(None).cast("string").alias("error"))
    return containers.parse(f).select("file_name", "file_type", "size", F.md5("data").alias("md5"))


# disks


def disk_replace(spark, sf_dir):
    return _shown(containers.parse(rewrite.insert(_built(spark, sf_dir, _disk, ".d64"), "TURN0", b"new contents", "SEQ")))


def _cpm(members):
    image = bytearray(formatted("D64", "CP/M PLUS", "65 2A"))
    image[:3] = b"CBM"
    disk = Disk(bytes(image), "D64")
    for place in disk._units("NORMAL")[0]:
        at = disk.geometry.offset(*place)
        image[at : at + 256] = b"\xe5" * 256
    out = bytes(image)
    for name, data in members:
        out = Disk(out, "D64").inserted(name, data)
    return out


def cpm_roundtrip(spark, sf_dir):
    return _shown(containers.parse(_built(spark, sf_dir, _cpm, ".d64")))


def _with_side(members, kind, side, record):
    """A disk whose files each have a sector of their own beside their chain, named in their entry."""
    image = _disk(members)
    for name, _ in members:
        disk = Disk(image, "D64")
        place, row = disk.free_sectors(1)[0], disk.find(name)
        out = bytearray(disk.with_allocation([place], free=False))
        at = disk.geometry.offset(*place)
        out[at : at + 256] = side.ljust(256, b"\x00")
        track, sector, offset = row["dir_loc"]
        entry = disk.geometry.offset(track, sector) + offset
        out[entry] = 128 | TYPES.index(kind)
        out[entry + 19 : entry + 22] = bytes([*place, record])
        image = bytes(out)
    return image


def relative_roundtrip(spark, sf_dir):
    files = containers.parse(_built(spark, sf_dir, lambda m: _with_side(m, "REL", bytes([0, 255, 0, 40]), 40), ".d64"))
    return _shown(files.filter("file_type = 'REL'"))


def geos_roundtrip(spark, sf_dir):
    files = containers.parse(_built(spark, sf_dir, lambda m: _with_side(m, "USR", b"\x00\xff" + b"info" * 60, 0), ".d64")).filter("data is not null")
    tail = F.expr("substring(data, 509)")
    return files.select(F.col("container").alias("image"), F.lower("file_name").alias("file_name"), F.octet_length(tail).cast("bigint").alias("size"), F.md5(tail).alias("md5"), X.is_geos(F.col("file_name"), F.concat("data", F.lit(b"....."))).alias("geos"))


def disk_flat(spark, sf_dir):
    entries = _built(spark, sf_dir, _disk, ".d64")
    whole = containers.flat(entries).select("container", F.octet_length("content").cast("bigint").alias("size"), F.md5("content").alias("after"))
    return whole.join(entries.select("container", F.md5("content").alias("before")), "container").select(F.col("container").alias("image"), "size", (F.col("before") == F.col("after")).alias("same"))


def disk_sectors(spark, sf_dir):
    rows = containers.sectors(_built(spark, sf_dir, _disk, ".d64"))
    return rows.groupBy(F.col("container").alias("image"), "track").agg(F.count("*").alias("sectors"), F.sum(F.octet_length("data")).cast("bigint").alias("size"))


def image_messages(spark, sf_dir):
    f = documents(spark, sf_dir).select(F.col("image").alias("container"), F.concat("doc_id", F.lit(".d64")).alias("entry"), F.col("data").alias("content"), F.lit(None).cast("string").alias("error"))
    return search.messages(containers.parse(f, with_data=False)).filter("message like 'the image is %'")


def six_volumes(spark, sf_dir):
    """One disk a region, with its nations as files, as six volumes."""

    def build(key, group):
        image = formatted("D64")
        for n, name in sorted(zip(group["n_nationkey"], group["n_name"], strict=True)):
            image = Disk(image, "D64").inserted(f"N{n}", name.encode(), "SEQ")
        return pd.DataFrame([(f"/{key[0]}/{k}!!disk", pack) for k, pack in enumerate(volumes.pack_six(image), 1)], columns=["path", "content"])

    packs = table(spark, sf_dir, "nation").groupBy("n_regionkey").applyInPandas(build, "path string, content binary")
    return _shown(containers.parse(containers.unpacked_volumes(packs)).withColumn("container", F.regexp_extract("container", "^/([^/]*)/", 1)))


# partitioned drives


def _drives(spark, sf_dir):
    """One drive a region; each nation is a partition of one block that begins with its name."""

    def build(key, group):
        rows = sorted(zip(group["n_nationkey"].tolist(), group["n_name"], strict=True))
        out = bytearray(512 * 900)
        out[volumes.TABLE : volumes.TABLE + 2 + 256 * 32] = volumes.write_partitions([(n, name[:16], 1, 512 * (600 + n), 512) for n, name in rows])
        for n, name in rows:
            out[512 * (600 + n) : 512 * (601 + n)] = name.encode().ljust(512)
        return pd.DataFrame([(f"drive{key[0]}", bytes(out))], columns=["path", "content"])

    return table(spark, sf_dir, "nation").groupBy("n_regionkey").applyInPandas(build, "path string, content binary")


def drive_partitions(spark, sf_dir):
    return containers.partition_table(_drives(spark, sf_dir)).select("path", F.col("number").cast("bigint").alias("number"), "name", "type_name", "start", "len")


def drive_extract(spark, sf_dir):
    return containers.partition_bytes(_drives(spark, sf_dir)).select("path", F.col("number").cast("bigint").alias("number"), "file_name", F.md5("content").alias("md5"))


def drive_replace(spark, sf_dir):
    new = table(spark, sf_dir, "nation").select(F.concat("n_nationkey", F.lit("_"), F.lower(F.substring("n_name", 1, 16)), F.lit(".dnp")).alias("file_name"), F.encode(F.rpad(F.reverse("n_name"), 512, "."), "UTF-8").alias("content"))
    back = rewrite.replaced_partitions(_drives(spark, sf_dir), new)
    return containers.partition_bytes(back.filter("error is null")).select("path", "file_name", F.md5("content").alias("md5"))


# rules over bytes and names


def petscii_codes(spark, sf_dir):
    name = F.col("s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.petscii_to_ascii(F.encode(name, "US-ASCII")).alias("shown"), F.hex(X.ascii_to_petscii(name)).alias("stored"), (X.petscii_to_ascii(X.ascii_to_petscii(name)) == name).alias("same"))


def padded_names(spark, sf_dir):
    k = (F.col("p_partkey") % 3).cast("int")
    padded = F.concat(F.encode("p_name", "UTF-8"), F.unhex(F.repeat(F.lit("A0"), k)), F.unhex(F.repeat(F.lit("00"), k)))
    stem = F.rpad(F.substring("p_name", 1, 8), 8, " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.decode(X.trim_padding(padded), "UTF-8").alias("disk"),
        F.decode(X.trim_padding(F.concat(padded, F.unhex(F.repeat(F.lit("20"), k))), tape=True), "UTF-8").alias("tape"),
        X.name_83(F.encode(F.concat(stem, F.lit("EXT")), "US-ASCII")).alias("short"),
        F.decode(X.from_hex(X.to_hex(padded)), "ISO-8859-1").substr(F.lit(1), F.char_length("p_name")).alias("back"),
    )


def geos_detect(spark, sf_dir):
    f = documents(spark, sf_dir).withColumn("name", F.concat(F.lit("file"), F.when(F.col("lang") == "fr", ".CVT").otherwise(".prg")))
    return f.filter(X.is_geos(F.col("name"), F.col("data"))).select("doc_id")


def geos_normalized(spark, sf_dir):
    return documents(spark, sf_dir).filter(F.octet_length("data") >= 254).select("doc_id", F.md5(X.normalize_geos(F.col("data"))).alias("md5"))


def geos_matches(spark, sf_dir):
    f = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat("doc_id", F.lit(".cvt")).alias("name"), "data")
    return matching.geos_equal(f, f.withColumn("data", F.concat(F.overlay("data", F.lit(b"X"), F.lit(2)), F.lit(b"zz"))))


def uniform_fill(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.filled(F.encode(F.substring("p_name", 1, 2), "UTF-8")).alias("uniform"))


def present_files(spark, sf_dir):
    f = documents(spark, sf_dir).withColumn("data", F.when(F.col("lang") != "es", F.col("data")))
    return search.present(f).select("doc_id")


def refreshed_catalog(spark, sf_dir):
    c = duplicates.digests(documents(spark, sf_dir).withColumn("path", F.col("doc_id").cast("string")), "path", "data", "image").withColumn("modified", F.lit(1))
    now = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("lang") == "es", 2).otherwise(1).alias("modified"), F.octet_length("data").cast("bigint").alias("length"))
    valid, anew = duplicates.refreshed(c, now)
    return valid.select("path", F.lit("valid").alias("state")).unionByName(anew.select("path", F.lit("anew").alias("state")))


def match_other_places(spark, sf_dir):
    f = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("image").alias("place"), F.sha2("data", 256).alias("digest"), F.col("file_name").alias("name"), "text")
    return matching.classify(f, f, place="place").select("id1", "id2", "label")


def distinct_report(spark, sf_dir):
    f = documents(spark, sf_dir)
    return listing.distinct_lines(f.withColumn("line", F.concat_ws(" ", "image", "file_type")), "line")


QUERIES = {
    f.__name__: f
    for f in (zip_roundtrip, zip_listing, zip_changed, tape_roundtrip, tape_scratch, tape_insert, loose_roundtrip, disk_replace, cpm_roundtrip, relative_roundtrip, geos_roundtrip, disk_flat, disk_sectors, image_messages, six_volumes, drive_partitions, drive_extract, drive_replace, petscii_codes, padded_names, geos_detect, geos_normalized, geos_matches, uniform_fill, present_files, refreshed_catalog, match_other_places, distinct_report)
}
_SAID = "FROM conversations WHERE text <> ''"
_IMAGE = "CAST(conv_id AS VARCHAR) AS image"
_TAPES = f"SELECT {_IMAGE}, 'turn' || turn AS file_name, octet_length(encode(text)) + 1 AS size, md5('AA' || text) AS md5 {_SAID}"
_NATION = "'drive' || n_regionkey AS path"
_FILE = "n_nationkey || '_' || lower(left(n_name, 16)) || '.dnp' AS file_name"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = {
    "zip_roundtrip": _TURNS,
    "zip_listing": f"SELECT {_IMAGE}, 'TURN' || turn AS member, octet_length(encode(text)) AS size, true AS ok {_SAID}",
    "zip_changed": f"{_TURNS} AND turn <> 0 UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 'notes', CAST(13 AS BIGINT), md5('kept as it is') {_SAID} AND conv_id IN (SELECT conv_id {_SAID} AND turn = 0)",
    "tape_roundtrip": _TAPES,
    "tape_scratch": f"{_TAPES} AND turn <> 0",
    "tape_insert": f"{_TAPES} UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 'extra', CAST(8 AS BIGINT), md5('AAfurther') {_SAID}",
    "loose_roundtrip": "SELECT 'Doc' || doc_id AS file_name, 'SEQ' AS file_type, octet_length(encode(text)) AS size, md5(text) AS md5 FROM documents",
    "disk_replace": f"{_TURNS} AND turn <> 0 UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 'turn0', CAST(12 AS BIGINT), md5('new contents') {_SAID}",
    "cpm_roundtrip": f"SELECT {_IMAGE}, 'turn' || turn || '.' AS file_name, octet_length(encode(text)) + (128 - octet_length(encode(text)) % 128) % 128 AS size, md5(text || repeat(chr(26), CAST((128 - octet_length(encode(text)) % 128) % 128 AS INTEGER))) AS md5 {_SAID}",
    "relative_roundtrip": _TURNS,
    "geos_roundtrip": f"SELECT {_IMAGE}, 'turn' || turn AS file_name, octet_length(encode(text)) AS size, md5(text) AS md5, true AS geos {_SAID}",
    "disk_flat": f"SELECT DISTINCT {_IMAGE}, CAST(174848 AS BIGINT) AS size, true AS same {_SAID}",
    "disk_sectors": f"SELECT image, CAST(track AS INTEGER) AS track, n AS sectors, n * 256 AS size FROM (SELECT DISTINCT {_IMAGE} {_SAID}), (SELECT t AS track, CAST(CASE WHEN t <= 17 THEN 21 WHEN t <= 24 THEN 19 WHEN t <= 30 THEN 18 ELSE 17 END AS BIGINT) AS n FROM range(1, 36) r(t))",
    "image_messages": "SELECT 'the image is ' || (174848 - octet_length(encode(text))) || ' bytes short' AS message, count(*) AS n FROM documents WHERE octet_length(encode(text)) < 174848 GROUP BY 1",
    "six_volumes": "SELECT CAST(n_regionkey AS VARCHAR) AS image, 'n' || n_nationkey AS file_name, octet_length(encode(n_name)) AS size, md5(n_name) AS md5 FROM nation",
    "drive_partitions": f"SELECT {_NATION}, CAST(n_nationkey AS BIGINT) AS number, lower(left(n_name, 16)) AS name, 'DNP' AS type_name, CAST(512 * (600 + n_nationkey) AS BIGINT) AS start, CAST(512 AS BIGINT) AS len FROM nation",
    "drive_extract": f"SELECT {_NATION}, CAST(n_nationkey AS BIGINT) AS number, {_FILE}, md5(rpad(n_name, 512, ' ')) AS md5 FROM nation",
    "drive_replace": f"SELECT {_NATION}, {_FILE}, md5(rpad(reverse(n_name), 512, '.')) AS md5 FROM nation",
    "petscii_codes": f"SELECT s_suppkey, translate(s_name, '{_UPPER}{_LOWER}', '{_LOWER}{_UPPER}') AS shown, array_to_string(list_transform(list_transform(range(1, length(s_name) + 1), lambda k: ascii(substr(s_name, k, 1))), lambda a: printf('%02X', CASE WHEN a BETWEEN 65 AND 90 THEN a + 128 WHEN a BETWEEN 97 AND 122 THEN a - 32 ELSE a END)), '') AS stored, true AS same FROM supplier",
    "padded_names": "SELECT p_partkey, p_name AS disk, p_name AS tape, rtrim(left(p_name, 8)) || '.EXT' AS short, p_name AS back FROM part",
    "geos_detect": "SELECT doc_id FROM documents WHERE octet_length(encode(text)) > 512 AND (lang = 'fr' OR substr(hex(encode(text)), 67, 50) = hex(encode(' formatted GEOS file V1.0')))",
    "geos_normalized": "WITH d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE octet_length(encode(text)) >= 254) SELECT doc_id, md5(unhex(left(h, 2) || '0000' || substr(h, 7, 32) || '0000' || substr(h, 43, 18) || '505247' || substr(h, 67, 54) || repeat('00', 194) || substr(h, 509))) AS md5 FROM d",
    "geos_matches": """WITH d AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents), a AS (SELECT doc_id AS id1, h AS ha, n AS na FROM d WHERE n > 512), b AS (SELECT doc_id AS id2, h || '7A7A' AS hb, n + 2 AS nb FROM d WHERE n + 2 > 512),
j AS (SELECT *, least(na, nb) AS s, CASE WHEN na > nb THEN substr(ha, 2 * nb + 1) ELSE substr(hb, 2 * na + 1) END AS tail FROM a JOIN b ON substr(ha, 509, 508) = substr(hb, 509, 508))
SELECT id1, id2 FROM j WHERE abs(na - nb) < 257 AND substr(ha, 509, 2 * (s - 254)) = substr(hb, 509, 2 * (s - 254)) AND tail = repeat(left(tail, 2), CAST(length(tail) // 2 AS INTEGER))""",
    "uniform_fill": "SELECT p_partkey, left(p_name, 1) = substr(p_name, 2, 1) AS uniform FROM part",
    "present_files": "SELECT doc_id FROM documents WHERE lang <> 'es' AND text IS NOT NULL",
    "refreshed_catalog": "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN lang = 'es' THEN 'anew' ELSE 'valid' END AS state FROM documents",
    "match_other_places": f"WITH {DOCUMENTS_SQL} SELECT a.doc_id AS id1, b.doc_id AS id2, 'MATCH' AS label FROM f a JOIN f b ON a.text = b.text AND a.image <> b.image WHERE octet_length(a.data) > 0",
    "distinct_report": "SELECT DISTINCT source || ' ' || coalesce(lang, '') AS line FROM documents",
}
