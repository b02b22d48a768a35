"""Containers as relations: files on disk, their zip and gzip insides, and what the parsers make of them.

Everything is narrow: a scan, filters on path and length that reach the reader, one Arrow map. Bad input gives rows with an
error and never fails a task. Only packed volumes need a shuffle, as their siblings lie in several files.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytefleet.functions.scalars import SIZE_CAP
from bytefleet.sources import stores
from bytefleet.sources.formats import FormatError, archives, volumes
from bytefleet.sources.formats.disk import Disk
from bytefleet.sources.formats.geometry import image_type, loose_type

#: A member of a zip file that doesn't tell its size is read up to here.
MEMBER_CAP = 16_777_216
FILES = (
    "container string, entry string, image_type string, ord int, file_id bigint, parent_id bigint, file_path string, file_name string, raw_name binary, "
    "file_type string, blocks int, size bigint, data binary, header binary, dir_loc array<int>, sectors array<struct<track:int,sector:int>>, error string"
)
ENTRIES = "container string, entry string, content binary, error string"
BAM = "container string, entry string, track int, sector int, is_free boolean"
SECTORS = "container string, entry string, track int, sector int, data binary"
_DISKS = ("D64", "D71", "D81", "D80", "D82", "DNP")
_TAKEN = r"(?i)(\.(d64|d71|d81|d80|d82|dnp|t64|lnx|lbr|arc|sda|zc4|zc6|prg|seq|cvt|sfx|p00|s00|u00|r00|wra|wr3)(\.gz)?|,[sp]|\.zip|(^|/)[1-6]!!?[^/]+)$"


def scan(spark: SparkSession, path: str, recurse: bool = True, taken: str = _TAKEN, cap: int = SIZE_CAP) -> DataFrame:
    """(path, length, content) of files under a folder. Length is pushed into the reader, the name is tested before contents are passed on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recurse).lower()).load(path)
    return files.filter((F.col("length") <= cap) & F.rlike("path", F.lit(taken))).select("path", "length", "modificationTime", "content")


def expand(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(container, entry, content, error): a zip file's members, a gzip file's inside, or the file itself. Zips inside zips stay closed.

    A broken or oversized member gives a row with an error; the others are kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(name, *row) for row in _inside(name, bytes(data) if data is not None else b"")], columns=["container", "entry", "content", "error"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, ENTRIES)


def _inside(name: str, data: bytes) -> list[tuple[str, bytes | None, str | None]]:
    base = name.rsplit("/", 1)[-1]
    if base.lower().endswith(".zip"):
        out = []
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist():
                    if info.is_dir():
                        continue
                    try:
                        out.append(_unzipped(info.filename, _member(z, data, info)))
                    except Exception as e:  # noqa: BLE001 - any fault of one member is reported in its row
                        out.append((info.filename, None, str(e)))
        except (zipfile.BadZipFile, OSError, EOFError, ValueError, NotImplementedError, struct.error) as e:
            out.append((base, None, f"{type(e).__name__}: {e}"))
        return out
    return [_unzipped(base, data)]


def _member(z: zipfile.ZipFile, data: bytes, info: zipfile.ZipInfo) -> bytes:
    """A member's bytes, up to the size cap; of one that doesn't tell its size, what is there up to MEMBER_CAP."""
    if info.file_size > SIZE_CAP:
        raise FormatError("over the size cap")
    if info.file_size or not info.compress_size or info.compress_type != zipfile.ZIP_DEFLATED:
        return z.read(info)
    at = info.header_offset
    begin = at + 30 + int.from_bytes(data[at + 26 : at + 28], "little") + int.from_bytes(data[at + 28 : at + 30], "little")
    return zlib.decompressobj(-15).decompress(data[begin : begin + info.compress_size], MEMBER_CAP)


def inflated(data: bytes, cap: int = SIZE_CAP) -> bytes:
    """What a gzip file of one or more members holds; never more than the cap is inflated."""
    out, rest = bytearray(), data
    while rest:
        one = zlib.decompressobj(31)
        out += one.decompress(rest, cap + 1 - len(out))
        if len(out) > cap:
            raise FormatError("over the size cap")
        if not one.eof:
            raise FormatError("the packed file is cut short")
        rest = one.unused_data.lstrip(b"\x00")
    return bytes(out)


def _unzipped(entry: str, data: bytes) -> tuple[str, bytes | None, str | None]:
    if entry.lower().endswith(".gz"):
        try:
            return entry, inflated(data), None
        except (FormatError, zlib.error) as e:
            return entry, None, f"{type(e).__name__}: {e}"
    return entry, data, None


def members(name: str, content: bytes, with_data: bool = True) -> tuple[str | None, list[dict], list[str]]:
    """(type, files, errors) of one container, by the type that its name tells."""
    kind = image_type(name) or loose_type(name)
    base = name.lower().removesuffix(".gz")
    if kind is None and base[-4:-2] in (".p", ".s", ".u", ".r", ".d") and base[-2:].isdigit():
        return "P00", archives.read_p00(content, base), []
    if base.endswith((".wra", ".wr3")):
        return "WRA", archives.read_wraptor(content), []
    if kind in ("ARC", "SDA"):
        return kind, archives.read_arc(content), []
    readers: dict[str, Callable[[bytes], list[dict]]] = {"T64": archives.read_tape, "LNX": archives.read_lynx, "LBR": archives.read_library}
    if kind in readers:
        return kind, readers[kind](content), []
    if kind in ("D64", "D71", "D81", "D80", "D82", "DNP", "ZC4", "ZC6"):
        disk = Disk(content, kind)
        return kind, disk.files(with_data), disk.errors
    if kind in ("PRG", "SEQ", "CVT", "SFX"):
        return kind, archives.read_loose(content, name), []
    return None, [], ["unknown type"]


def parse(entries: DataFrame, with_data: bool = True) -> DataFrame:
    """FILES rows of expanded entries: the fact relation that search, matching and checks work on. Errors are rows with ord -1.

    `with_data=False` leaves payloads out, for listings.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for container, entry, content, error in zip(batch["container"], batch["entry"], batch["content"], batch["error"], strict=True):
                yield pd.DataFrame(_file_rows(container, entry, None if content is None else bytes(content), error, with_data), columns=[c.split(" ")[0] for c in _columns(FILES)])

    return entries.mapInPandas(run, FILES)


def _columns(ddl: str) -> list[str]:
    depth, out, now = 0, [], ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out, now = [*out, now.strip()], ""
        else:
            now += c
    return [*out, now.strip()]


def _file_rows(container: str, entry: str, content: bytes | None, error: str | None, with_data: bool) -> list[tuple]:
    def failed(text: str, kind: str | None = None) -> tuple:
        return (container, entry, kind, -1, None, None, None, None, None, None, None, None, None, None, None, None, text)

    if content is None:
        return [failed(error or "no content")]
    try:
        kind, found, errors = members(entry, content, with_data)
    except (FormatError, IndexError, ValueError, KeyError) as e:
        return [failed(f"{type(e).__name__}: {e}")]
    folders = {r["file_path"].rstrip("/"): k for k, r in enumerate(found) if r["file_type"] in ("DIR", "CBM")}
    rows = []
    for k, r in enumerate(found):
        parent = folders.get(r["file_path"].rsplit("/", 1)[0] if "/" in r["file_path"].strip("/") else "") if r["file_path"] not in ("*BAM*", "/") else None
        rows.append((container, entry, kind, k, k, parent, r["file_path"], r["file_name"], r["raw_name"], r["file_type"], r["blocks"], r["size"], r["data"], r["header"], [int(x) for x in r["dir_loc"]], [{"track": t, "sector": s} for t, s in r["sectors"]], None))
    return rows + [failed(e, kind) for e in errors]


def bitmaps(entries: DataFrame) -> DataFrame:
    """BAM rows: every sector of each disk image and whether it is free."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for container, entry, content in zip(batch["container"], batch["entry"], batch["content"], strict=True):
                if (disk := _disk(entry, content)) is not None:
                    yield pd.DataFrame([(container, entry, *row) for row in disk.bam()], columns=["container", "entry", "track", "sector", "is_free"])

    return entries.mapInPandas(run, BAM)


def _disk(entry: str, content: bytes | None) -> Disk | None:
    """The disk that an entry holds; None for others, and for images that can't be one (parse reports them)."""
    kind = image_type(entry)
    try:
        return Disk(bytes(content), kind) if content is not None and kind in _DISKS else None
    except FormatError:
        return None


def sectors(entries: DataFrame) -> DataFrame:
    """SECTORS rows: every sector of each disk image with its bytes, in the order of tracks and sectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for container, entry, content in zip(batch["container"], batch["entry"], batch["content"], strict=True):
                if (disk := _disk(entry, content)) is not None:
                    rows = [(container, entry, t, s, disk.sector(t, s)) for t, n in enumerate(disk.geometry.sectors, 1) for s in range(n)]
                    yield pd.DataFrame(rows, columns=["container", "entry", "track", "sector", "data"])

    return entries.mapInPandas(run, SECTORS)


def flat(entries: DataFrame) -> DataFrame:
    """(container, entry, content): a disk's bytes in the order of tracks and sectors, as long as its geometry says; others as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            disks = [_disk(e, c) for e, c in zip(batch["entry"], batch["content"], strict=True)]
            yield batch[["container", "entry"]].assign(content=[c if d is None else d.content[: d.geometry.size] for d, c in zip(disks, batch["content"], strict=True)])

    return entries.select("container", "entry", "content").mapInPandas(run, "container string, entry string, content binary")


def used_sectors(files: DataFrame) -> DataFrame:
    """(image, file, track, sector) of parsed files, for the integrity operators."""
    return files.filter("ord >= 0").select(F.concat_ws("@", "container", "entry").alias("image"), F.col("file_path").alias("file"), F.explode("sectors").alias("s")).select("image", "file", "s.track", "s.sector")


def unpacked_volumes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """ENTRIES rows of the sets of four or six volumes `1!name`...: siblings of one folder and name are brought together.

    A set has at most six files, so a group is small whatever the table's size. A set that lacks a volume or holds a bad one is a row with an error.
    """
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    rows = files.withColumn("_name", name).filter(F.rlike("_name", F.lit(r"^[1-6]!!?.+")))
    rows = rows.select(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1).alias("folder"), F.expr("substring(_name, 2)").alias("rest"), F.substring("_name", 1, 1).cast("int").alias("n"), F.col(content).alias("content"))

    def unpack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        folder, rest = key
        image, error = None, None
        try:
            packs = [bytes(c) for c in group.sort_values("n")["content"]]
            image = volumes.unpack_six(packs) if rest.startswith("!!") else volumes.unpack_four(packs)
        except (FormatError, IndexError, ValueError, TypeError) as e:
            error = f"{type(e).__name__}: {e}"
        return pd.DataFrame([(f"{folder}1{rest}", rest.lstrip("!") + ".d64", image, error)], columns=["container", "entry", "content", "error"])

    return rows.groupBy("folder", "rest").applyInPandas(unpack, ENTRIES)


def partitions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, number, name, type, type_name, start, len) of raw drives in any store; a drive without a table has no rows. Only the table's bytes are read, as drives exceed what one value holds."""
    size, table = 2 + 256 * 32, volumes.TABLE
    found = spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(lambda batches: (_drive_rows(b, table, size) for b in batches), "path string, number int, name string, type int, type_name string, start bigint, len bigint")
    return found


def _drive_rows(batch: pd.DataFrame, at: int, size: int) -> pd.DataFrame:
    rows = []
    for path in batch["path"]:
        try:
            rows += [{"path": path, **p} for p in volumes.read_partitions(stores.read_part(path, at, size))]
        except FormatError:
            continue
    return pd.DataFrame(rows, columns=["path", "number", "name", "type", "type_name", "start", "len"])


def partition_table(drives: DataFrame) -> DataFrame:
    """(path, number, name, type, type_name, start, len) of drives that are held as (path, content); a drive without a table has no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, table in zip(batch["path"], batch["table"], strict=True):
                try:
                    rows += [{"path": path, **p} for p in volumes.read_partitions(bytes(table or b""))]
                except FormatError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "number", "name", "type", "type_name", "start", "len"])

    tables = drives.select("path", F.substring("content", volumes.TABLE + 1, 2 + 256 * 32).alias("table"))
    return tables.mapInPandas(run, "path string, number int, name string, type int, type_name string, start bigint, len bigint")


def partition_bytes(drives: DataFrame) -> DataFrame:
    """(path, number, file_name, content) of drives that are held as (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                parts = volumes.read_partitions(bytes(content)[volumes.TABLE : volumes.TABLE + 2 + 256 * 32])
                yield pd.DataFrame([(path, p["number"], volumes.partition_file(p), bytes(content)[p["start"] : p["start"] + p["len"]]) for p in parts], columns=["path", "number", "file_name", "content"])

    return drives.select("path", "content").mapInPandas(run, "path string, number int, file_name string, content binary")
