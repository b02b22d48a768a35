"""Changes and sinks. Inputs are never written to: each operator gives new contents as rows, or writes new files."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytefleet.operators.duplicates import suffixed
from bytefleet.sources import stores
from bytefleet.sources.formats import FormatError, archives, volumes
from bytefleet.sources.formats.disk import Disk
from bytefleet.sources.formats.geometry import ARCHIVES, image_type, loose_type

CHANGED = "container string, entry string, content binary, error string"


def _changed(images: DataFrame, change, change_tape=None) -> DataFrame:
    """Each disk and tape changed; what can't be changed, such as an archive, a loose file or a broken member, has an error."""

    def one(entry: str, content: bytes | None, error: str | None) -> bytes:
        kind = image_type(entry)
        if content is None:
            raise FormatError(error or "no content")
        if kind == "T64" and change_tape:
            return change_tape(bytes(content))
        if kind in ARCHIVES or kind is None and loose_type(entry):
            raise FormatError(f"no such change of {kind or loose_type(entry)}")
        return change(Disk(bytes(content), kind or "D64"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for container, entry, content, error in zip(batch["container"], batch["entry"], batch["content"], batch["error"], strict=True):
                try:
                    rows.append((container, entry, one(entry, content, error), None))
                except FormatError as e:
                    rows.append((container, entry, None, str(e)))
                except (IndexError, ValueError, KeyError) as e:
                    rows.append((container, entry, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["container", "entry", "content", "error"])

    error = F.col("error") if "error" in images.columns else F.lit(None).cast("string").alias("error")
    return images.select("container", "entry", "content", error).mapInPandas(run, CHANGED)


def insert(images: DataFrame, name: str, data: bytes, kind: str = "PRG") -> DataFrame:
    """Each disk and tape with a further file; one without room has an error."""
    return _changed(images, lambda disk: disk.inserted(name, data, kind), lambda tape: archives.tape_inserted(tape, name, data, kind))


def scratch(images: DataFrame, path: str) -> DataFrame:
    return _changed(images, lambda disk: disk.scratched(path), lambda tape: archives.tape_scratched(tape, path))


def repair_bitmap(images: DataFrame, allocate: bool = True, free: bool = True) -> DataFrame:
    """Each image with its bitmap as its files use it."""

    def change(disk: Disk) -> bytes:
        used = {s for r in disk.files(False) for s in r["sectors"]}
        state = {(t, s): is_free for t, s, is_free in disk.bam()}
        missing = [s for s in sorted(used) if state.get(s)] if allocate else []
        extra = [s for s, is_free in state.items() if not is_free and s not in used] if free else []
        return Disk(Disk(disk.with_allocation(missing, free=False), disk.kind).with_allocation(extra, free=True), disk.kind).content

    return _changed(images, change)


def lynx_archives(files: DataFrame, image: str = "image") -> DataFrame:
    """(image, content, n_files): all files of an image that have a name and data as one archive. An image's files meet in one group, as in the archive."""

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("ord")
        members = [(bytes(n), t, bytes(d)) for n, t, d in zip(rows["raw_name"], rows["file_type"], rows["data"], strict=True)]
        return pd.DataFrame([(key[0], archives.write_lynx(members), len(members))], columns=["image", "content", "n_files"])

    rows = files.filter((F.octet_length("data") > 0) & (F.octet_length("raw_name") > 0)).select(F.col(image).alias("image"), "ord", "raw_name", "file_type", "data")
    return rows.groupBy("image").applyInPandas(pack, "image string, content binary, n_files bigint")


def loose_files(files: DataFrame, as_p00: bool, order: str = "ord") -> DataFrame:
    """(target, content): files as raw or as P00 files; names that meet get `_n`."""
    ending = F.when(F.col("file_type") == "SEQ", "S00" if as_p00 else "seq").otherwise("P00" if as_p00 else "prg")
    named = files.filter(F.col("data").isNotNull()).withColumn("wanted", F.concat_ws(".", F.translate("file_name", "/*", "_"), ending))
    header = F.concat(F.encode(F.lit("C64File"), "UTF-8"), F.unhex(F.lit("00")), F.rpad(F.substring("raw_name", 1, 16), 16, F.unhex(F.lit("00"))), F.unhex(F.lit("0000")))
    content = F.concat(header, F.col("data")) if as_p00 else F.col("data")
    return suffixed(named, "wanted", order).select("target", content.alias("content"))


def unwrapped(files: DataFrame) -> DataFrame:
    """(path, name, content, ok): P00 files without their header."""
    mark = F.concat(F.encode(F.lit("C64File"), "UTF-8"), F.unhex(F.lit("00")))
    ok = F.substring("content", 1, 8) == mark
    raw = F.regexp_replace(F.hex(F.substring("content", 9, 16)), "(00|A0)+$", "")
    return files.select("path", F.lower(F.decode(F.unhex(raw), "ISO-8859-1")).alias("name"), F.when(ok, F.expr("substring(content, 27)")).alias("content"), ok.alias("ok"))


def extracted(files: DataFrame, folder: str, with_type: bool = False, image: Column | None = None) -> DataFrame:
    """Writes each payload under a folder, or an address of a store, that all executors reach and gives (file_path, target, size). Slashes become `_`; `*` in the folder's name stands for the image."""
    name = F.translate(F.col("file_path"), "/", "_")
    name = F.concat_ws(".", name, F.lower("file_type")) if with_type else name
    place = F.replace(F.lit(folder), F.lit("*"), image if image is not None else F.lit("image"))
    rows = suffixed(files.filter(F.col("data").isNotNull()).withColumn("wanted", F.concat_ws("/", place, name)), "wanted", "ord").select("file_path", "target", "data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for target, data in zip(batch["target"], batch["data"], strict=True):
                stores.write(target, bytes(data))
            yield pd.DataFrame({"file_path": batch["file_path"], "target": batch["target"], "size": [len(d) for d in batch["data"]]})

    return rows.mapInPandas(run, "file_path string, target string, size bigint")


def replaced_partitions(drives: DataFrame, replacements: DataFrame) -> DataFrame:
    """(path, content, n, error): drives (path, content) with the partitions whose `number_name.type` a replacement (file_name, content) has.

    A replacement with a path is for that drive alone, others are for every drive with such a partition: each drive meets its own
    ones, by its path and its partitions' names. One of another length, or a drive without a table, gives a row with an error.
    """

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, table in zip(batch["path"], batch["table"], strict=True):
                try:
                    rows += [(path, volumes.partition_file(p).lower()) for p in volumes.read_partitions(bytes(table or b""))]
                except FormatError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "file_name"])

    held = drives.select("path", F.substring("content", volumes.TABLE + 1, 2 + 256 * 32).alias("table")).mapInPandas(names, "path string, file_name string")
    new = replacements.select(F.lower("file_name").alias("file_name"), F.col("content").alias("new"), *([F.col("path").alias("only")] if "path" in replacements.columns else [F.lit(None).cast("string").alias("only")]))
    own = held.join(new, "file_name").filter(F.col("only").isNull() | (F.col("only") == F.col("path"))).select("path", "file_name", "new")

    def change(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        wanted, rows = dict(zip(right["file_name"], right["new"], strict=True)), []
        for path, content in zip(left["path"], left["content"], strict=True):
            drive, n = bytes(content or b""), 0
            try:
                for part in volumes.read_partitions(_table(drive)):
                    if (name := volumes.partition_file(part).lower()) in wanted:
                        drive, n = volumes.replaced_partition(drive, part, bytes(wanted[name])), n + 1
                rows.append((path, drive, n, None))
            except FormatError as e:
                rows.append((path, None, 0, str(e)))
        return pd.DataFrame(rows, columns=["path", "content", "n", "error"])

    return drives.select("path", "content").groupBy("path").cogroup(own.groupBy("path")).applyInPandas(change, "path string, content binary, n bigint, error string")


def _table(drive: bytes) -> bytes:
    return drive[volumes.TABLE : volumes.TABLE + 2 + 256 * 32]


def put_back(files: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, content, error): the files (path, content) with what was changed inside them (container, entry, content, error) put back.

    A zip file keeps its other members, a packed entry is packed again. A file of which nothing was changed is left out; a failed
    change is an error of its file, which then has no content. Each file meets its own changes alone.
    """

    def packed(entry: str, content: bytes) -> bytes:
        return gzip.compress(content, mtime=0) if entry.lower().endswith(".gz") else content

    def rebuilt(data: bytes, new: dict[str, bytes]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
            for info in old.infolist():
                made.writestr(info, new[info.filename] if info.filename in new else old.read(info))
        return out.getvalue()

    def change(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows, errors = [], [e for e in right["error"] if e]
        new = {e: packed(e, bytes(c)) for e, c in zip(right["entry"], right["content"], strict=True) if c is not None}
        for path, content in zip(left["path"], left["content"], strict=True):
            if errors:
                rows.append((path, None, "; ".join(sorted(errors))))
            elif new:
                try:
                    rows.append((path, rebuilt(bytes(content), new) if path.lower().endswith(".zip") else next(iter(new.values())), None))
                except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["path", "content", "error"])

    pairs = files.select("path", "content").groupBy("path").cogroup(changed.select(F.col("container").alias("path"), "entry", "content", "error").groupBy("path"))
    return pairs.applyInPandas(change, "path string, content binary, error string")


def rle(rows: DataFrame, data: str, pack: bool = True) -> DataFrame:
    """The column packed or unpacked sector by sector; null where it can't be unpacked."""

    @F.pandas_udf("binary")
    def code(values: pd.Series) -> pd.Series:
        def one(v: bytes | None) -> bytes | None:
            try:
                return None if v is None else volumes.rle_pack(bytes(v)) if pack else volumes.rle_unpack(bytes(v))
            except FormatError:
                return None

        return values.map(one)

    return rows.withColumn(data, code(F.col(data)))
