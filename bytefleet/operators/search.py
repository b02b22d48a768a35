"""Search over files by name and content, and the catalogue that an export writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytefleet.functions.scalars import SIZE_CAP, on_platform
from bytefleet.functions.text import inside_matches, name_matches
from bytefleet.operators.ordinals import row_numbers


def search(files: DataFrame, pattern: str, name: str = "file_name", text: str | None = None, data: str | None = None, inside: bool = False, case_sensitive: bool = False, platforms: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose name matches, or, with `inside`, whose text contains the pattern; only rows with a payload, of the platforms if any are named."""
    hit = name_matches(F.col(name), pattern, case_sensitive)
    if inside:
        hit = hit | inside_matches(F.col(text), pattern, case_sensitive)
    rows = files if data is None else files.filter(F.col(data).isNotNull())
    if platforms:
        rows = rows.filter(on_platform(F.col(data), *platforms))
    return rows.filter(hit)


def numbered(files: DataFrame, image: str, order: str | Column) -> DataFrame:
    """filenum: a file's place in its image's listing, from 1."""
    return row_numbers(files, image, order, "filenum")


def present(files: DataFrame, data: str = "data", cap: int = SIZE_CAP) -> DataFrame:
    """Rows with a payload that is within the size cap."""
    return files.filter(F.col(data).isNotNull() & (F.octet_length(data) <= cap))


def messages(files: DataFrame, error: str = "error") -> DataFrame:
    """(message, n): each distinct message of a relation with errors once, and how many rows have it."""
    return files.filter(F.col(error).isNotNull()).groupBy(F.col(error).alias("message")).agg(F.count("*").alias("n"))


def catalog(files: DataFrame, images: DataFrame | None = None, image: str = "image", name: str = "file_name", order: str = "ord", data: str = "data", kind: str | Column = "file_type") -> DataFrame:
    """(imagepath, filename, filenum, size, md5, filetype): a row for each file, and for each image one with filenum 0, name `*` and type `dsk`.

    `images` has (image, content); image rows are there whatever matches inside. Digests are upper-case.
    """
    kind = F.col(kind) if isinstance(kind, str) else kind
    rows = numbered(files, image, order).select(F.col(image).alias("imagepath"), F.col(name).alias("filename"), "filenum", F.octet_length(data).cast("bigint").alias("size"), F.upper(F.md5(data)).alias("md5"), F.lower(kind).alias("filetype"))
    if images is None:
        return rows
    whole = images.select(F.col("image").alias("imagepath"), F.lit("*").alias("filename"), F.lit(0).cast("bigint").alias("filenum"), F.octet_length("content").cast("bigint").alias("size"), F.upper(F.md5("content")).alias("md5"), F.lit("dsk").alias("filetype"))
    return whole.unionByName(rows)


def export_jdbc(rows: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, batch: int = 1000) -> None:
    """Appends the catalogue over JDBC, in batches from the executors."""
    rows.write.option("batchsize", batch).jdbc(url, table, mode="append", properties=properties or {})
