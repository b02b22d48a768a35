"""Allocation and cross-link checks over relations of sectors."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytefleet.functions.scalars import round_half_up

#: Rows of an image's shared sectors that a task holds, and pairs that it counts at once.
PIECE_ROWS, PAIRS = 3 << 20, 1 << 19


def allocation(bam: DataFrame, used: DataFrame, image: str = "image") -> DataFrame:
    """(image, track, sector, mark) of each sector of the bitmap (image, track, sector, is_free) against those that files use.

    x: used and marked so; o: free and marked so; 0: used but free in the bitmap; #: marked used, but by no file.
    """
    hit = used.select(image, "track", "sector").distinct().withColumn("hit", F.lit(True))
    rows = bam.join(hit, [image, "track", "sector"], "left")
    used_now = F.col("hit").isNotNull()
    mark = F.when(used_now & ~F.col("is_free"), "x").when(~used_now & F.col("is_free"), "o").when(used_now, "0").otherwise("#")
    return rows.select(image, "track", "sector", mark.alias("mark"))


def allocation_counts(marks: DataFrame, image: str = "image") -> DataFrame:
    """(image, over, under): sectors marked used by nobody, and used ones marked free."""
    return marks.groupBy(image).agg(F.count_if(F.col("mark") == "#").alias("over"), F.count_if(F.col("mark") == "0").alias("under"))


def repaired(marks: DataFrame, allocate: bool = True, free: bool = True) -> DataFrame:
    """The bitmap with wrong marks put right: `allocate` marks used sectors, `free` releases those of nobody."""
    is_free = F.col("mark").isin("o", *(["0"] if not allocate else []), *(["#"] if free else []))
    return marks.withColumn("is_free", is_free)


def affected_files(marks: DataFrame, used: DataFrame, image: str = "image", file: str = "file") -> DataFrame:
    """(image, file, n_sectors, n_free, pct): files with sectors that the bitmap calls free."""
    rows = used.join(marks.select(image, "track", "sector", "mark"), [image, "track", "sector"])
    return rows.groupBy(image, file).agg(F.count("*").alias("n_sectors"), F.count_if(F.col("mark") == "0").alias("n_free")).filter("n_free > 0").withColumn("pct", round_half_up(100.0 * F.col("n_free") / F.col("n_sectors")))


def free_by_track(bam: DataFrame, image: str = "image", skip: tuple[int, ...] = ()) -> DataFrame:
    """(image, track, free): free sectors; tracks in `skip`, such as the directory's, don't count."""
    rows = bam.filter(~F.col("track").isin(*skip)) if skip else bam
    return rows.groupBy(image, "track").agg(F.sum(F.col("is_free").cast("bigint")).alias("free"))


def total_free(bam: DataFrame, image: str = "image", skip: tuple[int, ...] = ()) -> DataFrame:
    return free_by_track(bam, image, skip).groupBy(image).agg(F.sum("free").alias("free"))


def cross_links(used: DataFrame, image: str = "image", file: str = "file", keys: tuple[str, ...] = ("track", "sector")) -> DataFrame:
    """(image, file, other, shared, kind) of files of one image that share sectors.

    inside: all of a file's sectors are the other's; contains: the reverse; overlaps: some. Files with the same sectors are inside
    each other. A file without sectors shares none.

    Pairs are counted where they arise and never shuffled: a task holds the files of each shared sector of an image, or of one piece
    of a large image's files, and all files of that image pass by. Only the shared sectors of one file have to fit in a task.
    Rows that are partitioned by image and file already are shuffled twice, others four times.
    """
    k = [f"_k{n}" for n in range(len(keys))]
    rows = used.select(F.col(image).alias("_i"), F.col(file).alias("_f"), *[F.col(c).alias(n) for c, n in zip(keys, k, strict=True)])
    sized = rows.distinct().withColumn("_n", F.count("*").over(Window.partitionBy("_i", "_f")))
    for c in ("_i", "_f", *k):
        sized = sized.filter(F.col(c).isNotNull())
    # a sector is numbered in the task that has all its rows
    at = Window.partitionBy("_i", *k)
    numbered = sized.repartition("_i", *k).withColumn("_id", F.monotonically_increasing_id())
    met = numbered.select("_i", "_f", "_n", F.count("*").over(at).alias("_users"), F.min("_id").over(at).alias("_sector")).filter("_users > 1").drop("_users")
    # all columns are named, so that this and the pass over pairs read one shuffle; there are no more such images than rows / PIECE_ROWS
    large = met.groupBy("_i").agg(F.count("*").alias("_rows"), F.max("_f").alias("_lf"), F.max("_n").alias("_ln"), F.max("_sector").alias("_ls")).filter((F.col("_rows") > PIECE_ROWS) & F.col("_lf").isNotNull() & (F.col("_ln") > 0) & (F.col("_ls") >= 0))
    pieces = met.join(F.broadcast(large.select("_i", F.ceil(F.col("_rows") / PIECE_ROWS).alias("_pieces"))), "_i", "left").withColumn("_pieces", F.coalesce("_pieces", F.lit(1).cast("bigint")))
    spread = pieces.withColumn("_home", F.pmod(F.xxhash64("_f"), "_pieces")).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_pieces") - 1)))
    sorted_ = spread.select("_i", "_piece", (F.col("_home") != F.col("_piece")).alias("_away"), "_f", "_n", "_sector").repartition("_i", "_piece").sortWithinPartitions("_i", "_piece", "_away", "_f")
    kinds = rows.schema
    out = T.StructType([T.StructField("_i", kinds["_i"].dataType), T.StructField("_f", kinds["_f"].dataType), T.StructField("_o", kinds["_f"].dataType), T.StructField("_shared", T.LongType()), T.StructField("_kind", T.ByteType())])
    kind = F.when(F.col("_kind") == 0, "inside").when(F.col("_kind") == 1, "contains").otherwise("overlaps")
    return sorted_.mapInArrow(_counted_pairs, out).select(F.col("_i").alias(image), F.col("_f").alias(file), F.col("_o").alias("other"), F.col("_shared").alias("shared"), kind.alias("kind"))


def _counted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each image and piece, whose rows (_i, _piece, _away, _f, _n, _sector) come together, the piece's own first, by file."""
    group, piece = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        i, p, away = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        new = pc.not_equal(i.slice(1), i.slice(0, len(i) - 1)).to_numpy(zero_copy_only=False).astype(bool) | (p[1:] != p[:-1])
        cuts = [0, *(np.flatnonzero(new | (away[1:] != away[:-1])) + 1).tolist(), batch.num_rows]
        for start, end in itertools.pairwise(cuts):
            if (key := (i[start].as_py(), int(p[start]))) != group:
                if piece:
                    yield from piece.end()
                group, piece = key, _Piece(i[start])
            part = batch.slice(start, end - start)
            rows = pa.RecordBatch.from_arrays([part.column(3).dictionary_encode(), part.column(4), part.column(5)], names=["f", "n", "sector"])
            yield from piece.visited(rows) if away[start] else piece.filled(rows)
    if piece:
        yield from piece.end()


def _joined(parts: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct files, and of each row the file's number, its size and the sector."""
    t = pa.Table.from_batches(parts).unify_dictionaries().combine_chunks()
    f = t.column(0).chunk(0)
    return f.dictionary, f.indices.to_numpy().astype(np.int64), t.column(1).to_numpy(), t.column(2).to_numpy()


class _Piece:
    """The files of each sector of a piece, and the pairs of all that pass by with these."""

    def __init__(self, image: pa.Scalar):
        self.image, self.own, self.waiting, self.files = image, [], [], None

    def filled(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.own.append(rows)
        yield from ()

    def visited(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Files of other pieces; the last one waits, as more of its rows may follow."""
        if self.files is None:
            yield from self._indexed()
        names = rows.column(0).dictionary
        if len(names) > 1 or (self.waiting and self.waiting[0].column(0).dictionary[0] != names[0]):
            last = int(np.searchsorted(rows.column(0).indices.to_numpy(), len(names) - 1))
            yield from self._pairs(*_joined([*self.waiting, rows.slice(0, last)]), False)
            self.waiting, rows = [], rows.slice(last)
            rows = rows.set_column(0, "f", rows.column(0).dictionary_decode().dictionary_encode())
        self.waiting.append(rows)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.files is None:
            yield from self._indexed()
        if self.waiting:
            yield from self._pairs(*_joined(self.waiting), False)

    def _indexed(self) -> Iterator[pa.RecordBatch]:
        if not self.own:  # no file of the image is at home here
            self.files, self.sectors, self.start, self.others, self.sizes = pa.array([]), np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            return
        self.files, f, n, sector = _joined(self.own)
        self.own = []
        order = np.argsort(sector, kind="stable")
        self.sectors, start = np.unique(sector[order], return_index=True)
        self.start, self.others = np.append(start, len(sector)), f[order]
        self.sizes = np.zeros(len(self.files), np.int64)
        self.sizes[f] = n
        yield from self._pairs(self.files, f, n, sector, True)

    def _pairs(self, files: pa.Array, f: np.ndarray, n: np.ndarray, sector: np.ndarray, home: bool) -> Iterator[pa.RecordBatch]:
        """Pairs of whole files, whose rows stand together, with the piece's."""
        if not len(f) or not len(self.sectors):
            return
        place = np.minimum(np.searchsorted(self.sectors, sector), len(self.sectors) - 1)
        first = self.start[place]
        met = np.where(self.sectors[place] == sector, self.start[place + 1] - first, 0)
        heads = np.append(0, np.flatnonzero(f[1:] != f[:-1]) + 1)
        load = np.add.reduceat(met, heads)
        heads = np.append(heads, len(f))
        turn = np.where(load > PAIRS, -1 - np.arange(len(load)), np.cumsum(load) // PAIRS)  # files with many pairs go by themselves
        ends = np.append(np.flatnonzero(turn[1:] != turn[:-1]) + 1, len(turn))
        width = len(self.sizes)
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            rows = slice(heads[a], heads[b])
            if turn[a] < 0:
                count = np.zeros(width, np.int64)
                cuts = np.flatnonzero(np.diff(np.cumsum(met[rows]) // PAIRS)) + 1
                for of, size in zip(np.split(first[rows], cuts), np.split(met[rows], cuts), strict=True):
                    count += np.bincount(self._met(of, size), minlength=width)
                other = np.flatnonzero(count)
                shared, run = count[other], np.zeros(len(other), np.int64)
            else:
                number = np.repeat(np.arange(b - a), np.diff(heads[a : b + 1]))
                pair = np.sort(np.repeat(number, met[rows]) * width + self._met(first[rows], met[rows]))
                if not len(pair):
                    continue
                edge = np.append(0, np.flatnonzero(pair[1:] != pair[:-1]) + 1)
                shared = np.diff(np.append(edge, len(pair)))
                run, other = np.divmod(pair[edge], width)
            at = heads[a + run]
            if home:
                keep = f[at] != other
                at, other, shared = at[keep], other[keep], shared[keep]
            kind = np.where(shared == n[at], 0, np.where(shared == self.sizes[other], 1, 2)).astype(np.int8)
            for k in range(0, len(at), PAIRS):
                part = slice(k, k + PAIRS)
                yield pa.RecordBatch.from_arrays([pa.repeat(self.image, len(at[part])), files.take(pa.array(f[at[part]])), self.files.take(pa.array(other[part])), pa.array(shared[part]), pa.array(kind[part])], names=["_i", "_f", "_o", "_shared", "_kind"])

    def _met(self, first: np.ndarray, met: np.ndarray) -> np.ndarray:
        """The files met in the sectors that begin at `first`, row by row."""
        return self.others[np.repeat(first - (np.cumsum(met) - met), met) + np.arange(met.sum())]


def file_issues(files: DataFrame, marks: DataFrame, used: DataFrame) -> DataFrame:
    """(image, file, other, kind): wrong block counts, sectors marked free, and cross links of all images.

    files: (image, file, blocks); used: (image, file, track, sector).
    """
    n = used.groupBy("image", "file").agg(F.count("*").alias("n"))
    none = F.lit(None).cast(dict(used.dtypes)["file"]).alias("other")
    counts = files.join(n, ["image", "file"], "left").filter(F.coalesce("n", F.lit(0)) != F.col("blocks")).select("image", "file", none, F.lit("block count").alias("kind"))
    wrong = marks.filter("mark = '0'").select("image", "track", "sector").distinct()
    free = used.join(wrong, ["image", "track", "sector"], "left_semi").select("image", "file").distinct().select("image", "file", none, F.lit("not allocated").alias("kind"))
    return counts.unionByName(free).unionByName(cross_links(used).select("image", "file", "other", "kind"))
