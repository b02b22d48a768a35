"""Exact and approximate matching of files across collections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytefleet.functions.scalars import filled, is_geos, match_label, round_half_up
from bytefleet.operators.lineage import cut
from bytefleet.operators.ordinals import running_sums


def block_grams(text: Column) -> Column:
    """Distinct aligned 8-character blocks, and the last 8 characters where the length isn't a multiple; none under 8 characters."""
    n = F.char_length(text)
    blocks = F.regexp_extract_all(text, F.lit("(?s).{8}"), F.lit(0))
    with_tail = F.when((n > 8) & (n % 8 != 0), F.concat(blocks, F.array(F.right(text, F.lit(8))))).otherwise(blocks)
    return F.when(n >= 8, F.array_distinct(with_tail)).otherwise(F.array().cast("array<string>"))


def sliding_grams(text: Column) -> Column:
    """Distinct 8-character windows, found in one pass over the text; characters that the pass would take for two are cut one by one."""
    n = F.char_length(text)
    one_pass = F.regexp_extract_all(text, F.lit("(?s)(?=(.{8}))"), F.lit(1))
    chars = F.split(text, "")
    by_char = F.transform(F.sequence(F.lit(1), F.greatest(n - 7, F.lit(1))), lambda k: F.array_join(F.slice(chars, k, 8), ""))
    windows = F.when(F.rlike(text, F.lit(r"[\x{10000}-\x{10FFFF}]")), by_char).otherwise(one_pass)
    return F.when(n >= 8, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))


def _signed(grams: Column, text: Column) -> Column:
    """Grams of single-byte characters as the 64-bit numbers that signed bytes give when each is or-ed to those before it, shifted: a byte over 127 sets all before it."""
    one = lambda g: F.lpad(F.regexp_replace(g, r"(?s)^.*(?=[\x{80}-\x{FF}])", ""), 8, "\u00ff")
    return F.when(F.rlike(text, F.lit(r"[\x{80}-\x{FF}]")), F.array_distinct(F.transform(grams, one))).otherwise(grams)


def byte_blocks(text: Column) -> Column:
    """`block_grams` of a binary payload, held as text of single-byte characters, by the rule for signed bytes."""
    return _signed(block_grams(text), text)


def byte_windows(text: Column) -> Column:
    """`sliding_grams` of a binary payload by the rule for signed bytes; before there are eight bytes, the first ones behind zeros."""
    n = F.char_length(text)
    starts = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(7))), lambda k: F.lpad(F.left(text, k), 8, "\u0000"))
    return _signed(F.when(n > 0, F.array_distinct(F.concat(starts, sliding_grams(text)))).otherwise(F.array().cast("array<string>")), text)


def _rule(binary: bool) -> tuple:
    """Blocks, windows and size of payloads: texts, or bytes held as text of single-byte characters."""
    return (byte_blocks, byte_windows, F.char_length) if binary else (block_grams, sliding_grams, F.octet_length)


def scores(first: DataFrame, second: DataFrame, id1: str, id2: str, text1: str = "text", text2: str = "text", binary: bool = False) -> DataFrame:
    """(id1, id2, score) of all pairs with a score over 0, by shared grams: floor(30 lp p1 p2 + 35 p1 + 35 p2 + 0.5).

    p1 is the share of the first one's distinct blocks that occur anywhere in the second (0 without blocks), p2 the reverse, lp the ratio of
    sizes. A pair without a common gram scores 0, so the gram joins are complete. Equal grams are joined by hash; a frequent
    gram is left to adaptive skew handling, as dropping it would change scores. `binary`: texts are bytes, grams are numbers of signed bytes.
    """
    blocks, windows, _ = _rule(binary)
    ct1 = _exploded(first, id1, text1, "i1", blocks).join(_exploded(second, id2, text2, "i2", windows), "gram").groupBy("i1", "i2").agg(F.count("*").alias("ct1"))
    ct2 = _exploded(second, id2, text2, "i2", blocks).join(_exploded(first, id1, text1, "i1", windows), "gram").groupBy("i1", "i2").agg(F.count("*").alias("ct2"))
    rows = ct1.join(ct2, ["i1", "i2"], "full").join(_sizes(first, id1, text1, 1, binary), "i1").join(_sizes(second, id2, text2, 2, binary), "i2")
    return _scored(rows).filter("score > 0")


def _exploded(df: DataFrame, key: str, text: str, name: str, grams) -> DataFrame:
    return df.select(F.col(key).alias(name), F.explode(grams(F.col(text))).alias("gram"))


def _sizes(df: DataFrame, key: str, text: str, n: int, binary: bool) -> DataFrame:
    blocks, _, size = _rule(binary)
    return df.select(F.col(key).alias(f"i{n}"), size(F.col(text)).alias(f"size{n}"), F.size(blocks(F.col(text))).alias(f"blocks{n}"))


def _scored(rows: DataFrame) -> DataFrame:
    p1, p2 = (F.coalesce(F.try_divide(F.coalesce(f"ct{n}", F.lit(0)), F.col(f"blocks{n}")), F.lit(0.0)) for n in (1, 2))
    lp = F.try_divide(F.least("size1", "size2"), F.greatest("size1", "size2"))
    return rows.select(F.col("i1").alias("id1"), F.col("i2").alias("id2"), round_half_up(lp * p1 * p2 * 30 + p1 * 35 + p2 * 35).alias("score"))


def contenders(first: DataFrame, second: DataFrame, least: int, binary: bool = False) -> DataFrame:
    """(i1, i2) of the pairs of (id, text) that can reach the score; none that does is missed.

    With m the greater of p1 and p2 a score is 30 m^2 + 70 m at most, so one of the two has a least share. A file of n blocks that
    shares that many with the other side shares one of its first n - ceil(m n) + 1, whatever their order: blocks are ordered by
    how many files of the other side have them, rarest first, so that the grams which very many files share are hardly ever joined.
    """
    grams, all_windows, _ = _rule(binary)
    m = (math.sqrt(4900 + 120 * (least - 0.5)) - 70) / 60 - 1e-9

    def one(blocks_of: DataFrame, windows_of: DataFrame, i: str, j: str) -> DataFrame:
        windows = _exploded(windows_of, "id", "text", j, all_windows)
        times = windows.groupBy("gram").agg(F.count("*").alias("times"))
        blocks = blocks_of.select(F.col("id").alias(i), grams(F.col("text")).alias("g")).select(i, F.size("g").alias("n"), F.explode("g").alias("gram"))
        order = Window.partitionBy(i).orderBy("times", "gram")  # the blocks of one file
        ranked = blocks.join(times, "gram", "left").withColumn("times", F.coalesce("times", F.lit(0))).withColumn("place", F.row_number().over(order))
        front = ranked.filter(F.col("place") <= F.col("n") - F.greatest(F.ceil(F.col("n") * m), F.lit(1)) + 1).filter("times > 0").select(i, "gram")
        return front.join(windows, "gram").select("i1", "i2")

    return one(first, second, "i1", "i2").unionByName(one(second, first, "i2", "i1")).distinct()


def scores_of(pairs: DataFrame, first: DataFrame, second: DataFrame, binary: bool = False) -> DataFrame:
    """(id1, id2, score) of the given pairs (i1, i2), 0 included: the grams of these files alone are counted, pair by pair."""
    grams, all_windows, _ = _rule(binary)

    def shared(blocks_of: DataFrame, windows_of: DataFrame, i: str, j: str, name: str) -> DataFrame:
        blocks = pairs.join(_exploded(blocks_of, "id", "text", i, grams), i)
        windows = _exploded(windows_of, "id", "text", j, all_windows).join(pairs.select(j).distinct(), j, "left_semi")
        return blocks.join(windows, [j, "gram"]).groupBy("i1", "i2").agg(F.count("*").alias(name))

    counted = pairs.join(shared(first, second, "i1", "i2", "ct1"), ["i1", "i2"], "left").join(shared(second, first, "i2", "i1", "ct2"), ["i1", "i2"], "left")
    return _scored(counted.join(_sizes(first, "id", "text", 1, binary), "i1").join(_sizes(second, "id", "text", 2, binary), "i2"))


def geos_equal(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id1, id2) of converted desktop files (id, name, data) that are the same but for their first block and padding.

    Both are such files, their sizes differ by less than 257, the info blocks are equal, all after the first block is equal as far
    as the shorter one goes, and the longer one ends in one repeated byte. Candidates meet by the digest of their info blocks.
    """

    def side(df: DataFrame, n: int) -> DataFrame:
        block = F.substring("data", 255, 254)
        return df.filter(is_geos(F.col("name"), F.col("data"))).select(F.col("id").alias(f"id{n}"), F.col("data").alias(f"data{n}"), F.sha2(block, 256).alias("info"))

    n1, n2 = F.octet_length("data1"), F.octet_length("data2")
    shorter = F.least(n1, n2)

    def cut(data: str, begin: Column, end: Column) -> Column:
        return F.substring(F.col(data), begin + 1, end - begin)

    longer = F.when(n1 > n2, cut("data1", shorter, n1)).otherwise(cut("data2", shorter, n2))
    same = cut("data1", F.lit(254), shorter) == cut("data2", F.lit(254), shorter)
    return side(first, 1).join(side(second, 2), "info").filter((F.abs(n1 - n2) < 257) & same & filled(longer)).select("id1", "id2")


def classify(first: DataFrame, second: DataFrame, deeper: int | None = None, place: str | None = None, binary: bool = False) -> DataFrame:
    """(id1, id2, label, equal, approx) of two relations (id, name, digest, text, and data if desktop files are to be compared by their own rule), by priority.

    Equal contents: MATCH. Else, with `deeper`, a score that reaches it: M-n%, which counts as equal; below it, for files of the
    same name: n%, or DIFF at 0. Without `deeper`, and for payloads that are empty, the same name gives DIFF. All else gives no row.
    `binary` says that text holds bytes as single-byte characters, which scores then go by. With `place`, the column of both that names the file on disk, files of one and the same place aren't matched with each other.
    """
    a = first.select(F.col("id").alias("id1"), F.col("name").alias("name1"), F.col("digest").alias("d1"), F.octet_length("text").alias("n1"))
    b = second.select(F.col("id").alias("id2"), F.col("name").alias("name2"), F.col("digest").alias("d2"), F.octet_length("text").alias("n2"))
    exact = a.filter("n1 > 0").join(b.filter("n2 > 0"), F.col("d1") == F.col("d2")).select("id1", "id2", F.lit(True).alias("equal"), F.lit(0).cast("bigint").alias("approx"), F.lit(1).alias("rank"))
    named = a.join(b, F.col("name1") == F.col("name2")).select("id1", "id2", F.lit(False).alias("equal"), F.lit(0).cast("bigint").alias("approx"), F.lit(3).alias("rank"))
    rows = exact.unionByName(named)
    if {"data"} <= set(first.columns) & set(second.columns):
        rows = rows.unionByName(geos_equal(first, second).select("id1", "id2", F.lit(True).alias("equal"), F.lit(0).cast("bigint").alias("approx"), F.lit(1).alias("rank")))
    if deeper is not None:
        if deeper < 1:
            raise ValueError("a score of 0 would pair all with all")
        texts = [df.select("id", "text") for df in (first, second)]
        pairs = cut(contenders(*texts, deeper, binary).unionByName(named.select(F.col("id1").alias("i1"), F.col("id2").alias("i2"))).distinct())
        scored = scores_of(pairs, *texts, binary).filter("score > 0").join(named.select("id1", "id2", F.lit(True).alias("named")), ["id1", "id2"], "left")
        near = scored.filter((F.col("score") >= deeper) | F.col("named")).select("id1", "id2", (F.col("score") >= deeper).alias("equal"), F.col("score").alias("approx"), F.lit(2).alias("rank"))
        rows = rows.unionByName(near)
    best = rows.groupBy("id1", "id2").agg(F.min(F.struct("rank", "equal", "approx")).alias("x"))
    if place is not None:
        for df, n in ((first, 1), (second, 2)):
            best = best.join(df.select(F.col("id").alias(f"id{n}"), F.col(place).alias(f"place{n}")), f"id{n}")
        best = best.filter(~F.col("place1").eqNullSafe(F.col("place2")))
    return best.select("id1", "id2", match_label(F.col("x.equal"), F.col("x.approx")).alias("label"), F.col("x.equal").alias("equal"), F.col("x.approx").alias("approx"))


def summary(pairs: DataFrame, first: DataFrame, container: str) -> DataFrame:
    """(container, num_files, matched_anywhere): files of each container, and those with an equal file anywhere.

    pairs: (id1, equal); first: (id, container, is_dir). Directories don't count.
    """
    hit = pairs.filter("equal").select(F.col("id1").alias("id"), F.lit(True).alias("hit")).distinct()
    files = first.filter(~F.col("is_dir")).join(hit, "id", "left")
    return files.groupBy(container).agg(F.count("*").alias("num_files"), F.count("hit").alias("matched_anywhere"))


def containment(pairs: DataFrame, first: DataFrame, second: DataFrame, container: str) -> DataFrame:
    """(container1, container2, pairs, files): equal pairs, and distinct files, between two containers; full if `pairs` reaches num_files."""
    a, b = first.select(F.col("id").alias("id1"), F.col(container).alias("container1")), second.select(F.col("id").alias("id2"), F.col(container).alias("container2"))
    joined = pairs.filter("equal").join(a, "id1").join(b, "id2")
    counts = joined.groupBy("container1", "container2").agg(F.count("*").alias("pairs"), F.count_distinct("id1").alias("files"))
    return _with_sizes(counts, first, container)


def exact_classes(first: DataFrame, second: DataFrame) -> DataFrame:
    """(side, id, class_id, links) of every file of two relations (id, digest, text): the pairs of equal contents, without a row for each pair.

    Files of equal contents are one class, named by the least id of the first side, or else of the second; links counts
    the equal files of the other side. A file without payload, or without a digest, is in no class and has no links.
    """
    sides = [df.select(F.lit(n).alias("side"), "id", F.when(F.octet_length("text") > 0, F.col("digest")).alias("d")) for n, df in ((1, first), (2, second))]
    files = sides[0].unionByName(sides[1])
    on = [F.col("side") == n for n in (1, 2)]
    least = [F.min(F.when(s, F.col("id"))) for s in on]
    classes = files.filter("d is not null").groupBy("d").agg(F.coalesce(*least).alias("class_id"), *(F.count_if(s).alias(f"n{k}") for k, s in enumerate(on, 1)))
    links = F.coalesce(F.when(on[0], F.col("n2")).otherwise(F.col("n1")), F.lit(0))
    return files.join(classes, "d", "left").select("side", "id", "class_id", links.alias("links"))


def exact_containment(first: DataFrame, second: DataFrame, container: str) -> DataFrame:
    """What `containment` gives for pairs of equal contents: equal files of a container are counted before containers meet, so that no pair of files is made."""

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.filter(F.octet_length("text") > 0).groupBy("digest", F.col(container).alias(f"container{n}")).agg(F.count("*").alias(f"n{n}"))

    met = side(first, 1).join(side(second, 2), "digest").groupBy("container1", "container2")
    return _with_sizes(met.agg(F.sum(F.col("n1") * F.col("n2")).alias("pairs"), F.sum("n1").alias("files")), first, container)


def _with_sizes(counts: DataFrame, first: DataFrame, container: str) -> DataFrame:
    sizes = first.filter(~F.col("is_dir")).groupBy(F.col(container).alias("container1")).agg(F.count("*").alias("num_files"))
    return counts.join(sizes, "container1").withColumn("full", F.col("pairs") >= F.col("num_files"))


def running(rows: DataFrame, partition: str, order: str, hit: Column) -> DataFrame:
    """running_pct: the percentage of hits among the rows of a partition up to each, in order."""
    done = running_sums(rows, partition, order, {"_hits": F.when(hit, 1).otherwise(0).cast("bigint"), "_rows": F.lit(1).cast("bigint")})
    return done.withColumn("running_pct", round_half_up(100.0 * F.col("_hits") / F.col("_rows"))).drop("_hits", "_rows")
