"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions alone.

An item is contained in a document if at least `threshold` of its distinct `words`-word shingles occur there. Items are
short and documents long, so whole-document similarity says little; what counts is the item's own size. Items are
partitioned by their number of shingles n, and each partition has a sketch size of its own, k(n) = n - ceil(threshold * n) + 1: a
document that contains the item misses k(n) - 1 of its shingles at most, so it has one of the sketch, and no contained item is lost.
A sketch holds the k(n) shingles with the smallest ranks of a weighted MinHash: rank = -ln(u) * (items with the shingle), u being
the shingle's hash as a number between 0 and 1. All items rank a shingle alike, and one that many items share hardly ever gets into a sketch.

1. Candidates: the hashed shingles of all documents meet the sketches, and nothing else. This decides which pairs are looked at further.
2. Documents that met a sketch are read again, and the pairs found are verified by the texts of all shingles, not by hashes.

Items' tables and candidates are small against the corpus. They are broadcast only while their counted rows and bytes stay under
BROADCAST_ROWS and BROADCAST_BYTES; beyond that the same joins are left to shuffle.

Defined cases: null and empty texts contain nothing and are contained in nothing; a text of fewer words than a shingle
has its whole word sequence as its only shingle; rows that share a doc_id are one document, those without an id too;
equal items all match; different texts under one item_id, or without an id, are items of their own, with a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytefleet.llm.common import cut

WORDS, THRESHOLD, BROADCAST_ROWS, BROADCAST_BYTES = 5, 0.8, 500_000, 64 << 20


def words_of(text: Column) -> Column:
    """Words without white space, A-Z lower-cased."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(folded, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _windows(words: Column, n: int) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))


def shingles(hashes: Column, n: int = WORDS) -> Column:
    """Hashes of all n-word shingles in order, from word hashes; the whole sequence if there are fewer words."""
    several = F.transform(_windows(hashes, n), lambda k: F.xxhash64(*[F.get(hashes, k + (j - 1)) for j in range(n)]))
    return F.when(F.size(hashes) >= n, several).when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))


def spelt_shingles(words: Column, n: int = WORDS) -> Column:
    """The shingles as texts; words hold no blank, so the blanks between them tell shingles apart."""
    several = F.transform(_windows(words, n), lambda k: F.array_join(F.slice(words, k, n), " "))
    return F.when(F.size(words) > 0, several).otherwise(F.array().cast("array<string>"))


def item_sketches(items: DataFrame, item_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """(item_key, item_id, item_size, need, shingle, spelt, in_sketch): all distinct shingles of each item, hashed and as texts.

    The key tells apart different texts of one item_id; need is the number of shingles that a document must have.
    """
    spoken = items.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("w"))
    keyed = spoken.select(F.md5(F.concat_ws("\n", F.col("item_id").isNull().cast("string"), F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.array_join("w", " "))).alias("item_key"), "item_id", "w")
    hashed = keyed.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    zipped = F.array_distinct(F.arrays_zip(shingles(F.col("h"), n).alias("shingle"), spelt_shingles(F.col("w"), n).alias("spelt")))
    rows = hashed.select("item_key", "item_id", zipped.alias("s")).select("item_key", "item_id", F.size("s").alias("item_size"), F.explode("s").alias("x"))
    rows = rows.select("item_key", "item_id", "item_size", F.col("x.shingle").alias("shingle"), F.col("x.spelt").alias("spelt")).distinct()
    held = rows.groupBy("shingle").agg(F.count("*").alias("items_with"))
    unit = (F.shiftrightunsigned(F.xxhash64("shingle", F.lit(1)), 12) + 1) / F.lit(float(1 << 52))
    need = F.ceil(F.col("item_size") * threshold - 1e-9).cast("int")
    smallest = Window.partitionBy("item_key").orderBy(-F.log(unit) * F.col("items_with"), "shingle")
    ranked = rows.join(held, "shingle").withColumn("need", need).withColumn("in_sketch", F.row_number().over(smallest) <= F.col("item_size") - F.col("need") + 1)
    return ranked.select("item_key", "item_id", "item_size", "need", "shingle", "spelt", "in_sketch")


def candidates(docs: DataFrame, sketches: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, item_key) of documents (doc_id, text) that have a shingle of an item's sketch: one narrow pass in which only such
    shingles go on. The words are hashed in a step of their own, once a document rather than once a shingle."""
    hashed = docs.select("doc_id", word_hashes(F.col("text")).alias("w")).select("doc_id", F.explode(shingles(F.col("w"), n)).alias("shingle"))
    return hashed.join(_at_hand(sketches.filter("in_sketch").select("shingle", "item_key")), "shingle").select("doc_id", "item_key").distinct()


def _at_hand(rows: DataFrame) -> DataFrame:
    """Marked for broadcasting if its rows, counted, stay under both bounds."""
    texts = [c for c, kind in rows.dtypes if kind == "string"]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(16 * len(rows.columns)))
    n, held = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(rows) if n <= BROADCAST_ROWS and held <= BROADCAST_BYTES else rows


def contained_items(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """(doc_id, item_id, item_size, matched, containment) of every document and item that it contains."""
    sketches = cut(item_sketches(items, item_col, item_text_col, threshold, n))
    texts = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    met = cut(candidates(texts, sketches, n))
    some = _at_hand(met.select(F.col("doc_id").alias("met_id")).distinct())
    again = texts.join(some, F.col("doc_id").eqNullSafe(F.col("met_id")), "left_semi").select("doc_id", words_of(F.col("text")).alias("w"))
    spelt = again.select("doc_id", F.explode(spelt_shingles(F.col("w"), n)).alias("spelt"))
    # shingles that no item has go before repeated ones of a document do
    found = spelt.join(_at_hand(sketches.select("spelt", "item_key", "item_id", "item_size", "need")), "spelt")
    pairs = met.select(F.col("doc_id").alias("met_id"), F.col("item_key").alias("met_key"))
    verified = found.join(_at_hand(pairs), F.col("doc_id").eqNullSafe(F.col("met_id")) & (F.col("item_key") == F.col("met_key")), "left_semi").distinct()
    counted = verified.groupBy("doc_id", "item_key", "item_id", "item_size", "need").agg(F.count("*").alias("matched"))
    return counted.filter("matched >= need").select("doc_id", "item_id", F.col("item_size").cast("bigint").alias("item_size"), "matched", (F.col("matched") / F.col("item_size")).alias("containment"))
