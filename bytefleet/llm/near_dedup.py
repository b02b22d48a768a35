"""Near-duplicate documents by circulant MinHash, with links confirmed on full shingle sets.

1. One pass makes each document's set of distinct `WORDS`-word shingles, a 128-bit key of the set, and its signature. Two
   permutations make all signature coordinates: sigma places a shingle on a circle of CIRCLE points, and pi,
   shifted round by k, gives coordinate k as the least pi(sigma(x) + k). Equal sets become one node. Sets of more than LARGE
   shingles would fill that circle; theirs has 2^48 points, and pi is computed rather than kept. Sets of a size that may be
   linked with either side of LARGE have both signatures.
2. The coordinates are banded (BANDS of BAND_ROWS). Were they independent, two sets at Jaccard 0.8 would share no band with
   probability 5e-8; they nearly are (the README has the recall as measured).
3. In each bucket all nodes are compared with one hub, the node with the most company in all its buckets, on their full sets. That joins groups of
   copies in linear work. It is not the whole job: two nodes that both fail against their hub may still be linked.
4. So buckets that still hold more than one component are finished exactly: shingles of their nodes are
   ordered by frequency, rarest first, and sets with Jaccard >= T must share one of their first (prefix filter, with length
   and position bounds). Pairs of different components that do are compared on their full sets. What a set could still share
   bounds the size of its partners, so the longer set of a pair looks for the shorter among sizes that this bound allows: pages
   of one template that can't reach the threshold never meet, however many they are. Nor do sets of a shingle's largest component.
5. Components come from the links by minimum labels with pointer jumping, all as DataFrames with checkpoints.

Defined cases: texts without words (null, empty) have an empty set and are linked with nothing; fewer words
than a shingle: the whole sequence is the only shingle; repeated rows are documents of their own that are linked (by the
same set); rows without an id are returned with a null component, kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytefleet.llm.common import cut, pa_schema, slices, worker_state

WORDS, PERCENT = 4, 80
BANDS, BAND_ROWS, CIRCLE, LARGE = 32, 4, 1 << 20, 1 << 16
#: Size classes of contenders grow by this factor.
SIZE_STEP = 1.04
_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles. Words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().translate(_LOWER).split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))
    if not words:
        return hashes
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, _U)
    for k in range(size):
        out = _mix(out + hashes[k : len(words) - size + 1 + k])
    return np.unique(out)


def _circle() -> np.ndarray:
    return worker_state("near_dedup", CIRCLE, _make_circle)


def _make_circle() -> np.ndarray:
    """pi, as a view in which row i holds pi(i), pi(i + 1), ... round the circle."""
    pi = np.random.default_rng(20260101).permutation(CIRCLE).astype(np.uint32)
    width = BANDS * BAND_ROWS
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: width - 1]]), width)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of a non-empty set; sigma is the upper bits of a hash that is independent of the set's order."""
    at = (_mix(shingles ^ _U(0xA0761D6478BD642F)) >> _U(64 - 20)).astype(np.int64)
    rows = _circle()
    least = rows[at[:2048]].min(0)
    for k in range(2048, len(at), 2048):
        least = np.minimum(least, rows[at[k : k + 2048]].min(0))
    return least


def large_signature(shingles: np.ndarray) -> np.ndarray:
    """The same for large sets, on a circle of 2^48 points: pi is a bijective mix of the place, computed for each shift."""
    ring, low = _U((1 << 48) - 1), np.full(BANDS * BAND_ROWS, (1 << 64) - 1, _U)
    at = _mix(shingles ^ _U(0xA0761D6478BD642F)) >> _U(16)
    for begin in range(0, len(at), 1 << 16):
        part = at[begin : begin + (1 << 16)]
        for k in range(len(low)):
            low[k] = min(low[k], _mix(((part + _U(k)) & ring) ^ _U(0x8EBC6AF09C88C6E3)).min())
    return low


def bucket_keys(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The bucket keys of a non-empty set: of either circle, or of both where its size may be linked with sets on either side."""
    n, out = len(shingles), []
    if percent * n <= 100 * LARGE:
        out.append(band_keys(signature(shingles)))
    if 100 * n > percent * LARGE:
        out.append(band_keys(large_signature(shingles), BANDS))
    return np.concatenate(out)


def band_keys(coordinates: np.ndarray, first: int = 0) -> np.ndarray:
    """One 64-bit bucket key for each band; the band's number, counted from `first`, is part of the key."""
    out = np.arange(first, first + BANDS, dtype=_U) + _U(1)
    for column in coordinates.reshape(BANDS, BAND_ROWS).T:
        out = _mix(out * _U(0x9E3779B97F4A7C15) + column.astype(_U))
    return out.view(np.int64)


def _key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _map(docs: DataFrame, schema: str, row: Callable[[str | None, np.ndarray], tuple], lists: int) -> DataFrame:
    """Maps (id, text) to (id, *row(text, set)); the last `lists` values are arrays of 64-bit numbers."""
    out = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = [row(t, shingle_set(t)) for t in part.column(1).to_pylist()]
                columns = [part.column(0).cast(out.field(0).type)]
                for k, field in enumerate(list(out)[1:]):
                    values = [r[k] for r in rows]
                    if k >= len(out) - 1 - lists:
                        ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
                        flat = pa.array(np.concatenate([*values, np.empty(0, np.int64)]).astype(np.int64, copy=False))
                        columns.append(pa.ListArray.from_arrays(pa.array(ends), flat))
                    else:
                        columns.append(pa.array(values, field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return docs.mapInArrow(run, schema)


#: Of the columns that a text's hash is for; with this seed it equals Spark's own xxhash64 of the text.
_SEED = 42


def _signed(text: str | None, shingles: np.ndarray) -> tuple:
    hashed = np.uint64(xxhash.xxh64_intdigest((text or "").encode(), _SEED)).view(np.int64).item()
    return len(shingles), hashed, _key(shingles), bucket_keys(shingles) if len(shingles) else np.empty(0, np.int64)


def _sets(text: str | None, shingles: np.ndarray) -> tuple:
    return _key(shingles), shingles.view(np.int64)


def _linked(inter: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * inter >= percent * (a + b - inter)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    inter = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").filter(_linked(inter, F.size("sa"), F.size("sb"), percent)).select("a", "b")


def components(links: DataFrame, names: DataFrame) -> DataFrame:
    """(node, label): for each node of a link the least (id, node) that it reaches. names: (node, id)."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    named = both.select(F.col("a").alias("node")).distinct().join(names, "node")
    labels = cut(named.select("node", F.struct("id", "node").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = cut(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = lower.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = cut(lower.join(jump, F.col("label.node") == F.col("at")).select("node", "old", F.least("label", "further").alias("label")))
        labels = moved.select("node", "label")
        if moved.filter(F.col("old") != F.col("label")).isEmpty():
            return labels


def contenders(sets: DataFrame, labels: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of sets with different labels that can reach the threshold; none that does is missed.

    Shingles that no other set here has can't be shared. Of the c others, ordered by frequency, rarest first, a set of n must
    share one of its first c - ceil(percent n) + 1, and at the first shingle that two sets share, no more than it
    and what follows in both can be common. sets: (node, s); labels: (node, label) for all of them.
    """
    met = meetings(fronts(sets, labels, percent), percent).filter("possible")
    return met.select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b")).distinct()


def fronts(sets: DataFrame, labels: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, n, rest, most, g, label, minor): the first shingles of each set that more than one label has.

    rest: the shingle and those behind it; most: the size of the largest partner that these could be enough for;
    minor: the label isn't the one with the most sets at this shingle.
    """
    rows = sets.select("node", F.size("s").alias("n"), F.explode("s").alias("g"))
    counted = cut(rows.groupBy("g").agg(F.count("*").alias("times")).filter("times > 1"))
    ordered = rows.join(counted, "g").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("times", "g"))).alias("o"))
    sized = ordered.withColumn("c", F.size("o")).withColumn("first", F.expr(f"c - int(({percent} * n + 99) div 100) + 1")).filter("first > 0")
    front = sized.select("node", "n", "c", F.posexplode(F.slice("o", 1, F.col("first"))).alias("pos", "x")).select("node", "n", (F.col("c") - F.col("pos")).alias("rest"), F.col("x.g").alias("g"))
    # 100 rest >= percent (n + m - rest), solved for the partner's size m
    most = F.expr(f"int(((100 + {percent}) * rest - {percent} * n) div {percent})")
    front = front.join(labels, "node").withColumn("most", most).filter(F.col("most") * 100 >= percent * F.col("n"))
    front = cut(front)
    by_label = front.groupBy("g", "label").agg(F.count("*").alias("of"), F.min("n").alias("low"))
    heads = by_label.groupBy("g").agg(F.count("*").alias("labels"), F.max_by("label", "of").alias("major"), F.min("low").alias("low")).filter("labels > 1")
    return front.join(heads, "g").filter("most >= low").withColumn("minor", F.col("label") != F.col("major")).select("node", "n", "rest", "most", "g", "label", "minor")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(SIZE_STEP)).cast("int")


def meetings(front: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of sets that meet at a shingle and a size class, with `possible` for those that pass all bounds.

    The longer set `a` looks among the sizes that it could be linked with, which its own size and `most` bound.
    Pairs inside a shingle's largest label don't meet: one of the two is always minor.
    """
    low, high = F.ceil(F.col("n") * percent / 100).cast("int"), F.least("n", "most")
    longer = front.filter(low <= high).withColumn("size", F.explode(F.sequence(_size_class(low), _size_class(high))))
    shorter = front.withColumn("size", _size_class(F.col("n")))
    a, b = (side.select("g", "size", "minor", *(F.col(c).alias(c + name) for c in ("node", "n", "rest", "most", "label"))).withColumnRenamed("minor", "minor" + name) for side, name in ((longer, "a"), (shorter, "b")))
    ordered = (F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("nodeb") < F.col("nodea")))
    fits = (F.col("nb") <= F.col("mosta")) & (F.col("na") <= F.col("mostb")) & (100 * F.col("nb") >= percent * F.col("na"))
    can = _linked(F.least("resta", "restb"), F.col("na"), F.col("nb"), percent)
    met = a.filter("minora").join(b, ["g", "size"]).unionByName(a.filter("not minora").join(b.filter("minorb"), ["g", "size"]))
    return met.withColumn("possible", ordered & fits & can & (F.col("labela") != F.col("labelb")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row in."""
    out = _grouped(docs, id_col, text_col, percent)
    component = F.coalesce("label.id", F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows, with all their columns, of one document of each group: the smallest id's, and among texts that share it the one with the smallest hash.

    Rows are judged by id and text: different texts under one id belong each to its own group. Of rows with equal id and text
    the one with the smallest further columns stays. Texts without words are in no group and stay, as do all rows without an id.
    """
    out = _grouped(docs, id_col, text_col, percent).filter("id is not null")
    first = out.filter("label is not null").groupBy("label").agg(F.min(F.struct("id", "th")).alias("x")).select("x.id", "x.th")
    stay = cut(first.unionByName(out.filter("label is null").select("id", "th")).distinct())
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rows, hashed = docs.filter(F.col(id_col).isNotNull()), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    # equal rows become one before the shuffle, so that no row's copies gather; the join then finds both sides dealt by its keys
    single = rows.groupBy(F.col(id_col).cast("bigint").alias("_id"), hashed.alias("_th")).agg(F.min(F.struct(*others, id_col, text_col)).alias("_row"))
    kept = single.join(stay, (F.col("_id") == F.col("id")) & (F.col("_th") == F.col("th")), "left_semi").select("_row.*")
    return kept.select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(id, n, th, label) of each row: th hashes the text, label names its group; null for rows without words or id."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    base = cut(_map(texts, "id bigint, n bigint, th bigint, key binary, bands array<bigint>", _signed, 1))
    full = base.filter((F.col("n") > 0) & F.col("id").isNotNull())
    nodes = cut(full.groupBy("key").agg(F.min("id").alias("id"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    names = nodes.select("node", "id")

    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = cut(rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"))
    met = cut(rows.join(shared, "bucket"))
    # the hub of a bucket is its node with the most company in all buckets: what others were copied from rather than a copy
    company = met.groupBy("node").agg(F.sum("size").alias("company"))
    hubs = cut(met.join(company, "node").groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("hub")).select("bucket", F.col("hub.node").alias("hub")))
    hub_pairs = met.join(hubs, "bucket").filter("hub != node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()

    wanted = cut(met.select("node").distinct().join(nodes.select("node", "id", "key"), "node"))
    found = _map(texts.join(wanted.select("id").distinct(), "id", "left_semi"), "id bigint, key binary, s array<bigint>", _sets, 1)
    sets = cut(found.join(wanted, ["id", "key"]).groupBy("node").agg(F.first("s").alias("s")))

    links = cut(confirmed(hub_pairs, sets, percent))
    labels = components(links, names)

    # what the hubs did not settle
    of = met.select("bucket", "node").join(labels, "node", "left").select("bucket", "node", F.coalesce(F.col("label.node"), F.col("node")).alias("label"))
    open_buckets = of.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("bucket")
    unsettled = cut(of.join(open_buckets, "bucket", "left_semi").select("node", "label").distinct())
    more = cut(confirmed(contenders(sets.join(unsettled, "node", "left_semi"), unsettled, percent), sets, percent))
    if not more.isEmpty():
        labels = components(links.union(more), names)

    named = nodes.select("key", "node", "id").join(labels, "node", "left").select("key", F.coalesce("label", F.struct("id", "node")).alias("group"))
    out = base.drop("bands").join(named, "key", "left")
    return out.select("id", "n", "th", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("group")).alias("label"))
