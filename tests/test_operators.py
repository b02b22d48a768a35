"""The query layer: predicates against models of their own, scalars on all bytes, relations on small tables, and every query against its SQL."""

import itertools
import os
import random
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytefleet.functions import scalars as X
from bytefleet.functions.text import hex_inside, inside_matches, name_matches
from bytefleet.operators import compare, duplicates, integrity, listing, matching, search
from bytefleet.plans import registry

SF = "/root/testdata/sf0.001"


def model_name(name, pattern):
    """Character by character, as the semantics are put."""
    n, e = 0, 0
    if len(pattern) > 1 and pattern[0] == "%":
        n, e = (name.index(pattern[1]) if pattern[1] in name else len(name)), 1
    skip = e
    for k in range(e, len(pattern)):
        c = pattern[k]
        if c == "%":
            return True
        if c == "?":
            if n + k >= len(name):
                return False
        elif n + k - skip >= len(name) or name[n + k - skip] != c:
            return False
    return len(name) - n == len(pattern) - skip


def test_name_patterns(spark):
    names = ["".join(t) for n in range(6) for t in itertools.product("FOX", repeat=n)]
    df = spark.createDataFrame([(n,) for n in names], "n string").cache()
    patterns = ["FOO", "FOO%", "%FOO", "%FOO%", "F%O", "%", "", "?", "F?O", "%F?", "%F?O", "??%", "F??", "%XO", "fo%"]
    for p in patterns:
        got = {r[0] for r in df.filter(name_matches(F.col("n"), p)).collect()}
        assert got == {n for n in names if model_name(n, p.upper())}, p
    assert df.filter(name_matches(F.col("n"), "fo%", case_sensitive=True)).count() == 0
    for bad in ("%%A", "%?A"):
        with pytest.raises(ValueError):
            name_matches(F.col("n"), bad)


def test_inside_patterns(spark):
    df = spark.createDataFrame([("Hello\nWorld",), ("hel",), ("",), (None,)], "t string")
    for pattern, want in {"ELLO": 1, "l?w": 0, "o?w": 1, "HEL": 2, "hel?": 2, "?": 2, "h%l": 2, "z": 0}.items():
        assert df.filter(inside_matches(F.col("t"), pattern)).count() == want, pattern
    assert df.filter(inside_matches(F.col("t"), "World", True)).count() == 1 and df.filter(inside_matches(F.col("t"), "world", True)).count() == 0
    raw = spark.createDataFrame([(bytearray(b"\x00\xff\x41"),), (bytearray(b""),), (None,)], T.StructType([T.StructField("d", T.BinaryType())]))
    assert raw.filter(hex_inside(F.col("d"), "ff4")).count() == 1 and raw.filter(hex_inside(F.col("d"), "4142")).count() == 0


def test_scalars_on_all_bytes(spark):
    rows = [(bytearray([b]), b) for b in range(256)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("d", T.BinaryType()), T.StructField("b", T.IntegerType())]))
    shown = df.select("b", X.unsigned(F.col("d")).alias("u"), X.to_hex(F.col("d")).alias("h"), X.bit(F.col("b"), F.lit(2)).alias("lsb"), X.bit(F.col("b"), F.lit(2), True).alias("msb"), F.hex(X.trim_padding(F.concat(F.lit(b"A"), F.col("d")))).alias("t")).collect()
    for r in shown:
        assert r["u"] == r["b"] and r["h"] == f"{r['b']:02X}" and r["lsb"] == bool(r["b"] >> 2 & 1) and r["msb"] == bool(r["b"] >> 5 & 1)
        assert bytes.fromhex(r["t"]) == (b"A" + bytes([r["b"]])).rstrip(b"\xa0\x00")
    one = spark.range(1)
    got = one.select(X.long_hex(F.lit(0)).alias("a"), X.long_hex(F.lit(4095)).alias("b"), F.hex(X.number_bytes(F.lit(258))).alias("c"), X.to_integer(F.lit("x")).alias("d"), X.is_integer(F.lit("7")).alias("e"), X.round_half_up(F.lit(-0.5)).alias("f"), X.extension(F.lit("a/b.Tar.gz")).alias("g"), X.directory(F.lit("a/b/c")).alias("h"), X.name_83(F.lit(b"ABC     TXT")).alias("i"), X.match_label(F.lit(False), F.lit(7)).alias("j")).first()
    assert tuple(got) == ("", "0FFF", "02010000", 0, True, 0, "GZ", "a/b", "ABC.TXT", "7%   ")


def signed_hash(data):
    h = len(data)
    s = [b - 256 if b > 127 else b for b in data]
    for k in range(0, len(data) - 1, 2):
        h ^= (s[k + 1] << 8) | s[k]
    return h


def test_xor_hash(spark):
    values = [b"", b"a", b"ab", b"abc", bytes(range(256)), b"\xff\x01\x02\xff"]
    df = spark.createDataFrame([(bytearray(v),) for v in values], T.StructType([T.StructField("d", T.BinaryType())]))
    assert sorted(r[0] for r in df.select(X.xor_hash(F.col("d"))).collect()) == sorted(map(signed_hash, values))
    assert spark.range(1).select(X.xor_hash(F.lit(None).cast("binary"))).first()[0] == -1


def test_scores(spark):
    def grams(t, step):
        g = {t[k : k + 8] for k in range(0, len(t) - 7, step)}
        return g | ({t[-8:]} if step == 8 and len(t) > 8 and len(t) % 8 else set())

    def score(a, b):
        fa, fb = grams(a, 8), grams(b, 8)
        if not fa or not fb:
            return 0
        p1, p2 = len(fa & grams(b, 1)) / len(fa), len(fb & grams(a, 1)) / len(fb)
        return int(min(len(a), len(b)) / max(len(a), len(b)) * p1 * p2 * 30 + p1 * 35 + p2 * 35 + 0.5)

    texts = ["", "short", "exactly8", "exactly8 and more", "the quick brown fox jumps over", "the quick brown fox jumps under", "xx the quick brown fox", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r["id1"], r["id2"]): r["score"] for r in matching.scores(df, df, "id", "id").collect()}
    want = {(i, j): s for i, a in enumerate(texts) for j, b in enumerate(texts) if a and b and (s := score(a, b))}
    assert got == want and got[2, 2] == 100


def test_classify_by_priority(spark):
    rows = [(1, "a", "d1", "same text here, long enough"), (2, "b", "d2", "the quick brown fox jumps over"), (3, "c", "d3", "nothing alike"), (4, "e", "d4", "")]
    other = [(1, "z", "d1", "same text here, long enough"), (2, "b", "d5", "the quick brown fox jumps under"), (3, "c", "d6", "all differs!"), (4, "e", "d4", "")]
    a, b = (spark.createDataFrame(r, "id int, name string, digest string, text string") for r in (rows, other))
    deep = {(r["id1"], r["id2"]): (r["label"], r["equal"]) for r in matching.classify(a, b, 60).collect()}
    assert deep[1, 1] == ("MATCH", True) and deep[2, 2][0].startswith("M-") and deep[3, 3] == ("DIFF", False) and deep[4, 4] == ("DIFF", False)
    flat = {(r["id1"], r["id2"]): r["label"] for r in matching.classify(a, b).collect()}
    assert flat[2, 2] == "DIFF" and (1, 2) not in flat
    with pytest.raises(ValueError):
        matching.classify(a, b, 0)


def test_compare_two_disks(spark):
    schema = "path string, name string, type string, size bigint, digest string"
    a = spark.createDataFrame([("/same", "same", "PRG", 1, "x"), ("/diff", "diff", "PRG", 1, "x"), ("/old/m", "m", "SEQ", 2, "m"), ("/gone", "gone", "PRG", 3, "g"), ("/null", "null", "DIR", 0, None)], schema)
    b = spark.createDataFrame([("/same", "same", "PRG", 1, "x"), ("/diff", "diff", "PRG", 1, "y"), ("/new/M", "M", "SEQ", 2, "m"), ("/come", "come", "PRG", 3, "h"), ("/null", "null", "DIR", 0, None)], schema)
    got = sorted((r["kind"], r["path1"] or "", r["path2"] or "") for r in compare.compare(a, b).collect())
    assert got == [("differs", "/diff", "/diff"), ("missing1", "", "/come"), ("missing2", "/gone", ""), ("moved", "/old/m", "/new/M")]


def test_moved_classes_hold_what_the_pairs_say(spark):
    schema = "path string, name string, type string, size bigint, digest string"
    side = [("/both", "both", "PRG", 1, "x"), *((f"/{k}/c", "c", "PRG", 2, "c") for k in range(3)), ("/n", "n", "DIR", 0, None), ("/unnamed", None, "PRG", 1, "u"), ("/gone", "gone", "PRG", 1, "g")]
    other = [("/both", "both", "PRG", 1, "x"), *((f"/{k}/C", "C", "PRG", 2, "c") for k in range(2)), ("/N", "N", "DIR", 0, None), ("/Unnamed", None, "PRG", 1, "u")]
    a, b = spark.createDataFrame(side, schema), spark.createDataFrame(other, schema)
    pairs = [(r["path1"], r["path2"]) for r in compare.compare(a, b).filter("kind = 'moved'").collect()]
    rows = compare.moved_classes(a, b).collect()
    for n in (1, 2):
        links = Counter(p[n - 1] for p in pairs)
        assert links and {r["path"]: r["links"] for r in rows if r["side"] == n} == links
    named = {(r["side"], r["path"]): r["class_path"] for r in rows}
    assert {(p, q) for (s, p), c in named.items() for (t, q), d in named.items() if s == 1 and t == 2 and c == d} == set(pairs)
    assert len(rows) == len(named) and compare.moved_classes(a.limit(0), b).count() == 0


def test_exact_classes_and_containment_hold_what_the_pairs_say(spark):
    schema = "id bigint, container string, is_dir boolean, name string, digest string, text string"
    first = [(k, f"d{k % 3}", k == 4, f"n{k}", f"h{k % 4}", "t") for k in range(12)] + [(20, "d0", False, "e", "empty", ""), (21, "d1", False, "z", None, None), (22, None, False, "q", "h1", "t")]
    second = [(k, f"x{k % 2}", False, f"m{k}", f"h{k % 5}", "t") for k in range(30, 40)] + [(50, "x0", False, "e2", "empty", "")]
    a, b = spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)
    pairs = matching.classify(a, b)
    equal = [(r["id1"], r["id2"]) for r in pairs.filter("equal").collect()]
    rows = matching.exact_classes(a, b).collect()
    assert len(rows) == len(first) + len(second)
    for n in (1, 2):
        links = Counter(p[n - 1] for p in equal)
        assert {r["id"]: r["links"] for r in rows if r["side"] == n and r["links"]} == links
    classes = {(r["side"], r["id"]): r["class_id"] for r in rows if r["class_id"] is not None}
    assert {(p, q) for (s, p), c in classes.items() for (t, q), d in classes.items() if s == 1 and t == 2 and c == d} == set(equal)
    assert classes[2, 34] == 34 and (1, 20) not in classes and (1, 21) not in classes
    whole = sorted(map(tuple, matching.containment(pairs, a, b, "container").collect()))
    assert whole and sorted(map(tuple, matching.exact_containment(a, b, "container").collect())) == whole
    assert matching.exact_containment(a, b.limit(0), "container").count() == 0


def test_coverage(spark):
    rows = [(f"d/{n}", "d", n, f"h{n}") for n in range(20)] + [("e/0", "e", 1, "zz")]
    probe = spark.createDataFrame(rows, "path string, dir string, length bigint, hash string")
    known = probe.filter("hash <> 'h7' and hash <> 'zz'").unionByName(probe.filter("hash = 'zz'").withColumn("length", F.lit(9).cast("bigint")))
    got = {r["dir"]: (r["total"], r["matches"], r["pct"]) for r in duplicates.coverage(probe, known).collect()}
    assert got == {"d": (20, 19, 95), "e": (1, 0, 0)}
    assert [r["path"] for r in duplicates.nearly_complete(probe, known, over=90).collect()] == ["d/7"]
    assert duplicates.nearly_complete(probe, known).count() == 0 and duplicates.unknown(probe, known).count() == 1
    valid, stale = duplicates.refreshed(probe.withColumn("modified", F.lit(1)), known.withColumn("modified", F.lit(1)))
    assert valid.count() == 19 and stale.count() == 1


def test_integrity(spark):
    bam = spark.createDataFrame([("i", 1, s, s % 2 == 0) for s in range(4)], "image string, track int, sector int, is_free boolean")
    used = spark.createDataFrame([("i", "a", 1, 0), ("i", "a", 1, 1)], "image string, file string, track int, sector int")
    marks = integrity.allocation(bam, used)
    assert {r["sector"]: r["mark"] for r in marks.collect()} == {0: "0", 1: "x", 2: "o", 3: "#"}
    assert integrity.allocation_counts(marks).first()[1:] == (1, 1)
    fixed = {r["sector"]: r["is_free"] for r in integrity.repaired(marks).collect()}
    assert fixed == {0: False, 1: False, 2: True, 3: True}
    links = spark.createDataFrame([("i", f, 1, s) for f, ss in {"A": [1, 2], "B": [1, 2, 3], "C": [3, 4], "D": [9], "E": [1, 2]}.items() for s in ss], "image string, file string, track int, sector int")
    got = {(r["file"], r["other"]): r["kind"] for r in integrity.cross_links(links).collect()}
    assert got == {("A", "B"): "inside", ("B", "A"): "contains", ("A", "E"): "inside", ("E", "A"): "inside", ("E", "B"): "inside", ("B", "E"): "contains", ("B", "C"): "overlaps", ("C", "B"): "overlaps"}


def test_listing(spark):
    e = spark.createDataFrame([("t", 10, 12), ("t", 20, 50118), ("t", 20, 50118), ("t", 40, 50118)], "g string, s bigint, e bigint")
    assert sorted(tuple(r)[1:] for r in listing.repaired_ends(e, "g", "s", "e", F.lit(100)).select("g", "s", "end_fixed").collect()) == [(10, 12), (20, 39), (20, 39), (40, 99)]
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c")], "node string, parent string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in listing.descendants(edges, roots).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    files = spark.createDataFrame([("Dir/File",), ("dir/file",), ("dir/file/x",)], "p string")
    assert listing.lookup(files, "p", "dir/file").first()[0] == "dir/file" and listing.lookup(files, "p", "DIR/FILE").first()[0] == "Dir/File"
    assert listing.subtree(files, "p", "dir/file").count() == 1
    named = spark.createDataFrame([(1, "n"), (2, "n"), (3, "m")], "o int, t string")
    assert sorted(r["target"] for r in duplicates.suffixed(named, "t", "o").collect()) == ["m", "n", "n_1"]


def test_catalog(spark):
    f = spark.createDataFrame([("i", "b", 2, bytearray(b"xy"), "PRG"), ("i", "a", 1, None, "DIR")], T.StructType([T.StructField("image", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("ord", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("file_type", T.StringType())]))
    images = spark.createDataFrame([("i", bytearray(b"whole"))], T.StructType([T.StructField("image", T.StringType()), T.StructField("content", T.BinaryType())]))
    rows = {r["filenum"]: tuple(r) for r in search.catalog(f, images).collect()}
    assert rows[0][1] == "*" and rows[0][5] == "dsk" and rows[2][1:4] == ("b", 2, 2) and rows[1][4] is None


def _same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return abs(a - b) <= 1e-9 * max(1, abs(a), abs(b))
    return a == b


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    relation = duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    place = [relation.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(r[i] for i in place) for r in relation.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(_same(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_whole_comparison_accounts_for_every_document(spark):
    found = {k: registry.QUERIES[f"compare_all_{k}"](spark, SF).collect() for k in ("differs", "moved", "missing1", "missing2")}
    from bytefleet.plans.relation_queries import _whole_disk

    sides = [[r["path"] for r in _whole_disk(spark, SF, even).collect()] for even in (True, False)]
    sources = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("source").collect()]
    for n, paths in enumerate(sides):
        assert len(paths) == len(set(paths)) == sum(int(s[3:8]) % 2 == n for s in sources)
    # what is on one side alone is found as moved or missing
    only = [set(sides[0]) - set(sides[1]), set(sides[1]) - set(sides[0])]
    assert only[0] == {r["path1"] for k in ("moved", "missing2") for r in found[k]}
    assert only[1] == {r["path2"] for k in ("moved", "missing1") for r in found[k]}
    assert found["differs"] and {r["path1"] for r in found["differs"]} <= set(sides[0]) & set(sides[1])


def test_partition_addresses_of_large_keys(spark, tmp_path):
    keys = [0, 1, 65535, 65536, 65537, 70000, 119999, 1199999, 1 << 24, (1 << 31) + 5, 1 << 45, None]
    spark.createDataFrame([(k,) for k in keys], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    names = ("p_partkey", "address", "digits", "back")
    got = [tuple(r[n] for n in names) for r in registry.QUERIES["partition_addr"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({registry.ORACLE_SQL['partition_addr']})").fetchall(), key=repr)


def _links_by_hand(used):
    sectors = {}
    for i, f, *s in set(used):
        if f is not None:
            sectors.setdefault((i, f), set()).add(tuple(s))
    met = {(a, b): {s for s in sectors[a] & sectors[b] if None not in s} for a, b in itertools.permutations(sectors, 2) if a[0] == b[0] and a[0] is not None}
    kind = {(a, b): "inside" if len(s) == len(sectors[a]) else "contains" if len(s) == len(sectors[b]) else "overlaps" for (a, b), s in met.items()}
    return sorted((a[0], a[1], b[1], len(s), kind[a, b]) for (a, b), s in met.items() if s)


@pytest.mark.parametrize("rows_held", [7, 1 << 20])
def test_cross_links_shuffle_no_pairs(spark, monkeypatch, rows_held):
    draw = random.Random(3)
    used = [(draw.choice("ij"), f"file {draw.randrange(40)}", draw.randrange(3), draw.randrange(9)) for _ in range(500)] + [("i", f"same {n}", 1, s) for n in range(30) for s in range(5)]
    used += [("k", "alone", 1, 1), ("i", "file 1", None, 1), ("i", "file 2", None, 1), ("i", None, 1, 1), (None, "a", 1, 1), (None, "b", 1, 1)]
    monkeypatch.setattr(integrity, "PIECE_ROWS", rows_held)
    df = integrity.cross_links(spark.createDataFrame(used, "image string, file string, track int, sector int"))
    assert sorted(tuple(r) for r in df.collect()) == _links_by_hand(used)
    above = df._jdf.queryExecution().sparkPlan().toString().partition("MapInArrow")
    assert above[1] and not any(x in above[0] for x in ("Join", "Aggregate", "Exchange"))


@pytest.mark.parametrize("pairs", [1, 40, 1 << 19])
@pytest.mark.parametrize("pieces", [1, 3])
def test_pairs_are_counted_in_parts(monkeypatch, pairs, pieces):
    monkeypatch.setattr(integrity, "PAIRS", pairs)
    draw = random.Random(5)
    used = sorted({(draw.choice((1, 2)), draw.randrange(25), draw.randrange(12)) for _ in range(260)} | {(1, 99, s) for s in range(12)})
    size = Counter(r[:2] for r in used)
    rows = sorted((i, p, f % pieces != p, f, size[i, f], i * 100 + s) for i, f, s in used for p in range(pieces))
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 6], strict=True)], names=["_i", "_piece", "_away", "_f", "_n", "_sector"]) for k in range(0, len(rows), 6)]
    got = [tuple(r.values()) for b in integrity._counted_pairs(iter(batches)) for r in b.to_pylist()]
    assert sorted((*r[:4], ("inside", "contains", "overlaps")[r[4]]) for r in got) == _links_by_hand(used)
