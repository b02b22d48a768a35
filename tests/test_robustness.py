"""Broken inputs give rows with errors; hot groups and thresholds give the same rows as the plain way."""

import gzip
import io
import random
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bytefleet.functions import scalars as X
from bytefleet.operators import listing, matching, ordinals, rewrite, search
from bytefleet.sources import containers, stores
from bytefleet.sources.formats import FormatError, archives, volumes
from bytefleet.sources.formats.disk import Disk, formatted


def entries(spark, rows):
    return spark.createDataFrame([("c", e, None if d is None else bytearray(d), None) for e, d in rows], containers.ENTRIES)


def files(spark, rows):
    return spark.createDataFrame([(p, bytearray(d)) for p, d in rows], "path string, content binary")


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_broken_packed_files_are_rows_with_an_error(spark):
    good = gzip.compress(b"some text that is packed" * 9, mtime=0)
    bad = bytearray(good)
    bad[len(good) // 2] ^= 0xFF
    rows = containers.expand(files(spark, [("a.prg.gz", good), ("b.prg.gz", bytes(bad)), ("c.prg.gz", good[:-9]), ("d.prg.gz", b"no"), ("e.zip", b"PK\x03\x04 no"), ("f.zip", zipped([("x.prg.gz", bytes(bad)), ("y.prg", b"kept")])), ("g.prg.gz", good + good), ("h.zip", b"")])).collect()
    got = {(r["container"], r["entry"]): (None if r["content"] is None else bytes(r["content"]), r["error"]) for r in rows}
    assert got["a.prg.gz", "a.prg.gz"][0] == b"some text that is packed" * 9 and got["g.prg.gz", "g.prg.gz"][0] == b"some text that is packed" * 18
    for key in (("b.prg.gz", "b.prg.gz"), ("c.prg.gz", "c.prg.gz"), ("d.prg.gz", "d.prg.gz"), ("e.zip", "e.zip"), ("f.zip", "x.prg.gz"), ("h.zip", "h.zip")):
        assert got[key][0] is None and got[key][1], key
    assert got["f.zip", "y.prg"] == (b"kept", None)
    with pytest.raises(FormatError):
        containers.inflated(gzip.compress(bytes(5000)), cap=4999)


def test_members_that_do_not_tell_their_size():
    data = zipped([("a.prg", b"hello " * 50)])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        info = z.infolist()[0]
        info.file_size = 0
        assert containers._member(z, data, info) == b"hello " * 50


def test_a_broken_file_of_each_kind(spark):
    """Every kind of container with junk inside gives at least one row with an error, and none fails the task."""
    kinds = ["d64", "d71", "d81", "d80", "d82", "dnp", "t64", "lnx", "lbr", "arc", "sda", "wra", "p00"]
    rows = containers.parse(entries(spark, [(f"x.{k}", b"junk!") for k in kinds] + [("y.d64", None)])).collect()
    failed = {r["entry"] for r in rows if r["error"]}
    assert failed == {f"x.{k}" for k in kinds} | {"y.d64"}
    assert {r["message"] for r in search.messages(containers.parse(entries(spark, [("x.d64", b"junk!"), ("z.d64", b"junk!")]))).collect()} == {"the image is 174843 bytes short"}
    assert containers.bitmaps(entries(spark, [("x.d64", b"junk!"), ("n.d64", None)])).count() == 683


def test_bad_volume_sets_are_rows_with_an_error(spark):
    packs = volumes.pack_four(formatted("D64"))
    rows = [(f"/a/{k}!whole", p) for k, p in enumerate(packs, 1)] + [(f"/a/{k}!part", p) for k, p in enumerate(packs[:3], 1)] + [(f"/b/{k}!junk", b"x" * 9) for k in range(1, 5)]
    got = {r["entry"]: r for r in containers.unpacked_volumes(files(spark, rows)).collect()}
    assert set(got) == {"whole.d64", "part.d64", "junk.d64"} and bytes(got["whole.d64"]["content"]) == formatted("D64")
    assert all(got[e]["content"] is None and got[e]["error"] for e in ("part.d64", "junk.d64"))


def test_partitions_meet_their_own_replacements(spark):
    def drive(mark):
        out = bytearray(512 * 700)
        out[volumes.TABLE : volumes.TABLE + 2 + 256 * 32] = volumes.write_partitions([(1, "A", 1, 512 * 600, 512), (2, "B", 1, 512 * 601, 512)])
        out[512 * 600 : 512 * 602] = mark * 1024
        return bytes(out)

    drives = files(spark, [("one", drive(b"1")), ("two", drive(b"2")), ("none", b"no table")])
    new = spark.createDataFrame([("one", "1_a.dnp", bytearray(b"x" * 512)), (None, "2_B.dnp", bytearray(b"y" * 512)), ("two", "9_z.dnp", bytearray(b"z"))], "path string, file_name string, content binary")
    got = {r["path"]: r for r in rewrite.replaced_partitions(drives, new).collect()}
    parts = {p: bytes(got[p]["content"])[512 * 600 : 512 * 602] for p in ("one", "two")}
    assert parts == {"one": b"x" * 512 + b"y" * 512, "two": b"2" * 512 + b"y" * 512} and (got["one"]["n"], got["two"]["n"]) == (2, 1)
    assert got["none"]["error"] and got["none"]["content"] is None
    short = spark.createDataFrame([("1_a.dnp", bytearray(b"x"))], "file_name string, content binary")
    assert all(r["error"] for r in rewrite.replaced_partitions(drives, short).collect())
    assert {(r["path"], r["number"]) for r in containers.partition_table(drives).collect()} == {(p, n) for p in ("one", "two") for n in (1, 2)}


def test_changes_are_put_back(spark):
    image = Disk(formatted("D64"), "D64").inserted("OLD", b"old", "SEQ")
    found = files(spark, [("a.zip", zipped([("note.seq", b"n"), ("d.d64", image), ("e.d64.gz", gzip.compress(image))])), ("b.d64.gz", gzip.compress(image)), ("c.d64", image), ("d.d64", b"")])
    changed = rewrite.insert(containers.expand(found).filter("entry like '%.d64%'"), "NEW", b"new", "SEQ")
    got = {r["path"]: r for r in rewrite.put_back(found, changed).collect()}
    assert set(got) == {"a.zip", "b.d64.gz", "c.d64", "d.d64"}
    back = containers.parse(containers.expand(rewrite.put_back(found, changed).filter("error is null"))).filter("data is not null").collect()
    assert {(r["container"], r["entry"], r["file_name"]) for r in back if r["container"] != "d.d64"} == {("a.zip", "note.seq", "note"), *((c, e, n) for c, e in (("a.zip", "d.d64"), ("a.zip", "e.d64.gz"), ("b.d64.gz", "b.d64.gz"), ("c.d64", "c.d64")) for n in ("old", "new"))}


def test_a_file_is_replaced_and_goes_into_its_directory():
    image = Disk(formatted("D64"), "D64").inserted("ONE", b"first", "SEQ")
    again = Disk(Disk(image, "D64").inserted("ONE", b"second contents" * 40, "SEQ"), "D64")
    assert [(r["file_path"], r["data"]) for r in again.files() if r["data"] is not None] == [("one", b"second contents" * 40)]
    assert Disk(image, "D64").free_blocks() - again.free_blocks() == 2
    # a subdirectory: a header sector whose link leads to a page of entries
    made = Disk(formatted("DNP"), "DNP")
    made = Disk(made.inserted("SUB", b"x", "SEQ"), "DNP")
    row, (page,) = made.find("sub"), made.free_sectors(1)
    out, g = bytearray(made.with_allocation([page], free=False)), made.geometry
    track, sector, at = row["dir_loc"]
    out[g.offset(track, sector) + at] = 128 | 6
    out[g.offset(*row["sectors"][0]) : g.offset(*row["sectors"][0]) + 2] = bytes(page)
    out[g.offset(*page) : g.offset(*page) + 256] = b"\x00\xff" + bytes(254)
    inside = Disk(Disk(bytes(out), "DNP").inserted("sub/inner", b"within", "PRG"), "DNP")
    assert inside.find("sub/inner")["data"] == b"within"
    assert Disk(inside.inserted("sub/inner", b"anew", "PRG"), "DNP").find("sub/inner")["data"] == b"anew"
    with pytest.raises(FormatError):
        inside.inserted("sub", b"", "PRG")


def test_running_sums_equal_plain_windows(spark):
    """One group holds most rows, one is null, orders repeat and are null: the pieces add up to what one window gives."""
    draw = random.Random(1)
    rows = [(None if k % 50 == 0 else "hot" if k % 10 else f"g{k % 7}", None if k % 97 == 0 else k, draw.randint(-5, 9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint").withColumn("d", F.lit("x"))
    w = Window.partitionBy("g").orderBy("o")
    for before in (False, True):
        frame = w.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        # rows without an order come first in any order, so only the others are compared
        want = df.withColumn("s", F.coalesce(F.sum("v").over(frame), F.lit(0))).filter("o is not null")
        got = ordinals.running_sums(df, "g", "o", {"s": F.col("v")}, before)
        assert got.columns == want.columns and sorted(map(str, got.filter("o is not null").collect())) == sorted(map(str, want.collect()))
    assert ordinals.row_numbers(df.filter("v > 99"), "g", "o", "n").count() == 0
    plan = ordinals.row_numbers(df, "g", "o", "n")._jdf.queryExecution().toString()
    assert "_piece" in plan


def test_contenders_miss_no_score(spark):
    draw = random.Random(2)
    words = [draw.choice("alpha beta gamma delta omega sigma kappa".split()) for _ in range(400)]
    base = [" ".join(words[20 * k : 20 * k + 18]) for k in range(18)]
    texts = [b if draw.random() < 0.5 else b[: len(b) // 2] + draw.choice(base)[10:60] for b in base for _ in range(3)] + ["", "short", "x" * 40, "😀 smile " * 6, "common head of all files " + "q" * 30]
    a = spark.createDataFrame(list(enumerate(texts[::2])), "id bigint, text string")
    b = spark.createDataFrame(list(enumerate(texts[1::2] + texts[:6])), "id bigint, text string")
    full = {(r["id1"], r["id2"]): r["score"] for r in matching.scores(a, b, "id", "id").collect()}
    for least in (5, 30, 60, 95, 100):
        pairs = matching.contenders(a, b, least)
        got = {(r["id1"], r["id2"]): r["score"] for r in matching.scores_of(pairs, a, b).collect()}
        assert {k: v for k, v in full.items() if v >= least} == {k: v for k, v in got.items() if v >= least}
        assert all(full.get(k, 0) == v for k, v in got.items())
    assert matching.contenders(a, b, 60).count() < len(full)


def test_scores_of_bytes_are_those_of_signed_numbers(spark):
    def numbers(data, keep):
        out, r = set(), 0
        for k, byte in enumerate(data):
            r = ((r << 8) | (byte - 256 if byte > 127 else byte)) & (1 << 64) - 1
            out |= {r} if keep(k) else set()
        return out

    def blocks(data):
        starts = [*range(0, len(data) - 7, 8), *([len(data) - 8] if len(data) > 8 and len(data) % 8 else [])]
        return {n for at in starts for n in numbers(data[at : at + 8], lambda k: k == 7)}

    def score(a, b):
        p1, p2 = (len(blocks(x) & numbers(y, lambda k: True)) / max(len(blocks(x)), 1) for x, y in ((a, b), (b, a)))
        return int(min(len(a), len(b)) / max(len(a), len(b), 1) * p1 * p2 * 30 + p1 * 35 + p2 * 35 + 0.5)

    draw = random.Random(5)
    base = [bytes(draw.choice((0, 0, 65, 66, 127, 128, 200, 255)) for _ in range(n)) for n in (0, 3, 7, 8, 9, 16, 40, 41, 200)]
    files = [*base, b"\x00" * 20, b"\x00\x00\x00\x00\x00abc" * 3, b"abc", b"\xff" * 12, b"\x80", *(base[-1][k : k + 90] for k in (0, 5, 64)), b"ab\xe9cdefghijk", b"xy\xe9cdefghijk", None]
    df = spark.createDataFrame([(k, f) for k, f in enumerate(files)], "id bigint, data binary").withColumn("text", F.decode("data", "ISO-8859-1"))
    got = {(r["id1"], r["id2"]): r["score"] for r in matching.scores(df, df, "id", "id", binary=True).collect()}
    assert got == {(i, j): s for i, a in enumerate(files) for j, b in enumerate(files) if a is not None and b is not None and (s := score(a, b))}
    near = {(r["id1"], r["id2"]): r["score"] for r in matching.scores_of(matching.contenders(df, df, 40, binary=True), df, df, binary=True).collect()}
    assert {k: v for k, v in near.items() if v >= 40} == {k: v for k, v in got.items() if v >= 40}


def test_grams_count_characters(spark):
    text = "ab😀defgh😀jk" + "é" * 9
    r = spark.createDataFrame([(text, "plain text of some length"), ("1234567", None)], "t string, u string").select(matching.sliding_grams(F.col("t")).alias("w"), matching.block_grams(F.col("t")).alias("b"), matching.sliding_grams(F.col("u")).alias("v")).collect()
    assert r[0]["w"] == list(dict.fromkeys(text[k : k + 8] for k in range(len(text) - 7)))
    assert r[0]["b"] == list(dict.fromkeys([*(text[k : k + 8] for k in range(0, len(text) - 7, 8)), text[-8:]]))
    assert r[0]["v"] == [("plain text of some length")[k : k + 8] for k in range(18)] and r[1]["w"] == [] == r[1]["b"]


def test_files_of_one_place_are_not_matched(spark):
    rows = [(1, "a", "n", "d1", "text"), (2, "a", "n2", "d1", "text"), (3, "b", "n3", "d1", "text")]
    df = spark.createDataFrame(rows, "id bigint, place string, name string, digest string, text string")
    got = {(r["id1"], r["id2"]) for r in matching.classify(df, df, place="place").collect()}
    assert got == {(1, 3), (3, 1), (2, 3), (3, 2)}


def test_character_codes():
    assert [X.ascii_of(b) for b in (0x41, 0x61, 0xC1, 0xDA, 0xDB, 0xC0, 0xE0, 0xFF, 0x0D, 0x93, 0xA0, 0x30)] == [0x61, 0x41, 0x41, 0x5A, 0xDB, 0x60, 0xA0, 0xBF, 0x0A, 0x0C, 0x20, 0x30]
    assert [X.petscii_of(b) for b in (0x41, 0x5A, 0x60, 0x61, 0x7B, 0x7F, 0x09, 0x0A, 0x93)] == [0xC1, 0xDA, 0xC0, 0x41, 0xDB, 0xDF, 0x20, 0x0A, 0x0C]
    assert all(X.ascii_of(X.petscii_of(b)) == b for b in range(0x20, 0x7B))


def test_deep_trees_and_distinct_lines(spark):
    chain = spark.createDataFrame([(f"n{k + 1}", f"n{k}") for k in range(12)] + [("n3", "n12")], "node string, parent string")
    got = {r["node"]: r["depth"] for r in listing.descendants(chain, spark.createDataFrame([("n0",)], "node string")).collect()}
    assert got == {f"n{k}": k for k in range(13)}
    assert sorted(r["line"] for r in listing.distinct_lines(spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "line string"), "line").collect()) == ["a", "b"]


def test_entry_works_without_the_libraries_of_the_subpackage(monkeypatch):
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("bytefleet.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    assert "inside_ci" in entry.queries() and not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert archives.BROKEN_END == 50118


def test_files_of_a_store(spark, tmp_path):
    names = ["plain", "with % and #", "50%25"]
    rows = spark.createDataFrame([(n, k, bytearray(n.encode() * 3), "PRG") for k, n in enumerate(names)], "file_path string, ord int, data binary, file_type string")
    for folder in (f"{tmp_path}/a", f"file://{tmp_path}/b", f"file:{tmp_path}/c"):
        for _ in range(2):  # a second run replaces the files of the first
            assert rewrite.extracted(rows, folder).count() == 3
        place = tmp_path / folder[-1]
        assert {p.name: p.read_bytes() for p in place.iterdir()} == {n: n.encode() * 3 for n in names}
    assert stores.located(f"file:{tmp_path}/a")[1] == stores.located(f"file://{tmp_path}/a")[1] == f"{tmp_path}/a"
    (tmp_path / "drive").write_bytes(bytes(range(100)))
    assert stores.read_part(f"file://{tmp_path}/drive", 90, 20) == bytes(range(90, 100)) and stores.read_part(f"{tmp_path}/drive", 500, 20) == b""
    assert containers.partitions(spark, [f"{tmp_path}/drive"]).count() == 0
