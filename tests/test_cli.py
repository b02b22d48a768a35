"""The command line over small folders, and the rule for desktop files."""

import pytest
from pyspark.sql import types as T
from test_formats import filled

from bytefleet import cli
from bytefleet.operators import matching
from bytefleet.sources.formats import archives, volumes
from bytefleet.sources.formats.disk import Disk


@pytest.fixture
def folders(tmp_path):
    image, contents = filled("D64", 5)
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "one.d64").write_bytes(image)
    (tmp_path / "b" / "two.d64").write_bytes(Disk(Disk(image, "D64").scratched("file2"), "D64").inserted("other", contents["file4"]))
    return tmp_path, contents


def lines(capsys, spark, *args):
    capsys.readouterr()
    assert cli.main([str(a) for a in args], spark) == 0
    return [tuple(x.split("\t")) for x in capsys.readouterr().out.splitlines()[1:]]


def test_commands(spark, folders, capsys):
    top, contents = folders
    a, b = top / "a", top / "b"
    assert [x[1] for x in lines(capsys, spark, "search", a, "FILE3")] == ["file3"]
    assert len(lines(capsys, spark, "search", a, "file%")) == 5
    assert {x[1] for x in lines(capsys, spark, "search", a, "FCFDFEFF", "--hex")} == {n for n, d in contents.items() if bytes([252, 253, 254, 255]) in d}
    assert len(lines(capsys, spark, "catalog", a)) == 5
    assert {(x[0], x[1], x[2]) for x in lines(capsys, spark, "compare", a, b)} == {("missing2", "file2", ""), ("missing1", "", "other")}
    labels = {(x[0].split("#")[1], x[1].split("#")[1]): x[2] for x in lines(capsys, spark, "match", a, b)}
    assert labels["6", "4"] == "MATCH" and len([v for v in labels.values() if v == "MATCH"]) == 4
    assert [x[1:] for x in lines(capsys, spark, "duplicates", a, b)] == [("5", "4", "80")]
    assert len(lines(capsys, spark, "duplicates", a, b, "--missing", "--over", "70")) == 1
    assert [x[1] for x in lines(capsys, spark, "list", a)] == [f"file{k},p" for k in range(5)]
    assert lines(capsys, spark, "list", a, "--dir")[2][1].startswith('1    "file0"')
    assert lines(capsys, spark, "check", a) == [] and lines(capsys, spark, "check", a, "--bitmap") == []


def test_changes(spark, folders, capsys):
    top, contents = folders
    a, out = top / "a", top / "out"
    lines(capsys, spark, "extract", a, out / "*", "--with-type")
    assert (out / "one" / "file3.prg").read_bytes() == contents["file3"]
    lines(capsys, spark, "lynx", a, out)
    packed = next(out.glob("*.lnx")).read_bytes()
    assert {r["file_path"]: r["data"] for r in archives.read_lynx(packed)} == {k: v for k, v in contents.items() if v}
    (top / "new.bin").write_bytes(b"fresh")
    lines(capsys, spark, "insert", a, out / "i", "added", top / "new.bin", "--type", "SEQ")
    assert Disk((out / "i" / "one.d64").read_bytes(), "D64").find("added")["data"] == b"fresh"
    lines(capsys, spark, "scratch", a, out / "s", "file1")
    assert len(Disk((out / "s" / "one.d64").read_bytes(), "D64").files()) == 6
    (top / "bad").mkdir()
    image = (a / "one.d64").read_bytes()
    disk = Disk(image, "D64")
    (top / "bad" / "x.d64").write_bytes(Disk(disk.with_allocation(disk.find("file4")["sectors"], free=True), "D64").with_allocation([(30, 1)], free=False))
    found = lines(capsys, spark, "check", top / "bad", "--bitmap")
    assert {x[3] for x in found} == {"0", "#"} and [x[3] for x in lines(capsys, spark, "check", top / "bad")] == ["not allocated"]
    lines(capsys, spark, "repair", top / "bad", out / "r")
    assert (out / "r" / "x.d64").read_bytes() == image
    (top / "loose").mkdir()
    (top / "loose" / "prog.prg").write_bytes(b"\x01\x08code")
    lines(capsys, spark, "convert", top / "loose", out / "p")
    assert archives.read_p00((out / "p" / "prog.P00").read_bytes())[0]["data"] == b"\x01\x08code"
    lines(capsys, spark, "convert", out / "p", out / "q", "--unwrap")
    assert (out / "q" / "prog").read_bytes() == b"\x01\x08code"


def test_partitions(spark, tmp_path, capsys):
    drive = bytes(volumes.TABLE) + volumes.write_partitions([(1, "WORK", 2, 512 * 600, 174_592)])
    (tmp_path / "d.hdd").write_bytes(drive)
    assert lines(capsys, spark, "partitions", tmp_path / "d.hdd") == [("1", "work", "D64", "04B000", "174592")]


def test_desktop_files_match_by_their_own_rule(spark):
    def made(first, info, body):
        return bytearray(first.ljust(30, b"\x00") + b"PRG formatted GEOS file V1.0".ljust(224, b"\x00") + info * 254 + body)

    base = made(b"a", b"i", b"body" * 50)
    rows = {"same": made(b"b", b"i", b"body" * 50), "padded": made(b"c", b"i", b"body" * 50 + b"\x00" * 40), "uneven": made(b"c", b"i", b"body" * 50 + b"\x00\x01"), "info": made(b"a", b"j", b"body" * 50), "long": made(b"a", b"i", b"body" * 50 + b"\x00" * 300), "plain": bytearray(b"x" * 700)}
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("data", T.BinaryType())])
    one = spark.createDataFrame([("base", "n", base)], schema)
    two = spark.createDataFrame([(k, k, v) for k, v in rows.items()], schema)
    assert {r["id2"] for r in matching.geos_equal(one, two).collect()} == {"same", "padded"}
