"""Containers: what the writers make, the parsers read; broken input is refused."""

import gzip
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bytefleet.sources.formats import FormatError, archives, volumes
from bytefleet.sources.formats.disk import Disk, formatted, petscii
from bytefleet.sources.formats.geometry import image_type, loose_type, of

KINDS = ("D64", "D71", "D81", "D80", "D82", "DNP")


def filled(kind, count=20, step=61):
    image = formatted(kind)
    contents = {f"file{n}": bytes((n + k) % 256 for k in range(n * step)) for n in range(count)}
    for name, data in contents.items():
        image = Disk(image, kind).inserted(name, data)
    return image, contents


@pytest.mark.parametrize("kind", KINDS)
def test_disk_round_trip(kind):
    image, contents = filled(kind)
    disk = Disk(image, kind)
    rows = [r for r in disk.files() if r["dir_loc"]]
    assert {r["file_path"]: r["data"] for r in rows} == contents
    assert [r["file_path"] for r in disk.files()[:2]] == ["*BAM*", "/"]
    used = [s for r in disk.files() for s in r["sectors"]]
    marked = {(t, s) for t, s, free in disk.bam() if not free}
    reserved = {(1, 0)} if kind == "DNP" else set()
    assert set(used) | reserved == marked and not disk.errors


@pytest.mark.parametrize("kind", KINDS)
def test_scratch_frees_what_insert_took(kind):
    image = formatted(kind)
    changed = Disk(image, kind).inserted("gone", b"x" * 3000)
    back = Disk(Disk(changed, kind).scratched("GONE"), kind)
    assert [r["file_path"] for r in back.files()] == ["*BAM*", "/"]
    assert list(back.bam()) == list(Disk(image, kind).bam())


def test_capacities():
    assert [of(k, 0).size for k in ("D64", "D71", "D81", "D80", "D82")] == [174_848, 349_696, 819_200, 533_248, 1_066_496]
    assert of("D64", 349_696).tracks == 70 and of("DNP", 3 * 65536).tracks == 3
    assert Disk(formatted("D64"), "D64").free_blocks() == 664


def test_full_disk_and_missing_file():
    disk = Disk(formatted("D64"), "D64")
    with pytest.raises(FormatError):
        disk.inserted("big", bytes(700 * 254))
    with pytest.raises(FormatError):
        disk.find("nothing")


def test_corrupt_disks_end_and_report():
    image, _ = filled("D64", 3)
    looped = bytearray(image)
    o = of("D64", 0).offset(18, 1)
    looped[o : o + 2] = bytes((18, 1))  # the directory links to itself
    assert len(Disk(bytes(looped), "D64").files()) == 5
    looped[o + 3 : o + 5] = bytes((99, 9))  # a file begins nowhere
    disk = Disk(bytes(looped), "D64")
    assert len(disk.files()) == 5 and disk.errors
    assert Disk(image[:1000], "D64").files()  # cut short
    rng = random.Random(3)
    for _ in range(30):
        noise = bytearray(image)
        for _ in range(200):
            noise[rng.randrange(len(noise))] = rng.randrange(256)
        Disk(bytes(noise), "D64").files()


def test_deleted_and_open_entries_are_not_listed():
    image = bytearray(filled("D64", 3)[0])
    o = of("D64", 0).offset(18, 1)
    image[o + 2], image[o + 34], image[o + 66] = 0x00, 0x02, 0x80
    assert [r["file_path"] for r in Disk(bytes(image), "D64").files()] == ["*BAM*", "/"]


@given(st.binary(max_size=800))
@settings(max_examples=60, deadline=None)
def test_rle_and_p00_round_trips(data):
    assert volumes.rle_unpack(volumes.rle_pack(data)) == data
    assert archives.read_p00(archives.write_p00(b"NAME", data))[0]["data"] == data


@given(st.lists(st.tuples(st.binary(min_size=1, max_size=16).filter(lambda b: b"\r" not in b and not b.endswith((b"\xa0", b"\x00")) and b"\x00\x00\x00" not in b), st.sampled_from(["PRG", "SEQ", "USR"]), st.binary(max_size=1100)), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_archive_round_trips(members):
    def shown(rows):
        return [(r["raw_name"], r["file_type"], r["data"]) for r in rows]

    assert shown(archives.read_library(archives.write_library(members))) == members
    assert shown(archives.read_arc(archives.write_arc(members, 2))) == members
    if all(data for _, _, data in members):
        assert shown(archives.read_lynx(archives.write_lynx(members))) == members
    raw, kind, data = members[0]
    if b"\x00" not in raw and data:
        assert shown(archives.read_wraptor(archives.write_wraptor(raw, kind, data))) == [(raw, kind, data)]


def test_tape_and_broken_end():
    tape = bytearray(archives.write_tape([("ONE", 2049, b"a" * 300), ("TWO", 4096, b"b" * 50)]))
    rows = archives.read_tape(bytes(tape))
    assert [(r["file_path"], r["data"]) for r in rows] == [("/one", b"\x01\x08" + b"a" * 300), ("/two", b"\x00\x10" + b"b" * 50)]
    tape = bytearray(archives.write_tape([("ONE", 2049, b"a" * 300), ("TWO", 2349, b"b" * 50)]))
    tape[68:70] = tape[100:102] = (archives.BROKEN_END).to_bytes(2, "little")
    fixed = archives.read_tape(bytes(tape))
    assert fixed[0]["size"] == 300 and fixed[0]["data"] == b"\x01\x08" + b"a" * 299  # up to the next start
    assert fixed[1]["data"] == b"\x2d\x09" and fixed[1]["size"] == 0  # the file ends before such a load address
    with pytest.raises(FormatError):
        archives.read_tape(b"nothing")


class Bits:
    """Bits as the archive's coder writes them: each byte from its lowest bit up."""

    def __init__(self):
        self.bits = []

    def high_first(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def low_first(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]

    def bytes(self):
        padded = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(b << k for k, b in enumerate(padded[j : j + 8])) for j in range(0, len(padded), 8))


def total(data):
    return sum(b ^ (k + 1 & 255) for k, b in enumerate(data)) & 0xFFFF


def lzw(data, bits):
    words, following, width, span, left, now = {bytes([k]): k for k in range(256)}, 258, 9, 256, 254, b""

    def put(code):
        nonlocal width, span, left
        bits.high_first(code, width)
        if width < 12:
            left -= 1
            if not left:
                span, width = span * 2, width + 1
                left = span

    for b in data:
        if now + bytes([b]) in words:
            now += bytes([b])
            continue
        put(words[now])
        if following < 4096:
            words[now + bytes([b])] = following
            following += 1
        now = bytes([b])
    put(words[now])
    put(256)


def arc_member(mode, body, size, check, extra=b""):
    head = bytes([2, mode]) + check.to_bytes(2, "little") + size.to_bytes(3, "little")
    tail = b"P" + bytes([4]) + b"NAME" + bytes(3) + extra
    blocks = -(-(len(head) + 2 + len(tail) + len(body)) // 254)
    return (head + blocks.to_bytes(2, "little") + tail + body).ljust(blocks * 254, b"\x00")


@pytest.mark.parametrize("seed", range(4))
def test_coded_archive_members(seed):
    draw = random.Random(seed)
    data = bytes(draw.choice(b"abcd\x00\xff") for _ in range(40 + 2500 * seed)) + b"z" * 30
    plain, check = data.replace(b"\xfe", b"x"), total(data)
    runs = plain[:-30] + bytes([254, 30]) + b"z"
    bits = Bits()
    lzw(plain, bits)
    assert archives.read_arc(arc_member(3, bits.bytes(), len(data), check))[0]["data"] == data
    assert archives.read_arc(arc_member(1, runs, len(data), check, extra=b"\xfe"))[0]["data"] == data
    one_pass = Bits()
    lzw(runs, one_pass)
    for value, n in ((check, 16), (len(data), 24), (0, 16)):
        one_pass.high_first(value, n)
    follow = archives.write_arc([(b"B", "SEQ", b"next")], 2)
    rows = archives.read_arc(arc_member(5, one_pass.bytes(), 0, 0) + follow)
    assert [r["data"] for r in rows] == [data, b"next"]
    codes = {b"a"[0]: (1, 0), b"b"[0]: (3, 0b001), b"c"[0]: (3, 0b011), b"d"[0]: (3, 0b101), 0: (4, 0b0111), 255: (5, 0b01111), b"z"[0]: (6, 0b011111), 254: (6, 0b111111)}
    for mode, text in ((2, plain), (4, runs[:-3] + bytes([254, 97, 97]))):
        bits = Bits()
        for value in range(256):
            n, code = codes.get(value, (0, 0))
            bits.low_first(n, 5)
            if n:
                bits.low_first(code, n)
        for b in text:
            n, code = codes[b]
            bits.low_first(code, n)
        want = plain if mode == 2 else plain[:-30] + b"a" * 97
        assert archives.read_arc(arc_member(mode, bits.bytes(), len(want), total(want)))[0]["data"] == want


def test_volumes():
    image, _ = filled("D64")
    assert volumes.unpack_four(volumes.pack_four(image)) == image
    assert volumes.unpack_six(volumes.pack_six(image)) == image
    for unpack, packs in ((volumes.unpack_four, volumes.pack_four(image)), (volumes.unpack_six, volumes.pack_six(image))):
        with pytest.raises(FormatError):
            unpack(packs[:-1])
        with pytest.raises(FormatError):
            unpack([b"??" + packs[0][2:], *packs[1:]])
    broken = bytearray(volumes.pack_six(image)[0])
    broken[600] ^= 0xFF
    with pytest.raises(FormatError):
        volumes.unpack_six([bytes(broken), *volumes.pack_six(image)[1:]])


def test_checksums_are_checked():
    arc = bytearray(archives.write_arc([(b"A", "PRG", b"payload")], 2))
    arc[20] ^= 1
    with pytest.raises(FormatError):
        archives.read_arc(bytes(arc))
    wra = bytearray(archives.write_wraptor(b"A", "PRG", b"payload"))
    wra[-1] ^= 1
    with pytest.raises(FormatError):
        archives.read_wraptor(bytes(wra))
    with pytest.raises(FormatError):
        volumes.rle_unpack(b"\xff\x00\xff\x00\xff\x00")  # a run across the sector's end


def test_partitions():
    table = volumes.write_partitions([(0, "SYSTEM", 255, 0, 1024), (1, "WORK", 2, 512 * 600, 174_592), (254, "LAST", 1, 512 * 2000, 65536)])
    parts = volumes.read_partitions(table)
    assert [(p["number"], p["name"], p["type_name"], p["start"], p["len"]) for p in parts] == [(0, "system", "SYS", 0, 1024), (1, "work", "D64", 307_200, 174_592), (254, "last", "DNP", 1_024_000, 65536)]
    assert volumes.partition_file(parts[1]) == "1_work.d64"
    drive = bytes(2_000_000)
    assert volumes.replaced_partition(drive, parts[2], b"y" * 65536)[1_024_000:1_089_536] == b"y" * 65536
    with pytest.raises(FormatError):
        volumes.replaced_partition(drive, parts[2], b"short")
    with pytest.raises(FormatError):
        volumes.read_partitions(b"\x00\x00")
    with pytest.raises(FormatError):
        volumes.read_partitions(b"\x01\x01\x09" + bytes(255 * 32))


def test_names():
    assert petscii(bytes(range(0x41, 0x5B))) == "abcdefghijklmnopqrstuvwxyz" and petscii(b"\x80\xff") == "ﾀ￿"
    assert [image_type(n) for n in ("a.D64", "x/b.d81.gz", "1!xx", "1!!x", "a.txt", "1!")] == ["D64", "D81", "ZC4", "ZC6", None, None]
    assert [loose_type(n) for n in ("a.prg", "a.SEQ.gz", "b,p", "b,S", "b")] == ["PRG", "SEQ", "PRG", "SEQ", None]
    assert archives.file_type("P") == "PRG" and archives.file_type("") is None and archives.file_type("X") is None


def written(image, kind, sectors, entry):
    """The image with raw sectors and a raw directory entry in the first slot."""
    out, g = bytearray(image), of(kind, len(image))
    for (track, sector), data in sectors.items():
        o = g.offset(track, sector)
        out[o : o + 256] = data.ljust(256, b"\x00")
    o = g.offset(18, 1) + 2
    out[o : o + len(entry)] = entry
    return Disk(bytes(out), kind)


def raw_entry(kind, first, name, side=(0, 0), extra=0, blocks=1):
    return bytes([128 | kind, *first]) + name.ljust(16, b"\xa0") + bytes([*side, extra]) + bytes(6) + blocks.to_bytes(2, "little")


def test_geos_files():
    info = b"\x00\xff" + bytes(range(254))
    first, second = b"r" * 300, b"s" * 100
    sectors = {(10, 0): info, (10, 1): b"\x00\xff" + bytes([10, 2, 0, 255, 10, 4]), (10, 2): bytes([10, 3]) + first[:254], (10, 3): bytes([0, 47]) + first[254:], (10, 4): bytes([0, 101]) + second}
    entry = raw_entry(3, (10, 1), b"LETTER", (10, 0), 1, 5)
    row = written(formatted("D64"), "D64", sectors, entry).files()[2]
    data = row["data"]
    assert row["file_name"] == "LETTER" and row["header"] == info and data[30:58] == b"PRG formatted GEOS file V1.0" and data[1:3] == b"\x00\x00"
    assert data[254:508] == info[2:] and data[508:514] == bytes([2, 47, 0, 255, 1, 101])
    assert data[762:] == first.ljust(508, b"\x00") + second and set(row["sectors"]) == {(10, k) for k in range(5)}
    plain = written(formatted("D64"), "D64", {(10, 0): info, (10, 1): bytes([0, 11]) + b"contents.."}, raw_entry(3, (10, 1), b"PLAIN", (10, 0)))
    assert plain.files()[2]["data"][508:] == b"contents.."


def test_relative_files_and_partitions():
    side = bytes([0, 20, 0, 30]) + bytes([10, 0])
    disk = written(formatted("D64"), "D64", {(10, 0): bytes([0, 31]) + b"x" * 30, (10, 1): side}, raw_entry(4, (10, 0), b"REL", (10, 1), 30))
    row = disk.files()[2]
    assert row["file_type"] == "REL" and row["data"] == b"x" * 30 and set(row["sectors"]) == {(10, 0), (10, 1)}
    wrong = written(formatted("D64"), "D64", {(10, 0): bytes([0, 31]) + b"x" * 30, (10, 1): side}, raw_entry(4, (10, 0), b"REL", (10, 1), 31))
    wrong.files()
    assert wrong.errors


def test_cpm():
    image = bytearray(formatted("D64", "CP/M PLUS", "65 2A"))
    image[:3] = b"CBM"
    disk = Disk(bytes(image), "D64")
    for track, sector in disk._units("NORMAL")[0]:
        o = disk.geometry.offset(track, sector)
        image[o : o + 256] = b"\xe5" * 256
    image = Disk(bytes(image), "D64").inserted("letter.txt", b"z" * 5000)
    disk = Disk(image, "D64")
    assert disk.cpm() == "NORMAL"
    row = disk.files()[0]
    assert row["file_path"] == "LETTER.TXT" and row["data"][:5000] == b"z" * 5000 and row["size"] == 5120
    assert Disk(disk.scratched("letter.txt"), "D64").files() == []


def test_spark_relations(spark, tmp_path):
    from bytefleet.operators import integrity, rewrite
    from bytefleet.sources import containers

    image, contents = filled("D64", 6)
    (tmp_path / "a.d64").write_bytes(image)
    (tmp_path / "b.d64.gz").write_bytes(gzip.compress(image))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("in/d.d64", image)
        z.writestr("e.t64", b"broken")
    (tmp_path / "f.prg").write_bytes(b"\x01\x08abc")
    (tmp_path / "skip.txt").write_bytes(b"no")
    for k, pack in enumerate(volumes.pack_four(image), 1):
        (tmp_path / f"{k}!pack").write_bytes(pack)
    found = containers.scan(spark, str(tmp_path))
    entries = containers.expand(found.filter("path not like '%!pack'")).cache()
    files = containers.parse(entries).cache()
    rows = files.filter("ord >= 0 and data is not null").groupBy("entry").count().collect()
    assert {r["entry"]: r["count"] for r in rows} == {"a.d64": 6, "b.d64.gz": 6, "in/d.d64": 6, "f.prg": 1}
    assert files.filter("error is not null").select("entry").collect()[0][0] == "e.t64"
    marks = integrity.allocation(containers.bitmaps(entries).selectExpr("concat_ws('@', container, entry) image", "track", "sector", "is_free"), containers.used_sectors(files))
    assert {r["mark"] for r in marks.select("mark").distinct().collect()} == {"x", "o"}
    assert integrity.cross_links(containers.used_sectors(files).filter("file <> '*BAM*'").filter("file <> '/'")).count() == 0
    unpacked = containers.unpacked_volumes(found)
    assert [bytes(r["content"]) for r in unpacked.collect()] == [image]
    changed = rewrite.insert(unpacked, "further", b"new" * 200)
    assert "further" in [r["file_path"] for r in containers.parse(changed).collect()]
    assert "file3" not in [r["file_path"] for r in containers.parse(rewrite.scratch(unpacked, "file3")).collect()]
    packed = rewrite.lynx_archives(files.filter("entry = 'a.d64'").withColumn("image", files["entry"])).collect()[0]
    nonempty = {k: v for k, v in contents.items() if v}
    assert {r["file_path"]: r["data"] for r in archives.read_lynx(bytes(packed["content"])) if r["data"]} == nonempty
    loose = {r["target"]: bytes(r["content"]) for r in rewrite.loose_files(files.filter("entry in ('a.d64', 'in/d.d64')"), as_p00=True).collect()}
    assert len(loose) == 12 and archives.read_p00(loose["file3.P00"])[0]["data"] == contents["file3"]
    out = rewrite.extracted(files.filter("entry = 'a.d64'"), str(tmp_path / "out"), with_type=True)
    assert out.count() == 6 and (tmp_path / "out" / "file2.prg").read_bytes() == contents["file2"]
    assert rewrite.rle(rewrite.rle(unpacked, "content"), "content", pack=False).collect()[0]["content"] == image


def test_streaming_catalog(spark, tmp_path):
    from bytefleet.streaming import catalog

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.prg").write_bytes(b"one")
    (tmp_path / "in" / "b.prg").write_bytes(b"one")
    (tmp_path / "in" / "c.prg").write_bytes(b"two")
    rows = catalog.first_seen(catalog.arrivals(spark, str(tmp_path / "in")))
    catalog.follow(rows, str(tmp_path / "table"), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_tapes_take_and_lose_files():
    def held(tape):
        return {r["file_path"]: r["data"] for r in archives.read_tape(tape)}

    tape = archives.write_tape([("ONE", 2049, b"a" * 300), ("TWO", 4096, b"b" * 50), ("SIX", 8192, b"c" * 70)])
    before = held(tape)
    more = archives.tape_inserted(tape, "new", b"\x01\x08" + b"n" * 99)
    assert held(more) == before | {"/new": b"\x01\x08" + b"n" * 99} and more[34:38] == b"\x04\x00\x04\x00"
    more = archives.tape_inserted(more, "text", b"t" * 40, "SEQ")
    assert held(more)["/text"] == b"t" * 40 and [r["file_type"] for r in archives.read_tape(more)][-1] == "SEQ"
    less = archives.tape_scratched(more, "TWO")
    assert held(less) == {k: v for k, v in held(more).items() if k != "/two"} and len(less) == len(more) - 50
    again = archives.tape_inserted(less, "back", b"\x00\x10" + b"k" * 20)  # into the slot that is free now
    assert held(again) == held(less) | {"/back": b"\x00\x10" + b"k" * 20} and again[34:38] == b"\x05\x00\x05\x00"
    broken = bytearray(tape)
    broken[68:70] = broken[132:134] = archives.BROKEN_END.to_bytes(2, "little")
    kept = held(bytes(broken))
    assert held(archives.tape_inserted(bytes(broken), "new", b"\x02\x08n")) == kept | {"/new": b"\x02\x08n"}
    assert held(archives.tape_scratched(bytes(broken), "two")) == {k: v for k, v in kept.items() if k != "/two"}
    for name, data, kind in (("x", b"", "SEQ"), ("x", b"1", "PRG"), ("x", b"123", "USR"), ("x", bytes(70000), "SEQ")):
        with pytest.raises(FormatError):
            archives.tape_inserted(tape, name, data, kind)
    with pytest.raises(FormatError):
        archives.tape_scratched(tape, "none")


def test_changes_of_a_mixed_folder_fail_no_task(spark):
    from bytefleet.operators import rewrite
    from bytefleet.sources import containers

    image, _ = filled("D64", 2)
    tape = archives.write_tape([("ONE", 2049, b"a" * 300)])
    rows = [("c", "a.d64", image, None), ("c", "b.t64", tape, None), ("c", "c.t64", b"broken", None), ("c", "d.lnx", b"x", None), ("c", "e.prg", b"\x01\x08p", None), ("c", "f.d64", None, "bad member")]
    entries = spark.createDataFrame([(a, b, None if c is None else bytearray(c), e) for a, b, c, e in rows], containers.ENTRIES)
    changed = {r["entry"]: r for r in rewrite.insert(entries, "further", b"\x01\x08body").collect()}
    assert [k for k, r in sorted(changed.items()) if r["error"] is None] == ["a.d64", "b.t64"] and changed["f.d64"]["error"] == "bad member"
    assert {r["file_path"] for r in archives.read_tape(bytes(changed["b.t64"]["content"]))} == {"/one", "/further"}
    gone = {r["entry"]: r for r in rewrite.scratch(entries, "ONE").collect()}
    assert archives.read_tape(bytes(gone["b.t64"]["content"])) == [] and gone["a.d64"]["error"] == "no file ONE"
    assert {r["entry"] for r in rewrite.repair_bitmap(entries).filter("error is null").collect()} == {"a.d64"}
