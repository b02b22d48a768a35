"""Tapes, archives and loose files: members as dicts like those of disks, and writers where the library has sinks."""

from __future__ import annotations

from bytefleet.sources.formats import FormatError
from bytefleet.sources.formats.disk import DATA, TYPES, _row, padded_name, petscii

_LETTER = {"D": "DEL", "S": "SEQ", "P": "PRG", "U": "USR", "R": "REL", "C": "CBM"}
#: A known bad end address of tape entries.
BROKEN_END = 50118


def file_type(prefix: str) -> str | None:
    """The first type whose name starts with the letters; None if there is none, also for no letters."""
    return next((t for t in TYPES if prefix and t.startswith(prefix.upper())), None)


# tapes


def read_tape(content: bytes) -> list[dict]:
    """Entries of a tape image.

    A size counts the end address; an end that is known to be broken becomes the next distinct start less one, or the file's last
    byte. A program's payload is its load address and one byte less than its size, others have one byte more.
    """
    if content[:3] != b"C64" or len(content) < 64:
        raise FormatError("no tape image")
    slots = int.from_bytes(content[34:36], "little")
    places = [k for k in range(64, 64 + 32 * slots, 32) if k + 32 <= len(content) and content[k] == 1]
    loads = {k: int.from_bytes(content[k + 2 : k + 4], "little") for k in places}
    starts = sorted(set(loads.values()))
    out = []
    for k in places:
        entry = content[k : k + 32]
        end, at = int.from_bytes(entry[4:6], "little"), int.from_bytes(entry[8:11], "little")
        if end == BROKEN_END:
            end = next((s for s in starts if s > loads[k]), len(content)) - 1
        size = max(0, end - loads[k] + 1)
        program = entry[1] != 0
        data = entry[2:4] + content[at : at + max(0, size - 1)] if program else content[at : at + size + 1]
        raw = padded_name(entry[16:32], b"\xa0\x00\x20")
        name = petscii(raw)
        out.append(_row("/" + name, raw, "PRG" if program else "SEQ", blocks=size // DATA, size=size, data=data, header=entry, dir_loc=[k & 255, k >> 8 & 255, k >> 16 & 255]))
    return out


def write_tape(members: list[tuple[str, int, bytes]], title: str = "TAPE") -> bytes:
    """(name, load address, body) as a tape image; end addresses stand one behind the last byte."""
    head = b"C64 tape image file".ljust(32, b"\x00") + (0x0101).to_bytes(2, "little") + len(members).to_bytes(2, "little") * 2 + bytes(2) + title.encode().ljust(24)
    at, entries, body = 64 + 32 * len(members), b"", b""
    for name, load, data in members:
        entries += bytes([1, 0x82]) + load.to_bytes(2, "little") + (load + len(data)).to_bytes(2, "little") + bytes(2) + (at + len(body)).to_bytes(4, "little") + bytes(4) + name.upper().encode()[:16].ljust(16)
        body += data
    return head[:64].ljust(64, b"\x00") + entries + body


def _settled_tape(content: bytes) -> tuple[bytearray, list[dict]]:
    """The tape with the end addresses that its entries are read with, where these hang on the other entries or on the file's end; its rows with `at` and `until` of their bytes."""
    out, rows = bytearray(content), read_tape(content)
    for r in rows:
        k, entry = _tape_place(r), r["header"]
        load, end, at = (int.from_bytes(entry[a:b], "little") for a, b in ((2, 4), (4, 6), (8, 11)))
        r |= {"at": at, "until": at + len(r["data"]) - 2 * (entry[1] != 0)}
        wanted = at + max(0, end - load) if entry[1] else at + max(0, end - load + 1) + 1
        if end == BROKEN_END or wanted > len(content):
            out[k + 4 : k + 6] = _tape_end(load, len(r["data"]))
    return out, rows


def _tape_place(row: dict) -> int:
    return int.from_bytes(bytes(row["dir_loc"]), "little")


def _tape_end(load: int, size: int) -> bytes:
    """The end address with which `size` bytes of payload are read."""
    end = load + size - 2
    if not 0 <= end < 65536 or end == BROKEN_END:
        raise FormatError("no end address can tell the file's size")
    return end.to_bytes(2, "little")


def _moved_tape(out: bytearray, rows: list[dict], behind: int, by: int) -> None:
    """Entries whose bytes begin at `behind` or later get them `by` bytes further on. The directory has its old place."""
    for r in rows:
        if r["at"] >= behind:
            k = _tape_place(r)
            out[k + 8 : k + 12] = (r["at"] + by).to_bytes(4, "little")


def tape_inserted(content: bytes, name: str, data: bytes, kind: str = "PRG") -> bytes:
    """The tape with a further file: an entry in a free slot or in a new one behind the last, its bytes at the end. The payloads of the others stay as they are read."""
    if kind not in ("PRG", "SEQ"):
        raise FormatError(f"a tape holds no {kind}")
    if len(data) < (2 if kind == "PRG" else 1):
        raise FormatError("the file is too short for a tape")
    out, rows = _settled_tape(content)
    slots, used = (int.from_bytes(out[k : k + 2], "little") for k in (34, 36))
    end = 64 + 32 * slots
    first = min((r["at"] for r in rows), default=len(out))
    place = next((k for k in range(64, end, 32) if k + 32 <= min(first, len(out)) and not out[k]), None)
    if place is None:
        if slots == 65535 or any(r["at"] < end < r["until"] for r in rows):
            raise FormatError("the directory can't grow")
        _moved_tape(out, rows, end, 32)
        out = out.ljust(end, b"\x00")
        out[end:end] = bytes(32)
        out[34:36], place = (slots + 1).to_bytes(2, "little"), end
    load, body = (int.from_bytes(data[:2], "little"), data[2:]) if kind == "PRG" else (2049 if len(data) < 48000 else 0, data)
    raw = name.swapcase().encode("latin-1", "replace")[:16] if name.islower() else name.encode("latin-1", "replace")[:16]
    out[place : place + 32] = bytes([1, 0x82 if kind == "PRG" else 0]) + load.to_bytes(2, "little") + _tape_end(load, len(data)) + bytes(2) + len(out).to_bytes(4, "little") + bytes(4) + raw.ljust(16)
    out[36:38] = min(used + 1, 65535).to_bytes(2, "little")
    return bytes(out + body)


def tape_scratched(content: bytes, path: str) -> bytes:
    """The tape without a file: its entry is cleared, and those of its bytes go that no other entry reads. By exact path, else with case aside."""
    out, rows = _settled_tape(content)
    named = lambda fold: next((r for r in rows if fold(r["file_path"].lstrip("/")) == fold(path.lstrip("/"))), None)
    gone = named(str) or named(str.lower)
    if gone is None:
        raise FormatError(f"no file {path}")
    others = [r for r in rows if r is not gone]
    begin, until = max(gone["at"], 64 + 32 * int.from_bytes(out[34:36], "little")), gone["until"]
    for r in sorted(others, key=lambda r: r["at"]):
        if r["at"] <= begin < r["until"]:
            begin = r["until"]
        elif begin < r["at"] < until:
            until = r["at"]
    if begin < until:
        _moved_tape(out, others, until, begin - until)
        del out[begin:until]
    k = _tape_place(gone)
    out[k : k + 32] = bytes(32)
    out[36:38] = max(0, int.from_bytes(out[36:38], "little") - 1).to_bytes(2, "little")
    return bytes(out)


# LYNX


def read_lynx(content: bytes) -> list[dict]:
    """Members of a LYNX archive. One that is cut short ends the reading: those before it have their data, unless it is the first.

    The last member may lack up to 1,024 bytes of its size; they are zero.
    """
    at = content.find(b"\x00\x00\x00")
    if at < 0:
        raise FormatError("no end of the program in front")
    at += 3

    def line() -> bytes:
        nonlocal at
        while content[at : at + 1] == b"\r":  # empty lines don't count
            at += 1
        end = content.find(b"\r", at)
        if end < 0:
            raise FormatError("a line of the header is missing")
        text, at = content[at:end], end + 1
        return text

    words = line().upper().split()
    if not any(b"LYNX" in w for w in words) or not words[0].isdigit() or not int(words[0]):
        raise FormatError("no LYNX mark")
    count = words[-1] if words[-1].isdigit() and 0 < int(words[-1]) < 1000 else line().strip()
    if not count.isdigit():
        raise FormatError("the number of entries is missing")
    body, out = int(words[0]) * DATA, []
    if len(content) < body:
        raise FormatError("the directory is cut short")
    for _ in range(int(count)):
        raw, blocks, kind, last = line(), line().strip(), line().strip().decode("latin-1"), line().strip()
        if not blocks.isdigit() or not 1 <= len(kind) <= 3 or file_type(kind) is None or at > body:
            raise FormatError("an entry is broken")
        raw = padded_name(raw)
        out.append(_row(petscii(raw), raw, file_type(kind), blocks=int(blocks), size=max(0, (int(blocks) - 1) * DATA + (int(last) if last.isdigit() else 0) - 1)))
    at = body
    for k, row in enumerate(out):
        whole = -(-row["size"] // DATA) * DATA
        data = content[at : at + whole]
        if len(data) < whole and (k + 1 < len(out) or len(data) < row["size"] - 1024):
            if k == 0:
                raise FormatError("the first member is cut short")
            break
        row["data"] = data[: row["size"]].ljust(row["size"], b"\x00")
        at += whole
    return out


def write_lynx(members: list[tuple[bytes, str, bytes]], title: str = "ARCHIVE BY BYTEFLEET") -> bytes:
    """(raw name, type, data) as a LYNX archive that also lists as a BASIC program. Members without a name or data are left out; the last one isn't padded."""
    members = [m for m in members if m[0] and m[2]]
    if not members:
        raise FormatError("nothing to pack")
    stub = b"\x01\x08\x5b\x08\x0a\x00\x9953280,0:\x89\x31\x30\x00\x00\x00\r"

    def header(blocks: int) -> bytes:
        text = f" {blocks:<3}*LYNX {title}\r {len(members):<3}\r".encode()
        for raw, kind, data in members:
            text += raw[:16].ljust(16, b"\xa0") + f"\r {-(-len(data) // DATA)}\r{kind[0]}\r {(len(data) - 1) % DATA + 2} \r".encode()
        return stub + text

    size = 1
    while -(-len(header(size)) // DATA) > size:
        size += 1
    out = header(size).ljust(size * DATA, b"\x00")
    for _, _, data in members[:-1]:
        out += data.ljust(-(-len(data) // DATA) * DATA, b"\x00")
    return out + members[-1][2]


# libraries


def read_library(content: bytes) -> list[dict]:
    """`DWB n` and entries as text lines, then the payloads one after the other."""
    if content[:3] != b"DWB":
        raise FormatError("no library")
    end = content.find(b"\r")
    count, k, entries = int(content[3:end].strip() or b"0"), end + 1, []
    for _ in range(count):
        fields = []
        for _ in range(3):
            end = content.find(b"\r", k)
            if end < 0:
                raise FormatError("an entry is missing")
            fields.append(content[k:end])
            k = end + 1
        if not fields[2].strip().isdigit():
            raise FormatError("an entry has no size")
        entries.append((fields[0], _LETTER.get(fields[1].decode("latin-1").strip().upper()[:1], "PRG"), int(fields[2])))
    out = []
    for raw, kind, size in entries:
        raw = padded_name(raw)
        if k + size > len(content):
            raise FormatError("the data end early")
        out.append(_row(petscii(raw), raw, kind, blocks=1 + size // DATA, size=size, data=content[k : k + size]))
        k += size
    return out


def write_library(members: list[tuple[bytes, str, bytes]]) -> bytes:
    head = f"DWB {len(members)} \r".encode() + b"".join(raw + f"\r{kind[0]}\r {len(data)} \r".encode() for raw, kind, data in members)
    return head + b"".join(data for _, _, data in members)


# ARC and SDA


class _Bits:
    """Bits of each byte from the lowest up."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.left, self.byte = data, at, 0, 0

    def next(self) -> int:
        if not self.left:
            if self.at >= len(self.data):
                raise EOFError
            self.byte, self.left, self.at = self.data[self.at], 8, self.at + 1
        bit, self.byte, self.left = self.byte & 1, self.byte >> 1, self.left - 1
        return bit

    def low_first(self, n: int) -> int:
        return sum(self.next() << k for k in range(n))

    def high_first(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.next()
        return value


def _huffman(bits: _Bits, table: dict[tuple[int, int], int]):
    while True:
        code = 0
        for size in range(1, 25):
            code |= bits.next() << (size - 1)
            if (size, code) in table:
                yield table[size, code]
                break
        else:
            return


def _lzw(bits: _Bits):
    """Codes of 9 to 12 bits, wider after 254, 512 and 1,024 of them; 256 ends, 258 is the first that is made."""
    words = {k: bytes([k]) for k in range(256)}
    following, width, span, left, previous = 258, 9, 256, 254, None
    while True:
        code = bits.high_first(width)
        if code == 256:
            return
        if width < 12:
            left -= 1
            if not left:
                span, width = span * 2, width + 1
                left = span
        if code in words:
            word = words[code]
        elif previous is not None and code == following:
            word = previous + previous[:1]
        else:
            raise FormatError("no such code")
        if previous is not None and following < 4096:
            words[following] = previous + word[:1]
            following += 1
        previous = word
        yield from word


def read_arc(content: bytes) -> list[dict]:
    """Members of an archive, self-dissolving or not: stored, run-length, Huffman or LZW coded. A wrong checksum raises."""
    at = 0
    if content[:1] == b"\x01":
        if content[6:7] == b"\x9e":
            line = int.from_bytes(content[4:6], "little")
            at = (line - 6) * DATA - (1 if line == 15 and content[8:9] == b"7" else 0)
    elif content[:1] != b"\x02":
        raise FormatError("no archive")
    out = []
    while at + 11 <= len(content):
        version, mode = content[at], content[at + 1]
        check, size = int.from_bytes(content[at + 2 : at + 4], "little"), int.from_bytes(content[at + 4 : at + 7], "little")
        blocks, kind, n = int.from_bytes(content[at + 7 : at + 9], "little"), chr(content[at + 9]), content[at + 10]
        k = at + 11 + n
        if n > 16 or version not in (1, 2) or mode > (2 if version == 1 else 5) or kind not in "SPUR":
            break
        raw = content[at + 11 : k]
        k += 3 if version > 1 else 0
        escape = 254
        if mode == 1:
            escape, k = content[k], k + 1
        bits = _Bits(content, k)
        try:
            if mode in (2, 4):
                table = {}
                for value in range(256):
                    length = bits.low_first(5)
                    if length > 24:
                        raise FormatError("a code is too long")
                    if length:
                        table[length, bits.low_first(length)] = value
                source = _huffman(bits, table)
            elif mode in (3, 5):
                source = _lzw(bits)
            else:
                source = iter(content[k:])
            data, total = _expand(source, escape if mode not in (0, 2) else None, size if mode != 5 else 65536, version)
            if mode == 5:  # what a single pass could not know stands behind the codes
                check, size, _ = bits.high_first(16), bits.high_first(24), bits.high_first(16)
                blocks, data = -(-(bits.at - at) // DATA), data[:size]
        except EOFError:
            raise FormatError(f"{petscii(raw)}: cut short") from None
        if total & 0xFFFF != check:
            raise FormatError(f"{petscii(raw)}: checksum")
        out.append(_row(petscii(raw), raw, _LETTER[kind], blocks=1 + len(data) // DATA, size=len(data), data=data))
        at += blocks * DATA
        if not blocks:
            break
    return out


def _expand(source, escape: int | None, limit: int, version: int) -> tuple[bytes, int]:
    """(bytes, checksum) with runs after the escape byte written out."""
    out = bytearray()
    stream = iter(source)
    for value in stream:
        if len(out) >= limit:
            break
        if value == escape:
            count = next(stream, None)
            value = next(stream, None)
            if count is None or value is None:
                break
            out += bytes([value]) * min(count or (255 if version == 1 else 256), limit - len(out))
        else:
            out.append(value)
        if len(out) >= limit:
            break
    return bytes(out), sum(out) if version == 1 else sum(b ^ (k + 1 & 0xFF) for k, b in enumerate(out))


def write_arc(members: list[tuple[bytes, str, bytes]], version: int = 1) -> bytes:
    """Members stored as they are."""
    out = b""
    for raw, kind, data in members:
        total = sum(data) if version == 1 else sum(b ^ (k + 1 & 0xFF) for k, b in enumerate(data))
        head = bytes([version, 0]) + (total & 0xFFFF).to_bytes(2, "little") + len(data).to_bytes(3, "little")
        tail = kind[:1].encode() + bytes([len(raw)]) + raw + (bytes(3) if version > 1 else b"")
        blocks = -(-(len(head) + 2 + len(tail) + len(data)) // DATA)
        out += (head + blocks.to_bytes(2, "little") + tail + data).ljust(blocks * DATA, b"\x00")
    return out


# Wraptor


def crc16(data: bytes, start: int = 0) -> int:
    """CCITT polynomial, most significant bit first."""
    value = start
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ (0x1021 if value & 0x8000 else 0)) & 0xFFFF
    return value


def read_wraptor(content: bytes) -> list[dict]:
    out, at = [], 0
    while content[at : at + 4] == b"\xff\x42\x4c\xff":
        end = content.find(b"\x00", at + 4)
        if end < 0 or end + 1 >= len(content):
            raise FormatError("a member is cut short")
        raw, kind = content[at + 4 : end], content[end + 1]
        if not 1 <= kind <= 4:
            raise FormatError("no such file type")
        bits, data, width = _MsbBits(content, end + 2), bytearray(), 8
        try:
            while True:
                if not bits.take(1):
                    data.append(bits.take(8))
                    continue
                back = bits.take(width)
                if not back:
                    if not bits.take(1):
                        break
                    width += 1
                    if width > 15:
                        raise FormatError("offsets are too wide")
                    continue
                for k in range(bits.take(5)):
                    data.append(data[(len(data) >> 15 << 15) + back - 1 + k])  # offsets count from the start of the present 32,768 bytes
        except (EOFError, IndexError):
            raise FormatError("a member is cut short") from None
        at = bits.at + 2
        if int.from_bytes(content[bits.at : at], "big") != crc16(bytes(data)):
            raise FormatError(f"{petscii(raw)}: checksum")
        out.append(_row(petscii(raw), raw, TYPES[kind], blocks=-(-len(data) // DATA), size=len(data), data=bytes(data)))
    if not out:
        raise FormatError("no such archive")
    return out


class _MsbBits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.left, self.byte = data, at, 0, 0

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            if not self.left:
                if self.at >= len(self.data):
                    raise EOFError
                self.byte, self.left, self.at = self.data[self.at], 8, self.at + 1
            self.left -= 1
            value = value << 1 | self.byte >> self.left & 1
        return value


def write_wraptor(raw: bytes, kind: str, data: bytes) -> bytes:
    """One member of literals alone."""
    bits = "".join(f"0{b:08b}" for b in data) + "1" + "0" * 8 + "0"
    bits += "0" * (-len(bits) % 8)
    return b"\xff\x42\x4c\xff" + raw + b"\x00" + bytes([TYPES.index(kind)]) + int(bits, 2).to_bytes(len(bits) // 8, "big") + crc16(data).to_bytes(2, "big")


# loose files


def read_p00(content: bytes, name: str = "") -> list[dict]:
    if content[:8] != b"C64File\x00":
        raise FormatError("no such file")
    raw = padded_name(content[8:24])
    kind = {"S": "SEQ", "U": "USR", "R": "REL", "D": "DEL"}.get(name.rsplit(".", 1)[-1][:1].upper(), "PRG") if "." in name else "PRG"
    return [_row("", raw, kind, size=len(content) - 26, data=content[26:]) | {"file_name": petscii(raw)}]


def write_p00(raw: bytes, data: bytes) -> bytes:
    return b"C64File\x00" + raw[:16].ljust(16, b"\x00") + bytes(2) + data


def read_loose(content: bytes, name: str) -> list[dict]:
    """A file on its own; its name loses the extension that gave its type."""
    base = name.rsplit("/", 1)[-1]
    stem = base[:-3] if base.lower().endswith(".gz") else base
    kind = "SEQ" if stem.lower().endswith((".seq", ",s")) else "PRG"
    for ending in (".prg", ".seq", ".cvt", ".sda", ".sfx", ".arc", ".lbr", ",p", ",s"):
        if stem.lower().endswith(ending):
            stem = stem[: -len(ending)]
            break
    return [_row("", stem.encode("latin-1", "replace"), kind, blocks=-(-len(content) // DATA), size=len(content), data=content) | {"file_name": stem}]
