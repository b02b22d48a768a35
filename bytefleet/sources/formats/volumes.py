"""Packed volumes of several files, partitioned drives, and the run-length coded sectors of the 8-bit packer."""

from __future__ import annotations

from bytefleet.sources.formats import FormatError
from bytefleet.sources.formats.geometry import SECTOR, of

_SIZE = 174_848
# The disk's five-bit group code of each half byte.
GCR = (0x0A, 0x0B, 0x12, 0x13, 0x0E, 0x0F, 0x16, 0x17, 0x09, 0x19, 0x1A, 0x1B, 0x0D, 0x1D, 0x1E, 0x15)
_NIBBLE = {code: k for k, code in enumerate(GCR)}
#: Tracks in each of the volumes.
FOUR = ((1, 8), (9, 16), (17, 25), (26, 35))
SIX = ((1, 6), (7, 12), (13, 18), (19, 25), (26, 32), (33, 40))
_STORED = 326


def interleave(sectors: int) -> list[int]:
    """The order in which sectors stand in a track of a six-volume pack: steps of 8, going on at the first one left over.

    21 sectors: 0 8 16 3 11 19 6 ...; with fewer, the remainder moves down by 3 or by 1 in the same way.
    """
    out, at = [], 0
    for _ in range(sectors):
        while at in out:
            at = (at + 1) % sectors
        out.append(at)
        at = (at + 8) % sectors
    return out


def _track_starts(volume: int) -> list[int]:
    """Where each track of a volume begins: a two-byte address and the track count come first, each track has a descriptor and its sectors."""
    sectors = of("D64", 0).sectors
    out, at = [], 3
    for track in range(SIX[volume][0], SIX[volume][1] + 1):
        out.append(at)
        at += SECTOR + _STORED * (sectors[track - 1] if track <= 35 else 17)
    return out


def unpack_four(packs: list[bytes]) -> bytes:
    """A disk image of four volumes of raw, filled or run-length coded sectors."""
    if len(packs) != 4:
        raise FormatError("four volumes are needed")
    geometry, out = of("D64", 0), bytearray(_SIZE)
    for n, pack in enumerate(packs):
        if pack[:2] != (b"\xfe\x03" if n == 0 else b"\x00\x04"):
            raise FormatError(f"volume {n + 1} has another load address")
        at = 4 if n == 0 else 2
        try:
            while at < len(pack) and pack[at]:
                mode, track, sector = pack[at] >> 6, pack[at] & 63, pack[at + 1]
                at += 2
                if not FOUR[n][0] <= track <= FOUR[n][1]:
                    raise FormatError(f"track {track} isn't of volume {n + 1}")
                if mode == 0:
                    data, at = pack[at : at + SECTOR], at + SECTOR
                elif mode == 1:
                    data, at = pack[at : at + 1] * SECTOR, at + 1
                elif mode == 2:
                    size, escape = pack[at], pack[at + 1]
                    data, at = _runs(pack[at + 2 : at + 2 + size], escape), at + 2 + size
                else:
                    raise FormatError("no such mode")
                if len(data) != SECTOR:
                    raise FormatError("a sector has another size")
                o = geometry.offset(track, sector)
                out[o : o + SECTOR] = data
        except IndexError:
            raise FormatError(f"volume {n + 1} is cut short") from None
    return bytes(out)


def _runs(data: bytes, escape: int) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        if data[k] == escape:
            if k + 2 >= len(data):
                raise FormatError("a run is cut short")
            out += data[k + 2 : k + 3] * data[k + 1]
            k += 3
        else:
            out.append(data[k])
            k += 1
    return bytes(out)


def pack_four(image: bytes) -> list[bytes]:
    """Four volumes; sectors of one byte are stored as that."""
    geometry, out = of("D64", 0), []
    for n, (first, last) in enumerate(FOUR):
        pack = b"\xfe\x03\x00\x00" if n == 0 else b"\x00\x04"
        for track in range(first, last + 1):
            for sector in range(geometry.sectors[track - 1]):
                o = geometry.offset(track, sector)
                data = image[o : o + SECTOR]
                filled = data == data[:1] * SECTOR
                pack += bytes([track | (64 if filled else 0), sector]) + (data[:1] if filled else data)
        out.append(pack + b"\x00")
    return out


def gcr_encode(data: bytes) -> bytes:
    out = b""
    for k in range(0, len(data), 4):
        value = 0
        for b in data[k : k + 4]:
            value = value << 10 | GCR[b >> 4] << 5 | GCR[b & 15]
        out += value.to_bytes(5, "big")
    return out


def gcr_decode(data: bytes) -> bytes:
    out = bytearray()
    for k in range(0, len(data) - 4, 5):
        value = int.from_bytes(data[k : k + 5], "big")
        codes = [value >> shift & 31 for shift in range(35, -5, -5)]
        for high, low in zip(codes[::2], codes[1::2], strict=True):
            if high not in _NIBBLE or low not in _NIBBLE:
                if len(out) > 258:  # only padding follows the checksum
                    return bytes(out)
                raise FormatError("no such group code")
            out.append(_NIBBLE[high] << 4 | _NIBBLE[low])
    return bytes(out)


def unpack_six(packs: list[bytes]) -> bytes:
    """A disk image of six volumes of group-coded sectors."""
    if len(packs) != 6:
        raise FormatError("six volumes are needed")
    if any(p[:2] != b"\xff\x03" or p[2:3] != packs[0][2:3] for p in packs):
        raise FormatError("the volumes don't belong together")
    geometry, out = of("D64", 0), bytearray(_SIZE)
    for n, pack in enumerate(packs):
        for track, begin in zip(range(SIX[n][0], SIX[n][1] + 1), _track_starts(n), strict=True):
            if track > 35:
                break
            sectors = geometry.sectors[track - 1]
            if pack[begin + 255 : begin + 256] != bytes([sectors]):
                raise FormatError(f"track {track} has another number of sectors")
            for k, sector in enumerate(interleave(sectors)):
                stored = pack[begin + SECTOR + _STORED * k : begin + SECTOR + _STORED * (k + 1)]
                data = gcr_decode((stored[70:] + stored[:70])[:325])
                if len(data) < 258 or data[0] != 7:
                    raise FormatError(f"track {track} has no data block {k}")
                check = 0
                for b in data[1:257]:
                    check ^= b
                if check != data[257]:
                    raise FormatError(f"track {track}, block {k}: checksum")
                o = geometry.offset(track, sector)
                out[o : o + SECTOR] = data[1:257]
    return bytes(out)


def pack_six(image: bytes) -> list[bytes]:
    geometry, out = of("D64", 0), []
    for first, last in SIX:
        pack = b"\xff\x03" + bytes([36])
        for track in range(first, last + 1):
            sectors = geometry.sectors[track - 1] if track <= 35 else 17
            pack += bytes(255) + bytes([sectors])
            for sector in interleave(sectors):
                o = geometry.offset(track, sector) if track <= 35 else None
                data = image[o : o + SECTOR] if o is not None else bytes(SECTOR)
                check = 0
                for b in data:
                    check ^= b
                coded = gcr_encode(b"\x07" + data + bytes([check, 0, 0])) + b"\x55"
                pack += coded[256:] + coded[:256]
        out.append(pack)
    return out


# partitioned drives

TABLE = 262_144
PARTITION_TYPES = {1: "DNP", 2: "D64", 3: "D71", 4: "D81", 5: "D81", 255: "SYS"}


def read_partitions(table: bytes) -> list[dict]:
    """Partitions from the drive's bytes at TABLE on: number, name, type, type_name, start and len in bytes."""
    if table[:2] != b"\x01\x01":
        raise FormatError("no partition table")
    out = []
    for k in range(256):
        slot = table[2 + 32 * k : 34 + 32 * k]
        if len(slot) < 30 or not slot[0]:
            continue
        if slot[0] not in PARTITION_TYPES or slot[1]:
            raise FormatError(f"partition {k} has type {slot[0]}")
        name = slot[3:19].rstrip(b"\xa0\x00").decode("latin-1").lower()
        out.append({"number": k, "name": name, "type": slot[0], "type_name": PARTITION_TYPES[slot[0]], "start": int.from_bytes(slot[19:22], "big") * 512, "len": int.from_bytes(slot[27:30], "big") * 512})
    return out


def partition_file(part: dict) -> str:
    return f"{part['number']}_{part['name']}.{part['type_name'].lower()}"


def write_partitions(parts: list[tuple[int, str, int, int, int]]) -> bytes:
    """A table of (number, name, type, start, len)."""
    out = bytearray(b"\x01\x01" + bytes(256 * 32))
    for number, name, kind, start, size in parts:
        slot = bytes([kind, 0, 0]) + name.upper().encode()[:16].ljust(16, b"\xa0") + (start // 512).to_bytes(3, "big") + bytes(5) + (size // 512).to_bytes(3, "big")
        out[2 + 32 * number : 2 + 32 * number + len(slot)] = slot
    return bytes(out)


def replaced_partition(drive: bytes, part: dict, content: bytes) -> bytes:
    """The drive with a partition's bytes replaced; the lengths must be equal."""
    if len(content) != part["len"]:
        raise FormatError("the partition has another length")
    return drive[: part["start"]] + content + drive[part["start"] + part["len"] :]


# 8-bit run-length sectors


def rle_pack(data: bytes) -> bytes:
    """Sector by sector: 81-FF repeat the next byte, 01-80 give the number of bytes that follow as they are."""
    out = bytearray()
    for begin in range(0, len(data), SECTOR):
        sector, k, plain = data[begin : begin + SECTOR], 0, bytearray()

        def flush() -> None:
            for j in range(0, len(plain), 128):
                out.extend(bytes([len(plain[j : j + 128])]) + plain[j : j + 128])  # noqa: B023
            plain.clear()  # noqa: B023

        while k < len(sector):
            n = 1
            while n < 127 and k + n < len(sector) and sector[k + n] == sector[k]:
                n += 1
            if n > 2:
                flush()
                out += bytes([128 + n, sector[k]])
            else:
                plain += sector[k : k + n]
            k += n
        flush()
    return bytes(out)


def rle_unpack(data: bytes) -> bytes:
    """Whole sectors; a run that crosses a sector's end makes the archive invalid."""
    out, k = bytearray(), 0
    while k < len(data):
        n = data[k]
        if not n or len(out) % SECTOR + (n & 127 if n > 128 else n) > SECTOR:
            raise FormatError("a run crosses a sector's end")
        if n > 128:
            if k + 1 >= len(data):
                raise FormatError("a run is cut short")
            out += data[k + 1 : k + 2] * (n & 127)
            k += 2
        else:
            if k + 1 + n > len(data):
                raise FormatError("bytes are missing")
            out += data[k + 1 : k + 1 + n]
            k += 1 + n
    return bytes(out)
