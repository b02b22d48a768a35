"""Byte, number, name and path functions as column expressions; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from bytefleet.functions.text import ascii_lower

#: Data bytes of a sector behind its two link bytes.
SECTOR_BYTES = 254
#: Largest host file that is searched or hashed (a fixed value).
SIZE_CAP = 83_361_792
# Two-byte load addresses by platform, in byte order.
PLATFORMS = {"PET": "0104", "VIC": "0112", "C64": "0108", "CBM2": "0300", "C128": "011C", "C65": "0120"}


# Bytes whose ASCII and PETSCII meanings differ, besides the letters.
_TO_ASCII = {0x08: 0x14, 0x0A: 0x0D, 0x0B: 0x11, 0x0C: 0x93, 0x0D: 0x0A, 0x11: 0x0B, 0x14: 0x08, 0x93: 0x0C, 0xA0: 0x20, 0xC0: 0x60}
_TO_PETSCII = {0x08: 0x14, 0x09: 0x20, 0x0B: 0x11, 0x0C: 0x93, 0x11: 0x0B, 0x14: 0x08, 0x60: 0xC0, 0x93: 0x0C}


def ascii_of(byte: int) -> int:
    """The ASCII meaning of a PETSCII byte: letters change their case, the upper copies of letters and signs come down."""
    if byte in _TO_ASCII:
        return _TO_ASCII[byte]
    shift = 0x20 if 0x41 <= byte <= 0x5A else -0x20 if 0x61 <= byte <= 0x7A else -0x80 if 0xC1 <= byte <= 0xDA else -0x40 if byte >= 0xE0 else 0
    return byte + shift


def petscii_of(byte: int) -> int:
    """The PETSCII byte for an ASCII one: capitals lie at the upper copies, small letters where ASCII has capitals."""
    if byte in _TO_PETSCII:
        return _TO_PETSCII[byte]
    shift = 0x80 if 0x41 <= byte <= 0x5A else -0x20 if 0x61 <= byte <= 0x7A else 0x60 if 0x7B <= byte <= 0x7F else 0
    return byte + shift


def _recoded(text: Column, table: Callable[[int], int]) -> Column:
    changed = [b for b in range(256) if table(b) != b]
    return F.translate(text, "".join(map(chr, changed)), "".join(chr(table(b)) for b in changed))


def petscii_to_ascii(data: Column) -> Column:
    """A PETSCII payload as text of single-byte characters."""
    return _recoded(F.decode(data, "ISO-8859-1"), ascii_of)


def ascii_to_petscii(text: Column) -> Column:
    """Text of single-byte characters as PETSCII bytes."""
    return F.encode(_recoded(text, petscii_of), "ISO-8859-1")


def unsigned(data: Column, position: Column | int = 1) -> Column:
    """The byte at a position (from 1) as 0..255; null outside the payload."""
    byte = F.substring(data, position, 1) if isinstance(position, int) else F.substr(data, position, F.lit(1))
    return F.when(F.octet_length(byte) == 1, F.conv(F.hex(byte), 16, 10).cast("int"))


def to_hex(data: Column) -> Column:
    return F.hex(data)


def from_hex(digits: Column) -> Column:
    return F.unhex(digits)


def long_hex(number: Column) -> Column:
    """Upper-case digits in whole bytes, as few as hold the number; '' for 0."""
    digits = F.hex(number)
    return F.when(number == 0, "").when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)


def number_bytes(number: Column, size: int = 4) -> Column:
    """The lowest bytes of a number, up to eight, little-endian; four hold 32 bits and leave out what is above."""
    digits = F.lpad(F.hex(number.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(size)]))


def little_endian(data: Column, position: int, size: int) -> Column:
    """An unsigned number of up to seven bytes from a position (from 1), or of eight below 2^63."""
    return sum((unsigned(data, position + k).cast("bigint") * (1 << (8 * k)) for k in range(1, size)), unsigned(data, position).cast("bigint"))


def big_endian(data: Column, position: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, position, size)), 16, 10).cast("bigint")


def is_integer(text: Column) -> Column:
    """Text of a number over zero."""
    return F.coalesce(F.trim(text).try_cast("int") > 0, F.lit(False))


def to_integer(text: Column) -> Column:
    """The number that a text shows, 0 if it shows none."""
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(0))


def pad_right(text: Column, width: int) -> Column:
    """Blanks up to a least width; longer texts stay whole."""
    return F.when(F.char_length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def blocks_up(size: Column) -> Column:
    return F.ceil(size / SECTOR_BYTES).cast("bigint")


def blocks_down(size: Column) -> Column:
    return F.floor(size / SECTOR_BYTES).cast("bigint")


def blocks_next(size: Column) -> Column:
    return blocks_down(size) + 1


def round_half_up(value: Column) -> Column:
    """Halves go up, also below zero: floor(x + 0.5)."""
    return F.floor(value + 0.5).cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, round_half_up(100.0 * part / whole))


def trim_padding(data: Column, tape: bool = False) -> Column:
    """A binary name without its trailing padding: A0 and 00; on tape 20 too."""
    digits = F.regexp_replace(F.hex(data), "(A0|00|20)+$" if tape else "(A0|00)+$", "")
    # a match must begin at a whole byte
    whole = F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.unhex(whole)


def name_83(entry: Column, position: int = 1) -> Column:
    """`NAME.EXT` of eleven bytes whose upper bits are flags."""
    chars = [F.chr(unsigned(entry, position + k).bitwiseAND(127).cast("bigint")) for k in range(11)]
    return F.concat(F.rtrim(F.concat(*chars[:8])), F.lit("."), F.rtrim(F.concat(*chars[8:])))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """All before the last slash, '' if there is none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise("")


def extension(path: Column) -> Column:
    """Upper-case letters behind the last dot of the base name, '' if there is none."""
    return F.upper(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def lineage(outer: Column, inner: Column) -> Column:
    """`outer@inner` for what lies inside a container."""
    return F.concat_ws("@", outer, inner)


def bit(byte: Column, number: Column, msb_first: bool = False) -> Column:
    place = F.pmod(number, F.lit(8)).cast("int")
    return F.getbit(byte, (F.lit(7) - place) if msb_first else place) == 1


def match_label(equal: Column, approx: Column) -> Column:
    """MATCH, M-n%, n% or DIFF; a bare percentage is padded to five places."""
    shown = F.concat(approx.cast("string"), F.lit("%"))
    return F.when(equal & (approx == 0), "MATCH").when(equal, F.concat(F.lit("M-"), shown)).when(approx > 0, pad_right(shown, 5)).otherwise("DIFF")


def on_platform(data: Column, *names: str) -> Column:
    """The payload's load address belongs to one of the platforms; payloads under three bytes never do."""
    return (F.octet_length(data) >= 3) & F.hex(F.substring(data, 1, 2)).isin(*[PLATFORMS[n] for n in names])


def is_geos(name: Column, data: Column) -> Column:
    """A converted desktop file: by its name, or by the mark in its first block."""
    mark = F.encode(F.lit(" formatted GEOS file V1.0"), "UTF-8")
    return (F.octet_length(data) > 512) & (F.endswith(ascii_lower(name), F.lit(".cvt")) | (F.substring(data, 34, 25) == mark))


def filled(data: Column) -> Column:
    """All bytes are the first byte; true for an empty payload."""
    digits = F.hex(data)
    return digits == F.repeat(F.substring(digits, 1, 2), F.octet_length(data))


def equal_range(a: Column, b: Column, start: int, size: int) -> Column:
    """Bytes [start, start + size) are the same, start from 0."""
    return F.substring(a, start + 1, size) == F.substring(b, start + 1, size)


def normalize_geos(data: Column) -> Column:
    """A converted file without what differs between copies: disk places, date and the padding of the first block."""
    zero = F.unhex(F.lit("00"))
    cleared = data
    for place in (2, 3, 20, 21):
        cleared = F.overlay(cleared, zero, place)
    cleared = F.overlay(cleared, F.encode(F.lit("PRG"), "UTF-8"), 31)
    return F.overlay(cleared, F.unhex(F.lit("00" * 194)), 61)


def xor_hash(data: Column) -> Column:
    """Size xor all pairs of bytes as signed 16-bit numbers, high byte second; an odd last byte is left out. Null gives -1.

    Bytes are signed and or-ed together, so a low byte over 127 hides the high byte.
    """

    def signed(k: Column) -> Column:
        byte = unsigned(data, k)
        return F.when(byte > 127, byte - 256).otherwise(byte).cast("bigint")

    pairs = F.when(F.octet_length(data) >= 2, F.sequence(F.lit(1), F.octet_length(data) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    fold = F.aggregate(pairs, F.octet_length(data).cast("bigint"), lambda h, k: h.bitwiseXOR(F.shiftleft(signed(k + 1), 8).bitwiseOR(signed(k))))
    return F.when(data.isNull(), F.lit(-1).cast("bigint")).otherwise(fold)
