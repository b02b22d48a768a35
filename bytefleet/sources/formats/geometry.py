"""Disk geometries and where each keeps its allocation bits. All numbers in this module are fixed values of the formats."""

from __future__ import annotations

from dataclasses import dataclass, field

SECTOR = 256
_D64_ZONES = ((17, 21), (24, 19), (30, 18), (35, 17))
_D80_ZONES = ((39, 29), (53, 27), (64, 25), (77, 23))
ARCHIVES = ("T64", "LNX", "LBR", "ARC", "SDA")


def _zones(zones: tuple[tuple[int, int], ...]) -> list[int]:
    out: list[int] = []
    for last, sectors in zones:
        out += [sectors] * (last - len(out))
    return out


@dataclass(frozen=True)
class Geometry:
    """Sectors of each track (from track 1), the directory's head, and the bitmap's place for each track."""

    name: str
    sectors: tuple[int, ...]
    head: tuple[int, int]
    interleave: int
    bam_sectors: tuple[tuple[int, int], ...]
    msb_first: bool = False
    name_at: int = 144
    id_at: int = 162
    offsets: tuple[int, ...] = field(init=False)

    def __post_init__(self) -> None:
        at, out = 0, []
        for n in self.sectors:
            out.append(at)
            at += n * SECTOR
        object.__setattr__(self, "offsets", (*out, at))

    @property
    def size(self) -> int:
        return self.offsets[-1]

    @property
    def tracks(self) -> int:
        return len(self.sectors)

    def offset(self, track: int, sector: int) -> int:
        if not 1 <= track <= self.tracks or not 0 <= sector < self.sectors[track - 1]:
            from bytefleet.sources.formats import FormatError

            raise FormatError(f"no sector {track}/{sector}")
        return self.offsets[track - 1] + sector * SECTOR

    def bitmap(self, track: int) -> tuple[int, int | None, int]:
        """(byte offset of the track's bits in the image, offset of its free count or None, bytes of bits)."""
        if self.name in ("D64", "D71"):
            if track <= 35:
                at = self.offset(18, 0) + 4 * track
                return at + 1, at, 3
            return self.offset(53, 0) + 3 * (track - 36), self.offset(18, 0) + 221 + track - 36, 3
        if self.name == "D81":
            at = self.offset(40, 1 if track <= 40 else 2) + 16 + 6 * ((track - 1) % 40)
            return at + 1, at, 5
        if self.name in ("D80", "D82"):
            at = self.offset(38, 3 * ((track - 1) // 50)) + 6 + 5 * ((track - 1) % 50)
            return at + 1, at, 4
        return self.offset(1, 2) + 32 * track, None, 32


def of(kind: str, size: int) -> Geometry:
    """The geometry of a disk type; the number of tracks of some follows the image's size."""
    if kind in ("D64", "ZC4", "ZC6", "D71"):
        single = _zones(_D64_ZONES)
        if kind == "D71" or size >= 349_696:
            return Geometry("D71", tuple(single * 2), (18, 0), 5 if kind == "D71" else 10, ((18, 0), (53, 0)))
        return Geometry("D64", tuple(single), (18, 0), 10, ((18, 0),))
    if kind == "D81":
        return Geometry("D81", (40,) * 80, (40, 0), 1, ((40, 1), (40, 2)), name_at=4, id_at=22)
    if kind == "D80":
        return Geometry("D80", tuple(_zones(_D80_ZONES)), (39, 0), 10, ((38, 0), (38, 3)), name_at=6, id_at=24)
    if kind == "D82":
        return Geometry("D82", tuple(_zones(_D80_ZONES) * 2), (39, 0), 10, ((38, 0), (38, 3), (38, 6), (38, 9)), name_at=6, id_at=24)
    if kind == "DNP":
        return Geometry("DNP", (256,) * max(1, size // 65536), (1, 1), 1, tuple((1, s) for s in range(2, 34)), msb_first=True, name_at=4, id_at=22)
    raise KeyError(kind)


def image_type(name: str) -> str | None:
    """Told from the name alone: by extension, also before .GZ, or by the prefix of a packed volume."""
    base = name.upper().rsplit("/", 1)[-1].removesuffix(".GZ")
    for kind in ("D64", "D71", "D81", "D80", "D82", "DNP", *ARCHIVES, "ZC4", "ZC6"):
        if base.endswith("." + kind):
            return kind
    if len(base) > 3 and base.startswith("1!"):
        return "ZC6" if base.startswith("1!!") else "ZC4"
    return None


def loose_type(name: str) -> str | None:
    """PRG, SEQ, CVT and the self-extracting kinds, also before .GZ and as `,P` and `,S`."""
    base = name.upper().removesuffix(".GZ")
    for kind in ("PRG", "SEQ", "CVT", "SDA", "SFX", "ARC", "LBR"):
        if base.endswith("." + kind):
            return kind
    return {",P": "PRG", ",S": "SEQ"}.get(base[-2:])
