"""Disk images: directories, contents, allocation bits, and functional changes that give a new image.

Files are dicts with file_path, file_name, raw_name, file_type, blocks, size, data, header, dir_loc and sectors, in listing order.
"""

from __future__ import annotations

from collections.abc import Iterator

from bytefleet.sources.formats import FormatError
from bytefleet.sources.formats.geometry import SECTOR, Geometry, of

TYPES = ("DEL", "SEQ", "PRG", "USR", "REL", "CBM", "DIR")
_GEOS_MARK = b"PRG formatted GEOS file V1.0"
DATA = SECTOR - 2


def petscii(raw: bytes, fold: bool = True) -> str:
    """A-Z become a-z; other 7-bit bytes stay, bytes over 127 become U+FF80 and up."""
    out = []
    for b in raw:
        out.append(chr(b + 32) if fold and 65 <= b <= 90 else chr(b) if b < 128 else chr(0xFF00 + b))
    return "".join(out)


def padded_name(raw: bytes, pads: bytes = b"\xa0\x00") -> bytes:
    return raw.rstrip(pads)


class Disk:
    """A parsed image. Nothing that a corrupt image holds makes the walk endless: visited sectors end every chain."""

    def __init__(self, content: bytes, kind: str):
        self.kind, self.geometry = kind, of(kind, len(content))
        self.errors: list[str] = []
        if (missing := self.geometry.size - len(content)) > 0:
            self.errors.append(f"the image is {missing} bytes short")
            content = content + bytes(missing)
        self.content = content

    # sectors

    def sector(self, track: int, sector: int) -> bytes:
        at = self.geometry.offset(track, sector)
        return self.content[at : at + SECTOR]

    def chain(self, track: int, sector: int) -> tuple[bytes, list[tuple[int, int]]]:
        """(payload, sectors) along the links; ends at track 0 or at a sector met before. A link out of range raises."""
        out, seen = [], {}
        while track and (track, sector) not in seen:
            data = self.sector(track, sector)
            seen[track, sector] = None
            out.append(data[2:] if data[0] else data[2 : data[1] + 1])
            track, sector = data[0], data[1]
        return b"".join(out), list(seen)

    # allocation

    def is_free(self, track: int, sector: int) -> bool:
        at, _, _ = self.geometry.bitmap(track)
        bit = 7 - sector % 8 if self.geometry.msb_first else sector % 8
        return bool(self.content[at + sector // 8] >> bit & 1)

    def bam(self) -> Iterator[tuple[int, int, bool]]:
        for track, n in enumerate(self.geometry.sectors, 1):
            for sector in range(n):
                yield track, sector, self.is_free(track, sector)

    def free_blocks(self) -> int:
        skip = {"D64": {18}, "D71": {18, 53}, "D81": {40}, "D80": {38, 39}, "D82": {38, 39}}.get(self.geometry.name, set())
        return sum(free for track, _, free in self.bam() if track not in skip)

    # listing

    def label(self) -> tuple[bytes, bytes]:
        head = self.sector(*self.geometry.head)
        return head[self.geometry.name_at : self.geometry.name_at + 16], head[self.geometry.id_at : self.geometry.id_at + 5]

    def cpm(self) -> str | None:
        """NORMAL, C64 or CBM if the label is one of the other system's."""
        name, ident = self.label()
        name = name.rstrip(b"\xa0\x00 ")
        boot = self.content[:3] == b"CBM"
        if self.geometry.name in ("D64", "D71"):
            if name == b"CP/M PLUS" and ident[:2] == b"65" and boot:
                return "NORMAL"
            return "C64" if name in (b"CP/M PLUS", b"CP/M DISK") else None
        if self.geometry.name == "D81":
            return "NORMAL" if name == b"CP/M PLUS" and ident[:2] == b"80" else None
        if self.geometry.name in ("D80", "D82"):
            return "CBM" if name == b"CPM86" and ident[:2] == b"86" else None
        return None

    def files(self, with_data: bool = True) -> list[dict]:
        if variant := self.cpm():
            return self._cpm_files(variant, with_data)
        g = self.geometry
        head = g.head
        bam = [head, *g.bam_sectors]
        out = [_row("*BAM*", b"", "DIR", sectors=list(dict.fromkeys(bam))), root := _row("/", b"", "DIR", sectors=[head])]
        if g.name in ("D80", "D82"):
            first = (39, 1)
            if g.name == "D82":
                link = self.sector(*g.bam_sectors[-1])
                first = (link[0], link[1])
        else:
            link = self.sector(*head)
            first = (link[0], link[1])
        seen: set[tuple[int, int]] = {head}
        root["sectors"] += self._walk(first, "", out, seen, with_data)
        link = self.sector(*head)
        border = (link[171], link[172])
        if g.name not in ("D80", "D82") and border[0] and (border[0] != 1 or g.name == "DNP") and border not in seen:
            try:
                if not self.is_free(*border) or border[0] == first[0]:
                    root["sectors"] += self._walk(border, "*/", out, seen, with_data)
            except (FormatError, IndexError):
                pass
        if self.kind == "D71":
            root["sectors"] += [(53, s) for s in range(1, g.sectors[52])]
        return out

    def _walk(self, start: tuple[int, int], prefix: str, out: list[dict], seen: set[tuple[int, int]], with_data: bool) -> list[tuple[int, int]]:
        at, mine = start, []
        while at[0] and at not in seen:
            try:
                data = self.sector(*at)
            except FormatError as e:
                self.errors.append(str(e))
                break
            seen.add(at)
            mine.append(at)
            for k in range(2, SECTOR, 32):
                entry = data[k : k + 30]
                if not entry[0] & 128 or entry[0] == 128:
                    continue
                if raw := padded_name(entry[3:19]):
                    try:
                        self._entry(entry, raw, (*at, k), prefix, out, seen, with_data)
                    except (FormatError, IndexError) as e:
                        self.errors.append(f"{prefix}{petscii(raw)}: {e}")
            at = (data[0], data[1])
        return mine

    def _entry(self, entry: bytes, raw: bytes, loc: tuple[int, int, int], prefix: str, out: list[dict], seen: set, with_data: bool) -> None:
        kind = TYPES[entry[0] & 15] if entry[0] & 15 < len(TYPES) else "PRG"
        first, side = (entry[1], entry[2]), (entry[19], entry[20])
        header = None
        if kind != "REL" and side[0]:
            try:
                info = self.sector(*side)
                header = info if info[:2] == b"\x00\xff" else None
            except FormatError:
                pass
        name = petscii(raw, fold=header is None)
        row = _row(prefix + name, raw, kind, blocks=entry[28] + 256 * entry[29], header=header, dir_loc=list(loc))
        out.append(row)
        if kind in ("CBM", "DIR"):
            child = first
            if kind == "DIR":
                link = self.sector(*first)
                child = (link[0], link[1])
                row["sectors"] = [first]
                seen.add(first)
            elif not self._looks_like_directory(first):
                row["sectors"] = self._partition(first, row["blocks"])
                return
            row["sectors"] += self._walk(child, prefix + name + "/", out, seen, with_data)
            return
        if kind == "REL" and side[0] and entry[21]:
            data, sectors = self._relative(first, side, entry[21])
        elif kind == "USR" and header is not None and first[0]:
            data, sectors = self._geos(entry, header, first, side)
        elif first[0]:
            data, sectors = self.chain(*first)
        else:
            data, sectors = b"", []
        row |= {"sectors": sectors, "size": len(data), "data": data if with_data else None}

    def _looks_like_directory(self, at: tuple[int, int]) -> bool:
        data = self.sector(*at)
        return 1 <= data[0] <= self.geometry.tracks and data[1] < self.geometry.sectors[data[0] - 1]

    def _partition(self, first: tuple[int, int], blocks: int) -> list[tuple[int, int]]:
        out, (track, sector) = [], first
        while len(out) < blocks and track <= self.geometry.tracks:
            out.append((track, sector))
            sector += 1
            if sector >= self.geometry.sectors[track - 1]:
                track, sector = track + 1, 0
        return out

    def _relative(self, first: tuple[int, int], side: tuple[int, int], record: int) -> tuple[bytes, list[tuple[int, int]]]:
        info = self.sector(*side)
        if info[2] == 254:  # a super side sector lists groups of side sectors
            starts = [(info[0], info[1]), *((info[k], info[k + 1]) for k in range(3, 255, 2))]
        elif info[3] == record:
            starts = [side]
        else:
            raise FormatError("the side sector has another record length")
        sectors = [side]
        for at in starts:
            if at[0]:
                sectors += [s for s in self.chain(*at)[1] if s not in sectors]
        data, own = self.chain(*first)
        return data, sectors + own

    def _geos(self, entry: bytes, header: bytes, first: tuple[int, int], side: tuple[int, int]) -> tuple[bytes, list[tuple[int, int]]]:
        """The converted form: directory entry and mark, info block, and the chain or the record map with all records."""
        block = bytearray(DATA)
        block[:30] = entry
        for k in (1, 2, 19, 20):
            block[k] = 0
        block[30 : 30 + len(_GEOS_MARK)] = _GEOS_MARK
        sectors = [side, first]
        if entry[21] != 1:
            data, sectors = self.chain(*first)
            return bytes(block) + header[2:] + data, [side, *sectors]
        index, table, parts = self.sector(*first), bytearray(DATA), []
        for k in range(0, DATA, 2):
            at = (index[2 + k], index[3 + k])
            if not at[0]:
                table[k : k + 2] = b"\x00\xff"
                continue
            data, own = self.chain(*at)
            sectors += own
            table[k : k + 2] = bytes([-(-len(data) // DATA) & 255, len(data) % DATA + 1])
            parts.append(data)
        body = b"".join(p + bytes(-len(p) % DATA) for p in parts[:-1]) + (parts[-1] if parts else b"")
        return bytes(block) + header[2:] + bytes(table) + body, sectors

    # the other system's file system

    def _units(self, variant: str) -> list[list[tuple[int, int]]]:
        """Allocation units in order, as lists of sectors."""
        g = self.geometry
        per_unit = 8 if g.name in ("D81", "D71", "D82") and variant != "C64" else 4
        order: list[tuple[int, int]] = []
        if variant in ("C64", "CBM"):
            count, begin, reserved = (17, 3, 18) if variant == "C64" else (23, 3, 39)
            order = [(t, s) for t in range(begin, g.tracks + 1) if t != reserved for s in range(min(count, g.sectors[t - 1]))]
        else:
            for track in range(1, g.tracks + 1):
                n = g.sectors[track - 1]
                step, s, done = (1 if g.name == "D81" else 5), 0, set()
                for _ in range(n):
                    while s in done:
                        s = (s + 1) % n
                    done.add(s)
                    if (track, s) not in ((1, 0), (1, 5)) and track not in ((18,) if g.name != "D81" else (40,)):
                        order.append((track, s))
                    s = (s + step) % n
        return [order[k : k + per_unit] for k in range(0, len(order), per_unit)]

    def _cpm_files(self, variant: str, with_data: bool) -> list[dict]:
        units = self._units(variant)
        wide = self.geometry.name == "D81"
        directory = b"".join(self.sector(*s) for s in units[0])
        found: dict[bytes, dict] = {}
        for at in range(0, len(directory), 32):
            entry = directory[at : at + 32]
            if entry[0] >= 32 or not entry[1:12].strip(b"\x00"):
                continue
            raw = bytes(b & 127 for b in entry[1:12])
            name = raw[:8].decode("latin-1").rstrip() + "." + raw[8:].decode("latin-1").rstrip()
            row = found.setdefault(raw, _row(name, raw, "PRG", header=None, dir_loc=[]))
            place = units[0][at // SECTOR]
            row["dir_loc"] += [*place, at % SECTOR]
            numbers = [int.from_bytes(entry[k : k + 2], "little") for k in range(16, 32, 2)] if wide else list(entry[16:32])
            row.setdefault("_extents", []).append((entry[14] * 32 + entry[12], entry[15], [n for n in numbers if n]))
        for row in found.values():
            data = b""
            for _, records, numbers in sorted(row.pop("_extents")):
                part = b""
                for n in numbers:
                    if n >= len(units):
                        self.errors.append(f"{row['file_path']}: no block {n}")
                        continue
                    row["sectors"] += units[n]
                    part += b"".join(self.sector(*s) for s in units[n])
                data += part[: records * 128] if records < 128 else part
            row |= {"size": len(data), "blocks": -(-len(data) // SECTOR), "data": data if with_data else None}
        return list(found.values())

    # changes: each gives a new image

    def with_allocation(self, sectors: list[tuple[int, int]], free: bool) -> bytes:
        """The image with the sectors' bits, and their tracks' counts, set."""
        out, g = bytearray(self.content), self.geometry
        for track, sector in sectors:
            at, count, _ = g.bitmap(track)
            mask = 1 << (7 - sector % 8 if g.msb_first else sector % 8)
            was = bool(out[at + sector // 8] & mask)
            if was == free:
                continue
            out[at + sector // 8] ^= mask
            if count is not None:
                out[count] = max(0, min(255, out[count] + (1 if free else -1)))
        return bytes(out)

    def scratched(self, path: str) -> bytes:
        """The image without a file: its entry is cleared, its sectors are freed."""
        row = self.find(path)
        if self.cpm():
            out = bytearray(self.content)
            for k in range(0, len(row["dir_loc"]), 3):
                track, sector, at = row["dir_loc"][k : k + 3]
                out[self.geometry.offset(track, sector) + at] = 0xE5
            return bytes(out)
        out = bytearray(self.with_allocation(row["sectors"], free=True))
        track, sector, at = row["dir_loc"]
        out[self.geometry.offset(track, sector) + at] = 0
        return bytes(out)

    def find(self, path: str) -> dict:
        """By exact path, else with case aside."""
        rows = [r for r in self.files() if r["dir_loc"]]
        for same in (lambda p: p == path, lambda p: p.lower() == path.lower()):
            for row in rows:
                if same(row["file_path"]):
                    return row
        raise FormatError(f"no file {path}")

    def free_sectors(self, count: int) -> list[tuple[int, int]]:
        """Sectors for a new file: tracks nearest to the directory first, the usual interleave within a track."""
        g, middle = self.geometry, self.geometry.head[0]
        skip = {s[0] for s in g.bam_sectors} | {middle} if g.name != "DNP" else set()
        order = sorted((t for t in range(1, g.tracks + 1) if t not in skip), key=lambda t: (abs(t - middle), t > middle))
        out: list[tuple[int, int]] = []
        for track in order:
            n = g.sectors[track - 1]
            free, s = {x for x in range(n) if self.is_free(track, x)}, 0
            while free and len(out) < count:
                while s % n not in free:
                    s += 1
                out.append((track, s % n))
                free.discard(s % n)
                s = s % n + g.interleave
            if len(out) == count:
                return out
        raise FormatError("the disk is full")

    def _found(self, path: str) -> dict | None:
        try:
            return self.find(path)
        except FormatError:
            return None

    def inserted(self, path: str, data: bytes, kind: str = "PRG") -> bytes:
        """The image with a file: a file that has the path is replaced; `folder/name` goes into that directory, if there is one."""
        old = self._found(path)
        if old and old["file_type"] in ("DIR", "CBM"):
            raise FormatError(f"{path} is a directory")
        if old:
            return Disk(self.scratched(old["file_path"]), self.kind)._placed(path, data, kind)
        return self._placed(path, data, kind)

    def _placed(self, path: str, data: bytes, kind: str) -> bytes:
        """Contents in free sectors, an entry in the first free slot (a new directory sector if there is none)."""
        if self.cpm():
            return self._cpm_inserted(path, data)
        g = self.geometry
        folder, _, name = path.rpartition("/")
        home = self._found(folder) if folder else None
        if home and home["file_type"] == "CBM":
            raise FormatError(f"{folder} is a partition with a bitmap of its own")
        name = name if home and home["file_type"] == "DIR" else path.lstrip("/")
        raw = name.swapcase().encode("latin-1", "replace")[:16] if name.islower() else name.encode("latin-1", "replace")[:16]
        head = self.sector(*g.head)
        at = (39, 1) if g.name in ("D80", "D82") else (head[0], head[1])
        if home and home["file_type"] == "DIR":
            link = self.sector(*home["sectors"][0])
            at = (link[0], link[1])
        slot, last, seen = None, at, set()
        while at[0] and at not in seen and slot is None:
            seen.add(at)
            page = self.sector(*at)
            slot = next(((at, k) for k in range(2, SECTOR, 32) if not page[k] & 128), None)
            last, at = at, (page[0], page[1])
        need = max(1, -(-len(data) // DATA))
        grow = [] if slot else [(last[0], s) for s in range(g.sectors[last[0] - 1]) if self.is_free(last[0], s)][:1]
        if not slot and not grow:
            raise FormatError("the directory is full")
        sectors = [s for s in self.free_sectors(need + len(grow)) if s not in grow][:need]
        out = bytearray(self.with_allocation([*sectors, *grow], free=False))
        for k, place in enumerate(sectors):
            part = data[k * DATA : (k + 1) * DATA]
            link = bytes(sectors[k + 1]) if k + 1 < need else bytes([0, len(part) + 1])
            o = g.offset(*place)
            out[o : o + SECTOR] = (link + part).ljust(SECTOR, b"\x00")
        if not slot:
            o = g.offset(*last)
            out[o : o + 2] = bytes(grow[0])
            o = g.offset(*grow[0])
            out[o : o + SECTOR] = b"\x00\xff" + bytes(SECTOR - 2)
            slot = (grow[0], 2)
        entry = bytes([128 | TYPES.index(kind), *sectors[0]]) + raw.ljust(16, b"\xa0") + bytes(9) + need.to_bytes(2, "little")
        o = g.offset(*slot[0]) + slot[1]
        out[o : o + 30] = entry
        return bytes(out)

    def _cpm_inserted(self, name: str, data: bytes) -> bytes:
        variant = self.cpm()
        units, wide = self._units(variant), self.geometry.name == "D81"
        used = {s for r in self.files(False) for s in r["sectors"]}
        unit_bytes = len(units[0]) * SECTOR
        free = [k for k, u in enumerate(units) if k > 0 and (not wide or k < 65536) and (wide or k < 256) and not used.intersection(u)]
        need = -(-len(data) // unit_bytes)
        if need > len(free):
            raise FormatError("the disk is full")
        stem, _, ext = name.upper().partition(".")
        out, per_extent = bytearray(self.content), 8 if wide else 16
        slots = [(u, k) for u in units[0] for k in range(0, SECTOR, 32) if self.sector(*u)[k] == 0xE5]
        for n in range(max(1, -(-need // per_extent))):
            if n >= len(slots):
                raise FormatError("the directory is full")
            mine = free[n * per_extent : min(need, (n + 1) * per_extent)]
            part = data[n * per_extent * unit_bytes : (n + 1) * per_extent * unit_bytes]
            numbers = b"".join(k.to_bytes(2 if wide else 1, "little") for k in mine).ljust(16, b"\x00")
            extent = bytes([0]) + stem[:8].ljust(8).encode() + ext[:3].ljust(3).encode() + bytes([n % 32, 0, n // 32, min(128, -(-len(part) // 128))]) + numbers
            o = self.geometry.offset(*slots[n][0]) + slots[n][1]
            out[o : o + 32] = extent
            for j, k in enumerate(mine):
                block = part[j * unit_bytes : (j + 1) * unit_bytes].ljust(unit_bytes, b"\x1a")
                for i, s in enumerate(units[k]):
                    o = self.geometry.offset(*s)
                    out[o : o + SECTOR] = block[i * SECTOR : (i + 1) * SECTOR]
        return bytes(out)


def _row(path: str, raw: bytes, kind: str, blocks: int = 0, size: int | None = None, data: bytes | None = None, header: bytes | None = None, dir_loc: list[int] | None = None, sectors: list | None = None) -> dict:
    return {"file_path": path, "file_name": path if path == "/" else path.rstrip("/").rsplit("/", 1)[-1], "raw_name": raw, "file_type": kind, "blocks": blocks, "size": DATA * blocks if size is None else size, "data": data, "header": header, "dir_loc": dir_loc or [], "sectors": sectors or []}


def formatted(kind: str = "D64", name: str = "EMPTY", ident: str = "00 2A", tracks: int = 16) -> bytes:
    """A new, empty image."""
    g: Geometry = of(kind, tracks * 65536 if kind == "DNP" else 0)
    out = bytearray(g.size)
    first = {"D81": (40, 3), "D80": (39, 1), "D82": (39, 1), "DNP": (1, 34)}.get(g.name, (18, 1))
    head = g.offset(*g.head)
    out[head : head + 2] = bytes(first) if g.name not in ("D80", "D82") else bytes((38, 0))
    out[head + g.name_at : head + g.name_at + 16] = name.encode().ljust(16, b"\xa0")
    out[head + g.id_at : head + g.id_at + 5] = ident.encode().ljust(5, b"\xa0")[:5]
    o = g.offset(*first)
    out[o : o + 2] = b"\x00\xff"
    if g.name == "D82":
        o = g.offset(38, 9)
        out[o : o + 2] = bytes(first)
    for track, n in enumerate(g.sectors, 1):
        at, count, size = g.bitmap(track)
        bits = (1 << n) - 1
        out[at : at + size] = bits.to_bytes(size, "little")
        if count is not None:
            out[count] = n
    used = [g.head, first, *g.bam_sectors] + ([(53, s) for s in range(19)] if g.name == "D71" else []) + ([(1, 0)] if g.name == "DNP" else [])
    return Disk(bytes(out), kind).with_allocation(list(dict.fromkeys(used)), free=False)
