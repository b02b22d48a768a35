"""Media columns as baseline JPEG.

A payload is stored as a grey baseline JPEG of one 8x8 block for each byte: the quantiser is 8, so the DC coefficient of
byte b is b - 128 exactly and the block shows the flat grey b. The stored bytes are then read as any
baseline file is: markers parsed, scans Huffman-decoded with the tables in the file, and the luminance thumbnail
of one pixel a block rebuilt from DC coefficients alone (no inverse transform). That thumbnail is the payload again.

The decoder takes any baseline (SOF0) file, with any tables, sampling, components and restart markers; AC coefficients are
decoded and passed over. All restart intervals are decoded side by side in numpy, one lane each; a restart
interval of one block row makes a payload's lanes many and short.

Bounds: a frame holds up to ROWS rows of WIDTH blocks; a longer payload becomes several JPEG files one after the other,
each complete. Defined cases: a null text is the empty payload, padded to 64 zero bytes; equal texts give equal
files and features; one row out for each row in. A malformed file raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from bytefleet.llm.common import map_text

WIDTH, ROWS, UNIT = 64, 8191, 64
#: Bytes of payload that are coded and decoded together; bounds the memory of a slice.
TOGETHER = 2 << 20
# Code lengths of the DC differences' sizes 0..8, so that a code and its extra bits take 9 bits together.
_DC_LENGTHS = {size: 9 - size for size in range(9)}


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _huffman_segment(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(1 for s in order if lengths[s] == n) for n in range(1, 17)]
    return _segment(0xC4, bytes([kind, *counts, *order]))


def codes(counts: list[int], symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), by the canonical rule."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(maxsize=1)
def _dc_code() -> tuple[np.ndarray, np.ndarray]:
    """For each difference -255..255: its ten bits (code, extra bits, and the one-bit end of block)."""
    order = sorted(_DC_LENGTHS, key=lambda s: (_DC_LENGTHS[s], s))
    counts = [sum(1 for s in order if _DC_LENGTHS[s] == n) for n in range(1, 17)]
    table = codes(counts, bytes(order))
    words = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << size) - 1
        words[d + 255] = ((table[size][0] << size) | extra) << 1  # the end of block is the code 0
    return words, np.arange(511)


@lru_cache(maxsize=256)
def _head(rows: int) -> bytes:
    quantiser = _segment(0xDB, bytes([0]) + bytes([8] * 64))
    frame = _segment(0xC0, bytes([8]) + (rows * 8).to_bytes(2, "big") + (WIDTH * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    tables = _huffman_segment(0x00, _DC_LENGTHS) + _huffman_segment(0x10, {0: 1})
    return b"\xff\xd8" + quantiser + frame + tables + _segment(0xDD, WIDTH.to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of 64 bytes) as one JPEG file, or as several in a row if it is longer than a frame."""
    joined = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH)
    level = joined.astype(np.int16) - 128
    diff = np.diff(level, axis=1, prepend=np.zeros((len(level), 1), np.int16))  # each row is a restart interval: it begins at 0
    words = _dc_code()[0][(diff + 255).ravel()].reshape(-1, 4)
    packed = (words[:, 0] << np.uint64(30)) | (words[:, 1] << np.uint64(20)) | (words[:, 2] << np.uint64(10)) | words[:, 3]
    raw = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(len(level), -1)  # 64 x 10 bits: 80 bytes a row, no padding
    out, at = [], 0
    for p in payloads:
        rows, files = len(p) // WIDTH, []
        for begin in range(0, rows, ROWS):
            n = min(ROWS, rows - begin)
            part = raw[at + begin : at + begin + n]
            size = part.shape[1]
            full = np.empty((n, size + 2), np.uint8)
            full[:, :size], full[:, size], full[:, size + 1] = part, 0xFF, 0xD0 + np.arange(n) % 8
            flat = full.ravel()[:-2]
            stuffed = flat == 0xFF
            stuffed.reshape(-1)[np.arange(1, n) * (size + 2) - 2] = False  # the markers' own bytes
            files.append(_head(n) + np.insert(flat, np.flatnonzero(stuffed) + 1, 0).tobytes() + b"\xff\xd9")
        out.append(b"".join(files))
        at += rows
    return out


class Frame:
    """Tables and geometry of one file, as its markers tell."""

    def __init__(self) -> None:
        self.height = self.width = self.restart = 0
        self.components: list[tuple[int, int, int, int]] = []
        self.quant: dict[int, bytes] = {}
        self.huffman: dict[int, tuple[list[int], bytes]] = {}
        self.scan: list[tuple[int, int, int]] = []
        self.data = (0, 0)


def parse(data: bytes, at: int = 0) -> tuple[Frame, int]:
    """(frame, where the file ends). Raises ValueError at anything but one baseline scan."""
    frame = Frame()
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if len(body) != size - 2:
            raise ValueError("a segment is cut short")
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                frame.quant[body[k] & 15] = body[k + 1 : k + 65 + 64 * wide]
                k += 65 + 64 * wide
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = list(body[k + 1 : k + 17])
                frame.huffman[body[k]] = (counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif marker == 0xC0:
            frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame.components = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline file")
        elif marker == 0xDD:
            frame.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            frame.scan = [(body[k], body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)]
            break
        elif marker == 0xD9:
            raise ValueError("no scan")
    if not frame.components or not frame.scan:
        raise ValueError("no frame")
    end = at
    while True:  # the scan ends at the first marker that isn't a restart or a stuffed byte
        end = data.find(b"\xff", end)
        if end < 0 or end + 1 >= len(data):
            raise ValueError("no end of image")
        if data[end + 1] == 0xD9:
            break
        if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
            raise ValueError("more than one scan")
        end += 2
    frame.data = (at, end)
    return frame, end + 2


@lru_cache(maxsize=64)
def _lookup(counts: tuple[int, ...], symbols: bytes) -> np.ndarray:
    """By the next 16 bits: symbol and code length, packed as symbol << 8 | length; 0 where no code matches."""
    table = np.zeros(1 << 16, np.int64)
    for symbol, (code, length) in codes(list(counts), symbols).items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = symbol << 8 | length
    return table


def _units(frame: Frame) -> tuple[list[tuple[int, int, int]], int, int, int]:
    """(the scan's blocks in an MCU as (component, DC table, AC table)), MCUs across, MCUs down, MCUs in an interval."""
    of = {c[0]: (k, c[1], c[2]) for k, c in enumerate(frame.components)}
    if len(frame.scan) == 1:
        k, h, v = of[frame.scan[0][0]]
        high, wide = max(c[2] for c in frame.components), max(c[1] for c in frame.components)
        across, down = -(-(-(-frame.width * h // wide)) // 8), -(-(-(-frame.height * v // high)) // 8)
        blocks = [(k, frame.scan[0][1], frame.scan[0][2])]
    else:
        blocks = [(of[c][0], dc, ac) for c, dc, ac in frame.scan for _ in range(of[c][1] * of[c][2])]
        across = -(-frame.width // (8 * max(c[1] for c in frame.components)))
        down = -(-frame.height // (8 * max(c[2] for c in frame.components)))
    return blocks, across, down, frame.restart or across * down


def decode_dc(files: list[tuple[bytes, Frame]]) -> list[np.ndarray]:
    """DC coefficients of each file in scan order, [MCU, block of the MCU], for files that share tables and layout."""
    blocks, *_ = _units(files[0][1])
    tables = {}
    for _, dc, ac in blocks:
        for kind in (dc, 16 | ac):
            counts, symbols = files[0][1].huffman[kind]
            tables[kind] = _lookup(tuple(counts), symbols)
    lanes, todo, layout, base = [], [], [], 0
    for data, frame in files:
        _, across, down, interval = _units(frame)
        raw = np.frombuffer(data, np.uint8)[frame.data[0] : frame.data[1]]
        ff = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[ff + 1]
        marks, drop = ff[(after >= 0xD0) & (after <= 0xD7)], ff[after == 0] + 1
        keep = np.ones(len(raw), bool)
        keep[drop] = keep[marks] = keep[marks + 1] = False
        clean = raw[keep]
        gone = np.cumsum(~keep)
        starts = np.concatenate([[0], marks + 2 - gone[marks + 1]])
        count = -(-across * down // interval)
        if len(starts) != count:
            raise ValueError("restart markers don't fit the frame")
        layout.append((base, starts, across * down, interval, clean))
        todo.append(np.minimum(interval, across * down - interval * np.arange(count)))
        lanes.append(starts)
        base += len(clean) + 8
    buffer = np.full(base + 8, 0xFF, np.uint8)
    for at, _, _, _, clean in layout:
        buffer[at : at + len(clean)] = clean
    bit = np.concatenate([(at + s) * 8 for (at, s, *_), s in zip(layout, lanes, strict=True)])
    left = np.concatenate(todo)
    # at each byte, the 32 bits that begin there
    wide = buffer.astype(np.uint32)
    window = (wide[:-7] << 24) | (wide[1:-6] << 16) | (wide[2:-5] << 8) | wide[3:-4]
    window = window.astype(np.int64) << 8 | buffer[4:-3]
    components = max(b[0] for b in blocks) + 1
    previous = np.zeros((components, len(bit)), np.int64)
    out = np.zeros((int(left.max()), len(blocks), len(bit)), np.int32)

    def take(live, kind):
        """Next symbol of each live lane and its extra bits' place; moves the lanes on past the code."""
        bits = window[bit[live] >> 3] >> (24 - (bit[live] & 7)) & 0xFFFF
        hit = tables[kind][bits]
        if not hit.all():
            raise ValueError("no such Huffman code")
        bit[live] += hit & 255
        return hit >> 8

    def extra(live, size):
        value = (window[bit[live] >> 3] >> (24 - (bit[live] & 7)) & 0xFFFF) >> (16 - size)
        bit[live] += size
        return np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)

    everyone = np.arange(len(bit))
    for step in range(int(left.max())):
        live = everyone if (left > step).all() else np.flatnonzero(left > step)
        for k, (component, dc, ac) in enumerate(blocks):
            previous[component, live] += extra(live, take(live, dc))
            out[step, k, live] = previous[component, live]
            inside, position = live, np.ones(len(live), np.int64)
            while len(inside):
                symbol = take(inside, 16 | ac)
                run, size = symbol >> 4, symbol & 15
                bit[inside] += size
                position = np.where(symbol == 0, 64, position + run + 1)
                inside, position = inside[position < 64], position[position < 64]
    if (bit > 8 * base + 64).any():
        raise ValueError("a scan is cut short")
    found, lane = [], 0
    for _, starts, total, interval, _ in layout:
        part = out[:, :, lane : lane + len(starts)]
        found.append(part.transpose(2, 0, 1).reshape(-1, len(blocks))[:total] if interval == len(out) else np.concatenate([part[:n, :, j] for j, n in enumerate(np.minimum(interval, total - interval * np.arange(len(starts))))]))
        lane += len(starts)
    return found


def luminance(frame: Frame, dc: np.ndarray) -> np.ndarray:
    """The DC-only thumbnail: one pixel for each block of the first component."""
    blocks, across, down, _ = _units(frame)
    first = [k for k, b in enumerate(blocks) if b[0] == 0]
    h, v = (1, 1) if len(frame.scan) == 1 else frame.components[0][1:3]
    table = frame.quant[frame.components[0][3]]
    q = table[0] if len(table) == 64 else int.from_bytes(table[:2], "big")
    grid = dc[:, first].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    return np.clip((grid * q + 4) // 8 + 128, 0, 255).astype(np.uint8)


def thumbnails(stored: list[bytes]) -> list[list[np.ndarray]]:
    """Luminance thumbnails of all files that each stored form holds. Files with equal tables are decoded together."""
    parsed, groups = [], {}
    for k, data in enumerate(stored):
        at = 0
        while at < len(data):
            frame, at = parse(data, at)
            key = (tuple((n, tuple(c), s) for n, (c, s) in sorted(frame.huffman.items())), tuple(frame.scan), tuple(c[:3] for c in frame.components))
            groups.setdefault(key, []).append(len(parsed))
            parsed.append((k, data, frame))
    out: list[list] = [[] for _ in stored]
    shown = {}
    for members in groups.values():
        for n, dc in zip(members, decode_dc([(parsed[n][1], parsed[n][2]) for n in members]), strict=True):
            shown[n] = luminance(parsed[n][2], dc)
    for n, (k, _, _) in enumerate(parsed):
        out[k].append(shown[n])
    return out


def thumbnail_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 8x8 cells is brighter on average than the cell to its right (the last: than the first)."""
    rows, columns = (np.linspace(0, n, 9).astype(int) for n in image.shape)
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    total[1:, 1:] = image.astype(np.int64).cumsum(0).cumsum(1)
    lower, upper = (np.minimum(r[:-1], n - 1) for r, n in ((rows, image.shape[0]), (columns, image.shape[1])))
    bottom, right = np.maximum(rows[1:], lower + 1), np.maximum(columns[1:], upper + 1)
    cell = total[np.ix_(bottom, right)] - total[np.ix_(lower, right)] - total[np.ix_(bottom, upper)] + total[np.ix_(lower, upper)]
    mean = cell / ((bottom - lower)[:, None] * (right - upper)[None, :])
    return int.from_bytes(np.packbits(mean > np.roll(mean, -1, 1)).tobytes(), "big")


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT if data else UNIT)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_type: str = "bigint", keep_media: bool = False) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, width, height, feature[, media]).

    Payload columns are computed from the stored bytes, read back. `feature` joins dimensions, hash and mean of the thumbnails.
    """

    def each(keys, texts):
        raw = [(t or "").encode() for t in texts]
        columns: list[list] = [[] for _ in range(10)]
        begin = 0
        while begin < len(raw):
            end, held = begin, 0
            while end < len(raw) and (end == begin or held + len(raw[end]) <= TOGETHER):
                held += len(raw[end])
                end += 1
            stored = encode_many([padded(x) for x in raw[begin:end]])
            for data, media, shown in zip(raw[begin:end], stored, thumbnails(stored), strict=True):
                back = b"".join(x.tobytes() for x in shown)
                height, width = sum(x.shape[0] for x in shown), shown[0].shape[1]
                feature = f"{width}x{height}:" + "".join(f"{thumbnail_hash(x):016x}" for x in shown) + f":{sum(int(x.sum(dtype=np.int64)) for x in shown) / len(back):.2f}"
                row = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), 8 * width, 8 * height, feature, media)
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
            begin = end
        return keys, *columns[: 10 if keep_media else 9]

    return map_text(docs, id_col, text_col, each, f"{id_col} {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, width bigint, height bigint, feature string" + (", media binary" if keep_media else ""))
