"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts each text where its content says so; equal passages of different documents
thus give equal chunks, and a worker encodes each of them once. A text without a cut is one chunk. A cut may fall inside a token. So every join
is repaired: the last piece of the left chunk and the first of the right are encoded anew between guard pieces,
and the join is taken only if both guards come out exactly as they stand in their chunks; else the guards widen,
and in the end the whole text is encoded in one go. The result equals the library's for every text.

Defined cases: a null text counts as empty (no tokens, decoded text ""); equal rows give equal results, one row
out for each row in; special strings inside a text are read as the library does by default (as special tokens).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bytefleet.llm.common import map_text, worker_state
from bytefleet.llm.tokenizers_io import PieceCache, byte_level_pieces, load, packed

WINDOW, CUT_BITS = 32, 11
#: Chunks kept in a worker, and the longest one that is kept (bytes): at most about 64 MB with their ids.
CHUNKS_KEPT, CHUNK_KEPT_BYTES = 8192, 8192
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20
_GUARDS = 3


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(_BLOCK + WINDOW, _BASE, np.uint64), np.full(_BLOCK + WINDOW, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def cut_points(data: bytes) -> list[int]:
    """Where the rolling hash of the last WINDOW bytes has CUT_BITS leading zeros, moved on to the start of a character.

    A cut depends on the WINDOW bytes before it alone: texts that share a passage share its inner cuts.
    """
    raw = np.frombuffer(data, np.uint8)
    found = []
    up, down = _powers()
    for start in range(0, max(0, len(raw) - WINDOW + 1), _BLOCK):
        part = raw[start : start + _BLOCK + WINDOW - 1].astype(np.uint64)
        sums = np.cumsum(part * down[: len(part)])
        sums[WINDOW:] -= sums[:-WINDOW].copy()
        hashes = sums[WINDOW - 1 :] * up[WINDOW - 1 : len(part)]
        found.append(np.flatnonzero(hashes >> np.uint64(64 - CUT_BITS) == 0) + (start + WINDOW))
    cuts = np.concatenate(found) if found else np.empty(0, np.int64)
    cuts = cuts[cuts < len(raw)]
    for _ in range(3):
        inside = (raw[np.minimum(cuts, len(raw) - 1)] & 0xC0) == 0x80 if len(cuts) else np.zeros(0, bool)
        cuts = cuts + inside
    return np.unique(cuts[cuts < len(raw)]).tolist()


class ChunkEncoder:
    """Encodes texts; keeps chunks and pieces that it has met, within fixed bounds."""

    def __init__(self, path: str):
        self.tokenizer, self.pieces, self.chunks = load(path), PieceCache(path, packed), {}
        self.reused = self.reused_bytes = self.repaired = self.whole = 0

    def _direct(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _chunk(self, data: bytes) -> tuple | None:
        """(first pieces, ids of all but the first and last piece, last pieces), or None if the chunk has too few pieces."""
        known = self.chunks.get(data, 0)
        if known != 0:
            self.reused, self.reused_bytes = self.reused + 1, self.reused_bytes + len(data)
            return known
        pieces = byte_level_pieces(data.decode())
        made = None
        if len(pieces) >= 2 * _GUARDS + 2:
            ids = self.pieces(pieces)
            ends = [*range(_GUARDS + 1)], [*range(len(pieces) - 1, len(pieces) - _GUARDS - 2, -1)]
            made = ([(pieces[k], ids[k]) for k in ends[0]], b"".join(ids[1:-1]), [(pieces[k], ids[k]) for k in ends[1]])
        if len(data) <= CHUNK_KEPT_BYTES:
            if len(self.chunks) >= CHUNKS_KEPT:
                self.chunks.clear()
            self.chunks[data] = made
        return made

    def _join(self, left: list, seam: str, right: list) -> bytes | None:
        """Ids of the seam between guards that agree exactly, or None. left and right begin at the seam."""
        self.repaired += 1
        for n in range(1, _GUARDS + 1):
            before, after = left[1 : n + 1][::-1], right[1 : n + 1]
            ids = self._direct("".join(p for p, _ in before) + seam + "".join(p for p, _ in after))
            head, tail = b"".join(x for _, x in before), b"".join(x for _, x in after)
            if len(ids) >= len(head) + len(tail) and ids.startswith(head) and ids.endswith(tail):
                return ids[len(head) : len(ids) - len(tail)]
        return None

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        data = text.encode()
        cuts = cut_points(data) if len(data) >= 2 * WINDOW else []
        if not cuts:
            only = self._chunk(data)
            return b"".join([only[0][0][1], only[1], only[2][0][1]]) if only else b"".join(self.pieces(byte_level_pieces(text)))
        out, left, open_text = [], [], ""
        for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
            chunk = self._chunk(data[a:b])
            if chunk is None:
                open_text += data[a:b].decode()
                continue
            first, middle, last = chunk
            ids = self._join(left, open_text + first[0][0], first)
            if ids is None:
                self.whole += 1
                return self._direct(text)
            out += [ids, middle]
            left, open_text = last, last[0][0]
        ids = self._join(left, open_text, [])
        if ids is None:
            self.whole += 1
            return self._direct(text)
        return b"".join([*out, ids])


class TokenBytes:
    """Decoding by table: the bytes of each token joined, then read as UTF-8 with replacement, as the library does."""

    def __init__(self, path: str):
        tokenizer = load(path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        added = {k: x.content.encode() for k, x in tokenizer.get_added_tokens_decoder().items()}
        names = [tokenizer.id_to_token(k) for k in range(tokenizer.get_vocab_size())]
        texts = [added[k] if k in added else bytes(of[c] for c in name) for k, name in enumerate(names)]
        self.size = np.array([len(x) for x in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4")
        size = self.size[numbers]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[numbers] - ends + size, size) + np.arange(total)
        return self.data[at].tobytes().decode("utf-8", "replace")


def _coder(path: str) -> tuple[ChunkEncoder, TokenBytes]:
    return worker_state("bpe", path, lambda: (ChunkEncoder(path), TokenBytes(path)))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", id_type: str = "bigint") -> DataFrame:
    """(id, ids): the token ids of each text."""

    def each(keys, texts):
        encoder, _ = _coder(path)
        found = [np.frombuffer(encoder.encode(t or ""), "<u4") for t in texts]
        values = pa.array(np.concatenate([*found, np.empty(0, "<u4")]).astype(np.int32))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return keys, pa.ListArray.from_arrays(pa.array(ends), values)

    return map_text(df, id_col, text_col, each, f"{id_col} {id_type}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", id_type: str = "bigint") -> DataFrame:
    """(id, text): the text of each list of ids; null ids give the empty text."""

    def run(batches):
        for batch in batches:
            _, table = _coder(path)
            texts = [table.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(df[id_col], df[ids_col]).mapInArrow(run, f"{id_col} {id_type}, text string")


def roundtrip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", id_type: str = "bigint") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded, both digested where they are made."""

    def each(keys, texts):
        encoder, table = _coder(path)
        ids = [encoder.encode(t or "") for t in texts]
        return keys, [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(table.decode(x).encode()).hexdigest() for x in ids]

    return map_text(df, id_col, text_col, each, f"{id_col} {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
