"""Token counts by a public vocabulary, with overlap resynchronisation for huge documents.

A text of at most `chunk` characters is counted from its pieces between spaces; the vocabulary drops white
space before it splits, so nothing spans one. A longer text is encoded in chunks that overlap, with offsets.
Two neighbours are spliced at a stable common boundary: a place in their overlap that follows white space (no
match, normalisation or look-around of the vocabulary passes it) and at which both have agreed on a
token start. Places beside digits and before common punctuation are stable too, as the vocabulary's pattern always
splits there. Where the overlap has no such place, it is widened; where the whole left chunk has none, both chunks become one,
and each further chunk is as long as all that is open, so that the work stays in proportion to the text.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); one row out for each row in.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from bytefleet.llm.common import map_text, worker_state
from bytefleet.llm.tokenizers_io import PieceCache, load

CHUNK, OVERLAP = 16_384, 512
#: Where a token always starts: after white space, between ASCII digits and letters, before punctuation that follows a letter
#: which neither lower-casing nor NFC takes apart.
#: The apostrophe and the characters of special strings (<, |, >) are left out; none of these characters joins its neighbour in NFC.
_STABLE = re.compile(r"(?<=[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])|(?<=[0-9])(?=[A-Za-z0-9])|(?<=[A-Za-z])(?=[0-9])|(?<=[A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3])(?=[.,;:!?\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")


class Resync:
    """Counts the tokens of one long text from overlapping chunks."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        if not 0 < overlap < chunk:
            raise ValueError("the overlap lies between 0 and the chunk")
        self.tokenizer, self.chunk, self.overlap = load(path), chunk, overlap
        self.widened = self.encoded = 0

    def _starts(self, text: str, a: int, b: int) -> list[int]:
        """Where the tokens of text[a:b] start. A token with no offset of its own keeps its neighbour's order."""
        self.encoded += b - a
        return [a + s for s, _ in self.tokenizer.encode(text[a:b], add_special_tokens=False).offsets]

    @staticmethod
    def _splice(text: str, left: list[int], right: list[int], a: int, b: int) -> int | None:
        """The middle one of the stable common boundaries in text[a:b], or None."""
        ours, theirs = {s for s in left if a < s < b}, {s for s in right if a < s < b}
        stable = sorted(ours & theirs & {m.start() for m in _STABLE.finditer(text, a + 1, b)})
        return stable[len(stable) // 2] if stable else None

    def count(self, text: str) -> int:
        size, total = len(text), 0
        begin, end = 0, min(self.chunk, size)
        left = self._starts(text, 0, end)
        while end < size:
            overlap, cut = self.overlap, None
            stop = min(size, end + max(self.chunk, end - begin))
            while True:
                start = max(begin, end - overlap)
                if _STABLE.search(text, start + 1, end):  # else there is nothing to encode for
                    right = self._starts(text, start, stop)
                    cut = self._splice(text, left, right, start, end)
                if cut is not None or start == begin:
                    break
                overlap *= 2
                self.widened += 1
            if cut is None:  # no stable place in all of the left chunk: both become one chunk
                end, left = stop, self._starts(text, begin, stop)
                continue
            total += sum(s < cut for s in left)
            begin, end, left = cut, stop, [s for s in right if s >= cut]
        return total + len(left)


def _counters(path: str, chunk: int, overlap: int) -> tuple[PieceCache, Resync]:
    return worker_state("token_counts", (path, chunk, overlap), lambda: (PieceCache(path, len), Resync(path, chunk, overlap)))


def token_counts(df: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text", id_type: str = "bigint") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, without begin, end or added tokens."""

    def each(keys, texts):
        pieces, long_texts = _counters(path, chunk, overlap)
        counts = [sum(pieces(t.split(" "))) if len(t) <= chunk else long_texts.count(t) for t in (t or "" for t in texts)]
        return keys, [len((t or "").encode()) for t in texts], counts, [n > limit for n in counts]

    return map_text(df, id_col, text_col, each, f"{id_col} {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
