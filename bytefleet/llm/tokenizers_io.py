"""Public tokenizer files, loaded once in each Python worker, and encoding by memoised pieces."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np


def public_path(name: str) -> str:
    """Where the named public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=8)
def load(path: str):
    """The tokenizer of a .json file, without truncation or padding. One thread: Spark runs as many workers as cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: White space other than the plain space, and the plain space itself: before " " each makes that cut unsafe.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_UNSAFE = [c + " " for c in _SPACES]
_SAFE_CUT = re.compile(r"(?<=\S)(?= )")


def byte_level_pieces(text: str) -> list[str]:
    """Splits before each space that follows a character which isn't white space.

    In byte-level BPE with the usual pattern, no match spans such a place, and no look-ahead or look-behind
    passes it, so the pieces' encodings joined are the encoding of the text.
    """
    if not text:
        return []
    if any(u in text for u in _UNSAFE):
        return _SAFE_CUT.split(text)
    head, *rest = text.split(" ")
    pieces = [" " + x for x in rest]
    return [head, *pieces] if head else pieces


class PieceCache:
    """Encodes pieces whose encodings may be joined; each piece goes to the library once until the cache is emptied.

    The cache is emptied when it holds `limit` pieces, so memory is bounded however long the worker lives.
    `value` makes what is kept of a piece from its list of ids.
    """

    def __init__(self, path: str, value, limit: int = 300_000, longest: int = 64):
        self.tokenizer, self.value, self.limit, self.longest, self.known = load(path), value, limit, longest, {}

    def __call__(self, pieces: list[str]) -> list:
        known = self.known
        found = list(map(known.get, pieces))
        if None in found:
            missing = list({p for p, v in zip(pieces, found, strict=True) if v is None})
            new = {}
            for k in range(0, len(missing), 4096):
                part = missing[k : k + 4096]
                new.update(zip(part, (self.value(x.ids) for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
            found = [new[p] if v is None else v for p, v in zip(pieces, found, strict=True)]
            if len(known) + len(new) > self.limit:
                known.clear()
            known.update((p, v) for p, v in new.items() if len(p) <= self.longest)
        return found


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()
