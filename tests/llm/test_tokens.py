import hashlib
import random

import numpy as np
from helpers import AWKWARD, by_id, documents, empty

from bytefleet.llm import bpe_chunks, token_counts
from bytefleet.llm.tokenizers_io import byte_level_pieces, load, packed, public_path

BYTE, WORD = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")


def noise(seed, n, alphabet="ab  \n'tés😀12.<|"):
    draw = random.Random(seed)
    return "".join(draw.choice(alphabet) for _ in range(n))


SHARED = noise(1, 16_000, "abcde fgh ijk ")
LONG = [noise(2, 20_000), noise(3, 400) + SHARED + noise(4, 500), noise(5, 900) + SHARED, "no-space" * 4000, " " * 3000 + "a", "<|endoftext|>" * 500, "é" * 9000 + " b" * 9000]


def test_encoding_equals_the_library():
    library, encoder, table = load(BYTE), bpe_chunks.ChunkEncoder(BYTE), bpe_chunks.TokenBytes(BYTE)
    for t in [x or "" for x in AWKWARD] + LONG + [noise(k, 700) for k in range(60)]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t) == packed(ids)
        assert table.decode(packed(ids)) == library.decode(ids, skip_special_tokens=False)
        assert "".join(byte_level_pieces(t)) == t
    assert encoder.reused > 0 and encoder.repaired > 0


def test_cuts_follow_the_content():
    a, b = (noise(7, 500) + SHARED).encode(), (noise(8, 333) + SHARED).encode()
    inner = {len(a) - c for c in bpe_chunks.cut_points(a)} & {len(b) - c for c in bpe_chunks.cut_points(b)}
    assert inner and all((a[c] & 0xC0) != 0x80 for c in bpe_chunks.cut_points(a))


def test_joins_that_disagree_fall_back_to_the_whole_text(monkeypatch):
    encoder = bpe_chunks.ChunkEncoder(BYTE)
    monkeypatch.setattr(encoder, "_join", lambda *a: None)
    assert encoder.encode(LONG[0]) == packed(load(BYTE).encode(LONG[0], add_special_tokens=False).ids) and encoder.whole


def test_operators_round_trip(spark):
    docs = documents(spark, AWKWARD + LONG, extra=[(3, "again"), (None, "no id")])
    rows = by_id(bpe_chunks.roundtrip(docs, BYTE))
    library = load(BYTE)
    for k, t in enumerate(AWKWARD + LONG):
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = rows[k][0]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert len(rows[3]) == 2 and len(rows[None]) == 1
    back = by_id(bpe_chunks.decode(bpe_chunks.encode(docs, BYTE), BYTE))
    assert all(back[k][0]["text"] == (t or "") for k, t in enumerate(AWKWARD + LONG))
    assert bpe_chunks.roundtrip(empty(spark), BYTE).count() == 0


def test_counts_equal_the_library(spark):
    library = load(WORD)
    texts = AWKWARD + LONG + ["Ａ́ fi ǅ" * 100]
    for chunk, overlap in ((token_counts.CHUNK, token_counts.OVERLAP), (300, 40), (64, 8)):
        rows = by_id(token_counts.token_counts(documents(spark, texts), WORD, limit=10, chunk=chunk, overlap=overlap))
        for k, t in enumerate(texts):
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (rows[k][0]["n_bytes"], rows[k][0]["n_tokens"], rows[k][0]["over_limit"]) == (len((t or "").encode()), n, n > 10)
    assert token_counts.token_counts(empty(spark), WORD).count() == 0


def test_work_stays_in_proportion_without_white_space():
    """No place is stable in a long word; what is encoded is bounded by a multiple of the text all the same."""
    library = load(WORD)
    for text in ("x" * 40_000, "漢字" * 20_000, "漢字、" * 15_000, "a1" * 20_000, "w" * 9_000 + " " + "v" * 30_000):
        r = token_counts.Resync(WORD, 500, 50)
        assert r.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        assert r.encoded < 4 * len(text), (text[:5], r.encoded / len(text))


def test_stable_places_are_token_starts():
    """Cutting at any stable place changes nothing: fuzzed over characters that could interact."""
    library, draw = load(WORD), random.Random(8)
    alphabet = "aZ9 '<|>.,;:!?、。，！？；：sStdllve\n\t\xa0\u3000\x85é́Ａ²ß漢한ㄱ\u0301İΣ😀-_"
    for k in range(3000):
        t = "".join(draw.choices(alphabet, k=draw.randint(2, 14))) + draw.choice(["", "<|endoftext|>", "'s.", "'ll9"])
        whole = library.encode(t, add_special_tokens=False).ids
        for m in token_counts._STABLE.finditer(t):
            if 0 < (at := m.start()) < len(t):
                assert library.encode(t[:at], add_special_tokens=False).ids + library.encode(t[at:], add_special_tokens=False).ids == whole, (t, at)


def test_overlaps_widen_where_nothing_is_stable():
    r = token_counts.Resync(WORD, 100, 10)
    text = "word " * 50 + "x" * 900 + " word" * 50
    assert r.count(text) == len(load(WORD).encode(text, add_special_tokens=False).ids) and r.widened
