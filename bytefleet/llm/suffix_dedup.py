"""Repeated passages by a depth-limited radix sort of all suffixes.

Only the first DEPTH bytes of a suffix matter: a passage is repeated if the DEPTH-byte window that begins at a suffix
begins elsewhere too. The sort goes digit by digit, most significant first; groups of one drop out, groups of equals go on
to the next digit, and the groups that are left at full depth are exactly the repeated windows. So that no pass moves every
suffix, a digit isn't a byte but a string of bytes that all equal windows share, and neighbours travel together:

* Digit 1, the anchor: the GRAM-byte string inside the window with the smallest hash, the leftmost of equals. Equal windows
  have equal anchors at equal offsets, and neighbouring windows mostly share theirs. A run of windows with one anchor is one
  row (about one for 65 bytes). Rows whose anchor is met once drop out.
* Digit 2, the run: the whole run's bytes and the anchor's place in it. Runs that are met twice are settled whole.
* Digit 3, the block: what all windows share whose anchor lies in one block of BLOCK offsets (the core), and then the whole
  block. It refines single runs in groups of several; blocks with a core met once drop out, blocks met twice are settled whole.
* Digit 4, the window: all DEPTH bytes, for what is left.

This is refinement by hashed digits rather than an ordered sort: groups are what they would be after sorting by each digit, but
have no order among themselves, which nothing here needs. Digits are 64-bit hashes; groups are by the first digit and the
present one together. Windows with different anchors differ in both, those that share an anchor in one alone, and no bytes
are compared afterwards. Every pass is a count by key, combined before the shuffle, and a join back that adaptive execution
may split: no group of equal or similar passages is ever gathered in one task. A text is known by 128 bits of its own hash and not by its
row's id: copies of a text, with whatever ids or none, are cut up and listed as one, and each copy's row gets the result. Texts
are shuffled once to cut out the runs to be refined; passes are cut by checkpoints.

Defined cases: null and empty texts, and texts under DEPTH bytes, lose nothing; copies of a document, and repeated rows, lose all
that lies in full windows, so all; texts of equal bytes repeat themselves; rows without an id are judged like others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytefleet.llm.common import cut, pa_schema, slices, worker_state

DEPTH, GRAM, BLOCK = 200, 48, 16
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Windows that are looked at together; a run ends where a stretch does, which the later digits make good.
_STRETCH_BITS = 18
#: Bytes that a worker hashes at a time.
SLICE = 1 << _STRETCH_BITS


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return worker_state("suffix_dedup", _STRETCH_BITS, _make_tables)


def _make_tables(size: int = (1 << _STRETCH_BITS) + (1 << 16)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, _U), np.full(size, pow(_BASE, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    of_byte = np.random.default_rng(20260102).integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
    return of_byte, np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hashes:
    """Hashes of any substrings of a byte string, from prefix sums."""

    def __init__(self, raw: np.ndarray):
        of_byte, self.up, down = _tables()
        self.sums = np.zeros(len(raw) + 1, _U)
        np.cumsum(of_byte[raw] * down[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        salted = np.asarray(salt).astype(_U) * _U(0xD6E8FEB86659FD93) + (end - start).astype(_U)
        return _mix(_mix((self.sums[end] - self.sums[start]) * self.up[start]) + salted)


def runs(raw: np.ndarray, depth: int = DEPTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(first digit, second digit, start of the first window, number of windows, anchor) of the runs of each stretch."""
    width, most = depth - gram + 1, 1 << _STRETCH_BITS
    low = _U((1 << 22) - 1)
    for begin in range(0, len(raw) - depth + 1, most):
        part = raw[begin : begin + most + depth - 1]
        hashes = Hashes(part)
        starts = np.arange(len(part) - gram + 1)
        grams = hashes.of(starts, starts + gram)
        least, size = (grams & ~low) | starts.astype(_U), 1  # equal upper bits: the leftmost is the least
        while size * 2 <= width:
            least, size = np.minimum(least[:-size], least[size:]), size * 2
        if size < width:
            least = np.minimum(least[: size - width], least[width - size :])
        anchor = (least & low).astype(np.int64)  # of the window that starts at each place
        first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        count = np.diff(np.append(first, len(anchor)))
        at = anchor[first]
        yield grams[at].view(np.int64), hashes.of(first, first + count + depth - 1, at - first).view(np.int64), first + begin, count, at + begin


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint runs [start, end) that cover the same bytes; touching spans become one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack([spans[new, 0], reach[last]], 1)


def without(data: bytes, spans: np.ndarray) -> bytes:
    return b"".join(data[a:b] for a, b in zip(np.append(0, spans[:, 1]).tolist(), np.append(spans[:, 0], len(data)).tolist(), strict=True))


def _arrow(df: DataFrame, *steps: tuple) -> DataFrame:
    """Maps batches through steps (schema, rows, text), one after the other in one worker: `rows` makes the schema's columns of a slice
    of about SLICE bytes in column `text`."""
    typed = [(pa_schema(schema), rows, text) for schema, rows, text in steps]

    def run(batches):
        for out, rows, text in typed:
            batches = _mapped(batches, out, rows, text)
        return batches

    return df.mapInArrow(run, steps[-1][0])


def _mapped(batches: Iterator[pa.RecordBatch], out: pa.Schema, rows, text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text, SLICE):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(rows(part), out, strict=True)], schema=out)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, places): value k of a string or binary column is bytes[places[k]:places[k + 1]]; nulls are empty."""
    places = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[places[0] : places[-1]], places - places[0]


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all elements, places): list k holds elements[places[k]:places[k + 1]]; nulls are empty."""
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes)])


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place in its owner) of each of so many items of each owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _join_parts(parts: list[tuple[np.ndarray, ...]], width: int) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * width


def _identity(text: str | None) -> tuple[int, int]:
    """128 bits that tell a text from all others, as two signed numbers."""
    high, low = np.frombuffer(xxhash.xxh3_128_digest((text or "").encode()), ">i8").tolist()
    return high, low


def _identities(texts: list[str | None]) -> tuple[list[int], list[int]]:
    found = [_identity(t) for t in texts]
    return [h for h, _ in found], [t for _, t in found]


def _place(start: np.ndarray, offset: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A run's first window, the anchor's place in that, and the number of windows, as one number."""
    return start.astype(np.int64) << 32 | offset.astype(np.int64) << 16 | windows.astype(np.int64)


def _unplace(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 32, place >> 16 & 0xFFFF, place & 0xFFFF


def _pass(rows: DataFrame, group: list[str], digit: str) -> DataFrame:
    """One pass: the rows that are left, refined from `group` by `digit`, with their standing.

    settled: the same digit is met twice. open: to be refined further, because the group has several digits and one of them is met
    once; of equal rows, those of one text (the smallest rid) take part. alone: the digit is met once.
    Rows that are neither drop out.
    """
    groups = cut(rows.groupBy(*group, digit).agg(F.count("*").alias("n"), F.min("rid").alias("first")))
    mixed = cut(groups.groupBy(*group).agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select(*group, F.lit(True).alias("mixed")))
    status = cut(groups.join(mixed, group, "left").filter("n > 1 or mixed"))
    marked = rows.join(status, [*group, digit]).withColumn("settled", F.col("n") > 1).withColumn("open", F.coalesce("mixed", F.lit(False)) & (F.col("rid") == F.col("first")))
    return marked.withColumn("once", F.col("n") == 1).drop("n", "mixed", "first", digit)


def _by_runs(texts: DataFrame, depth: int, gram: int) -> DataFrame:
    """Digits 1 and 2: (rid, th, text, settled, open) of the texts that have any repeated run or one to refine, each once."""

    def cut_runs(part):
        found = []
        for text in part.column(1).to_pylist():
            rid, th = _identity(text)
            for d1, d2, start, count, anchor in runs(np.frombuffer((text or "").encode(), np.uint8), depth, gram):
                found.append((d1, d2, np.full(len(d1), rid), np.full(len(d1), th), _place(start, anchor - start, count)))
        return _join_parts(found, 5)

    rows = _arrow(texts, ("d1 bigint, d2 bigint, rid bigint, th bigint, place bigint", cut_runs, 1))
    anchors = cut(rows.groupBy("d1").agg(F.count("*").alias("n")).filter("n > 1").select("d1"))
    marked = _pass(cut(rows.join(anchors, "d1", "left_semi")), ["d1"], "d2")
    to_refine = F.when(F.col("open"), F.struct("d1", F.col("once").alias("alone"), "place"))
    # sets, so that the many copies of a text add nothing to its one list, before the shuffle as after it
    listed = marked.groupBy("rid", "th").agg(F.collect_set(F.when(F.col("settled"), F.col("place"))).alias("settled"), F.collect_set(to_refine).alias("open"))
    identified = _arrow(texts, ("rid bigint, th bigint, text string", lambda part: (*_identities(part.column(1).to_pylist()), part.column(1)), 1))
    return cut(identified.groupBy("rid", "th").agg(F.first("text").alias("text")).join(listed, ["rid", "th"]))


def _pieces(depth: int) -> tuple:
    """The step from texts with their open runs to the bytes of the runs to refine."""

    def cut_out(part):
        data, texts = _bytes(part.column(2))
        found, places = _lists(part.column(3))
        owner = np.repeat(np.arange(part.num_rows), np.diff(places))
        place = np.asarray(found.field("place"))
        start, _, windows = _unplace(place)
        sizes = windows + depth - 1
        run, at = _spread(sizes)
        raw = data[(texts[owner] + start)[run] + at]
        cuts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        pieces = pa.Array.from_buffers(pa.binary(), len(sizes), [None, cuts.buffers()[1], pa.py_buffer(raw.tobytes())])
        return found.field("d1"), np.asarray(part.column(0))[owner], np.asarray(part.column(1))[owner], place, found.field("alone"), pieces

    return "d1 bigint, rid bigint, th bigint, place bigint, alone boolean, bytes binary", cut_out, 2


def _by_blocks(work: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Digit 3: (rid, th, place) of blocks of single runs that are settled, and (d1, rid, th, alone, starts, digits) of the windows that go on."""
    size = min(BLOCK, depth)  # so that a block's windows have a core
    open_texts = work.filter(F.size("open") > 0).select("rid", "th", "text", "open")

    def blocks_of(part):
        data, places = _bytes(part.column(5))
        start, offset, windows = _unplace(np.asarray(part.column(3)))
        first, last = (offset - windows + 1) // size, offset // size
        run, k = _spread(last - first + 1)
        block = first[run] + k
        begin, at = offset[run] - size * block, places[run]  # of the window whose anchor has the block's first offset
        hashes = Hashes(data)
        core = hashes.of(at + np.maximum(begin, 0), np.minimum(at + begin - size + 1 + depth, places[run + 1]), block + 1)
        # the block's windows in this run, and all their bytes: equal ones have equal windows at equal offsets
        low, high = np.maximum(begin - size + 1, 0), np.minimum(begin, windows[run] - 1)
        whole = hashes.of(at + low, at + high + depth, (offset[run] - low) << 8 | (high - low + 1))
        own = _place(start[run] + low, np.zeros(len(run), np.int64), high - low + 1)
        return np.asarray(part.column(0))[run], core.view(np.int64), whole.view(np.int64), *(np.asarray(part.column(c))[run] for c in (1, 2, 3)), block, part.column(4).take(pa.array(run)), own

    schema = "d1 bigint, core bigint, whole bigint, rid bigint, th bigint, place bigint, block bigint, alone boolean, own bigint"
    marked = cut(_pass(_arrow(open_texts, _pieces(depth), (schema, blocks_of, 5)), ["d1", "core"], "whole").filter("(settled and alone) or open"))
    settled = marked.filter("settled and alone").select("rid", "th", F.col("own").alias("place"))
    hit = marked.filter("open").groupBy("rid", "th", "place", (F.col("alone") & F.col("once")).alias("wanted")).agg(F.collect_set("block").alias("blocks"))

    def windows_of(part):
        data, places = _bytes(part.column(5))
        start, offset, windows = _unplace(np.asarray(part.column(3)))
        hit_blocks, hit_places = _lists(part.column(6))
        wanted = np.repeat(np.arange(len(start)), np.diff(hit_places)) << 20 | np.asarray(hit_blocks)
        run, at = _spread(windows)
        kept = np.isin(run << 20 | (offset[run] - at) // size, wanted)
        run, at = run[kept], at[kept]
        digits = Hashes(data).of(places[run] + at, places[run] + at + depth, offset[run] - at + 1).view(np.int64)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(run, minlength=len(start)))]).astype(np.int32))
        lists = pa.ListArray.from_arrays(ends, pa.array((start[run] + at).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(digits))
        return part.column(0), part.column(1), part.column(2), part.column(4), *lists

    joined = _arrow(open_texts, _pieces(depth)).drop("alone").join(hit, ["rid", "th", "place"]).select("d1", "rid", "th", "place", F.col("wanted").alias("alone"), "bytes", "blocks")
    return settled, cut(_arrow(joined, ("d1 bigint, rid bigint, th bigint, alone boolean, starts array<int>, digits array<bigint>", windows_of, 5)))


def _by_windows(packed: DataFrame) -> DataFrame:
    """Digit 4: (rid, th, place) of the windows in single runs that are met twice."""
    twice = cut(
        packed.select("d1", "alone", F.explode("digits").alias("d4")).groupBy("d1", "d4").agg(F.count("*").alias("n"), F.max("alone").alias("alone")).filter("n > 1 and alone").select("d1", "d4")
    )
    spread = packed.filter("alone").select("d1", "rid", "th", F.explode(F.arrays_zip("starts", "digits")).alias("w")).select("d1", F.col("w.digits").alias("d4"), "rid", "th", F.col("w.starts").cast("bigint").alias("start"))
    return spread.join(twice, ["d1", "d4"], "left_semi").select("rid", "th", (F.shiftleft("start", 32) + 1).alias("place"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(base, found): base has (id, rid, th, n_bytes, sha256) for each row; found has (rid, th, text, settled, more), once for each text with
    repeats: places of settled runs, and of further blocks and windows. rid and th are the two halves of a text's hash."""
    if not 0 < gram <= depth or depth >= 1 << 16:
        raise ValueError("the anchor lies inside the window, the window under 65,536 bytes")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def describe(part):
        data = [(t or "").encode() for t in part.column(1).to_pylist()]
        return part.column(0), *_identities([t.decode() for t in data]), [len(t) for t in data], [hashlib.sha256(t).hexdigest() for t in data]

    work = _by_runs(texts.filter(F.octet_length("text") >= depth), depth, gram)
    settled, packed = _by_blocks(work, depth)
    more = cut(settled.unionAll(_by_windows(packed)).groupBy("rid", "th").agg(F.collect_list("place").alias("more")))
    del settled, packed
    base = _arrow(texts, ("id bigint, rid bigint, th bigint, n_bytes bigint, sha256 string", describe, 1))
    return base, work.drop("open").join(more, ["rid", "th"], "left")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row: every byte in a repeated window is removed."""
    base, found = repeated_passages(docs, id_col, text_col, depth, gram)

    def removed(part):
        data, texts = _bytes(part.column(2))
        (first, ends), (second, more) = _lists(part.column(3)), _lists(part.column(4))
        first, second = np.asarray(first, np.int64), np.asarray(second, np.int64)
        out = []
        for k in range(part.num_rows):
            start, _, windows = _unplace(np.concatenate([first[ends[k] : ends[k + 1]], second[more[k] : more[k + 1]]]))
            spans = merged(np.stack([start, start + windows + depth - 1], 1))
            out.append((int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(without(data[texts[k] : texts[k + 1]].tobytes(), spans)).hexdigest()))
        return part.column(0), part.column(1), *([list(c) for c in zip(*out, strict=True)] if out else [[], [], []])

    cut_down = cut(_arrow(found, ("rid bigint, th bigint, n_removed bigint, n_spans bigint, kept_sha256 string", removed, 2)))
    return base.join(cut_down, ["rid", "th"], "left").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256")
    )
