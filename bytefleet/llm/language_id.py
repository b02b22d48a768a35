"""Language identification by segmentation-marginalised unigram models over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. A word's probability is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product over its words. Words repeat, so a
worker computes each distinct word once (within a bounded cache). The piece probabilities are fitted by
expectation-maximisation over the same lattice, on the word counts of a bounded sample of labelled documents.

Bounds: about `TRAIN_DOCS` documents of each language (by hash of their id) and `TRAIN_WORDS` distinct
words of each language (the most frequent) fit the model, one language on one executor at a time. All pieces of the vocabulary that
can match lower-cased letters take part, and words of any length. The model that is sent to the executors holds vocabulary x languages
numbers, about 180 KB a language; their number isn't limited.

Defined cases: a null text, or one without a letter, is `und` with score 0; with nothing to learn from, every
text is `und`; ties go to the language that sorts first; one row out for each row in.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytefleet.llm.common import hash_bound, map_text, slices, worker_state
from bytefleet.llm.tokenizers_io import public_path

TRAIN_DOCS, TRAIN_WORDS = 300, 60_000
ROUNDS, SMOOTH, UNKNOWN = 3, 0.05, 1e-7
_WORD = re.compile(r"[^\W\d_]+")
#: Words that a worker keeps, fewer with many languages (numbers kept); words from this length on are computed in a way that can't underflow.
_KNOWN_WORDS, _KNOWN_NUMBERS, _LONG = 500_000, 4_000_000, 40
#: More languages than this aren't broadcast when the sample is picked.
_FEW_LANGUAGES = 10_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; none if the text has no letter."""
    found = _WORD.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def vocabulary(path: str) -> list[str]:
    """The lower-case pieces of a sentencepiece file that are made of letters; a leading mark stands for a word's start."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    names = {pieces.id_to_piece(k) for k in range(pieces.vocab_size())}
    return sorted(p for p in names if (b := p.removeprefix("▁")) == b.lower() and (not b or _WORD.fullmatch(b)))


class Lattice:
    """Ids of all pieces inside words, as arrays for words of one length."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: k for k, p in enumerate(pieces)}
        self.none, self.unknown = len(pieces), len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)

    def arcs(self, words: list[str], n: int) -> np.ndarray:
        """[word, end, length - 1] -> piece id, for marked words of n characters. A single character out of the vocabulary is `unknown`."""
        find, none, longest = self.ids.get, self.none, min(self.longest, n)
        places = [(j - l, j) for j in range(1, n + 1) for l in range(1, min(j, longest) + 1)]
        flat = np.array([find(w[a:b], none) for w in words for a, b in places], np.int32).reshape(len(words), len(places))
        out = np.full((len(words), n, longest), none, np.int32)
        out[:, [b - 1 for _, b in places], [b - a - 1 for a, b in places]] = flat
        single = out[:, :, 0]
        single[single == none] = self.unknown
        return out

    def long_arcs(self, word: str) -> list[tuple[int, int, int]]:
        """(begin, end, piece id) of all pieces in one word, by end."""
        out = []
        for j in range(1, len(word) + 1):
            for l in range(1, min(j, self.longest) + 1):
                k = self.ids.get(word[j - l : j], self.unknown if l == 1 else None)
                if k is not None:
                    out.append((j - l, j, k))
        return out


def forward(arcs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """alpha[word, position, language] by summing over all segmentations up to each position."""
    count, n, longest = arcs.shape
    alpha = np.zeros((count, n + 1, table.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, n + 1):
        for l in range(1, min(j, longest) + 1):
            alpha[:, j] += alpha[:, j - l] * table[arcs[:, j - 1, l - 1]]
    return alpha


def _by_length(words: list[str], most: int = 4096):
    groups = defaultdict(list)
    for w in words:
        groups[len(w)].append(w)
    for n, group in groups.items():
        step = max(1, most * 12 // n)
        for k in range(0, len(group), step):
            yield n, group[k : k + step]


class Scorer:
    """Log-probabilities of marked words in all languages, with a bounded cache."""

    def __init__(self, pieces: list[str], table: np.ndarray, keep: int | None = None):
        languages = table.shape[1]
        self.keep = keep or max(1000, min(_KNOWN_WORDS, _KNOWN_NUMBERS // max(1, languages)))
        self.lattice, self.table, self.known = Lattice(pieces), table, {}
        self.rows, self.most = np.empty((self.keep, languages)), max(16, 4096 * 4 // max(4, languages))

    def _long(self, word: str) -> np.ndarray:
        """One long word, rescaled at each position so that nothing underflows."""
        ids, n, longest = self.lattice.ids, len(word), self.lattice.longest
        log, alpha = np.zeros(self.table.shape[1]), [np.ones(self.table.shape[1])]
        for j in range(1, n + 1):
            now = sum(alpha[-l] * self.table[ids.get(word[j - l : j], self.lattice.unknown if l == 1 else self.lattice.none)] for l in range(1, min(j, longest) + 1))
            log += np.log(now)
            alpha = [a / now for a in alpha[max(0, len(alpha) - longest + 1) :]] + [np.ones_like(now)]
        return log

    def new(self, words: list[str]) -> dict[str, np.ndarray]:
        out = {w: self._long("▁" + w) for w in words if len(w) >= _LONG}
        for n, group in _by_length(["▁" + w for w in words if len(w) < _LONG], self.most):
            out.update(zip((w[1:] for w in group), np.log(forward(self.lattice.arcs(group, n), self.table)[:, n]), strict=True))
        return out

    def score(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Summed log-probabilities of each text's words, None for a text without words."""
        known = self.known
        missing = list({w for t in texts for w in t if w not in known})
        if len(known) + len(missing) > self.keep:
            known.clear()
            missing = list({w for t in texts for w in t})
        rows = self.rows
        if len(missing) > len(rows):  # more distinct words in one slice than are kept
            rows, known = np.empty((len(missing), rows.shape[1])), {}
        for w, value in self.new(missing).items():
            rows[len(known)] = value
            known[w] = len(known)
        return [rows[np.fromiter(map(known.__getitem__, t), np.int64, len(t))].sum(0) if t else None for t in texts]


def fit(counts: list[tuple[str, str, int]], pieces: list[str], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and a table [piece, language] of probabilities, from (language, word, count) by expectation-maximisation."""
    languages, lattice = sorted({lang for lang, _, _ in counts}), Lattice(pieces)
    tables = [fit_one([(w, n) for x, w, n in counts if x == lang], lattice, rounds) for lang in languages]
    return languages, np.stack(tables, 1) if tables else np.zeros((len(pieces) + 2, 0))


def fit_one(counts: list[tuple[str, int]], lattice: Lattice, rounds: int = ROUNDS) -> np.ndarray:
    """One language's piece probabilities from (word, count)."""
    size = lattice.unknown + 1
    of = {"▁" + w: n for w, n in sorted(counts)}
    short, long_words = [w for w in of if len(w) <= _LONG], [(lattice.long_arcs(w), len(w), of[w]) for w in of if len(w) > _LONG]
    p = np.full(size, 1 / size)
    p[lattice.none] = 0
    for _ in range(rounds):
        expected = np.zeros(size)
        for n, group in _by_length(short):
            arcs, weight = lattice.arcs(group, n), np.array([of[w] for w in group], float)
            alpha = forward(arcs, p[:, None])[:, :, 0]
            beta = np.zeros((len(group), n + 1))
            beta[:, n] = 1
            for j in range(n, 0, -1):
                for l in range(1, min(j, arcs.shape[2]) + 1):
                    use = p[arcs[:, j - 1, l - 1]] * beta[:, j]
                    beta[:, j - l] += use
                    expected += np.bincount(arcs[:, j - 1, l - 1], weight * alpha[:, j - l] * use / alpha[:, n], size)
        for arcs, n, times in long_words:
            _add_expected(expected, arcs, n, times, p)
        expected[lattice.none] = 0
        p = (expected + SMOOTH) / (expected.sum() + SMOOTH * size)
        p[lattice.none] = 0
        p[lattice.unknown] = min(p[lattice.unknown], UNKNOWN)
        p /= p.sum()
    return p


def _add_expected(expected: np.ndarray, arcs: list[tuple[int, int, int]], n: int, times: int, p: np.ndarray) -> None:
    """The expected counts of one long word's pieces, in logarithms so that nothing underflows."""
    with np.errstate(divide="ignore"):
        log = np.log(p[[k for _, _, k in arcs]]).tolist()
    ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for (i, j, _), x in zip(arcs, log, strict=True):
        ahead[j] = _log_add(ahead[j], ahead[i] + x)
    for (i, j, _), x in zip(reversed(arcs), reversed(log), strict=True):
        behind[i] = _log_add(behind[i], behind[j] + x)
    for (i, j, k), x in zip(arcs, log, strict=True):
        expected[k] += times * math.exp(ahead[i] + x + behind[j] - ahead[n])


def _log_add(a: float, b: float) -> float:
    low, high = (a, b) if a < b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocab_path: str | None = None) -> tuple[list[str], list[str], np.ndarray]:
    """(pieces, languages, table) from at most TRAIN_DOCS documents of each language.

    Which documents these are is settled from ids and labels alone; only their texts are then read in full.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    share = labelled.groupBy("lang").count().collect()
    if not share:
        return [], [], np.zeros((0, 0))
    # ids hash evenly, so a threshold on the hash takes TRAIN_DOCS of n documents, give or take
    spark = docs.sparkSession
    bounds = spark.createDataFrame([(r["lang"], hash_bound(TRAIN_DOCS, r["count"])) for r in share], "of string, bound bigint")
    bounds = F.broadcast(bounds) if len(share) <= _FEW_LANGUAGES else bounds
    picked = labelled.join(bounds, (F.col("lang") == F.col("of")) & (F.xxhash64("id") <= F.col("bound"))).select("lang", "text")

    def count(batches):
        for pdf in batches:
            rows = [(lang, w) for lang, text in zip(pdf["lang"], pdf["text"], strict=True) for w in words_of(text)]
            yield pd.DataFrame(rows, columns=["lang", "word"]).groupby(["lang", "word"], as_index=False).size().rename(columns={"size": "n"})

    counted = picked.mapInPandas(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "word")  # words of the bounded sample alone
    top = counted.withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= TRAIN_WORDS)
    pieces = vocabulary(vocab_path or public_path("piece_bpe_32k.model"))

    def fitted(key, group):
        p = fit_one(list(zip(group["word"], group["n"].tolist(), strict=True)), Lattice(pieces))
        return pd.DataFrame({"lang": [key[0]], "table": [p.tobytes()]})

    rows = sorted((r["lang"], bytes(r["table"])) for r in top.groupBy("lang").applyInPandas(fitted, "lang string, table binary").collect())
    return (pieces, [lang for lang, _ in rows], np.stack([np.frombuffer(t) for _, t in rows], 1)) if rows else ([], [], np.zeros((0, 0)))


def _sent(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray]):
    """The model for the executors: vocabulary x languages numbers, so bounded."""
    pieces, _, table = model
    return docs.sparkSession.sparkContext.broadcast((pieces, table, hashlib.sha256(table.tobytes()).hexdigest()))


def _predict(texts: list[str | None], languages: list[str], sent) -> tuple[list[str], list[float]]:
    if not languages:
        return ["und"] * len(texts), [0.0] * len(texts)
    pieces, table, name = sent.value
    scorer = worker_state("language_id", name, lambda: Scorer(pieces, table))
    preds, scores = [], []
    for total in scorer.score([words_of(t) for t in texts]):
        best = None if total is None else int(np.argmax(total))
        preds.append("und" if best is None else languages[best])
        scores.append(0.0 if best is None else float(1 / np.exp(total - total[best]).sum()))
    return preds, scores


def identify(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", id_type: str = "bigint") -> DataFrame:
    """(id, lang_pred, score): the likeliest language and its posterior probability (languages equally likely before)."""
    _, languages, _ = model
    sent = _sent(docs, model)

    def each(keys, texts):
        return keys, *_predict(texts, languages, sent)

    return map_text(docs, id_col, text_col, each, f"{id_col} {id_type}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray], least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is identified with a posterior probability of `least` or more."""
    _, languages, _ = model
    sent = _sent(docs, model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index(text_col)):
                found = _predict(part.column(text_col).to_pylist(), languages, sent)
                yield part.filter(pa.array([lang != "und" and score >= least for lang, score in zip(*found, strict=True)]))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str | Column = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Documents that must not be learned from: crc32 of the id as text leaves `part` when divided by `parts`."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % parts == part, F.lit(False))
