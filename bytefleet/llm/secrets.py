"""Secret scanning: three base patterns, and spans found by character Markov models.

A token that no base pattern has claimed is a secret if the log-likelihood ratio per character of a first-order
Markov model of random strings over one of ordinary identifiers is high. Both models are trained from labelled samples: strings drawn
from the alphabets of keys, and identifiers made of ordinary words, those of a public vocabulary and the frequent ones of the whole corpus.

Defined cases: a null text counts as empty (no spans); one row out for each row in; base spans are never
removed by the models, and a model's span never overlaps a base span.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytefleet.llm.common import map_text, slices
from bytefleet.llm.tokenizers_io import load, public_path

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that the models judge: key-like characters, this long at least, with a letter among them.
TOKEN_LEAST, RATIO_LEAST = 16, 0.6
SAMPLE_STRINGS = 20_000
#: Words that are met less often, in all and for so many documents, may be pieces of secrets. The share keeps the words few, whatever the number of documents.
LEAST_TIMES, PER_DOCS = 3, 200
REDACTED = "[secret]"
_ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_OF = {c: k for k, c in enumerate(_ALPHABET)}
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % TOKEN_LEAST)
_LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
_KEY = re.compile(r"p(?:assword|asswd)|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_LETTER = re.compile(r"[A-Za-z]")
#: Fixed joins by which words become identifiers.
JOINS = ("_", "-", "", "/", "=")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind as listed."""
    found = []
    if _KEY.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    # a maximal run that is long enough: what [0-9a-f]+ gives once short runs are dropped
    found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def transitions(samples: list[str]) -> np.ndarray:
    """Log-probabilities [from, to] of a first-order model; the last `from` is a token's start. Add-one smoothing."""
    n = len(_ALPHABET)
    counts = np.ones((n + 1, n))
    for s in samples:
        last = n
        for c in s:
            if (k := _OF.get(c)) is not None:
                counts[last, k] += 1
                last = k
    return np.log(counts / counts.sum(1, keepdims=True))


def random_samples(seed: int = 7, count: int = SAMPLE_STRINGS) -> list[str]:
    """Labelled "random": keys drawn from the usual alphabets."""
    draw = random.Random(seed)
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits)
    return ["".join(draw.choices(alphabets[k % len(alphabets)], k=draw.randint(TOKEN_LEAST, 64))) for k in range(count)]


def identifier_samples(words: list[str], seed: int = 11, count: int = SAMPLE_STRINGS) -> list[str]:
    """Labelled "ordinary": words joined as identifiers, paths, numbered names and dates are; one in six in capitals, as constants are."""
    draw = random.Random(seed)
    usable = [w for w in words if w.isascii() and w.isalpha()] or list(public_words())
    out = []
    for _ in range(count):
        join = draw.choice(JOINS)
        part = [draw.choice(usable) for _ in range(draw.randint(2, 6))]
        part = [w.capitalize() for w in part] if join == "" else part
        part = [w.upper() for w in part] if draw.randrange(6) == 0 else part
        out.append(join.join(part) + draw.choice(["", "", str(draw.randint(0, 9999)), f"-{draw.randint(1990, 2030)}-{draw.randint(1, 12):02d}"]))
    return out


@lru_cache(maxsize=1)
def public_words() -> tuple[str, ...]:
    """Ordinary words: the whole words of a public vocabulary, of three to fifteen letters."""
    names = load(public_path("word_bpe_49k.json")).get_vocab()
    return tuple(sorted(w for n in names if n.endswith("</w>") and 3 <= len(w := n[:-4]) <= 15 and w.isascii() and w.isalpha()))


@lru_cache(maxsize=4)
def models(words: tuple[str, ...] = ()) -> np.ndarray:
    """The difference of both models' log-probabilities: positive where a step is likelier in a random string."""
    ordinary = identifier_samples(list(public_words())) + (identifier_samples(list(words), seed=13) if words else [])
    return transitions(random_samples()) - transitions(ordinary + list(words))


def ratio(token: str, gain: np.ndarray) -> float:
    """Log-likelihood ratio per character."""
    steps = [_OF[c] for c in token]
    return float(gain[[len(_ALPHABET), *steps[:-1]], steps].mean())


def markov_spans(text: str, base: list[tuple[int, int, str]], gain: np.ndarray) -> list[tuple[int, int, str]]:
    """Tokens that look random and touch no base span."""
    out, k, reach = [], 0, -1  # base is sorted by start; reach is the furthest end of those that start before the token's end
    for m in _TOKEN.finditer(text):
        t = m[0]
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][1])
            k += 1
        if reach <= m.start() and _LETTER.search(t) and ratio(t, gain) >= RATIO_LEAST:
            out.append((m.start(), m.end(), "markov"))
    return out


def train(docs: DataFrame, text_col: str = "text") -> tuple[str, ...]:
    """The ordinary words of all documents, most frequent first: those met LEAST_TIMES times, and so often for every PER_DOCS documents."""
    least = F.lit(LEAST_TIMES * max(docs.count(), PER_DOCS))
    words = docs.select(F.explode(F.split(F.col(text_col), r"[^A-Za-z]+")).alias("word")).filter(F.length("word").between(3, 30))
    rows = words.groupBy("word").count().filter(F.col("count") * PER_DOCS >= least).orderBy(F.desc("count"), "word").collect()
    return tuple(r["word"] for r in rows)


def _spelt(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, words: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", id_type: str = "bigint") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) of every whole text; places count code points."""

    def each(keys, texts):
        gain = models(words)
        columns: list[list] = [[] for _ in range(6)]
        for t in texts:
            base = base_spans(t or "")
            more = markov_spans(t or "", base, gain)
            kinds = [k for _, _, k in base]
            spans = sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
            for c, v in zip(columns, (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(more), hashlib.sha256(_spelt(base).encode()).hexdigest(), _spelt(spans)), strict=True):
                c.append(v)
        return keys, *columns

    return map_text(docs, id_col, text_col, each, f"{id_col} {id_type}, n_assign bigint, n_access bigint, n_hex bigint, n_markov bigint, base_sha256 string, spans string")


def redacted(docs: DataFrame, words: tuple[str, ...] = (), text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with the secrets in the text column replaced, and its length in chars_col counted anew.

    A null text stays null.
    """

    def run(batches):
        gain = models(words)
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index(text_col)):
                texts = [None if t is None else redact(t, gain) for t in part.column(text_col).to_pylist()]
                yield part.set_column(part.schema.get_field_index(text_col), text_col, pa.array(texts, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out


def redact(text: str, gain: np.ndarray) -> str:
    """The text with every span replaced by a mark; overlapping spans become one. An assignment keeps its name and sign."""
    base = base_spans(text)
    spans = [(m.start(2), m.end(2)) for m in (ASSIGN.match(text, a) for a, _, k in base if k == "assign") if m]
    spans += [(a, b) for a, b, k in base if k != "assign"] + [(a, b) for a, b, _ in markov_spans(text, base, gain)]
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], REDACTED]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text
