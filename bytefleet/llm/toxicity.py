"""Toxicity by weak supervision.

Many voters look at a text: a fixed list of insults, a lexicon of words and word beginnings (met once, twice or three times) mined
from labelled rows, and patterns. A generative label model explains their votes by a hidden class of each row: voters that move
together within the classes form cliques, and the number of votes in a clique has a rate under either class. Rates,
correlations and classes are estimated from the votes alone by expectation-maximisation; labels come in twice, before (what
words are worth a voter) and after (which of the two classes is called toxic). A linear classifier is trained on the posterior labels.
Scores need the text alone.

Bounds: voters are mined and the models fitted on about TRAIN_ROWS labelled rows of each class (those with the
smallest hash of their id), at most VOTERS mined voters. All rows are scored, whole.

Defined cases: null and empty texts get the score of a text on which no voter votes; with no labelled rows of
both classes, all scores are 0; repeated labels of one document count each; one row out for each row in.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Set

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytefleet.llm.common import hashed_share, map_text, worker_state

TRAIN_ROWS, VOTERS, LEAST_DOCS, LEAST_LIFT, THRESHOLD, CORRELATED = 3000, 400, 3, 8.0, 0.7, 0.3
#: Votes in a clique that are told apart; pseudo-counts of rates; rounds of expectation-maximisation, the first of them without cliques.
MOST_VOTES, PRIOR_COUNT, ROUNDS, ROUNDS_ALONE = 6, 0.5, 5, 1
#: The hash picks about 2 x TRAIN_ROWS rows; where many labels share an id, the sample still ends here.
SAMPLE_BOUND = 4 * TRAIN_ROWS
BEGINNINGS, TIMES = (4, 5, 6, 7, 8), (1, 2, 3)
_WORD = re.compile(r"[^\W\d_]+")
# Common English insults, as a voter of its own.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting scum trash clown fool jerk bastard filth vermin hateful".split())
PATTERNS = ("insult", "address", "shout", "repeat")
_ADDRESS = re.compile(r"\b(?:you|your|you're|ur)\b[^.!?]{0,20}\b(?:" + "|".join(sorted(INSULTS)) + r")\b")
_REPEAT = re.compile(r"[!?]{3,}")
_KNOWN_WORDS = 400_000


def features(word: str) -> list[str]:
    """What mined voters look at: the word, and its beginnings."""
    return ["=" + word, *(word[:k] + "*" for k in BEGINNINGS if len(word) >= k)]


def traits(text: str | None) -> list[str]:
    """All that a text could be mined for: its features, and with a number those that it has so many times."""
    times: Counter = Counter()
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        for f in features(w):
            times[f] += n
    return [f if k == 1 else f"{f}{k}" for f, n in times.items() for k in TIMES if n >= k]


def patterns(lowered: str, words: Set[str]) -> list[str]:
    """Names of the fixed voters that vote for toxic."""
    found = []
    if not INSULTS.isdisjoint(words):
        found.append("insult")
        if _ADDRESS.search(lowered):
            found.append("address")
    if lowered.count("!") * 40 > len(words) + 40:
        found.append("shout")
    if _REPEAT.search(lowered):
        found.append("repeat")
    return found


class Voters:
    """Votes of all voters on a text; a word's voters are looked up once."""

    def __init__(self, mined: list[str]):
        self.names = [*PATTERNS, *mined]
        self.index = {n: k for k, n in enumerate(self.names)}
        # a feature's voters, with the times that each of them asks for; words have no digits
        self.asked: dict[str, list[tuple[int, int]]] = {}
        for n in mined:
            base, times = (n[:-1], int(n[-1])) if n[-1].isdigit() else (n, 1)
            self.asked.setdefault(base, []).append((times, self.index[n]))
        self.known: dict[str, tuple] = {}

    def fired(self, text: str | None) -> list[int]:
        lowered = (text or "").lower()
        words, known = Counter(_WORD.findall(lowered)), self.known
        found = {self.index[n] for n in patterns(lowered, words.keys())}
        times: dict[str, int] = {}
        for w, n in words.items():
            hit = known.get(w)
            if hit is None:
                hit = tuple(f for f in features(w) if f in self.asked)
                if len(known) >= _KNOWN_WORDS:
                    known.clear()
                if len(w) <= 64:
                    known[w] = hit
            for f in hit:
                times[f] = times.get(f, 0) + n
        for f, n in times.items():
            found.update(k for least, k in self.asked[f] if n >= least)
        return sorted(found)


def states(votes: np.ndarray, cliques: list[list[int]]) -> np.ndarray:
    """[row, clique]: how many of a clique's voters vote, up to MOST_VOTES."""
    return np.stack([np.minimum(votes[:, c].sum(1), MOST_VOTES) for c in cliques], 1).astype(int)


def expectation(state: np.ndarray, post: np.ndarray) -> np.ndarray:
    """One round: rates of each clique's states under both classes from `post`, and the posteriors that these rates give."""
    prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
    odds = np.full(len(state), np.log(prior / (1 - prior)))
    for column in state.T:
        one, two = (np.bincount(column, w, int(column.max()) + 1) + PRIOR_COUNT for w in (post, 1 - post))
        odds += (np.log(one / one.sum()) - np.log(two / two.sum()))[column]
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def correlated(votes: np.ndarray, post: np.ndarray) -> list[list[int]]:
    """Cliques of voters: the connected sets of those whose votes correlate by CORRELATED or more within the classes."""
    v = votes.astype(float)
    rate1, rate0 = (post @ v) / max(post.sum(), 1e-9), ((1 - post) @ v) / max((1 - post).sum(), 1e-9)
    left = v - (post[:, None] * rate1 + (1 - post)[:, None] * rate0)
    scale = left.std(0) + 1e-6
    near = np.abs((left.T @ left) / max(len(v), 1) / np.outer(scale, scale)) >= CORRELATED
    lead = np.arange(len(near))
    for k in range(len(near)):
        mine = np.flatnonzero(near[k, : k + 1] | (np.arange(k + 1) == k))
        lead[np.isin(lead, lead[mine])] = lead[mine].min()
    return [np.flatnonzero(lead == k).tolist() for k in np.unique(lead)]


def label_model(votes: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """(posterior of the class with more votes for each row, cliques), from votes [row, voter] in {0, 1} alone.

    It starts from how many voters vote on a row against the average row, then the rows' classes and the cliques' rates explain each other.
    """
    count = votes.sum(1).astype(float)
    post = np.clip(count**2 / (count**2 + max(count.mean(), 1e-9) ** 2), 0.05, 0.95)
    cliques = [[k] for k in range(votes.shape[1])]
    for k in range(ROUNDS):
        if k >= ROUNDS_ALONE:
            cliques = correlated(votes, post)
        post = expectation(states(votes, cliques), post)
    return post, cliques


def linear_classifier(votes: np.ndarray, target: np.ndarray, steps: int = 400, ridge: float = 3e-4) -> tuple[np.ndarray, float]:
    """Logistic regression (weights, bias) on soft labels with classes balanced, by Adam; the same input gives the same model."""
    x, n = votes.astype(float), len(votes)
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    weight = (target / share + (1 - target) / (1 - share)) / (2 * n)
    theta, m, s = np.zeros(x.shape[1] + 1), 0.0, 0.0
    for k in range(1, steps + 1):
        z = np.clip(x @ theta[:-1] + theta[-1], -30, 30)
        err = weight * (1 / (1 + np.exp(-z)) - target)
        g = np.concatenate([x.T @ err + ridge * theta[:-1], [err.sum()]])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        theta -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], np.ndarray, float] | None:
    """(voters' names, weights, bias), or None if there are not both classes. `labels` has the rows that may be learned from."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    picked = F.lit(False)
    for y, n in sorted(sizes.items()):
        picked = picked | ((F.col("y") == y) & (hashed_share("id", TRAIN_ROWS, n)))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known.filter(picked).limit(SAMPLE_BOUND)), "id").select("text", "y")

    def mine(batches):
        for pdf in batches:
            rows = [(f, y) for t, y in zip(pdf["text"], pdf["y"], strict=True) for f in traits(t)]
            frame = pd.DataFrame(rows, columns=["feature", "y"])
            yield frame.groupby("feature", as_index=False)["y"].agg(pos="sum", n="count")[["feature", "pos", "n"]]

    counted = sample.mapInPandas(mine, "feature string, pos bigint, n bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), (F.sum("n") - F.sum("pos")).alias("neg"))
    pos, neg = (min(sizes[y], TRAIN_ROWS) for y in (1, 0))
    lift = (F.col("pos") / pos) / ((F.col("neg") + 0.5) / neg)
    best = counted.filter((F.col("pos") >= LEAST_DOCS) & (lift >= LEAST_LIFT)).orderBy(F.desc(F.log(lift) * F.sqrt("pos")), "feature").limit(VOTERS)
    voters = Voters([r["feature"] for r in best.collect()])

    def vote(batches):
        mine = Voters(voters.names[len(PATTERNS) :])
        for pdf in batches:
            yield pd.DataFrame({"fired": [mine.fired(t) for t in pdf["text"]], "y": pdf["y"]})

    rows = sorted((r["y"], tuple(r["fired"])) for r in sample.mapInPandas(vote, "fired array<int>, y int").limit(SAMPLE_BOUND).collect())
    votes = np.zeros((len(rows), len(voters.names)), bool)
    for k, (_, fired) in enumerate(rows):
        votes[k, list(fired)] = True
    if not len(rows):
        return None
    post, _ = label_model(votes)
    y = np.array([y for y, _ in rows], float)
    if (post * y).sum() / max(post.sum(), 1e-9) < ((1 - post) * y).sum() / max((1 - post).sum(), 1e-9):
        post = 1 - post  # the other class has more of the toxic rows
    weights, bias = linear_classifier(votes, post)
    return voters.names, weights, bias


def score(docs: DataFrame, model: tuple[list[str], np.ndarray, float] | None, id_col: str = "doc_id", text_col: str = "text", id_type: str = "bigint") -> DataFrame:
    """(id, score, predicted) of every whole text."""

    def each(keys, texts):
        if model is None:
            return keys, [0.0] * len(keys), [0] * len(keys)
        names, weights, bias = model
        voters = worker_state("toxicity", weights.tobytes(), lambda: Voters(names[len(PATTERNS) :]))
        scores = [float(1 / (1 + np.exp(-np.clip(sum(weights[k] for k in voters.fired(t)) + bias, -30, 30)))) for t in texts]
        return keys, scores, [int(s >= THRESHOLD) for s in scores]

    return map_text(docs, id_col, text_col, each, f"{id_col} {id_type}, score double, predicted int")
