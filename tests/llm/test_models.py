import random

import numpy as np
import pytest
from helpers import AWKWARD, by_id, documents, empty

from bytefleet.llm import language_id, secrets, toxicity

WORDS = {"en": "the of and to in that with for was from house river stone bread", "de": "der die und zu das nicht ist haus fluss stein brot über", "fr": "le la de et les des une dans maison rivière pierre pain"}


def written(lang, k, n=40):
    draw = random.Random(f"{lang}{k}")
    return " ".join(draw.choices(WORDS[lang].split(), k=n))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(k, written(lang, k), lang) for k, lang in enumerate(list(WORDS) * 40)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language_on_held_out_documents(spark, labelled):
    held = language_id.held_out()
    model = language_id.train(labelled.filter(~held))
    rows = language_id.identify(labelled, model).join(labelled, "doc_id").filter(held).collect()
    assert len(rows) > 10 and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in rows)
    odd = by_id(language_id.identify(documents(spark, AWKWARD + ["x" * 60, "123 !?", "²½"]), model))
    for k in (0, 1, 2, 3, 7, len(AWKWARD) + 1, len(AWKWARD) + 2):
        assert (odd[k][0]["lang_pred"], odd[k][0]["score"]) == ("und", 0.0)
    assert odd[len(AWKWARD)][0]["lang_pred"] in WORDS and odd[9][0]["score"] == odd[10][0]["score"]
    kept = language_id.keep_identified(documents(spark, AWKWARD), model, 0.0)
    assert kept.columns == documents(spark, AWKWARD).columns and kept.filter("doc_id in (0, 1, 2, 3, 7)").count() == 0


def test_language_without_anything_to_learn_from(spark):
    docs = documents(spark, ["some text", None])
    model = language_id.train(docs.filter("lang = 'none'"))
    assert {r["lang_pred"] for r in language_id.identify(docs, model).collect()} == {"und"}
    assert language_id.identify(empty(spark), model).count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "ab", "b", "▁ab"]
    table = np.array([[0.1], [0.2], [0.3], [0.05], [0.15], [0.07], [0.0], [0.01]])

    def brute(rest):
        if not rest:
            return 1.0
        total = 0.0
        for n in range(1, len(rest) + 1):
            head = rest[:n]
            p = table[pieces.index(head), 0] if head in pieces else 0.01 if n == 1 else 0.0
            total += p * brute(rest[n:])
        return total

    scorer = language_id.Scorer(pieces, table, keep=3)
    for words in (["ab", "aab", "b", "zab"], ["ba"], ["abab", "b"]):
        assert np.allclose(scorer.score([words])[0], sum(np.log(brute("▁" + w)) for w in words))
    long = "ab" * 40
    assert np.allclose(scorer.new([long])[long], scorer._long("▁" + long)) and np.isfinite(scorer.new([long])[long]).all()


def test_fit_raises_the_likelihood():
    counts = [("xx", w, n) for w, n in (("abab", 5), ("ab", 9), ("ba", 1))]
    pieces = ["▁", "a", "b", "ab", "▁ab"]
    last = -np.inf
    for rounds in (1, 2, 4, 8):
        languages, table = language_id.fit(counts, pieces, rounds)
        value = sum(n * language_id.Scorer(pieces, table).score([[w]])[0][0] for _, w, n in counts)
        assert languages == ["xx"] and value >= last - 0.05
        last = value
        assert abs(table.sum() - 1) < 1e-6


@pytest.fixture(scope="module")
def toxic_rows(spark):
    draw, rows = random.Random(5), []
    for k in range(600):
        words, y = draw.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=60), int(k % 5 == 0)
        if y:
            words[draw.randrange(60)] = draw.choice(["idiot", "moron"]) if k % 2 else "grumb" + draw.choice(["a", "el", "ish", "on"])
        rows.append((k, " ".join(words), y))
    return spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")


def test_toxicity_on_held_out_documents(spark, toxic_rows):
    held = language_id.held_out(parts=3, part=1)
    model = toxicity.train(toxic_rows, toxic_rows.filter(~held))
    rows = toxicity.score(toxic_rows, model).join(toxic_rows.select("doc_id", "toxic"), "doc_id").filter(held).collect()
    assert all(r["predicted"] == r["toxic"] and 0 <= r["score"] <= 1 for r in rows)
    odd = by_id(toxicity.score(documents(spark, AWKWARD), model))
    assert {r["score"] for k in (0, 1, 2, 3) for r in odd[k]} == {odd[0][0]["score"]} and odd[0][0]["predicted"] == 0
    assert {r["score"] for r in toxicity.score(toxic_rows, toxicity.train(toxic_rows, toxic_rows.filter("toxic = 0"))).collect()} == {0.0}
    assert toxicity.score(empty(spark), model).count() == 0


def _likelihood(state, post):
    """Mean log-likelihood of the votes under the rates that `post` gives, by plain sums (rates without pseudo-counts)."""
    total = 0.0
    for row in state:
        both = []
        for w in (post, 1 - post):
            p = w.mean()
            for k, x in enumerate(row):
                p *= sum(v for v, r in zip(w, state, strict=True) if r[k] == x) / w.sum()
            both.append(p)
        total += np.log(sum(both))
    return total


def test_long_words_take_part_in_the_fit():
    """Expected counts of long words in logarithms equal those of the plain recursion, and every length of piece is used."""
    pieces = ["▁", "a", "b", "ab", "▁ab", "abababababababab"]
    lattice = language_id.Lattice(pieces)
    assert lattice.longest == 16
    word, p = "▁" + "ab" * 24, np.array([0.1, 0.2, 0.2, 0.2, 0.1, 0.1, 0.0, 0.1])
    expected = np.zeros(len(p))
    language_id._add_expected(expected, lattice.long_arcs(word), len(word), 3, p)
    arcs = lattice.arcs([word], len(word))
    alpha = language_id.forward(arcs, p[:, None])[0, :, 0]
    back = np.zeros(len(word) + 1)
    back[len(word)] = 1
    want = np.zeros(len(p))
    for j in range(len(word), 0, -1):
        for l in range(1, min(j, 16) + 1):
            k = arcs[0, j - 1, l - 1]
            back[j - l] += p[k] * back[j]
            want[k] += 3 * alpha[j - l] * p[k] * back[j] / alpha[len(word)]
    assert np.allclose(expected, want) and expected[5] > 0
    _, table = language_id.fit([("x", "ab" * 300, 2), ("x", "ba", 1)], pieces)
    assert np.isfinite(table).all() and abs(table.sum() - 1) < 1e-9 and table[5, 0] > table[1, 0]


def test_any_number_of_languages(spark):
    rows = [(k * 10 + j, f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + k % 7)} " * 6, f"l{k:03d}") for k in range(80) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(docs)
    assert len(model[1]) == 80 and model[2].shape[1] == 80
    hits = language_id.identify(docs, model).join(docs, "doc_id").filter("lang = lang_pred").count()
    assert hits == len(rows)


def test_label_model_round_equals_bayes_by_enumeration(monkeypatch):
    """The posterior of each row is the prior times all cliques' rates, divided by the sum over both classes; likelihood never falls."""
    monkeypatch.setattr(toxicity, "PRIOR_COUNT", 1e-12)
    draw = np.random.default_rng(6)
    y = draw.random(30) < 0.4
    votes = draw.random((30, 5)) < np.where(y[:, None], 0.7, 0.2)
    votes[:, 4] = votes[:, 3]
    state = toxicity.states(votes, [[0], [1, 2], [3, 4]])
    assert state.tolist() == [[int(v[0]), int(v[1]) + int(v[2]), 2 * int(v[3])] for v in votes]
    post, last = np.clip(votes.mean(1), 0.1, 0.9), -np.inf
    for _ in range(6):
        want = []
        for row in state:
            one, two = post.mean(), 1 - post.mean()
            for k, x in enumerate(row):
                same = state[:, k] == x
                one, two = one * post[same].sum() / post.sum(), two * (1 - post)[same].sum() / (1 - post).sum()
            want.append(one / (one + two))
        now = _likelihood(state, post)
        assert now >= last - 1e-9
        last, post = now, toxicity.expectation(state, post)
        assert np.allclose(post, want)


def test_label_model_needs_no_labels():
    """Copies of one voter are one clique and don't outvote others; the classes come from the votes alone."""
    draw = np.random.default_rng(3)
    y = draw.random(800) < 0.3
    good = draw.random((800, 12)) < np.where(y[:, None], 0.75, 0.05)
    noisy = np.repeat(draw.random((800, 1)) < 0.3, 3, 1)
    post, cliques = toxicity.label_model(np.hstack([good, noisy]))
    assert [12, 13, 14] in cliques and ((post > 0.5) == y).mean() > 0.97


def brute_spans(text):
    import regex

    found = []
    for kind, pattern, least, group, flags in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, regex.I | regex.A), ("access", r"AKIA[A-Z0-9]+", 20, 0, 0), ("hex", r"[0-9a-f]+", 24, 0, 0)):
        found += [(m.start(), m.end(), kind) for m in regex.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(found, key=lambda x: (x[0], secrets.KINDS.index(x[2]), x[1]))


KEY = "q7Zp4XvK9sTf2LbW8nRy3JmC6d"
CASES = ["password = hunter22 and PASSWD:'abcdef1'", "api_key=short token=toolong1 secret : x", "apikey=" + "a" * 40, "AKIA" + "B" * 16 + " AKIAshort", "0123456789abcdef" * 3 + "F" + "0" * 23, "token=" + "ab12" * 10, "éé secret=abcdef9 ſecret=abcdef9", f"look {KEY} here", "the_quick_brown_fox_jumps_2024-01-02", "passwordpassword=abcdef"]


def test_secret_spans(spark):
    docs = documents(spark, CASES + AWKWARD)
    rows = by_id(secrets.scan(docs, secrets.train(docs)))
    for k, t in enumerate(CASES + AWKWARD):
        base = brute_spans(t or "")
        r = rows[k][0]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[2] == kind for x in base) for kind in secrets.KINDS[:3])
        spelt = [f"{kind}:{a}:{b}" for a, b, kind in base]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("markov")] == spelt
    assert rows[7][0]["spans"] == f"markov:5:{5 + len(KEY)}" and rows[8][0]["spans"] == ""
    assert secrets.scan(empty(spark)).count() == 0


def test_planted_keys_are_found_and_identifiers_left(spark):
    """Keys of six alphabets and identifiers of words that no model has seen, each planted in prose of its own."""
    import string

    draw = random.Random(21)
    alphabets = {"mixed": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "url": string.ascii_letters + string.digits + "_-", "capitals": string.ascii_uppercase + string.digits, "small": string.ascii_lowercase + string.digits, "letters": string.ascii_letters}
    unseen = "zuverlig mantobel quirante folasure wendrick osterval brimlade kastorin pelluvar drastomi".split()
    planted = [(name, "".join(draw.choices(a, k=draw.randint(20, 48)))) for name, a in alphabets.items() for _ in range(60)]
    planted += [("plain", i) for i in secrets.identifier_samples(unseen, seed=22, count=500) if len(i) >= secrets.TOKEN_LEAST]
    docs = spark.createDataFrame([(k, f"we saw {draw.choice(unseen)} and then ({token}) was there, {draw.choice(unseen)}") for k, (_, token) in enumerate(planted)], "doc_id bigint, text string")
    rows, caught = by_id(secrets.scan(docs)), {}
    for k, (name, token) in enumerate(planted):
        hit = any(x for x in rows[k][0]["spans"].split(",") if x and int(x.split(":")[2]) - int(x.split(":")[1]) >= len(token) * 0.9)
        caught.setdefault(name, []).append(hit)
    assert all(np.mean(caught[name]) >= 0.95 for name in alphabets), {n: np.mean(c) for n, c in caught.items()}
    assert np.mean(caught["plain"]) <= 0.01


def test_models_tell_random_strings_from_identifiers():
    gain = secrets.models()
    fresh = secrets.random_samples(seed=99, count=400)
    plain = secrets.identifier_samples(["request", "handler", "number", "window", "button"], seed=98, count=400)
    caught = np.mean([secrets.ratio(s, gain) >= secrets.RATIO_LEAST for s in fresh])
    wrong = np.mean([secrets.ratio(s, gain) >= secrets.RATIO_LEAST for s in plain if len(s) >= secrets.TOKEN_LEAST and set(s) <= set(secrets._ALPHABET)])
    assert caught > 0.9 and wrong < 0.02


def test_ordinary_words_are_counted_in_all_documents(spark):
    """80 words, half of them in 2 % of the documents each and half in 1 %, where 1.5 % are needed; some stand in one stretch of ids alone."""
    names = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(80)]
    texts = [" ".join(["every", *[w for k, w in enumerate(names) if (d + 7 * k) % 100 < 1 + k % 2]]) + (" rarely" if d < 14 else "") + (" stretch" * 3 if 500 <= d < 505 else "") for d in range(1000)]
    assert set(secrets.train(documents(spark, [*texts, None]).filter("doc_id < 1000"))) == {"every", "stretch", *names[1::2]}
    assert secrets.train(documents(spark, ["one two two two", "one one"])) == ("one", "two")


def test_redaction(spark):
    docs = documents(spark, ["a password = hunter22 b", f"x {KEY}", None, "clean"])
    rows = by_id(secrets.redacted(docs))
    assert [rows[k][0]["text"] for k in range(4)] == ["a password = [secret] b", "x [secret]", None, "clean"]
    assert rows[0][0]["n_chars"] == len("a password = [secret] b") and secrets.redacted(docs).columns == docs.columns
    assert secrets.redact("token=0123456789abcdef0123456789", secrets.models()) == "token=[secret]"
