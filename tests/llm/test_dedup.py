import hashlib
import random
from collections import Counter

import pytest
from helpers import AWKWARD, by_id, documents, empty

from bytefleet.llm import decontamination as D
from bytefleet.llm import near_dedup as N
from bytefleet.llm import suffix_dedup as S


def prose(seed, n, words=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(words)}" for _ in range(n))


def edited(text, seed, share):
    draw, words = random.Random(seed), text.split()
    return " ".join(f"e{draw.randrange(10**6)}" if draw.random() < share else w for w in words)


def word_shingles(text, n):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_components(texts):
    sets = [word_shingles(t, 4) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))], [len(s) for s in sets]


@pytest.fixture(scope="module")
def copies():
    base = [prose(k, 120) for k in range(12)]
    texts = list(base)
    for k in range(90):
        texts.append(edited(base[k % 6], k, (0.0, 0.01, 0.02, 0.03, 0.05, 0.1)[k % 6]))
    chain = [prose(77, 100)]
    for k in range(8):  # each one close to the last, the ends far apart
        chain.append(edited(chain[-1], 1000 + k, 0.02))
    return texts + chain + ["a b", "A  b", "a", "same words here now", "SAME words\there now"]


def test_components_equal_brute_force(spark, copies):
    texts = copies + AWKWARD
    rows = by_id(N.near_duplicates(documents(spark, texts)))
    want, sizes = brute_components(texts)
    for k in range(len(texts)):
        r = rows[k][0]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[k], want[k], want[k] == k), (k, texts[k])


def test_contenders_miss_no_link(spark, copies):
    """Whatever the hubs did: all pairs that reach the threshold are among the contenders when every set has a label of its own."""
    sets = {k: N.shingle_set(t) for k, t in enumerate(dict.fromkeys(copies)) if len(N.shingle_set(t))}
    df = spark.createDataFrame([(k, [int(x) - (1 << 64) if int(x) >> 63 else int(x) for x in s]) for k, s in sets.items()], "node bigint, s array<bigint>")
    pairs = {tuple(r) for r in N.contenders(df, df.selectExpr("node", "node as label")).collect()}
    full = {k: set(s.tolist()) for k, s in sets.items()}
    links = {(i, j) for i in full for j in full if i < j and 100 * len(full[i] & full[j]) >= 80 * len(full[i] | full[j])}
    assert links <= pairs and len(pairs) < len(full) ** 2 / 3


def _sets(spark, sets):
    return spark.createDataFrame([(k, [int(x) - (1 << 64) if int(x) >> 63 else int(x) for x in s]) for k, s in sets.items()], "node bigint, s array<bigint>")


@pytest.mark.parametrize("pages", [40, 160])
def test_pages_of_a_template_do_not_meet(spark, pages):
    """170 of 200 shingles are common to all pages: Jaccard 0.74 at most. A few short pages that are mostly template don't change that."""
    rng = random.Random(3)
    draw = lambda n: {rng.getrandbits(64) for _ in range(n)}
    template = draw(170)
    sets = {k: template | draw(30) for k in range(pages)} | {1000 + k: set(list(template)[:100]) | draw(20) for k in range(3)}
    df = _sets(spark, sets)
    met = N.meetings(N.fronts(df, df.selectExpr("node", "node as label")))
    assert met.filter("nodea < 1000 and nodeb < 1000").count() == 0
    assert N.contenders(df, df.selectExpr("node", "node as label")).count() <= 3


def test_sets_of_the_largest_label_do_not_meet(spark):
    """Copies that are one component already, and one set beside them: work in proportion to the copies."""
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(100)]
    sets = {k: set(base[:99]) | {rng.getrandbits(64)} for k in range(60)} | {99: set(base[:95]) | {rng.getrandbits(64) for _ in range(3)}}
    df = _sets(spark, sets)
    met = N.meetings(N.fronts(df, df.selectExpr("node", "case when node < 60 then 0 else node end as label")))
    assert met.filter("nodea < 60 and nodeb < 60").count() == 0
    assert N.contenders(df, df.selectExpr("node", "case when node < 60 then 0 else node end as label")).count() == 60


def test_very_large_sets_keep_their_resemblance(monkeypatch):
    import numpy as np

    monkeypatch.setattr(N, "LARGE", 1000)
    draw = np.random.default_rng(5)
    pool = draw.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:1500]), np.unique(pool[150:1650])
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((N.large_signature(a) == N.large_signature(b)).mean() - truth) < 0.1
    assert len(N.bucket_keys(a)) == N.BANDS == len(N.bucket_keys(np.unique(pool[:500]))) and len(N.bucket_keys(np.unique(pool[:1100]))) == 2 * N.BANDS
    small, large = np.unique(pool[:900]), np.unique(pool[:1100])  # on either side of the bound, yet they share buckets
    assert np.intersect1d(N.bucket_keys(small), N.bucket_keys(large)).size


def test_one_row_of_each_group_stays(spark):
    """Rows are judged by id and text: no text goes because another one has its id, and a group keeps exactly one row."""
    a, b, c = "one two three four five", "other words in here now", "quite another text that stands alone"
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "w"), (2, a, "x"), (3, c, "x"), (3, c, "x"), (4, b + " ", "x"), (5, "", "x"), (5, None, "x"), (6, "é é é é", "x"), (None, a, "x"), (None, a, "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted(((r["doc_id"], r["text"], r["source"]) for r in N.one_of_each(docs).collect()), key=str)
    assert got == sorted([(1, a, "x"), (1, b, "w"), (3, c, "x"), (5, None, "x"), (6, "é é é é", "x"), *rows[-3:]], key=str)
    assert N.one_of_each(docs).columns == docs.columns and N.one_of_each(docs.filter("doc_id = 99")).count() == 0


def test_one_of_each_keeps_further_columns_of_any_name(spark):
    words = "a b c d e f g h"
    docs = spark.createDataFrame([(1, words, 5, "p", 7), (2, words, 6, "q", 8), (None, words, 7, "r", 9)], "doc_id bigint, text string, _th int, label string, id int")
    assert sorted(map(tuple, N.one_of_each(docs).collect()), key=str) == sorted([(1, words, 5, "p", 7), (None, words, 7, "r", 9)], key=str)


def test_repeated_rows_nulls_and_emptiness(spark):
    docs = documents(spark, ["one two three four five", "other words in here now"], extra=[(0, "one two three four five"), (None, "one two three four five"), (7, None), (8, "")])
    rows = by_id(N.near_duplicates(docs))
    assert [r["component_id"] for r in rows[0]] == [0, 0] and rows[None][0]["component_id"] is None and rows[None][0]["kept"]
    assert rows[7][0]["component_id"] == 7 and rows[8][0]["component_id"] == 8 and rows[7][0]["n_shingles"] == 0
    assert N.near_duplicates(empty(spark)).count() == 0


def test_circulant_signatures_estimate_jaccard():
    import numpy as np

    draw = np.random.default_rng(1)
    pool = draw.integers(0, 1 << 63, 1200, dtype=np.uint64)
    errors = []
    for k in range(40):
        a, b = np.unique(pool[:800]), np.unique(pool[k * 10 : 800 + k * 10])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((N.signature(a) == N.signature(b)).mean() - truth)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
    assert (N.band_keys(N.signature(pool)) == N.band_keys(N.signature(pool))).all()


def brute_removed(texts, depth):
    raws = [(t or "").encode() for t in texts]
    times = Counter(r[k : k + depth] for r in raws for k in range(len(r) - depth + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for k in range(len(r) - depth + 1):
            if times[r[k : k + depth]] > 1:
                gone[k : k + depth] = [True] * depth
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


def passages():
    shared = [prose(k, 60) for k in range(4)]
    texts = [prose(100 + k, 30) + shared[k % 4] + prose(200 + k, 20 + k) for k in range(24)]
    texts += [shared[0][:150] + "cut" + shared[0][60:], shared[1][7:], "ab" * 300, "ab" * 150 + "c", "z" * 199, "z" * 200, "z" * 201, "é" * 150]
    return texts + [texts[3], texts[3], prose(5, 50) * 2] + AWKWARD


def test_removal_equals_brute_force(spark):
    texts = passages()
    rows = by_id(S.remove_repeats(documents(spark, texts)))
    for k, want in enumerate(brute_removed(texts, S.DEPTH)):
        assert tuple(rows[k][0])[1:] == want, (k, texts[k])


def test_many_copies_are_listed_as_one(spark, monkeypatch):
    """Equal texts under a thousand ids, or under none, make one text to cut up, with one list of its own places."""
    text, rows = prose(77, 90), 1000
    docs = documents(spark, [text] * rows + [prose(78, 90)], extra=[(None, text)] * rows)
    base, found = S.repeated_passages(docs)
    work = found.collect()
    assert len(work) == 1 and len(work[0]["settled"]) <= len(text) and base.count() == 2 * rows + 1
    out = S.remove_repeats(docs).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    n = len(text.encode())
    assert {(r["n_bytes"], r["n_removed"], r["n_spans"], r["count"]) for r in out} == {(n, n, 1, 2 * rows), (len(prose(78, 90).encode()), 0, 0, 1)}


@pytest.mark.parametrize(("depth", "gram"), [(24, 8), (40, 40), (5, 1)])
def test_removal_at_other_depths(spark, depth, gram):
    texts = [t for t in passages() if len(t or "") < 1500]
    rows = by_id(S.remove_repeats(documents(spark, texts), depth=depth, gram=gram))
    for k, want in enumerate(brute_removed(texts, depth)):
        assert tuple(rows[k][0])[1:] == want, (k, texts[k])


def test_removal_over_stretches_repeats_and_nulls(spark, monkeypatch):
    docs = documents(spark, ["q" + prose(1, 60)], extra=[(0, "q" + prose(1, 60)), (None, prose(2, 70)), (5, prose(2, 70))])
    rows = by_id(S.remove_repeats(docs))
    assert len(rows[0]) == 2 and all(r["n_removed"] == r["n_bytes"] for rs in rows.values() for r in rs)
    assert S.remove_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        S.remove_repeats(docs, depth=10, gram=11)
    import numpy as np

    raw = np.frombuffer(prose(9, 3000).encode(), np.uint8)
    monkeypatch.setattr(S, "_STRETCH_BITS", 11)
    starts = np.concatenate([np.arange(s, s + n) for _, _, ss, ns, _ in S.runs(raw) for s, n in zip(ss, ns, strict=True)])
    assert (starts == np.arange(len(raw) - S.DEPTH + 1)).all()


def brute_contained(docs, items, n=5, num=4, den=5):
    out = {}
    for d, t in docs:
        for i, u in items:
            a, b = word_shingles(u, n), word_shingles(t, n)
            if a and den * len(a & b) >= num * len(a):
                out[d, i] = (len(a), len(a & b))
    return out


def test_containment_equals_brute_force(spark):
    items = [(k, prose(300 + k, 5 + 3 * k)) for k in range(12)] + [(20, "two words"), (21, ""), (22, None), (23, prose(300, 5)), (24, "Same Words In A Row here")]
    texts = []
    for k in range(30):
        piece = edited(items[k % 12][1], k, (0.0, 0.02, 0.05, 0.2)[k % 4])
        texts.append(prose(400 + k, 100) + " " + piece + " " + prose(500 + k, 80))
    texts += ["two words", "TWO\twords", "same words in a row here and on", *AWKWARD]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame([(k, t, "c") for k, t in items], "item_id bigint, text string, shingle string")
    for limit in (D.BROADCAST_ROWS, 0):
        D_limit, D.BROADCAST_ROWS = D.BROADCAST_ROWS, limit
        try:
            got = {(r["doc_id"], r["item_id"]): (r["item_size"], r["matched"]) for r in D.contained_items(documents(spark, texts), frame).collect()}
        finally:
            D.BROADCAST_ROWS = D_limit
        assert got == brute_contained(docs, items)
    assert D.contained_items(empty(spark), frame).count() == 0 and D.contained_items(documents(spark, texts), frame.filter("item_id < 0")).count() == 0


def test_sketches_miss_nothing(spark):
    """A sketch has one shingle more than a contained item may lack."""
    rows = D.item_sketches(spark.createDataFrame([(k, prose(k, 5 + k)) for k in range(40)], "item_id bigint, text string")).collect()
    for k in range(40):
        mine = [r for r in rows if r["item_id"] == k]
        n = len(mine)
        assert sum(r["in_sketch"] for r in mine) == n - -(-4 * n // 5) + 1


def test_only_sketch_shingles_make_candidates(spark):
    """A document with a shingle that is in no sketch is no candidate; one with a sketch's shingle is."""
    items = spark.createDataFrame([(1, prose(11, 30))], "item_id bigint, text string")
    rows = D.item_sketches(items).collect()
    words = prose(11, 30).split()
    texts = [" ".join(words[k : k + 5]) for k in range(26)]
    of = {r["shingle"]: r["in_sketch"] for r in rows}
    docs = documents(spark, texts)
    held = {r["doc_id"]: of[r["s"][0]] for r in docs.select("doc_id", D.shingles(D.word_hashes(docs["text"])).alias("s")).collect()}
    got = {r["doc_id"] for r in D.candidates(docs.select("doc_id", "text"), D.item_sketches(items)).collect()}
    assert got == {k for k, inside in held.items() if inside} and 0 < len(got) < len(texts)
    assert D.contained_items(docs, items).count() == 0


@pytest.mark.parametrize("item_id", [7, None])
def test_texts_of_one_item_id_have_sketches_of_their_own(spark, item_id):
    for seed in range(6):
        texts = [prose(900 + seed, 24), prose(950 + seed, 60)]
        items = spark.createDataFrame([(item_id, t) for t in texts], "item_id bigint, text string")
        sketch = [(r["item_key"], r["item_size"]) for r in D.item_sketches(items).filter("in_sketch").collect()]
        assert sorted(sketch.count(k) for k in set(sketch)) == sorted(n - -(-4 * n // 5) + 1 for n in (len(word_shingles(t, 5)) for t in texts))
        got = D.contained_items(documents(spark, [f"before {t} after" for t in texts]), items).collect()
        assert sorted((r["doc_id"], r["item_size"]) for r in got) == [(k, len(word_shingles(t, 5))) for k, t in enumerate(texts)]
