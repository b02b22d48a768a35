import os

import pytest

import corpus_pipeline as P
from bytefleet.llm import language_id, near_dedup, secrets
from bytefleet.llm.tokenizers_io import load, packed, public_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_stages_against_plain_models(spark, tmp_path):
    import hashlib

    from test_dedup import brute_components, brute_contained

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    held = {}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        held[name] = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(P.STAGES) - 1:
            assert held[name].columns == list(P.DOCUMENTS)
            docs = held[name]
    rows = {n: {r["doc_id"]: r for r in df.collect()} for n, df in held.items()}
    before = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(language_id.words_of(before[k]["text"]) for k in rows["language_id"])
    assert len(rows["language_id"]) > 0.9 * len(before)
    ids = sorted(rows["language_id"])
    root, _ = brute_components([rows["language_id"][k]["text"] for k in ids])
    assert sorted(rows["near_duplicates"]) == sorted({ids[r] for r in root})
    leaks = {d for d, _ in brute_contained([(k, r["text"]) for k, r in rows["near_duplicates"].items()], items)}
    assert leaks and set(rows["decontamination"]) == set(rows["near_duplicates"]) - leaks
    assert set(rows["secrets"]) == set(rows["decontamination"]) == set(rows["bpe"])
    for k, r in rows["secrets"].items():
        old = rows["decontamination"][k]["text"]
        for a, b, kind in secrets.base_spans(old):  # what was assigned, or the whole span, is gone
            hidden = secrets.ASSIGN.match(old, a)[2] if kind == "assign" else old[a:b]
            assert old.count(hidden) > r["text"].count(hidden) and secrets.REDACTED in r["text"]
        assert secrets.base_spans(old) or r["text"] == old or secrets.REDACTED in r["text"]
        ids = packed(load(public_path("byte_bpe_50k.json")).encode(r["text"], add_special_tokens=False).ids)
        assert rows["bpe"][k]["ids_sha256"] == hashlib.sha256(ids).hexdigest() and r["n_chars"] == len(r["text"])


def test_stages_take_awkward_tables(spark, tmp_path):
    from helpers import AWKWARD, documents, empty

    extra = documents(spark, AWKWARD, extra=[(3, "again"), (None, "no id at all here")])
    for name, stage in P.STAGES[1:]:
        stage(spark, extra, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        got = sorted(str(r["doc_id"]) for r in out.collect())
        everyone = sorted(str(r["doc_id"]) for r in extra.collect())
        # "word " is there twice, as 9 and 10; id 3 has two texts, each in a group of its own
        assert got == ([k for k in everyone if k != "10"] if name == "near_duplicates" else everyone), name
        assert stage(spark, empty(spark), SF).count() == 0, name
    assert P.STAGES[0][1](spark, extra, SF).count() <= extra.count()
    assert near_dedup.BANDS * near_dedup.BAND_ROWS == 128


def test_decontamination_takes_rows_without_an_id(spark):
    from helpers import documents

    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    docs = documents(spark, ["clean words of no item at all", leak], extra=[(None, f"before {leak} after"), (None, "clean and without an id"), (None, None)])
    left = {(r["doc_id"], r["text"]) for r in P.decontaminate(spark, docs, SF).collect()}
    assert left == {(0, "clean words of no item at all"), (None, "clean and without an id"), (None, None)}
