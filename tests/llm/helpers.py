"""Small tables with the awkward cases that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

AWKWARD = [None, "", " ", "\n\t ", "a", "é", "ß" * 3, "\x00\x01", "😀 smile", "word " * 5, "word " * 5, "x" * 5000, "Tab\tand\nline  double", "<|endoftext|> inside <|im_start|>"]


def documents(spark, texts, extra=()):
    """Rows of documents with further columns whose names the operators use themselves."""
    rows = [(k, t, "en", f"src{k % 3}", len(t or ""), "x", 1) for k, t in enumerate(texts)]
    rows += [(k, t, None, None, None, None, None) for k, t in extra]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n bigint")


def empty(spark):
    return documents(spark, ["x"]).filter("doc_id < 0")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out
