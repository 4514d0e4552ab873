"""Scores of cut texts and counts of substrings against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from granary.functions.text import collapse, terms
from granary.operators import chunks, retrieval


def texts_of(spark, texts, parts=1):
    return spark.createDataFrame([(f"doc-{i}", t) for i, t in enumerate(texts)], "source string, text string").repartition(parts)


def test_substrings_are_counted_without_overlaps():
    r = random.Random(5)
    some = [*{"".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(120)}, "中文", "aaaaaaa"]
    texts = ["".join(r.choice("abc") for _ in range(r.randint(0, 30))) for _ in range(300)] + ["中文中文x", "a" * 29, ""]
    found = {(of, term): n for of, term, n in zip(*map(np.ndarray.tolist, retrieval.Substrings(some).counts(texts)), strict=True)}
    assert found == {(i, k): x.count(t) for i, x in enumerate(texts) for k, t in enumerate(some) if x.count(t)}
    assert [len(x) for x in retrieval.Substrings(some).counts([])] == [0, 0, 0]


def test_a_task_gives_on_only_what_may_be_among_the_best(spark, monkeypatch):
    """Before, every batch gave on its own best, so rows grew with the batches."""
    monkeypatch.setattr(retrieval, "CHUNKS_AT_ONCE", 10)
    texts = texts_of(spark, [f"word{i} " * 20 for i in range(500)])
    asked = spark.createDataFrame([(1, ["x"])], "qid long, terms array<string>")

    def scorer(rows):
        return lambda contents: np.array([[1000.0 - int(c.split("word")[1].split()[0]) for c in contents]])

    found = retrieval.in_blocks(texts.coalesce(1).orderBy(F.length("source"), "source").coalesce(1), asked, scorer, "score", 3)
    assert found.count() < 15 and found.agg(F.max("score")).first()[0] == 1000.0


def test_best_keeps_ties_and_rounds():
    best = retrieval.Best(1, 2)
    assert best.places(np.array([[1.0, 3.0, 0.0, 2.0]]))[1].tolist() == [1, 3]
    asks, at, values = best.places(np.array([[2.0000001, 1.9, 2.0, 0.0]]))
    assert at.tolist() == [0, 2] and values.tolist() == [2.0, 2.0]


def test_ranking_equals_plain_counts(spark):
    r = random.Random(7)
    texts = [" ".join(r.choice(["ab", "abab", "Straße", "ﬁt", "中文中文", "c++", "x", "İx"]) + r.choice(["", ".", "  "]) for _ in range(r.randint(0, 120))) for _ in range(40)]
    asks = ["ab b x", "STRASSE fit", "中文", "c++ i̇x", "nothing-here", ""]
    questions = spark.createDataFrame(list(enumerate(asks)), "qid long, question string")
    found = {(row.qid, row.source, row.chunk_index): row.hits for row in retrieval.term_counts(texts_of(spark, texts, 3), questions, 1000).collect()}
    wanted = dict(questions.select("qid", terms(F.col("question")).alias("t")).collect())
    expected = {}
    for i, text in enumerate(texts):
        for k, content in enumerate(chunks.pieces_of(text), 1):
            for q, ts in wanted.items():
                if n := sum(content.casefold().count(t) for t in ts):
                    expected[q, f"doc-{i}", k] = n
    assert found == expected and found


def test_pieces_of_a_text_are_the_fixed_chunks(spark):
    texts = ["", " \n", "a\x1cb\u3000c " * 90, "😀 " * 200, "x" * 180, "y" * 181]
    units = texts_of(spark, texts).select("source", collapse(F.col("text")).alias("content"))
    found = {(row.source, row.chunk_index): row.content for row in chunks.fixed_chunks(units).collect()}
    assert found == {(f"doc-{i}", k): c for i, t in enumerate(texts) for k, c in enumerate(chunks.pieces_of(t), 1)}
