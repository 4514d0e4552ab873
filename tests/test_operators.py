"""Operators on fixtures and, where order decides, against a plain walk."""

import hashlib
import json
import math
import random
import unicodedata

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import chunks, evaluation, operations, retrieval


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first().x


def test_white_space_and_case(spark):
    for space in [*map(chr, range(9, 14)), *map(chr, range(0x1C, 0x21)), "\x85", "\xa0", " ", " ", " ", " ", " ", " ", "　"]:
        assert one(spark, T.collapse(F.col("t")), t=f"{space}a{space}{space}b{space}") == "a b"
    assert one(spark, T.casefold(F.col("t")), t="Straße ẞ ſ ﬁ") == "strasse ss s fi"


def test_case_folding_of_every_code_point(spark):
    """All that the standard library's Unicode version assigns; Spark's is newer and knows more pairs."""
    every = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) != "Cn"]
    texts = ["".join(every[a : a + 997]) for a in range(0, len(every), 997)]
    found = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.casefold(F.col("t"))).collect()
    wrong = [(hex(ord(c)), c.casefold()) for k, x in found if x != texts[k].casefold() for c in texts[k]]
    assert not wrong, (len(wrong), wrong[:5])


def test_terms(spark):
    assert one(spark, T.tokens(F.col("t")), t=" FastAPI 与威沙特分布 C++ 好 ") == ["fastapi", "c++", "与威", "威沙", "沙特", "特分", "分布"]
    for text in (" FastAPI 与威沙特分布 C++ 好 ", "Straße ﬁ 中文a中b中文字", "", "K"):
        assert one(spark, T.tokens(F.col("t")), t=text) == T.tokens_of(text)
    assert one(spark, T.terms(F.col("t")), t="a b a") == ["a", "b"]
    assert one(spark, T.occurrences(F.col("t"), F.lit("aa")), t="aaaa") == 2
    assert one(spark, T.coverage(T.terms(F.col("q")), F.col("t")), q="rag", t="") == 0.0
    assert one(spark, T.coverage(T.terms(F.col("q")), F.col("t")), q="?!", t="x") == 0.0
    assert one(spark, T.coverage(T.terms(F.col("q")), F.col("t")), q="rag index", t="A RAGged thing") == 0.5


def test_identities(spark):
    plain = lambda *parts: hashlib.sha256(json.dumps([str(p) for p in parts], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    material = "8e6450ac515849397e8829348b994dcfd4c62d59501fc2cd76697dba2ba59601"
    assert one(spark, T.stable_sha256(F.lit("material-v1"), F.lit("markdown"), F.lit("rag-intro.md"))) == material
    content = "c51ec19c4451a0922f8e97063718030fa1d7a9f1a3158b25ea69c17981bfd9e2"
    assert one(spark, chunks.chunk_id(F.lit(material), F.lit(2), F.lit(content))) == "315abb3f389e01fd785140d4db87a972a55f253f82e45f1427025e1f1332d2a6"
    other = F.lit("9b73e970e4b0a9cd59bfc32e2fe4b34be223c3b92a71ced24220a96f6d745874")
    third = chunks.chunk_id(other, F.lit(3), F.lit("c7d7e24225984e283c7515f3a45117bd3850be8f9690f4ba44d3cc067035646f"), page=F.lit(3))
    assert one(spark, third) == "9df551b5b95f9be91539968d8c037e0e1d6427dda0196cf30adc2c3dbe8f9622"
    for odd in ('q"\\/\t', "é中😀 ", "\x0e\x0f\x1a\x1b", ""):
        assert one(spark, T.stable_sha256(F.col("t")), t=odd) == plain(odd)


def test_fixed_chunks(spark):
    units = spark.createDataFrame([(1, "x" * 181), (2, ""), (3, "😀" * 180)], "doc_id long, content string")
    assert sorted((r.doc_id, r.chunk_index, len(r.content)) for r in chunks.fixed_chunks(units).collect()) == [(1, 1, 180), (1, 2, 1), (3, 1, 180)]


def test_sync(spark):
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "chunk_id string")
    assert {tuple(r) for r in chunks.synced(frame("a", "b"), frame("b", "c")).collect()} == {("a", "delete"), ("b", "unchanged"), ("c", "add")}


def test_adjacent_fixtures(spark):
    def order(seeds, indexes, window, limit):
        s = spark.createDataFrame([(1, "s", i, k) for k, i in enumerate(seeds, 1)], "qid long, source string, chunk_index int, rank int")
        c = spark.createDataFrame([("s", i) for i in indexes] + [("other", 2)], "source string, chunk_index int")
        return [r.chunk_index for r in retrieval.adjacent(s, c, window, limit).orderBy("position").collect()]

    assert order([2], [1, 2, 3], 1, 8) == [2, 1, 3]
    assert order([1, 2], [1, 2, 3], 1, 3) == [1, 2, 3]
    assert order([4, 1, 2], range(1, 6), 1, 8) == [4, 1, 2, 3, 5]
    assert order([6], range(1, 7), 2, 8) == [6, 5, 4]


def test_selection_is_a_walk(spark):
    rng, rows, expected = random.Random(4), [], {}
    for q in range(150):
        items = [{"position": p, "source": rng.choice("ab"), "chunk_index": i, "role": "seed" if p <= 3 else "adjacent", "coverage": rng.choice((0.0, 0.25, 0.5))} for p, i in enumerate(rng.sample(range(12), 8), 1)]
        rows += [(q, x["position"], x["source"], x["chunk_index"], x["role"], x["coverage"]) for x in items]
        taken = {x["position"] for x in items if x["role"] == "seed"}
        for seed in items[:3]:
            free = [x for x in items if x["role"] == "adjacent" and x["position"] not in taken and x["source"] == seed["source"]]
            if free:
                taken.add(max(free, key=lambda x: (x["coverage"], -abs(x["chunk_index"] - seed["chunk_index"]), -x["position"]))["position"])
        expected[q] = sorted(taken)
    frame = spark.createDataFrame(rows, "qid long, position int, source string, chunk_index int, role string, coverage double")
    found = {}
    for r in retrieval.selected(frame).collect():
        found.setdefault(r.qid, []).append(r.position)
    assert {q: sorted(v) for q, v in found.items()} == expected


def test_budget_skips_and_goes_on(spark):
    frame = spark.createDataFrame([(1, 1, 2), (1, 2, 5), (1, 3, 1), (2, 1, 9)], "qid long, position int, size long")
    assert sorted((r.qid, r.position) for r in retrieval.within_budget(frame, 3).collect()) == [(1, 1), (1, 3)]


def test_fusion_fixture(spark):
    frame = lambda rows: spark.createDataFrame(rows, "qid long, chunk_id string, rank int")
    found = retrieval.fused(frame([(1, "d", 1), (1, "s", 2)]), frame([(1, "s", 1), (1, "p", 2)]), 3).orderBy("rank").collect()
    assert [r.chunk_id for r in found] == ["s", "d", "p"] and abs(found[0].rrf - (1 / 62 + 1 / 61)) < 1e-9


def test_metric_fixtures(spark):
    ranked = spark.createDataFrame([(1, "other", 1), (1, "g2", 2), (1, "g1", 3), (2, "x", 1)], "qid long, vec_id string, rank int")
    gold = spark.createDataFrame([(1, "g1"), (1, "g2")], "qid long, vec_id string")
    found = {r.qid: r for r in evaluation.case_metrics(evaluation.judged(ranked, gold)).collect()}
    assert (found[1].recall_1, found[1].recall_3, found[1].rr) == (0, 1, 0.5) and 0.6 < found[1].ndcg_5 < 1 and abs(found[1].precision - 2 / 3) < 1e-6
    assert found[2].recall_1 is None and found[2].rr is None and found[2].precision == 0
    zero = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>, c array<double>")
    assert tuple(zero.select(retrieval.cosine(F.col("a"), F.col("b")), retrieval.cosine(F.col("a"), F.col("c"))).first()) == (1.0, 0.0)


def test_citations(spark):
    assert one(spark, evaluation.citations(F.col("t")), t="x [S1][S9] [S1] [s2]") == ["S1", "S9"]


def test_limiter_is_a_walk(spark):
    fixture = spark.createDataFrame([("a", t, i) for i, t in enumerate([0.0, 1.0, 1.0, 60.0])], "key string, at double, event_id long")
    got = [(r.accepted, r.retry_after) for r in operations.limited(fixture, 60, 2).orderBy("event_id").collect()]
    assert got == [(True, None), (True, None), (False, 59), (True, None)]
    rng = random.Random(2)
    calls = [(rng.randrange(5), round(rng.uniform(0, 500), 1), i) for i in range(600)]
    expected, times = {}, {}
    for key, at, i in sorted(calls):
        kept = times.setdefault(key, [])
        kept[:] = [t for t in kept if t > at - 60]
        expected[i] = None if len(kept) < 3 else max(1, math.ceil(kept[0] + 60 - at))
        if expected[i] is None:
            kept.append(at)
    found = operations.limited(spark.createDataFrame(calls, "key long, at double, event_id long"), 60, 3).collect()
    assert {r.event_id: r.retry_after for r in found} == expected


def test_names_urls_and_intents(spark):
    problems = lambda name: one(spark, operations.filename_problems(F.col("n")), n=name)
    assert problems("notes.md") == [] and problems("CON.txt") == ["reserved"] and problems("a/b.exe") == ["characters", "suffix"] and problems(" x.pdf") == ["outer_space"]
    url = lambda u: one(spark, operations.canonical_url(F.col("u")), u=u)
    assert url("https://Example.COM/course?q=rag") == "https://example.com/course?q=rag" and url("http://a.b") == "http://a.b/" and url("https://a.b:443/x") == "https://a.b/x"
    assert [url(u) for u in ("https://u:p@a.b/", "https://a.b/#x", "https://a.b:8443/", "https://a.b\\c", "ftp://a.b/")] == [None] * 5
    assert [one(spark, operations.intent(F.col("m")), m=m) for m in ("RAG 有哪些部分", "为什么要切分", "出题", "总结一下", "学习计划")] == ["knowledge_qa", "explanation", "quiz", "summary", "study_plan"]
    assert one(spark, operations.topic(F.col("m"), F.lit("quiz")), m="请出题 RAG 一下") == "RAG"
    assert one(spark, operations.topic(F.col("m"), F.lit("summary")), m="总结") == "本次学习内容"


def test_history_keeps_the_end(spark):
    rows = [(1, t, "user", c * 10) for t, c in enumerate("abcd")]
    found = operations.bounded_history(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 3, 14, 8).orderBy("turn").collect()
    assert [(r.turn, r.content) for r in found] == [(2, "cccccc"), (3, "dddddddd")]


def test_contracts_of_ranks_and_chunks(spark):
    """Repeated, missing and non-finite scores, and one chunk id with two contents, are errors."""
    candidates = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid long, vec_id long, rank int")
    scores = lambda *rows: spark.createDataFrame(list(rows), "qid long, vec_id long, score double")
    good = retrieval.reranked(candidates, scores((1, 10, 0.5), (1, 11, 0.5))).orderBy("new_rank").collect()
    assert [(r.vec_id, r.rank_change) for r in good] == [(10, 0), (11, 0)]
    for wrong in (scores((1, 10, 0.5)), scores((1, 10, 0.5), (1, 10, 0.6), (1, 11, 0.1)), scores((1, 10, float("nan")), (1, 11, 0.1)), scores((1, 10, float("inf")), (1, 11, 0.1))):
        with pytest.raises(PySparkException, match="one row and one finite score"):
            retrieval.reranked(candidates, wrong).collect()
    chunks_of = lambda *rows: spark.createDataFrame(list(rows), "chunk_id string, content string")
    assert retrieval.unique_chunks(chunks_of(("a", "x"), ("a", "x"), ("b", "y"))).count() == 2
    with pytest.raises(PySparkException, match="conflicting contents"):
        retrieval.unique_chunks(chunks_of(("a", "x"), ("a", "z"))).collect()
    for broken in ([[0.0, 0.0]], [[1.0, 0.0, 0.0]]):
        vectors = spark.createDataFrame([(1, 1, broken[0])], "vec_id long, label int, v array<double>")
        with pytest.raises(PySparkException):
            retrieval.nearest(vectors, spark.createDataFrame([(1, [1.0, 2.0])], "qid int, q array<double>")).collect()
