"""The retrieval trace on a small index: stages, measures, failures, comparison and replay."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granary.operators import chunks as C
from granary.operators import trace as T

WORDS = {1: "alpha", 2: "beta", 3: "gamma", 4: "delta", 5: "omega"}


@pytest.fixture(scope="module")
def index(spark):
    """Two sources of five chunks each, ten characters or so long."""
    rows = [(f"s{d}", f"m{d}", i, f"{WORDS[i]} s{d} x") for d in (1, 2) for i in range(1, 6)]
    return C.with_ids(spark.createDataFrame(rows, "source string, material_id string, chunk_index int, content string")).cache()


@pytest.fixture(scope="module")
def raw(spark, index):
    """Question 1 finds s1 #3, #1, s2 #5, #4; question 2 only what is under the threshold; question 3 nothing."""
    rows = [(1, "s1", 3, 0.9, 1), (1, "s1", 1, 0.8, 2), (1, "s2", 5, 0.5, 3), (1, "s2", 4, 0.25, 4), (1, "s2", 1, 0.2, 5), (2, "s1", 2, 0.1, 1), (4, "s2", 2, 0.9, 1)]
    return spark.createDataFrame(rows, "qid long, source string, chunk_index int, score double, rank int").join(index.select("source", "chunk_index", "chunk_id", "content"), ["source", "chunk_index"]).cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "omega alpha", True), (2, "beta", True), (3, "beta", True), (4, "beta", False), (5, "none", False)], "qid long, question string, answerable boolean").cache()


def gold(spark, index, rows):
    marks = spark.createDataFrame(rows, "qid long, source string, chunk_index int")
    return marks.join(index.select("source", "chunk_index", "chunk_id"), ["source", "chunk_index"]).select("qid", "chunk_id")


def test_stages_of_a_question(spark, asked, raw, index):
    trace = T.traced(asked, raw, index).orderBy("qid").collect()
    assert [r.qid for r in trace] == [1, 2, 3, 4, 5]
    one = trace[0]
    assert [c.retained for c in one.candidates] == [True, True, True, True, False] and one.candidates[-1].reason == "vector_score_below_threshold"
    # 0.8 x score + 0.2 x coverage: 0.72, 0.74, 0.5, 0.2
    assert [(c.rank_after, c.seed_rank) for c in one.candidates] == [(2, 2), (1, 1), (3, 3), (4, None), (None, None)]
    assert [(c.source, c.chunk_index, c.role) for c in one.context[:3]] == [("s1", 1, "seed"), ("s1", 3, "seed"), ("s2", 5, "seed")]
    ids = {(r.source, r.chunk_index): r.chunk_id for r in index.collect()}
    assert [(c.source, c.chunk_index, c.source_seed) for c in one.context[3:]] == [
        ("s1", 2, ids["s1", 1]), ("s1", 4, ids["s1", 3]), ("s1", 5, ids["s1", 3]), ("s2", 4, ids["s2", 5]), ("s2", 3, ids["s2", 5]),
    ]
    assert trace[2].candidates == [] and trace[2].context == []


def test_measures_and_failures(spark, asked, raw, index):
    marks = gold(spark, index, [(1, "s1", 3), (1, "s2", 4), (1, "s1", 4), (2, "s1", 2), (3, "s1", 1)])
    wide = {r.qid: r for r in T.measured(T.traced(asked, raw, index), marks).collect()}
    one = wide[1]
    assert (one.raw_recall_1, one.raw_recall_3, one.raw_recall_5, one.raw_mrr, one.ranked_mrr) == (0.333333, 0.333333, 0.666667, 1.0, 0.5)
    ideal = 1 + 1 / math.log2(3) + 1 / 2
    assert one.raw_ndcg_5 == round((1 + 1 / math.log2(5)) / ideal, 6) and one.ranked_ndcg_5 == round((1 / math.log2(3) + 1 / math.log2(5)) / ideal, 6)
    assert (one.final_context_recall, one.context_precision, one.failure, one.gold_count) == (1.0, 0.375, None, 3)
    assert (wide[2].failure, wide[2].raw_recall_1, wide[2].ranked_recall_1, wide[2].context_precision) == ("filtering_failure", 1.0, 0.0, 0.0)
    assert (wide[3].failure, wide[3].final_context_recall) == ("recall_failure", 0.0)
    assert (wide[4].failure, wide[4].context_precision, wide[4].raw_mrr) == ("unanswerable_handling_failure", 0.0, None)
    assert (wide[5].failure, wide[5].context_precision, wide[5].n_context) == (None, 1.0, 0)
    tight = {r.qid: r for r in T.measured(T.traced(asked, raw, index, T.Config(context_limit=1)), marks).collect()}
    assert tight[1].failure == "context_construction_failure"
    fourth = gold(spark, index, [(1, "s2", 4)])
    assert {r.qid: r.failure for r in T.measured(T.traced(asked, raw, index), fourth).collect()}[1] == "ranking_failure"


def test_deltas_by_one_unpivot(spark, asked, raw, index):
    marks = gold(spark, index, [(1, "s1", 3)])
    first, second = (T.averages(T.measured(T.traced(asked, raw, index, c), marks)) for c in (T.Config(), T.Config(context_limit=1)))
    found = {r.metric: (r.first, r.second, r.delta) for r in T.deltas(first, second).collect()}
    assert set(found) == set(T.METRICS) and found["final_context_recall"] == (1.0, 0.0, -1.0) and found["raw_mrr"][2] == 0.0


def test_replay_refuses_what_the_index_no_longer_holds(spark, asked, raw, index):
    trace = T.traced(asked, raw, index).cache()
    assert T.replayed(trace, index).count() == sum(len(r.context) for r in trace.collect())
    read = lambda chunks: T.replayed(trace, chunks).collect()
    with pytest.raises(PySparkException, match="not in the index"):
        read(index.filter("not (source = 's1' and chunk_index = 2)"))
    with pytest.raises(PySparkException, match="changed since the trace"):
        read(index.withColumn("content_hash", F.when(F.col("chunk_index") == 2, "other").otherwise(F.col("content_hash"))))
    with pytest.raises(PySparkException, match="more than once"):
        read(index.union(index.filter("source = 's1'")))


@pytest.mark.parametrize("answerable,n,recall,before,expected", [(False, 2, None, None, "unanswerable_handling_failure"), (False, 0, None, "x", None), (True, 1, 0.0, None, "context_construction_failure"), (True, 1, 0.0, "recall_failure", "recall_failure"), (True, 1, 0.5, "y", "y")])
def test_failures_carry_over(spark, answerable, n, recall, before, expected):
    frame = spark.createDataFrame([(answerable, n, recall, before)], "a boolean, n int, r double, b string")
    assert frame.select(T.carried_over(F.col("a"), F.col("n"), F.col("r"), F.col("b"))).first()[0] == expected


def test_configs_are_checked():
    for wrong in ({"limit": 0}, {"candidates": -1}, {"threshold": 1.5}, {"adjacent": -1}, {"context_limit": 0}, {"budget": -1}):
        with pytest.raises(ValueError):
            T.Config(**wrong)
