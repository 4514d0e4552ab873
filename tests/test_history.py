"""Messages with owners, limits, questions by intent and counts of tokens on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from granary.operators import history as H

MESSAGE = "session_id string, message_order long, created_at long"


def test_messages_follow_their_sessions(spark):
    messages = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 6), ("c", 1, 9), ("d", 1, 1)], MESSAGE)
    sessions = spark.createDataFrame([("a", 1), ("b", 1), ("d", 2), ("e", 3)], "session_id string, user_id long")
    owned = H.owned_messages(messages, sessions)
    assert sorted((r.user_id, r.session_id, r.message_order) for r in owned.collect()) == [(1, "a", 1), (1, "a", 2), (1, "b", 1), (2, "d", 1)]
    last = sorted((r.user_id, r.position, r.session_id, r.message_order) for r in H.latest_of_users(owned, 2).collect())
    assert last == [(1, 1, "a", 2), (1, 2, "b", 1), (2, 1, "d", 1)]
    assert H.latest_of_users(owned.limit(0), 2).count() == 0


def test_a_user_is_cut_before_the_shuffle(spark):
    owned = spark.range(100).select((F.col("id") % 3).alias("user_id"), F.lit("a").alias("session_id"), F.col("id").alias("message_order"), F.col("id").alias("created_at"))
    plan = H.latest_of_users(owned, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("limit", [0, 101, -1, True])
def test_limits(limit):
    with pytest.raises(ValueError):
        H.bounded(limit)


def test_topics_and_questions(spark):
    topics = [" a \t", "", None, "　", "x" * 200, "x" * 201]
    found = spark.createDataFrame(list(enumerate(topics)), "k long, t string").select("k", H.normal_topic(F.col("t")).alias("t")).collect()
    assert [r.t for r in sorted(found)] == ["a", None, None, None, "x" * 200, None]
    asked = spark.createDataFrame([("quiz",), ("summary",), ("study_plan",), ("explanation",), (None,)], "i string").select("i", H.retrieval_question(F.col("i"), F.lit("TCP"), F.lit("what?")).alias("q"))
    assert {r.i: r.q for r in asked.collect()} == {"quiz": "TCP有哪些需要掌握的核心概念？", "summary": "请总结TCP的核心内容。", "study_plan": "学习TCP需要掌握哪些关键知识？", "explanation": "what?", None: "what?"}


def plain_usage(text):
    try:
        result = json.loads(text)
    except (TypeError, ValueError):
        result = {}
    usage = result.get("usage_metadata")
    if not isinstance(usage, dict):
        usage = (result.get("response_metadata") or {}).get("token_usage")
    usage = usage if isinstance(usage, dict) else {}
    whole = lambda *names: next((usage[n] for n in names if type(usage.get(n)) is int and usage[n] >= 0), None)
    read, written, total = whole("input_tokens", "prompt_tokens"), whole("output_tokens", "completion_tokens"), whole("total_tokens")
    if total is None and None not in (read, written):
        total = read + written
    return (any(x is not None for x in (read, written, total)), read, written, total)


def test_token_usage_against_a_plain_version(spark):
    values = [3, 0, -1, True, "4", 2.5, None]
    places = [lambda u: {"usage_metadata": u}, lambda u: {"response_metadata": {"token_usage": u}}, lambda u: {"usage_metadata": "none", "response_metadata": {"token_usage": u}}, lambda u: {"usage_metadata": {}, "response_metadata": {"token_usage": u}}]
    texts = [json.dumps(place({a: x, b: y})) for place in places for a in ("input_tokens", "prompt_tokens") for b in ("output_tokens", "completion_tokens", "total_tokens") for x in values for y in values]
    texts += [json.dumps({"usage_metadata": {"input_tokens": -1, "prompt_tokens": 5, "output_tokens": 1, "total_tokens": 9}}), "{}", "no json", "", None]
    found = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", H.token_usage(F.col("t")).alias("u")).collect()
    assert [tuple(r.u) for r in sorted(found, key=lambda r: r.k)] == [plain_usage(t) for t in texts]
