"""What users said and asked: messages with their owners, the latest of each, questions as retrieval asks them, tokens used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import strip
from granary.operators import operations as O

MOST, TOPIC_CHARS = 100, 200
# What retrieval asks about a topic, by intent.
QUESTIONS = (("quiz", "", "有哪些需要掌握的核心概念？"), ("summary", "请总结", "的核心内容。"), ("study_plan", "学习", "需要掌握哪些关键知识？"))
# The names that models give their counts of tokens.
_COUNTS = "input_tokens: long, prompt_tokens: long, output_tokens: long, completion_tokens: long, total_tokens: long"
USAGE = f"usage_metadata struct<{_COUNTS}>, response_metadata struct<token_usage: struct<{_COUNTS}>>"


def bounded(limit: int) -> int:
    if isinstance(limit, bool) or not 1 <= limit <= MOST:
        raise ValueError(f"a limit is between 1 and {MOST}")
    return limit


def normal_topic(topic: Column) -> Column:
    """The topic without white space at its ends; null if nothing is left or it is too long."""
    text = strip(topic)
    return F.when(F.length(text).between(1, TOPIC_CHARS), text)


def owned_messages(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """messages (session_id, ...) with the user_id of their session; those of no session go."""
    return messages.join(sessions.select("session_id", "user_id"), "session_id")


def latest_of_users(messages: DataFrame, limit: int) -> DataFrame:
    """The last `limit` messages (user_id, session_id, message_order, created_at) of every user, numbered in ascending order.

    Ties in time go by session and order. The window keeps `limit` rows of a user in each task before anything is shuffled.
    """
    order = [F.desc("created_at"), F.desc("session_id"), F.desc("message_order")]
    back = messages.withColumn("back", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).filter(F.col("back") <= bounded(limit))
    return back.withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("back")))).drop("back")


def retrieval_question(intent: Column, topic: Column, message: Column) -> Column:
    """What is searched for: a question on the topic where the intent has one, else the message itself."""
    out = message
    for name, before, behind in QUESTIONS:
        out = F.when(intent == name, F.concat(F.lit(before), topic, F.lit(behind))).otherwise(out)
    return out


def token_usage(result: Column) -> Column:
    """available, input_tokens, output_tokens and total_tokens that a model's result (JSON) tells.

    The first of a count's names that holds a whole number of at least 0 is taken; the total is their sum if it is not
    told itself. Nothing is estimated: without any count, available is false.
    """
    parsed = F.from_json(result, USAGE)
    usage = F.coalesce(parsed["usage_metadata"], parsed["response_metadata"]["token_usage"])
    count = lambda *names: F.coalesce(*[F.when(usage[n] >= 0, usage[n]) for n in names])
    read, written = count("input_tokens", "prompt_tokens"), count("output_tokens", "completion_tokens")
    total = F.coalesce(count("total_tokens"), read + written)
    available = read.isNotNull() | written.isNotNull() | total.isNotNull()
    return F.struct(available.alias("available"), read.alias("input_tokens"), written.alias("output_tokens"), total.alias("total_tokens"))


# --- queries: a conversation is a session, five in a row are a user's; a turn's number and a third of the conversation's are its time ---


def _messages(spark, sf_dir) -> DataFrame:
    """Messages of sessions; every ninth conversation has none."""
    every = O.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_order"), "role", (F.col("conv_id") % 3 * 2 + F.col("turn")).alias("created_at"))
    sessions = every.select("session_id").distinct().filter("session_id % 9 > 0").withColumn("user_id", F.floor(F.col("session_id") / 5))
    return owned_messages(every, sessions)


def q_user_messages(spark, sf_dir):
    return latest_of_users(_messages(spark, sf_dir), 6).select("user_id", "session_id", "message_order", "role", F.col("position").cast("long").alias("position"))


def q_retrieval_questions(spark, sf_dir):
    """Every message as retrieval asks it; words of three intents are put before some, by turn."""
    word = F.element_at(F.array(*map(F.lit, ("quiz ", "总结 ", "学习计划 ", ""))), (F.col("turn") % 4 + 1).cast("int"))
    found = O.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(word, "text").alias("text")).withColumn("intent", O.intent(F.col("text")))
    topic = O.topic(F.col("text"), F.col("intent"))
    return found.select("conv_id", "turn", "intent", F.sha2(retrieval_question(F.col("intent"), topic, F.col("text")), 256).alias("digest"))


def q_token_usage(spark, sf_dir):
    """Events as results of a model, in eight forms: both places, both sets of names, negative, fractional, quoted and missing counts."""
    a, b = F.col("event_id") % 1000, F.floor("value")
    forms = (
        '{"usage_metadata": {"input_tokens": %d, "output_tokens": %d}}', '{"response_metadata": {"token_usage": {"prompt_tokens": %d, "completion_tokens": %d, "total_tokens": 7}}}', '{"usage_metadata": {"input_tokens": -%d, "prompt_tokens": %d}}',
        '{"usage_metadata": "%d", "response_metadata": {"token_usage": {"output_tokens": %d}}}', '{"usage_metadata": {}, "response_metadata": {"token_usage": {"total_tokens": %d}}, "n": %d}', '{"usage_metadata": {"input_tokens": "%d", "output_tokens": %d.5}}',
        '{"usage_metadata": {"input_tokens": %d, "output_tokens": true}, "n": %d}', '{"n": %d, "m": %d}',
    )
    form = F.element_at(F.array(*[F.format_string(f, a, b) for f in forms]), (F.col("event_id") % 8 + 1).cast("int"))
    return O.read(spark, sf_dir, "events").select("event_id", token_usage(form).alias("u")).select("event_id", "u.*")


QUERIES = {
    "user_messages": (
        q_user_messages,
        """with m as (select conv_id // 5 as user_id, conv_id as session_id, turn as message_order, role, conv_id % 3 * 2 + turn as created from conversations where conv_id % 9 > 0),
        b as (select *, row_number() over (partition by user_id order by created desc, session_id desc, message_order desc) as back from m qualify back <= 6)
        select user_id, session_id, message_order, role, row_number() over (partition by user_id order by back desc) as position from b""",
    ),
    "retrieval_questions": (
        q_retrieval_questions,
        r"""with a as (select conv_id, turn, ['quiz ', '总结 ', '学习计划 ', ''][turn % 4 + 1] || text as t from conversations),
        i as (select *, case when contains(lower(t), 'quiz') then 'quiz' when contains(t, '学习计划') then 'study_plan' when contains(t, '总结') then 'summary' else 'knowledge_qa' end as intent from a),
        p as (select *, trim(regexp_replace(case intent when 'quiz' then regexp_replace(trim(t), 'quiz', ' ', 'gi') when 'study_plan' then replace(trim(t), '学习计划', ' ') when 'summary' then replace(trim(t), '总结', ' ') else trim(t) end, '\s+', ' ', 'g')) as x from i),
        q as (select *, substr(case when trim(x, '，。！？?：: ') = '' then '本次学习内容' else trim(x, '，。！？?：: ') end, 1, 200) as topic from p)
        select conv_id, turn, intent, sha256(case intent when 'quiz' then topic || '有哪些需要掌握的核心概念？' when 'summary' then '请总结' || topic || '的核心内容。' when 'study_plan' then '学习' || topic || '需要掌握哪些关键知识？' else t end) as digest from q""",
    ),
    "token_usage": (
        q_token_usage,
        """with e as (select event_id, event_id % 8 as f, event_id % 1000 as a, floor(value)::bigint as b from events),
        u as (select event_id, f, case when f in (0, 1, 6) then a when f = 2 and a = 0 then 0 when f = 2 then b end as i, case when f in (0, 1, 3) then b end as o from e)
        select event_id, i is not null or o is not null as available, i as input_tokens, o as output_tokens, case when f = 1 then 7 else i + o end as total_tokens from u""",
    ),
}
