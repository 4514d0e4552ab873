"""Operational data: messages, sessions, jobs, requests, limits, and the rules for names and urls."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.streaming import jobs

# Limits of a conversation's history, in turns and characters.
HISTORY_TURNS, HISTORY_CHARS, TURN_CHARS = 20, 12_000, 4_000
# Words that tell a message's intent, the first list that matches winning.
INTENTS = (
    ("quiz", ("出题", "一道题", "练习", "测验", "测试我", "quiz")),
    ("study_plan", ("学习计划", "学习路径", "怎么学", "如何学", "规划学习")),
    ("summary", ("总结", "复习", "回顾", "要点", "小结")),
    ("explanation", ("什么是", "解释", "为什么", "怎么理解", "如何理解", "原理", "举例")),
)
# Content types that go with a file name's suffix.
CONTENT_TYPES = (
    (".txt", "text/plain"), (".txt", "application/octet-stream"), (".md", "text/markdown"), (".md", "text/plain"), (".md", "application/octet-stream"),
    (".pdf", "application/pdf"), (".pdf", "application/octet-stream"), (".docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    (".docx", "application/octet-stream"), (".docx", "application/zip"), (".docx", "application/x-zip-compressed"),
)


def read(spark, sf_dir, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation, numbered in ascending order."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= n)


def q_latest_messages(spark, sf_dir):
    return latest(read(spark, sf_dir, "conversations"), 6).select("conv_id", "turn", "role", "back")


def bounded_history(messages: DataFrame, turns: int = HISTORY_TURNS, chars: int = HISTORY_CHARS, each: int = TURN_CHARS) -> DataFrame:
    """From the latest backwards, each cut to its first characters, until the characters are used up; the oldest keeps its end."""
    cut = latest(messages, turns).withColumn("content", F.substring(F.col("text"), 1, each))
    before = Window.partitionBy("conv_id").orderBy("back").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(chars) - F.coalesce(F.sum(F.length("content")).over(before), F.lit(0))
    kept = cut.withColumn("left", left).filter((F.col("left") > 0) & (F.length("content") > 0))
    tail = F.when(F.length("content") > F.col("left"), F.expr("right(content, int(left))")).otherwise(F.col("content"))
    return kept.select("conv_id", "turn", "role", tail.alias("content"))


def q_bounded_history(spark, sf_dir):
    """With tighter bounds than in production, so that they bite on short conversations."""
    found = bounded_history(read(spark, sf_dir, "conversations"), 5, 900, 400)
    return found.select("conv_id", "turn", F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("digest"))


def q_append_exchange(spark, sf_dir):
    """The next order numbers of a new exchange of two messages in each conversation."""
    last = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.coalesce(F.max("turn"), F.lit(0)).alias("last"))
    return last.select("conv_id", F.posexplode(F.array(F.lit("user"), F.lit("tutor"))).alias("k", "role"), "last").select("conv_id", (F.col("last") + 1 + F.col("k")).alias("message_order"), "role")


def q_next_message_order(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.coalesce(F.max("turn"), F.lit(0)) + 1).alias("next_order"), F.count("*").alias("n_messages"))


def intent(message: Column) -> Column:
    folded, found = F.lower(message), F.lit("knowledge_qa")
    for name, words in reversed(INTENTS):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(folded, F.lit(word))
        found = F.when(hit, name).otherwise(found)
    return found


def topic(message: Column, of: Column) -> Column:
    """The message without its intent's words, polite openings and closing marks; at most 200 characters."""
    out = F.trim(message)
    for name, words in INTENTS:
        stripped = out
        for word in words:
            stripped = F.regexp_replace(stripped, f"(?i){word}", " ")
        out = F.when(of == name, stripped).otherwise(out)
    out = F.regexp_replace(F.regexp_replace(out, r"^(?:请|帮我|给我|关于)\s*", ""), r"\s*一下$", "")
    out = F.btrim(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit("，。！？?：: "))
    return F.substring(F.when(out == "", "本次学习内容").otherwise(out), 1, 200)


def q_tutor_route(spark, sf_dir):
    """Intent, topic and route of every message, quiz words put before every third turn."""
    asked = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Quiz "), F.col("text"))).otherwise(F.col("text"))
    found = read(spark, sf_dir, "conversations").select("conv_id", "turn", asked.alias("text")).withColumn("intent", intent(F.col("text")))
    found = found.withColumn("topic", topic(F.col("text"), F.col("intent")))
    return found.select("conv_id", "turn", "intent", F.sha2("topic", 256).alias("topic_digest"), F.when(F.col("intent") == "summary", "session_summary").otherwise("retrieve").alias("route"))


def q_goal_truncate(spark, sf_dir):
    goal = F.col("text")
    short = F.when(F.length(goal) <= 60, goal).otherwise(F.concat(F.substring(goal, 1, 57), F.lit("...")))
    return read(spark, sf_dir, "benchmark").select("item_id", short.alias("goal"))


def q_log_projection(spark, sf_dir):
    """What a log keeps of an event: fixed columns, one line, at most 80 characters."""
    safe = F.left(F.trim(F.translate("props", "\r\n\t", "   ")), F.lit(80))
    return read(spark, sf_dir, "events").select("event_id", F.left("event_type", F.lit(80)).alias("event"), safe.alias("detail"), F.expr("get_json_object(props, '$.k')").cast("long").alias("k"))


def status_category(status: Column) -> Column:
    return (
        F.when(status < 400, F.lit(None)).when(status == 422, "request_validation").when(status == 429, "rate_limited").when(status == 502, "rag_processing")
        .when(status == 503, "rag_unavailable").when(status < 500, "client_error").otherwise("server_error")
    )


def _status() -> Column:
    return F.element_at(F.array(*map(F.lit, (200, 204, 404, 422, 429, 500, 502, 503))), (F.col("event_id") % 8 + 1).cast("int"))


def q_status_category(spark, sf_dir):
    found = read(spark, sf_dir, "events").select(_status().alias("status")).withColumn("category", F.coalesce(status_category(F.col("status")), F.lit("none")))
    return found.groupBy("status", "category").agg(F.count("*").alias("n"))


def q_request_log_validate(spark, sf_dir):
    ok = F.col("event_type").isNotNull() & F.col("ts").isNotNull() & (F.col("value") >= 0) & F.col("props").rlike(r'^\{"k": \d+\}$')
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum((~F.coalesce(ok, F.lit(False))).cast("int")).alias("n_bad"))


def q_runtime_metrics(spark, sf_dir):
    """Totals, rates to four places and averages to two, half to even; distinct names in order."""
    failed = status_category(_status()).isNotNull().cast("int")
    found = read(spark, sf_dir, "events").withColumn("failed", failed).withColumn("ms", F.floor(F.col("value")).cast("long"))
    return found.groupBy("event_type").agg(
        F.count("*").alias("total"), F.sum("failed").alias("failed"), F.bround(F.sum("failed") / F.count("*"), 4).alias("failure_rate"),
        F.bround(F.sum("ms") / F.count("*"), 2).alias("mean_ms"), F.sum("ms").alias("sum_ms"), F.count_distinct("user_id").alias("n_users"),
    )


def q_owner_scope(spark, sf_dir):
    """Orders joined with their owners, those in credit only, summed by segment."""
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    found = orders.join(customers.filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"))
    return found.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("o_custkey").alias("n_owners"))


def limited(events: DataFrame, window_seconds: float, most: int) -> DataFrame:
    """key, at, event_id, accepted and retry_after of calls (key, at in seconds, event_id) under a rolling window.

    Only accepted calls count, so each decision depends on those before it: the calls of a key come in order, in Arrow
    batches of a sorted stream, and the state is the accepted times of one window, at most `most` of them.
    """

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times = None, []
        for batch in batches:
            out = []
            for k, at, event_id in zip(batch["key"], batch["at"], batch["event_id"], strict=True):
                if k != key:
                    key, times = k, []
                while times and times[0] <= at - window_seconds:
                    times.pop(0)
                if len(times) >= most:
                    out.append((k, at, event_id, False, max(1, ceil(times[0] + window_seconds - at))))
                else:
                    times.append(at)
                    out.append((k, at, event_id, True, None))
            yield pd.DataFrame(out, columns=["key", "at", "event_id", "accepted", "retry_after"]).astype({"retry_after": "Int64"})

    ordered = events.select("key", "at", "event_id").repartition("key").sortWithinPartitions("key", "at", "event_id")
    return ordered.mapInPandas(decide, f"key {events.schema['key'].dataType.simpleString()}, at double, event_id long, accepted boolean, retry_after long")


def q_rolling_limiter(spark, sf_dir):
    """Each user's calls, at most two in six hours."""
    calls = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_id")
    return limited(calls, 6 * 3600.0, 2).select(F.col("key").alias("user_id"), "event_id", "accepted", F.coalesce("retry_after", F.lit(0)).alias("retry_after"))


def q_job_state(spark, sf_dir):
    """The last event of each user and its running number: the current view of a job log."""
    found = read(spark, sf_dir, "events")
    last = F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id"))
    return found.groupBy("user_id").agg(last.alias("l"), F.count("*").alias("n_events")).select("user_id", F.col("l.event_type").alias("status"), F.col("l.event_id").alias("event_id"), "n_events")


# --- jobs: each user's events of three days are one job, submitted, claimed and ended by them ---


def _job_events(spark, sf_dir) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    event = F.when(F.col("event_type") == "signup", "submit").when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("click")
    job = F.col("user_id") * 10_000 + F.floor(at / (3 * 86_400)).cast("long")
    return read(spark, sf_dir, "events").select(job.alias("key"), at.alias("at"), "event_id", event.alias("event"))


def _jobs(spark, sf_dir) -> DataFrame:
    events = _job_events(spark, sf_dir)
    now = events.agg(F.coalesce(F.max("at"), F.lit(0.0))).first()[0]
    return jobs.states(events, jobs.JOBS, now)


def q_job_states(spark, sf_dir):
    """Every job's state at the time of the last event; pending ones expire after a day, those in processing fail after half of one."""
    progress = F.create_map(*[F.lit(x) for pair in jobs.PROGRESS.items() for x in pair])
    found = _jobs(spark, sf_dir)
    return found.select(F.col("key").alias("job_id"), "state", progress[F.col("state")].cast("int").alias("progress"), F.round("since", 3).alias("since"), F.round("created", 3).alias("created"), "n_taken", "n_ignored")


def q_next_pending(spark, sf_dir):
    """The job that each of ten queues takes next."""
    return jobs.next_pending(_jobs(spark, sf_dir).withColumn("queue", F.floor(F.col("key") / 10_000) % 10), "queue").select("queue", F.col("key").alias("job_id"), "n_pending")


def q_session_users(spark, sf_dir):
    """Sessions of a week that have not ended at the last event, of customers in credit; their owners with them."""
    events = read(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    now = events.agg(F.coalesce(F.max("at"), F.lit(0.0))).first()[0]
    sessions = events.filter("event_type = 'signup'").select("event_id", "user_id", (F.col("at") + 7 * 86_400).alias("expires_at"))
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("secret"))
    return jobs.valid_sessions(sessions, users, now).select("event_id", "user_id", "email", F.round("expires_at", 3).alias("expires_at"))


def canonical_url(url: Column) -> Column:
    """The url without default port, its host in lower case and at least a slash as path; null if it isn't a safe public one."""
    scheme, rest = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(.*)$", 1)
    netloc = F.regexp_extract(rest, r"^[^/?]*", 0)
    host, port = F.lower(F.regexp_extract(netloc, r"^(.*?)(?::(\d+))?$", 1)), F.regexp_extract(netloc, r":(\d+)$", 1)
    default = F.when(scheme == "http", "80").when(scheme == "https", "443")
    path, query = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), F.regexp_extract(rest, r"(\?.+)$", 1)
    ok = (
        (F.length(url) <= 2048) & (url == F.trim(url)) & ~F.contains(url, F.lit("\\")) & ~url.rlike(r"[\x00-\x1f\x7f]") & default.isNotNull() & (host != "")
        & ~F.contains(netloc, F.lit("@")) & ~F.contains(host, F.lit("%")) & ~url.rlike("#.") & ((port == "") | (port == default))
    )
    clean = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query)
    return F.when(ok, F.regexp_replace(clean, "#$", ""))


def q_url_canonical(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", canonical_url(F.col("url")).alias("canonical"))


def q_web_filename(spark, sf_dir):
    found = read(spark, sf_dir, "pages").select("page_id", canonical_url(F.regexp_replace("url", "#.*$", "")).alias("u"))
    host = F.regexp_extract("u", r"^https?://([^/?:]*)", 1)
    slug = F.left(F.btrim(F.regexp_replace(host, "[^a-z0-9]+", "-"), F.lit("-")), F.lit(50))
    name = F.concat(F.lit("web-"), F.when(slug == "", "web").otherwise(slug), F.lit("-"), F.left(F.sha2("u", 256), F.lit(12)), F.lit(".md"))
    return found.select("page_id", name.alias("filename"))


def q_html_title(spark, sf_dir):
    """The page's title, white space collapsed, at most 200 characters; its host where there is none."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        title = F.replace(title, F.lit(code), F.lit(char))
    return read(spark, sf_dir, "pages").select("page_id", F.when(title == "", F.regexp_extract("url", r"://([^/?#:]*)", 1)).otherwise(F.left(title, F.lit(200))).alias("title"))


def filename_problems(name: Column) -> Column:
    """Reasons against an upload's file name."""
    stem = F.upper(F.split_part(name, F.lit("."), F.lit(1)))
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    rules = (
        (F.coalesce(F.trim(name), F.lit("")) == "", "empty"), (name != F.trim(name), "outer_space"), (F.length(name) > 120, "too_long"),
        (name.rlike(r'[<>:"/\\|?*\x00-\x1f]') | name.endswith("."), "characters"), (stem.rlike("^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), "reserved"),
        (~suffix.isin(".txt", ".md", ".pdf", ".docx"), "suffix"),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), reason) for rule, reason in rules]))


def _uploads(spark, sf_dir):
    """Parts as uploads: their name with a suffix by their size."""
    suffix = F.element_at(F.array(*map(F.lit, (".txt", ".md", ".PDF", ".docx", ".exe", ""))), (F.col("p_partkey") % 6 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("text/plain", "text/markdown", "application/pdf", "application/zip", "application/octet-stream"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", suffix).alias("filename"), kind.alias("content_type"), F.col("p_size").cast("long").alias("size"))


def q_filename_rules(spark, sf_dir):
    return _uploads(spark, sf_dir).select("p_partkey", F.array_join(filename_problems(F.col("filename")), ",").alias("problems"))


def q_content_type_ok(spark, sf_dir):
    allowed = spark.createDataFrame(CONTENT_TYPES, "suffix string, content_type string").withColumn("ok", F.lit(True))
    found = _uploads(spark, sf_dir).withColumn("suffix", F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1)))
    found = found.join(F.broadcast(allowed), ["suffix", "content_type"], "left")  # a table of eleven fixed rows
    return found.groupBy("suffix").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("ok").cast("int"), F.lit(0))).alias("n_ok"))


def q_stage_batch(spark, sf_dir):
    """Uploads of a batch (a suffix) by name without regard to case, the first of each, and whether the batch fits its budget."""
    found = _uploads(spark, sf_dir).withColumn("batch", F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1)))
    first = found.groupBy("batch", F.lower("filename").alias("name")).agg(F.min_by("size", "p_partkey").alias("size"), F.count("*").alias("n"))
    return first.groupBy("batch").agg(F.count("*").alias("n_kept"), F.sum(F.col("n") - 1).alias("n_repeated"), F.sum("size").alias("size"), (F.sum("size") <= 5_000).alias("accepted"))


def q_manifest_compat(spark, sf_dir):
    """Each customer as an index manifest against the first of its nation: the fields that differ."""
    found = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.signum("c_acctbal").cast("int").alias("sign"))
    first = found.groupBy("c_nationkey").agg(F.min_by(F.struct("c_mktsegment", "sign"), "c_custkey").alias("m"))
    both = found.join(first, "c_nationkey")
    differing = F.array_compact(F.array(F.when(~F.col("c_mktsegment").eqNullSafe(F.col("m.c_mktsegment")), "segment"), F.when(~F.col("sign").eqNullSafe(F.col("m.sign")), "sign")))
    return both.select("c_custkey", F.array_join(differing, ",").alias("differing"), F.when(F.size(differing) == 0, "compatible").otherwise("error").alias("state"))


def q_pass_rate(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").groupBy("toxic").agg(F.bround(100 * F.avg("quality"), 2).alias("pass_rate"), F.count("*").alias("n"))
    return rows


def q_latency_summary(spark, sf_dir):
    v = F.col("value")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))


_UPLOADS_SQL = """upload as (select p_partkey, p_name || ['.txt', '.md', '.PDF', '.docx', '.exe', ''][p_partkey % 6 + 1] as filename,
  ['text/plain', 'text/markdown', 'application/pdf', 'application/zip', 'application/octet-stream'][p_partkey % 5 + 1] as content_type, p_size::bigint as size from part)"""
_STATUS_SQL = "[200, 204, 404, 422, 429, 500, 502, 503][event_id % 8 + 1]"
_CATEGORY_SQL = "case when s < 400 then null when s = 422 then 'request_validation' when s = 429 then 'rate_limited' when s = 502 then 'rag_processing' when s = 503 then 'rag_unavailable' when s < 500 then 'client_error' else 'server_error' end"
_URL_SQL = r"""case when not regexp_matches({0}, '#.') and regexp_matches({0}, '^https?://[^/?@%:]+(/|\?|$)') then regexp_replace(regexp_extract({0}, '^(https?://)', 1) || lower(regexp_extract({0}, '^https?://([^/?]*)', 1))
  || case when regexp_extract({0}, '^https?://[^/?]*([^?]*)', 1) = '' then '/' else regexp_extract({0}, '^https?://[^/?]*([^?]*)', 1) end || regexp_extract({0}, '(\?.+)$', 1), '#$', '') end"""
_TYPES_SQL = " or ".join(f"(suffix = '{s}' and content_type = '{t}')" for s, t in CONTENT_TYPES)

_JOBS_SQL = """event as (select user_id * 10000 + floor(epoch_us(ts) / 1e6 / 259200)::bigint as key, epoch_us(ts) / 1e6::double as t, event_id,
  case event_type when 'signup' then 'submit' when 'view' then 'claim' when 'purchase' then 'complete' when 'error' then 'fail' else 'click' end as e from events where user_id is not null),
placed as (select *, row_number() over (partition by key order by t, event_id) as k, max(t) over () as now from event),
walk as (select key, 0::bigint as k, ''::varchar as s, null::double as since, null::double as created, 0::bigint as taken, 0::bigint as ignored from placed where k = 1
  union all select key, k, coalesce(m, s2) as s, case when m is null then since2 else t end, case when m is null then created else coalesce(created, t) end, taken + (m is not null)::int, ignored + (m is null)::int
  from (select *, case when s2 = '' and e = 'submit' then 'pending' when s2 = 'pending' and e = 'claim' then 'processing' when s2 = 'processing' and e = 'complete' then 'completed' when s2 = 'processing' and e = 'fail' then 'failed' end as m
    from (select p.key, p.k, p.t, p.e, w.created, w.taken, w.ignored, case when w.s = 'pending' and w.since + 86400 <= p.t then 'expired' when w.s = 'processing' and w.since + 43200 <= p.t then 'failed' else w.s end as s2,
      case when w.s = 'pending' and w.since + 86400 <= p.t then w.since + 86400 when w.s = 'processing' and w.since + 43200 <= p.t then w.since + 43200 else w.since end as since2
      from walk w join placed p on p.key = w.key and p.k = w.k + 1) x) y),
last as (select key, arg_max({'s': s, 'since': since, 'created': created, 'taken': taken, 'ignored': ignored}, k) as x from walk group by key),
job as (select key, case when x.s = 'pending' and x.since + 86400 <= now then 'expired' when x.s = 'processing' and x.since + 43200 <= now then 'failed' else nullif(x.s, '') end as state,
  case when x.s = 'pending' and x.since + 86400 <= now then x.since + 86400 when x.s = 'processing' and x.since + 43200 <= now then x.since + 43200 else x.since end as since, x.created as created, x.taken as n_taken, x.ignored as n_ignored from last, (select max(t) as now from event))"""

QUERIES = {
    "job_states": (
        q_job_states,
        f"""with recursive {_JOBS_SQL} select key as job_id, state, case state when 'pending' then 0 when 'expired' then 0 when 'completed' then 100 when 'processing' then 10 when 'failed' then 10 end::int as progress,
          round(since, 3) as since, round(created, 3) as created, n_taken, n_ignored from job""",
    ),
    "next_pending": (q_next_pending, f"with recursive {_JOBS_SQL} select key // 10000 % 10 as queue, arg_min(key, (created, key)) as job_id, count(*) as n_pending from job where state = 'pending' group by 1"),
    "session_users": (
        q_session_users,
        """with s as (select event_id, user_id, epoch_us(ts) / 1e6::double + 604800 as expires_at from events where event_type = 'signup'), n as (select max(epoch_us(ts) / 1e6::double) as now from events)
        select event_id, user_id, c_name as email, round(expires_at, 3) as expires_at from s join customer on c_custkey = user_id, n where expires_at > now and c_acctbal > 0 and c_name is not null and c_mktsegment is not null""",
    ),
    "latest_messages": (q_latest_messages, "select conv_id, turn, role, back::int as back from (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations) where back <= 6"),
    "bounded_history": (
        q_bounded_history,
        """with l as (select *, row_number() over (partition by conv_id order by turn desc) as back, substr(text, 1, 400) as content from conversations),
        b as (select *, 900 - coalesce(sum(length(content)) over (partition by conv_id order by back rows between unbounded preceding and 1 preceding), 0) as rest from l where back <= 5),
        k as (select conv_id, turn, case when length(content) > rest then right(content, rest::bigint) else content end as content from b where rest > 0 and length(content) > 0)
        select conv_id, turn, length(content)::bigint as n_chars, sha256(content) as digest from k""",
    ),
    "append_exchange": (q_append_exchange, "with l as (select conv_id, coalesce(max(turn), 0) as last from conversations group by conv_id) select conv_id, last + 1 as message_order, 'user' as role from l union all select conv_id, last + 2, 'tutor' from l"),
    "next_message_order": (q_next_message_order, "select conv_id, coalesce(max(turn), 0) + 1 as next_order, count(*) as n_messages from conversations group by conv_id"),
    "tutor_route": (
        q_tutor_route,
        r"""with a as (select conv_id, turn, case when turn % 3 = 0 then 'Quiz ' || text else text end as t from conversations),
        i as (select *, case when contains(lower(t), 'quiz') then 'quiz' else 'knowledge_qa' end as intent from a),
        p as (select *, trim(regexp_replace(case when intent = 'quiz' then regexp_replace(trim(t), 'quiz', ' ', 'gi') else trim(t) end, '\s+', ' ', 'g')) as x from i)
        select conv_id, turn, intent, sha256(substr(case when trim(x, '，。！？?：: ') = '' then '本次学习内容' else trim(x, '，。！？?：: ') end, 1, 200)) as topic_digest, 'retrieve' as route from p""",
    ),
    "goal_truncate": (q_goal_truncate, "select item_id, case when length(text) <= 60 then text else substr(text, 1, 57) || '...' end as goal from benchmark"),
    "log_projection": (q_log_projection, "select event_id, left(event_type, 80) as event, left(trim(translate(props, chr(13) || chr(10) || chr(9), '   ')), 80) as detail, json_extract_string(props, '$.k')::bigint as k from events"),
    "status_category": (q_status_category, f"with e as (select {_STATUS_SQL} as s from events) select s::int as status, coalesce({_CATEGORY_SQL}, 'none') as category, count(*) as n from e group by 1, 2"),
    "request_log_validate": (
        q_request_log_validate,
        r"""select event_type, count(*) as n, sum((not coalesce(event_type is not null and ts is not null and value >= 0 and regexp_matches(props, '^\{"k": \d+\}$'), false))::int)::bigint as n_bad from events group by event_type""",
    ),
    "runtime_metrics": (
        q_runtime_metrics,
        f"""with e as (select *, ({_STATUS_SQL} >= 400)::int as f, floor(value)::bigint as ms from events)
        select event_type, count(*) as total, sum(f)::bigint as failed, round_even(sum(f) / count(*), 4) as failure_rate, round_even(sum(ms) / count(*), 2) as mean_ms, sum(ms)::bigint as sum_ms, count(distinct user_id) as n_users from e group by event_type""",
    ),
    "owner_scope": (q_owner_scope, "select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total, count(distinct o_custkey) as n_owners from orders join customer on o_custkey = c_custkey where c_acctbal > 0 group by c_mktsegment"),
    "rolling_limiter": (
        q_rolling_limiter,
        """with recursive call as (select user_id, event_id, epoch_us(ts) / 1e6::double as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
        walk as (select user_id, 0::bigint as k, null::bigint as event_id, null::double as a, null::double as b, false as accepted, 0::bigint as retry_after from call where k = 1
          union all select user_id, k, event_id, case when full_ then a else b end, case when full_ then b else t end, not full_, case when full_ then greatest(1, ceil(a + 21600 - t))::bigint else 0 end
          from (select c.*, w.a, w.b, coalesce(w.a > c.t - 21600 and w.b > c.t - 21600, false) as full_ from walk w join call c on c.user_id = w.user_id and c.k = w.k + 1) x)
        select user_id, event_id, accepted, retry_after from walk where k > 0""",
    ),
    "job_state": (q_job_state, "select user_id, arg_max(event_type, (ts, event_id)) as status, arg_max(event_id, (ts, event_id)) as event_id, count(*) as n_events from events group by user_id"),
    "url_canonical": (q_url_canonical, f"select page_id, {_URL_SQL.format('url')} as canonical from pages"),
    "web_filename": (
        q_web_filename,
        f"""with b as (select page_id, regexp_replace(url, '#.*$', '') as url from pages), u as (select page_id, {_URL_SQL.format("url")} as u from b),
        s as (select *, left(trim(regexp_replace(regexp_extract(u, '^https?://([^/?:]*)', 1), '[^a-z0-9]+', '-', 'g'), '-'), 50) as slug from u)
        select page_id, 'web-' || case when slug = '' then 'web' else slug end || '-' || left(sha256(u), 12) || '.md' as filename from s""",
    ),
    "html_title": (
        q_html_title,
        r"""with t as (select page_id, url, replace(replace(replace(replace(replace(trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as t from pages)
        select page_id, case when t = '' then regexp_extract(url, '://([^/?#:]*)', 1) else left(t, 200) end as title from t""",
    ),
    "filename_rules": (
        q_filename_rules,
        f"""with {_UPLOADS_SQL} select p_partkey, array_to_string(list_filter([case when trim(filename) = '' then 'empty' end, case when filename <> trim(filename) then 'outer_space' end, case when length(filename) > 120 then 'too_long' end,
          case when regexp_matches(filename, '[<>:"/\\\\|?*\\x00-\\x1f]') or ends_with(filename, '.') then 'characters' end,
          case when regexp_matches(upper(split_part(filename, '.', 1)), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') then 'reserved' end,
          case when lower(regexp_extract(filename, '(\\.[^.]*)$', 1)) not in ('.txt', '.md', '.pdf', '.docx') then 'suffix' end], lambda x: x is not null), ',') as problems from upload""",
    ),
    "content_type_ok": (q_content_type_ok, f"with {_UPLOADS_SQL}, s as (select *, lower(regexp_extract(filename, '(\\.[^.]*)$', 1)) as suffix from upload) select suffix, count(*) as n, sum(({_TYPES_SQL})::int)::bigint as n_ok from s group by suffix"),
    "stage_batch": (
        q_stage_batch,
        f"""with {_UPLOADS_SQL}, f as (select lower(regexp_extract(filename, '(\\.[^.]*)$', 1)) as batch, lower(filename) as name, arg_min(size, p_partkey) as size, count(*) as n from upload group by 1, 2)
        select batch, count(*) as n_kept, sum(n - 1)::bigint as n_repeated, sum(size)::bigint as size, sum(size) <= 5000 as accepted from f group by batch""",
    ),
    "manifest_compat": (
        q_manifest_compat,
        """with c as (select c_custkey, c_nationkey, c_mktsegment, sign(c_acctbal)::int as s from customer), f as (select c_nationkey, arg_min(c_mktsegment, c_custkey) as m, arg_min(s, c_custkey) as ms from c group by 1),
        d as (select c_custkey, list_filter([case when c_mktsegment is distinct from m then 'segment' end, case when s is distinct from ms then 'sign' end], lambda x: x is not null) as l from c join f using (c_nationkey))
        select c_custkey, array_to_string(l, ',') as differing, case when len(l) = 0 then 'compatible' else 'error' end as state from d""",
    ),
    "pass_rate": (q_pass_rate, "select toxic, round_even(100 * avg(quality), 2) as pass_rate, count(*) as n from labels group by toxic"),
    "latency_summary": (q_latency_summary, "select event_type, round(sum(value), 4) as total, round(avg(value), 6) as mean, min(value) as least, max(value) as most from events group by event_type"),
}
