"""Conversations without quotes, in reply order, by linking quoted passages.

Quoted lines begin with one ``>`` per nesting level. Runs of lines of one level and
their single lines are normalised (lower case, single spaces) and hashed; so are
the own words of every message, whole and by line. A quote belongs to the latest
earlier message of its conversation with that hash. A message replies to the one
that most of its outermost linked quotes (by characters; then the later) belong to.
Quoted lines, and the attribution line before them, go from the text. Threads and
depths follow by pointer doubling, in as many rounds as the depth has bits.

Sorting a conversation by (thread, depth, turn) puts every reply after what it
replies to. No conversation is gathered: all steps are joins on (conversation, hash)
or (conversation, turn), windows over one quoted hash and partial aggregates.

Defined results: null or empty texts are empty messages; a message whose quotes link
to nothing starts a thread, as does one without quotes; several rows with one
(conv_id, turn) stay, and share links; rows with a null key link to nothing; extra
columns are ignored. All DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import stored, table

_MARKS = r"^\s*(?:>\s?)+"
_ATTRIBUTION = r"(?i)^\s*(?:on|am|le|el)\b.{0,200}\b(?:wrote|schrieb|écrit|a écrit|escribió)\b.{0,80}:\s*$"


def _norm(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def own_text(text: Column) -> Column:
    """text without quoted lines and the attribution lines right before them, trimmed."""
    lines = _lines(text)
    quoted = F.transform(lines, lambda x: x.rlike(_MARKS))
    kept = F.filter(
        F.transform(
            lines,
            lambda x, i: F.when(~F.get(quoted, i) & ~(F.coalesce(F.get(quoted, i + 1), F.lit(False)) & x.rlike(_ATTRIBUTION)), x),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(F.coalesce(text, F.lit("")).rlike("(?m)" + _MARKS), F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")).otherwise(F.coalesce(text, F.lit("")))


def _quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage: runs of quoted lines and their single lines."""
    lines = messages.filter(F.col("text").rlike("(?m)" + _MARKS)).select("conv_id", "turn", F.xxhash64("text").alias("body"), F.posexplode(_lines(F.col("text"))).alias("at", "line")).distinct()
    marks = F.regexp_extract("line", _MARKS, 0)
    lines = lines.withColumn("level", F.length(F.regexp_replace(marks, "[^>]", ""))).withColumn("passage", _norm(F.regexp_replace("line", _MARKS, "")))
    message = Window.partitionBy("conv_id", "turn", "body").orderBy("at")
    lines = lines.withColumn("run", F.sum((F.col("level") != F.lag("level", 1, -1).over(message)).cast("int")).over(message))
    lines = lines.filter("level > 0 and passage <> ''")
    runs = lines.groupBy("conv_id", "turn", "body", "level", "run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "passage"))), lambda x: x["passage"]), " ").alias("passage"))
    columns = ["conv_id", "turn", "level", "passage"]
    return lines.select(columns).union(runs.select(columns)).distinct()


def replies(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to of each message that quotes an earlier one."""
    keyed = messages.filter("conv_id is not null and turn is not null")
    quotes = stored(_quotes(keyed).select("conv_id", "turn", "level", F.xxhash64("passage").alias("h"), F.length("passage").alias("size")), "quotes")
    wanted = quotes.select("conv_id", "h").distinct()
    own = _norm(own_text(F.col("text")))
    passages = F.array_distinct(F.concat(F.array(own), F.transform(_lines(own_text(F.col("text"))), _norm)))
    sources = keyed.join(wanted.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.explode(passages).alias("p")).filter("p <> ''")
    sources = sources.select("conv_id", F.xxhash64("p").alias("h"), "turn").distinct().join(wanted, ["conv_id", "h"], "left_semi")
    none = F.lit(None)
    both = sources.select("conv_id", "h", "turn", F.lit(1).alias("kind"), F.col("turn").alias("source"), none.cast("int").alias("level"), none.cast("int").alias("size")).union(
        quotes.select("conv_id", "h", "turn", F.lit(0), none.cast(messages.schema["turn"].dataType), "level", "size")
    )
    # the quote stands before the sources of its own turn, so that only earlier ones count
    earlier = Window.partitionBy("conv_id", "h").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    linked = both.withColumn("source", F.last("source", ignorenulls=True).over(earlier)).filter("kind = 0 and source is not null")
    votes = linked.groupBy("conv_id", "turn", "level", "source").agg(F.sum("size").alias("size"))
    best = F.max_by("source", F.struct(-F.col("level"), F.col("size"), F.col("source")))
    return votes.groupBy("conv_id", "turn").agg(best.alias("reply_to"))


def threads(parents: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, thread (the turn at the root) and depth of each reply."""
    state = stored(parents.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = state.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("thread_up"), F.col("depth").alias("depth_up"))
        moved = state.join(up, (F.col("conv_id") == F.col("c")) & (F.col("thread") == F.col("t")), "left")
        if moved.filter("t is not null").isEmpty():
            return state
        state = stored(moved.select("conv_id", "turn", "reply_to", F.coalesce("thread_up", "thread").alias("thread"), (F.col("depth") + F.coalesce("depth_up", F.lit(0))).alias("depth")), "threads")


def conversations_in_reply_order(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), reply_to, thread, depth, n_quoted_lines and message of each row."""
    messages = messages.select("conv_id", "turn", "role", "text")
    links = threads(replies(messages))
    quoted = F.size(F.filter(_lines(F.col("text")), lambda x: x.rlike(_MARKS))).cast("long")
    clean = messages.select("conv_id", "turn", "role", own_text(F.col("text")).alias("text"), quoted.alias("n_quoted_lines"))
    out = clean.join(links, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "text", "reply_to",
        F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quoted_lines",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("text")).alias("message"),
    )


def op6_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations_in_reply_order(table(spark, sf_dir, "conversations"))


_Q = r"^\s*(?:>\s?)+"
OP6_SQL = rf"""
with recursive m as (
  select row_number() over () as row, conv_id, turn, role, coalesce(text, '') as t, string_split(coalesce(text, ''), chr(10)) as l from conversations),
own as (
  select *, len(list_filter(l, lambda x: regexp_matches(x, '{_Q}'))) as n_quoted,
    case when len(list_filter(l, lambda x: regexp_matches(x, '{_Q}'))) = 0 then t else
      regexp_replace(array_to_string(list_filter(l, lambda x, i: not regexp_matches(x, '{_Q}') and not (coalesce(regexp_matches(l[i + 1], '{_Q}'), false) and regexp_matches(x, '{_ATTRIBUTION}'))), chr(10)), '^\s+|\s+$', '', 'g') end as clean
  from m),
line as (select conv_id, turn, row, i, l[i] as x from m, unnest(range(1, len(l) + 1)) u(i) where len(list_filter(l, lambda x: regexp_matches(x, '{_Q}'))) > 0 and conv_id is not null and turn is not null),
level as (select *, length(regexp_replace(regexp_extract(x, '{_Q}'), '[^>]', '', 'g')) as lev, lower(trim(regexp_replace(regexp_replace(x, '{_Q}', ''), '\s+', ' ', 'g'))) as p from line),
changed as (select *, (lev <> coalesce(lag(lev) over (partition by row order by i), -1))::int as c from level),
run as (select *, sum(c) over (partition by row order by i) as r from changed),
quote as (
  select distinct conv_id, turn, lev, p from run where lev > 0 and p <> ''
  union select conv_id, turn, lev, string_agg(p, ' ' order by i) from run where lev > 0 and p <> '' group by row, conv_id, turn, lev, r),
source as (
  select distinct conv_id, turn, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) as p
  from (select conv_id, turn, unnest(list_append(string_split(clean, chr(10)), clean)) as x from own) where conv_id is not null and turn is not null),
vote as (select q.conv_id, q.turn, q.lev, q.p, max(s.turn) as s from quote q join source s on s.conv_id = q.conv_id and s.p = q.p and s.turn < q.turn group by all),
summed as (select conv_id, turn, lev, s, sum(length(p)) as size from vote group by all),
parent as (select conv_id, turn, arg_max(s, (-lev, size, s)) as reply_to from summed group by conv_id, turn),
walk as (
  select conv_id, turn, reply_to, reply_to as thread, 1::bigint as depth from parent
  union all select w.conv_id, w.turn, w.reply_to, p.reply_to, w.depth + 1 from walk w join parent p on p.conv_id = w.conv_id and p.turn = w.thread),
root as (select conv_id, turn, arg_max((reply_to, thread, depth), depth) as x from walk group by conv_id, turn)
select o.conv_id, o.turn, role, clean as text, x[1] as reply_to, coalesce(x[2], o.turn) as thread, coalesce(x[3], 0) as depth, n_quoted::bigint as n_quoted_lines,
  '<|' || coalesce(role, 'user') || '|>' || chr(10) || clean as message
from own o left join root r on r.conv_id = o.conv_id and r.turn = o.turn
"""
