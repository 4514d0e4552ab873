"""The retrieval trace: one row a question that says where each candidate stood at every stage, and all that is read off it.

A trace is nested: candidates (one struct each, with its rank among all found, whether the threshold kept it, its rank
after the rerank and as a seed) and the final context (each chunk's place, role and seed). It holds no text, is written
once, and metrics, failures, comparisons and replays come from it alone.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators import chunks as C
from granary.operators import evidence as E
from granary.operators import evaluation as V
from granary.operators import retrieval as R
from granary.plans.shared import shared_dir, stored
from granary.sources import journal


@dataclass(frozen=True)
class Config:
    """Bounds of a retrieval: seeds, candidates, neighbours on each side, chunks and characters of the context."""

    limit: int = R.LIMIT
    candidates: int = R.CANDIDATES
    threshold: float = R.THRESHOLD
    adjacent: int = R.ADJACENT
    context_limit: int = R.CONTEXT_LIMIT
    budget: int | None = None

    def __post_init__(self) -> None:
        if self.limit <= 0 or self.candidates <= 0 or self.context_limit <= 0:
            raise ValueError("limits must be positive")
        if not 0 <= self.threshold <= 1:
            raise ValueError("the threshold must be from 0 to 1")
        if self.adjacent < 0 or self.budget is not None and self.budget < 0:
            raise ValueError("neighbours and budget must not be negative")


_CANDIDATE = ("raw_rank", "chunk_id", "source", "chunk_index", "score", "retained", "reason", "coverage", "combined", "rank_after", "seed_rank")
_CONTEXT = ("position", "chunk_id", "content_hash", "source", "chunk_index", "material_id", "role", "source_seed", "reason", "n_chars")


def traced(asked: DataFrame, raw: DataFrame, chunks: DataFrame, config: Config = Config()) -> DataFrame:
    """qid, answerable, candidates and context of each question of asked (qid, question, answerable).

    raw (qid, chunk_id, source, chunk_index, content, score, rank) is what the search found, chunks (source, chunk_index,
    content, material_id) the index. A question without candidates has empty arrays.
    """
    found = raw.filter(F.col("rank") <= max(config.limit, config.candidates)).withColumnRenamed("rank", "raw_rank").join(asked.select("qid", "question"), "qid")
    ranked = R.weighted_rerank(found.filter(F.col("score") >= config.threshold)).select("qid", "chunk_id", "coverage", "combined", F.col("rank").alias("rank_after"))
    staged = found.join(ranked, ["qid", "chunk_id"], "left").withColumns(
        {
            "retained": F.col("rank_after").isNotNull(),
            "reason": F.when(F.col("rank_after").isNotNull(), "vector_score_at_or_above_threshold").otherwise("vector_score_below_threshold"),
            "seed_rank": F.when(F.col("rank_after") <= config.limit, F.col("rank_after")),
        }
    )
    staged = stored(staged.select("qid", *_CANDIDATE), "candidates")  # the seeds, and what is grouped
    seeds = staged.filter("seed_rank is not null").select("qid", "chunk_id", "source", "chunk_index", F.col("seed_rank").alias("rank"))
    context = R.adjacent(seeds, chunks, config.adjacent, config.context_limit).select("qid", "source", "chunk_index", "role", "position")
    by = seeds.select("qid", "source", F.col("chunk_index").alias("seed_index"), F.col("chunk_id").alias("seed_id"), F.col("rank").alias("seed_rank"))
    beside = context.filter("role = 'adjacent'").join(by, ["qid", "source"]).filter(F.abs(F.col("chunk_index") - F.col("seed_index")).between(1, config.adjacent))
    beside = beside.groupBy("qid", "position").agg(F.min_by("seed_id", "seed_rank").alias("source_seed"))
    context = C.with_ids(context.join(chunks.select("source", "chunk_index", "content", "material_id"), ["source", "chunk_index"])).withColumn("n_chars", F.length("content").cast("long"))
    if config.budget is not None:
        context = context.join(R.within_budget(context.select("qid", "position", F.col("n_chars").alias("size")), config.budget).select("qid", "position"), ["qid", "position"])
    reason = F.when(F.col("role") == "seed", "hybrid_top_n").when(F.col("source_seed").isNotNull(), "same_source_adjacent_chunk").otherwise("adjacency_provenance_unresolved")
    context = context.join(beside, ["qid", "position"], "left").withColumn("reason", reason).withColumn("source_seed", F.when(F.col("role") == "seed", F.col("chunk_id")).otherwise(F.col("source_seed")))
    nested = lambda df, names, name: df.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(*names))).alias(name))
    out = asked.select("qid", "answerable").join(nested(staged, _CANDIDATE, "candidates"), "qid", "left").join(nested(context, _CONTEXT, "context"), "qid", "left")
    return out.withColumns({"candidates": F.coalesce("candidates", F.array()), "context": F.coalesce("context", F.array())})


def placements(trace: DataFrame) -> DataFrame:
    """qid, stage (raw, ranked, seed, final), chunk_id and rank: the trace, unpivoted once."""

    def at(array: str, stage: str, rank: str) -> Column:
        placed = F.filter(array, lambda x: x[rank].isNotNull())
        return F.transform(placed, lambda x: F.struct(F.lit(stage).alias("stage"), x["chunk_id"].alias("chunk_id"), x[rank].alias("rank")))

    stages = (("candidates", "raw", "raw_rank"), ("candidates", "ranked", "rank_after"), ("candidates", "seed", "seed_rank"), ("context", "final", "position"))
    return trace.select("qid", F.inline(F.concat(*[at(*x) for x in stages])))


METRICS = [f"{stage}_{name}" for stage in ("raw", "ranked") for name in (*(f"recall_{k}" for k in V.CUTS), "mrr", "ndcg_5")] + ["context_precision", "final_context_recall"]


def measured(trace: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, answerable, METRICS, failure, gold_count, n_context, n_sources, n_materials and n_chars of each question, for gold (qid, chunk_id).

    Measures that need gold are null without; precision counts an empty context as right where nothing can be answered.
    """
    marks = gold.select("qid", "chunk_id").distinct().withColumn("is_gold", F.lit(True))
    sizes = marks.groupBy("qid").agg(F.count("*").alias("gold_count"))
    placed = placements(trace).join(marks, ["qid", "chunk_id"], "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))
    of = lambda stage, k=None: (F.col("stage") == stage) & F.col("is_gold") & (F.lit(True) if k is None else F.col("rank") <= k)
    hits = lambda stage, k=None: F.count_distinct(F.when(of(stage, k), F.col("chunk_id")))
    found = {f"{s}_{k}": hits(s, k) for s in ("raw", "ranked") for k in V.CUTS}
    found |= {f"best_{s}": F.min(F.when(of(s), F.col("rank"))) for s in ("raw", "ranked")}
    found |= {f"gain_{s}": F.sum(F.when(of(s, 5), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)) for s in ("raw", "ranked")}
    found |= {s: hits(s) for s in ("raw", "ranked", "seed", "final")}
    counted = placed.groupBy("qid").agg(*[c.alias(n) for n, c in found.items()])
    rows = trace.join(sizes, "qid", "left").join(counted, "qid", "left")
    n = F.coalesce("gold_count", F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    with_gold = lambda c: F.round(F.when(n > 0, c), 6)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(5)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = {}
    for s in ("raw", "ranked"):
        out |= {f"{s}_recall_{k}": with_gold(zero(f"{s}_{k}") / n) for k in V.CUTS}
        out |= {f"{s}_mrr": with_gold(F.coalesce(1 / F.col(f"best_{s}"), F.lit(0.0))), f"{s}_ndcg_5": with_gold(zero(f"gain_{s}") / ideal)}
    size = F.size("context")
    out["context_precision"] = F.round(F.when(~F.col("answerable"), (size == 0).cast("double")).otherwise(F.coalesce(F.try_divide(zero("final"), size), F.lit(0.0))), 6)
    out["final_context_recall"] = with_gold(zero("final") / n)
    failure = V.diagnosis(zero("raw"), zero("ranked"), zero("seed"), F.when(F.col("answerable"), zero("final")).otherwise(size), F.col("answerable"))
    distinct = lambda name: F.size(F.array_distinct(F.transform("context", lambda x: x[name]))).cast("long")
    chars = F.aggregate("context", F.lit(0).cast("long"), lambda s, x: s + x["n_chars"])
    return rows.select(
        "qid", "answerable", *[c.alias(name) for name, c in out.items()], failure.alias("failure"), n.alias("gold_count"), size.cast("long").alias("n_context"),
        distinct("source").alias("n_sources"), distinct("material_id").alias("n_materials"), chars.alias("n_chars"),
    )


def averages(metrics: DataFrame) -> DataFrame:
    """metric and mean: every metric over the questions that have it, by one unpivot."""
    long = metrics.select("qid", *METRICS).unpivot("qid", METRICS, "metric", "value")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"))


def deltas(first: DataFrame, second: DataFrame) -> DataFrame:
    """metric, first, second and delta of two tables of averages; null where either has none."""
    return first.withColumnRenamed("mean", "first").join(second.withColumnRenamed("mean", "second"), "metric", "full_outer").withColumn("delta", F.round(F.col("second") - F.col("first"), 6))


def replayed(trace: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, position, role and the present chunk (source, chunk_index, content, chunk_id) of every context of a stored trace.

    A chunk that the index lacks, has twice, or has with another content than the trace saw is an error when its row is
    read: the join keeps every row of the trace, so no result can be complete without each of them.
    """
    wanted = trace.select("qid", F.inline("context")).select("qid", "position", "role", "chunk_id", F.col("content_hash").alias("seen_hash"), F.col("n_chars").alias("seen_chars"))
    current = chunks.groupBy("chunk_id").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("source", "chunk_index", "content", "content_hash")])
    both = wanted.join(current, "chunk_id", "left")
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{why}: chunk "), F.col("chunk_id"))).cast("string")
    changed = (F.col("content_hash") != F.col("seen_hash")) | (F.length("content") != F.col("seen_chars"))
    content = F.when(F.col("n").isNull(), fail("not in the index")).when(F.col("n") > 1, fail("more than once in the index")).when(changed, fail("changed since the trace")).otherwise(F.col("content"))
    return both.select("qid", "position", "role", "chunk_id", "source", "chunk_index", content.alias("content"))


def carried_over(answerable: Column, n_chunks: Column, recall: Column, before: Column) -> Column:
    """A replayed case's failure: the stored one stays, unless nothing of the gold is left and there was none."""
    return F.when(~answerable, F.when(n_chunks > 0, "unanswerable_handling_failure")).when(recall == 0, F.coalesce(before, F.lit("context_construction_failure"))).otherwise(before)


# --- queries: the benchmark asks, BM25 by its best score finds, the documents' passages of the benchmark are gold ---

TIGHT = 170  # characters: no whole chunk fits, only the shorter last ones of documents


def _traces(spark, sf_dir, *configs: Config) -> tuple[list[DataFrame], DataFrame]:
    """A stored trace for each config, over one search, and the gold (qid, chunk_id)."""
    gold, found = E.gold_chunks(spark, sf_dir), R._bm25(spark, sf_dir)
    pieces = stored(R.pieces(spark, sf_dir, found), "pieces")  # contexts hold chunks of the sources found only
    raw = stored(found.withColumn("score", F.round(F.col("bm25") / F.max("bm25").over(Window.partitionBy("qid")), 6)).drop("bm25"), "raw")
    answerable = gold.select("qid").distinct().withColumn("answerable", F.lit(True))
    asked = R.questions(spark, sf_dir).join(answerable, "qid", "left").withColumn("answerable", F.coalesce("answerable", F.lit(False)))
    ids = C.with_ids(gold.withColumn("material_id", C.material_id(F.col("source")))).select("qid", "chunk_id")
    return [stored(traced(asked, raw, pieces, config), "trace") for config in configs], stored(ids, "gold")


def q_retrieval_trace(spark, sf_dir):
    """Every chunk that a question's retrieval has seen, with its ranks at all stages and why it is in the context."""
    (trace,), _ = _traces(spark, sf_dir, Config())
    found = trace.select("qid", F.inline("candidates")).select("qid", "chunk_id", "raw_rank", "score", "retained", "coverage", "combined", "rank_after", "seed_rank")
    context = trace.select("qid", F.inline("context")).select("qid", "chunk_id", "position", "role", "source_seed", "reason", "n_chars")
    return found.join(context, ["qid", "chunk_id"], "full_outer")


def q_trace_metrics(spark, sf_dir):
    (trace,), gold = _traces(spark, sf_dir, Config())
    return measured(trace, gold)


def q_final_context_recall(spark, sf_dir):
    """Context and failure of each question with and without a tight budget."""
    traces, gold = _traces(spark, sf_dir, Config(), Config(budget=TIGHT))
    parts = [measured(t, gold).select(F.lit(arm).alias("arm"), "qid", "answerable", "context_precision", "final_context_recall", "failure", "n_context", "n_chars") for arm, t in zip(("wide", "tight"), traces, strict=True)]
    return parts[0].union(parts[1])


def q_metric_deltas(spark, sf_dir):
    """Each metric's mean of the wide and of the tight arm, and the difference."""
    traces, gold = _traces(spark, sf_dir, Config(), Config(budget=TIGHT))
    return deltas(*[averages(measured(t, gold)) for t in traces])


def q_empty_context_rate(spark, sf_dir):
    """Of the questions that nothing answers, how many get an empty context, in each arm; a threshold over the best score filters all."""
    traces, gold = _traces(spark, sf_dir, Config(), Config(budget=TIGHT), Config(budget=0))
    arms = [measured(t, gold).filter("not answerable").agg(F.lit(arm).alias("arm"), F.count("*").alias("n"), F.sum((F.col("n_context") == 0).cast("int")).alias("n_empty")) for arm, t in zip(("wide", "tight", "none"), traces, strict=True)]
    return arms[0].union(arms[1]).union(arms[2]).withColumn("rate", F.round(F.try_divide(F.col("n_empty"), F.col("n")), 6))


def q_context_replay(spark, sf_dir):
    """The stored contexts replayed with the selector: seeds and each seed's best neighbour, their measures and failures before and after."""
    (trace,), gold = _traces(spark, sf_dir, Config())
    chunks = C.with_ids(R.pieces(spark, sf_dir, trace.select(F.inline("context")).select("source")))  # an id stands for its source, too
    rows = replayed(trace, chunks).join(R.questions(spark, sf_dir), "qid")
    rows = rows.withColumn("coverage", R.coverage(R.terms(F.col("question")), F.col("content")))
    ranks = F.when(F.col("role") == "seed", F.col("position"))
    kept = R.selected(rows.withColumn("seed_rank", ranks)).select("qid", "position")
    after = trace.select("qid", F.inline("context")).join(kept, ["qid", "position"], "left_semi")
    nested = after.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(*_CONTEXT))).alias("context"))
    new = measured(trace.drop("context").join(nested, "qid", "left").withColumn("context", F.coalesce("context", F.array())), gold)
    names = ("context_precision", "final_context_recall", "n_context", "n_chars")
    both = measured(trace, gold).select("qid", "answerable", F.col("failure").alias("failure_before"), *[F.col(c).alias(f"{c}_before") for c in names]).join(new.select("qid", *names), "qid")
    failure = carried_over(F.col("answerable"), F.col("n_context"), F.col("final_context_recall"), F.col("failure_before"))
    return both.select("qid", *[f"{c}_before" for c in names], *names, "failure_before", failure.alias("failure"))


def q_run_journal(spark, sf_dir):
    """The wide arm's cases as a run of three parts: the second is tried twice, and an attempt of it was killed before its commit. The report of what is committed."""
    (trace,), gold = _traces(spark, sf_dir, Config())
    cases = stored(measured(trace, gold).withColumn("case_id", F.concat(F.lit("case-"), F.col("qid").cast("string"))), "cases")
    path = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    journal.begin(spark, path, {"evaluation_type": "retrieval"})
    for part in range(3):
        rows = cases.filter(F.col("qid") % 3 == part)
        if part == 1:
            rows.write.parquet(f"{path}/parts/1-killed")
        journal.append(path, part, rows)
        if part == 1:
            journal.append(path, part, rows)
    journal.complete(spark, path, "same", "same")
    return journal.report(spark, path, METRICS)


_TRACE_SQL = f"""{R.BM25_SQL}, {E.GOLD_SQL}, gold_id as (select qid, chunk_id from gold join chunk using (source, chunk_index)), gold_n as (select qid, count(*) as n from gold_id group by qid),
rel as (select *, round(bm25 / max(bm25) over (partition by qid), 6) as score from bm25),
raw as (select rel.qid, chunk_id, rel.rank as raw_rank, score, c.source, c.chunk_index, content, {R.TOKENS_SQL.format("b.text")} as want_terms from rel join chunk c using (chunk_id) join benchmark b on b.item_id = rel.qid),
covered as (select *, round({R._COVER_SQL.split(" as ts, ")[1].rsplit(" as ", 1)[0]}, 6) as coverage from raw where score >= 0.25),
combined as (select *, round((1 - 0.2::double) * score + 0.2::double * coverage, 6) as combined from covered),
ranked as (select *, row_number() over (partition by qid order by combined desc, score desc, raw_rank) as rank_after from combined),
seed as (select qid, source, chunk_index, chunk_id, rank_after as seed_rank from ranked where rank_after <= 3), {R._ADJACENT_SQL},
context as (select a.qid, a.position, c.chunk_id, c.source, c.material_id, case when late = 0 then 'seed' else 'adjacent' end as role, s.chunk_id as source_seed, length(c.content) as n_chars
  from adj a join chunk c using (source, chunk_index) join seed s on s.qid = a.qid and s.seed_rank = a.seed_rank),
walk as (select qid, 0::bigint as position, 0::bigint as used, false as kept from context where position = 1
  union all select w.qid, s.position, w.used + case when w.used + s.n_chars <= {TIGHT} then s.n_chars else 0 end, w.used + s.n_chars <= {TIGHT} from walk w join context s on s.qid = w.qid and s.position = w.position + 1),
arm_context as (select 'wide' as arm, * from context union all select 'tight', c.* from context c join walk w on w.qid = c.qid and w.position = c.position and w.kept),
asked as (select arm, item_id as qid, n is not null as answerable, coalesce(n, 0) as n from benchmark left join gold_n on qid = item_id, (values ('wide'), ('tight'), ('none')) a(arm)),
placed as (select arm, p.* from (select qid, 'raw' as stage, chunk_id, raw_rank as rank from raw union all select qid, 'ranked', chunk_id, rank_after from ranked union all select qid, 'seed', chunk_id, seed_rank from seed) p, (values ('wide'), ('tight'), ('none')) a(arm)
  union all select arm, qid, 'final', chunk_id, position from arm_context),
hit as (select p.*, g.chunk_id is not null as is_gold from placed p left join gold_id g using (qid, chunk_id)),
counted as (select arm, qid, {", ".join(f"count(distinct chunk_id) filter (stage = '{s}' and is_gold and rank <= {k}) as {s}_{k}" for s in ("raw", "ranked") for k in V.CUTS)},
  {", ".join(f"min(rank) filter (stage = '{s}' and is_gold) as best_{s}, coalesce(sum(1 / log2(rank + 1.0::double)) filter (stage = '{s}' and is_gold and rank <= 5), 0) as gain_{s}" for s in ("raw", "ranked"))},
  {", ".join(f"count(distinct chunk_id) filter (stage = '{s}' and is_gold) as hit_{s}" for s in ("raw", "ranked", "seed", "final"))} from hit group by arm, qid),
sized as (select arm, qid, count(*) as n_context, count(distinct source) as n_sources, count(distinct material_id) as n_materials, sum(n_chars)::bigint as n_chars from arm_context group by arm, qid),
joined as (select a.*, c.* exclude (arm, qid), coalesce(n_context, 0) as n_context, coalesce(n_sources, 0) as n_sources, coalesce(n_materials, 0) as n_materials, coalesce(n_chars, 0)::bigint as n_chars,
  (select sum(1 / log2(i + 1.0::double)) from unnest(range(1, least(a.n, 5) + 1)) u(i)) as ideal from asked a left join counted c using (arm, qid) left join sized using (arm, qid)),
measured as (select arm, qid, answerable, {", ".join(f"case when n > 0 then round(coalesce({s}_{k}, 0) / n, 6) end as {s}_recall_{k}" for s in ("raw", "ranked") for k in V.CUTS)},
  {", ".join(f"case when n > 0 then round(coalesce(1.0::double / best_{s}, 0), 6) end as {s}_mrr, case when n > 0 then round(coalesce(gain_{s}, 0) / ideal, 6) end as {s}_ndcg_5" for s in ("raw", "ranked"))},
  case when not answerable then (n_context = 0)::int::double else round(coalesce(hit_final / nullif(n_context, 0), 0), 6) end as context_precision, case when n > 0 then round(coalesce(hit_final, 0) / n, 6) end as final_context_recall,
  case when not answerable then case when n_context > 0 then 'unanswerable_handling_failure' end when coalesce(hit_raw, 0) = 0 then 'recall_failure' when hit_ranked = 0 then 'filtering_failure' when hit_seed = 0 then 'ranking_failure' when hit_final = 0 then 'context_construction_failure' end as failure,
  n as gold_count, n_context, n_sources, n_materials, n_chars from joined)"""
_MEANS_SQL = ", ".join(f"round(avg({m}), 6) as {m}" for m in METRICS)

QUERIES = {
    "retrieval_trace": (
        q_retrieval_trace,
        f"""with recursive {_TRACE_SQL} select coalesce(r.qid, c.qid) as qid, coalesce(r.chunk_id, c.chunk_id) as chunk_id, r.raw_rank::int as raw_rank, r.score, case when r.qid is not null then k.rank_after is not null end as retained, k.coverage, k.combined,
          k.rank_after::int as rank_after, (case when k.rank_after <= 3 then k.rank_after end)::int as seed_rank, c.position::int as position, c.role, c.source_seed, case c.role when 'seed' then 'hybrid_top_n' when 'adjacent' then 'same_source_adjacent_chunk' end as reason, c.n_chars
        from raw r left join ranked k using (qid, chunk_id) full join context c on c.qid = r.qid and c.chunk_id = r.chunk_id""",
    ),
    "trace_metrics": (q_trace_metrics, f"with recursive {_TRACE_SQL} select * exclude (arm) from measured where arm = 'wide'"),
    "final_context_recall": (q_final_context_recall, f"with recursive {_TRACE_SQL} select arm, qid, answerable, context_precision, final_context_recall, failure, n_context, n_chars from measured where arm <> 'none'"),
    "metric_deltas": (
        q_metric_deltas,
        f"""with recursive {_TRACE_SQL}, m as (select arm, {_MEANS_SQL} from measured group by arm), l as (unpivot m on {", ".join(METRICS)} into name metric value mean)
        select a.metric, a.mean as first, b.mean as second, round(b.mean - a.mean, 6) as delta from l a join l b on a.metric = b.metric and a.arm = 'wide' and b.arm = 'tight'""",
    ),
    "empty_context_rate": (
        q_empty_context_rate,
        f"with recursive {_TRACE_SQL} select arm, count(*) as n, count(*) filter (n_context = 0) as n_empty, round(count(*) filter (n_context = 0) / count(*), 6) as rate from measured where not answerable group by arm",
    ),
    "context_replay": (q_context_replay, None),
    "run_journal": (
        q_run_journal,
        f"""with recursive {_TRACE_SQL}, w as (select * from measured where arm = 'wide'), m as (select {_MEANS_SQL} from w)
        select 'metric' as kind, name, value from (unpivot m on {", ".join(METRICS)} into name name value value) union all select 'failure', failure, count(*)::double from w where failure is not null group by failure
        union all select 'total', 'cases', count(*)::double from w""",
    ),
}
