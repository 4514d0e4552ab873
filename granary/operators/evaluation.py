"""Evaluation of ranked lists against gold: metrics, diagnosis, comparison of two arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import retrieval as R

CUTS = (1, 3, 5, 10)


def judged(ranked: DataFrame, gold: DataFrame, key: str = "vec_id") -> DataFrame:
    """ranked (qid, key, rank) with is_gold and the question's gold_count; questions without gold have a count of 0."""
    marks = gold.select("qid", key).distinct().withColumn("is_gold", F.lit(True))
    sizes = gold.groupBy("qid").agg(F.count_distinct(key).alias("gold_count"))
    return ranked.join(marks, ["qid", key], "left").join(sizes, "qid", "left").withColumns({"is_gold": F.coalesce("is_gold", F.lit(False)), "gold_count": F.coalesce("gold_count", F.lit(0))})


def recall(k: int) -> Column:
    """Recall at k; null without gold."""
    hits = F.sum((F.col("is_gold") & (F.col("rank") <= k)).cast("int"))
    return F.round(F.try_divide(hits, F.first("gold_count")), 6)


def reciprocal_rank() -> Column:
    best = F.min(F.when(F.col("is_gold"), F.col("rank")))
    return F.when(F.first("gold_count") > 0, F.round(F.coalesce(1 / best, F.lit(0.0)), 6))


def ndcg(k: int = 5) -> Column:
    gain = F.sum(F.when(F.col("is_gold") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    most = F.least(F.first("gold_count").cast("int"), F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return F.when(most > 0, F.round(gain / ideal, 6))


def precision() -> Column:
    """Distinct gold hits by list length for answerable questions; for others whether the list is empty."""
    hits = F.count_distinct(F.when(F.col("is_gold"), F.col("vec_id")))
    return F.when(F.first("gold_count") > 0, F.round(F.coalesce(F.try_divide(hits, F.count("vec_id")), F.lit(0.0)), 6)).otherwise((F.count("vec_id") == 0).cast("double"))


def case_metrics(rows: DataFrame) -> DataFrame:
    cuts = [recall(k).alias(f"recall_{k}") for k in CUTS]
    return rows.groupBy("qid").agg(*cuts, reciprocal_rank().alias("rr"), ndcg().alias("ndcg_5"), precision().alias("precision"), F.first("gold_count").cast("long").alias("gold_count"))


def gold_of(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("qid"), "vec_id")


def _arms(spark, sf_dir):
    gold = gold_of(spark, sf_dir)
    a = R.dense(spark, sf_dir)
    b = R.fused(a, R._labelled(spark, sf_dir), R.CANDIDATES, "vec_id")
    return judged(a.select("qid", "vec_id", "rank"), gold), judged(b.select("qid", "vec_id", "rank"), gold)


def q_case_metrics(spark, sf_dir):
    return case_metrics(_arms(spark, sf_dir)[0])


def q_metric_averages(spark, sf_dir):
    """Each metric averaged over the questions that have it, for both arms."""
    names = [*(f"recall_{k}" for k in CUTS), "rr", "ndcg_5", "precision"]
    parts = [case_metrics(rows).agg(*[F.round(F.avg(n), 6).alias(n) for n in names]).withColumn("arm", F.lit(arm)) for arm, rows in zip(("dense", "fused"), _arms(spark, sf_dir), strict=True)]
    return parts[0].unionByName(parts[1])


def diagnosis(raw: Column, kept: Column, seeds: Column, final: Column, answerable: Column) -> Column:
    """The first stage at which no gold is left; for unanswerable questions whether anything was given."""
    return (
        F.when(~answerable & (final > 0), "unanswerable_handling_failure")
        .when(~answerable, F.lit(None))
        .when(raw == 0, "recall_failure")
        .when(kept == 0, "filtering_failure")
        .when(seeds == 0, "ranking_failure")
        .when(final == 0, "context_construction_failure")
    )


def q_failure_diagnosis(spark, sf_dir):
    found = judged(R.dense(spark, sf_dir), gold_of(spark, sf_dir))
    hit = lambda c: F.sum((F.col("is_gold") & c).cast("int"))
    kept = F.col("score") >= R.THRESHOLD
    counts = found.groupBy("qid").agg(hit(F.lit(True)).alias("raw"), hit(kept).alias("kept"), hit(kept & (F.col("rank") <= R.LIMIT)).alias("seeds"), F.first("gold_count").alias("gold_count"))
    failure = diagnosis(F.col("raw"), F.col("kept"), F.col("seeds"), F.col("seeds"), F.col("gold_count") > 0)
    return counts.select("qid", "raw", "kept", "seeds", failure.alias("failure"))


def q_failure_counts(spark, sf_dir):
    return q_failure_diagnosis(spark, sf_dir).groupBy(F.coalesce("failure", F.lit("none")).alias("failure")).agg(F.count("*").alias("n"))


def outcome(before: Column, after: Column, answerable: Column) -> Column:
    """What an experiment's best gold rank makes of the baseline's."""
    return (
        F.when(~answerable, "unanswerable")
        .when(before.isNull() & after.isNotNull(), "added_recall")
        .when(before.isNotNull() & after.isNull(), "lost_recall")
        .when(before.isNull(), "unchanged_miss")
        .when(after < before, "ranking_improved")
        .when(after > before, "ranking_regressed")
        .otherwise("unchanged")
    )


def q_ab_hybrid(spark, sf_dir):
    a, b = _arms(spark, sf_dir)
    best = F.min(F.when(F.col("is_gold"), F.col("rank")))
    gold = lambda: F.sort_array(F.collect_set(F.when(F.col("is_gold"), F.col("vec_id"))))
    left = a.groupBy("qid").agg(best.alias("best_a"), gold().alias("gold_a"), recall(10).alias("recall_a"), F.first("gold_count").alias("gold_count"))
    right = b.groupBy("qid").agg(best.alias("best_b"), gold().alias("gold_b"), recall(10).alias("recall_b"))
    both = left.join(right, "qid", "full_outer")
    return both.select(
        "qid", F.coalesce("best_a", F.lit(0)).alias("best_a"), F.coalesce("best_b", F.lit(0)).alias("best_b"), outcome(F.col("best_a"), F.col("best_b"), F.col("gold_count") > 0).alias("outcome"), F.round(F.col("recall_b") - F.col("recall_a"), 6).alias("recall_delta"),
        F.size(F.array_except("gold_b", "gold_a")).cast("long").alias("n_gained"), F.size(F.array_except("gold_a", "gold_b")).cast("long").alias("n_lost"),
    )


def q_report_diff(spark, sf_dir):
    """Questions that have gold in the first place: newly failed, recovered, still failed, still passed, added or removed."""
    a, b = (case_metrics(rows).select("qid", (F.col("recall_1") >= 1e-9).alias("ok")) for rows in _arms(spark, sf_dir))
    both = a.withColumnRenamed("ok", "was").join(b, "qid", "full_outer")
    change = (
        F.when(F.col("was").isNull(), "added").when(F.col("ok").isNull(), "removed").when(F.col("was") & ~F.col("ok"), "newly_failed").when(~F.col("was") & F.col("ok"), "recovered").when(F.col("ok"), "still_passed").otherwise("still_failed")
    )
    return both.select("qid", change.alias("change"))


def q_context_diversity(spark, sf_dir):
    """Sources, distinct chunks, repeated share and characters of each question's context."""
    found = R._context(spark, sf_dir)
    return found.groupBy("qid").agg(
        F.count("*").alias("n_chunks"), F.count_distinct("source").alias("n_sources"), F.sum(F.length("content")).cast("long").alias("n_chars"),
        F.round(1 - F.count_distinct("content") / F.count("*"), 6).alias("repeated"),
    )


def q_context_sizes(spark, sf_dir):
    sizes = R.q_adjacent_context(spark, sf_dir).groupBy("qid").agg(F.count("*").alias("n"))
    return sizes.agg(F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("n_questions"))


def q_citation_validity(spark, sf_dir):
    """Answers cite S1, S3, S9 and S1 again: distinct ids in order, those in the context, and the valid share."""
    contexts = R.q_adjacent_context(spark, sf_dir).groupBy("qid").agg(F.sort_array(F.collect_set(F.concat(F.lit("S"), F.col("position").cast("string")))).alias("known"))
    cited = citations(F.concat(F.lit("Answer [S1][S3], also [S9] and [S1] "), F.col("qid").cast("string")))
    found = contexts.withColumn("cited", cited)
    valid = F.array_intersect("cited", "known")
    return found.select(
        "qid", F.array_join("cited", ",").alias("cited"), F.array_join(valid, ",").alias("valid"), F.array_join(F.array_except("cited", "known"), ",").alias("invalid"),
        F.round(F.try_divide(F.size(valid), F.size("cited")), 6).alias("valid_share"),
    )


def citations(answer: Column) -> Column:
    """Distinct ids cited as [S1], in order of first sight."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(S[0-9]+)\]"), F.lit(1)))


def q_unresolved_gold(spark, sf_dir):
    """Gold vectors that no arm's list holds, counted by question."""
    a, b = _arms(spark, sf_dir)
    found = a.select("qid", "vec_id").union(b.select("qid", "vec_id")).distinct()
    return gold_of(spark, sf_dir).join(found, ["qid", "vec_id"], "left_anti").groupBy("qid").agg(F.count("*").alias("n_unresolved"))


def _metrics_sql(arm: str) -> str:
    return f"""(select qid, round(sum((is_gold and rank <= 1)::int) / any_value(gold_count), 6) as recall_1, round(sum((is_gold and rank <= 3)::int) / any_value(gold_count), 6) as recall_3,
      round(sum((is_gold and rank <= 5)::int) / any_value(gold_count), 6) as recall_5, round(sum((is_gold and rank <= 10)::int) / any_value(gold_count), 6) as recall_10,
      round(coalesce(1.0::double / min(rank) filter (is_gold), 0), 6) as rr,
      round(sum(case when is_gold and rank <= 5 then 1 / log2(rank + 1.0::double) else 0 end) / any_value((select sum(1 / log2(i + 1.0::double)) from unnest(range(1, least(gold_count, 5) + 1)) u(i))), 6) as ndcg_5,
      round(count(distinct case when is_gold then vec_id end) / count(*), 6) as precision, any_value(gold_count)::bigint as gold_count from {arm} group by qid)"""


ARMS_SQL = (
    f"{R.MEANS_SQL}, {R.GAP_SQL}"
    + """, gold_n as (select label as qid, count(*) as gold_count from embeddings group by label),
arm_a as (select d.qid, d.vec_id, d.rank, d.score, e.label = d.qid as is_gold, gold_count from dense d join embeddings e using (vec_id) join gold_n g on g.qid = d.qid),
arm_b as (select f.qid, f.vec_id, f.rank, e.label = f.qid as is_gold, gold_count from fused f join embeddings e using (vec_id) join gold_n g on g.qid = f.qid)"""
)
_NAMES = "round(avg(recall_1), 6) as recall_1, round(avg(recall_3), 6) as recall_3, round(avg(recall_5), 6) as recall_5, round(avg(recall_10), 6) as recall_10, round(avg(rr), 6) as rr, round(avg(ndcg_5), 6) as ndcg_5, round(avg(precision), 6) as precision"
_DIAGNOSED = """counted as (select qid, sum(is_gold::int) as raw, sum((is_gold and score >= 0.25)::int) as kept, sum((is_gold and score >= 0.25 and rank <= 3)::int) as seeds from arm_a group by qid),
diagnosed as (select qid, raw::bigint as raw, kept::bigint as kept, seeds::bigint as seeds, case when raw = 0 then 'recall_failure' when kept = 0 then 'filtering_failure' when seeds = 0 then 'ranking_failure' end as failure from counted)"""

QUERIES = {
    "case_metrics": (q_case_metrics, f"with {ARMS_SQL} select * from {_metrics_sql('arm_a')}"),
    "metric_averages": (q_metric_averages, f"with {ARMS_SQL} select {_NAMES}, 'dense' as arm from {_metrics_sql('arm_a')} union all select {_NAMES}, 'fused' from {_metrics_sql('arm_b')}"),
    "failure_diagnosis": (q_failure_diagnosis, f"with {ARMS_SQL}, {_DIAGNOSED} select * from diagnosed"),
    "failure_counts": (q_failure_counts, f"with {ARMS_SQL}, {_DIAGNOSED} select coalesce(failure, 'none') as failure, count(*) as n from diagnosed group by 1"),
    "ab_hybrid": (
        q_ab_hybrid,
        f"""with {ARMS_SQL},
        a as (select qid, min(rank) filter (is_gold) as best_a, list(vec_id) filter (is_gold) as gold_a, round(sum(is_gold::int) / any_value(gold_count), 6) as recall_a from arm_a group by qid),
        b as (select qid, min(rank) filter (is_gold) as best_b, list(vec_id) filter (is_gold) as gold_b, round(sum(is_gold::int) / any_value(gold_count), 6) as recall_b from arm_b group by qid)
        select qid, coalesce(a.best_a, 0)::int as best_a, coalesce(b.best_b, 0)::int as best_b, case when a.best_a is null and b.best_b is not null then 'added_recall' when a.best_a is not null and b.best_b is null then 'lost_recall'
          when a.best_a is null then 'unchanged_miss' when b.best_b < a.best_a then 'ranking_improved' when b.best_b > a.best_a then 'ranking_regressed' else 'unchanged' end as outcome,
          round(recall_b - recall_a, 6) as recall_delta,
          len(list_filter(coalesce(gold_b, []), lambda x: not list_contains(coalesce(gold_a, []), x)))::bigint as n_gained,
          len(list_filter(coalesce(gold_a, []), lambda x: not list_contains(coalesce(gold_b, []), x)))::bigint as n_lost from a full join b using (qid)""",
    ),
    "report_diff": (
        q_report_diff,
        f"""with {ARMS_SQL}, a as (select qid, bool_or(is_gold and rank = 1) as was from arm_a group by qid), b as (select qid, bool_or(is_gold and rank = 1) as ok from arm_b group by qid)
        select qid, case when was is null then 'added' when ok is null then 'removed' when was and not ok then 'newly_failed' when not was and ok then 'recovered' when ok then 'still_passed' else 'still_failed' end as change from a full join b using (qid)""",
    ),
    "unresolved_gold": (
        q_unresolved_gold,
        f"with {ARMS_SQL} select label as qid, count(*) as n_unresolved from embeddings e where not exists (select 1 from arm_a a where a.qid = e.label and a.vec_id = e.vec_id) and not exists (select 1 from arm_b b where b.qid = e.label and b.vec_id = e.vec_id) group by label",
    ),
    "context_diversity": (
        q_context_diversity,
        f"with {R._ADJ_SQL} select qid, count(*) as n_chunks, count(distinct source) as n_sources, sum(length(content))::bigint as n_chars, round(1 - count(distinct content) / count(*), 6) as repeated from adj join chunk using (source, chunk_index) group by qid",
    ),
    "context_sizes": (q_context_sizes, f"with {R._ADJ_SQL}, n as (select qid, count(*) as n from adj group by qid) select round(avg(n), 6) as mean, min(n) as least, max(n) as most, count(*) as n_questions from n"),
    "citation_validity": (
        q_citation_validity,
        f"""with {R._ADJ_SQL}, known as (select qid, list('S' || position) as known from adj group by qid), c as (select qid, known, ['S1', 'S3', 'S9'] as cited from known)
        select qid, array_to_string(cited, ',') as cited, array_to_string(list_filter(cited, lambda x: list_contains(known, x)), ',') as valid,
          array_to_string(list_filter(cited, lambda x: not list_contains(known, x)), ',') as invalid, round(len(list_filter(cited, lambda x: list_contains(known, x))) / 3, 6) as valid_share from c""",
    ),
}
