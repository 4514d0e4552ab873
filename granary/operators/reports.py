"""End-to-end cases and reports: what an answer fails, at which layer, and what two reports can be compared for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import casefold, strip, tokens
from granary.operators import contracts as K
from granary.operators import evaluation as V
from granary.operators import evidence as E
from granary.operators import retrieval as R
from granary.operators import trace as T
from granary.operators.evidence import NO_EVIDENCE_ANSWER
from granary.plans.shared import stored

PLACES = "array<struct<source: string, chunk_index: int>>"
POOL = 20
#: The fields of a stored report, of both kinds.
REPORT = (
    "report_schema_version int, evaluation_type string, evaluation_dataset struct<file: string, version: string, dataset_version: string, sha256: string>, "
    "cases array<struct<id: string, passed: boolean, elapsed_ms: long>>, aggregate_metrics map<string, double>, "
    "per_case_results array<struct<case_id: string, failure_category: string, metrics: map<string, double>, trace: struct<latency_ms: map<string, double>>>>"
)


# --- cases: an answer's failures, and the layer that is to blame ---


def label(place: Column) -> Column:
    return F.format_string("[%s · 第 %d 段]", place["source"], place["chunk_index"])


def _failure(check: str, detail: Column | None = None) -> Column:
    return F.struct(F.lit(check).alias("check"), (F.lit("") if detail is None else detail).alias("detail"))


def judged_answers(cases: DataFrame) -> DataFrame:
    """cases (answer, should_refuse, retrieved, expected, terms) with failures (check, detail) in order, and passed.

    Where nothing can be answered, only a bare refusal without sources passes. Else the answer must not refuse, every
    expected place must be retrieved and its label cited, every term must occur without regard to case, and no formula
    markup may be left. A null answer is an empty one; null lists are empty.
    """
    filled = cases.withColumns(
        {
            "answer": F.coalesce("answer", F.lit("")), "should_refuse": F.coalesce("should_refuse", F.lit(False)), "retrieved": F.coalesce(F.col("retrieved").cast(PLACES), F.array().cast(PLACES)),
            "expected": F.coalesce(F.col("expected").cast(PLACES), F.array().cast(PLACES)), "terms": F.coalesce("terms", F.array().cast("array<string>")),
        }
    )
    filled = filled.withColumn("_low", casefold(F.col("answer"))).withColumn("_terms", F.transform("terms", lambda t: F.struct(t.alias("term"), casefold(t).alias("low"))))
    refused = F.col("answer") == NO_EVIDENCE_ANSWER
    if_so = lambda holds, *found: F.when(holds, found[0])
    kept = F.array_compact(F.array(if_so(~refused, _failure("answered_without_evidence")), if_so(F.size("retrieved") > 0, _failure("sources_with_refusal"))))
    place = lambda x: F.array(
        if_so(~F.array_contains("retrieved", x), _failure("source_not_retrieved", label(x))), if_so(~F.contains(F.col("answer"), label(x)), _failure("source_not_cited", label(x)))
    )
    absent = F.transform(F.filter("_terms", lambda t: ~F.contains(F.col("_low"), t["low"])), lambda t: _failure("term_missing", t["term"]))
    markup = F.contains("answer", F.lit("$")) | F.col("answer").rlike(r"\\[A-Za-z]+")
    answered = F.concat(
        F.array_compact(F.array(if_so(refused, _failure("wrongly_refused")))), F.array_compact(F.flatten(F.transform("expected", place))), absent, F.array_compact(F.array(if_so(markup, _failure("markup_left"))))
    )
    found = filled.withColumn("failures", F.when(F.col("should_refuse"), kept).otherwise(answered)).drop("_low", "_terms")
    return found.withColumn("passed", F.size("failures") == 0)


def layer(parsing_failed: Column, chunking_failed: Column, retrieval: Column, generation_failed: Column, citation_valid: Column, citation_support: Column) -> Column:
    """The first layer that failed; support that nobody has judged yet asks for a review and is never taken for granted."""
    no = lambda c: F.coalesce(~c, F.lit(False))
    return (
        F.when(parsing_failed, "parsing_failure").when(chunking_failed, "chunking_failure").when(retrieval.isNotNull(), retrieval).when(generation_failed, "generation_failure")
        .when(no(citation_valid) | no(citation_support), "citation_failure").when(citation_valid & citation_support.isNull(), "needs_manual_review")
    )


def arm_failure(answerable: Column, ranked: Column, seeds: Column, final: Column) -> Column:
    """As diagnosis, for arms that rank without a threshold: gold hits in the ranking, its first places and the context."""
    return V.diagnosis(ranked, ranked, seeds, final, answerable)


def pool_size(pool: int, dense: int, lexical: int) -> int:
    """A reranker's pool holds no more than both lists together."""
    if min(pool, dense, lexical) <= 0:
        raise ValueError("all limits must be positive")
    if pool > dense + lexical:
        raise ValueError("the reranker's pool exceeds the two lists together")
    return pool


# --- reports: read, checked, compared ---


@dataclass(frozen=True)
class Report:
    """head: one row (kind, file, version, sha256); cases: case_id, failure (null: passed), elapsed_ms, metrics."""

    head: DataFrame
    cases: DataFrame


def report_rules() -> list[K.Rule]:
    """What a stored report must have to be compared, as rules over the columns of REPORT."""
    version = F.coalesce("report_schema_version", F.lit(0))
    answers, retrieval = version == 1, version == 2
    every = lambda of, array, holds: K.implies(of & F.col(array).isNotNull(), F.forall(array, lambda x: F.coalesce(holds(x), F.lit(False))))
    ids = lambda of, array, name: K.implies(of & F.col(array).isNotNull(), K.distinct(F.transform(array, lambda x: x[name])))
    return [
        K.Rule("unknown_version", version.isin(1, 2)),
        K.Rule("missing_dataset", F.col("evaluation_dataset").isNotNull()),
        K.Rule("missing_cases", K.implies(answers, F.col("cases").isNotNull())),
        K.Rule("not_retrieval", K.implies(retrieval, F.col("evaluation_type") == "retrieval")),
        K.Rule("missing_results", K.implies(retrieval, F.col("per_case_results").isNotNull())),
        K.Rule("missing_metrics", K.implies(retrieval, F.col("aggregate_metrics").isNotNull())),
        K.Rule("malformed_case", every(answers, "cases", lambda x: (F.length(x["id"]) > 0) & x["passed"].isNotNull() & (x["elapsed_ms"] >= 0))),
        K.Rule("malformed_result", every(retrieval, "per_case_results", lambda x: (F.length(x["case_id"]) > 0) & x["metrics"].isNotNull() & x["trace"]["latency_ms"].isNotNull())),
        K.Rule("repeated_case", ids(answers, "cases", "id") & ids(retrieval, "per_case_results", "case_id")),
    ]


def read_reports(spark: SparkSession, *paths: str) -> DataFrame:
    """path and the columns of REPORT of JSON files, one report each; what is no JSON object has nulls only."""
    text = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", REPORT).alias("r"))
    return text.select("path", "r.*")


def report(spark: SparkSession, path: str) -> Report:
    """A stored report; reading one that breaks a rule is an error that names it."""
    row = K.checked(read_reports(spark, path), "path", report_rules())
    sound = F.col("path").isNotNull()  # what needs the path needs its check
    data = F.col("evaluation_dataset")
    head = row.select(F.when(sound & (F.col("report_schema_version") == 2), "retrieval").otherwise("answers").alias("kind"), data["file"].alias("file"), F.coalesce(data["version"], data["dataset_version"]).alias("version"), data["sha256"].alias("sha256"))
    metrics = F.create_map().cast("map<string, double>")
    plain = F.transform("cases", lambda x: F.struct(x["id"].alias("case_id"), F.when(~x["passed"], "failed").alias("failure"), x["elapsed_ms"].alias("elapsed_ms"), metrics.alias("metrics")))
    found = F.transform("per_case_results", lambda x: F.struct(x["case_id"].alias("case_id"), x["failure_category"].alias("failure"), x["trace"]["latency_ms"]["total_retrieval"].cast("long").alias("elapsed_ms"), x["metrics"].alias("metrics")))
    cases = row.select(F.inline(F.when(sound, F.when(F.col("report_schema_version") == 2, found).otherwise(plain))))
    return Report(head, cases)


def case_changes(first: Report, second: Report) -> DataFrame:
    """case_id, change, both failures, both times and their difference, and each metric's difference (null where either has none)."""
    side = lambda r, n: r.cases.select("case_id", F.struct("failure", "elapsed_ms", "metrics").alias(n))
    both = side(first, "a").join(side(second, "b"), "case_id", "full_outer")
    a, b = F.col("a.failure").isNotNull(), F.col("b.failure").isNotNull()
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~a & b, "newly_failed").when(a & ~b, "recovered").when(a, "still_failed").otherwise("still_passed")
    empty = F.create_map().cast("map<string, double>")
    deltas = F.map_zip_with(F.coalesce("a.metrics", empty), F.coalesce("b.metrics", empty), lambda _, x, y: F.round(y - x, 6))
    return both.select(
        "case_id", change.alias("change"), F.col("a.failure").alias("failure_before"), F.col("b.failure").alias("failure"), F.col("a.elapsed_ms").alias("ms_before"), F.col("b.elapsed_ms").alias("ms"),
        (F.col("b.elapsed_ms") - F.col("a.elapsed_ms")).alias("ms_delta"), deltas.alias("metric_deltas"),
    )


def summary(first: Report, second: Report) -> DataFrame:
    """One row: totals of both reports, their differences, and whether these mean anything: other data or other cases are a warning, another kind is an error."""
    changes = case_changes(first, second)
    n = lambda *names: F.count(F.when(F.col("change").isin(*names), 1))
    counts = changes.agg(
        F.lit(1).alias("one"), n("removed", "newly_failed", "recovered", "still_failed", "still_passed").alias("total_before"), n("added", "newly_failed", "recovered", "still_failed", "still_passed").alias("total"),
        F.count(F.when((F.col("change") != "added") & F.col("failure_before").isNull(), 1)).alias("passed_before"), F.count(F.when((F.col("change") != "removed") & F.col("failure").isNull(), 1)).alias("passed"),
        F.coalesce(F.sum("ms_before"), F.lit(0)).alias("ms_before"), F.coalesce(F.sum("ms"), F.lit(0)).alias("ms"), n("newly_failed").alias("newly_failed"), n("recovered").alias("recovered"), n("added").alias("added"), n("removed").alias("removed"),
    )
    side = lambda r, k: r.head.select(F.lit(k).alias("side"), "kind", "sha256")
    of = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    heads = side(first, 1).unionByName(side(second, 2)).agg(F.lit(1).alias("one"), *[of(k, c).alias(f"{c}_{k}") for k in (1, 2) for c in ("kind", "sha256")])
    mixed = F.raise_error(F.lit("a retrieval report and one of answers cannot be compared")).cast("boolean")
    same = F.when(F.col("kind_1") != F.col("kind_2"), mixed).otherwise(F.coalesce(F.col("sha256_1") == F.col("sha256_2"), F.lit(False)))
    cases = (F.col("added") == 0) & (F.col("removed") == 0)
    out = counts.join(heads, "one").withColumn("same_dataset", same).withColumn("same_cases", cases)
    warning = F.when(~F.col("same_dataset"), "other_dataset").when(~F.col("same_cases"), "other_cases")
    return out.select(
        "total_before", "total", "passed_before", "passed", (F.col("passed") - F.col("passed_before")).alias("passed_delta"), "ms_before", "ms", (F.col("ms") - F.col("ms_before")).alias("ms_delta"),
        "newly_failed", "recovered", "added", "removed", "same_dataset", "same_cases", (F.col("same_dataset") & F.col("same_cases")).alias("comparable"), warning.alias("warning"),
    )


# --- queries: the assistants' answers to the benchmark question of their conversation's number ---


def _asked(spark, sf_dir) -> DataFrame:
    """qid, expected places (the gold), required terms (the question's first two) and the context's places."""
    place = F.struct("source", "chunk_index")
    gold = E.gold_chunks(spark, sf_dir).groupBy("qid").agg(F.sort_array(F.collect_list(place)).cast(PLACES).alias("expected"))
    context = R.q_adjacent_context(spark, sf_dir).groupBy("qid").agg(F.collect_list(place).cast(PLACES).alias("retrieved"))
    terms = R.questions(spark, sf_dir).select("qid", F.slice(tokens(F.col("question")), 1, 2).alias("terms"))
    return terms.join(gold, "qid", "left").join(context, "qid", "left")


def _answered(spark, sf_dir) -> DataFrame:
    asked = _asked(spark, sf_dir).withColumnRenamed("qid", "conv_id")
    return E.answers(spark, sf_dir).join(asked, "conv_id", "left").withColumn("refused", E.final_state(F.col("answer"), F.lit(0)) == "refused")


def _cases(found: DataFrame, helped: bool = True) -> DataFrame:
    """Every answer as a case: those of even conversations name the expected labels, of every third the terms, of every fifth a formula, if helped."""
    every = lambda k, text: F.when((F.col("conv_id") % k == 0) & F.lit(helped), F.coalesce(text, F.lit(""))).otherwise(F.lit(""))
    more = F.concat(every(2, F.array_join(F.transform("expected", label), "")), every(3, F.concat(F.lit(" "), F.upper(F.array_join("terms", " ")))), every(5, F.lit(" $x$")))
    text = F.when(F.col("refused"), F.lit(NO_EVIDENCE_ANSWER)).otherwise(F.concat(strip(F.col("answer")), more))
    return judged_answers(found.withColumns({"answer": text, "should_refuse": F.col("expected").isNull(), "retrieved": F.when(~F.col("refused"), F.col("retrieved"))}))


def q_rag_case_checks(spark, sf_dir):
    told = F.array_join(F.transform("failures", lambda f: F.concat(f["check"], F.lit(":"), f["detail"])), "|")
    return _cases(_answered(spark, sf_dir)).select("conv_id", "turn", "should_refuse", "passed", F.size("failures").cast("long").alias("n_failures"), told.alias("failures"))


def q_e2e_diagnosis(spark, sf_dir):
    """The layer to blame for every answer. Parsing: the question has no text. Chunking: a document holds GOLD_WORDS words of it in a
    row, yet no chunk does. Citations: against the places of the stored context; support is judged for every fourth conversation, by its labels."""
    (trace,), gold = T._traces(spark, sf_dir, T.Config())
    asked = R.questions(spark, sf_dir)
    held = E.held(R.texts(spark, sf_dir), asked).withColumn("held", F.lit(True))
    measured = T.measured(trace, gold).select("qid", F.col("failure").alias("retrieval"), "gold_count", "n_context")
    cases = asked.join(measured, "qid").join(held, "qid", "left").withColumnRenamed("qid", "conv_id")
    found = E.answers(spark, sf_dir).join(cases, "conv_id")
    cited = F.array_distinct(F.regexp_extract_all("answer", F.lit(E.CITATION), F.lit(1)))
    valid = F.when(F.size(cited) > 0, F.forall(cited, lambda x: F.substring(x, 2, 20).cast("long").between(1, F.col("n_context"))))
    support = F.when(F.col("conv_id") % 4 == 0, F.length("answer") % 3 > 0)
    parsing = F.coalesce(F.length(strip(F.col("question"))) == 0, F.lit(True))
    chunking = F.coalesce("held", F.lit(False)) & (F.col("gold_count") == 0)
    found = found.withColumns({"chunking": chunking, "empty": F.length(strip(F.col("answer"))) == 0, "valid": valid, "support": support})
    return found.select("conv_id", "turn", layer(parsing, F.col("chunking"), F.col("retrieval"), F.col("empty"), F.col("valid"), F.col("support")).alias("failure"), "retrieval", "chunking", "empty", "valid", "support")


def _reports(spark, sf_dir) -> list[Report]:
    """Two runs of all cases, without and with help, each without a tenth of the conversations; an answer's length stands for its time."""
    out, found = [], stored(_answered(spark, sf_dir), "answered")
    for k, helped in enumerate((False, True)):
        cases = _cases(found, helped).filter(F.col("conv_id") % 10 != k)
        head = spark.range(1).select(F.lit("answers").alias("kind"), F.lit("benchmark").alias("file"), F.lit("1").alias("version"), F.lit("same").alias("sha256"))
        name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        failure = F.when(~F.col("passed"), F.element_at("failures", 1)["check"])
        out.append(Report(head, cases.select(name.alias("case_id"), failure.alias("failure"), F.length("answer").cast("long").alias("elapsed_ms"), F.create_map(F.lit("failures"), F.size("failures").cast("double")).alias("metrics"))))
    return out


def q_report_changes(spark, sf_dir):
    return case_changes(*_reports(spark, sf_dir)).withColumn("failures_delta", F.col("metric_deltas")["failures"]).drop("metric_deltas")


def q_report_summary(spark, sf_dir):
    return summary(*_reports(spark, sf_dir))


def q_abc_rerank(spark, sf_dir):
    """Three arms over one dense search: its list, fused with a second list, and the fused pool ordered by given scores (the
    smallest difference): best gold ranks, failures of each, and what each step makes of the best rank."""
    gold = V.gold_of(spark, sf_dir)
    a, second = R.dense(spark, sf_dir), R._labelled(spark, sf_dir)
    b = R.fused(a.filter(F.col("score") >= R.THRESHOLD), second, pool_size(POOL, R.CANDIDATES, R.CANDIDATES), "vec_id")
    given = R._labelled(spark, sf_dir, None).join(b.select("qid", "vec_id"), ["qid", "vec_id"], "left_semi").select("qid", "vec_id", (-F.col("gap")).alias("score"))
    c = R.reranked(b.select("qid", "vec_id", "rank"), given).select("qid", "vec_id", F.col("new_rank").alias("rank"))
    arms = [x.select(F.lit(n).alias("arm"), "qid", "vec_id", "rank") for n, x in zip("abc", (a, b, c), strict=True)]
    rows = V.judged(arms[0].union(arms[1]).union(arms[2]), gold)
    hits = lambda n, k: F.count(F.when((F.col("arm") == n) & F.col("is_gold") & (F.col("rank") <= k), 1))
    best = lambda n: F.min(F.when((F.col("arm") == n) & F.col("is_gold"), F.col("rank")))
    cols = [f(n).alias(f"{name}_{n}") for n in "abc" for name, f in (("best", best), ("ranked", lambda n: hits(n, 2 * R.CANDIDATES)), ("seeds", lambda n: hits(n, R.LIMIT)))]
    found = rows.groupBy("qid").agg(*cols, (F.max("gold_count") > 0).alias("answerable"))
    failure = lambda n: arm_failure(F.col("answerable"), F.col(f"ranked_{n}"), F.col(f"seeds_{n}"), F.col(f"seeds_{n}")).alias(f"failure_{n}")
    turn = lambda x, y: V.outcome(F.col(f"best_{x}"), F.col(f"best_{y}"), F.col("answerable")).alias(f"outcome_{x}{y}")
    return found.select("qid", *[f"best_{n}" for n in "abc"], *[failure(n) for n in "abc"], turn("a", "b"), turn("b", "c"))


_LABEL_OF = "'[' || x.s || ' · 第 ' || x.i || ' 段]'"
_CASE_SQL = f"""expected as (select qid, list({{'s': source, 'i': chunk_index::bigint}} order by source, chunk_index) as expected from gold group by qid),
retrieved as (select qid, list({{'s': source, 'i': chunk_index::bigint}}) as retrieved from adj group by qid),
wants as (select item_id as qid, {R.TOKENS_SQL.format("text")}[1:2] as terms from benchmark),
answered as (select a.*, expected, retrieved, terms, contains(answer, '{E.NO_EVIDENCE_TOKEN}') or contains(answer, '{NO_EVIDENCE_ANSWER}') as refused
  from answer a left join expected e on e.qid = conv_id left join retrieved r on r.qid = conv_id left join wants w on w.qid = conv_id),
case_ as (select *, case when refused then '{NO_EVIDENCE_ANSWER}' else trim(answer) || case when helped and conv_id % 2 = 0 then coalesce(array_to_string(list_transform(expected, lambda x: {_LABEL_OF}), ''), '') else '' end
  || case when helped and conv_id % 3 = 0 and terms is not null then ' ' || upper(array_to_string(terms, ' ')) else '' end || case when helped and conv_id % 5 = 0 then ' $x$' else '' end end as text from answered, (values (false), (true)) h(helped)),
judged as (select *, case when expected is null then list_filter([case when text <> '{NO_EVIDENCE_ANSWER}' then 'answered_without_evidence:' end, case when not refused and retrieved is not null then 'sources_with_refusal:' end], lambda x: x is not null)
  else list_concat(case when refused then ['wrongly_refused:'] else []::varchar[] end, list_filter(flatten(list_transform(expected, lambda x: [case when refused or not list_contains(coalesce(retrieved, []), x) then 'source_not_retrieved:' || {_LABEL_OF} end,
    case when not contains(text, {_LABEL_OF}) then 'source_not_cited:' || {_LABEL_OF} end])), lambda x: x is not null), list_transform(list_filter(terms, lambda t: not contains(replace(lower(text), 'ß', 'ss'), t)), lambda t: 'term_missing:' || t),
    case when contains(text, '$') or regexp_matches(text, '\\\\[A-Za-z]+') then ['markup_left:'] else []::varchar[] end) end as failures from case_)"""
_ANSWERS_SQL = E._ANSWER_SQL.split(",\nmark as")[0]
_JUDGED_SQL = f"{R._ADJ_SQL}, {E.GOLD_SQL}, {_ANSWERS_SQL}, {_CASE_SQL}"
_CHANGES_SQL = """report as (select helped, conv_id || '-' || turn as case_id, case when len(failures) > 0 then split_part(failures[1], ':', 1) end as failure, length(text) as ms, len(failures) as n from judged where conv_id % 10 <> helped::int),
a as (select * from report where not helped), b as (select * from report where helped),
changes as (select coalesce(a.case_id, b.case_id) as case_id, case when a.case_id is null then 'added' when b.case_id is null then 'removed' when a.failure is null and b.failure is not null then 'newly_failed' when a.failure is not null and b.failure is null then 'recovered'
  when a.failure is not null then 'still_failed' else 'still_passed' end as change, a.failure as failure_before, b.failure as failure, a.ms as ms_before, b.ms as ms, b.ms - a.ms as ms_delta, (b.n - a.n)::double as failures_delta from a full join b on a.case_id = b.case_id)"""
_OUTCOME = "case when best_{0} is null and best_{1} is not null then 'added_recall' when best_{0} is not null and best_{1} is null then 'lost_recall' when best_{0} is null then 'unchanged_miss' when best_{1} < best_{0} then 'ranking_improved' when best_{1} > best_{0} then 'ranking_regressed' else 'unchanged' end as outcome_{0}{1}"

QUERIES = {
    "rag_case_checks": (
        q_rag_case_checks,
        f"with {_JUDGED_SQL} select conv_id, turn, expected is null as should_refuse, len(failures) = 0 as passed, len(failures)::bigint as n_failures, array_to_string(failures, '|') as failures from judged where helped",
    ),
    "e2e_diagnosis": (
        q_e2e_diagnosis,
        f"""with recursive {T._TRACE_SQL}, {_ANSWERS_SQL}, doc_words as (select string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as w from documents),
        doc_run as (select distinct unnest(list_transform(range(1, greatest(len(w) - {E.GOLD_WORDS - 2}, 1)), lambda i: array_to_string(w[i:i + {E.GOLD_WORDS - 1}], ' '))) as run from doc_words),
        held as (select distinct qid from asked_run join doc_run using (run)),
        signal as (select conv_id, turn, trim(coalesce(b.text, '')) = '' as parsing, m.failure as retrieval, h.qid is not null and m.gold_count = 0 as chunking, trim(answer) = '' as empty, n_context, list_distinct(regexp_extract_all(answer, '\\[(S[0-9]+)\\]', 1)) as l,
          case when conv_id % 4 = 0 then length(answer) % 3 > 0 end as support from answer join benchmark b on item_id = conv_id join measured m on m.qid = conv_id and arm = 'wide' left join held h on h.qid = conv_id),
        s as (select *, case when len(l) > 0 then len(list_filter(l, lambda x: x[2:]::bigint not between 1 and n_context)) = 0 end as valid from signal)
        select conv_id, turn, case when parsing then 'parsing_failure' when chunking then 'chunking_failure' when retrieval is not null then retrieval when empty then 'generation_failure' when valid = false or support = false then 'citation_failure'
          when valid and support is null then 'needs_manual_review' end as failure, retrieval, chunking, empty, valid, support from s""",
    ),
    "report_changes": (q_report_changes, f"with {_JUDGED_SQL}, {_CHANGES_SQL} select * from changes"),
    "report_summary": (
        q_report_summary,
        f"""with {_JUDGED_SQL}, {_CHANGES_SQL}, n as (select count(*) filter (change <> 'added') as total_before, count(*) filter (change <> 'removed') as total, count(*) filter (change <> 'added' and failure_before is null) as passed_before,
          count(*) filter (change <> 'removed' and failure is null) as passed, coalesce(sum(ms_before), 0)::bigint as ms_before, coalesce(sum(ms), 0)::bigint as ms, count(*) filter (change = 'newly_failed') as newly_failed,
          count(*) filter (change = 'recovered') as recovered, count(*) filter (change = 'added') as added, count(*) filter (change = 'removed') as removed from changes)
        select *, passed - passed_before as passed_delta, ms - ms_before as ms_delta, true as same_dataset, added = 0 and removed = 0 as same_cases, added = 0 and removed = 0 as comparable, case when added > 0 or removed > 0 then 'other_cases' end as warning from n""",
    ),
    "abc_rerank": (
        q_abc_rerank,
        f"""with {R.MEANS_SQL}, {R.GAP_SQL}, close as (select * from dense where score >= 0.25),
        both_ as (select coalesce(d.qid, g.qid) as qid, coalesce(d.vec_id, g.vec_id) as vec_id, round(coalesce(1 / (60.0::double + d.rank), 0) + coalesce(1 / (60.0::double + g.rank), 0), 9) as rrf from close d full join gap g on d.qid = g.qid and d.vec_id = g.vec_id),
        pool as (select *, row_number() over (partition by qid order by rrf desc, vec_id) as rank from both_ qualify rank <= {POOL}),
        anew as (select p.qid, p.vec_id, row_number() over (partition by p.qid order by gap, p.rank, p.vec_id) as rank from pool p join gap_score s on s.qid = p.qid and s.vec_id = p.vec_id),
        arm as (select 'a' as arm, qid, vec_id, rank from dense union all select 'b', qid, vec_id, rank from pool union all select 'c', qid, vec_id, rank from anew),
        hit as (select arm, arm.qid, rank, e.label = arm.qid as is_gold from arm join embeddings e using (vec_id)),
        n as (select qid, {", ".join(f"min(rank) filter (arm = '{n}' and is_gold)::int as best_{n}, count(*) filter (arm = '{n}' and is_gold and rank <= {R.LIMIT}) as seeds_{n}" for n in "abc")} from hit group by qid)
        select qid, best_a, best_b, best_c, {", ".join(f"case when best_{n} is null then 'recall_failure' when seeds_{n} = 0 then 'ranking_failure' end as failure_{n}" for n in "abc")}, {_OUTCOME.format("a", "b")}, {_OUTCOME.format("b", "c")} from n""",
    ),
}
