"""Contracts of evaluation datasets: rules as data, all violations of all cases in one pass, and gold that an index lacks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.text import strip
from granary.operators import chunks as C
from granary.operators import evidence as E
from granary.operators import retrieval as R

# What a case is called, and the columns of both kinds of datasets.
CASE_ID = r"^[a-z0-9][a-z0-9_-]*\z"
GOLD = "array<struct<gold_id: string, material_id: string, source: string, locator: string, text_span: string, page: int, section: string>>"
MAPPING = "array<struct<gold_ids: array<string>, chunk_id: string, material_id: string, content_hash: string, source: string, page: int, section: string, legacy_chunk_index: int>>"
RETRIEVAL_CASE = (
    "case_id string, dataset_version string, question string, answerable boolean, case_types array<string>, expected_scope struct<material_ids: array<string>, sources: array<string>>, "
    f"stable_gold_meanings {GOLD}, current_chunk_mappings {MAPPING}, annotation_notes string"
)
ANSWER_CASE = "id string, category string, question string, expected_sources array<struct<source: string, chunk_index: int>>, required_answer_terms array<string>, should_refuse boolean"
KEY = ("chunk_id", "material_id", "content_hash", "source", "page", "section")


@dataclass(frozen=True)
class Rule:
    """A named condition of a case's columns; holds is false or null where the case breaks it."""

    name: str
    holds: Column


def told(*columns) -> Column:
    """Texts that are not blank."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.length(strip(F.col(c) if isinstance(c, str) else c)) > 0)
    return out


def every(array: str, holds) -> Column:
    return F.forall(array, holds)


def distinct(values: Column) -> Column:
    return F.size(values) == F.size(F.array_distinct(values))


def within(values: Column, allowed: Column) -> Column:
    return F.size(F.array_except(values, allowed)) == 0


def complete(referenced: Column, declared: Column) -> Column:
    """The two hold the same values."""
    return within(referenced, declared) & within(declared, referenced)


def implies(condition: Column, then: Column) -> Column:
    return ~condition | then


def field(array: str, name: str) -> Column:
    return F.transform(array, lambda x: x[name])


def positive(x: Column) -> Column:
    return x.isNull() | (x > 0)


def sha(x: Column) -> Column:
    return x.rlike(E.SHA256)


def retrieval_rules(version: Column | None = None) -> list[Rule]:
    """The rules of a retrieval case; version is the dataset's own, where it has one."""
    gold, maps = "stable_gold_meanings", "current_chunk_mappings"
    materials, sources = F.col("expected_scope.material_ids"), F.col("expected_scope.sources")
    lists = [F.size(c) > 0 for c in (materials, sources, F.col(gold), F.col(maps))]
    every_list, no_list = lists[0] & lists[1] & lists[2] & lists[3], ~(lists[0] | lists[1] | lists[2] | lists[3])
    return [
        Rule("missing_text", told("case_id", "dataset_version", "question", "annotation_notes")),
        Rule("malformed_case_id", F.col("case_id").rlike(CASE_ID)),
        Rule("repeated_case_id", F.count("*").over(Window.partitionBy("case_id")) == 1),
        Rule("other_version", F.lit(True) if version is None else F.col("dataset_version") == version),
        Rule("missing_value", F.col("answerable").isNotNull() & F.col("case_types").isNotNull() & materials.isNotNull() & sources.isNotNull() & F.col(gold).isNotNull() & F.col(maps).isNotNull()),
        Rule("repeated_value", distinct(F.col("case_types")) & distinct(sources) & every(maps, lambda m: distinct(m["gold_ids"]))),
        Rule("blank_value", every("case_types", lambda x: told(x)) & every("expected_scope.sources", lambda x: told(x)) & every(gold, lambda g: told(g["gold_id"], g["source"], g["locator"], g["text_span"]) & (g["section"].isNull() | told(g["section"]))) & every(maps, lambda m: told(m["source"]) & (m["section"].isNull() | told(m["section"])))),
        Rule("malformed_identity", every("expected_scope.material_ids", sha) & every(gold, lambda g: sha(g["material_id"])) & every(maps, lambda m: sha(m["chunk_id"]) & sha(m["material_id"]) & sha(m["content_hash"]))),
        Rule("number_not_positive", every(gold, lambda g: positive(g["page"])) & every(maps, lambda m: positive(m["page"]) & positive(m["legacy_chunk_index"]))),
        Rule("repeated_chunk_id", distinct(field(maps, "chunk_id"))),
        Rule("repeated_gold_id", distinct(field(gold, "gold_id"))),
        Rule("undeclared_scope", implies(F.col("answerable"), every_list)),
        Rule("invented_gold", implies(~F.col("answerable"), no_list)),
        Rule("mapping_outside_materials", within(field(maps, "material_id"), materials)),
        Rule("mapping_outside_sources", within(field(maps, "source"), sources)),
        Rule("gold_outside_scope", within(field(gold, "material_id"), materials) & within(field(gold, "source"), sources)),
        Rule("gold_not_fully_referenced", every(maps, lambda m: F.size(m["gold_ids"]) > 0) & complete(F.flatten(field(maps, "gold_ids")), field(gold, "gold_id"))),
    ]


def answer_rules() -> list[Rule]:
    """The rules of an end-to-end case."""
    some, terms = F.size("expected_sources") > 0, F.size("required_answer_terms") > 0
    return [
        Rule("missing_text", told("id", "category", "question")),
        Rule("malformed_case_id", F.col("id").rlike(CASE_ID)),
        Rule("repeated_case_id", F.count("*").over(Window.partitionBy("id")) == 1),
        Rule("missing_value", F.col("should_refuse").isNotNull() & F.col("expected_sources").isNotNull() & F.col("required_answer_terms").isNotNull()),
        Rule("malformed_source", every("expected_sources", lambda s: told(s["source"]) & (s["chunk_index"] > 0))),
        Rule("repeated_source", distinct(F.col("expected_sources"))),
        Rule("blank_term", every("required_answer_terms", lambda x: told(x))),
        Rule("repeated_term", distinct(F.col("required_answer_terms"))),
        Rule("refusal_with_gold", implies(F.col("should_refuse"), ~(some | terms))),
        Rule("answer_without_gold", implies(~F.col("should_refuse"), some & terms)),
    ]


def _broken(rules: list[Rule]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(r.holds, F.lit(False)), r.name) for r in rules]))


def violations(cases: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """key and rule for each rule that a case breaks; all of them from one pass, with one exchange for what must be unique."""
    return cases.select(key, _broken(rules).alias("broken")).select(key, F.explode("broken").alias("rule"))


def checked(cases: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """cases as they are; reading one that breaks a rule is an error that names it."""
    why = F.concat(F.lit("case "), F.coalesce(F.col(key), F.lit("without id")), F.lit(" breaks "), F.array_join("_broken", ", "))
    kind = dict(cases.dtypes)[key]
    return cases.withColumn("_broken", _broken(rules)).withColumn(key, F.when(F.size("_broken") > 0, F.raise_error(why).cast(kind)).otherwise(F.col(key))).drop("_broken")


def read_cases(spark: SparkSession, path: str, schema: str, version_field: str, version: int = 1) -> DataFrame:
    """The cases of a JSON dataset; a root without the version or without cases is an error."""
    root = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(f"{version_field} int, dataset_version string, cases array<struct<{_nested(schema)}>>").json(path)
    found = root.select(version_field, "dataset_version", F.size("cases").alias("n")).collect()  # one row a file
    if not found or any(r[0] != version or not r["n"] or r["n"] < 1 for r in found):
        raise ValueError(f"a dataset needs {version_field} {version} and cases")
    return root.select(F.col("dataset_version").alias("_version"), F.explode("cases").alias("x")).select("x.*", "_version")


def _nested(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, _, kind in (part.partition(" ") for part in _split(schema)))


def _split(schema: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            parts.append(schema[start:i].strip())
            start = i + 1
    return [*parts, schema[start:].strip()]


def unresolved(mappings: DataFrame, index: DataFrame) -> DataFrame:
    """The mappings whose six key columns no chunk of the index has; nulls are equal to nulls."""
    there = index.select(*[F.col(c).alias(f"there_{c}") for c in KEY]).distinct()
    same = F.lit(True)
    for c in KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"there_{c}"))
    return mappings.join(there, same, "left_anti")


def missing_sources(cases: DataFrame, index: DataFrame) -> DataFrame:
    """id, source and chunk_index of the expected places that the index does not have."""
    return cases.select("id", F.inline("expected_sources")).join(index.select("source", "chunk_index").distinct(), ["source", "chunk_index"], "left_anti").select("id", "source", "chunk_index")


# --- queries: the benchmark's questions and the chunks that hold them as cases, with faults by the question's number ---


def _gold(spark, sf_dir) -> DataFrame:
    gold = E.gold_chunks(spark, sf_dir).drop("content")
    return E.evidence(E.labelled(R.pieces(spark, sf_dir, gold)).join(gold.withColumnRenamed("source", "doc"), ["doc", "chunk_index"]))


def _cases(spark, sf_dir) -> DataFrame:
    item = F.struct("doc_id", "chunk_index", "chunk_id", "material_id", "content_hash", "source", "locator", "content", "page", "section")
    gold = _gold(spark, sf_dir).groupBy("qid").agg(F.sort_array(F.collect_list(item)).alias("g"))
    found = R.questions(spark, sf_dir).join(gold, "qid", "left").withColumn("g", F.coalesce("g", F.array()))
    fault = F.col("qid") % 6
    name = lambda x: F.concat(F.lit("gold-"), x["doc_id"].cast("string"), F.lit("-"), x["chunk_index"].cast("string"))
    sources = F.array_sort(F.array_distinct(F.transform("g", lambda x: x["source"])))
    meaning = F.transform("g", lambda x: F.struct(name(x).alias("gold_id"), x["material_id"].alias("material_id"), x["source"].alias("source"), x["locator"].alias("locator"), x["content"].alias("text_span"), x["page"].alias("page"), x["section"].alias("section")))
    ids = lambda x: F.when(fault == 2, F.array().cast("array<string>")).otherwise(F.array(name(x)))
    mapping = F.transform(
        "g",
        lambda x: F.struct(
            ids(x).alias("gold_ids"), F.when(fault == 4, F.upper(x["chunk_id"])).otherwise(x["chunk_id"]).alias("chunk_id"), x["material_id"].alias("material_id"), x["content_hash"].alias("content_hash"), x["source"].alias("source"),
            x["page"].alias("page"), x["section"].alias("section"), x["chunk_index"].alias("legacy_chunk_index"),
        ),
    )
    answerable = F.size("g") > 0
    number = F.when(F.col("qid") % 10 >= 8, F.col("qid") - F.col("qid") % 2).otherwise(F.col("qid")).cast("string")
    return found.select(
        F.when(fault == 3, F.concat(F.lit("Case "), number)).otherwise(F.concat(F.lit("case-"), number)).alias("case_id"), F.lit("v1").alias("dataset_version"), F.when(fault == 4, "  ").otherwise(F.col("question")).alias("question"),
        F.when(fault == 1, ~answerable).otherwise(answerable).alias("answerable"), F.array(F.lit("explicit_fact")).alias("case_types"),
        F.struct(F.array_distinct(F.transform("g", lambda x: x["material_id"])).alias("material_ids"), F.when((fault == 0) & (F.size("g") > 0), F.slice(sources, 2, F.greatest(F.size(sources), F.lit(1)))).otherwise(sources).alias("sources")).alias("expected_scope"),
        meaning.cast(GOLD).alias("stable_gold_meanings"), mapping.cast(MAPPING).alias("current_chunk_mappings"), F.lit("from the benchmark").alias("annotation_notes"),
    )


def q_dataset_violations(spark, sf_dir):
    return violations(_cases(spark, sf_dir), "case_id", retrieval_rules(F.lit("v1")))


def q_gold_unresolved_keys(spark, sf_dir):
    """Gold keys against the index, each part of the key changed for some: page, content and section in turn."""
    turn = (F.col("doc_id") + F.col("chunk_index")) % 4
    keys = _gold(spark, sf_dir).select("qid", *KEY, turn.alias("turn"))
    changed = keys.withColumns({"page": F.when(F.col("turn") == 0, F.coalesce("page", F.lit(0)) + 1).otherwise(F.col("page")), "content_hash": F.when(F.col("turn") == 1, F.reverse("content_hash")).otherwise(F.col("content_hash")), "section": F.when(F.col("turn") == 2, F.nullif(F.coalesce("section", F.lit("new")), F.col("section"))).otherwise(F.col("section"))})
    index = E.evidence(E.labelled(R.pieces(spark, sf_dir)))
    return unresolved(changed, index).select("qid", "chunk_id", "turn")


def q_expected_sources_missing(spark, sf_dir):
    """End-to-end cases that expect a question's gold place and the one three chunks on: those that no document has."""
    gold = E.gold_chunks(spark, sf_dir)
    place = F.struct("source", "chunk_index")
    later = F.struct("source", (F.col("chunk_index") + 3).alias("chunk_index"))
    cases = gold.groupBy("qid").agg(F.array_union(F.collect_set(place), F.collect_set(later)).alias("expected_sources"))
    return missing_sources(cases.withColumn("id", F.concat(F.lit("case-"), F.col("qid").cast("string"))), R.pieces(spark, sf_dir, gold))


QUERIES = {
    "dataset_violations": (
        q_dataset_violations,
        f"""with {C.PIECES_SQL}, {E._LABEL_SQL}, {E.GOLD_SQL}, hit as (select g.qid, e.label from gold g join evidence e using (source, chunk_index)),
        n as (select item_id as qid, count(label) as n, count(distinct label) as n_sources from benchmark left join hit on qid = item_id group by 1),
        c as (select *, qid % 6 as f, case when qid % 6 = 3 then 'Case ' else 'case-' end || case when qid % 10 >= 8 then qid - qid % 2 else qid end as case_id from n),
        r as (select case_id, unnest(list_filter([case when f = 4 then 'missing_text' end, case when f = 3 then 'malformed_case_id' end, case when count(*) over (partition by case_id) > 1 then 'repeated_case_id' end,
          case when f = 4 and n > 0 then 'malformed_identity' end, case when (f = 1 and n = 0) or (f = 0 and n_sources = 1) then 'undeclared_scope' end, case when f = 1 and n > 0 then 'invented_gold' end,
          case when f = 0 and n > 0 then 'mapping_outside_sources' end, case when f = 0 and n > 0 then 'gold_outside_scope' end, case when f = 2 and n > 0 then 'gold_not_fully_referenced' end], lambda x: x is not null)) as rule from c)
        select case_id, rule from r""",
    ),
    "gold_unresolved_keys": (
        q_gold_unresolved_keys,
        f"""with {C.PIECES_SQL}, {E._LABEL_SQL}, {E.GOLD_SQL}, k as (select g.qid, e.*, (doc_id + chunk_index) % 4 as turn from gold g join evidence e using (source, chunk_index)),
        m as (select qid, turn, chunk_id, material_id, label, case when turn = 0 then coalesce(page, 0) + 1 else page end as page, case when turn = 1 then reverse(content_hash) else content_hash end as content_hash,
          case when turn = 2 then nullif(coalesce(section, 'new'), section) else section end as section from k)
        select qid, chunk_id, turn from m where not exists (select 1 from evidence e where e.chunk_id = m.chunk_id and e.material_id = m.material_id and e.content_hash = m.content_hash and e.label = m.label
          and e.page is not distinct from m.page and e.section is not distinct from m.section)""",
    ),
    "expected_sources_missing": (
        q_expected_sources_missing,
        f"""with {C.PIECES_SQL}, {E.GOLD_SQL}, p as (select qid, source, chunk_index from gold union select qid, source, chunk_index + 3 from gold)
        select 'case-' || qid as id, source, chunk_index from p where not exists (select 1 from piece where piece.source = p.source and piece.chunk_index = p.chunk_index)""",
    ),
}
