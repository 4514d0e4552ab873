"""Dataset contracts: one fault at a time, reading, and gold that an index lacks."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granary.operators import contracts as K

A, B, C = "a" * 64, "b" * 64, "c" * 64


def case(**changes):
    gold = {"gold_id": "g", "material_id": A, "source": "s", "locator": "s#1", "text_span": "t", "page": None, "section": None}
    mapping = {"gold_ids": ["g"], "chunk_id": B, "material_id": A, "content_hash": C, "source": "s", "page": 1, "section": None, "legacy_chunk_index": 1}
    out = {"case_id": "case-1", "dataset_version": "v1", "question": "q", "answerable": True, "case_types": ["x"], "expected_scope": {"material_ids": [A], "sources": ["s"]}, "stable_gold_meanings": [gold], "current_chunk_mappings": [mapping], "annotation_notes": "n"}
    for path, value in changes.items():
        target, parts = out, path.split("__")
        for part in parts[:-1]:
            target = target[int(part) if part.isdigit() else part]
        target[int(parts[-1]) if parts[-1].isdigit() else parts[-1]] = value
    return out


NOTHING = dict(expected_scope={"material_ids": [], "sources": []}, stable_gold_meanings=[], current_chunk_mappings=[])
FAULTS = [
    ({}, set()),
    ({"answerable": False, **NOTHING}, set()),
    ({"question": " \t"}, {"missing_text"}),
    ({"annotation_notes": None}, {"missing_text"}),
    ({"case_id": "Case"}, {"malformed_case_id"}),
    ({"case_id": "a\n"}, {"malformed_case_id"}),
    ({"dataset_version": "v2"}, {"other_version"}),
    ({"answerable": None}, {"missing_value", "invented_gold"}),
    ({"case_types": ["x", "x"]}, {"repeated_value"}),
    ({"expected_scope__sources": ["s", ""]}, {"blank_value"}),
    ({"stable_gold_meanings__0__text_span": " "}, {"blank_value"}),
    ({"current_chunk_mappings__0__section": ""}, {"blank_value"}),
    ({"current_chunk_mappings__0__content_hash": "C" * 64}, {"malformed_identity"}),
    ({"current_chunk_mappings__0__page": 0}, {"number_not_positive"}),
    ({"answerable": True, **NOTHING}, {"undeclared_scope"}),
    ({"answerable": False}, {"invented_gold"}),
    ({"current_chunk_mappings__0__material_id": B}, {"mapping_outside_materials"}),
    ({"current_chunk_mappings__0__source": "other"}, {"mapping_outside_sources"}),
    ({"stable_gold_meanings__0__source": "other"}, {"gold_outside_scope"}),
    ({"current_chunk_mappings__0__gold_ids": []}, {"gold_not_fully_referenced"}),
    ({"current_chunk_mappings__0__gold_ids": ["g", "h"]}, {"gold_not_fully_referenced"}),
    ({"stable_gold_meanings": [{"gold_id": "g", "material_id": A, "source": "s", "locator": "l", "text_span": "t"}] * 2}, {"repeated_gold_id"}),
    ({"current_chunk_mappings": [{"gold_ids": ["g"], "chunk_id": B, "material_id": A, "content_hash": C, "source": "s"}] * 2}, {"repeated_chunk_id"}),
]


def test_each_fault_breaks_its_rules_alone(spark):
    rows = [json.dumps(case(**changes)) for changes, _ in FAULTS]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, r string").select("k", F.from_json("r", K.RETRIEVAL_CASE).alias("x")).select("k", "x.*")
    found = frame.select("k", K._broken([r for r in K.retrieval_rules(F.lit("v1")) if r.name != "repeated_case_id"]).alias("b")).collect()
    assert {r.k: set(r.b) for r in found} == {k: names for k, (_, names) in enumerate(FAULTS)}


def test_datasets_are_read_and_checked(spark, tmp_path):
    def read(root):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(root, indent=1))
        return K.read_cases(spark, str(path), K.RETRIEVAL_CASE, "evaluation_version")

    good = read({"evaluation_version": 1, "dataset_version": "v1", "cases": [case(), case(case_id="case-2")]})
    assert K.violations(good, "case_id", K.retrieval_rules(F.col("_version"))).count() == 0
    assert sorted(r.case_id for r in K.checked(good, "case_id", K.retrieval_rules(F.col("_version"))).collect()) == ["case-1", "case-2"]
    twice = read({"evaluation_version": 1, "dataset_version": "v2", "cases": [case(), case()]})
    assert sorted(map(tuple, K.violations(twice, "case_id", K.retrieval_rules(F.col("_version"))).collect())) == sorted([("case-1", "repeated_case_id"), ("case-1", "other_version")] * 2)
    with pytest.raises(PySparkException, match="case case-1 breaks repeated_case_id, other_version"):
        K.checked(twice, "case_id", K.retrieval_rules(F.col("_version"))).collect()
    for root in ({"evaluation_version": 2, "cases": [case()]}, {"evaluation_version": 1, "cases": []}, {"evaluation_version": 1}):
        with pytest.raises(ValueError):
            read(root)


def test_answer_cases(spark):
    source = lambda i: {"source": "s", "chunk_index": i}
    rows = [
        ("a", "c", "q", [source(1)], ["t"], False, set()),
        ("b", "c", "q", [], [], True, set()),
        ("c", "c", "q", [source(1)], [], True, {"refusal_with_gold"}),
        ("d", "c", "q", [source(1)], [], False, {"answer_without_gold"}),
        ("e", "c", "q", [source(0)], ["t"], False, {"malformed_source"}),
        ("f", "c", "q", [source(1), source(1)], ["t", "t"], False, {"repeated_source", "repeated_term"}),
        ("g", "", "q", [source(1)], ["t", " "], False, {"missing_text", "blank_term"}),
        ("G", "c", "q", [source(1)], ["t"], None, {"malformed_case_id", "missing_value", "refusal_with_gold"}),
    ]
    frame = spark.createDataFrame([r[:6] for r in rows], K.ANSWER_CASE)
    found = {}
    for r in K.violations(frame, "id", K.answer_rules()).collect():
        found.setdefault(r.id, set()).add(r.rule)
    assert found == {r[0]: r[6] for r in rows if r[6]}


def test_gold_keys_match_null_to_null(spark):
    key = "chunk_id string, material_id string, content_hash string, source string, page int, section string"
    index = spark.createDataFrame([("c", "m", "h", "s", None, None), ("d", "m", "h", "s", 1, "x")], key)
    mappings = spark.createDataFrame([("c", "m", "h", "s", None, None), ("c", "m", "h", "s", 1, None), ("d", "m", "h", "s", 1, "x"), ("d", "m", "h", "s", 1, None), ("e", "m", "h", "s", None, None)], key)
    assert sorted((r.chunk_id, r.page, r.section) for r in K.unresolved(mappings, index).collect()) == [("c", 1, None), ("d", 1, None), ("e", None, None)]


def test_expected_places_that_are_missing(spark):
    cases = spark.createDataFrame([("a", "c", "q", [{"source": "s", "chunk_index": 1}, {"source": "s", "chunk_index": 2}], ["t"], False)], K.ANSWER_CASE)
    index = spark.createDataFrame([("s", 1), ("t", 2)], "source string, chunk_index int")
    assert list(map(tuple, K.missing_sources(cases, index).collect())) == [("a", "s", 2)]
