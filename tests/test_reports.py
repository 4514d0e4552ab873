"""End-to-end cases on small fixtures, the layers of failures, stored reports and their comparison."""

import itertools
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granary.operators import contracts as K
from granary.operators import reports as P
from granary.operators.evidence import NO_EVIDENCE_ANSWER

CASE = f"name string, answer string, should_refuse boolean, retrieved {P.PLACES}, expected {P.PLACES}, terms array<string>"


def failures(spark, *rows):
    found = P.judged_answers(spark.createDataFrame(rows, CASE)).collect()
    return {r.name: [f.check + (f":{f.detail}" if f.detail else "") for f in r.failures] for r in found}, {r.name: r.passed for r in found}


def test_answers_that_should_answer(spark):
    good = "Straße and TCP [a.md · 第 2 段]"
    found, passed = failures(
        spark,
        ("good", good, False, [("a.md", 2)], [("a.md", 2)], ["STRASSE", "tcp"]),
        ("other place", good, False, [("a.md", 1)], [("a.md", 2), ("b.md", 1)], []),
        ("refused", NO_EVIDENCE_ANSWER, False, [], [("a.md", 2)], ["x"]),
        ("formula", good + r" \frac", False, None, None, None),
        ("dollar", "$1", False, [], [], ["2"]),
        ("null", None, False, [], [], ["x"]),
    )
    assert found["good"] == [] and passed["good"]
    assert found["other place"] == ["source_not_retrieved:[a.md · 第 2 段]", "source_not_retrieved:[b.md · 第 1 段]", "source_not_cited:[b.md · 第 1 段]"]
    assert found["refused"] == ["wrongly_refused", "source_not_retrieved:[a.md · 第 2 段]", "source_not_cited:[a.md · 第 2 段]", "term_missing:x"]
    assert found["formula"] == ["markup_left"] and found["dollar"] == ["term_missing:2", "markup_left"] and found["null"] == ["term_missing:x"]


def test_answers_that_should_refuse(spark):
    found, passed = failures(spark, ("bare", NO_EVIDENCE_ANSWER, True, [], [], ["x"]), ("sources", NO_EVIDENCE_ANSWER, True, [("a", 1)], [], []), ("told", "x $", True, [("a", 1)], [], []))
    assert found == {"bare": [], "sources": ["sources_with_refusal"], "told": ["answered_without_evidence", "sources_with_refusal"]} and passed["bare"]
    assert P.judged_answers(spark.createDataFrame([], CASE)).count() == 0


def test_layers_against_a_plain_cascade(spark):
    three = (None, True, False)
    rows = list(itertools.product((True, False), (True, False), (None, "ranking_failure"), (True, False), three, three))
    names = "p boolean, c boolean, r string, g boolean, v boolean, s boolean"
    found = spark.createDataFrame(rows, names).select("*", P.layer(*map(F.col, "pcrgvs")).alias("layer")).collect()

    def plain(p, c, r, g, v, s):
        if p or c:
            return "parsing_failure" if p else "chunking_failure"
        if r or g:
            return r or "generation_failure"
        if v is False or s is False:
            return "citation_failure"
        return "needs_manual_review" if v and s is None else None

    assert len(found) == len(rows) and all(x.layer == plain(*x[:6]) for x in found)


def test_pool():
    assert P.pool_size(20, 10, 10) == 20
    for wrong in ((21, 10, 10), (0, 10, 10), (5, 10, -1)):
        with pytest.raises(ValueError):
            P.pool_size(*wrong)


ANSWERS = {"report_schema_version": 1, "evaluation_dataset": {"file": "d.json", "version": "v1", "sha256": "s"}}
FOUND = {"report_schema_version": 2, "evaluation_type": "retrieval", "evaluation_dataset": {"dataset_version": "v2", "sha256": "s"}, "aggregate_metrics": {"mrr": 0.5}}


def case(name, passed=True, ms=1):
    return {"id": name, "passed": passed, "elapsed_ms": ms}


def result(name, failure=None, ms=1, **metrics):
    return {"case_id": name, "failure_category": failure, "metrics": metrics, "trace": {"latency_ms": {"total_retrieval": ms}}}


@pytest.fixture
def write(tmp_path):
    def write(name, content):
        path = tmp_path / f"{name}.json"
        path.write_text(content if isinstance(content, str) else json.dumps(content, indent=1, ensure_ascii=False))
        return str(path)

    return write


def test_reports_are_gated(spark, write):
    broken = {
        "text": ("no json", {"unknown_version", "missing_dataset"}), "list": ([1], {"unknown_version", "missing_dataset"}), "version": (ANSWERS | {"report_schema_version": 3}, {"unknown_version"}),
        "dataset": (FOUND | {"evaluation_dataset": None, "per_case_results": []}, {"missing_dataset"}), "cases": (ANSWERS, {"missing_cases"}), "kind": (FOUND | {"evaluation_type": "rag", "per_case_results": []}, {"not_retrieval"}),
        "results": ({k: v for k, v in FOUND.items() if k != "aggregate_metrics"}, {"missing_results", "missing_metrics"}), "passed": (ANSWERS | {"cases": [case("a", "yes")]}, {"malformed_case"}), "time": (ANSWERS | {"cases": [case("a", ms=-1)]}, {"malformed_case"}),
        "id": (ANSWERS | {"cases": [case("")]}, {"malformed_case"}), "twice": (ANSWERS | {"cases": [case("a"), case("a", False)]}, {"repeated_case"}), "trace": (FOUND | {"per_case_results": [result("a") | {"trace": {}}]}, {"malformed_result"}),
        "good": (ANSWERS | {"cases": [case("a"), case("b", False)]}, set()), "good too": (FOUND | {"per_case_results": [result("a", mrr=1.0)]}, set()), "empty": (ANSWERS | {"cases": []}, set()),
    }
    paths = [write(name.replace(" ", "_"), content) for name, (content, _) in broken.items()]
    found = {}
    for row in K.violations(P.read_reports(spark, *paths), "path", P.report_rules()).collect():
        found.setdefault(row.path.split("/")[-1][:-5], set()).add(row.rule)
    assert found == {name.replace(" ", "_"): rules for name, (_, rules) in broken.items() if rules}
    with pytest.raises(PySparkException, match="missing_cases"):
        P.report(spark, paths[4]).cases.collect()
    with pytest.raises(PySparkException, match="missing_cases"):
        P.report(spark, paths[4]).head.select("kind").collect()


def test_reports_of_answers_compared(spark, write):
    first = P.report(spark, write("a", ANSWERS | {"cases": [case("x", True, 5), case("y", False, 7), case("z", False, 1), case("gone")]}))
    second = P.report(spark, write("b", ANSWERS | {"cases": [case("x", False, 4), case("y", True, 7), case("z", False, 2), case("new", False)]}))
    changes = {r.case_id: (r.change, r.ms_delta) for r in P.case_changes(first, second).collect()}
    assert changes == {"x": ("newly_failed", -1), "y": ("recovered", 0), "z": ("still_failed", 1), "gone": ("removed", None), "new": ("added", None)}
    (row,) = P.summary(first, second).collect()
    assert (row.total_before, row.total, row.passed_before, row.passed, row.passed_delta, row.ms_before, row.ms, row.ms_delta) == (4, 4, 2, 1, -1, 14, 14, 0)
    assert row.same_dataset and not row.same_cases and not row.comparable and row.warning == "other_cases"
    (row,) = P.summary(first, first).collect()
    assert row.comparable and row.warning is None
    other = P.report(spark, write("c", ANSWERS | {"evaluation_dataset": {"file": "d.json"}, "cases": []}))
    (row,) = P.summary(other, other).collect()
    assert row.warning == "other_dataset" and row.total == 0 and row.ms == 0


def test_reports_of_retrieval_compared_and_kinds_not_mixed(spark, write):
    first = P.report(spark, write("a", FOUND | {"per_case_results": [result("x", None, 3, mrr=0.5, recall=1.0), result("y", "recall_failure", mrr=None)]}))
    second = P.report(spark, write("b", FOUND | {"per_case_results": [result("x", "ranking_failure", 5, mrr=0.25), result("y", None, mrr=1.0)]}))
    changes = {r.case_id: r for r in P.case_changes(first, second).collect()}
    assert changes["x"].change == "newly_failed" and changes["x"].ms_delta == 2 and changes["x"].metric_deltas == {"mrr": -0.25, "recall": None}
    assert changes["y"].change == "recovered" and changes["y"].failure_before == "recall_failure" and changes["y"].metric_deltas == {"mrr": None}
    assert first.head.first().version == "v2"
    answers = P.report(spark, write("c", ANSWERS | {"cases": []}))
    with pytest.raises(PySparkException, match="cannot be compared"):
        P.summary(first, answers).collect()
