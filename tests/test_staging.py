"""Uploads admitted one by one and as a batch; the plan of an index built anew."""

import pytest

from granary.operators import staging as S

UPLOAD = "batch long, position long, filename string, content_type string, operation string, size long, head string, text string"


def upload(position, filename="a.txt", content_type="text/plain", operation="add", size=1, head="x", text="some text", batch=1):
    return (batch, position, filename, content_type, operation, size, head, text)


def reasons(spark, rows, existing=(), **limits):
    found = S.staged(spark.createDataFrame(rows, UPLOAD), spark.createDataFrame([(x,) for x in existing], "filename string"), S.Limits(**limits))
    return {(r.batch, r.position): r.reason for r in found.collect()}


def test_every_reason_and_its_order(spark):
    rows = [
        upload(1), upload(2, "A.TXT"), upload(3, None), upload(4, "x/y.txt"), upload(5, "b.txt", operation="move"), upload(6, "c.txt", "application/pdf"), upload(7, "old.txt"), upload(8, "new.txt", operation="replace"),
        upload(9, "old.md", operation="replace"), upload(10, "big.txt", size=11), upload(11, "f.pdf", "application/pdf", head="%PDX"), upload(12, "g.pdf", "application/pdf", head="%PDF-1.4"), upload(13, "h.docx", "application/zip", head=None),
        upload(14, "i.docx", "application/zip", head="PK\x03\x04.."), upload(15, "j.txt", text=" \n "), upload(16, "k.txt", text=None), upload(17, "l.txt", text="x" * 3601), upload(18, "m.txt", text="x" * 1800), upload(19, "b.txt"), upload(20, "n.txt", None),
    ]
    found = reasons(spark, rows, ["old.txt", "old.md"], files=99, bytes=10, batches=2)
    wrong = {2: "repeated", 3: "name", 4: "name", 5: "operation", 6: "content_type", 7: "exists", 8: "absent", 10: "size", 11: "signature", 13: "signature", 15: "empty", 16: "empty", 17: "calls", 19: "repeated", 20: "content_type"}
    # the five that are left need five calls together
    assert found == {(1, k): wrong.get(k, "batch_calls") for k in range(1, 21)}
    # eight calls are enough for them and for the one of three
    found = reasons(spark, rows, ["old.txt", "old.md"], files=99, bytes=10, batches=8)
    assert found == {(1, k): None if k == 17 else wrong.get(k) for k in range(1, 21)}


def test_batches_do_not_touch_each_other(spark):
    rows = [upload(1), upload(2, "b.txt"), upload(3, "c.txt"), upload(1, batch=2), upload(2, batch=2), upload(1, text="x" * 1801, batch=3), upload(2, "b.txt", batch=3)]
    found = reasons(spark, rows, files=2, batches=2)
    assert found == {(1, 1): "too_many_files", (1, 2): "too_many_files", (1, 3): "too_many_files", (2, 1): None, (2, 2): "repeated", (3, 1): "batch_calls", (3, 2): "batch_calls"}
    assert reasons(spark, []) == {}


@pytest.fixture
def plan(spark):
    def plan(base, files, chunks, legacy, most=100):
        pair = "filename string, chunk_id string"
        frames = (spark.createDataFrame(base, pair), spark.createDataFrame(files, "filename string, operation string"), spark.createDataFrame(chunks, pair), spark.createDataFrame([(x,) for x in legacy], "chunk_id string"))
        return S.migration_plan(*frames, most).first().asDict()

    return plan


def test_plan_counts_ids_once(plan):
    base = [("A.md", "1"), ("A.md", "2"), ("b.md", "3"), ("b.md", "3")]
    found = plan(base, [("a.MD", "replace"), ("c.md", "add")], [("a.MD", "2"), ("a.MD", "4"), ("c.md", "5"), ("c.md", "5")], ["1", "2", "9"])
    assert found == {"n_legacy": 3, "n_base": 3, "n_final": 4, "n_new": 2, "base_calls": 1, "new_calls": 1, "calls": 2, "legacy_matches": True, "n_taken": 0, "n_absent": 0, "problems": ""}


def test_plan_names_what_forbids_it(plan):
    base = [("a.md", str(i)) for i in range(21)]
    found = plan(base, [("A.md", "add"), ("z.md", "replace")], [("z.md", f"n{i}") for i in range(30)], [], most=2)
    assert found["problems"] == "no_legacy,name_taken,name_absent,base_calls,new_calls" and (found["base_calls"], found["new_calls"]) == (3, 3)
    empty = plan([], [], [], [])
    assert empty["problems"] == "no_legacy" and empty["n_final"] == 0 and empty["calls"] == 0
