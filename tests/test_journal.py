"""Runs that survive retries and kills, and index versions that readers never see half of."""

import json

import pytest
from pyspark.sql import functions as F

from granary.sources import files, index, journal

CONFIG = {k: "x" for k in index.CONFIG} | {"embedding_dimension": 4}


def cases(spark, *rows):
    return spark.createDataFrame([(c, m, f, ms) for c, m, f, ms in rows], "case_id string, recall double, failure string, ms long")


def told(frame):
    return {(r.kind, r.name): r.value for r in frame.collect()}


def test_files_are_created_once_and_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "a" / "x.txt")
    assert files.create(spark, path, "one é") and not files.create(spark, path, "two") and files.read(spark, path) == "one é"
    files.replace(spark, path, "three")
    assert files.read(spark, path) == "three" and [n for n in files.names(spark, str(tmp_path / "a")) if not n.endswith(".crc")] == ["x.txt"]
    assert files.names(spark, str(tmp_path / "none")) == []


def test_a_killed_and_repeated_run_gives_the_same_report(spark, tmp_path):
    first, second = cases(spark, ("a", 1.0, None, 5), ("b", None, "recall_failure", 7)), cases(spark, ("c", 0.0, "recall_failure", 6))
    plain, hurt = str(tmp_path / "plain"), str(tmp_path / "hurt")
    for path in (plain, hurt):
        journal.begin(spark, path, {"dataset": "v1"})
    assert journal.status(spark, plain) == "ready"
    with pytest.raises(ValueError):
        journal.report(spark, plain, ["recall"])
    journal.append(plain, 0, first)
    journal.append(plain, 1, second)
    first.write.parquet(f"{hurt}/parts/0-killed")  # an attempt that never committed
    assert journal.append(hurt, 0, first) and not journal.append(hurt, 0, second)  # a retry has no effect, whatever it holds
    assert journal.status(spark, hurt) == "running"
    journal.append(hurt, 1, second)
    expected = {("metric", "recall"): 0.5, ("failure", "recall_failure"): 2.0, ("total", "cases"): 3.0, ("total", "total_ms"): 18.0, ("total", "mean_ms"): 6.0}
    assert told(journal.report(spark, plain, ["recall"], latency="ms")) == told(journal.report(spark, hurt, ["recall"], latency="ms")) == expected


def test_repeated_cases_and_ended_runs_are_refused(spark, tmp_path):
    path = str(tmp_path / "run")
    with pytest.raises(FileNotFoundError):
        journal.append(path, 0, cases(spark, ("a", 1.0, None, 1)))
    journal.begin(spark, path, {})
    with pytest.raises(FileExistsError):
        journal.begin(spark, path, {"other": 1})
    with pytest.raises(ValueError, match="already: a"):
        journal.append(path, 0, cases(spark, ("a", 1.0, None, 1), ("a", 0.0, None, 1)))
    journal.append(path, 0, cases(spark, ("a", 1.0, None, 1)))
    with pytest.raises(ValueError, match="already: a"):
        journal.append(path, 1, cases(spark, ("b", 1.0, None, 1), ("a", 0.0, None, 1)))
    with pytest.raises(ValueError, match="index changed"):
        journal.complete(spark, path, "before", "after")
    assert journal.status(spark, path) == "running" and journal.committed(spark, path).count() == 1
    journal.complete(spark, path, "same", "same")
    assert journal.status(spark, path) == "completed"
    with pytest.raises(ValueError, match="completed"):
        journal.append(path, 2, cases(spark, ("c", 1.0, None, 1)))
    with pytest.raises(FileExistsError):
        journal.complete(spark, path, "same", "same")


def test_streams_commit_each_batch_once(spark, tmp_path):
    path, source = str(tmp_path / "run"), str(tmp_path / "in")
    journal.begin(spark, path, {})
    cases(spark, ("a", 1.0, None, 1)).write.parquet(source)
    stream = spark.readStream.schema("case_id string, recall double, failure string, ms long").parquet(source)
    for k in range(2):
        stream.writeStream.foreachBatch(journal.sink(path)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        if not k:
            cases(spark, ("b", 0.0, "x", 2)).write.mode("append").parquet(source)
    journal.sink(path)(cases(spark, ("b", 0.0, "x", 2)), 1)  # the last batch again, as after a crash
    assert sorted(r.case_id for r in journal.committed(spark, path).collect()) == ["a", "b"]


def test_a_reader_between_the_steps_sees_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    frame = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "chunk_id string, content string")
    assert index.state(spark, path, CONFIG) == "empty"
    index.build(frame("a"), path, "1", index.described(CONFIG, "2026-01-01T00:00:00Z"))
    assert index.state(spark, path, CONFIG) == "compatible"
    seen = []
    real = files.replace
    monkeypatch.setattr(index.files, "replace", lambda *a: (seen.extend(r.chunk_id for r in index.current(spark, path).collect()), real(*a)))
    index.sync(spark, path, frame("a", "b"), "2")
    assert seen == ["a"] and sorted(r.chunk_id for r in index.current(spark, path).collect()) == ["a", "b"]
    assert [r.chunk_id for r in spark.read.parquet(f"{path}/versions/1").collect()] == ["a"]
    monkeypatch.setattr(index.files, "replace", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        index.sync(spark, path, frame("c"), "3")
    assert sorted(r.chunk_id for r in index.current(spark, path).collect()) == ["a", "b"]


def test_manifests_are_checked(spark, tmp_path):
    good = index.described(CONFIG, "2026-01-01T00:00:00Z")
    assert index.problems(good) == [] and index.described(CONFIG, "2026-01-02T00:00:00Z", good)["created_at"] == "2026-01-01T00:00:00Z"
    for change, wrong in (({"chunker_version": ""}, "chunker_version"), ({"manifest_version": "2"}, "manifest_version"), ({"embedding_dimension": "0"}, "embedding_dimension"), ({"updated_at": "2025-01-01T00:00:00Z"}, "times"), ({"created_at": "2026-01-01"}, "times")):
        assert index.problems(good | change) == [wrong]
    path = str(tmp_path / "index")
    spark.range(1).write.parquet(f"{path}/versions/old")
    assert index.state(spark, path, CONFIG) == "legacy_read_only"
    with pytest.raises(ValueError, match="read only"):
        index.sync(spark, path, spark.range(1).select(F.lit("a").alias("chunk_id")), "2")
    files.replace(spark, f"{path}/manifest.json", json.dumps(good))
    for key in index.CONFIG:
        with pytest.raises(ValueError, match=f"another configuration: {key}"):
            index.state(spark, path, CONFIG | {key: "other"})
    files.replace(spark, f"{path}/manifest.json", "{")
    with pytest.raises(ValueError, match="not JSON"):
        index.state(spark, path, CONFIG)


def test_fingerprint_trees_differ_only_where_records_do(spark):
    rows = [(f"id-{k}", f"text {k}") for k in range(300)]
    tree = lambda x: index.fingerprint_tree(spark.createDataFrame(x, "k string, t string"), "k", "t", F.lit("meta"))
    first = tree(rows)
    assert index.differing(first, tree(rows[::-1])).count() == 0
    changed = tree([*rows[:7], ("id-7", "other"), *rows[8:]])
    found = sorted(r.prefix for r in index.differing(first, changed).collect())
    assert len(found) == 4 and found[0] == "" and all(found[-1].startswith(x) for x in found)
    assert index.differing(first, tree(rows + rows[:1])).count() == 4
