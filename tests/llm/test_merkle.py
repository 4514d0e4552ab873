"""Merkle fingerprints against a plain version, on hand-made and random texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from granary.llm import merkle as M


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain(text):
    out, section = [], []
    for line in re.split(r"(?<=\n)(?=.)", text, flags=re.S):
        leaves = [sha(x) for x in re.split(r"(?<=[.!?][ \t\r\n])(?=.)", line, flags=re.S)]
        own = sha("".join(leaves))
        section.append((own, "".join(x[:8] for x in leaves)))
        if own[0] in "01":
            out.append(section)
            section = []
    out += [section] * bool(section)
    hashes = [sha("".join(h for h, _ in s)) for s in out]
    return sha("".join(hashes)) + ":" + ";".join(h[:16] + "=" + ",".join(x for _, x in s) for h, s in zip(hashes, out, strict=True))


def edited_rows(rows):
    """(doc_id, text, edited, next) of rows, null texts empty."""
    rows = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), [-ord(c) for c in r[1]] + [1]))
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text) // 3
        yield i, text, text[: len(text) - n] + after[:n], after


def test_fingerprints_equal_the_plain_ones(spark):
    random.seed(3)
    texts = ["", "\n", "a", "a\n", "a\n\n", "A. b! c? d", "A.  b", "x.\n", ".\n. \n", "é世界。 x. \U0001f600 y", "w" * 5000, "One. Two.\nThree.\n" * 300]
    texts += ["".join(random.choices("ab .!?\n\té", k=random.randrange(200))) for _ in range(100)]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", M.fingerprint(F.col("text"))).collect()
    assert dict(map(tuple, found)) == {k: plain(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_query_over_odd_rows(spark, tmp_path, partitions):
    """Null ids and texts, ties, repeated rows, gaps between ids, negative ids, extra columns with clashing names."""
    random.seed(4)
    rows = [(None, "n. u."), (None, None), (7, None), (7, ""), (-5, "neg. ative"), (-5, "neg. ative"), (1 << 62, "far. away\n")]
    rows += [(random.randrange(400), "".join(random.choices("abc. \n", k=random.randrange(60)))) for _ in range(150)]
    extra = [(i, t, "x", "y", 3) for i, t in rows]
    spark.createDataFrame(extra, "doc_id long, text string, fp string, part string, next_text int").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found = M.op11_merkle_fingerprints(spark, str(tmp_path)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = [(i, len(t), sha(e), plain(t), plain(e)) for i, t, e, _ in edited_rows(rows)]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("rows", [[], [(3, "Only. One.\n")], [(None, "no id"), (None, "either")]])
def test_small_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = M.op11_merkle_fingerprints(spark, str(tmp_path)).select("doc_id", "n_chars", "edited_sha256", "edited_fingerprint").collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(i, len(t), sha(e), plain(e)) for i, t, e, _ in edited_rows(rows)], key=repr)


def test_likeness_and_changed_paragraphs(spark):
    text = "".join(f"Line {k} of it. And more of {k}.\n" for k in range(200))
    changed = text.replace("Line 77 of it", "Another").replace("Line 150 of it", "Another one")
    pairs = [(text, text), (text, changed), (text, "Nothing. In common.\n"), ("", ""), ("", "a"), (text, text + "The end.\n"), ("A. B. ", "B. A. ")]
    frame = spark.createDataFrame(pairs, "a string, b string").select(M.fingerprint(F.col("a")).alias("a"), M.fingerprint(F.col("b")).alias("b"))
    near = [(r[0], list(r[1])) for r in frame.select(M.likeness(F.col("a"), F.col("b")), M.changed_paragraphs(F.col("a"), F.col("b"))).collect()]
    assert near[0] == (1.0, [])
    assert 0.98 < near[1][0] < 1 and near[1][1] == [78, 151]
    assert near[2][0] == 0 and near[2][1] == list(range(1, 201))
    assert near[3] == (1.0, []) and near[4] == (0.0, [1])
    assert near[5][0] > 0.99 and near[5][1] == []
    assert near[6][0] < 1 and near[6][1] == [1]


def test_no_python_in_the_plan(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = M.op11_merkle_fingerprints(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "SinglePartition" not in plan
