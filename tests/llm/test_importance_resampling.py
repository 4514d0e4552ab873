"""Checksums against zlib, features and draws against a plain version."""

import hashlib
import random
import re
import zlib
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import importance_resampling as R


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(x.encode()) % R.BUCKETS for x in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def plain(documents, benchmark):
    s, t = np.zeros(R.BUCKETS), np.zeros(R.BUCKETS)
    for counts, texts in ((s, [x for _, x in documents]), (t, benchmark)):
        for text in texts:
            for bucket in plain_features(text)[1]:
                counts[bucket] += 1
    gain = [floor(1000 * log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    rows = []
    for doc_id, text in documents:
        words, buckets = plain_features(text)
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets) // len(buckets) if buckets else 0
        rows.append([doc_id, len(buckets), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), len(words) >= 20])
    enough = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(enough[: 25 * len(enough) // 100])}
    return sorted([(*r[:4], rank.get(id(r))) for r in rows], key=repr)


def run(spark, folder, documents, benchmark):
    spark.createDataFrame([(*r, 1, 2, 3) for r in documents], "doc_id long, text string, score int, rank int, n_words int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, t, 1) for k, t in enumerate(benchmark)], "item_id long, text string, bucket int").write.parquet(f"{folder}/benchmark.parquet")
    return sorted(map(tuple, R.op13_importance_resampling(spark, str(folder)).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_checksums_equal_zlib():
    random.seed(1)
    data = np.frombuffer(random.randbytes(20_000), np.uint8)
    sizes = [1, 2, 3, 4, 5, 63, 64, 65, 127, 128, 129, 192, 1_000, 15_000]
    starts = np.array([random.randrange(5_000) for _ in range(400)])
    ends = starts + np.array([random.choice(sizes) for _ in starts])
    assert R.crc32_of_spans(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("window", [1, 2, 7, 50, 1 << 20])
def test_features_of_windows(monkeypatch, window):
    monkeypatch.setattr(R, "LONG", window)
    monkeypatch.setattr(R, "AT_ONCE", window)
    random.seed(2)
    texts = [None, "", "...", "A", "A b", " x", "é" * 300, "\x00a\x7fB~c{d", "KK İ ß", "w" * 500 + " " + "v" * 500 + " w w"]
    texts += ["".join(random.choices("aZ9 é世.\n_", k=random.randrange(120))) for _ in range(60)]
    found, words = [[] for _ in texts], [0] * len(texts)
    for rows, buckets, of_words in R.features(pa.array(texts)):
        for row, bucket in zip(rows.tolist(), buckets.tolist(), strict=True):
            found[row].append(bucket)
        for row in of_words.tolist():
            words[row] += 1
    assert [sorted(x) for x in found] == [sorted(plain_features(t)[1]) for t in texts]
    assert words == [len(plain_features(t)[0]) for t in texts]


def test_draw_equals_the_plain_version(spark, tmp_path):
    """Null ids and texts, ties, repeated rows, very long texts and words, extra columns with clashing names."""
    random.seed(5)
    words = ["alpha", "beta", "gamma", "delta", "42", "été"]
    documents = [(k, " ".join(random.choices(words, k=random.randrange(60)))) for k in range(300)]
    documents += [(None, "alpha beta " * 30), (None, None), (7, "alpha beta " * 30), (7, "alpha beta " * 30), (400, ""), (401, "x" * 300_000 + " y" * 30), (402, "gamma delta " * 20_000)]
    benchmark = ["alpha beta gamma", "alpha beta", None, ""]
    assert run(spark, tmp_path, documents, benchmark) == plain(documents, benchmark)


@pytest.mark.parametrize("documents,benchmark", [([], ["a b"]), ([(1, "a b " * 20)], []), ([(k, "a " * 25) for k in range(8)], ["b"])])
def test_small_tables(spark, tmp_path, documents, benchmark):
    assert run(spark, tmp_path, documents, benchmark) == plain(documents, benchmark)
