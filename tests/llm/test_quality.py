import numpy as np
from pyspark.sql import functions as F

from granary.llm.quality import STATISTICS, grow, scored, statistics, train


def test_statistics_of_odd_texts():
    for text in (None, "", " ", "\n\n", "a", "é" * 100_000, "word " * 50_000):
        found = statistics(text)
        assert len(found) == len(STATISTICS) and np.isfinite(found).all()


def test_arrays_give_what_the_trees_say():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)).astype(float)
    trees = grow(x[:2000], y[:2000])

    def walk(row, node):
        while trees.feature[node] >= 0:
            node = trees.left[node] if row[trees.feature[node]] <= trees.limit[node] else trees.right[node]
        return trees.value[node]

    scores = trees.score(x)
    for i in range(0, 3000, 97):
        assert abs(scores[i] - 1 / (1 + np.exp(-(trees.start + sum(walk(x[i], r) for r in trees.roots))))) < 1e-12
    assert ((scores[2000:] > 0.5) == y[2000:]).mean() > 0.9


def test_training_on_labels(spark):
    rows = [(i, f"Clean words number {i} stand here in a row. " * (i % 7 + 1), 1) for i in range(60)] + [(100 + i, f"*** $$$ buy{i} &&& ### " * (i % 7 + 1), 0) for i in range(60)]
    documents = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, 1) for i, _, q in rows] + [(None, 1, 1), (3, None, 1), (5000, 0, 1)], "doc_id long, quality int, text int")
    trees = train(documents, labels)
    found = {r.doc_id: r.p for r in documents.select("doc_id", scored(F.col("text"), trees).alias("p")).collect()}
    assert all((found[i] > 0.5) == (q == 1) for i, _, q in rows) and 0 <= found[900] == found[901] <= 1
    none = train(documents, labels.limit(0))
    assert {r.p for r in documents.select(scored(F.col("text"), none).alias("p")).collect()} == {0.5}
    only = train(documents, labels.filter("quality = 1"))
    assert min(r.p for r in documents.select(scored(F.col("text"), only).alias("p")).collect()) > 0.99
