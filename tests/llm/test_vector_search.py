import numpy as np
from pyspark.sql import functions as F

from granary.llm.vector_search import LEAST_LISTS, NEAR, REPLICAS, build, nearest


def brute(rows, asks, k):
    good = [(i, np.array(v, float)) for i, v in rows if v and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == len(rows[0][1])]
    x, ids = np.stack([v for _, v in good]), np.array([i for i, _ in good])
    out = {}
    for i, v in good:
        if asks(i):
            s = x @ v
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 12)) * rng.uniform(0.5, 2, size=(1500, 1))
    x[200:260] = x[200]  # more copies than neighbours
    x[300:500] = x[300] + rng.normal(size=(200, 12)) * 1e-3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] + [1.0] * 11), (2003, [float("inf")] + [1.0] * 11), (2004, [None] + [1.0] * 11), (2005, []), (2020, [1.0, 2.0]), (None, [1.0] * 12)]
    frame = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, key int, id int")
    found = {}
    for r in nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    expected = brute(rows, lambda i: i % 20 == 0, 20)
    assert set(found) == set(expected) and all(len(v) == 20 for v in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in e}) for q, e in expected.items())
    assert hits / (20 * len(expected)) >= 0.9
    vectors = dict(rows[:1500])
    for q, near in found.items():
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))
        assert all(abs(s - np.dot(vectors[q], vectors[i])) < 1e-9 for i, s in near)
    assert [i for i, _ in found[200]][:20] == list(range(201, 221)) or found[200][0][1] > np.dot(x[200], x[200])


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 0.5), (2, 0.0)]
    assert nearest(few.limit(0), F.lit(True)).count() == 0
    assert nearest(few.filter("vec_id = 0"), F.lit(True)).count() == 0


def test_lists_of_a_batch_are_those_of_each_vector():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3_000, 6)) * rng.uniform(0.5, 2, size=(3_000, 1))
    index = build(x, (x * x).sum(1).max(), len(x), 20)
    lifted, asked = index.lifted(x[:300]), index.lifted(x[:300], query=True)
    held, searched = index.holding(lifted), index.searched(asked, index.ratio, LEAST_LISTS)
    for i in range(300):
        d = np.linalg.norm(index.centroids - lifted[i], axis=1)
        chosen = []
        for c in np.argsort(d):
            if d[c] <= (1 + NEAR) * d.min() and len(chosen) < REPLICAS and all(np.linalg.norm(index.centroids[c] - index.centroids[o]) > d[c] for o in chosen):
                chosen.append(c)
        assert set(np.flatnonzero(held[i])) == set(chosen)
        d = np.linalg.norm(index.centroids - asked[i], axis=1)
        assert set(np.flatnonzero(searched[i])) == set(np.flatnonzero((d <= (1 + index.ratio) * d.min()) | (d <= np.sort(d)[LEAST_LISTS - 1])))
    assert held.sum(1).max() > 1


def test_a_thin_sample_does_not_widen_the_search():
    # the sample's 20th neighbour is far beyond the table's 20th: the ratio must follow the table's
    x = np.random.default_rng(6).normal(size=(4_000, 8))
    top, asked = (x * x).sum(1).max(), slice(0, 200)
    whole = build(x[:1_000], top, 1_000, 20)
    thin = build(x[:1_000], top, 20_000, 20)
    shares = [one.searched(one.lifted(x[asked], query=True), one.ratio, LEAST_LISTS).mean() for one in (whole, thin)]
    assert shares[1] < 0.7 * shares[0]
