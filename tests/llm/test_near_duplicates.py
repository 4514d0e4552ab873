import random
import re

import numpy as np
import pytest

from granary.llm import near_duplicates as nd
from granary.llm.near_duplicates import BANDS, least_matches, near_duplicates, shingles


def brute(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.setdefault(i, []).append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if any(a and b and 100 * len(a & b) >= 85 * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for i in ids for s in sets[i])


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, n = [], 0
    common = [word() for _ in range(40)]

    def add(words):
        nonlocal n
        rows.append((rng.randrange(10**6) * 1000 + n, " ".join(words)))
        n += 1

    for size in (3, 5, 8, 30, 120):  # families around an original: copies that reach it, not always each other
        original = [word() for _ in range(size)]
        for _ in range(25):
            copy = list(original)
            for _ in range(rng.choice((0, 1, 1, 1 + size // 60))):
                copy[rng.randrange(size)] = word()
            add(copy)
    chain = [word() for _ in range(200)]
    for k in range(40):  # a chain: neighbours are near, ends are not
        chain[(k * 7) % 200] = word()
        add(list(chain))
    for _ in range(60):  # one passage that many share
        add([*common, *[word() for _ in range(rng.randrange(5, 60))]])
    rows += [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, "a b c d"), (7, "A B\x0bC  D"), (8, "a b c")]
    return rows + rows[:4]


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, rep int, key int, n int")
    found = sorted(tuple(r) for r in near_duplicates(frame).collect())
    assert found == brute(rows)


def test_groups_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_BYTES", 5 * nd.LEAST_BYTES)
    monkeypatch.setattr(nd, "BLOCK", 4)
    rows = corpus(7)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(frame).collect()) == brute(rows)


def test_forests_connect_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    for n in (2, 3, 30, 200):
        base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, 60 - k, replace=False), rng.integers(0, 1 << 60, k).astype(np.uint64)])) for k in rng.integers(0, 9, n)]
        links = {(i, j) for i in range(n) for j in range(n) if i < j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
        edges, _ = nd.forest_within(nd.Sets(sets))
        assert len(edges) < n and {(min(e), max(e)) for e in edges} <= links and parts(n, edges) == parts(n, links)
        half = n // 2
        between = nd.forest_between(np.arange(half), np.arange(half, n), np.arange(n), nd.Sets(sets).near)
        across = {e for e in links if e[0] < half <= e[1]}
        assert len(between) < n and set(between) <= across and parts(n, between) == parts(n, across)


def parts(n, edges):
    label = list(range(n))
    for i, j in edges:
        label = [label[j] if x == label[i] else x for x in label]
    return {frozenset(k for k in range(n) if label[k] == x) for x in label}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingles_count_distinct():
    assert len(shingles("a b c d e a b c d e")) == 5
    assert len(shingles("x" * 300_000)) == 1
    assert np.array_equal(shingles("Ä b c d e"), shingles("Ä B c D e")) and not np.array_equal(shingles("Ä b c d e"), shingles("ä b c d e"))


def test_pruning_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(0)
    for n in (36, 84, 252):
        assert (rng.binomial(n, 0.85, 200_000) >= least_matches(n)).all()
    assert (1 - 0.85**7) ** BANDS < 1e-6
