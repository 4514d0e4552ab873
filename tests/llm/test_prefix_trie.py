"""The prefix trie against a plain version over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from granary.llm import prefix_trie as P


def plain(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv_id].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in of if len(built[c]) == len(node))
        out.append((of[0], len(node), members[node[:-1]][0] if node else None, len(of), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def run(spark, folder, rows):
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, size int, path string").write.parquet(f"{folder}/conversations.parquet")
    return sorted(map(tuple, P.op12_prefix_trie(spark, str(folder)).select(NAMES).collect()), key=repr)


def conversations(seed, n, texts, longest):
    random.seed(seed)
    return [(c, t, random.choice(["user", None]), random.choice(texts)) for c in random.sample(range(4 * n), n) for t in range(random.randrange(1, longest))]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("partitions", ["3", "16"])
def test_equals_the_plain_version(spark, tmp_path, seed, partitions, monkeypatch):
    """Few texts, so that paths are shared, and one large group of copies that fills several shards."""
    monkeypatch.setattr(P, "ENDS_AT_ONCE", 7)
    rows = conversations(seed, 120, ["a", "b", "é\n", "", None], 7)
    rows += [(1_000 + 5 * k, t, "user", f"copy {t}") for k in range(200) for t in range(4)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert run(spark, tmp_path, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark, tmp_path):
    """Null ids and turns, ties, repeated rows, very long conversations and texts, conversations without turns left."""
    rows = [(None, 1, "user", "lost"), (3, None, "user", "first"), (3, 0, "user", "x"), (3, 0, "user", "x"), (3, 0, "assistant", "y"), (4, 5, None, None)]
    rows += [(20, t, "user", f"turn {t % 3}") for t in range(2_000)] + [(21, t, "user", f"turn {t % 3}") for t in range(1_500)] + [(22, 0, "user", "w" * 100_000)]
    assert any(len([r for r in rows if r[0] == c]) <= zlib.crc32(str(c).encode()) % 9 for c in (3, 4, 22))
    assert run(spark, tmp_path, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(8, 1, "user", "x")]])
def test_small_tables(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == plain(rows)


def test_skeleton_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(P, "SKELETON", 64)
    found = spark.createDataFrame([(k, bytes([k % 7, k]) * 80, b"\0" * 80) for k in range(100)], "conv_id long, path binary, sizes binary")
    skeleton = P.skeleton_of(found, 50)
    assert 1 <= len(skeleton.splitters) and len(skeleton.parent) <= 64
    assert skeleton.last[0] == len(skeleton.parent) - 1
