import math
import os
import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import granary.llm.context_mixing as cm
from granary.llm.common import CLEANUP

WORDS = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in ("", "n", "rst")]


def texts(n, seed=0):
    rng = random.Random(seed)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    return [" ".join(rng.choices(WORDS, weights, k=rng.randrange(0, 120))) for _ in range(n)]


def rows_of(spark):
    rows = [(i, t) for i, t in enumerate(texts(120))]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "Ban BAN\x0bünknown 中文 " + "x" * 5000), (503, "Ban BAN\x0bünknown 中文 " + "x" * 5000)]
    return rows, spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_tokens int, `odd.name` string")


def test_base_score_and_counts(spark, monkeypatch):
    rows, frame = rows_of(spark)
    counts = cm.word_counts(frame.filter("doc_id < 100"))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    c = Counter(w for i, t in rows if i < 100 for w in words(t))
    n, v = sum(c.values()), len(c)
    model = cm.train(counts)
    found = {}
    for most in (10, 10_000):  # with most words' counts joined, then with all of them broadcast
        monkeypatch.setattr(cm, "MOST_FREQUENT", most)
        got = cm.score(frame, model, counts).collect()
        assert len(got) == len(rows) and {r["odd.name"] for r in got} == {"x"}
        for r in got:
            expected = dict(rows)[r.doc_id]
            assert r.n_tokens == len(words(expected)) and r.n_known == sum(c[w] > 0 for w in words(expected)) and r.train_tokens == n
            base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(expected))
            assert abs(r.base_score - base) < 1e-6
            assert found.setdefault(r.doc_id, r.score) == r.score < 0
    held_out = [r for r in got if 100 <= r.doc_id < 120]
    assert sum(r.score for r in held_out) > 1.1 * sum(r.base_score for r in held_out)
    assert sum(r.bits_per_byte for r in held_out) / len(held_out) < 2.5


def seen_in(counts, codes):
    """All counts at once, of every predictor."""
    rows = counts.toPandas()
    keys, bits, ns = [], [], []
    for _, some in rows[(rows["kind"] == 1) | (rows["word"].str.len() >= cm.HEAD)].groupby("kind"):
        found = cm._decisions_of(some, codes)
        for k in range(cm.N if some["kind"].iloc[0] else cm.TOPIC):
            keys.append(found.slots[k])
            bits.append(found.bit)
            ns.append(np.repeat(some["n"].to_numpy(float), found.size))
    key, _, both = cm._sums(np.concatenate(keys), np.concatenate(bits), np.concatenate(ns))
    return cm.Seen(key, both[:, 0], both[:, 1])


def test_symbols_share_one_probability(spark):
    """Whatever comes first, the chances of all symbols that can come next sum to one, but for the little that a way around to a seen symbol wastes."""
    _, frame = rows_of(spark)
    counts = cm.word_counts(frame.filter("doc_id < 100"))
    codes = cm.train(counts)
    seen, weights = seen_in(counts, codes), np.tile(np.float32([0.1, 0.2, 0.3, 0.4, 0.3]), (cm.GATES, 1))
    for before in (b"", b"ba", b"zq"):
        for top in (b"", b"ba"):
            strings = [before + bytes([s]) for s in range(256)]
            found = cm.decisions(strings, codes, [top] * 256)
            looked = cm._looked([seen[x] for x in found.slots], found.bit)
            z = (looked[:, : cm.N] / cm.SCALE * weights[looked[:, cm.N]]).sum(1)
            logs = np.add.reduceat(-np.log1p(np.exp(-z)), found.first)
            skip = cm.decisions([before], codes, [top]).size[0] if before else 0
            own = np.array([-np.log1p(np.exp(-z[a : a + skip])).sum() for a in found.first]) if skip else 0
            assert 0.995 < np.exp(logs - own).sum() < 1 + 1e-9


@pytest.mark.parametrize(("at_once", "most_shared"), ((3, 10**6), (17, 0), (20_000, 10**6)))
def test_odds_come_from_the_counts_of_all_texts(spark, monkeypatch, at_once, most_shared):
    """However the words are cut into groups, every context's counts are those of all training words, and of no other context."""
    monkeypatch.setattr(cm, "WORDS_AT_ONCE", at_once)
    monkeypatch.setattr(cm, "MOST_SHARED", most_shared)
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(400)]
    rows = [(k, " ".join(rng.choices(words[:300] if k < 40 else words, k=30))) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    counts = cm.word_counts(frame.filter("doc_id < 40"))
    codes = cm.train(counts)
    seen = seen_in(counts, codes)
    wanted = cm.word_counts(frame).filter(f"kind = 1 or length(word) >= {cm.HEAD}").drop("n").join(counts, ["kind", "top", "word"], "left").fillna({"n": 0})
    found = cm.odds_of_pieces(wanted, codes).toPandas()
    pairs = found[found["cell"].isna()]
    assert len(pairs) == wanted.count()
    for (_, row), odds in zip(pairs.iterrows(), pairs["odds"], strict=True):
        one = cm._decisions_of(row.to_frame().T, codes)
        assert odds == cm._looked([seen[x] for x in one.slots[: cm.N if row["kind"] else cm.TOPIC]], one.bit).tobytes()
    n = {(r.kind, r.top, r.word): r.n for r in counts.collect()}
    named = zip(pairs["kind"], pairs["top"], pairs["word"], pairs["odds"], strict=True)
    assert found["m"].sum() == sum(n[k, t, w] * len(o) // (cm.N + 1) for k, t, w, o in named if (k, t, w) in n)


def test_leading_short_words():
    rng = random.Random(4)
    texts = [None, "", "a b b a a long b b"] + [" ".join(rng.choices(["a", "bb", "ccc", "dddd", "12", "\u00fc"], k=rng.randrange(40))) for _ in range(30)]
    coded = cm.Coded.of(texts)
    expected = []
    for t in texts:
        counts, lead = Counter(), -1
        for w in [*(t or "").encode().split(), cm.END]:
            expected.append(lead)
            if w.isalpha() and len(w) <= cm.SHORT:
                counts[w] += 1
                if lead < 0 or counts[w] > counts[coded.words[lead]]:
                    lead = coded.words.index(w)
    assert coded.tops().tolist() == expected
    numbers, kinds, tops, words = coded.pieces()
    for head, rest, top, word in zip(numbers[::2], numbers[1::2], expected, coded.flat, strict=True):
        symbols = cm.symbols_of(coded.words[word])
        assert (kinds[head - 1], tops[head - 1], words[head - 1]) == (1, coded.words[top] if top >= 0 else b"", symbols[: cm.HEAD])
        assert (rest == 0) == (len(symbols) <= cm.HEAD) and (rest == 0 or (kinds[rest - 1], words[rest - 1]) == (0, coded.words[word]))


def plain_score(flat, words, weights):
    """One text's score, word by word in plain numbers."""
    delta, bend = np.zeros((cm.GATES, cm.N)), np.zeros(1 + len(cm.KNOTS))
    total = 0.0
    for a in range(0, len(flat), 2 * cm.BLOCK):
        d, b = np.zeros_like(delta), np.zeros_like(bend)
        for word in flat[a : a + 2 * cm.BLOCK]:
            for row in np.frombuffer(words[word], np.int8).reshape(-1, cm.N + 1):
                x, g = row[: cm.N] / cm.SCALE, row[cm.N]
                z = float(x @ (weights[g] + delta[g]))
                bases = np.array([z, *(min(max(z, -k), k) for k in map(float, cm.KNOTS))])
                p = 1 / (1 + math.exp(-(z + bend @ bases)))
                total += math.log10(p)
                d[g] += cm.RATE * (1 - p) * x
                b += cm.BEND * (1 - p) * bases
        delta, bend = delta + d, bend + b
    return total


def test_scores_against_a_plain_version(monkeypatch):
    rng = np.random.default_rng(2)
    words = []
    for n in rng.integers(1, 12, 50):
        rows = rng.integers(-30, 60, (n, cm.N + 1)).astype(np.int8)
        rows[:, cm.N] = rng.integers(0, cm.GATES, n)
        words.append(rows.tobytes())
    flat = [rng.integers(0, 50, n).astype(np.int32) for n in (1, 2, cm.BLOCK, 40, 41, 333, 7)]
    weights = rng.normal(0.2, 0.1, (cm.GATES, cm.N)).astype(np.float32)
    expected = [plain_score(f, words, weights.astype(float)) for f in flat]
    assert np.allclose(cm.scores(flat, words, weights), expected, rtol=1e-4)
    monkeypatch.setattr(cm, "DECISIONS_AT_ONCE", 64)
    assert np.allclose(cm.scores(flat, words, weights), expected, rtol=1e-4) and len(cm.scores([], [], weights)) == 0


def test_weights_are_the_most_likely_ones():
    rng = np.random.default_rng(5)
    true = np.array([0.5, -0.2, 0.3, 0.1, 0.6])
    looked = np.zeros((60_000, cm.N + 1), np.int8)
    looked[:, : cm.N] = np.clip(np.rint(rng.normal(0, 18, (60_000, cm.N)) / cm.STEPS) * cm.STEPS, -63, 63)
    side = np.where(rng.random(60_000) < 1 / (1 + np.exp(-(looked[:, : cm.N] / cm.SCALE @ true))), 1, -1)
    looked[:, : cm.N] *= side[:, None].astype(np.int8)
    found = cm.fitted_weights(*cm._cells(looked, np.ones(60_000)))
    assert np.allclose(found[0], true, atol=0.05) and np.allclose(found[1], [0.1, 0.2, 0.3, 0.3, 0.3])


def test_a_score_depends_on_its_text_only(spark):
    _, frame = rows_of(spark)
    counts = cm.word_counts(frame)
    model = cm.train(counts)
    one = {(r.doc_id, r.score) for r in cm.score(frame.coalesce(1), model, counts).collect()}
    many = {(r.doc_id, r.score) for r in cm.score(frame.repartition(7), model, counts).collect()}
    assert one == many


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "abc def"), (2, None)], "doc_id long, text string")
    none = frame.limit(0)
    counts = cm.word_counts(none)
    found = cm.score(frame, cm.train(counts), counts).orderBy("doc_id").collect()
    assert [r.n_tokens for r in found] == [3, 1] and all(r.score < 0 and r.n_known == 0 and r.train_tokens == 0 for r in found)
    assert cm.score(none, cm.train(counts), counts).count() == 0


def test_frequent_pieces_are_not_stored_by_batch(spark, monkeypatch):
    """A piece that training texts hold often is broadcast; whatever is, the scores are the same."""
    monkeypatch.setattr(cm, "TEXTS_AT_ONCE", 10)
    _, frame = rows_of(spark)
    counts = cm.word_counts(frame.filter("doc_id < 100"))
    model, found, rows = cm.train(counts), [], []

    def watched(df, name, stored=cm.stored, **options):
        out = stored(df, name, **options)
        if name == "coded":
            rows.append(out.filter("id is not null").count())
        return out

    monkeypatch.setattr(cm, "stored", watched)
    for often in (0, 20, 10**6):
        monkeypatch.setattr(cm, "OFTEN", often)
        found.append(sorted((r.doc_id, r.n_known, r.base_score, r.score) for r in cm.score(frame.repartition(3, "doc_id"), model, counts).collect()))
    monkeypatch.setattr(cm, "LONGEST_OFTEN", 3)  # longer pieces stay in their batches however frequent
    found.append(sorted((r.doc_id, r.n_known, r.base_score, r.score) for r in cm.score(frame.repartition(3, "doc_id"), model, counts).collect()))
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == 125 and rows[3] > rows[2]
    assert rows[0] > rows[1] > rows[2] > 0  # words of the texts without a number in training stay in their batches


def test_numbers_in_planes():
    for numbers in ([], [0], [1, 300, 70_000, 2**31 - 1]):
        assert cm._from_planes(cm._planes(np.array(numbers, np.int32))).tolist() == numbers


def test_pieces_come_to_each_batch_that_asks():
    rng = np.random.default_rng(8)
    odds = [rng.integers(-9, 9, (n, cm.N + 1)).astype(np.int8).tobytes() for n in rng.integers(0, 9, 300)]
    asked = [rng.choice(7, rng.integers(1, 5), replace=False).astype(np.int64) << 32 for _ in odds]
    ids = [rng.integers(0, 2**31 - 1, len(a)) for a in asked]
    rows = pd.DataFrame({"batches": asked, "ids": ids, "odds": odds, "seen": rng.integers(0, 2**40, len(odds))})
    sent = pd.concat(cm._sent(iter([rows.iloc[:120], rows.iloc[120:120], rows.iloc[120:]])))
    assert len(sent) == 14  # one row a batch and part, not one a piece
    for of, some in sent.groupby("of"):
        expected = sorted((int(i), int(rows["seen"][k]), odds[k]) for k in range(300) for b, i in zip(asked[k], ids[k], strict=True) if b == of)
        seen, found = cm._received(some)
        assert seen.tolist() == [n for _, n, _ in expected] and found == [o for _, _, o in expected]
    seen, found = cm._received(sent.iloc[:0])
    assert len(seen) == len(found) == 0


def test_texts_are_stored_by_batch(spark, monkeypatch):
    """Packed as they are, the numbers of a batch's texts give the same scores, however they are cut."""
    _, frame = rows_of(spark)
    counts = cm.word_counts(frame)
    model, found, rows = cm.train(counts), [], []

    def watched(df, name, stored=cm.stored, **options):
        out = stored(df, name, **options)
        if name == "coded":
            rows.append(out.filter("flat is not null").count())
        return out

    monkeypatch.setattr(cm, "stored", watched)
    for at_once in (10**6, 37):
        monkeypatch.setattr(cm, "NUMBERS_AT_ONCE", at_once)
        found.append(sorted((r.doc_id, r["odd.name"], r.n_tokens, r.score) for r in cm.score(frame.coalesce(1), model, counts).collect()))
    assert found[0] == found[1] and len(found[0]) == 125 and rows[0] == 1 < 100 < rows[1]


def test_shuffle_files_go_with_the_write(spark, tmp_path):
    """What a stored table was shuffled through takes no disk any more, without the driver collecting garbage."""
    top = Path(os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", "/tmp"))
    files = lambda: {p for p in top.glob("blockmgr-*/*/shuffle_*.data")}
    before, setting = files(), spark.conf.get(CLEANUP, None)
    spark.range(1000).groupBy((F.col("id") % 97).alias("k")).count().write.parquet(str(tmp_path / "plain"))
    assert files() - before  # a plain write leaves them
    before = files()
    found = cm.stored(spark.range(1000).groupBy((F.col("id") % 97).alias("k")).count(), "counts")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and found.count() == 97
    assert spark.conf.get(CLEANUP, None) == setting
