import random

import numpy as np
from pyspark.sql import functions as F

from granary.llm.language_id import END, ORDER, START, _hash_texts, calibrate, count_sequences, identify, smooth, sums, train, words_of

SYLLABLES = {"aa": "ka ko mi ta ru shi".split(), "bb": "the ing er an st wh".split(), "cc": "ción os la el rr ñ".split()}


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(8, 40))), lang) for i, lang in zip(range(n), random.Random(1).choices(list(SYLLABLES), k=n), strict=True)]


def test_chances_of_all_next_characters_sum_to_one():
    counts = {"x": {}, "y": {}}
    for lang, words in (("x", "aba abab bab aab"), ("y", "bcb cbc bb cab")):
        for word in words.split():
            p = START + word + END
            for i in range(1, len(p)):
                s = p[max(0, i - 2) : i + 1]
                counts[lang][s] = counts[lang].get(s, 0) + 1
    models = smooth(counts, 3)
    letters = "abc" + END
    for before in ("", "a", "ab", "ba", "cc", "cab"):
        logs = [models.score([before])[0] if c == END else partial(models, before + c) for c in letters]
        total = np.exp(np.array(logs) - partial(models, before)).sum(0)
        assert (total < 1 + 1e-5).all() and (total > 0.75).all()  # what is missing belongs to characters never seen


def partial(models, word):
    """The log probability of a word's characters without its end."""
    if not word:
        return np.zeros(2)
    return models.score([word])[0] - end_of(models, word)


def end_of(models, word):
    padded = START + word + END
    size = min(len(padded), models.order)
    out = np.zeros(2)
    for n in range(size, 0, -1):
        seq = padded[-n:]
        key = _hash_texts([seq])[0]
        k = np.searchsorted(models.keys[n], key)
        if k < len(models.keys[n]) and models.keys[n][k] == key:
            return out + models.logs[n][k]
        if n > 1:
            key = _hash_texts([seq[:-1]])[0]
            k = np.searchsorted(models.context_keys[n], key)
            if k < len(models.context_keys[n]) and models.context_keys[n][k] == key:
                out = out + models.context_logs[n][k]
    return out + models.unseen


def test_held_out_accuracy_and_rejection(spark):
    rows = texts(300, 0)
    frame = spark.createDataFrame([(*r, 1.0) for r in rows] + [(900, "ka mi", None, 1.0), (901, None, "aa", 1.0)], "doc_id long, text string, lang string, score double")
    models = train(frame)
    limits = calibrate(frame, models)
    odd = [(0, None), (1, ""), (2, "12 34 !?"), (3, "щщщ жжж ъъъ ыыы эээ"), (4, "KA MI TA ru"), (4, "KA MI TA ru"), (5, "the wher " * 20_000)]
    fresh = [(1000 + i, t) for i, t, _ in texts(300, 9)]
    found = identify(spark.createDataFrame([(*r, "x") for r in odd + fresh], "doc_id long, text string, lang string"), models, limits).collect()
    assert len(found) == len(odd) + len(fresh)
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (0, 1, 2))
    assert by[3].rejected and by[4].lang_pred == "aa" and by[5].lang_pred == "bb" and not by[5].rejected
    assert np.mean([by[1000 + i].lang_pred == lang for i, _, lang in texts(300, 9)]) > 0.99
    assert np.mean([by[1000 + i].rejected for i in range(300)]) < 0.02 and all(0 <= r.score <= 1 for r in found)


def test_slices_change_nothing(spark, monkeypatch):
    models = train(spark.createDataFrame(texts(50, 2), "doc_id long, text string, lang string"))
    t = ["the ing", None, "ka ka ka", "", "novel ünkñown", "x", "..."]
    whole = sums(models, t)
    monkeypatch.setattr("granary.llm.language_id.CHARS_AT_ONCE", 3)
    assert np.allclose(sums(models, t), whole) and whole.shape == (7, 4) and sums(models, []).shape == (0, 4)
    assert (whole[[1, 3, 6]] == 0).all()


def test_number_signs_are_no_letters():
    assert words_of("½ ² Ⅷ 12 _") == [] and words_of("x² ÄÖ_b") == ["x", "äö", "b"]


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    models = train(frame)
    assert [(r.lang_pred, r.score, r.rejected) for r in identify(frame, models, calibrate(frame, models)).collect()] == [("und", 0.0, True)]
    assert identify(frame.limit(0), models).count() == 0


def test_every_sequence_counts(spark):
    """The models are those of all sequences, and a language of few rows beside one of very many sequences is kept."""
    rng = random.Random(5)
    many = "abcdefghijklmnopqrstuvwxyz"
    rows = [*texts(60, 4), *[(1000 + i, " ".join("".join(rng.choices(many, k=9)) for _ in range(40)), "dd") for i in range(60)], (2000, "žluťoučký kůň", "ee")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts: dict = {}
    for lang, seq, n in count_sequences(frame).collect():
        counts.setdefault(lang, {})[seq] = n
    models, whole = train(frame), smooth(counts)
    assert models.langs == whole.langs == ["aa", "bb", "cc", "dd", "ee"] and models.order == ORDER
    for n in range(1, ORDER + 1):
        for k, v, k2, v2 in ((models.keys[n], models.logs[n], whole.keys[n], whole.logs[n]), (models.context_keys[n], models.context_logs[n], whole.context_keys[n], whole.context_logs[n])):
            assert np.array_equal(k, k2) and np.allclose(v, v2, atol=1e-5)
    assert np.allclose(models.unseen, whole.unseen)
    assert identify(spark.createDataFrame([(1, "kůň žluťoučký")], "doc_id long, text string"), models).first().lang_pred == "ee"


def test_a_language_of_one_row_stays_beside_very_many_sequences(spark):
    word = F.lower(F.translate(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), "0123456789+/=", "абвгдежзийклм"))
    large = spark.range(20_000).groupBy(F.pmod("id", F.lit(50)).alias("doc_id")).agg(F.array_join(F.collect_list(word), " ").alias("text")).withColumn("lang", F.lit("dd"))
    frame = large.union(spark.createDataFrame([(2000, "žluťoučký kůň", "ee")], "doc_id long, text string, lang string"))
    assert train(frame).langs == ["dd", "ee"]
