"""Language identification with interpolated Kneser-Ney character models.

One model per language over lower-cased words (runs of letters) between a start and
an end mark. Counts are gathered from all training rows in Spark: words by language,
then character sequences by language, then their continuation counts, discounts and
back-off weights; no sequence is left out. The models are held together in sorted arrays
of sequence hashes, one row of log probabilities (a column per language) for each
sequence that any language has, and one of backing-off weights for each context. A
text gets the language of the lowest cross-entropy per character. It is rejected
where even that lies above the language's limit, calibrated on the training texts.

Defined results: null texts and texts without a letter (number signs such as ½ and Ⅷ are
none) are ``und`` with score 0 and rejected; null ids are in no fold: they are scored,
train nothing and have a null held_out; repeated rows stay and weigh as often as they occur; null languages train
nothing; ties go to the smaller language value; without a training row every text is
``und``; extra columns are ignored; very long texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import fold, stored, table

ORDER = 5
START, END = "\x02", "\x03"
CHARS_AT_ONCE = 1 << 20


_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; number signs that are no digits part them as digits do."""
    words = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [part for word in words for part in "".join(c if c.isalpha() else " " for c in word).split()]


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        by_lang: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            by_lang.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, word, n) for lang, counts in by_lang.items() for word, n in counts.items()]
        yield pd.DataFrame(rows, columns=["lang", "word", "n"])


def _sequences(order: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, word, n in zip(batch["lang"], batch["word"], batch["n"], strict=True):
                padded = START + word + END
                for i in range(1, len(padded)):
                    counts[lang, padded[max(0, i - order + 1) : i + 1]] += n
            yield pd.DataFrame([(lang, s, n) for (lang, s), n in counts.items()], columns=["lang", "seq", "n"])

    return count


def _hash(codes: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(codes[0]), len(codes), np.uint64)
    for c in codes:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _hash_texts(texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    lengths = np.array([len(x) for x in texts])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        if n:
            codes = np.frombuffer("".join([texts[i] for i in at]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            out[at] = _hash([codes[:, k] for k in range(n)])
    return out


def _sorted(rows: dict[str, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    keys = _hash_texts(list(rows))
    at = np.argsort(keys)
    return keys[at], (np.stack(list(rows.values()))[at] if rows else np.zeros((0, width))).astype(np.float32)


@dataclass
class Models:
    langs: list[str]
    order: int
    keys: list[np.ndarray]  # by length of the sequence: its sorted hashes
    logs: list[np.ndarray]  # and a row of log probabilities for each, a column per language
    context_keys: list[np.ndarray]
    context_logs: list[np.ndarray]
    unseen: np.ndarray  # log probability of a character never seen

    def score(self, words: list[str]) -> np.ndarray:
        """The log probability of each word, its end included, by language."""
        padded = [START + w + END for w in words]
        lengths = np.array([len(p) for p in padded])
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = np.arange(len(codes)) - first
        word = np.repeat(np.arange(len(words)), lengths)
        todo = np.flatnonzero(place > 0)
        found = np.zeros(len(codes), bool)
        logs = np.zeros((len(codes), len(self.langs)), np.float32)
        size = np.minimum(place + 1, self.order)
        for n in range(self.order, 0, -1):
            at = todo[size[todo] >= n]
            if not len(at):
                continue
            columns = [codes[at - k] for k in range(n - 1, -1, -1)]
            keys = _hash(columns)
            k = np.minimum(np.searchsorted(self.keys[n], keys), max(0, len(self.keys[n]) - 1))
            hit = self.keys[n][k] == keys if len(self.keys[n]) else np.zeros(len(at), bool)
            logs[at[hit]] += self.logs[n][k[hit]]
            miss = at[~hit]
            if n > 1 and len(miss) and len(self.context_keys[n]):
                keys = _hash([c[~hit] for c in columns[:-1]])
                k = np.minimum(np.searchsorted(self.context_keys[n], keys), len(self.context_keys[n]) - 1)
                known = self.context_keys[n][k] == keys
                logs[miss[known]] += self.context_logs[n][k[known]]
            elif n == 1:
                logs[miss] += self.unseen
            found[at[hit]] = True
            todo = todo[~found[todo]]
        out = np.zeros((len(words), len(self.langs)), np.float64)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(word, weights=logs[:, k], minlength=len(words))
        return out


def smooth(counts: dict[str, dict[str, int]], order: int = ORDER) -> Models:
    """Interpolated Kneser-Ney models from {lang: {sequence: count}}, sequences of full length or from a word's start.

    All on the driver, for few counts; `smoothed` makes the same models in Spark.
    """
    langs = sorted(counts)
    width = len(langs)
    # count of each sequence at its own length: the highest order and word starts as they occur, others by distinct left neighbours
    levels: list[dict[str, np.ndarray]] = [{} for _ in range(order + 1)]
    for k, lang in enumerate(langs):
        full = counts[lang]
        for s, n in full.items():
            levels[len(s)].setdefault(s, np.zeros(width))[k] += n
        seen = {s for s in full}
        for n in range(order, 1, -1):
            shorter = {s[1:] for s in seen if len(s) == n}
            for s in (s for s in seen if len(s) == n):
                levels[n - 1].setdefault(s[1:], np.zeros(width))[k] += 1
            seen |= shorter
    alphabet = len(levels[1]) + 1
    keys, logs, context_keys, context_logs = [np.zeros(0, np.uint64)], [np.zeros((0, width), np.float32)], [np.zeros(0, np.uint64)], [np.zeros((0, width), np.float32)]
    lower: dict[str, np.ndarray] = {}
    unseen = np.full(width, 1 / alphabet)
    gammas: list[dict[str, np.ndarray]] = [{} for _ in range(order + 1)]
    for n in range(1, order + 1):
        rows = levels[n]
        totals: dict[str, np.ndarray] = {}
        kinds: dict[str, np.ndarray] = {}
        once, twice = np.zeros(width), np.zeros(width)
        for s, c in rows.items():
            totals.setdefault(s[:-1], np.zeros(width))
            kinds.setdefault(s[:-1], np.zeros(width))
            totals[s[:-1]] += c
            kinds[s[:-1]] += c > 0
            once += c == 1
            twice += c == 2
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
        gammas[n] = {x: np.where(t > 0, discount * kinds[x] / np.maximum(t, 1), 1.0) for x, t in totals.items()}
        now: dict[str, np.ndarray] = {}
        for s, c in rows.items():
            t, shorter = totals[s[:-1]], lower.get(s[1:], None)
            if n == 1:
                shorter = unseen
            elif shorter is None:  # a suffix that only stands at a word's start: back off to what is shorter still
                shorter = unseen.copy()
                for m in range(2, n):
                    if s[m:] in by_length[n - m]:
                        shorter = by_length[n - m][s[m:]]
                        break
            now[s] = np.where(t > 0, np.maximum(c - discount, 0) / np.maximum(t, 1), 0.0) + gammas[n][s[:-1]] * shorter
        if n == 1:
            by_length: list[dict[str, np.ndarray]] = [{}]
            bottom = gammas[1].get("", np.ones(width)) * unseen
        by_length.append(now)
        lower = now
        k, v = _sorted({s: np.log(p) for s, p in now.items()}, width)
        keys.append(k)
        logs.append(v)
        k, v = _sorted({x: np.log(g) for x, g in gammas[n].items()} if n > 1 else {}, width)
        context_keys.append(k)
        context_logs.append(v)
    return Models(langs, order, keys, logs, context_keys, context_logs, np.log(bottom if levels[1] else unseen).astype(np.float32))


def _shipped(frame: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of the first column's sequences, and the second's rows of logarithms."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seq, rows = (batch[c] for c in batch.columns)
            yield pd.DataFrame({"key": _hash_texts(list(seq)).view(np.int64), "logs": [np.log(row).astype(np.float32).tobytes() for row in rows]})

    found = frame.mapInPandas(hashed, "key long, logs binary").toArrow()
    keys = found["key"].to_numpy().view(np.uint64)
    at = np.argsort(keys)
    return keys[at], np.frombuffer(b"".join(found["logs"].to_pylist()), np.float32).reshape(-1, width)[at]


def smoothed(sequences: DataFrame, order: int = ORDER) -> Models:
    """The models of `smooth` from lang, seq and n, all sequences counted and smoothed in Spark; finished arrays come to the driver."""
    langs = sorted(lang for (lang,) in sequences.select("lang").distinct().collect())
    width = len(langs)
    if not langs:
        return smooth({}, order)
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    full = sequences.select(number.alias("k"), "seq", F.col("n").cast("double").alias("c"))
    levels: dict[int, DataFrame] = {}
    for m in range(order, 0, -1):  # the highest order and word starts as they occur, others by distinct left neighbours
        rows = full.filter(F.length("seq") == m)
        if m < order:
            rows = rows.union(levels[m + 1].select("k", F.expr("substring(seq, 2)"), F.lit(1.0)))
        levels[m] = stored(rows.groupBy("k", "seq").agg(F.sum("c").alias("c")), "level")
    unseen = 1 / (levels[1].select("seq").distinct().count() + 1)
    by_lang = lambda f: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), f)
    of_langs = lambda c: F.map_from_entries(F.collect_list(F.struct("k", c)))
    dense = lambda c: by_lang(lambda i: F.coalesce(F.element_at(c, i), F.lit(0.0)))
    keys, logs, context_keys, context_logs = [np.zeros(0, np.uint64)], [np.zeros((0, width), np.float32)], [np.zeros(0, np.uint64)], [np.zeros((0, width), np.float32)]
    lower, bottom = None, np.full(width, unseen)
    for n in range(1, order + 1):
        marks = {k: (once, twice) for k, once, twice in levels[n].groupBy("k").agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).collect()}
        once, twice = np.array([marks.get(k, (0, 0)) for k in range(width)], np.float64).T
        cut = F.array(*map(F.lit, np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95).tolist()))
        rows = levels[n].withColumn("context", F.expr(f"substring(seq, 1, {n - 1})"))
        totals = rows.groupBy("k", "context").agg(F.sum("c").alias("t"), F.count("*").cast("double").alias("kinds"))
        contexts = totals.groupBy("context").agg(of_langs("t").alias("t"), of_langs("kinds").alias("kinds")).select("context", dense("t").alias("t"), dense("kinds").alias("kinds"))
        gamma = by_lang(lambda i: F.when(F.get("t", i) > 0, F.get(cut, i) * F.get("kinds", i) / F.greatest(F.get("t", i), F.lit(1.0))).otherwise(F.lit(1.0)))
        contexts = stored(contexts.select("context", "t", gamma.alias("gamma")), "contexts")
        counts = rows.groupBy("seq", "context").agg(of_langs("c").alias("c")).select("seq", "context", dense("c").alias("c")).join(contexts, "context")
        if n == 1:
            counts = counts.withColumn("shorter", F.array_repeat(F.lit(unseen), width))
            bottom = np.array(contexts.first()["gamma"]) * unseen
        else:
            counts = counts.withColumn("suffix", F.expr("substring(seq, 2)")).join(lower.select(F.col("seq").alias("suffix"), F.col("p").alias("shorter")), "suffix")
        seen = lambda i: F.greatest(F.get("c", i) - F.get(cut, i), F.lit(0.0)) / F.greatest(F.get("t", i), F.lit(1.0))
        p = by_lang(lambda i: seen(i) + F.get("gamma", i) * F.get("shorter", i))
        lower = stored(counts.select("seq", p.alias("p")), "chances")
        for frame, to_keys, to_logs in ((lower, keys, logs), (contexts.select("context", "gamma").filter(F.lit(n > 1)), context_keys, context_logs)):
            k, v = _shipped(frame, width)
            to_keys.append(k)
            to_logs.append(v)
    return Models(langs, order, keys, logs, context_keys, context_logs, np.log(bottom).astype(np.float32))


def count_sequences(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, seq and n of the character sequences in text and lang of all rows."""
    words = rows.filter("lang is not null and text is not null").select("lang", "text").mapInPandas(_count_words, "lang string, word string, n long")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sequences = words.mapInPandas(_sequences(order), "lang string, seq string, n long").groupBy("lang", "seq").agg(F.sum("n").alias("n"))
    return stored(sequences, "sequences")


def train(rows: DataFrame, order: int = ORDER) -> Models:
    """Models from text and lang of all rows."""
    return smoothed(count_sequences(rows, order), order)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, a few at a time: CHARS_AT_ONCE or one text."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= CHARS_AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def sums(models: Models, texts: list[str | None]) -> np.ndarray:
    """By text: the log probability by language, then the number of characters with word ends. Each distinct word is scored once a slice."""
    out = [np.zeros((0, len(models.langs) + 1))]
    for part in _slices(texts):
        index, lists = _Numbers(), list(map(words_of, part))
        sizes = np.array(list(map(len, lists)), np.int64)
        flat = np.fromiter(map(index.__getitem__, chain.from_iterable(lists)), np.int32, sizes.sum())
        del lists
        words = list(index)
        scores = [np.column_stack([models.score(words[k : k + 50_000]), [len(w) + 1 for w in words[k : k + 50_000]]]) for k in range(0, len(words), 50_000)]
        found, some = np.zeros((len(part), len(models.langs) + 1)), sizes > 0
        for k, column in enumerate(np.concatenate(scores).T if scores else ()):
            found[some, k] = np.add.reduceat(column[flat], (np.cumsum(sizes) - sizes)[some])
        out.append(found)
    return np.concatenate(out)


def guessed(text: Column, models: Models, limits: dict[str, float] | None = None) -> Column:
    """struct of lang_pred, score, entropy (nats a character) and rejected of a text."""
    shared = SparkSession.active().sparkContext.broadcast((models, limits or {}))

    @F.pandas_udf("lang_pred string, score double, entropy double, rejected boolean")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        models, limits = shared.value
        langs = np.array([*models.langs, "und"], dtype=object)
        most = np.array([*(limits.get(x, np.inf) for x in models.langs), -np.inf])
        for batch in batches:
            found = sums(models, list(batch))
            size, logs = found[:, -1], np.column_stack([found[:, :-1], np.full(len(found), -np.inf)])
            some = (size > 0) & (len(models.langs) > 0)
            best = np.where(some, logs.argmax(1), len(langs) - 1)
            top = np.where(some, logs.max(1), 0)
            score = np.where(some, 1 / np.maximum(1, np.exp(np.minimum(logs - top[:, None], 0)).sum(1)), 0.0)
            entropy = np.where(some, -top / np.maximum(size, 1), np.inf)
            yield pd.DataFrame({"lang_pred": langs[best], "score": score, "entropy": entropy, "rejected": entropy > most[best]})

    return guess(text)


def identify(documents: DataFrame, models: Models, limits: dict[str, float] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, entropy and rejected of each row of documents (doc_id, text)."""
    return documents.select("doc_id", guessed(F.col("text"), models, limits).alias("g")).select("doc_id", "g.*")


def limits_of(found: DataFrame, kept: float = 0.999, margin: float = 1.0) -> dict[str, float]:
    """By language, the cross-entropy that all but 1 - kept of the texts in found (lang_pred, entropy) stay under, plus a margin in nats."""
    limits = found.filter("lang_pred <> 'und'").groupBy("lang_pred").agg(F.percentile_approx("entropy", kept, 10_000)).collect()
    return {lang: most + margin for lang, most in limits}


def calibrate(rows: DataFrame, models: Models) -> dict[str, float]:
    return limits_of(identify(rows.filter("lang is not null"), models))


def training_rows(documents: DataFrame) -> DataFrame:
    return documents.filter(fold(F.col("doc_id"), 5) != 0).select("doc_id", "text", "lang")


def recognised(documents: DataFrame, into: str, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (else all) of documents (doc_id, text, lang and others), written once, with lang_pred, score, entropy and rejected in the struct `into`.

    Models and limits come from the rows of the training folds whose language is given; keep must name doc_id and lang.
    """
    models = train(training_rows(documents))
    kept = [F.col(f"`{c}`") for c in keep or documents.columns]
    found = stored(documents.select(*kept, guessed(F.col("text"), models).alias(into)), "guessed")
    trained = found.filter("lang is not null").filter(fold(F.col("doc_id"), 5) != 0).select(f"`{into}`.*")
    limit, lang, entropy = F.lit(None).cast("double"), F.col(f"`{into}`.lang_pred"), F.col(f"`{into}`.entropy")
    for one, most in limits_of(trained).items():
        limit = F.when(lang == one, most).otherwise(limit)
    rejected = (lang == "und") | F.coalesce(entropy > limit, F.lit(False))
    return found.withColumn(into, F.col(f"`{into}`").withField("rejected", rejected))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = recognised(documents, "found", keep=["doc_id", "lang"])
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "found.lang_pred", "found.score", "found.entropy", "found.rejected")
