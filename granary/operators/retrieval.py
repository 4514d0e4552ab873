"""Ranking: term counts, BM25, dense cosine, coverage rerank, reciprocal rank fusion, and the context around what is found."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.text import HAN, TERM, coverage, terms, tokens, tokens_of
from granary.operators import chunks as C
from granary.plans.shared import stored

K1, B, RRF_K = 1.5, 0.75, 60
THRESHOLD, KEYWORD_WEIGHT, CANDIDATES, LIMIT = 0.25, 0.2, 10, 3
ADJACENT, CONTEXT_LIMIT = 2, 8
QUESTIONS_AT_ONCE, CHUNKS_AT_ONCE, TERMS_AT_ONCE, RUN_BYTES = 1_024, 4_000, 200_000, 1 << 27


def top(df: DataFrame, n: int, *order, rank: str = "rank", by: str = "qid") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col(rank) <= n)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def pieces(spark: SparkSession, sf_dir: str, within: DataFrame | None = None) -> DataFrame:
    """The fixed chunks without their ids, which only what is found needs: source and chunk_index name a chunk. Of the sources of `within` only, if given."""
    return C.fixed_chunks(C.units(spark, sf_dir, within))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source and text of every document, to be cut into the same chunks in Arrow batches."""
    return C.documents(spark, sf_dir).select("source", "text")


def postings(chunks: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """source, chunk_index, term, dl and tf of a chunk's tokens, of the asked terms (term, distinct) only if given."""
    found = chunks.select("source", "chunk_index", tokens(F.col("content")).alias("tokens"))
    # explode_outer: an inner one has its array computed once more, for the filter that it brings
    found = found.select("source", "chunk_index", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term")).filter("term is not null")
    found = found if asked is None else found.join(asked, "term", "left_semi")
    return found.groupBy("source", "chunk_index", "term", "dl").agg(F.count("*").alias("tf"))


def best_chunks(scores: DataFrame, limit: int, by: str) -> DataFrame:
    """The `limit` best of scores (qid, source, chunk_index, content, by) of each question with chunk_id; ties go to the smaller chunk_id.

    Ids are hashes of the content: only what ranks by score alone, ties included, is hashed.
    """
    near = scores.withColumn("at", F.rank().over(Window.partitionBy("qid").orderBy(F.desc(by)))).filter(F.col("at") <= limit).drop("at")
    found = C.with_ids(near.withColumn("material_id", C.material_id(F.col("source"))))
    return top(found.select("qid", "chunk_id", "source", "chunk_index", "content", by), limit, F.desc(by), "chunk_id")


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[int], list[str]]]:
    """source, chunk_index and content of the fixed chunks of texts (source, text), about CHUNKS_AT_ONCE at a time."""
    sources: list[str] = []
    indexes: list[int] = []
    contents: list[str] = []
    for batch in batches:
        for source, text in zip(batch.column("source").to_pylist(), batch.column("text"), strict=True):
            found = C.pieces_of(text.as_py())
            contents += found
            indexes += range(1, len(found) + 1)
            sources += [source] * len(found)
            if len(contents) >= CHUNKS_AT_ONCE:
                yield sources, indexes, contents
                sources, indexes, contents = [], [], []
    if contents:
        yield sources, indexes, contents


class Best:
    """The `limit` best scores of each question that a task has seen so far: what is below the last of them is not given on."""

    def __init__(self, n: int, limit: int):
        self.limit, self.best = limit, np.zeros((n, limit))

    def places(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Question, chunk and score of positive scores (questions by chunks) that may be among the best, ties included; rounded to 6 places."""
        least = self.best[:, -1]
        asks, at = np.nonzero((scores >= least[:, None] - 1e-6) & (scores > 0))
        found = np.round(scores[asks, at], 6)
        cuts = np.searchsorted(asks, np.arange(len(scores) + 1))
        for q in np.flatnonzero(np.diff(cuts)):
            every = np.concatenate([self.best[q], found[cuts[q] : cuts[q + 1]]])
            self.best[q] = -np.sort(-np.partition(every, -self.limit)[-self.limit :])
        kept = (found >= self.best[asks, -1]) & (found > 0)
        return asks[kept], at[kept], found[kept]


def in_blocks(texts: DataFrame, asked: DataFrame, scorer, by: str, limit: int) -> DataFrame:
    """qid, source, chunk_index, content and `by` of the chunks of texts (source, text) that may be among the `limit` best of each question of asked (qid, terms).

    For each QUESTIONS_AT_ONCE questions, scorer(rows) runs once a task and gives the scores (questions by chunks) of a list
    of contents. A task gives on what is not below the best that it has seen so far, with its content: no row is made of a
    chunk and a question else, and nothing is looked up in the corpus again.
    """
    kinds = f"qid {asked.schema['qid'].dataType.simpleString()}, source string, chunk_index int, content string, {by} double"
    rows = asked.orderBy("qid").toLocalIterator()
    spark, found = texts.sparkSession, texts.sparkSession.createDataFrame([], kinds)
    while block := list(islice(rows, QUESTIONS_AT_ONCE)):
        shared = spark.sparkContext.broadcast([r.asDict(recursive=True) for r in block])

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scores, qids, best = scorer(shared.value), [r["qid"] for r in shared.value], Best(len(shared.value), limit)
            for sources, indexes, contents in cut_batches(batches):
                asks, at, values = best.places(scores(contents))
                if len(at):
                    columns = [[qids[q] for q in asks], [sources[i] for i in at], pa.array([indexes[i] for i in at], pa.int32()), [contents[i] for i in at], values]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["qid", "source", "chunk_index", "content", by])

        found = found.union(texts.select("source", "text").mapInArrow(score, kinds))
    return found


def numbered(rows: list[dict], term) -> tuple[dict, list[list[int]]]:
    """The number of each term that the questions ask for, and of each number the questions that do."""
    number: dict = {}
    owners: list[list[int]] = []
    for q, row in enumerate(rows):
        for x in row["terms"]:
            if number.setdefault(term(x), len(number)) == len(owners):
                owners.append([])
            owners[number[term(x)]].append(q)
    return number, owners


def frequencies(texts: DataFrame) -> DataFrame:
    """term and df (chunks that have it) of every token, and rows without a term: df holds the number of chunks, size that of all tokens.

    One pass over the texts (source, text), summed by task before it is shuffled, and stored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            columns = [pa.array([None, *df], pa.string()), pa.array([n, *df.values()], pa.int64()), pa.array([size] + [0] * len(df), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["term", "df", "size"])

        df, n, size = Counter(), 0, 0
        for _, _, contents in cut_batches(batches):
            n += len(contents)
            for content in contents:
                found = tokens_of(content)
                size += len(found)
                df.update(set(found))
            if len(df) >= TERMS_AT_ONCE:
                yield told()
                df, n, size = Counter(), 0, 0
        yield told()

    counted = texts.select("source", "text").mapInArrow(count, "term string, df long, size long")
    return stored(counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("size").alias("size")), "frequencies")


def bm25(texts: DataFrame, questions: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """qid, chunk_id, source, chunk_index, content, bm25, rank over the fixed chunks of texts (source, text), sources distinct; stored.

    The frequencies of all terms are counted first, then batches of chunks are scored for blocks of questions.
    """
    wanted = questions.select("qid", F.explode(terms(F.col("question"))).alias("term"))
    counts = frequencies(texts)
    n, total = counts.filter("term is null").select("df", "size").first() or (0, 0)
    df, avgdl = counts.filter("term is not null").select("term", "df"), total / n if n else 1.0
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = wanted.join(df, "term").groupBy("qid").agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("terms"))

    def scorer(rows: list[dict]):
        number, owners = numbered(rows, lambda x: x["term"])
        owners = [np.array(of) for of in owners]
        weights = np.zeros(len(number))
        for row in rows:
            for x in row["terms"]:
                weights[number[x["term"]]] = x["idf"]

        def scores(contents: list[str]) -> np.ndarray:
            tokenised = [tokens_of(content) for content in contents]
            size = np.fromiter(map(len, tokenised), np.int64, len(tokenised))
            term = np.fromiter(map(number.get, chain.from_iterable(tokenised), repeat(-1)), np.int64, int(size.sum()))
            known = term >= 0
            pairs, tf = np.unique(term[known] * len(contents) + np.repeat(np.arange(len(contents)), size)[known], return_counts=True)
            at, term = pairs % len(contents), pairs // len(contents)
            w = weights[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[at] / avgdl))
            out = np.zeros((len(rows), len(contents)))
            cuts = np.flatnonzero(np.diff(term, prepend=-1)).tolist()
            for b, c in zip(cuts, [*cuts[1:], len(term)], strict=True):
                out[owners[term[b]][:, None], at[b:c]] += w[b:c]
            return out

        return scores

    return stored(best_chunks(in_blocks(texts, asked, scorer, "bm25", limit), limit, "bm25"), "bm25")


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """One row of each chunk_id; the same id with another content is an error."""
    found = chunks.groupBy("chunk_id").agg(F.min("content").alias("content"), F.max("content").alias("other"))
    clash = F.raise_error(F.concat(F.lit("conflicting contents of chunk "), "chunk_id")).cast("string")
    return found.select("chunk_id", F.when(F.col("content") != F.col("other"), clash).otherwise(F.col("content")).alias("content"))


class Substrings:
    """Finds given terms in many short texts at once: rolling hashes of each length that a term has, then the characters themselves."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, terms: list[str]):
        self.terms, self.codes, self.of_length = terms, [self._codes(t) for t in terms], {}
        for n in {len(t) for t in terms}:
            ids = np.array([k for k, t in enumerate(terms) if len(t) == n])
            letters = np.array([self.codes[k] for k in ids])
            hashes = np.zeros(len(ids), np.uint64)
            for k in range(n):
                hashes += letters[:, k] * np.uint64(pow(self.BASE, k + 1, 1 << 64))
            order = np.argsort(hashes)
            there = np.zeros(1 << 16, bool)
            there[self._slot(hashes)] = True
            self.of_length[n] = hashes[order], ids[order], letters[order], there

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(48)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and how often that occurs in it without overlaps."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes, owner = self._codes("".join(texts)), np.repeat(np.arange(len(texts)), sizes)
        room, hashes = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        found = [np.zeros(0, np.int64)]
        for n in range(1, min(max(self.of_length, default=0), len(codes)) + 1):
            hashes = hashes[: len(codes) - n + 1] + codes[n - 1 :] * np.uint64(pow(self.BASE, n, 1 << 64))
            if n in self.of_length:
                known, ids, letters, there = self.of_length[n]
                at = np.flatnonzero(there[self._slot(hashes)] & (room[: len(hashes)] >= n))
                first = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
                while len(at):  # terms of one hash stand side by side
                    same = known[first] == hashes[at]
                    at, first = at[same], first[same]
                    hit = (codes[at[:, None] + np.arange(n)] == letters[first]).all(1)
                    found.append(owner[at[hit]] * len(self.terms) + ids[first[hit]])
                    more = ~hit & (first + 1 < len(known))
                    at, first = at[more], first[more] + 1
        pairs, n = np.unique(np.concatenate(found), return_counts=True)
        of, term = pairs // len(self.terms), pairs % len(self.terms)
        for k in np.flatnonzero(n > 1):  # they may overlap
            n[k] = texts[of[k]].count(self.terms[term[k]])
        return of, term, n


def term_counts(texts: DataFrame, questions: DataFrame, limit: int = LIMIT) -> DataFrame:
    """qid, chunk_id, source, chunk_index, content, hits, rank: non-overlapping occurrences of the question's distinct terms in the fixed chunks of texts (source, text); stored.

    A term has the characters of one kind of run only (technical or Han), so each occurrence lies within one run. A run's
    hits for all questions are counted once and kept, RUN_BYTES of them a task.
    """
    asked = questions.select("qid", terms(F.col("question")).alias("terms")).filter(F.size("terms") > 0)

    def scorer(rows: list[dict]):
        number, owners = numbered(rows, lambda x: x)
        whole, inside = re.compile(f"{TERM}|{HAN}"), Substrings(list(number))
        n_owners, every = np.array([len(of) for of in owners]), np.array([q for of in owners for q in of])
        starts = np.cumsum(n_owners) - n_owners
        # a folded chunk has at most three times its characters, and each may begin one occurrence of each length
        kind = np.uint16 if 3 * C.CHUNK_SIZE * len(inside.of_length) < 1 << 16 else np.int32
        room = max(RUN_BYTES // (np.dtype(kind).itemsize * len(rows)), 1)
        known: dict[str, int] = {}
        table = np.zeros((min(room, 1_024), len(rows)), kind)

        def add(runs: list[str]) -> None:
            nonlocal table
            if len(known) + len(runs) > len(table):
                table = np.concatenate([table, np.zeros((max(len(table), len(known) + len(runs) - len(table)), len(rows)), kind)])
            for a in range(0, len(runs), CHUNKS_AT_ONCE):
                part = runs[a : a + CHUNKS_AT_ONCE]
                of, term, n = inside.counts(part)
                many = n_owners[term]
                asks = every[np.repeat(starts[term] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                hits = np.bincount(np.repeat(of, many) * len(rows) + asks, np.repeat(n, many), len(part) * len(rows))
                table[len(known) : len(known) + len(part)] = hits.reshape(len(part), len(rows))
                known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))

        def scores(contents: list[str]) -> np.ndarray:
            runs = [whole.findall(content.casefold()) for content in contents]
            new = set(chain.from_iterable(runs)).difference(known)
            if len(known) + len(new) > room:
                known.clear()
                new = set(chain.from_iterable(runs))
            add(list(new))
            size = np.fromiter(map(len, runs), np.int64, len(runs))
            at, cuts = np.fromiter(map(known.__getitem__, chain.from_iterable(runs)), np.int64, int(size.sum())), [0, *np.cumsum(size).tolist()]
            out = np.zeros((len(contents), len(rows)), kind)
            for i in np.flatnonzero(size):
                np.add.reduce(table.take(at[cuts[i] : cuts[i + 1]], axis=0), axis=0, out=out[i])
            return out.T.astype(float)

        return scores

    found = in_blocks(texts, asked, scorer, "hits", limit).withColumn("hits", F.col("hits").cast("long"))
    return stored(best_chunks(found, limit, "hits"), "hits")


def fused(first: DataFrame, second: DataFrame, limit: int, key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two lists (qid, key, rank)."""
    a, b = first.select("qid", key, F.col("rank").alias("rank_a")), second.select("qid", key, F.col("rank").alias("rank_b"))
    part = lambda c: F.coalesce(1 / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = a.join(b, ["qid", key], "full_outer").withColumn("rrf", F.round(part("rank_a") + part("rank_b"), 9))
    return top(both, limit, F.desc("rrf"), key)


def adjacent(seeds: DataFrame, chunks: DataFrame, window: int = ADJACENT, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """qid, source, chunk_index, role, seed_rank, position: seeds in rank order, then neighbours by seed, distance, before, after."""
    seed = seeds.select("qid", "source", "chunk_index", F.col("rank").alias("seed_rank"))
    offsets = F.explode(F.array(*[F.lit(x) for d in range(1, window + 1) for x in (-d, d)]))
    near = seed.withColumn("offset", offsets).select("qid", "source", (F.col("chunk_index") + F.col("offset")).alias("chunk_index"), "seed_rank", "offset")
    near = near.join(chunks.select("source", "chunk_index"), ["source", "chunk_index"], "left_semi")
    key = F.struct(F.lit(1).alias("late"), "seed_rank", F.abs("offset").alias("distance"), (F.col("offset") > 0).cast("int").alias("after"))
    every = seed.select("qid", "source", "chunk_index", F.struct(F.lit(0).alias("late"), "seed_rank", F.lit(0).alias("distance"), F.lit(0).alias("after")).alias("key"))
    every = every.unionByName(near.select("qid", "source", "chunk_index", key.alias("key")))
    first = every.groupBy("qid", "source", "chunk_index").agg(F.min("key").alias("key"))
    ordered = top(first, limit, "key", rank="position")
    role = F.when(F.col("key.late") == 0, "seed").otherwise("adjacent")
    return ordered.select("qid", "source", "chunk_index", role.alias("role"), F.when(F.col("key.late") == 0, F.col("key.seed_rank")).alias("seed_rank"), "position")


def selected(context: DataFrame, per_seed: int = 1) -> DataFrame:
    """context (qid, source, chunk_index, role, seed_rank, position, coverage) with its seeds and each seed's best unused neighbours.

    Seeds choose in turn, so what one has taken is not free for the next: a fold over at most CONTEXT_LIMIT rows of a question.
    """
    item = F.struct("position", "source", "chunk_index", "role", F.round("coverage", 9).alias("coverage"))
    grouped = context.groupBy("qid").agg(F.sort_array(F.collect_list(item)).alias("items"))
    seeds = F.filter("items", lambda x: x["role"] == "seed")
    near = F.filter("items", lambda x: x["role"] == "adjacent")

    def step(taken: Column, seed: Column) -> Column:
        free = F.filter(near, lambda x: (x["source"] == seed["source"]) & (x["chunk_index"] != seed["chunk_index"]) & ~F.array_contains(taken, x["position"]))
        ranked = F.array_sort(F.transform(free, lambda x: F.struct((-x["coverage"]).alias("c"), F.abs(x["chunk_index"] - seed["chunk_index"]).alias("d"), x["position"].alias("p"))))
        return F.concat(taken, F.transform(F.slice(ranked, 1, per_seed), lambda x: x["p"]))

    taken = F.aggregate(seeds, F.transform(seeds, lambda x: x["position"]), step)
    kept = grouped.select("qid", F.explode(F.filter("items", lambda x: F.array_contains(taken, x["position"]))).alias("x"))
    return kept.select("qid", "x.position", "x.source", "x.chunk_index", "x.role", "x.coverage")


def within_budget(context: DataFrame, budget: int) -> DataFrame:
    """In order of position, the rows (qid, position, size) that still fit; what does not fit is skipped."""
    grouped = context.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("position", "size"))).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
    fits = lambda a, x: a["used"] + x["size"] <= budget
    fold = F.aggregate(
        "items",
        zero,
        lambda a, x: F.struct((a["used"] + F.when(fits(a, x), x["size"]).otherwise(F.lit(0))).alias("used"), F.when(fits(a, x), F.concat(a["kept"], F.array(x["position"]))).otherwise(a["kept"]).alias("kept")),
    )
    return grouped.select("qid", fold.alias("f")).select("qid", F.col("f.used").alias("used"), F.explode("f.kept").alias("position"))


# --- dense retrieval over the embeddings table: each label's mean vector asks, all vectors answer ---


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.posexplode("embedding").alias("at", "x"))
    means = rows.groupBy("label", "at").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    return means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("q"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Raises an error for vectors of other dimensions or without length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    bad = (F.size(a) != F.size(b)) | (norm == 0)
    return F.when(bad, F.raise_error(F.lit("cosine needs vectors of one dimension, none of them zero")).cast("double")).otherwise(dot(a, b) / norm)


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Raises an error for vectors without length."""
    norms = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    if not (norms[0].all() and norms[1].all()):
        raise ValueError("cosine needs vectors that are not zero")
    return x @ q.T / (norms[0][:, None] * norms[1])


def differences(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Less the sums of absolute differences, so that more is nearer."""
    return -np.stack([np.abs(x - one).sum(1) for one in q], axis=1)


def nearest(vectors: DataFrame, asked: DataFrame, measure=cosines, limit: int | None = CANDIDATES, least: float = -np.inf) -> DataFrame:
    """qid, vec_id, label, score, rank of vectors (vec_id, label, v) for the questions asked (qid, q).

    Matrix products of Arrow batches with QUESTIONS_AT_ONCE questions at a time; a batch gives on what reaches `least`, and no
    more than `limit` of it a question. Vectors of another dimension than the questions' are an error.
    """
    rows = asked.orderBy("qid").toLocalIterator(prefetchPartitions=False)
    kinds = f"qid {asked.schema['qid'].dataType.simpleString()}, vec_id long, label {vectors.schema['label'].dataType.simpleString()}, score double"
    found = vectors.sparkSession.createDataFrame([], kinds)
    while block := list(islice(rows, QUESTIONS_AT_ONCE)):
        shared = vectors.sparkSession.sparkContext.broadcast(([r["qid"] for r in block], np.array([r["q"] for r in block], np.float64)))

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qids, q = shared.value
            for batch in batches:
                x = np.array(batch["v"].to_list(), np.float64).reshape(len(batch), -1)
                if len(batch) and x.shape[1] != q.shape[1]:
                    raise ValueError("vectors and questions are of different dimensions")
                scores = np.round(measure(x, q), 6) if len(batch) else np.zeros((0, len(q)))
                ids, parts = batch["vec_id"].to_numpy(), []
                for k in range(len(q)):
                    kept = np.flatnonzero(scores[:, k] >= least)
                    kept = kept[np.lexsort((ids[kept], -scores[kept, k]))][:limit]
                    parts.append(pd.DataFrame({"qid": qids[k], "vec_id": ids[kept], "label": batch["label"].to_numpy()[kept], "score": scores[kept, k]}))
                yield pd.concat(parts)

        found = found.union(vectors.mapInPandas(score, kinds))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = label_means(spark, sf_dir).select(F.col("label").alias("qid"), "q")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")), asked


def dense(spark: SparkSession, sf_dir: str, limit: int | None = CANDIDATES, least: float = -np.inf) -> DataFrame:
    """qid (label), vec_id, label, score, rank."""
    return nearest(*_vectors(spark, sf_dir), cosines, limit, least)


MEANS_SQL = """component as (select label, i, embedding[i]::double as x from embeddings, unnest(range(1, len(embedding) + 1)) u(i)),
mean as (select label, i, round(avg(x), 9) as x from component group by label, i),
ask as (select label as qid, list(x order by i) as q from mean group by label),
scored as (select qid, vec_id, label, round(list_cosine_similarity(embedding::double[], q::double[]), 6) as score from embeddings, ask),
dense as (select *, row_number() over (partition by qid order by score desc, vec_id) as rank from scored qualify rank <= 10)"""

TOKENS_SQL = "regexp_extract_all(replace(lower(trim({0})), 'ß', 'ss'), '[a-z0-9_+#.-]+')"
BM25_SQL = (
    C.CHUNKS_SQL
    + f""", token as (select chunk_id, source, chunk_index, content, {TOKENS_SQL.format("content")} as ts from chunk),
posting as (select chunk_id, term, len(any_value(ts)) as dl, count(*) as tf from (select chunk_id, ts, unnest(ts) as term from token) group by chunk_id, term),
stat as (select count(*) as n, avg(len(ts)) as avgdl from token),
want as (select distinct item_id as qid, unnest({TOKENS_SQL.format("text")}) as term from benchmark),
df as (select term, count(*) as df from posting where term in (select term from want) group by term),
weighted as (select chunk_id, p.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) as w from posting p join df using (term), stat),
bm25_score as (select qid, chunk_id, round(sum(w), 6) as bm25 from weighted join want using (term) group by qid, chunk_id),
bm25 as (select *, row_number() over (partition by qid order by bm25 desc, chunk_id) as rank from bm25_score where bm25 > 0 qualify rank <= 10)"""
)


def q_bm25_stats(spark, sf_dir):
    posted = postings(pieces(spark, sf_dir))
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def _bm25(spark, sf_dir):
    return bm25(texts(spark, sf_dir), questions(spark, sf_dir))


def q_bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir).select("qid", "chunk_id", "bm25", "rank")


def q_lexical_count(spark, sf_dir):
    return term_counts(texts(spark, sf_dir), questions(spark, sf_dir)).select("qid", "chunk_id", "hits", "rank")


def _seeds(spark, sf_dir):
    return _bm25(spark, sf_dir).filter(F.col("rank") <= LIMIT)


def q_keyword_coverage(spark, sf_dir):
    """Coverage of each question by its BM25 candidates, and their order by 0.8 x relevance + 0.2 x coverage."""
    found = _bm25(spark, sf_dir)
    best = F.max("bm25").over(Window.partitionBy("qid"))
    found = found.withColumn("relevance", F.round(F.col("bm25") / best, 6)).filter(F.col("relevance") >= THRESHOLD)
    found = found.join(questions(spark, sf_dir), "qid")
    found = found.withColumn("coverage", F.round(coverage(terms(F.col("question")), F.col("content")), 6))
    found = found.withColumn("combined", F.round((1 - KEYWORD_WEIGHT) * F.col("relevance") + KEYWORD_WEIGHT * F.col("coverage"), 6))
    found = found.withColumnRenamed("rank", "raw_rank")
    return top(found, CANDIDATES, F.desc("combined"), F.desc("relevance"), "raw_rank").select("qid", "chunk_id", "raw_rank", "coverage", "combined", "rank")


def q_adjacent_context(spark, sf_dir):
    """Stored: what is read of it cuts the texts of its sources only."""
    seeds = _seeds(spark, sf_dir)
    return stored(adjacent(seeds, pieces(spark, sf_dir, seeds)).withColumn("seed_rank", F.coalesce("seed_rank", F.lit(0))), "context")


def _context(spark, sf_dir):
    context = q_adjacent_context(spark, sf_dir)
    where = pieces(spark, sf_dir, context).select("source", "chunk_index", "content")
    found = context.join(where, ["source", "chunk_index"]).join(questions(spark, sf_dir), "qid")
    return found.withColumn("coverage", coverage(terms(F.col("question")), F.col("content")))


def q_context_select(spark, sf_dir):
    return selected(_context(spark, sf_dir)).select("qid", "position", "source", "chunk_index", "role", F.round("coverage", 6).alias("coverage"))


def q_context_budget(spark, sf_dir):
    found = _context(spark, sf_dir).select("qid", "position", F.length("content").cast("long").alias("size"))
    return within_budget(found, 700)


def q_evidence_prompt(spark, sf_dir):
    found = _context(spark, sf_dir).select("qid", F.struct("position", "content").alias("x"))
    parts = F.transform(F.sort_array(F.collect_list("x")), lambda x: F.concat(F.lit("[S"), x["position"].cast("string"), F.lit("]\n"), x["content"]))
    return found.groupBy("qid").agg(F.array_join(parts, "\n\n").alias("prompt"), F.count("*").alias("n_evidence"))


def q_dense_topk(spark, sf_dir):
    return dense(spark, sf_dir).select("qid", "vec_id", "score", "rank")


def q_dense_threshold(spark, sf_dir):
    return dense(spark, sf_dir, None, THRESHOLD).select("qid", "vec_id", "score", "rank")


def _labelled(spark, sf_dir, limit: int | None = CANDIDATES):
    """A second ranking of the vectors: by the smallest sum of absolute differences."""
    return nearest(*_vectors(spark, sf_dir), differences, limit).withColumn("gap", -F.col("score")).drop("score")


GAP_SQL = """gap_score as (select qid, vec_id, label, round(list_sum(list_transform(list_zip(embedding::double[], q), lambda p: abs(p[1] - p[2]))), 6) as gap from embeddings, ask),
gap as (select *, row_number() over (partition by qid order by gap, vec_id) as rank from gap_score qualify rank <= 10),
fused_score as (select coalesce(d.qid, g.qid) as qid, coalesce(d.vec_id, g.vec_id) as vec_id, d.rank as rank_a, g.rank as rank_b,
  round(coalesce(1 / (60.0::double + d.rank), 0) + coalesce(1 / (60.0::double + g.rank), 0), 9) as rrf from dense d full join gap g on d.qid = g.qid and d.vec_id = g.vec_id),
fused as (select *, row_number() over (partition by qid order by rrf desc, vec_id) as rank from fused_score qualify rank <= 10)"""


def q_rrf_fusion(spark, sf_dir):
    return fused(dense(spark, sf_dir), _labelled(spark, sf_dir), CANDIDATES, "vec_id").select("qid", "vec_id", F.coalesce("rank_a", F.lit(0)).alias("rank_a"), F.coalesce("rank_b", F.lit(0)).alias("rank_b"), "rrf", "rank")


def q_rrf_top3(spark, sf_dir):
    """BM25 and term counts, fused, of each question."""
    counted = term_counts(texts(spark, sf_dir), questions(spark, sf_dir), CANDIDATES)
    return fused(_bm25(spark, sf_dir), counted, LIMIT).select("qid", "chunk_id", "rrf", "rank")


def reranked(candidates: DataFrame, scores: DataFrame, key: str = "vec_id") -> DataFrame:
    """candidates (qid, key, rank) in the order of given scores (qid, key, score), with both ranks; ties keep their order.

    Every candidate needs one finite score: a repeated candidate or score, a missing one, or one that is not finite is an error.
    """
    given = scores.groupBy("qid", key).agg(F.count("*").alias("n_scores"), F.first("score").alias("rerank_score"))
    once = candidates.groupBy("qid", key).agg(F.count("*").alias("n_rows"), F.min("rank").alias("original_rank")).join(given, ["qid", key], "left")
    ok = (F.col("n_rows") == 1) & (F.coalesce("n_scores", F.lit(0)) == 1) & F.coalesce(~F.isnan("rerank_score") & (F.abs("rerank_score") < float("inf")), F.lit(False))
    wrong = F.raise_error(F.lit("a candidate needs one row and one finite score")).cast("double")
    checked = once.withColumn("rerank_score", F.when(ok, F.col("rerank_score")).otherwise(wrong))
    new = checked.withColumn("new_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "original_rank", key)))
    return new.select("qid", key, "original_rank", "new_rank", (F.col("original_rank") - F.col("new_rank")).alias("rank_change"), "rerank_score")


def q_rerank_contract(spark, sf_dir):
    """The dense candidates ordered anew by a given score (their smallest difference), with the change of rank."""
    candidates = dense(spark, sf_dir).select("qid", "vec_id", "rank")
    given = _labelled(spark, sf_dir, None).join(candidates, ["qid", "vec_id"], "left_semi").select("qid", "vec_id", (-F.col("gap")).alias("score"))
    return reranked(candidates, given).drop("rerank_score")


# --- hybrid retrieval: a label asks with the benchmark text of its number; a vector stands for the first chunk of its document ---


def weighted_rerank(found: DataFrame, limit: int | None = None) -> DataFrame:
    """found (qid, question, content, score, raw_rank, ...) with a score of THRESHOLD at least, by 0.8 x score + 0.2 x coverage of the question's terms."""
    kept = found.filter(F.col("score") >= THRESHOLD).withColumn("coverage", F.round(coverage(terms(F.col("question")), F.col("content")), 6))
    kept = kept.withColumn("combined", F.round((1 - KEYWORD_WEIGHT) * F.col("score") + KEYWORD_WEIGHT * F.col("coverage"), 6))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("combined"), F.desc("score"), "raw_rank")))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def _asked_chunks(spark, sf_dir, limit: int = LIMIT) -> DataFrame:
    """Dense candidates, max(limit, 10) a question, with the question's text and the chunk; blank questions find nothing."""
    asked = questions(spark, sf_dir).filter(F.trim("question") != "").withColumnRenamed("qid", "item")
    found = stored(dense(spark, sf_dir, max(limit, CANDIDATES)).select("qid", "vec_id", "score", F.col("rank").alias("raw_rank")), "dense")
    found = found.join(asked, F.col("qid") == F.col("item")).drop("item")
    first = pieces(spark, sf_dir, found.select(F.concat(F.lit("doc-"), F.col("vec_id").cast("string")).alias("source"))).filter("chunk_index = 1").select(F.col("doc_id").alias("vec_id"), "source", "chunk_index", "content")
    return found.join(first, "vec_id")


def q_hybrid_rerank(spark, sf_dir):
    return weighted_rerank(_asked_chunks(spark, sf_dir)).select("qid", "source", "chunk_index", "raw_rank", "score", "coverage", "combined", "rank")


def q_hybrid_top3(spark, sf_dir):
    return weighted_rerank(_asked_chunks(spark, sf_dir), LIMIT).select("qid", "source", "chunk_index", "combined", "rank")


def q_retrieve_full(spark, sf_dir):
    """The whole retriever: dense candidates, threshold, weighted rerank, the first three, then the chunks beside them."""
    seeds = stored(weighted_rerank(_asked_chunks(spark, sf_dir), LIMIT), "seeds")
    found = adjacent(seeds, pieces(spark, sf_dir, seeds))
    return found.withColumn("seed_rank", F.coalesce("seed_rank", F.lit(0)))


def q_hybrid_rrf(spark, sf_dir):
    """The dense list above the threshold and the BM25 list of the same question, fused; the first three."""
    name = F.concat("source", F.lit("#"), F.col("chunk_index").cast("string")).alias("chunk")
    a = _asked_chunks(spark, sf_dir).filter(F.col("score") >= THRESHOLD)
    a = a.select("qid", name, F.row_number().over(Window.partitionBy("qid").orderBy("raw_rank")).alias("rank"))
    b = _bm25(spark, sf_dir).select("qid", name, "rank").join(a.select("qid").distinct(), "qid", "left_semi")
    return fused(a, b, LIMIT, "chunk").select("qid", "chunk", F.coalesce("rank_a", F.lit(0)).alias("dense_rank"), F.coalesce("rank_b", F.lit(0)).alias("bm25_rank"), "rrf", "rank")


_TERM_HITS_SQL = f"""vocabulary as (select distinct term from posting), asked as (select distinct term as wanted from want),
matched as (select v.term, wanted, ((length(v.term) - length(replace(v.term, wanted, ''))) / length(wanted))::bigint as m from vocabulary v join asked on contains(v.term, wanted)),
hit as (select w.qid, p.chunk_id, sum(tf * m)::bigint as hits from posting p join matched x on x.term = p.term join want w on w.term = x.wanted group by all)"""
_ADJ_SQL = (
    BM25_SQL
    + """, seed as (select qid, source, chunk_index, rank as seed_rank from bm25 join chunk using (chunk_id) where rank <= 3),
near as (select qid, s.source, c.chunk_index, seed_rank, c.chunk_index - s.chunk_index as o from seed s join chunk c on c.source = s.source and abs(c.chunk_index - s.chunk_index) between 1 and 2),
every as (select qid, source, chunk_index, 0 as late, seed_rank, 0 as d, 0 as after_ from seed union all select qid, source, chunk_index, 1, seed_rank, abs(o), (o > 0)::int from near),
first_ as (select *, row_number() over (partition by qid, source, chunk_index order by late, seed_rank, d, after_) as k from every qualify k = 1),
adj as (select *, row_number() over (partition by qid order by late, seed_rank, d, after_) as position from first_ qualify position <= 8)"""
)
_COVER_SQL = """list_distinct(want_terms) as ts, len(list_filter(list_distinct(want_terms), lambda t: contains(replace(lower(content), 'ß', 'ss'), t))) / len(list_distinct(want_terms)) as coverage"""

_ASKED_SQL = (
    BM25_SQL
    + f""", {MEANS_SQL}, asked_chunk as (select d.qid, d.score, d.rank as raw_rank, b.text as question, c.source, c.chunk_index, c.content, {TOKENS_SQL.format("b.text")} as want_terms
  from dense d join benchmark b on b.item_id = d.qid and trim(b.text) <> '' join chunk c on c.source = 'doc-' || d.vec_id and c.chunk_index = 1),
covered as (select *, round({_COVER_SQL.split(" as ts, ")[1].rsplit(" as ", 1)[0]}, 6) as coverage from asked_chunk where score >= 0.25),
combined as (select *, round((1 - 0.2::double) * score + 0.2::double * coverage, 6) as combined from covered),
hybrid as (select *, row_number() over (partition by qid order by combined desc, score desc, raw_rank) as rank from combined)"""
)
_ADJACENT_SQL = """near as (select qid, s.source, c.chunk_index, seed_rank, c.chunk_index - s.chunk_index as o from seed s join chunk c on c.source = s.source and abs(c.chunk_index - s.chunk_index) between 1 and 2),
every as (select qid, source, chunk_index, 0 as late, seed_rank, 0 as d, 0 as after_ from seed union all select qid, source, chunk_index, 1, seed_rank, abs(o), (o > 0)::int from near),
first_ as (select *, row_number() over (partition by qid, source, chunk_index order by late, seed_rank, d, after_) as k from every qualify k = 1),
adj as (select *, row_number() over (partition by qid order by late, seed_rank, d, after_) as position from first_ qualify position <= 8)"""

QUERIES = {
    "hybrid_rerank": (q_hybrid_rerank, f"with {_ASKED_SQL} select qid, source, chunk_index, raw_rank::int as raw_rank, score, coverage, combined, rank::int as rank from hybrid"),
    "hybrid_top3": (q_hybrid_top3, f"with {_ASKED_SQL} select qid, source, chunk_index, combined, rank::int as rank from hybrid where rank <= 3"),
    "retrieve_full": (
        q_retrieve_full,
        f"""with {_ASKED_SQL}, seed as (select qid, source, chunk_index, rank as seed_rank from hybrid where rank <= 3), {_ADJACENT_SQL}
        select qid, source, chunk_index, case when late = 0 then 'seed' else 'adjacent' end as role, (case when late = 0 then seed_rank else 0 end)::int as seed_rank, position::int as position from adj""",
    ),
    "hybrid_rrf": (
        q_hybrid_rrf,
        f"""with {_ASKED_SQL}, a as (select qid, source || '#' || chunk_index as chunk, row_number() over (partition by qid order by raw_rank) as rank from covered),
        b as (select qid, source || '#' || chunk_index as chunk, rank from bm25 join chunk using (chunk_id) where qid in (select qid from a)),
        f as (select coalesce(a.qid, b.qid) as qid, coalesce(a.chunk, b.chunk) as chunk, a.rank as ra, b.rank as rb, round(coalesce(1 / (60.0::double + a.rank), 0) + coalesce(1 / (60.0::double + b.rank), 0), 9) as rrf
          from a full join b on a.qid = b.qid and a.chunk = b.chunk)
        select qid, chunk, coalesce(ra, 0)::int as dense_rank, coalesce(rb, 0)::int as bm25_rank, rrf, rank::int as rank from (select *, row_number() over (partition by qid order by rrf desc, chunk) as rank from f) where rank <= 3""",
    ),
    "bm25_stats": (q_bm25_stats, f"with {BM25_SQL} select term, count(*) as df, sum(tf)::bigint as cf, max(tf) as max_tf from posting group by term"),
    "bm25_topk": (q_bm25_topk, f"with {BM25_SQL} select qid, chunk_id, bm25, rank::int as rank from bm25"),
    "lexical_count": (
        q_lexical_count,
        f"with {BM25_SQL}, {_TERM_HITS_SQL} select qid, chunk_id, hits, rank::int as rank from (select *, row_number() over (partition by qid order by hits desc, chunk_id) as rank from hit) where rank <= 3",
    ),
    "rrf_top3": (
        q_rrf_top3,
        f"""with {BM25_SQL}, {_TERM_HITS_SQL}, counted as (select *, row_number() over (partition by qid order by hits desc, chunk_id) as rank from hit qualify rank <= 10),
        f as (select coalesce(a.qid, b.qid) as qid, coalesce(a.chunk_id, b.chunk_id) as chunk_id, round(coalesce(1 / (60.0::double + a.rank), 0) + coalesce(1 / (60.0::double + b.rank), 0), 9) as rrf
          from bm25 a full join counted b on a.qid = b.qid and a.chunk_id = b.chunk_id)
        select qid, chunk_id, rrf, rank::int as rank from (select *, row_number() over (partition by qid order by rrf desc, chunk_id) as rank from f) where rank <= 3""",
    ),
    "keyword_coverage": (
        q_keyword_coverage,
        f"""with {BM25_SQL}, r as (select *, round(bm25 / max(bm25) over (partition by qid), 6) as relevance from bm25),
        c as (select r.qid, r.chunk_id, r.rank as raw_rank, relevance, content, {TOKENS_SQL.format("b.text")} as want_terms from r join chunk using (chunk_id) join benchmark b on b.item_id = r.qid where relevance >= 0.25),
        v as (select *, round({_COVER_SQL.split(" as ts, ")[1].rsplit(" as ", 1)[0]}, 6) as coverage from c),
        w as (select *, round((1 - 0.2::double) * relevance + 0.2::double * coverage, 6) as combined from v)
        select qid, chunk_id, raw_rank::int as raw_rank, coverage, combined, (row_number() over (partition by qid order by combined desc, relevance desc, raw_rank))::int as rank from w""",
    ),
    "adjacent_context": (
        q_adjacent_context,
        f"with {_ADJ_SQL} select qid, source, chunk_index, case when late = 0 then 'seed' else 'adjacent' end as role, (case when late = 0 then seed_rank else 0 end)::int as seed_rank, position::int as position from adj",
    ),
    "context_select": (q_context_select, None),
    "context_budget": (
        q_context_budget,
        f"""with recursive {_ADJ_SQL}, sized as (select qid, position, length(content) as size from adj join chunk using (source, chunk_index)),
        walk as (select qid, 0::bigint as position, 0::bigint as used, false as kept from sized where position = 1
          union all select w.qid, s.position, w.used + case when w.used + s.size <= 700 then s.size else 0 end, w.used + s.size <= 700 from walk w join sized s on s.qid = w.qid and s.position = w.position + 1),
        total as (select qid, max(used) as used from walk group by qid)
        select qid, total.used, position::int as position from walk join total using (qid) where kept""",
    ),
    "evidence_prompt": (
        q_evidence_prompt,
        f"with {_ADJ_SQL} select qid, string_agg('[S' || position || ']' || chr(10) || content, chr(10) || chr(10) order by position) as prompt, count(*) as n_evidence from adj join chunk using (source, chunk_index) group by qid",
    ),
    "dense_topk": (q_dense_topk, f"with {MEANS_SQL} select qid, vec_id, score, rank::int as rank from dense"),
    "dense_threshold": (
        q_dense_threshold,
        f"with {MEANS_SQL} select qid, vec_id, score, rank::int as rank from (select *, row_number() over (partition by qid order by score desc, vec_id) as rank from scored) where score >= 0.25",
    ),
    "rrf_fusion": (q_rrf_fusion, f"with {MEANS_SQL}, {GAP_SQL} select qid, vec_id, coalesce(rank_a, 0)::int as rank_a, coalesce(rank_b, 0)::int as rank_b, rrf, rank::int as rank from fused"),
    "rerank_contract": (
        q_rerank_contract,
        f"""with {MEANS_SQL}, {GAP_SQL}, r as (select d.qid, d.vec_id, d.rank as original_rank, row_number() over (partition by d.qid order by gap, d.rank, d.vec_id) as new_rank from dense d join gap_score g on g.qid = d.qid and g.vec_id = d.vec_id)
        select qid, vec_id, original_rank::int as original_rank, new_rank::int as new_rank, (original_rank - new_rank)::int as rank_change from r""",
    ),
}
