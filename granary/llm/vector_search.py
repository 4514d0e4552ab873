"""Approximate nearest neighbours with balanced posting lists.

Largest inner products become smallest distances by one more component (the root of
the largest squared norm less the vector's own; zero for queries). Centroids come
from a tree of balanced two-means splits of a bounded sample. Every vector joins the
list of its nearest centroid, and further lists where it lies near their boundary: a
centroid within (1 + NEAR) of the nearest distance that no chosen one stands closer
to. The distances of ROWS_AT_ONCE vectors to all centroids are one matrix product; a
query's lists are those within (1 + ratio) of its nearest centroid's distance, the
ratio being the smallest that finds RECALL of the true neighbours within the sample
(of the k nearest in the table, the sample holds its share).

Lists are dealt out in shards, salted by vector and by query where they are long, and
scored as matrix products with exact double-precision scores for what is returned.
Equal vectors are one candidate that carries its k + 1 smallest ids, chosen by a
window with a limit before the shuffle, so copies cost nothing and none is lost.

Only the sample (at most SAMPLE vectors) and the centroids (at most MOST_LISTS) ever
reach the driver or a broadcast. Defined results: vectors that are null, empty, zero
or hold null or non-finite components, null ids and vectors of another dimension
than most take no part; equal ids with different vectors count as separate rows; ties
go to the smaller id; fewer candidates than k give fewer rows; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import stored, table

SAMPLE = 16_384
LIST_SIZE = 128
MOST_LISTS = 8_192
LEAST_IN_SHARD, MOST_IN_SHARD = 16, 64  # lists
ROWS_A_GROUP = 16_384
QUERIES_A_GROUP = 4_096
ROWS_AT_ONCE = 512
REPLICAS = 4
NEAR = 0.1
LEAST_LISTS = 8
RECALL = 0.97


def split_balanced(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of lists leaves of a tree of two-means splits at the median."""
    rng, leaves = np.random.default_rng(seed), [(np.arange(len(x)), lists)]
    centroids = []
    while leaves:
        rows, n = leaves.pop()
        if n <= 1 or len(rows) < 2:
            centroids.append(x[rows].mean(0))
            continue
        a, b = x[rng.choice(rows, 2, replace=False)]
        share = (n // 2) / n
        for _ in range(6):
            side = x[rows] @ (b - a)
            low = np.argsort(side, kind="stable")
            cut = max(1, min(len(rows) - 1, round(len(rows) * share)))
            a, b = x[rows[low[:cut]]].mean(0), x[rows[low[cut:]]].mean(0)
        leaves += [(rows[low[:cut]], n // 2), (rows[low[cut:]], n - n // 2)]
    return np.stack(centroids)


@dataclass
class Index:
    centroids: np.ndarray
    top: float  # largest squared norm
    ratio: float = 0.0

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.top - (x * x).sum(1)))
        return np.column_stack([x, last])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Of all rows of q to all centroids, as one matrix product."""
        squares = (q * q).sum(1)[:, None] + (self.centroids**2).sum(1)[None] - 2 * q @ self.centroids.T
        return np.sqrt(np.maximum(0, squares))

    def searched(self, q: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """By row of q, which lists are searched: those within (1 + ratio) of the nearest centroid's distance, and so many nearest ones at least."""
        d = self.distances(q)
        least = min(least, d.shape[1])
        return d <= np.maximum((1 + ratio) * d.min(1), np.partition(d, least - 1, axis=1)[:, least - 1])[:, None]

    def holding(self, x: np.ndarray) -> np.ndarray:
        """By row of x, which lists hold it: its nearest centroid's, and boundary replicas."""
        d = self.distances(x)
        open_ = np.where(d <= (1 + NEAR) * d.min(1)[:, None], d, np.inf)
        held, rows = np.zeros(d.shape, bool), np.arange(len(x))
        for _ in range(REPLICAS):
            nearest = open_[rows].argmin(1)
            held[rows, nearest] = True
            # what stands closer to the chosen centroid than to the vector gets no replica
            open_[rows] = np.where(self.distances(self.centroids[nearest]) > d[rows], open_[rows], np.inf)
            open_[rows, nearest] = np.inf
            rows = rows[np.isfinite(open_[rows]).any(1)]
            if not len(rows):
                break
        return held


def build(sample: np.ndarray, top: float, total: int, k: int) -> Index:
    """An index for total vectors from a sample of them."""
    index = Index(np.zeros((0, 0)), top)
    x = index.lifted(sample)
    lists = max(1, min(MOST_LISTS, ceil(total / LIST_SIZE), len(x)))
    index.centroids = split_balanced(x, lists)
    # the ratio: true neighbours of some sample rows within the sample, as many as of k the sample holds, and how far their nearest lists are
    some = max(1, min(ceil(k * len(x) / max(total, 1)), k, len(x) - 1))
    rows = np.unique(np.linspace(0, len(x) - 1, min(200 * ceil(k / some), 2_000, len(x))).astype(int))
    needed = []
    for part in np.array_split(rows, ceil(len(rows) / ROWS_AT_ONCE)) if len(x) > 1 else ():
        scores = sample[part] @ sample.T
        scores[np.arange(len(part)), part] = -np.inf
        d = index.distances(index.lifted(sample[part], query=True))
        for near, own in zip(np.argpartition(-scores, some - 1, axis=1)[:, :some], d, strict=True):
            needed.append(np.where(index.holding(x[near]), own, np.inf).min(1) / max(own.min(), 1e-12) - 1)
    index.ratio = float(np.quantile(np.concatenate(needed), RECALL)) if needed else 0.0
    return index


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of vectors for which queries holds."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), queries.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & _usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not sizes:
        return empty
    rows = rows.filter(F.size("v") == sizes[0]["n"]).withColumn("key", F.sha2(F.array_join("v", ",").cast("binary"), 256))
    rows = stored(rows, "vectors")
    first = Window.partitionBy("key").orderBy("id")
    ranked = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
    classes = ranked.groupBy("key").agg(F.min("id").alias("c"), F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))
    classes = stored(classes, "classes")
    asking = rows.filter("asks").select("id", "key")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total, top = classes.agg(F.count("*"), F.max(square)).first()
    share = min(1.0, SAMPLE / total)
    sample = classes.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else classes
    fitted = np.stack(sample.select("c", "v").toPandas().sort_values("c")["v"].to_list())
    index = build(fitted, top, total, k)
    shared = spark.sparkContext.broadcast(index)
    n_queries = asking.count()
    # a query goes once to each shard that it searches: few and large ones, but enough for many tasks
    in_shard = max(LEAST_IN_SHARD, min(MOST_IN_SHARD, len(index.centroids) // 16))
    shards = ceil(len(index.centroids) / in_shard)
    salts = ceil(total * REPLICAS / shards / ROWS_A_GROUP)
    blocks = max(1, ceil(n_queries / QUERIES_A_GROUP))

    def dealt(batches: Iterator[pd.DataFrame], query: bool) -> Iterator[pd.DataFrame]:
        """A row for each vector and shard in which it has lists."""
        index = shared.value
        for batch in batches:
            for a in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[a : a + ROWS_AT_ONCE]
                x = np.stack(part["v"].to_list())
                lifted = index.lifted(x, query)
                row, one = np.nonzero(index.searched(lifted, index.ratio, LEAST_LISTS) if query else index.holding(lifted))
                first = np.flatnonzero(np.diff(row * shards + one // in_shard, prepend=-1))
                data = [v.tobytes() for v in x]
                yield pd.DataFrame({"shard": one[first] // in_shard, "lists": np.split(one, first[1:]), "c": part["c"].to_numpy()[row[first]], "v": [data[i] for i in row[first]]})

    columns = "shard long, lists array<long>, c long, v binary"
    salted = lambda n: F.pmod(F.xxhash64("c"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    posted = classes.select("c", "v").mapInPandas(lambda batches: dealt(batches, False), columns).withColumn("salt", salted(salts)).withColumn("block", every(blocks))
    asked = classes.join(asking.select("key").distinct(), "key", "left_semi").select("c", "v").mapInPandas(lambda batches: dealt(batches, True), columns)
    asked = asked.withColumn("salt", every(salts)).withColumn("block", salted(blocks))

    def score(posted: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(posted) and len(asked):
            x, q = (np.frombuffer(b"".join(part["v"]), np.float64).reshape(len(part), -1) for part in (posted, asked))
            ids = posted["c"].to_numpy()
            first = int(posted["shard"].iloc[0]) * in_shard
            held, wanted = (np.zeros((len(part), in_shard), np.float32) for part in (posted, asked))
            for mask, part in ((held, posted), (wanted, asked)):
                at = np.repeat(np.arange(len(part)), [len(one) for one in part["lists"]])
                mask[at, np.concatenate(part["lists"].to_list()) - first] = 1
            some = min(len(x), k + 9)
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                rough = np.where(wanted[a : a + 256] @ held.T > 0, part @ x.T, -np.inf)
                best = np.argpartition(-rough, some - 1, axis=1)[:, :some]
                for i, row in enumerate(best):
                    row = row[rough[i, row] > -np.inf]
                    exact = np.einsum("ij,j->i", x[row], part[i])
                    order = np.lexsort((ids[row], -exact))[: k + 1]
                    if len(order):
                        out.append((asked["c"].iloc[a + i], ids[row][order].tolist(), exact[order].tolist()))
        return pd.DataFrame(out, columns=["q", "c", "s"])

    keys = ["shard", "salt", "block"]
    found = posted.groupBy(keys).cogroup(asked.groupBy(keys)).applyInPandas(score, "q long, c array<long>, s array<double>")
    pairs = F.transform(F.arrays_zip("s", "c"), lambda x: F.struct((-x["s"]).alias("s"), x["c"].alias("c")))
    found = found.select("q", pairs.alias("pairs")).groupBy("q").agg(F.flatten(F.collect_list("pairs")).alias("pairs"))
    found = found.select("q", F.explode(F.slice(F.array_sort(F.array_distinct("pairs")), 1, k + 1)).alias("p")).select("q", "p.s", "p.c")
    copies = classes.filter(F.size("ids") > 1).select("c", "ids")
    found = found.join(copies, "c", "left").select("q", "s", F.explode(F.coalesce("ids", F.array("c"))).alias("id"))
    found = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "id"))), 1, k + 1).alias("near"))
    found = found.join(classes.select(F.col("c").alias("q"), "key"), "q").select("key", "near")
    answers = asking.join(found, "key").select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    answers = answers.select(F.col("id").alias("query_id"), F.posexplode("near").alias("at", "n"))
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.s")).alias("score"))


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
