"""Quality scores from histogram gradient-boosted trees over document statistics.

Statistics come from the whole text alone. The trees are grown by Newton boosting on
binned statistics of a bounded sample of labelled rows (MOST_LABELS, chosen by hash
of the id among all of them), flattened into arrays, and walked by numpy for whole
Arrow batches at a time.

Defined results: null texts count as empty and are scored as such; null labels teach
nothing; without labels of both kinds every score is the share of label 1 (0.5 if
there are none); repeated rows stay; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import fold, table

MOST_LABELS = 30_000
THRESHOLD = 0.3
SPAN = 256
SYMBOLS = "!#$%&*+/<=>@\\^_`{|}~"
_COUNTED = "\n.,!?|#*$%&@:;/-'\"()<>{}="
STATISTICS = (
    "chars words mean_word log_words distinct_words top_word repeats lines mean_line repeated_lines short_lines digits upper lower "
    "other_bytes symbols worst_symbols symbol_spans worst_upper upper_spans longest_word stops"
).split() + [f"byte_{ord(c)}" for c in _COUNTED]

_KIND = np.zeros((4, 256), np.float32)
_KIND[0, [ord(c) for c in SYMBOLS]] = 1
_KIND[1, 65:91] = 1
_KIND[2, 97:123] = 1
_KIND[3, 48:58] = 1


def statistics(text: str | None) -> list[float]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256).astype(np.float64)
    size, words, lines = max(1, len(raw)), text.split(), text.split("\n")
    n = max(1, len(words))
    kinds = Counter(words)
    symbols, upper, lower, digits = (_KIND * counts).sum(1)
    # the worst stretch shows junk that the whole text dilutes
    starts = np.arange(0, len(raw), SPAN)
    spans = np.minimum(SPAN, len(raw) - starts) if len(raw) else np.ones(1)
    share = [np.add.reduceat(_KIND[k][data], starts) / spans if len(raw) else np.zeros(1) for k in (0, 1)]
    return [
        len(text), len(words), len(text) / n, np.log1p(len(words)), len(kinds) / n, max(kinds.values(), default=0) / n, sum(map(eq, words, words[1:])) / n,
        len(lines), len(text) / len(lines), 1 - len(set(lines)) / len(lines), sum(len(x) < 20 for x in lines) / len(lines), digits / size, upper / size, lower / size,
        counts[128:].sum() / size, symbols / size, share[0].max(), (share[0] > 0.05).mean(), share[1].max(), (share[1] > 0.3).mean(), max(map(len, words), default=0),
        sum(n for word, n in kinds.items() if len(word) <= 3) / n, *(counts[ord(c)] / size for c in _COUNTED),
    ]


@dataclass
class Trees:
    """Nodes of all trees side by side: at a leaf, feature is -1 and both ways lead to itself."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            feature = self.feature[at]
            at = np.where(x[rows, np.maximum(feature, 0)] <= self.limit[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(1))))


def grow(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.12, ridge: float = 2.0, least: int = 10) -> Trees:
    """Newton boosting of the logistic loss with histograms of equal-count bins."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4))
    start = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, limit, left, right, value
    roots: list[int] = []
    if len(y) and 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
        raw = np.full(len(y), start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([-1, 0, 0, 0, 0])
            open_ = [(roots[-1], np.arange(len(y)), 0)]
            while open_:
                node, rows, level = open_.pop()
                total_g, total_h = g[rows].sum(), h[rows].sum()
                best = (1e-3, 0, 0)
                if level < depth and len(rows) >= 2 * least:
                    for f, e in enumerate(edges):
                        b = binned[f, rows]
                        gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                        nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                        gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge) - total_g**2 / (total_h + ridge)
                        gain[(nl < least) | (len(rows) - nl < least)] = 0
                        if len(gain) and gain.max() > best[0]:
                            best = (float(gain.max()), f, int(gain.argmax()))
                if best[0] > 1e-3:
                    _, f, k = best
                    goes = binned[f, rows] <= k
                    nodes[node] = [f, edges[f][k], len(nodes), len(nodes) + 1, 0]
                    nodes += [[-1, 0, 0, 0, 0], [-1, 0, 0, 0, 0]]
                    open_ += [(len(nodes) - 2, rows[goes], level + 1), (len(nodes) - 1, rows[~goes], level + 1)]
                else:
                    value = -rate * total_g / (total_h + ridge)
                    nodes[node] = [-1, 0, node, node, value]
                    raw[rows] += value
    table_ = np.array(nodes or np.zeros((0, 5)))
    return Trees(start, np.array(roots, np.int64), table_[:, 0].astype(np.int64), table_[:, 1], table_[:, 2].astype(np.int64), table_[:, 3].astype(np.int64), table_[:, 4], depth)


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = pd.DataFrame([statistics(t) for t in batch["text"]], columns=STATISTICS, dtype="float64")
        out.insert(0, "quality", batch["quality"].to_numpy())
        out.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield out


def train(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Trees:
    """Trees from labels (doc_id, quality) and the texts of documents; no more than about most labelled rows, by hash of the id."""
    labels = labels.filter("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("double").alias("quality"))
    n = labels.count()
    if n > most:
        labels = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    kind = documents.schema["doc_id"].dataType.simpleString()
    sample = documents.select("doc_id", "text").join(F.broadcast(labels), "doc_id")  # labels are bounded by most
    rows = sample.mapInPandas(_measure, ", ".join([f"doc_id {kind}", "quality double", *(f"{x} double" for x in STATISTICS)])).toPandas()
    rows = rows.sort_values(["doc_id", "quality", "chars"])
    return grow(rows[STATISTICS].to_numpy(), rows["quality"].to_numpy())


def scored(text: Column, trees: Trees) -> Column:
    """The score of a text."""
    shared = SparkSession.active().sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array([statistics(t) for t in text]).reshape(len(text), len(STATISTICS))))

    return score(text)


def train_on_fold(documents: DataFrame, labels: DataFrame) -> Trees:
    return train(documents, labels.filter(fold(F.col("doc_id"), 5) != 0))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = train_on_fold(documents, table(spark, sf_dir, "labels"))
    scores = documents.select("doc_id", scored(F.col("text"), trees).alias("score"))
    return scores.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
