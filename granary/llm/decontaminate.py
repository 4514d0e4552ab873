"""Benchmark decontamination: pigeonhole pieces, exact hits, Myers verification.

Texts are lower-cased and runs of white space become one space. An item with an
error budget of k edits is cut into k + 1 pieces: wherever it occurs with at most k
edits, one piece at least occurs unchanged. An Aho-Corasick automaton finds all
piece hits in whole documents; around each, Myers' bit-parallel algorithm gives the
smallest edit distance of the whole item to any passage there.

The benchmark is read in blocks of bounded size, each broadcast in turn, so that any
number of items is served exactly. Defined results: null or blank texts and items
match nothing; items under SHORTEST characters have no error budget and must stand
between spaces or the text's ends; items of equal text are each reported; repeated
documents give repeated rows; extra columns are ignored. Overlapping hits of an item
are verified as one window, so a frequent piece costs no more than one pass of the text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import table

ERROR_RATE = 0.08
SHORTEST_PIECE = 8
SHORTEST = 24
BLOCK_CHARS = 1_000_000


def normalised(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(item: str, rate: float = ERROR_RATE) -> int:
    return 0 if len(item) < SHORTEST else max(0, min(int(len(item) * rate), len(item) // SHORTEST_PIECE - 1))


def pieces_of(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(pattern: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """(distance, end) of the passage of text nearest to pattern by edits; the first end of the smallest distance."""
    masks, m = masks or masks_of(pattern), len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, j
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        import ahocorasick

        self.items: dict[str, list[int]] = {}
        for item_id, item in items:
            self.items.setdefault(item, []).append(item_id)
        self.texts = list(self.items)
        self.budgets = [budget(x, rate) for x in self.texts]
        self.masks: dict[int, tuple[dict, dict]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (item, k) in enumerate(zip(self.texts, self.budgets, strict=True)):
            for at, piece in pieces_of(item, k):
                found.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, length) of each item within its budget; the nearest passage of each, the first of equals."""
        text = normalised(text)
        if not text or not self.texts:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, at in where:
                start = end + 1 - size - at
                k, m = self.budgets[n], len(self.texts[n])
                low, high = max(0, start - k), min(len(text), start + m + k)
                own = windows.setdefault(n, [])
                if own and low <= own[-1][1] and low >= own[-1][0]:
                    own[-1][1] = max(own[-1][1], high)
                else:
                    own.append([low, high])
        found = []
        for n, spans in windows.items():
            item, k = self.texts[n], self.budgets[n]
            best: tuple[int, int, int] | None = None
            for low, high in sorted(spans):
                hit = self._nearest(n, item, k, text, low, high)
                if hit and (best is None or hit[0] < best[0]):
                    best = hit
            if best:
                found += [(item_id, *best) for item_id in self.items[item]]
        return found

    def _nearest(self, n: int, item: str, k: int, text: str, low: int, high: int) -> tuple[int, int, int] | None:
        if len(item) < SHORTEST:
            at = f" {text} ".find(f" {item} ", low)
            return (0, at, len(item)) if 0 <= at <= high else None
        at = text.find(item, low, high)
        if at >= 0:
            return 0, at, len(item)
        if high - low < len(item) - k:
            return None
        if n not in self.masks:
            self.masks[n] = masks_of(item), masks_of(item[::-1])
        forward, backward = self.masks[n]
        edits, end = myers(item, text[low:high], forward)
        if edits > k:
            return None
        end += low
        # the same from the end gives the passage's start
        start = end - myers(item[::-1], text[max(0, end - len(item) - k) : end][::-1], backward)[1]
        return edits, start, end - start


@functools.lru_cache(maxsize=1)
def _matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    return Matcher(list(items), rate)


def _blocks(benchmark: DataFrame) -> Iterator[tuple[tuple[int, str], ...]]:
    block, size = [], 0
    for item_id, text in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        item = normalised(text)
        if item and item_id is not None:
            block.append((item_id, item))
            size += len(item)
            if size >= BLOCK_CHARS:
                yield tuple(block)
                block, size = [], 0
    if block:
        yield tuple(block)


def matched(text: Column, benchmark: DataFrame, rate: float = ERROR_RATE) -> Column:
    """array of (item_id, n_errors, start, length in the normalised text) of the items that a text holds."""
    spark, kind = benchmark.sparkSession, "array<struct<item_id: long, n_errors: int, start: int, length: int>>"

    def scanner(shared: Broadcast):
        def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = _matcher(shared.value, rate)
            names = ("item_id", "n_errors", "start", "length")
            for batch in batches:
                yield pd.Series([[dict(zip(names, hit, strict=True)) for hit in matcher.matches(text)] for text in batch], dtype=object)

        return F.pandas_udf(scan, kind)

    parts = [scanner(spark.sparkContext.broadcast(block))(text) for block in _blocks(benchmark)]
    return F.concat(*parts) if parts else F.array().cast(kind)


def leaks(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, n_errors, start and length of each item that a document holds."""
    hits = documents.select("doc_id", F.explode(matched(F.col("text"), benchmark, rate)).alias("hit"))
    return hits.select("doc_id", "hit.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
