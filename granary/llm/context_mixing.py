"""Language-model scores by online logistic context mixing.

The text that is coded is its words (runs of other bytes than space and 0x09-0x0D,
A-Z lower-cased), each with one space behind it, then one end. A symbol is coded as
the binary decisions on its way down Huffman trees that belong to the two symbols before
it, so likely symbols take few decisions. Five predictors look at each decision, by
hashed contexts: the last symbol with the place in the word, the last two, the last
three, the word so far, and, for the first HEAD symbols, the word so far with the text's
leading short word (of ASCII letters, the most frequent before, the first to reach its
number), which tells languages apart. Their counts come from all training texts, as sums
of the decisions of each context and node by full 64-bit hash.

A word is coded in two pieces: its head (with the short word that leads there) and its
rest. The distinct pieces lie in order in groups of WORDS_AT_ONCE. What begins alike is in
one group, so the contexts of the word so far in rests, and those with the short word in
heads, are counted there, but for those that the group's first or last piece shares: these
and the other predictors' are summed over all groups in a table of Spark. Up to
MOST_SHARED of them are broadcast; more are joined to the groups that ask for them, with
the same results.

A mixer adds the predictors' log odds with weights from the set that a gate chooses
(how often the last two predictors' contexts were seen). The start weights are fitted on
the decisions of all training texts, each one's own count left out, which Spark sums by
gate and odds in steps of STEPS. To these weights each text adds its own for each gate,
and a map of the mixed odds, linear between knots, both learned online along the text,
after every BLOCK words. The sum of the decisions' logarithms is the score; bits per
byte follow from it. A text's score depends on nothing but the text and the training texts.

The odds of the OFTEN most frequent pieces (but long ones) are broadcast; rarer pieces, however many, carry
the list of the batches that ask for them, at most one entry a batch, and their odds go
there. Broadcast are the trees, the weights and the MOST_FREQUENT most frequent words'
counts for the unigram base score, too; counts of rarer words, however many, come with their rests or, of words without a rest, by a join. The driver sees these, at most GATES * 16^5 sums for the
weights and 2^24 counts of three bytes for the trees.

Defined results: null and empty texts are one end; repeated rows stay; without a
training text all predictors are even; null ids are in no fold, train nothing and have a
null held_out; very long texts are scored whole; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain, compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import fold, stored, table

WORD, TOPIC = 3, 4  # the predictors of the word so far, and with the text's short word
N = 5
SHORT = 3
HEAD = 4
GATES = 16
MOST_FREQUENT = 100_000
OFTEN, LONGEST_OFTEN = 400_000, 64  # pieces, of so many bytes at most
BLOCK = 4  # words
TEXTS_AT_ONCE, BYTES_AT_ONCE = 4_000, 8 << 20
WORDS_AT_ONCE = 30_000
MOST_SHARED = 3_000_000
DECISIONS_AT_ONCE, NUMBERS_AT_ONCE = 1 << 19, 1 << 20
RATE, BEND = 0.015, 0.002
KNOTS = (np.float32(1.5), np.float32(4.0))
SCALE = 12
STEPS = 9  # of odds, for the sums that the weights are fitted on
SMOOTH = 0.3
END = b"\n"

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(4_04).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= n:
        _powers = tuple(np.concatenate([[_U(1)], np.cumprod(np.full(max(1 << 16, 2 * n), b, np.uint64))]) for b in (_BASE, _BACK))
    return _powers


@dataclass
class Codes:
    """Ways down the trees.

    A pair of symbols has a tree of what was seen after it, with one leaf for all else; from there the tree of the
    last symbol alone goes on, which has every symbol. Each way is a stretch of node and bit.
    """

    seen: np.ndarray  # sorted: two symbols before << 8 | symbol
    seen_start: np.ndarray
    seen_size: np.ndarray
    pairs: np.ndarray  # sorted: the symbols before that have a tree
    else_start: np.ndarray
    else_size: np.ndarray
    start: np.ndarray  # by last symbol << 8 | symbol
    size: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    def ways(self, two: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the two stretches (one after the other) of each symbol after two others."""
        key, single = two << 8 | symbol, (two & 255) << 8 | symbol
        k = np.minimum(np.searchsorted(self.seen, key), max(0, len(self.seen) - 1))
        p = np.minimum(np.searchsorted(self.pairs, two), max(0, len(self.pairs) - 1))
        known = self.seen[k] == key if len(self.seen) else np.zeros(len(key), bool)
        paired = self.pairs[p] == two if len(self.pairs) else known
        starts, sizes = np.zeros((len(key), 2), np.int64), np.zeros((len(key), 2), np.int64)
        if len(self.seen):
            starts[:, 0] = np.where(known, self.seen_start[k], self.else_start[p])
            sizes[:, 0] = np.where(known, self.seen_size[k], np.where(paired, self.else_size[p], 0))
        starts[:, 1], sizes[:, 1] = self.start[single], np.where(known, 0, self.size[single])
        return starts.ravel(), sizes.ravel()


def _tree(weights: dict[int, float]) -> dict[int, tuple[list[int], list[int]]]:
    """Nodes and bits on the way to each leaf of a Huffman tree."""
    heap: list = [(w, s, s) for s, w in weights.items()]
    heapify(heap)
    number, children = 1 << 12, {}
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heappop(heap), heappop(heap)
        children[number] = x, y
        heappush(heap, (a + b, number, number))
        number += 1
    ways, todo = {}, [(heap[0][2], [], [])]
    while todo:
        at, nodes, bits = todo.pop()
        if at in children:
            todo += [(child, [*nodes, at - (1 << 12)], [*bits, k]) for k, child in enumerate(children[at])]
        else:
            ways[at] = nodes, bits
    return ways


def huffman(triples: np.ndarray, counts: np.ndarray) -> Codes:
    """Trees from counts of sorted triples (two symbols before << 8 | symbol)."""
    node, bit, rest = [], [], 256

    def stretch(nodes: list[int], bits: list[int], offset: int) -> tuple[int, int]:
        node.extend(x + offset for x in nodes)
        bit.extend(bits)
        return len(node) - len(nodes), len(nodes)

    single = np.bincount(triples & 65535, counts, 65536).reshape(256, 256)
    start, size = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    even = None
    for last in range(256):
        total = float(single[last].sum())
        if not total and even is not None:
            start[last * 256 : last * 256 + 256], size[last * 256 : last * 256 + 256] = even
            continue
        for symbol, way in _tree({s: float(w) + total / 65536 + 1e-3 for s, w in enumerate(single[last])}).items():
            start[last * 256 + symbol], size[last * 256 + symbol] = stretch(*way, 512)
        if not total:
            even = start[last * 256 : last * 256 + 256].copy(), size[last * 256 : last * 256 + 256].copy()
    pairs, first = np.unique(triples >> 8, return_index=True)
    seen_at, else_at = np.zeros((len(triples), 2), np.int64), np.zeros((len(pairs), 2), np.int64)
    for k, (a, b) in enumerate(zip(first, np.append(first[1:], len(triples))[: len(first)], strict=True)):
        leaves = {int(t & 255): float(n) for t, n in zip(triples[a:b], counts[a:b], strict=True)}
        for symbol, way in _tree(leaves | {rest: 0.5 * len(leaves)}).items():
            at = stretch(*way, 0)
            if symbol == rest:
                else_at[k] = at
            else:
                seen_at[a + np.searchsorted(triples[a:b] & 255, symbol)] = at
    return Codes(triples, seen_at[:, 0], seen_at[:, 1], pairs, else_at[:, 0], else_at[:, 1], start, size, np.array(node, np.uint64), np.array(bit, np.uint8))


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] of them, then those of first[1] and so on."""
    ends = np.cumsum(size)
    out = np.arange(ends[-1] if len(ends) else 0)
    out += np.repeat(first - ends + size, size)
    return out


@dataclass
class Decisions:
    """All decisions of some symbol strings, one after the other: first and size by string."""

    first: np.ndarray
    size: np.ndarray
    bit: np.ndarray
    place: np.ndarray  # of its symbol
    slots: list[np.ndarray]  # by predictor: full hashes of context and node


def symbols_of(word: bytes) -> bytes:
    return word if word == END else word + b" "


def triples_of(strings: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct [second last, last, symbol] and their n-weighted counts; nothing and a space stand before the first."""
    data = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64)
    sizes = np.array([len(s) for s in strings], np.int64)
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = np.where(place > 0, np.roll(data, 1), 32)
    before = np.where(place > 1, np.roll(data, 2), np.where(place == 1, 32, 0))
    found, number = np.unique(before << 16 | last << 8 | data, return_inverse=True)
    return found, np.bincount(number, np.repeat(n, sizes), len(found))


def decisions(strings: list[bytes], codes: Codes, tops: list[bytes], rests: bool = False) -> Decisions:
    """The decisions of each string where a text's short word is the one in tops; of rests, those behind the first HEAD symbols only."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings], np.int64)
    first = np.cumsum(sizes) - sizes
    start = np.repeat(first, sizes)
    place = np.arange(len(data)) - start
    at = data.astype(np.uint64)
    last = [np.where(place >= k, np.roll(at, k), np.where(place == k - 1, _U(32), _U(0))) for k in (1, 2, 3)]
    up, back = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    prefix = (sums[:-1] - sums[start]) * back[start] + place.astype(np.uint64)
    starts, parts = codes.ways((last[1] << _U(8) | last[0]).astype(np.int64), data.astype(np.int64))
    if rests:
        parts[np.repeat(place < HEAD, 2)] = 0
    flat = _spread(starts, parts)
    steps = parts[::2] + parts[1::2]
    symbol = np.repeat(np.arange(len(data)), steps)
    top = np.repeat(np.array([int.from_bytes(t, "big") + 1 for t in tops], np.uint64), sizes)
    contexts = (
        last[0] << _U(4) | np.minimum(place, 7).astype(np.uint64),
        last[1] << _U(8) | last[0],
        last[2] << _U(16) | last[1] << _U(8) | last[0],
        prefix,
        prefix * _BASE + top,
    )
    slots, node = [], _mix(codes.node[flat] * _BASE)
    for k, context in enumerate(contexts):
        h = _mix(context * _BASE + _U(k + 1))[symbol]
        h ^= node
        h *= _U(0xD6E8FEB86659FD93)
        slots.append(h.view(np.int64))
    ends = np.concatenate([[0], np.cumsum(steps)])
    begins = ends[first]
    return Decisions(begins, ends[first + sizes] - begins, codes.bit[flat], place[symbol].astype(np.int32), slots)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Coded:
    """Texts as numbers of their distinct words; the end of each text is a word."""

    words: list[bytes]
    flat: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(texts) -> Coded:
        index = _Numbers()
        parts, sizes = [], []
        for t in texts:
            words = t.encode("utf-8", "surrogatepass").lower().split() if t else []
            words.append(END)
            parts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
            sizes.append(len(words))
        return Coded(list(index), np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(sizes, np.int64))

    def tops(self) -> np.ndarray:
        """By token: the number of the leading short word before it in its text; -1 if there is none."""
        short = np.array([len(w) <= SHORT and w.isalpha() for w in self.words], bool)
        at = np.flatnonzero(short[self.flat])
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        own, word = text[at], self.flat[at]
        order = np.lexsort((at, word, own))
        new = np.ones(len(at), bool)
        new[1:] = (own[order][1:] != own[order][:-1]) | (word[order][1:] != word[order][:-1])
        nth = np.empty(len(at), np.int64)
        nth[order] = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        most = np.maximum.accumulate(own * (1 << 40) + nth + 1)
        leads = at[np.concatenate([[True], most[1:] > most[:-1]])] if len(at) else at
        place = np.zeros(len(self.flat) + 1, np.int64)
        place[leads + 1] = leads + 1
        last = np.maximum.accumulate(place)[:-1]
        last[last <= np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)] = 0
        return np.where(last > 0, self.flat[last - 1], -1)

    def heads(self) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """The number of each token's (short word, head), and these."""
        index = _Numbers()
        head = np.array([index[symbols_of(w)[:HEAD]] for w in self.words], np.int64)[self.flat]
        names, tops = list(index), [b"", *self.words]
        found, number = np.unique((self.tops().astype(np.int64) + 1) * len(names) + head, return_inverse=True)
        return number, [tops[i // len(names)] for i in found.tolist()], [names[i % len(names)] for i in found.tolist()]

    def pieces(self) -> tuple[np.ndarray, list[int], list[bytes], list[bytes]]:
        """The numbers, from 1, of each token's head and rest (0 for none), one after the other; and kind (1: heads), short word and word of these."""
        number, tops, heads = self.heads()
        long = np.array([len(symbols_of(w)) > HEAD for w in self.words], bool)
        rest = np.where(long, np.cumsum(long) + len(heads), 0)
        words = [w for w, is_long in zip(self.words, long.tolist(), strict=True) if is_long]
        both = np.stack([number + 1, rest[self.flat]], axis=1).astype(np.int32).ravel()
        return both, [1] * len(heads) + [0] * len(words), [*tops, *[b""] * len(words)], [*heads, *words]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for batch in _cut(whole):
            coded = Coded.of(batch["text"])
            number, tops, heads = coded.heads()
            yield pd.DataFrame({"kind": 0, "top": b"", "word": coded.words, "n": np.bincount(coded.flat, minlength=len(coded.words))})
            yield pd.DataFrame({"kind": 1, "top": tops, "word": heads, "n": np.bincount(number, minlength=len(heads))})


def _cut(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows in order, TEXTS_AT_ONCE or BYTES_AT_ONCE at a time."""
    weight = rows["text"].str.len().cumsum() // BYTES_AT_ONCE
    return (b.iloc[a : a + TEXTS_AT_ONCE] for _, b in rows.groupby(weight) for a in range(0, len(b), TEXTS_AT_ONCE))


def _triples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            found, n = triples_of([symbols_of(w) for w in batch["word"]], batch["n"].to_numpy(np.float64))
            yield pd.DataFrame({"triple": found, "n": n})


def _joined(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """The batches, several of them as one until it has so many rows."""
    parts: list[pd.DataFrame] = []
    for batch in batches:
        parts.append(batch)
        if sum(map(len, parts)) >= least:
            yield pd.concat(parts, ignore_index=True)
            parts = []
    if sum(map(len, parts)):
        yield pd.concat(parts, ignore_index=True)


def _decisions_of(rows: pd.DataFrame, codes: Codes) -> Decisions:
    """Of pieces of one kind."""
    if rows["kind"].iloc[0]:
        return decisions(list(rows["word"]), codes, list(rows["top"]))
    return decisions([symbols_of(w) for w in rows["word"]], codes, [b""] * len(rows), rests=True)


def _own_contexts(rows: pd.DataFrame, found: Decisions) -> tuple[int, np.ndarray]:
    """The predictor whose contexts lie together in groups of these pieces, and the decisions at which a context is in no other group.

    In another group may be what begins its first or last word, and in heads the short words of these.
    """
    ends = rows.iloc[0]
    if ends["kind"]:
        return TOPIC, np.repeat(~rows["top"].isin([ends["first_top"], ends["last_top"]]).to_numpy(), found.size)
    words, first, last = [symbols_of(w) for w in rows["word"]], symbols_of(ends["first"]), symbols_of(ends["last"])
    same = np.array([max(_alike(w, first), _alike(w, last)) for w in words])
    return WORD, found.place > np.repeat(same, found.size)


def _alike(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _sums(keys: np.ndarray, bit: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the number of each key among them, and their n-weighted decisions."""
    found, number = np.unique(keys, return_inverse=True)
    return found, number, np.bincount(number * 2 + bit, n, 2 * len(found)).reshape(-1, 2)


class Seen:
    """n0 and n1 by key, 0 where a key is not there."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray):
        order = np.argsort(key)
        self.key, self.n = key[order], np.stack([n0[order], n1[order]], axis=1).astype(np.float32)

    @staticmethod
    def of(rows: pd.DataFrame) -> Seen:
        return Seen(*(rows[c].to_numpy() for c in ("key", "n0", "n1")))

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros((len(keys), 2))
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where((self.key[at] == keys)[:, None], self.n[at], 0.0)


def _odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of 1 in steps of 1 / SCALE."""
    return np.clip(np.rint(np.log((counts[:, 1] + SMOOTH) / (counts[:, 0] + SMOOTH)) * SCALE), -127, 127).astype(np.int8)


def _levels(n: np.ndarray) -> np.ndarray:
    return (n > 0).astype(np.int8) + (n > 4) + (n > 40)


def _looked(counts: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
    """By decision, in bytes: each predictor's odds towards the bit that is there (0 for the last one in rests), then the gate."""
    sign = bit.astype(np.int8) * np.int8(2) - np.int8(1)
    gate, none = _levels(counts[WORD].sum(1)) * 4, [np.zeros(len(bit), np.int8)] * (N - len(counts))
    if not none:
        gate += _levels(counts[TOPIC].sum(1))
    return np.stack([*(_odds(n) * sign for n in counts), *none, gate.astype(np.int8)], axis=1)


def _cells(looked: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gate and rounded odds as one number each, and their n-weighted counts."""
    cell = looked[:, N].astype(np.int64)
    for k in range(N):
        cell = cell << 4 | np.clip(np.rint(looked[:, k] / STEPS).astype(np.int64) + 8, 0, 15)
    found, number = np.unique(cell, return_inverse=True)
    return found, np.bincount(number, n, len(found))


def fitted_weights(cells: np.ndarray, n: np.ndarray, steps: int = 12) -> np.ndarray:
    """Start weights by gate from the sums of all training decisions: Newton steps with a pull to even weights."""
    weights = np.tile(np.array([0.1, 0.2, 0.3, 0.3, 0.3]), (GATES, 1))
    gate = cells >> 4 * N
    for g in range(GATES):
        some = gate == g
        v = np.stack([(cells[some] >> 4 * (N - 1 - k) & 15) - 8 for k in range(N)], axis=1) * (STEPS / SCALE)
        m, start = n[some], weights[g].copy()
        for _ in range(steps if m.sum() else 0):
            p = 1 / (1 + np.exp(-np.clip(v @ weights[g], -12, 12)))
            h = (v * (m * p * (1 - p))[:, None]).T @ v + 20 * np.eye(N)
            step = np.linalg.solve(h, v.T @ (m * (1 - p)) - 20 * (weights[g] - start))
            weights[g] += step * min(1.0, 1 / max(1e-9, np.abs(step).max()))
    return weights.astype(np.float32)


def odds_of_pieces(pieces: DataFrame, codes: Codes) -> DataFrame:
    """Of pieces (kind, top, word, n in the training texts): kind, top, word and odds of each, the bytes of its decisions; and rows of cell and m, the sums over all n that the weights are fitted on. Further columns of pieces stay with them."""
    spark = pieces.sparkSession
    more = [c for c in pieces.columns if c not in ("kind", "top", "word", "n")]
    their = "".join(f", {c} {pieces.schema[c].dataType.simpleString()}" for c in more)
    shared = spark.sparkContext.broadcast(codes)

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, batch in enumerate(_joined(batches, WORDS_AT_ONCE)):
            for kind, some in batch.groupby("kind", sort=False):
                for a in range(0, len(some), WORDS_AT_ONCE):
                    part = some.iloc[a : a + WORDS_AT_ONCE]
                    ends = {f"{x}{y}": part[z].iloc[at] for x, at in (("first", 0), ("last", -1)) for y, z in (("", "word"), ("_top", "top"))}
                    yield part.assign(**ends, g=TaskContext.get().partitionId() << 40 | k << 20 | int(kind) << 19 | a // WORDS_AT_ONCE)

    def shared_keys(rows: pd.DataFrame, found: Decisions) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By predictor: which decisions have keys that other groups may have, too, and these keys."""
        own, alone = _own_contexts(rows, found)
        for k in range(N if own == TOPIC else TOPIC):
            some = ~alone if k == own else np.ones(len(found.bit), bool)
            yield some, found.slots[k][some]

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["n"] > 0]
        if not len(rows):
            return pd.DataFrame({"key": [], "n0": [], "n1": []})
        found, out = _decisions_of(rows, shared.value), []
        n = np.repeat(rows["n"].to_numpy(np.float64), found.size)
        for some, keys in shared_keys(rows, found):
            keys, _, both = _sums(keys, found.bit[some], n[some])
            out.append(pd.DataFrame({"key": keys, "n0": both[:, 0], "n1": both[:, 1]}))
        return pd.concat(out)

    def wanted(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(np.concatenate([keys for _, keys in shared_keys(rows, _decisions_of(rows, shared.value))]))
        return pd.DataFrame({"g": rows["g"].iloc[0], "key": keys})

    def odds(rows: pd.DataFrame, have: Seen) -> pd.DataFrame:
        found = _decisions_of(rows, shared.value)
        n, counts = np.repeat(rows["n"].to_numpy(np.float32), found.size), []
        own, alone = _own_contexts(rows, found)
        for k, slots in enumerate(found.slots[: N if own == TOPIC else TOPIC]):
            everywhere = have[slots]
            if k == own:
                _, number, both = _sums(slots, found.bit, n)
                everywhere = np.where(alone[:, None], both[number], everywhere)
            counts.append(everywhere.astype(np.float32))
        data, width = _looked(counts, found.bit).tobytes(), N + 1
        every = [data[a * width : (a + m) * width] for a, m in zip(found.first.tolist(), found.size.tolist(), strict=True)]
        at = np.arange(len(found.bit))
        for c in counts:  # each decision's own count left out
            c[at, found.bit] = np.maximum(c[at, found.bit] - 1, 0)
        cell, m = _cells(_looked(counts, found.bit)[n > 0], n[n > 0])
        none, pad = [None] * len(cell), np.full(len(rows), np.nan)
        names = {c: [*rows[c], *none] for c in ("kind", "top", "word", *more)}
        out = pd.DataFrame({**names, "odds": [*every, *none], "cell": pd.array([*[None] * len(rows), *cell.tolist()], "Int64"), "m": np.concatenate([pad, m])})
        return out.astype({"kind": "Int32"})

    order = ["kind", "top", "word"]
    pieces = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = stored(pieces.mapInPandas(grouped, "kind int, top binary, word binary, n long, first binary, last binary, first_top binary, last_top binary, g long" + their), "vocabulary", compression="zstd")
    contexts = pieces.drop(*more).groupBy("g").applyInPandas(counted, "key long, n0 double, n1 double").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    contexts, kinds = stored(contexts, "contexts"), "kind int, top binary, word binary, odds binary, cell long, m double" + their
    if contexts.count() > MOST_SHARED:
        seen = pieces.drop(*more).groupBy("g").applyInPandas(wanted, "g long, key long").join(contexts, "key")
        joined = lambda rows, seen: odds(rows, Seen.of(seen))
        return pieces.groupBy("g").cogroup(seen.groupBy("g")).applyInPandas(joined, kinds)
    found = contexts.toArrow()
    have = spark.sparkContext.broadcast(Seen(*(found[c].to_numpy() for c in ("key", "n0", "n1"))))
    return pieces.groupBy("g").applyInPandas(lambda rows: odds(rows, have.value), kinds)


def scores(flat: list[np.ndarray], words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """log10 of the probability of each text, from the numbers of its pieces, two a word, and the pieces' odds.

    All texts of a part move on together, a block of words at a time; what a text learns from a block counts from its next one.
    """
    looked = np.frombuffer(b"".join(words), np.int8).reshape(-1, N + 1)
    size = np.array([len(w) // (N + 1) for w in words], np.int64)
    first, gate, z = np.cumsum(size) - size, looked[:, N], np.zeros(len(looked), np.float32)
    for k in range(N):
        z += looked[:, k] * (weights[:, k] / SCALE)[gate]
    lengths = np.array([len(f) for f in flat], np.int64)
    decisions_of = np.array([size[f].sum() for f in flat], np.int64)
    order = np.argsort(-lengths, kind="stable")  # texts that still go on are the first ones
    part = np.cumsum(decisions_of[order]) // DECISIONS_AT_ONCE
    out = np.zeros(len(flat))
    for a in np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(flat) else ():
        some = order[part == part[a]]
        out[some] = _mixed([flat[i] for i in some], first, size, looked, z, gate)
    return out / np.log(10)


def _mixed(flat: list[np.ndarray], first, size, looked, z_start, gates) -> np.ndarray:
    """Natural logarithms of the texts' probabilities; the texts come by falling length."""
    lengths = np.array([len(f) for f in flat])
    block = np.concatenate([np.arange(n) // (2 * BLOCK) for n in lengths])
    order = np.argsort(block, kind="stable")
    word, text = np.concatenate(flat)[order], np.repeat(np.arange(len(flat), dtype=np.int32), lengths)[order]
    steps = size[word]
    at = _spread(first[word], steps).astype(np.int32)
    whose = np.repeat(text, steps)
    ends = np.cumsum(np.bincount(np.repeat(block[order], steps)))
    delta = np.zeros((len(flat) * GATES, N), np.float32)
    bend = np.zeros((len(flat), 1 + len(KNOTS)), np.float32)
    total, a = np.zeros(len(flat)), 0
    for b in ends.tolist():
        rows, own = at[a:b], whose[a:b]
        n = int(own.max()) + 1
        x = looked[rows, :N].astype(np.float32)
        x /= SCALE
        key = own * np.int32(GATES) + gates[rows]
        z = z_start[rows]
        bases = None
        if a:
            z += np.einsum("ij,ij->i", x, delta[key])
        # an adaptive map of the mixed odds: odd, and linear between the knots
        bases = [z, *(np.clip(z, -k, k) for k in KNOTS)]
        mapped = z if not a else z + sum(bend[own, k] * base for k, base in enumerate(bases))
        t = np.exp(np.minimum(-mapped, 12))
        u = 1 + t
        total[:n] -= np.bincount(own, np.log(u), n)
        t /= u  # the probability of the other bit
        for k in range(N):
            delta[: n * GATES, k] += RATE * np.bincount(key, t * x[:, k], n * GATES)
        for k, base in enumerate(bases):
            bend[:n, k] += BEND * np.bincount(own, t * base, n)
        a = b
    return total


def word_counts(training: DataFrame) -> DataFrame:
    """kind, top, word and n over all rows of training (text): words and ends (0), and their heads by the short word that leads there (1)."""
    parts = training.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(_count, "kind int, top binary, word binary, n long")
    return stored(parts.groupBy("kind", "top", "word").agg(F.sum("n").alias("n")), "words")


def train(counts: DataFrame) -> Codes:
    """Trees from word_counts: from at most 2^24 triples of bytes, in any corpus."""
    triples = counts.filter("kind = 0").select("word", "n").mapInPandas(_triples, "triple long, n double").groupBy("triple").agg(F.sum("n").alias("n")).toPandas().sort_values("triple")
    return huffman(triples["triple"].to_numpy(np.int64), triples["n"].to_numpy(np.float64))


def _least(counts: DataFrame, most: int) -> int:
    """The smallest n that no more than so many rows of counts reach."""
    total = 0
    for n, size in sorted(counts.groupBy("n").count().collect(), reverse=True):
        total += size
        if total > most:
            return n + 1
    return 1


def _name(kind: int, top: bytes, word: bytes) -> bytes:
    """A piece as one string; short words hold no space."""
    return b"1%b %b" % (top, word) if kind else b"0" + word


def _planes(numbers: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then the next ones and so on, of which the last are mostly zeros and take no space when compressed."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of pieces with the batches that ask for them: for each of these one row of ids, counts, sizes and odds, the odds column by column, packed."""
    for part in batches:
        asked = part["batches"].str.len().to_numpy(np.int64)
        if not len(asked):
            continue
        of, ids = np.concatenate(part["batches"].to_list()), np.concatenate(part["ids"].to_list())
        order = np.argsort(of, kind="stable")
        piece, seen, every = np.repeat(np.arange(len(part)), asked)[order], part["seen"].to_numpy(np.int64), part["odds"].to_list()
        names, first = np.unique(of[order], return_index=True)
        for name, some, own in zip(names.tolist(), np.split(piece, first[1:]), np.split(ids[order], first[1:]), strict=True):
            odds = [every[i] for i in some.tolist()]
            data = np.frombuffer(b"".join(odds), np.uint8).reshape(-1, N + 1).T.tobytes()
            numbers = np.stack([own.astype(np.int64), seen[some], np.fromiter(map(len, odds), np.int64, len(odds))])
            yield pd.DataFrame({"of": [name], "n": [len(odds)], "pieces": [_packed(numbers.astype("<i8").tobytes() + data)]})


def _received(rows: pd.DataFrame) -> tuple[np.ndarray, list[bytes]]:
    """What _sent sent to one batch, in the order of the ids: the counts and the odds."""
    ids, counts, odds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for n, packed in zip(rows["n"], rows["pieces"], strict=True):
        data = _unpacked(packed)
        own, seen, sizes = np.frombuffer(data, "<i8", 3 * n).reshape(3, n)
        flat, ends = np.frombuffer(data, np.uint8, offset=24 * n).reshape(N + 1, -1).T.tobytes(), np.cumsum(sizes).tolist()
        odds += [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        ids.append(own)
        counts.append(seen)
    order = np.argsort(np.concatenate(ids), kind="stable")
    return np.concatenate(counts)[order], [odds[i] for i in order.tolist()]


def score(documents: DataFrame, codes: Codes, counts: DataFrame) -> DataFrame:
    """The rows of documents without text, with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    spark = documents.sparkSession
    words = counts.filter("kind = 0").select("word", "n")
    n_words, vocabulary = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = _least(words, MOST_FREQUENT) if vocabulary > MOST_FREQUENT else 1
    most = words.filter(F.col("n") >= least).toArrow()
    frequent = spark.sparkContext.broadcast(dict(zip(most["word"].to_pylist(), most["n"].to_pylist(), strict=True)))
    learned = counts.filter((F.col("kind") == 1) | (F.length("word") >= HEAD))
    brief = learned.filter(F.length("word") <= LONGEST_OFTEN)
    least_often = _least(brief, OFTEN)
    most = brief.filter(F.col("n") >= least_often).orderBy(F.desc("n"), "kind", "top", "word").select("kind", "top", "word").toArrow()
    number_of = {name: k for k, name in enumerate(map(_name, *(most[c].to_pylist() for c in ("kind", "top", "word"))), 1)}
    often = spark.sparkContext.broadcast(number_of)
    del most
    own = {"text", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"}
    names = [c for c in documents.columns if c not in own]
    inner = [f"own_{k}" for k in range(len(names))]  # no name of documents can clash with those in between
    kinds = "".join(f"{i} {documents.schema[c].dataType.simpleString()}, " for i, c in zip(inner, names, strict=True))
    known = "row int, tokens long, bytes long, known long, base double"
    codings = f"batch long, id int, kind int, top binary, word binary, {kinds}{known}, rare array<binary>, times array<int>, flat binary"

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each batch of texts: its distinct pieces but the frequent ones; the texts (id and flat null); and all texts one after the other as numbers of pieces, behind the frequent ones' numbers, packed (flat)."""
        number_of_batch = 0
        for whole in batches:
            for batch in _cut(whole):
                at_batch = TaskContext.get().partitionId() << 32 | number_of_batch
                number_of_batch += 1
                coded = Coded.of(batch["text"])
                number, kinds_of, tops, ws = coded.pieces()
                numbers = np.array([0, *map(often.value.get, map(_name, kinds_of, tops, ws), repeat(0))], np.int32)
                own = np.flatnonzero(numbers[1:] == 0)
                numbers[1 + own] = len(often.value) + 1 + np.arange(len(own))
                for k in range(0, len(own), WORDS_AT_ONCE):
                    at = own[k : k + WORDS_AT_ONCE].tolist()
                    some = pd.DataFrame({"batch": at_batch, "kind": [kinds_of[i] for i in at], "top": [tops[i] for i in at], "word": [ws[i] for i in at], "id": numbers[1:][at]})
                    yield some.assign(**{c: None for c in columns if c not in some})[columns]
                number = numbers[number]
                del kinds_of, tops, ws
                seen = np.array([frequent.value.get(w, -1) for w in coded.words], np.float64)
                text = np.repeat(np.arange(len(batch)), coded.sizes)
                logs = np.where(seen >= 0, np.log10(np.maximum(seen, 0) + 0.1), 0)[coded.flat]
                out = batch[inner].reset_index(drop=True)
                out["batch"], out["row"] = at_batch, np.arange(len(batch), dtype=np.int32)
                out["tokens"], out["bytes"] = coded.sizes, np.bincount(text, np.array([len(symbols_of(w)) for w in coded.words])[coded.flat], len(batch)).astype(np.int64)
                out["known"] = np.bincount(text, (seen >= 0)[coded.flat], len(batch)).astype(np.int64)
                out["base"] = np.bincount(text, logs, len(batch))
                brief = np.array([len(w) < HEAD for w in coded.words], bool)
                at = np.flatnonzero(((seen < 0) & brief)[coded.flat])
                pair, times = np.unique(text[at] * len(coded.words) + coded.flat[at], return_counts=True)
                cuts = np.searchsorted(pair // max(1, len(coded.words)), np.arange(len(batch) + 1))
                names_of = [coded.words[i] for i in (pair % max(1, len(coded.words))).tolist()]
                out["rare"] = [names_of[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                out["times"] = [times[a:b].astype(np.int32) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield out.assign(id=None, kind=None, top=None, word=None, flat=None)[columns]
                cuts = range(0, len(number), NUMBERS_AT_ONCE)
                # the first text's own columns, so that these hold no nulls that are not there
                flat = out.iloc[[0] * len(cuts)].assign(row=np.arange(len(cuts), dtype=np.int32), rare=None, times=None, flat=[_packed(_planes(number[a : a + NUMBERS_AT_ONCE])) for a in cuts])
                yield flat.assign(id=None, kind=None, top=None, word=None)[columns]

    columns = spark.createDataFrame([], codings).columns
    texts = documents.select(*(F.col(f"`{c}`").alias(i) for i, c in zip(inner, names, strict=True)), F.coalesce("text", F.lit("")).alias("text"))
    coded = stored(texts.mapInPandas(code, codings), "coded", compression="zstd")
    pieces = coded.filter("id is not null").groupBy("kind", "top", "word").agg(F.collect_list(F.struct("batch", "id")).alias("at"))
    wanted = pieces.join(learned, ["kind", "top", "word"], "full_outer")
    wanted = wanted.select("kind", "top", "word", F.coalesce("n", F.lit(0)).alias("n"), F.col("at.batch").alias("batches"), F.col("at.id").alias("ids"), F.coalesce("n", F.lit(0)).alias("seen"))
    odds = stored(odds_of_pieces(stored(wanted, "wanted", compression="zstd"), codes), "odds", compression="zstd")
    cells = odds.filter("cell is not null").groupBy("cell").agg(F.sum("m").alias("m")).toArrow()
    weights = fitted_weights(cells["cell"].to_numpy(), cells["m"].to_numpy())

    most = odds.filter(F.col("cell").isNull() & (F.col("seen") >= least_often) & (F.length("word") <= LONGEST_OFTEN)).select("kind", "top", "word", "odds", "seen").toArrow()
    of_often, n_often = [b""] * (len(number_of) + 1), np.zeros(len(number_of) + 1, np.int64)
    for k, t, w, found, n in zip(*(most[c].to_pylist() for c in ("kind", "top", "word", "odds", "seen")), strict=True):
        at = number_of[_name(k, t, w)]
        of_often[at], n_often[at] = found, n
    shared = spark.sparkContext.broadcast((of_often, n_often))
    del most, of_often, n_often

    def mix(texts: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        packed = texts["flat"].notna()
        every, texts = np.concatenate([_from_planes(_unpacked(b)) for b in texts[packed].sort_values("row")["flat"]]), texts[~packed].sort_values("row")
        flat = np.split(every, np.cumsum(2 * texts["tokens"].to_numpy())[:-1])
        (seen, odds_here), (of_often, n_often) = _received(pieces), shared.value
        used = np.zeros(len(of_often) + len(seen), bool)
        used[every] = True
        number = np.cumsum(used, dtype=np.int32) - 1
        here = list(compress(chain(of_often, odds_here), used.tolist()))
        # a rest is its whole word: the rarer words' counts come with the rests
        rest, n = every[1::2], np.concatenate([n_often, seen])
        text, rarer = np.repeat(np.arange(len(flat)), [len(f) // 2 for f in flat]), (rest > 0) & (n[rest] < least)
        text, n = text[rarer], n[rest[rarer]]
        texts["base"] += np.bincount(text, np.log10(n + 0.1), len(flat))
        texts["known"] += np.bincount(text[n > 0], minlength=len(flat))
        return texts.assign(score=scores([number[f] for f in flat], here, weights))[["batch", *inner, *own_known, "score"]]

    own_known = ["row", "tokens", "bytes", "known", "base"]
    pieces = odds.filter("batches is not null").select("batches", "ids", "odds", "seen").mapInPandas(_sent, "of long, n int, pieces binary")
    texts = coded.filter("id is null and flat is null")
    scored = coded.filter("id is null").select("batch", *inner, *own_known, "flat").groupBy("batch").cogroup(pieces.groupBy("of")).applyInPandas(mix, f"batch long, {kinds}{known}, score double")
    scored = stored(scored, "scored")
    # the counts of rarer words without a rest are joined, each of a text's words once
    rare = texts.select("batch", "row", F.explode(F.arrays_zip("rare", "times")).alias("at")).select("batch", "row", F.col("at.rare").alias("word"), F.col("at.times").alias("m"))
    rare = rare.join(words.filter((F.col("n") < least) & (F.length("word") < HEAD)), "word", "left")
    rare = rare.groupBy("batch", "row").agg(F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_base"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("rare_known"))
    every = F.lit(float(np.log10(n_words + 0.1 * (vocabulary + 1))))
    found = scored.join(rare, ["batch", "row"], "left")
    return found.select(
        *(F.col(i).alias(c) for i, c in zip(inner, names, strict=True)), F.col("tokens").alias("n_tokens"), (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_words).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("tokens") * every).alias("base_score"), "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.col("bytes")).alias("bits_per_byte"),
    )


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = word_counts(documents.filter(fold(F.col("doc_id"), 10) != 0))
    found = score(documents, train(counts), counts)
    return found.withColumn("held_out", fold(F.col("doc_id"), 10) == 0)
