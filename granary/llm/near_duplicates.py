"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact links.

Words are runs of other characters than space and 0x09-0x0D, A-Z lower-cased; a
document's set holds its distinct 5-word shingles (or its whole word sequence, if
shorter). Documents with equal sets are one class. Classes that share a band of
their MinHash signatures are candidates; their one-byte signatures are compared in
batches, and a pair is dropped once the posterior probability that its similarity
reaches the threshold falls under MISS. Survivors are confirmed on their full sets.

A bucket of n classes is not expanded into pairs. Every class is compared with the
smallest id of each of its buckets; in buckets that then still hold several components
of plausible pairs, members outside the largest one are compared with all the others,
in blocks inside numpy, which give no more than a spanning forest. The components of
plausible pairs are the groups. The texts of a group come together in blocks of bounded
bytes, where full sets decide: every pair of a block is either tested or already
connected, and again a block gives a forest, so no step makes more rows than members
a block. A group of several blocks is joined by the most central member of each, then
by comparing what is still outside its largest component with all the rest.

A pair at exactly 0.85 is lost if it shares none of 36 bands of 7 (probability 9e-7) or
is pruned in one of four batches (1e-8 each), unless others connect it: 1e-6 at most in
all. At 0.9 it is 2e-10 for the bands.

Rows that share a doc_id are one document: their links are united. Defined results:
null, empty and blank texts have no set, no link and themselves as component; repeated
rows stay; null ids give null components; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import stored, table
from granary.llm.components import components

SHINGLE = 5
BANDS, ROWS = 36, 7
THRESHOLD = 85  # hundredths
MISS = 1e-8
BATCHES = (36, 84, 147, BANDS * ROWS)
#: Bytes of a block's texts, and the least that one counts for: a block has 1,024 members at most.
BLOCK_BYTES, LEAST_BYTES = 8 << 20, 8 << 10
#: Members of a block whose signatures alone are compared.
BLOCK = 2_048
MOST_WORDS = 1 << 19

_U = np.uint64
_random = np.random.default_rng(20_11)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE, _NEXT = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_BACK = _U(pow(int(_BASE), -1, 1 << 64))
_FACTORS = (_random.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_FLIPS = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= n:
        size = max(1 << 16, 2 * n)
        _powers = tuple(np.concatenate([[_U(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, _BACK))
    return _powers


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    space = np.concatenate([[True], _SPACE[data], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, back = _powers_to(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = h * _NEXT + words[k : k + n]
    return np.unique(_mix(h))


def signature(hashes: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> _U(32)).astype(np.uint32)
    for a in range(0, len(short), 1024):
        np.minimum(low, ((short[None, a : a + 1024] ^ _FLIPS) * _FACTORS).min(1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1).astype(np.uint64)
    for k in range(ROWS):
        h = _mix(h * _NEXT + low[k::ROWS].astype(np.uint64))
    return h.view(np.int64)


def least_matches(n: int, threshold: float = THRESHOLD / 100, miss: float = MISS) -> int:
    """The fewest equal bytes of n at which similarity >= threshold still has a posterior probability of miss.

    From a uniform prior, P(p >= t | m of n equal) is the chance of at most m successes in n + 1 trials at t; a byte
    of other minima is equal once in 256.
    """
    t, below = threshold + (1 - threshold) / 256, 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


_LEAST = [(n, least_matches(n)) for n in BATCHES]


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of signatures a and b stay plausible through all batches."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in _LEAST:
        matches[alive] += (a[alive, done:n] == b[alive, done:n]).sum(1)
        alive, done = alive[matches[alive] >= least], n
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


class Signatures:
    """Which signatures stay plausible beside another's."""

    def __init__(self, sig: np.ndarray, sizes: np.ndarray):
        self.sig, self.sizes = sig, sizes

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        small, large = np.minimum(self.sizes[others], self.sizes[i]), np.maximum(self.sizes[others], self.sizes[i])
        others = others[small * 100 >= large * THRESHOLD]
        return others[plausible(np.broadcast_to(self.sig[i], (len(others), self.sig.shape[1])), self.sig[others])]


class Sets:
    """Which sets reach the threshold beside another: intersections counted over all sets at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.mark = np.zeros(self.codes.max() + 1, np.int32)
        self.at, self.kept = np.arange(len(sets)), self.codes

    def central(self) -> np.ndarray:
        """All sets, those first whose members are the most frequent on average: of a family, its original."""
        often = np.bincount(self.codes)[self.codes]
        return np.argsort(-np.add.reduceat(often, self.starts) / self.sizes, kind="stable")

    def _near(self, i: int, others: np.ndarray, codes: np.ndarray) -> np.ndarray:
        size, own = self.sizes[others], self.codes[self.starts[i] : self.starts[i] + self.sizes[i]]
        self.mark[own] = 1
        both = np.add.reduceat(self.mark[codes], np.cumsum(size) - size)
        self.mark[own] = 0
        return others[both * 100 >= (size + self.sizes[i] - both) * THRESHOLD]

    def _codes_of(self, some: np.ndarray) -> np.ndarray:
        size = self.sizes[some]
        return self.codes[np.arange(size.sum()) + np.repeat(self.starts[some] - np.cumsum(size) + size, size)]

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        return self._near(i, others, self._codes_of(others)) if len(others) else others

    def near_of_rest(self, i: int, rest: np.ndarray) -> np.ndarray:
        """The same among the sets that rest, a mask, still has; from call to call it only shrinks."""
        n = np.count_nonzero(rest)
        if 2 * n < len(self.at):
            self.at = np.flatnonzero(rest)
            self.kept = self._codes_of(self.at)
        near = self._near(i, self.at, self.kept) if n else self.at[:0]
        return near[rest[near]]


def forest_within(sets: Sets) -> tuple[list[tuple[int, int]], int]:
    """Edges that connect what the links of all pairs connect, and the most central set."""
    order, rest, edges = sets.central().tolist(), np.ones(len(sets.sizes), bool), []
    for start in order:
        todo = [start] if rest[start] else []
        rest[start] = False
        while todo:
            i = todo.pop()
            near = sets.near_of_rest(i, rest).tolist()
            rest[near] = False
            edges += [(i, j) for j in near]
            todo += near
    return edges, order[0]


def forest_between(left: np.ndarray, right: np.ndarray, component: np.ndarray, near) -> list[tuple[int, int]]:
    """Edges (left, right) that connect, beyond the components there, what the links of all pairs connect."""
    component, edges = component.copy(), []
    for i in left.tolist():
        others = right[component[right] != component[i]]
        for j in near(i, others).tolist() if len(others) else ():
            if component[j] != component[i]:
                edges.append((i, j))
                component[component == component[j]] = component[i]
    return edges


def _near_in_size(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * THRESHOLD


def profiles(documents: DataFrame) -> DataFrame:
    """doc_id, n, k1 and k2 (digest of the set), bands and sig of each row."""

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                h = shingles(text)
                if not len(h):
                    rows.append((i, 0, None, None, None, None))
                    continue
                k1, k2 = (int(_mix(h ^ _U(c)).sum(dtype=np.uint64).view(np.int64)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
                low = signature(h)
                rows.append((i, len(h), k1, k2, band_keys(low), (low & np.uint32(255)).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "k1", "k2", "bands", "sig"]).astype({"doc_id": "Int64", "k1": "Int64", "k2": "Int64"})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(profile, "doc_id long, n long, k1 long, k2 long, bands array<long>, sig binary")


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), BANDS * ROWS)


def _prune(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of class ids whose sizes and signatures leave the threshold plausible."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.loc[plausible(_signatures(batch["sig_a"]), _signatures(batch["sig_b"])), ["a", "b"]]

    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(_near_in_size(F.col("n_a"), F.col("n_b")))
    return near.select("a", "b", "sig_a", "sig_b").mapInPandas(keep, "a long, b long")


def _likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, ...) with an id among ids (id, distinct), and few others: for a join with these ids.

    A bitmap of hashed ids, of MOST_WORDS words at most whatever the tables are, is broadcast, so that most rows of
    other ids do not reach the shuffle of the join.
    """
    n = ids.count()
    words = min(MOST_WORDS, 1 << max(6, (n // 4).bit_length()))
    bit = lambda x: F.expr(f"shiftleft(1L, int(pmod(pmod(xxhash64({x}, 3), {words * 64}L), 64L)))")
    word = lambda x: F.expr(f"pmod(xxhash64({x}, 3), {words * 64}L) div 64")
    bitmap = ids.groupBy(word("id").alias("word")).agg(F.bit_or(bit("id")).alias("bits"))
    some = rows.withColumn("word", word("id")).join(F.broadcast(bitmap), "word").filter(F.col("bits").bitwiseAND(bit("id")) != 0)
    return some.drop("word", "bits")


def _in_order(rows: DataFrame, keys: list[str], *then: str) -> DataFrame:
    """The rows of a key in one partition, key after key. The number of partitions is the session's: bytes tell little of the work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, *then)


def _stretches(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and ends of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else group
    return zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True)


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows sorted by keys, each whole."""
    parts: list[pd.DataFrame] = []
    for batch in batches:
        for a, b in _stretches(batch.groupby(keys, sort=False).ngroup().to_numpy()):
            part = batch.iloc[a:b]
            if parts and a == 0 and (parts[-1][keys].iloc[0] == part[keys].iloc[0]).all():
                parts.append(part)
                continue
            if parts:
                yield pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            parts = [part]
    if parts:
        yield pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]


def _edges(ids: np.ndarray, edges: list[tuple[int, int]]) -> pd.DataFrame:
    one, other = (ids[[e[k] for e in edges]] for k in (0, 1))
    return pd.DataFrame({"a": np.maximum(one, other), "b": np.minimum(one, other)})


def _opposed(members: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """key, block, other, side, rep and component: in blocks, the members (key, rep, size) of each key that holds several components.

    What lies outside a key's largest component is on the left of every block of that component, and of every block
    of its like from its own on. A block has about `most` by size.
    """
    labelled = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("component"))
    sizes = labelled.groupBy("key", "component").agg(F.sum("size").alias("m"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("m").alias("all"), F.max(F.struct("m", "component")).alias("main")).filter("kinds > 1")
    blocks = lambda c: F.ceil(c / most).cast("long")
    mixed = mixed.select("key", F.col("main.component").alias("main"), blocks(F.col("all") - F.col("main.m")).alias("blocks"), blocks(F.col("main.m")).alias("chunks"))
    rows = labelled.drop("size").join(mixed, "key")
    spread = lambda n: F.pmod(F.xxhash64("rep"), n)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    outside = rows.filter("component <> main").withColumn("block", spread(F.col("blocks")))
    columns = ["key", "block", "other", "side", "rep", "component"]
    others = F.concat(F.transform(upto(F.col("chunks")), lambda j: -1 - j), F.sequence("block", F.col("blocks") - 1))
    left = outside.withColumn("side", F.lit(0)).withColumn("other", F.explode(others)).select(columns)
    right = rows.filter("component = main").withColumn("block", F.explode(upto(F.col("blocks")))).withColumn("other", -1 - spread(F.col("chunks")))
    right = right.withColumn("side", F.lit(1)).select(columns)
    again = outside.withColumn("side", F.lit(1)).withColumn("other", F.col("block")).drop("block").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "other")))
    return left.union(right).union(again.select(columns))


_BLOCK_KEYS = ["key", "block", "other"]


def _compared(opposed: DataFrame, of_each: DataFrame) -> DataFrame:
    """a and b: forests of the plausible pairs between both sides of each block, by rep, n and sig of each class."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches, _BLOCK_KEYS):
            side = rows["side"].to_numpy()
            component = rows["component"].to_numpy()
            signatures = Signatures(_signatures(rows["sig"]), rows["n"].to_numpy())
            edges = forest_between(np.flatnonzero(side == 0), np.flatnonzero(side == 1), component, signatures.near)
            if edges:
                yield _edges(rows["rep"].to_numpy(), edges)

    return _in_order(opposed.join(of_each.select("rep", "n", "sig"), "rep"), _BLOCK_KEYS, "side", "rep").mapInPandas(compare, "a long, b long")


def _linked_between(opposed: DataFrame, texts: DataFrame) -> DataFrame:
    """a and b: forests of the pairs between both sides of each block whose full sets reach the threshold."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches, _BLOCK_KEYS):
            found, side = Sets([shingles(t) for t in rows["text"]]), rows["side"].to_numpy()
            edges = forest_between(np.flatnonzero(side == 0), np.flatnonzero(side == 1), rows["component"].to_numpy(), found.near)
            if edges:
                yield _edges(rows["rep"].to_numpy(), edges)

    rows = opposed.join(texts.select(F.col("id").alias("rep"), "text"), "rep")
    return _in_order(rows, _BLOCK_KEYS, "side", "rep").mapInPandas(link, "a long, b long")


def _linked_within(texts: DataFrame) -> DataFrame:
    """a and b: a forest of the links within each block of texts; a pair of one id marks the most central member of a block of several."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches, ["group", "block"]):
            ids = rows["id"].to_numpy()
            edges, central = forest_within(Sets([shingles(t) for t in rows["text"]])) if len(ids) > 1 else ([], 0)
            if rows["blocks"].iloc[0] > 1:
                edges.append((central, central))
            if edges:
                yield _edges(ids, edges)

    return _in_order(texts, ["group", "block"], "id").mapInPandas(link, "a long, b long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of documents (doc_id, text)."""
    profile = stored(profiles(documents), "profiles")
    found = profile.filter("n > 0 and doc_id is not null").groupBy("k1", "k2")
    classes = stored(found.agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("hub")).filter("m > 1")
    members = stored(banded.join(buckets.select("key", "hub"), "key"), "members")
    # plausible pairs, as far as they are needed to tell what belongs together: with the hubs, then within mixed buckets
    stars = members.filter("rep > hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    plausible_pairs = stored(_prune(stars, classes), "plausible")
    groups = components(plausible_pairs)
    opposed = stored(_opposed(members.select("key", "rep", F.lit(1).alias("size")), groups, BLOCK), "opposed")
    if not opposed.isEmpty():
        groups = components(plausible_pairs.union(stored(_compared(opposed, classes), "plausible")))
    # the texts of each group in blocks, and their links
    groups = groups.select(F.col("node").alias("id"), F.col("component").alias("group"))
    of_ids = groups.join(classes.groupBy(F.col("rep").alias("id")).agg(F.sum(F.greatest(F.col("n") * 8, F.lit(LEAST_BYTES))).alias("size")), "id")
    blocks = of_ids.groupBy("group").agg(F.ceil(F.sum("size") / BLOCK_BYTES).cast("long").alias("blocks"))
    of_ids = stored(of_ids.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))), "groups")
    texts = _likely(documents.select(F.col("doc_id").cast("long").alias("id"), "text"), of_ids.select("id")).join(of_ids, "id")
    texts = stored(texts.filter(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")), "texts")
    links = stored(_linked_within(texts), "links")
    central = links.filter("a = b").select(F.col("a").alias("rep"))
    if not central.isEmpty():
        large = of_ids.filter("blocks > 1").select(F.col("group").alias("key"), F.col("id").alias("rep"), "block", "blocks", "size")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        pivots = large.join(central.distinct(), "rep", "left_semi").withColumn("block", every).withColumn("side", F.lit(0))
        both = pivots.union(large.withColumn("side", F.lit(1)).select(pivots.columns)).withColumn("other", F.col("block")).withColumn("component", F.col("rep"))
        links = links.filter("a <> b").union(stored(_linked_between(both, texts), "links"))
        opposed = stored(_opposed(large.select("key", "rep", "size"), components(links), BLOCK_BYTES), "opposed")
        if not opposed.isEmpty():
            links = links.union(stored(_linked_between(opposed, texts), "links"))
    labels = components(links)
    of_class = classes.join(labels, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = profile.select("doc_id", "n", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
with recursive word as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
shingle as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from word),
size as (select doc_id, count(*) as n from shingle group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select a, b from shared join size x on x.doc_id = a join size y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
both_ways as (select a, b from link union select b, a from link),
reach as (select a, a as r from both_ways union select e.b, reach.r from reach join both_ways e on e.a = reach.a),
part as (select a, min(r) as c from reach group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(c, doc_id) as component_id, coalesce(c, doc_id) = doc_id as kept
from documents left join size using (doc_id) left join part on a = doc_id
"""
