"""The trie of conversations' shared beginnings, by a splitter skeleton over sorted shards.

A turn is its digest: the first 16 bytes of a SHA-256 over role and text. A conversation
is the row of its digests (path) and of its texts' sizes, 24 bytes a turn; texts are read
once and never shuffled. Rows sorted by (path, conv_id) hold the members of every node
side by side. Paths that a sample gives as range splitters part them into shards; the
trie of the splitters' paths, the skeleton, is broadcast. A node off the skeleton cannot
reach over a splitter: its shard sees all of it and finishes it in one sorted pass with a
stack. Of each skeleton node a shard gives a partial aggregate, and these are summed;
what skeleton nodes add to one another follows from their order. Splitters part copies of
one path by conv_id, so a group of copies fills several shards.

The skeleton has SKELETON nodes at most, or else the nodes of one path: there are so many
splitters as that bound allows. Splitters decide on balance alone, never on results.

Defined results: rows without conv_id belong to no conversation; null roles and texts
are empty; null turns come first, equal turns by their digests; repeated rows are turns of
their own; a conversation without turns left ends at the root; an empty table has no
node, not even a root; extra columns are ignored. A path is one row: a conversation's
digests, not its texts, must fit into a task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import stored, table

DIGEST = 16
SKELETON = 1 << 17
#: Sampled paths a shard; ids of a node's ends that one row of partial results carries.
SAMPLED, ENDS_AT_ONCE = 32, 50_000
#: Conversations come in families of FAMILY, and share the first 0 to MOST_SHARED turns with the first of theirs.
FAMILY, MOST_SHARED = 5, 8

_FIELDS = "kind string, node long, depth long, conv_id long, parent long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, bytes long, ends_sha256 string, shard long, part long, ids string"
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]
_EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 1), digest and size of every turn of conversations (conv_id, turn, role, text)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * DIGEST))
    found = conversations.filter("conv_id is not null").select("conv_id", "turn", F.unhex(digest).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return found.select("conv_id", F.row_number().over(order).alias("at"), "digest", "size")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, kind, at, digest, size: the first turns of the family's first conversation, then the own ones after as many."""
    shared = lambda c: F.crc32(c.cast("string").cast("binary")) % (MOST_SHARED + 1)
    ids = turns.select("conv_id").distinct()
    borrowed = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"), shared(F.col("conv_id")).alias("h")).filter("h > 0")
    heads = turns.filter(F.col("at") <= MOST_SHARED).filter(F.col("conv_id") % FAMILY == 0).withColumnRenamed("conv_id", "first")
    lent = borrowed.join(heads, "first").filter(F.col("at") <= F.col("h")).select("conv_id", F.lit(0).alias("kind"), "at", "digest", "size")
    own = turns.filter(F.col("at") > shared(F.col("conv_id"))).select("conv_id", F.lit(1).alias("kind"), "at", "digest", "size")
    return lent.unionByName(own).unionByName(ids.select("conv_id", F.lit(2).alias("kind"), F.lit(0).alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("size")))


def paths(rows: DataFrame) -> DataFrame:
    """conv_id, path (digests, one behind another) and sizes; a row of kind 2 keeps a conversation without turns."""
    packed = F.concat(F.col("digest"), F.unhex(F.lpad(F.hex("size"), 16, "0")))
    turn = F.struct("kind", "at", packed.alias("x"))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("kind") < 2, turn))).alias("turns"))
    joined = lambda a, n: F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(F.substring(t["x"], a, n))), ""))
    return held.select("conv_id", joined(1, DIGEST).alias("path"), joined(DIGEST + 1, 8).alias("sizes"))


class Skeleton:
    """The splitters, and the trie of their paths: nodes in order of their paths, so that a node's subtree is node to last."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.children: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.last = [-1], [0], [0]
        for path, _ in splitters:
            node = 0
            for at in range(0, len(path), DIGEST):
                key = (node, path[at : at + DIGEST])
                if key not in self.children:
                    self.children[key] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                    self.last.append(len(self.parent) - 1)
                node = self.children[key]
        for node in range(len(self.parent) - 1, 0, -1):
            up = self.parent[node]
            self.last[up] = max(self.last[up], self.last[node])

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))


def skeleton_of(found: DataFrame, shards: int) -> Skeleton:
    """Splitters for so many shards, fewer where their paths would pass SKELETON, from a sample of SAMPLED paths a shard."""
    n, longest = found.agg(F.count("*"), F.coalesce(F.max(F.length("path")), F.lit(0))).first()
    shards = min(shards, max(2, SKELETON // max(1, longest // DIGEST)))
    share = max(1, n // (SAMPLED * shards))
    sample = found.filter(F.pmod(F.xxhash64("conv_id"), F.lit(share)) == 0).select("conv_id", F.length("path").alias("n"), "path")
    # the sample's order is found in Spark; only the splitters come to the driver
    ordered = sample.withColumn("at", F.row_number().over(Window.orderBy("path", "conv_id")))
    size = sample.count()
    wanted = sorted({k * size // shards for k in range(1, shards)} - {0})
    rows = ordered.filter(F.col("at").isin(wanted)).select("path", "conv_id").collect() if wanted else []
    return Skeleton(sorted((bytes(r["path"]), r["conv_id"]) for r in rows))


class _Node:
    __slots__ = ("known", "bytes", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends", "ids", "part", "closed")

    def __init__(self, known: int, size: int, conv_id: int):
        self.known, self.bytes, self.conv_id = known, size, conv_id
        self.n_convs = self.n_children = self.n_leaves = self.saved = self.part = 0
        self.ends, self.ids, self.closed = None, [], []


class _Shard:
    """One pass over the sorted rows of a shard. known: a skeleton node's number, -1 for others."""

    def __init__(self, skeleton: Skeleton, shard: int):
        self.skeleton, self.shard, self.stack, self.path, self.rows = skeleton, shard, [], b"", []

    def row(self, kind: str, **x) -> None:
        x |= {"kind": kind, "shard": self.shard}
        self.rows.append([x.get(name) for name in _NAMES])

    def flush_ids(self, node: _Node) -> None:
        if node.ids:
            self.row("ends", node=node.known, part=node.part, ids=",".join(node.ids))
            node.ids, node.part = [], node.part + 1

    def close(self) -> None:
        depth, node = len(self.stack) - 1, self.stack.pop()
        if node.known >= 0:
            self.flush_ids(node)
            self.row("part", node=node.known, conv_id=node.conv_id, n_convs=node.n_convs, n_children=node.n_children, n_leaves=node.n_leaves, saved=node.saved, bytes=node.bytes)
            if self.stack:  # the parent is on the skeleton, too
                up = self.stack[-1]
                up.n_leaves, up.saved = up.n_leaves + node.n_leaves, up.saved + node.saved
        else:
            up = self.stack[-1]
            node.n_leaves += node.n_children == 0
            node.saved += (node.n_convs - 1) * node.bytes
            up.n_children, up.n_leaves, up.saved = up.n_children + 1, up.n_leaves + node.n_leaves, up.saved + node.saved
            own = dict(depth=depth, conv_id=node.conv_id, n_convs=node.n_convs, n_children=node.n_children, n_leaves=node.n_leaves, saved=node.saved, ends_sha256=node.ends.hexdigest() if node.ends else _EMPTY)
            if up.known >= 0:
                self.row("node", parent=up.known, **own)
            else:
                up.closed.append(own)
        for own in node.closed:  # only now is the smallest member known
            self.row("node", parent_conv_id=node.conv_id, **own)
        if self.stack:
            up = self.stack[-1]
            up.n_convs, up.conv_id = up.n_convs + node.n_convs, min(up.conv_id, node.conv_id)

    def add(self, conv_id: int, path: bytes, sizes: bytes) -> None:
        same, most = 0, min(len(path), len(self.path))
        while same < most and path[same : same + DIGEST] == self.path[same : same + DIGEST]:
            same += DIGEST
        while len(self.stack) > same // DIGEST + 1:
            self.close()
        if not self.stack:
            self.stack.append(_Node(0, 0, conv_id))
        for at in range(same, len(path), DIGEST):
            up = self.stack[-1].known
            known = self.skeleton.children.get((up, path[at : at + DIGEST]), -1) if up >= 0 else -1
            self.stack.append(_Node(known, int.from_bytes(sizes[at // 2 : at // 2 + 8], "big"), conv_id))
        self.path, end = path, self.stack[-1]
        end.n_convs, end.conv_id = end.n_convs + 1, min(end.conv_id, conv_id)
        if end.known >= 0:
            end.ids.append(str(conv_id))
            if len(end.ids) >= ENDS_AT_ONCE:
                self.flush_ids(end)
        else:
            first, end.ends = end.ends is None, end.ends or hashlib.sha256()
            end.ends.update(b"%d" % conv_id if first else b",%d" % conv_id)

    def end(self) -> None:
        while self.stack:
            self.close()

    def taken(self) -> pd.DataFrame:
        out, self.rows = pd.DataFrame(self.rows, columns=_NAMES, dtype=object), []
        return out.astype({n: "Int64" for n, kind in (x.split() for x in _FIELDS.split(", ")) if kind == "long"})


def shards(found: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Rows of three kinds: finished nodes, partial skeleton nodes, and ids that end at skeleton nodes."""
    shared = found.sparkSession.sparkContext.broadcast(skeleton)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(shard=[shared.value.shard(p, c) for p, c in zip(batch["path"], batch["conv_id"], strict=True)])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for batch in batches:
            for shard, conv_id, path, sizes in zip(batch["shard"].tolist(), batch["conv_id"].tolist(), batch["path"], batch["sizes"], strict=True):
                if state is None or state.shard != shard:
                    if state is not None:
                        state.end()
                        yield state.taken()
                    state = _Shard(shared.value, shard)
                state.add(conv_id, path, sizes)
            yield state.taken()
        if state is not None:
            state.end()
            yield state.taken()

    dealt = found.select("conv_id", "path", "sizes").mapInPandas(deal, "conv_id long, path binary, sizes binary, shard long")
    n = len(skeleton.splitters) + 1
    return dealt.repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("shard", "path", "conv_id").mapInPandas(walk, _FIELDS)


def ends_of(rows: DataFrame) -> DataFrame:
    """node and ends_sha256 from the ids' parts in order of (shard, part), hashed as they come."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            done = []
            for n, ids in zip(batch["node"].tolist(), batch["ids"], strict=True):
                if n == node:
                    state.update(b"," + ids.encode())
                else:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])

    parts = rows.filter("kind = 'ends'").select("node", "shard", "part", "ids")
    return parts.repartition("node").sortWithinPartitions("node", "shard", "part").select("node", "ids").mapInPandas(digest, "node long, ends_sha256 string")


def skeleton_nodes(rows: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The finished skeleton nodes: sums of their parts, and of what the skeleton nodes below them add."""
    parts = rows.filter("kind = 'part'").groupBy("node").agg(F.min("conv_id"), F.sum("n_convs"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved"), F.max("bytes"))
    held = {r[0]: r[1:] for r in parts.collect()}  # as many as the skeleton has nodes
    n = len(skeleton.parent)
    below = [0] * n
    for node in range(1, n):
        below[skeleton.parent[node]] += 1
    leaves, saved = [0] * (n + 1), [0] * (n + 1)  # running sums of the skeleton nodes' own
    for node in range(n):
        _, n_convs, n_children, _, _, size = held.get(node, (None, 0, 0, 0, 0, 0))
        leaves[node + 1] = leaves[node] + (node in held and n_children + below[node] == 0)
        saved[node + 1] = saved[node] + (max(0, n_convs - 1) * size)
    out = []
    for node, (conv_id, n_convs, n_children, n_leaves, own_saved, _) in held.items():
        last = skeleton.last[node] + 1
        up = skeleton.parent[node]
        out.append((node, skeleton.depth[node], conv_id, held[up][0] if up >= 0 else None, n_convs, n_children + below[node], n_leaves + leaves[last] - leaves[node], own_saved + saved[last] - saved[node]))
    kinds = "node long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    return rows.sparkSession.createDataFrame(out, kinds)


def trie(found: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node over paths (conv_id, path, sizes)."""
    skeleton = skeleton_of(found, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(shards(found, skeleton), "trie")
    top = skeleton_nodes(rows, skeleton)
    upper = top.join(ends_of(rows), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    parents = F.broadcast(top.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")))  # the skeleton's nodes
    lower = rows.filter("kind = 'node'").join(parents, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).withColumnRenamed("saved", "saved_tokens")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return upper.select(names).unionByName(lower.select(names))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "turns")
    return trie(stored(paths(rebuilt(found)), "paths"))


# The checksum's table from its rule (reflected polynomial 0xEDB88320).
OP12_SQL = """
with entry as (select i, list_reduce(list_prepend(i::bigint, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i)),
crc_table as (select list(v order by i) as t from entry),
said as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
digested as (select conv_id, turn, left(sha256(length(role) || ':' || role || text), 32) as digest, strlen(text) as size from said),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, digest) as place from digested),
ids as (select distinct conv_id from said),
heads as (select conv_id, conv_id - conv_id % 5 as first, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 9 as h from ids, crc_table),
turn_of as (select h.conv_id, 0 as kind, place, digest, size from heads h join numbered n on n.conv_id = first and place <= h union all select n.conv_id, 1, place, digest, size from heads h join numbered n on n.conv_id = h.conv_id and place > h),
member as (select conv_id, row_number() over w as depth, string_agg(digest, '') over w as key, size from turn_of window w as (partition by conv_id order by kind, place rows unbounded preceding) union all select conv_id, 0, '', 0 from ids),
whole as (select *, max(depth) over (partition by conv_id) as n from member),
node as (select key, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (depth = n), '') as ends from whole group by key, depth),
children as (select left(key, 32 * (depth - 1)::bigint) as key, depth - 1 as depth, count(*) as n from node where depth > 0 group by 1, 2),
counted as (select node.*, coalesce(n, 0) as n_children from node left join children using (key, depth)),
part as (select left(key, 32 * a::bigint) as key, a as depth, n_children = 0 as leaf, (n_convs - 1) * size as saved from counted, unnest(range(0, depth + 1)) u(a)),
summed as (select key, depth, sum(leaf::int) as n_leaves, sum(saved) as saved from part group by 1, 2)
select c.conv_id, c.depth::bigint as depth, up.conv_id as parent_conv_id, c.n_convs, c.n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(c.ends) as ends_sha256
from counted c join summed s on s.key = c.key and s.depth = c.depth left join node up on c.depth > 0 and up.depth = c.depth - 1 and up.key = left(c.key, 32 * (c.depth - 1)::bigint)
"""
