"""Importance resampling towards a target distribution, over hashed word n-grams.

Texts become words (A-Z lower-cased; runs of digits, letters and all beyond ASCII), and
words features: single words and pairs of neighbours, joined by one space. A feature's
bucket is the CRC-32 of its bytes modulo BUCKETS. A bucket's gain compares how often the
target and the corpus hold it; a document's weight is the mean gain of its features. Gumbel
noise, fixed by the document's id, makes the highest scores a sample without replacement.

A CRC without its start and end values is linear: each byte contributes by its value and
its distance from the feature's end alone. TABLE holds these contributions; those of a span
are combined by ``bitwise_xor.reduceat``, and a constant of the length gives what is left.
Spans over SPAN bytes are cut into blocks of SPAN bytes from their end; neighbouring blocks
are folded pairwise by shifting the former's value over the latter's length.

Counting is by task: each gives BUCKETS sums at most, whatever it reads, so a corpus
moves only those. Gains number BUCKETS and are broadcast. Scores are integers within
about +-60,000 by construction, so their histogram, which ranks them, is bounded as well.

Defined results: null and empty texts and texts without words have no feature and weight
0; documents with fewer than LEAST_WORDS words are never drawn; a null doc_id counts as
an empty text in the noise and comes last among ties; repeated rows each count and are
drawn each for itself; an empty target gives gains from the corpus alone, an empty corpus
an empty table; extra columns are ignored. Texts are read whole, long ones in windows that
share a word, so that memory is bounded by LONG bytes and the longest word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import stored, table

BUCKETS = 10_000
LEAST_WORDS, SHARE = 20, 25  # hundredths of the documents that have as many words
SEED = 7
#: Bytes of texts that are handled at once, and of a window of a longer text.
AT_ONCE = LONG = 1 << 20
SPAN = 64

_GAP = np.full(1, 32, np.uint8)
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def _contributions(span: int) -> np.ndarray:
    """Row d: what each value of a byte adds to a CRC-32 that ends d bytes later, without start and end values."""
    rows = np.empty((span, 256), np.uint32)
    start = zlib.crc32(b"\0")
    rows[0] = [zlib.crc32(bytes([b])) ^ start for b in range(256)]
    for d in range(1, span):
        rows[d] = (rows[d - 1] >> np.uint32(8)) ^ rows[0][rows[d - 1] & np.uint32(255)]
    return rows


TABLE = _contributions(SPAN)
_LENGTHS = np.array([zlib.crc32(bytes(n)) for n in range(SPAN + 1)], np.uint32)
#: Shifts a value over SPAN bytes: what its four bytes add there. They stand at distances SPAN - 1 to SPAN - 4.
_OVER_SPAN = TABLE[[SPAN - 1, SPAN - 2, SPAN - 3, SPAN - 4]]


def _shifted(values: np.ndarray, over: np.ndarray) -> np.ndarray:
    out = over[0][values & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ over[k][(values >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _linear(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The linear part of the CRC-32 of spans of SPAN bytes at most, none empty."""
    size = ends - starts
    first = np.cumsum(size) - size
    left = np.repeat(first + size - 1, size) - np.arange(int(size.sum()))  # distance from the span's end
    at = np.repeat(ends - 1, size) - left
    return np.bitwise_xor.reduceat(TABLE.ravel()[left * 256 + data[at]], first)


def _folded(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The linear part of spans from those of their blocks of SPAN bytes, counts of them each; zeros before the first change nothing."""
    over = _OVER_SPAN
    while len(counts) and counts.max() > 1:
        odd = counts & 1
        wide = counts + odd
        to = np.repeat(np.cumsum(wide) - wide + odd - (np.cumsum(counts) - counts), counts) + np.arange(len(values))
        padded = np.zeros(int(wide.sum()), np.uint32)
        padded[to] = values
        values, counts = _shifted(padded[::2], over) ^ padded[1::2], wide // 2
        over = _shifted(over.ravel(), over).reshape(4, 256)
    return values


def crc32_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] (bytes as uint8) of each span; none is empty, and spans may overlap."""
    out = np.empty(len(starts), np.uint32)
    if not len(starts):
        return out
    size = ends - starts
    short = size <= SPAN
    if short.any():
        out[short] = _linear(data, starts[short], ends[short]) ^ _LENGTHS[size[short]]
    if not short.all():
        s, e, n = starts[~short], ends[~short], size[~short]
        counts = -(-n // SPAN)
        back = np.repeat(np.cumsum(counts), counts) - 1 - np.arange(int(counts.sum()))  # blocks behind this one
        stop = np.repeat(e, counts) - back * SPAN
        values = _folded(_linear(data, np.maximum(stop - SPAN, np.repeat(s, counts)), stop), counts)
        lengths, where = np.unique(n, return_inverse=True)
        out[~short] = values ^ np.array([zlib.crc32(bytes(int(x))) for x in lengths], np.uint32)[where]
    return out


def _windows(data: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """A text's bytes in windows of about LONG that end at gaps. Where one begins with the last word before it, that word counts there alone."""
    if len(data) <= LONG:
        yield data, False
        return
    gaps = np.flatnonzero(~_WORD[data])
    at, carried = 0, data[:0]
    while at < len(data):
        k = np.searchsorted(gaps, at + LONG)
        stop = int(gaps[k]) if k < len(gaps) else len(data)
        window = data[at:stop]
        yield (np.concatenate([carried, _GAP, window]) if len(carried) else window), bool(len(carried))
        if len(last := np.flatnonzero(_WORD[window])[-1:]):
            end = int(last[0]) + 1
            k = np.searchsorted(gaps, at + end)
            carried = window[max(0, int(gaps[k - 1]) + 1 - at) if k else 0 : end]
        at = stop


def _groups(texts: pa.Array) -> Iterator[list[tuple[int, np.ndarray, bool]]]:
    """(row, bytes, whether the first word has been counted) of texts, A-Z lower-cased, in lists of about AT_ONCE bytes."""
    group, size = [], 0
    for row, text in enumerate(texts):
        whole = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
        for window, shared in _windows(whole):
            group.append((row, window, shared))
            size += len(window)
            if size >= AT_ONCE:
                yield group
                group, size = [], 0
    if group:
        yield group


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and buckets of all features of some texts, and the rows of their words; together all of them."""
    for group in _groups(texts):
        data = np.concatenate([x for _, window, _ in group for x in (window, _GAP)])
        edge = np.flatnonzero(np.diff(_WORD[data], prepend=False))  # each window ends with a gap
        starts, ends = edge[::2], edge[1::2]
        begins = np.cumsum([0, *(len(w) + 1 for _, w, _ in group[:-1])])
        window = np.searchsorted(begins, starts, "right") - 1
        row = np.array([r for r, _, _ in group], np.int64)[window]
        counted = np.array([s for _, _, s in group])[window] & np.diff(window, prepend=-1).astype(bool)
        # words one space apart, so that a pair of neighbours is one span
        size = ends - starts
        end = np.cumsum(size + 1) - 1
        packed = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
        at = np.repeat(ends - np.cumsum(size), size) + np.arange(int(size.sum()))
        packed[np.repeat(end - ends, size) + at] = data[at]
        start = end - size
        pair = np.flatnonzero(window[1:] == window[:-1])
        one = np.flatnonzero(~counted)
        crc = np.concatenate([crc32_of_spans(packed, start[one], end[one]), crc32_of_spans(packed, start[pair], end[pair + 1])])
        yield np.concatenate([row[one], row[pair]]), (crc % np.uint32(BUCKETS)).astype(np.int64), row[one]


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n: how many features of the texts (text) each bucket holds; buckets without are missing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, bucket, _ in features(batch.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, in thousandths of a nat, from two tables of bucket_counts."""
    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for counts, found in ((s, corpus), (t, target)):
        for bucket, n in found.collect():  # BUCKETS rows at most
            counts[bucket] = n
    all_s, all_t = float(s.sum() + BUCKETS), float(t.sum() + BUCKETS)
    return np.array([floor(1000 * log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, words, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, bucket, of_words in features(batch.column(1)):
                n += np.bincount(row, minlength=len(n))
                words += np.bincount(of_words, minlength=len(n))
                np.add.at(total, row, shared.value[bucket])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the id's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with rank: from 1 for the highest scores, of so many hundredths of the documents with enough words.

    How many documents stand before a score is read off the scores' histogram; a window of
    the documents of one score orders these. The others pass by.
    """
    enough = F.col("n_words") >= least_words
    histogram = scored.filter(enough).groupBy("score").agg(F.count("*").alias("n"))
    rows = histogram.collect()  # distinct scores: integers of a bounded range
    before, places = 0, share * sum(r["n"] for r in rows) // 100
    ahead = []
    for r in sorted(rows, key=lambda r: -r["score"]):
        if before >= places:
            break
        ahead.append((r["score"], before))
        before += r["n"]
    ahead = scored.sparkSession.createDataFrame(ahead, "score long, ahead long")
    joined = scored.join(F.broadcast(ahead), "score", "left")
    near = joined.filter(enough & F.col("ahead").isNotNull())
    at = F.col("ahead") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    near = near.withColumn("at", at).withColumn("rank", F.when(F.col("at") <= places, F.col("at"))).drop("at")
    rest = joined.filter(~enough | F.col("ahead").isNull()).withColumn("rank", F.lit(None).cast("long"))
    return near.unionByName(rest).drop("ahead")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gain = gains(bucket_counts(docs), bucket_counts(table(spark, sf_dir, "benchmark")))
    scored = stored(weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "scored")
    return drawn(scored).select("doc_id", "n_features", "weight", "score", "rank")


# The checksum's table from its rule (reflected polynomial 0xEDB88320), and a feature's bytes from its hexadecimal form.
OP13_SQL = r"""
with entry as (select i, list_reduce(list_prepend(i::bigint, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i)),
crc_table as (select list(v order by i) as t from entry),
text_of as (select 'd' as kind, row_number() over () as row, doc_id, coalesce(text, '') as text from documents union all select 'b', row_number() over (), null, coalesce(text, '') from benchmark),
words as (select kind, row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from text_of),
feature as (select kind, row, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) as f from words),
hexed as (select f, hex(encode(f)) as x from (select distinct f from feature)),
bucket_of as (select f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(x) + 1, 2),
  lambda i: ((instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 as bucket from hexed, crc_table),
counted as (select bucket, count(*) filter (kind = 'd') as s, count(*) filter (kind = 'b') as t from feature join bucket_of using (f) group by bucket),
total as (select sum(s)::double as ss, sum(t)::double as tt from counted),
gain as (select bucket, floor(1000 * ln((t + 1.0::double) * (ss + 10000) / ((s + 1.0::double) * (tt + 10000))))::bigint as g from counted, total),
summed as (select row, count(*) as n, sum(g) as g from feature join bucket_of using (f) join gain using (bucket) where kind = 'd' group by row),
weight as (select w.row, doc_id, len(w) as n_words, coalesce(n, 0) as n_features, coalesce(floor(g / n::double), 0)::bigint as weight from words w left join summed s on s.row = w.row where kind = 'd'),
noise as (select *, list_reduce(list_prepend(0::bigint, list_transform(range(1, 9), lambda i: instr('0123456789abcdef', sha256('7:' || coalesce(doc_id::varchar, ''))[i]) - 1)), lambda a, b: a * 16 + b) as h from weight),
scored as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from noise),
ordered as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last) as place, count(*) over (partition by n_words >= 20) as n from scored)
select doc_id, n_features::bigint as n_features, weight, score, case when n_words >= 20 and place <= 25 * n // 100 then place end as rank from ordered
"""
