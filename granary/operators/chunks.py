"""Corpus ingest: materials, chunks, identities, and the maintenance of an index of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import collapse, collapse_of, stable_sha256

CHUNK_SIZE = 180
EMBED_BATCH = 10


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the text as it is given, null as empty."""
    source = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", source.alias("source"), F.coalesce("text", F.lit("")).alias("text"))


def material_id(source: Column) -> Column:
    return stable_sha256(F.lit("material-v1"), F.lit("text"), source)


def units(spark: SparkSession, sf_dir: str, within: DataFrame | None = None) -> DataFrame:
    """One material unit a document: doc_id, lang, source, material_id and collapsed content; of the sources of `within` only, if given."""
    found = documents(spark, sf_dir)
    if within is not None:  # before any text is collapsed or cut
        found = found.join(within.select("source").distinct(), "source", "left_semi")
    return found.select("doc_id", "lang", "source", material_id(F.col("source")).alias("material_id"), collapse(F.col("text")).alias("content"))


def fixed_chunks(units: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """units with chunk_index (from 1) and content cut to size characters; empty content has no chunk."""
    # all pieces in one walk over the text: a substring for each would count characters from its start anew
    pieces = F.regexp_extract_all("content", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    others = [c for c in units.columns if c not in ("content", "chunk_index")]
    return units.select(*others, F.posexplode_outer(pieces).alias("at", "content")).filter("content is not null").select(*others, (F.col("at") + 1).alias("chunk_index"), "content")


def pieces_of(text: str, size: int = CHUNK_SIZE) -> list[str]:
    """The contents of fixed_chunks of one text that is not collapsed yet, for what runs in Arrow batches."""
    content = collapse_of(text)
    return [content[a : a + size] for a in range(0, len(content), size)]


def chunk_id(material_id: Column, index: Column, content_hash: Column, page: Column | None = None, section: Column | None = None) -> Column:
    blank = F.lit("")
    return stable_sha256(F.lit("chunk-v1"), material_id, page if page is not None else blank, section if section is not None else blank, index, content_hash)


def with_ids(chunks: DataFrame) -> DataFrame:
    hashed = chunks.withColumn("content_hash", stable_sha256(F.col("content")))
    return hashed.withColumn("chunk_id", chunk_id(F.col("material_id"), F.col("chunk_index"), F.col("content_hash")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ids(fixed_chunks(units(spark, sf_dir)))


UNITS_SQL = r"""unit as (
  select doc_id, lang, 'doc-' || doc_id as source, sha256(to_json(['material-v1', 'text', 'doc-' || doc_id])::varchar) as material_id,
         trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as content from documents)"""
PIECES_SQL = (
    UNITS_SQL
    + """, piece as (
  select doc_id, lang, source, material_id, i::int as chunk_index, substr(content, (i - 1) * 180 + 1, 180) as content
  from unit, unnest(range(1, ceil(length(content) / 180.0)::bigint + 1)) u(i))"""
)
CHUNKS_SQL = (
    PIECES_SQL
    + """, hashed as (select *, sha256(to_json([content])::varchar) as content_hash from piece),
chunk as (select *, sha256(to_json(['chunk-v1', material_id, '', '', chunk_index::varchar, content_hash])::varchar) as chunk_id from hashed)"""
)


def q_fixed_chunks(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", "chunk_index", "content", "content_hash", "material_id", "chunk_id")


def q_chunk_records(spark, sf_dir):
    evidence = stable_sha256(F.lit("evidence-v1"), F.col("chunk_id"))
    locator = F.concat("source", F.lit("#chunk="), F.col("chunk_index").cast("string"))
    label = F.format_string("[%s · 第 %d 段]", "source", "chunk_index")
    return chunks(spark, sf_dir).select("chunk_id", evidence.alias("evidence_id"), locator.alias("locator"), label.alias("label"), F.length("content").cast("long").alias("n_chars"))


def q_chunk_stats(spark, sf_dir):
    """Counts and lengths of chunks by language; the 95th percentile is the nearest rank."""
    n = F.length("content")
    p95 = F.expr("percentile_disc(0.95) within group (order by length(content))")
    return (
        fixed_chunks(units(spark, sf_dir))
        .groupBy("lang")
        .agg(
            F.count("*").alias("n_chunks"), F.min(n).cast("long").alias("shortest"), F.expr("percentile(length(content), 0.5)").alias("median"),
            p95.cast("long").alias("p95"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.count_distinct("doc_id").alias("n_documents"),
        )
    )


def q_scan_materials(spark, sf_dir):
    """Materials in path order with the characters read so far: partial sums by range of ids, then within each."""
    found = units(spark, sf_dir).select("doc_id", "source", F.length("content").cast("long").alias("n_chars"))
    ranged = found.withColumn("part", F.floor(F.col("doc_id") / 4096))
    from pyspark.sql import Window

    totals = ranged.groupBy("part").agg(F.sum("n_chars").alias("in_part"))
    before = totals.withColumn("before", F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("n_chars").over(Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("within", within).join(before.select("part", "before"), "part").select("doc_id", "source", "n_chars", (F.col("within") + F.col("before")).alias("running_chars"))


def q_embed_batches(spark, sf_dir):
    return fixed_chunks(units(spark, sf_dir)).groupBy("lang").agg(F.count("*").alias("n_chunks"), F.ceil(F.count("*") / EMBED_BATCH).cast("long").alias("n_batches"))


def q_ids_fingerprint(spark, sf_dir):
    """Of each document the hash of its sorted chunk ids; index_fingerprint covers the whole index."""
    joined = F.array_join(F.sort_array(F.collect_list("chunk_id")), "\n")
    return chunks(spark, sf_dir).groupBy("doc_id").agg(F.sha2(joined, 256).alias("fingerprint"), F.count("*").alias("n_chunks"))


def synced(stored: DataFrame, current: DataFrame) -> DataFrame:
    """chunk_id and action: add what is only current, delete what is only stored, keep the rest."""
    s, c = stored.select("chunk_id").distinct().withColumn("s", F.lit(1)), current.select("chunk_id").distinct().withColumn("c", F.lit(1))
    action = F.when(F.col("s").isNull(), "add").when(F.col("c").isNull(), "delete").otherwise("unchanged")
    return s.join(c, "chunk_id", "full_outer").select("chunk_id", action.alias("action"))


def q_index_sync_diff(spark, sf_dir):
    """The stored index holds the texts without line breaks' own lines after the first; the current one holds them whole."""
    old = units(spark, sf_dir).drop("content").join(
        spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", collapse(F.substring_index(F.coalesce("text", F.lit("")), "\n", 3)).alias("content")), "doc_id"
    )
    return synced(with_ids(fixed_chunks(old)), chunks(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id"))


def of_material(source: Column, filename: str) -> Column:
    """Whether a chunk's source label belongs to a material: itself, or a page, paragraph or table of it."""
    import re

    quoted = re.escape(filename)
    return (source == filename) | source.startswith(f"web:{filename}") | source.rlike(rf"(?i)^{quoted} · 第 \d+ (页|段)$") | source.rlike(rf"(?i)^{quoted} · 表 \d+$")


def q_index_delete_material(spark, sf_dir):
    """What remains of the index by language once the material doc-7 is deleted."""
    kept = chunks(spark, sf_dir).filter(~of_material(F.col("source"), "doc-7"))
    return kept.groupBy("lang").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id"))


def _old_units(spark, sf_dir) -> DataFrame:
    """The documents as they were before their lines after the third were added."""
    old = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", collapse(F.substring_index(F.coalesce("text", F.lit("")), "\n", 3)).alias("content"))
    return units(spark, sf_dir).drop("content").join(old, "doc_id")


def q_index_set_equality(spark, sf_dir):
    """Whether the stored index's ids are those expected, by language; how many are on one side only."""
    side = lambda u, name: with_ids(fixed_chunks(u)).select("lang", "chunk_id").distinct().withColumn(name, F.lit(1))
    both = side(_old_units(spark, sf_dir), "stored").join(side(units(spark, sf_dir), "expected"), ["lang", "chunk_id"], "full_outer")
    only = lambda a, b: F.count(F.when(F.col(b).isNull(), F.col(a)))
    return both.groupBy("lang").agg(only("stored", "expected").alias("n_only_stored"), only("expected", "stored").alias("n_only_expected"), (F.count("stored") == F.count("expected")).alias("same_count")).withColumn("equal", (F.col("n_only_stored") == 0) & (F.col("n_only_expected") == 0))


def q_index_fingerprint(spark, sf_dir):
    """The upper nodes of the index's hash tree over ids, texts and metadata: those of two digits, and the root."""
    from granary.sources.index import fingerprint_tree

    metadata = stable_sha256(F.col("source"), F.col("chunk_index"), F.coalesce("lang", F.lit("")))
    return fingerprint_tree(chunks(spark, sf_dir), "chunk_id", "content", metadata).filter(F.length("prefix") <= 2)


QUERIES = {
    "index_set_equality": (
        q_index_set_equality,
        f"""with {CHUNKS_SQL}, old_unit as (select lang, sha256(to_json(['material-v1', 'text', 'doc-' || doc_id])::varchar) as material_id,
          trim(regexp_replace(array_to_string(string_split(coalesce(text, ''), chr(10))[1:3], chr(10)), '\\s+', ' ', 'g')) as content from documents),
        old_piece as (select lang, material_id, i as chunk_index, substr(content, (i - 1) * 180 + 1, 180) as content from old_unit, unnest(range(1, ceil(length(content) / 180.0)::bigint + 1)) u(i)),
        old as (select distinct lang, sha256(to_json(['chunk-v1', material_id, '', '', chunk_index::varchar, sha256(to_json([content])::varchar)])::varchar) as chunk_id from old_piece),
        new as (select distinct lang, chunk_id from chunk), both_ as (select coalesce(o.lang, n.lang) as lang, o.chunk_id as o, n.chunk_id as n from old o full join new n on o.chunk_id = n.chunk_id and o.lang = n.lang)
        select lang, count(o) filter (n is null) as n_only_stored, count(n) filter (o is null) as n_only_expected, count(o) = count(n) as same_count, count(o) filter (n is null) = 0 and count(n) filter (o is null) = 0 as equal from both_ group by lang""",
    ),
    "index_fingerprint": (
        q_index_fingerprint,
        f"""with {CHUNKS_SQL}, leaf as (select left(sha256(chunk_id), 6) as p, sha256(to_json([chunk_id, sha256(content), sha256(sha256(to_json([source, chunk_index::varchar, coalesce(lang, '')])::varchar))])::varchar) as h from chunk),
        six as (select p, sha256(string_agg(h, chr(10) order by h)) as h from leaf group by p), four as (select left(p, 4) as p, sha256(string_agg(h, chr(10) order by p)) as h from six group by 1),
        two as (select left(p, 2) as p, sha256(string_agg(h, chr(10) order by p)) as h from four group by 1)
        select p as prefix, h as hash from two union all select '', sha256(string_agg(h, chr(10) order by p)) from two""",
    ),
    "fixed_chunks": (q_fixed_chunks, f"with {CHUNKS_SQL} select doc_id, chunk_index, content, content_hash, material_id, chunk_id from chunk"),
    "chunk_records": (
        q_chunk_records,
        f"""with {CHUNKS_SQL} select chunk_id, sha256(to_json(['evidence-v1', chunk_id])::varchar) as evidence_id, source || '#chunk=' || chunk_index as locator,
        '[' || source || ' · 第 ' || chunk_index || ' 段]' as label, length(content)::bigint as n_chars from chunk""",
    ),
    "chunk_stats": (
        q_chunk_stats,
        f"""with {PIECES_SQL} select lang, count(*) as n_chunks, min(length(content))::bigint as shortest, quantile_cont(length(content), 0.5)::double as median,
        quantile_disc(length(content), 0.95)::bigint as p95, max(length(content))::bigint as longest, round(avg(length(content)), 6) as mean, count(distinct doc_id) as n_documents from piece group by lang""",
    ),
    "scan_materials": (
        q_scan_materials,
        f"with {UNITS_SQL} select doc_id, source, length(content)::bigint as n_chars, (sum(length(content)) over (order by doc_id rows unbounded preceding))::bigint as running_chars from unit",
    ),
    "embed_batches": (q_embed_batches, f"with {PIECES_SQL} select lang, count(*) as n_chunks, ceil(count(*) / 10.0)::bigint as n_batches from piece group by lang"),
    "ids_fingerprint": (q_ids_fingerprint, f"with {CHUNKS_SQL} select doc_id, sha256(string_agg(chunk_id, chr(10) order by chunk_id)) as fingerprint, count(*) as n_chunks from chunk group by doc_id"),
    "index_sync_diff": (
        q_index_sync_diff,
        f"""with {CHUNKS_SQL}, old_unit as (select doc_id, sha256(to_json(['material-v1', 'text', 'doc-' || doc_id])::varchar) as material_id,
          trim(regexp_replace(array_to_string(string_split(coalesce(text, ''), chr(10))[1:3], chr(10)), '\\s+', ' ', 'g')) as content from documents),
        old_piece as (select material_id, i as chunk_index, substr(content, (i - 1) * 180 + 1, 180) as content from old_unit, unnest(range(1, ceil(length(content) / 180.0)::bigint + 1)) u(i)),
        old as (select distinct sha256(to_json(['chunk-v1', material_id, '', '', chunk_index::varchar, sha256(to_json([content])::varchar)])::varchar) as chunk_id from old_piece),
        both_ as (select coalesce(o.chunk_id, c.chunk_id) as chunk_id, case when o.chunk_id is null then 'add' when c.chunk_id is null then 'delete' else 'unchanged' end as action
          from old o full join (select distinct chunk_id from chunk) c on o.chunk_id = c.chunk_id)
        select action, count(*) as n, min(chunk_id) as first_id from both_ group by action""",
    ),
    "index_delete_material": (q_index_delete_material, f"with {CHUNKS_SQL} select lang, count(*) as n, min(chunk_id) as first_id from chunk where source <> 'doc-7' group by lang"),
}
