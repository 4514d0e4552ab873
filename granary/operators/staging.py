"""Uploads on their way into the index: admission of each and of its batch, and the plan of an index built anew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import casefold, collapse
from granary.operators import chunks as C
from granary.operators import operations as O

# How files of a kind begin.
SIGNATURES = ((".pdf", "%PDF-"), (".docx", "PK\x03\x04"))


@dataclass(frozen=True)
class Limits:
    files: int = 10
    bytes: int = 10 * 1024 * 1024
    batches: int = 100


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def n_batches(n_chunks: Column) -> Column:
    return F.ceil(n_chunks / F.lit(C.EMBED_BATCH)).cast("long")


def type_fits(name: Column, content_type: Column) -> Column:
    allowed = F.array(*[F.lit(f"{s} {t}") for s, t in O.CONTENT_TYPES])
    return F.array_contains(allowed, F.concat_ws(" ", suffix(name), content_type))


def signature_fits(name: Column, head: Column) -> Column:
    out = F.lit(True)
    for s, begin in SIGNATURES:
        out = F.when(suffix(name) == s, F.startswith(F.coalesce(head, F.lit("")), F.lit(begin))).otherwise(out)
    return out


def staged(uploads: DataFrame, existing: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """batch, position, filename, reason, n_chunks and n_batches of every upload; the reason is null for those that are staged.

    uploads: batch, position, filename, content_type, operation, size in bytes, head (its beginning), text (what it says);
    existing: filename. One that fails keeps none of the others out, but a name counts as taken from its first fit use on.
    A batch of too many files fails as a whole, as does one whose files together need too many calls. Positions of a batch are distinct.
    """
    sizes = uploads.groupBy("batch").agg((F.count("*") > limits.files).alias("crowded"))
    taken = existing.select("filename").distinct().withColumn("exists", F.lit(True))
    every = uploads.join(sizes, "batch").withColumn("named", F.size(O.filename_problems(F.col("filename"))) == 0)
    fit = F.col("named") & ~F.col("crowded")
    first = every.filter(fit).groupBy("batch", casefold(F.col("filename")).alias("key")).agg(F.min("position").alias("first"))
    found = every.withColumn("key", F.when(fit, casefold(F.col("filename")))).join(first, ["batch", "key"], "left").join(taken, "filename", "left")
    n_chunks = F.ceil(F.length(collapse(F.coalesce("text", F.lit("")))) / F.lit(C.CHUNK_SIZE)).cast("long")
    found = found.withColumns({"n_chunks": n_chunks, "exists": F.coalesce("exists", F.lit(False))}).withColumn("n_batches", n_batches(F.col("n_chunks")))
    reason = (
        F.when(F.col("crowded"), "too_many_files").when(~F.col("named"), "name").when(F.col("position") > F.col("first"), "repeated")
        .when(~F.coalesce(F.col("operation").isin("add", "replace"), F.lit(False)), "operation").when(~type_fits(F.col("filename"), F.col("content_type")), "content_type")
        .when((F.col("operation") == "add") & F.col("exists"), "exists").when((F.col("operation") == "replace") & ~F.col("exists"), "absent").when(F.col("size") > limits.bytes, "size")
        .when(~signature_fits(F.col("filename"), F.col("head")), "signature").when(F.col("n_chunks") == 0, "empty").when(F.col("n_batches") > limits.batches, "calls")
    )
    judged = found.withColumn("reason", reason)
    total = judged.filter("reason is null").groupBy("batch").agg((F.sum("n_batches") > limits.batches).alias("dear"))
    out = judged.join(total, "batch", "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("dear"), "batch_calls").otherwise(F.col("reason")))
    return out.select("batch", "position", "filename", "reason", "n_chunks", "n_batches")


def migration_plan(base: DataFrame, files: DataFrame, chunks: DataFrame, legacy: DataFrame, most: int = Limits.batches) -> DataFrame:
    """One row: what building an old index anew costs, and what forbids it.

    base (filename, chunk_id): the present materials; files (filename, operation) and chunks (filename, chunk_id): what is
    staged; legacy (chunk_id): the old index. Names are compared without regard to case, ids counted once.
    """
    key = casefold(F.col("filename")).alias("key")
    names = base.select(key).distinct().withColumn("there", F.lit(True))
    wanted = files.select("operation", key).join(names, "key", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    clashes = wanted.agg(F.count(F.when((F.col("operation") == "add") & F.col("there"), 1)).alias("n_taken"), F.count(F.when((F.col("operation") == "replace") & ~F.col("there"), 1)).alias("n_absent"), F.lit(1).alias("one"))
    gone = files.filter("operation = 'replace'").select(key).distinct()
    kept = base.withColumn("key", key).join(gone, "key", "left_anti")
    mark = lambda df, name: df.select("chunk_id", *[F.lit(name == n).alias(n) for n in ("base", "final", "old")])
    ids = mark(base, "base").unionByName(mark(kept, "final")).unionByName(mark(chunks, "final")).unionByName(mark(legacy, "old")).groupBy("chunk_id").agg(*[F.max(n).alias(n) for n in ("base", "final", "old")])
    n = lambda c: F.count(F.when(c, 1))
    counts = ids.agg(n(F.col("old")).alias("n_legacy"), n(F.col("base")).alias("n_base"), n(F.col("final")).alias("n_final"), n(F.col("final") & ~F.col("base")).alias("n_new"), F.lit(1).alias("one"))
    out = counts.join(clashes, "one").withColumns({"base_calls": n_batches(F.col("n_base")), "new_calls": n_batches(F.col("n_new"))})
    rules = (("no_legacy", F.col("n_legacy") == 0), ("name_taken", F.col("n_taken") > 0), ("name_absent", F.col("n_absent") > 0), ("base_calls", F.col("base_calls") > most), ("new_calls", F.col("new_calls") > most))
    problems = F.array_join(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules])), ",")
    return out.select("n_legacy", "n_base", "n_final", "n_new", "base_calls", "new_calls", (F.col("base_calls") + F.col("new_calls")).alias("calls"), (F.col("n_legacy") == F.col("n_base")).alias("legacy_matches"), "n_taken", "n_absent", problems.alias("problems"))


# --- queries: documents as uploads and as the materials of an index ---


def q_stage_uploads(spark, sf_dir):
    """Documents in batches of eight, every sixth batch twice as large, with names, kinds and operations by number; tighter limits than in production."""
    k, number, text = F.col("doc_id") % 11, F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))
    group = F.floor(F.col("doc_id") / 8)
    case = lambda of, default: F.coalesce(*[F.when(k == i, v) for i, v in of.items()], default)
    name = lambda s: F.concat(F.lit("doc-"), number, F.lit(s))
    filename = case({0: F.lit("con.txt"), 1: F.lit("Shared.md"), 2: F.lit("shared.MD"), 3: name(".exe"), 4: name(".pdf"), 5: name(".docx")}, name(".txt"))
    kind = case({1: F.lit("text/markdown"), 2: F.lit("text/plain"), 4: F.lit("application/pdf"), 5: F.lit("application/zip"), 6: F.lit("application/zip")}, F.lit("text/plain"))
    even = F.col("doc_id") % 2 == 0
    head = F.when(even & (k == 4), "%PDF-1.7").when(even & (k == 5), "PK\x03\x04").otherwise(F.left(text, F.lit(8)))
    operation = F.when(F.col("doc_id") % 7 == 3, "replace").when(F.col("doc_id") % 13 == 5, "move").otherwise("add")
    documents = O.read(spark, sf_dir, "documents")
    uploads = documents.select(
        F.when(group % 6 == 0, group + 1).otherwise(group).alias("batch"), F.col("doc_id").alias("position"), filename.alias("filename"), kind.alias("content_type"), operation.alias("operation"),
        F.octet_length(text).cast("long").alias("size"), head.alias("head"), text.alias("text"),
    )
    existing = documents.filter("doc_id % 3 = 0").select(F.concat(F.lit("doc-"), number, F.lit(".txt")).alias("filename"))
    return staged(uploads, existing, Limits(files=10, bytes=3_000, batches=4))


def q_migration_plan(spark, sf_dir):
    """Three of four documents are the materials; the fourth is added, and every eighth replaced by its first two chunks, the second with a mark behind it.
    Some names are wrong: every 32nd addition is there already, every 40th replacement is of nothing. Two of three materials are in the old index."""
    named = C.chunks(spark, sf_dir).withColumn("filename", F.concat(F.lit("Doc-"), F.col("doc_id").cast("string")))
    base = named.filter("doc_id % 4 < 3")
    marked = C.with_ids(named.filter("doc_id % 8 = 1 and chunk_index <= 2").withColumn("content", F.when(F.col("chunk_index") == 2, F.concat("content", F.lit("."))).otherwise(F.col("content"))))
    chunks = named.filter("doc_id % 4 = 3").select("filename", "chunk_id").unionByName(marked.select("filename", "chunk_id"))
    ids = O.read(spark, sf_dir, "documents").select("doc_id")
    wrong = F.when(F.col("doc_id") % 32 == 3, F.col("doc_id") - 1).when(F.col("doc_id") % 40 == 1, -F.col("doc_id")).otherwise(F.col("doc_id"))
    files = ids.filter("doc_id % 4 = 3 or doc_id % 8 = 1").select(F.concat(F.lit("doc-"), wrong.cast("string")).alias("filename"), F.when(F.col("doc_id") % 4 == 3, "add").otherwise("replace").alias("operation"))
    return migration_plan(base.select("filename", "chunk_id"), files, chunks, base.filter("doc_id % 3 < 2").select("chunk_id"))


QUERIES = {
    "stage_uploads": (
        q_stage_uploads,
        f"""with doc as (select doc_id, coalesce(text, '') as text, doc_id % 11 as k, doc_id // 8 as g from documents),
        up as (select case when g % 6 = 0 then g + 1 else g end as batch, doc_id as position, case k when 0 then 'con.txt' when 1 then 'Shared.md' when 2 then 'shared.MD' when 3 then 'doc-' || doc_id || '.exe' when 4 then 'doc-' || doc_id || '.pdf'
            when 5 then 'doc-' || doc_id || '.docx' else 'doc-' || doc_id || '.txt' end as filename, case k when 1 then 'text/markdown' when 2 then 'text/plain' when 4 then 'application/pdf' when 5 then 'application/zip' when 6 then 'application/zip' else 'text/plain' end as content_type,
          case when doc_id % 7 = 3 then 'replace' when doc_id % 13 = 5 then 'move' else 'add' end as operation, strlen(text) as size, k in (4, 5) and doc_id % 2 = 1 as forged, ceil(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) / 180.0)::bigint as n_chunks from doc),
        has as (select 'doc-' || doc_id || '.txt' as filename from documents where doc_id % 3 = 0),
        c as (select *, count(*) over (partition by batch) > 10 as crowded, filename <> 'con.txt' and not ends_with(filename, '.exe') as named, lower(regexp_extract(filename, '(\\.[^.]*)$', 1)) as suffix, ceil(n_chunks / 10.0)::bigint as n_batches,
          filename in (select filename from has) as there from up),
        r as (select *, case when crowded then 'too_many_files' when not named then 'name' when exists (select 1 from c d where d.batch = c.batch and d.named and lower(d.filename) = lower(c.filename) and d.position < c.position) then 'repeated'
          when operation = 'move' then 'operation' when not ({O._TYPES_SQL}) then 'content_type' when operation = 'add' and there then 'exists' when operation = 'replace' and not there then 'absent' when size > 3000 then 'size'
          when forged then 'signature' when n_chunks = 0 then 'empty' when n_batches > 4 then 'calls' end as reason from c)
        select batch, position, filename, case when reason is null and sum(case when reason is null then n_batches else 0 end) over (partition by batch) > 4 then 'batch_calls' else reason end as reason, n_chunks, n_batches from r""",
    ),
    "migration_plan": (
        q_migration_plan,
        f"""with {C.CHUNKS_SQL}, base as (select doc_id, chunk_id from chunk where doc_id % 4 < 3),
        marked as (select material_id, chunk_index, sha256(to_json([case when chunk_index = 2 then content || '.' else content end])::varchar) as h from piece where doc_id % 8 = 1 and chunk_index <= 2),
        fresh as (select chunk_id from chunk where doc_id % 4 = 3 union all select sha256(to_json(['chunk-v1', material_id, '', '', chunk_index::varchar, h])::varchar) from marked),
        files as (select case when doc_id % 32 = 3 then doc_id - 1 when doc_id % 40 = 1 then -doc_id else doc_id end as name, doc_id % 4 = 3 as added from documents where doc_id % 4 = 3 or doc_id % 8 = 1),
        final as (select chunk_id from base where doc_id not in (select name from files where not added) union select chunk_id from fresh), old as (select chunk_id from base where doc_id % 3 < 2),
        f as (select count(*) filter (added and name in (select doc_id from base)) as n_taken, count(*) filter (not added and name not in (select doc_id from base)) as n_absent from files),
        n as (select (select count(distinct chunk_id) from old) as n_legacy, (select count(distinct chunk_id) from base) as n_base, (select count(*) from final) as n_final, (select count(*) from final where chunk_id not in (select chunk_id from base)) as n_new),
        p as (select *, ceil(n_base / 10.0)::bigint as base_calls, ceil(n_new / 10.0)::bigint as new_calls from n, f)
        select n_legacy, n_base, n_final, n_new, base_calls, new_calls, base_calls + new_calls as calls, n_legacy = n_base as legacy_matches, n_taken, n_absent,
          array_to_string(list_filter([case when n_legacy = 0 then 'no_legacy' end, case when n_taken > 0 then 'name_taken' end, case when n_absent > 0 then 'name_absent' end, case when base_calls > {Limits.batches} then 'base_calls' end,
            case when new_calls > {Limits.batches} then 'new_calls' end], lambda x: x is not null), ',') as problems from p""",
    ),
}
