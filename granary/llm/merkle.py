"""Document fingerprints: Merkle trees over sections, paragraphs and sentences. DataFrame operations only.

A paragraph is a line with its line break; its leaves are its sentences, cut behind a full
stop, exclamation or question mark and the white space character after it. Cuts lose no
character and leave no empty part. A paragraph's hash is the SHA-256 of its leaves' hashes in order, a section's
that of its paragraphs', the root that of the sections'. A section ends behind a paragraph
whose hash begins with 0 or 1, one of eight on average: where it ends depends on what stands
there, so sections behind an edit are found again.

A fingerprint is text: the root (64 digits), a colon, the sections apart by semicolons; a
section is its hash (16 digits), an equals sign, its paragraphs apart by commas; a paragraph
is its leaves' hashes (8 digits each). Equal texts have equal fingerprints, texts whose
roots differ are unequal; everything else is read from two fingerprints, without the texts.

Likeness is 1 where roots are equal. Else sections that both have count whole, and the
leaves of the others (distinct hashes of 8 digits) are compared: twice the common leaves by
those of both; leaves that only stand in another order leave it just under 1. ``changed_paragraphs`` gives the numbers of the paragraphs in sections that
the other tree lacks and whose leaves are not those of one of its paragraphs.

The next document of the query is the one before it in ascending order of (doc_id, text), null
ids first; after the last comes the first again. Ids are cut into ranges at quantiles; each
range is a window, so the texts move once, and only the ranges' first texts move again.

Defined results: null texts are empty ones; an empty text is one section of one paragraph
with one empty leaf; a document alone is its own next one; repeated rows follow one
another; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import table

SECTION, LEAF = 16, 8  # hexadecimal digits
#: Ranges of ids a shuffle partition, and the relative error of the quantiles that part them.
RANGES, ACCURACY = 4, 100_000


def _sha(x: Column) -> Column:
    return F.sha2(x, 256)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text that is not null."""

    def paragraph(line: Column) -> Column:
        leaves = F.transform(F.split(line, r"(?s)(?<=[.!?][ \t\r\n])(?=.)", -1), _sha)
        own = _sha(F.array_join(leaves, ""))
        short = F.array_join(F.transform(leaves, lambda x: F.left(x, F.lit(LEAF))), "")
        return F.concat(own, short, F.when(F.left(own, F.lit(1)).isin("0", "1"), ";").otherwise(","))

    def section(paragraphs: Column) -> Column:
        parts = F.split(paragraphs, ",", -1)
        own = _sha(F.array_join(F.transform(parts, lambda p: F.left(p, F.lit(64))), ""))
        return F.concat(own, F.lit("="), F.array_join(F.transform(parts, lambda p: F.substr(p, F.lit(65))), ","))

    paragraphs = F.array_join(F.transform(F.split(text, r"(?s)(?<=\n)(?=.)", -1), paragraph), "")
    sections = F.transform(F.split(F.regexp_replace(paragraphs, "[,;]$", ""), ";", -1), section)
    root = lambda x: _sha(F.array_join(F.transform(x, lambda s: F.left(s, F.lit(64))), ""))
    shown = lambda x: F.array_join(F.transform(x, lambda s: F.concat(F.left(s, F.lit(SECTION)), F.substr(s, F.lit(65)))), ";")
    # a lambda's variable: the sections are computed once
    return F.element_at(F.transform(F.array(sections), lambda x: F.concat(root(x), F.lit(":"), shown(x))), 1)


def root_of(fp: Column) -> Column:
    return F.left(fp, F.lit(64))


def sections_of(fp: Column) -> Column:
    return F.split(F.substr(fp, F.lit(66)), ";", -1)


def _paragraphs(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.split(F.substr(s, F.lit(SECTION + 2)), ",", -1)))


def _leaves(sections: Column) -> Column:
    return F.regexp_extract_all(F.array_join(F.transform(sections, lambda s: F.substr(s, F.lit(SECTION + 2))), ""), F.lit(f"[0-9a-f]{{{LEAF}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1, from two fingerprints."""

    def unlike(x: Column, y: Column) -> Column:
        alike = F.size(_leaves(F.array_intersect(x, y)))
        own, other = F.array_distinct(_leaves(F.array_except(x, y))), F.array_distinct(_leaves(F.array_except(y, x)))
        both = F.size(F.array_intersect(own, other))
        every = 2 * alike + F.size(own) + F.size(other)
        return F.least(2.0 * (alike + both) / every, 1 - 1.0 / (every + 1))

    halves = F.transform(F.array(F.struct(sections_of(a).alias("a"), sections_of(b).alias("b"))), lambda x: unlike(x["a"], x["b"]))
    return F.when(root_of(a) == root_of(b), 1.0).otherwise(F.element_at(halves, 1))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 1) of a's paragraphs that b lacks: those of differing sections first, then by their leaves."""
    theirs = lambda x: _paragraphs(F.array_except(x["b"], x["a"]))

    def numbers(x: Column) -> Column:
        whole = F.array_intersect(x["a"], x["b"])
        marked = F.flatten(F.transform(x["a"], lambda s: F.transform(F.split(F.substr(s, F.lit(SECTION + 2)), ",", -1), lambda p: F.when(~F.array_contains(whole, s), p))))
        lacking = F.array_except(marked, theirs(x))
        return F.filter(F.transform(marked, lambda p, i: F.when(p.isNotNull() & F.array_contains(lacking, p), i + 1)), lambda i: i.isNotNull())

    both = F.struct(sections_of(a).alias("a"), sections_of(b).alias("b"))
    return F.when(root_of(a) == root_of(b), F.array().cast("array<int>")).otherwise(F.element_at(F.transform(F.array(both), numbers), 1))


def _bounds(docs: DataFrame, n: int) -> list[int]:
    """Ids of docs that part its rows into n ranges of about one size; the last is the largest id. None without ids."""
    found = docs.agg(F.percentile_approx("doc_id", [(k + 1) / n for k in range(n)], ACCURACY).alias("b")).first()["b"]
    return sorted(set(found or []))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are less than key, by bisection; 0 for null."""
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded to one literal

    def halve(x: Column, _: Column) -> Column:
        middle = F.floor((x["low"] + x["high"]) / 2).cast("int")
        above = F.get(held, middle) < key
        open_ = x["low"] < x["high"]
        return F.struct(F.when(open_ & above, middle + 1).otherwise(x["low"]).alias("low"), F.when(open_ & ~above, middle).otherwise(x["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds) - 1).alias("high"))  # no key is over the last bound
    found = F.aggregate(F.array_repeat(F.lit(0), len(bounds).bit_length()), start, halve, lambda x: x["low"])
    return F.when(key.isNull(), 0).otherwise(found)


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, fp) with next_text and next_fp of the next document.

    Each range's largest id stands first in it and goes to the range above, too, behind all of that; the largest of all to the lowest range.
    """
    bounds = _bounds(docs, RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if bounds:
        own = _range_of(F.col("doc_id"), bounds)
        first = F.col("doc_id") == F.get(F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>"), F.col("own"))
        above = F.when(first, F.when(F.col("own") == len(bounds) - 1, 0).otherwise(F.col("own") + 1))
    else:
        own, above = F.lit(0), F.lit(0)
    parts = F.array_compact(F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("copy")), F.when(above.isNotNull(), F.struct(above.alias("part"), F.lit(True).alias("copy")))))
    dealt = docs.select("doc_id", "text", "fp", own.alias("own")).select("doc_id", "text", "fp", F.inline(parts))
    order = Window.partitionBy("part").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("text"))
    found = dealt.withColumns({"next_text": F.lead("text").over(order), "next_fp": F.lead("fp").over(order)})
    return found.filter("not copy").select("doc_id", "text", "fp", "next_text", "next_fp")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with text (null: empty) and fp."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fp", fingerprint(F.col("text")))


def op11_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of each document and of its edited text, which ends as the next document begins."""
    found = with_next(fingerprinted(table(spark, sf_dir, "documents")))
    n = F.length("text")
    end = F.floor(n / 3).cast("int")
    edited = found.withColumn("edited", F.concat(F.left("text", n - end), F.left("next_text", end)))
    edited = edited.withColumn("edited_fp", fingerprint(F.col("edited")))
    return edited.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.size(changed_paragraphs(F.col("fp"), F.col("edited_fp"))).cast("long").alias("n_changed"),
    )


def _fingerprint_sql(text: str, out: str) -> list[str]:
    """Steps from a table of (row, {text}) to one of (row, fp)."""
    lines = f"string_split({text}, chr(10))"
    line = f"list_transform(case when ends_with({text}, chr(10)) then {lines}[:-2] else {lines} end, lambda x, i: case when i < len({lines}) then x || chr(10) else x end)"
    leaves = r"list_transform(string_split(regexp_replace(regexp_replace(p, '([.!?][ \t\r\n])', '\1' || chr(57344), 'g'), chr(57344) || '$', ''), chr(57344)), lambda s: sha256(s))"
    return [
        f"{out}_line as (select row, {text}, unnest({line}) as p, generate_subscripts({line}, 1) as line from {{source}})",
        f"{out}_leaf as (select row, line, {leaves} as l from {out}_line)",
        f"{out}_para as (select row, line, sha256(array_to_string(l, '')) as h, array_to_string(list_transform(l, lambda x: left(x, 8)), '') as short from {out}_leaf)",
        f"{out}_ends as (select *, coalesce(sum((left(h, 1) in ('0', '1'))::int) over (partition by row order by line rows between unbounded preceding and 1 preceding), 0) as sec from {out}_para)",
        f"{out}_sec as (select row, sec, sha256(string_agg(h, '' order by line)) as h, string_agg(short, ',' order by line) as shorts from {out}_ends group by row, sec)",
        f"{out} as (select row, sha256(string_agg(h, '' order by sec)) || ':' || string_agg(left(h, 16) || '=' || shorts, ';' order by sec) as fp from {out}_sec group by row)",
    ]


def _likeness_sql(a: str, b: str) -> str:
    sections = lambda x: f"string_split(substr({x}, 66), ';')"
    leaves = lambda x: f"regexp_extract_all(array_to_string(list_transform({x}, lambda s: substr(s, 18)), ''), '[0-9a-f]{{8}}')"
    minus = lambda x, y: f"list_filter({x}, lambda s: not list_contains({y}, s))"
    both = lambda x, y: f"list_filter(list_distinct({x}), lambda s: list_contains({y}, s))"
    sa, sb = sections(a), sections(b)
    alike, own, other = f"len({leaves(both(sa, sb))})", f"list_distinct({leaves(minus(sa, sb))})", f"list_distinct({leaves(minus(sb, sa))})"
    every = f"(2 * {alike} + len({own}) + len({other}))"
    return f"case when left({a}, 64) = left({b}, 64) then 1.0::double else least(2.0::double * ({alike} + len({both(own, other)})) / {every}, 1 - 1.0::double / ({every} + 1)) end"


OP11_SQL = f"""
with whole as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
{", ".join(_fingerprint_sql("text", "own")).replace("{source}", "whole")},
nexts as (select row, doc_id, text, fp, lead(row) over w as after, first_value(row) over w as top from whole join own using (row) window w as (order by doc_id desc nulls last, text desc, row rows between unbounded preceding and unbounded following)),
pair as (select a.row, a.doc_id, a.text, a.fp, b.fp as next_fp, left(a.text, length(a.text) - length(a.text) // 3) || left(b.text, length(a.text) // 3) as edited from nexts a join nexts b on b.row = coalesce(a.after, a.top)),
{", ".join(_fingerprint_sql("edited", "new")).replace("{source}", "pair")},
both_ as (select pair.*, new.fp as edited_fp from pair join new using (row)),
held as (select row, s.sec as sec, unnest(string_split(substr(s.v, 18), ',')) as p, not list_contains(string_split(substr(edited_fp, 66), ';'), s.v) as open,
    list_filter(string_split(substr(edited_fp, 66), ';'), lambda x: not list_contains(string_split(substr(fp, 66), ';'), x)) as theirs
  from (select row, fp, edited_fp, unnest(list_transform(string_split(substr(fp, 66), ';'), lambda v, sec: {{'v': v, 'sec': sec}})) as s from both_ where left(fp, 64) <> left(edited_fp, 64))),
changed as (select row, count(*) as n from held where open and not list_contains(flatten(list_transform(theirs, lambda x: string_split(substr(x, 18), ','))), p) group by row)
select doc_id, length(text)::bigint as n_chars, sha256(edited) as edited_sha256, fp as fingerprint, edited_fp as edited_fingerprint,
  {_likeness_sql("fp", "edited_fp")} as near_edited, {_likeness_sql("fp", "next_fp")} as near_next, coalesce(n, 0)::bigint as n_changed
from both_ left join changed using (row)
"""
