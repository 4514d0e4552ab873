"""URL block lists with redirect equivalence, in DataFrame operations only.

Rules are (verdict, host, path): a rule fits its host and all subdomains where the
url's path starts with the rule's, and the longest wins. Redirect (meta refresh)
and canonical-link edges join urls into components. A url that no rule of its own
fits takes its component's decision: allow if a member is explicitly allowed, else
block if a member is blocked, else allow.

All canonical links and refreshes of a page count. Targets that are relative are
resolved against the page's url, or its base element where there is one.

Defined results: a url that is null or has no ``://`` has empty host and path and no
rule, and relative targets on it lead nowhere; empty targets, fragments alone and
schemes without ``//`` lead nowhere; repeated rows stay; null html has no edges; an empty
table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import stored, table
from granary.llm.components import components

#: (verdict, rule); the rule is the host, a slash and the rest of the path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""
_BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits; at equal length an allow, then the smaller text, comes first."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow", r[1])):
        domain, _, rest = rule.partition("/")
        fits = F.concat(F.lit("."), host).endswith("." + domain) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _without_dots(path: Column) -> Column:
    """An absolute path without . and .. segments."""
    path = F.when(path.rlike(r"/\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path)

    def step(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.regexp_replace(done, "/[^/]*$", "")).when(part == ".", done).otherwise(F.concat(done, F.lit("/"), part))

    return F.aggregate(F.slice(F.split(path, "/"), 2, F.length(path)), F.lit(""), step)


def resolved(base: Column, target: Column) -> Column:
    """The url that target, as a page at base has it, stands for; null where it leads nowhere."""
    origin = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    path = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^.*/", 0), F.lit("")), F.lit("/"))
    own = F.regexp_extract(target, r"^[^?#]*", 0)
    rest = F.substring(target, F.length(own) + 1, F.length(target))
    full = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    return (
        F.when(target.rlike(_SCHEME + "//"), target)
        .when(target.rlike(_SCHEME) | (target == "") | target.startswith("#") | (origin == ""), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), target))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .otherwise(F.concat(origin, _without_dots(full), rest))
    )


def _decoded(target: Column) -> Column:
    return F.regexp_replace(target, "(?i)&(amp|#38|#x26);", "&")


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's url and each url that its canonical links and refreshes name."""
    low = F.lower("html")
    targets = F.concat(F.regexp_extract_all("html", F.lit(_CANONICAL), 1), F.regexp_extract_all("html", F.lit(_REFRESH), 1))
    base = F.coalesce(resolved(F.col("url"), _decoded(F.regexp_extract("html", _BASE, 1))), F.col("url"))
    return (
        pages.filter(F.col("url").isNotNull() & (low.contains("canonical") | low.contains("http-equiv")))
        .select(F.col("url").alias("a"), base.alias("base"), F.explode(targets).alias("target"))
        .select("a", resolved(F.col("base"), _decoded(F.col("target"))).alias("b"))
        .filter("b is not null")
        .distinct()
    )


def judge(pages: DataFrame, edges: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict of each row of pages, by rules and the aliases in edges (a, b)."""
    verdicts = dict((rule, verdict) for verdict, rule in rules)
    verdict_of = F.create_map(*[F.lit(x) for pair in verdicts.items() for x in pair])
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    groups = components(edges)
    # Members of components only: as many rows as edges have ends, whatever the pages are.
    members = groups.withColumn("rule", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules))
    members = members.withColumn("own", verdict_of[F.col("rule")])
    decided = members.groupBy("component").agg(F.min("own").alias("passed_on"))  # allow sorts before block
    passed = members.join(decided, "component").filter("rule is null and passed_on = 'block'").select(F.col("node").alias("url"), F.lit("block").alias("passed_on"))
    judged = own.join(passed.distinct(), "url", "left")
    verdict = F.coalesce(verdict_of[F.col("rule")], F.col("passed_on"), F.lit("allow"))
    return judged.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages, stored(alias_edges(pages), "aliases"))


_RULE_SQL = "\n".join(
    f"      when ends_with('.' || host, '.{rule.partition('/')[0]}') and starts_with(path, '/{rule.partition('/')[2]}') then '{rule}'"
    for _, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))
)


def _without_dots_sql(path: str) -> str:
    parts = f"string_split(case when regexp_matches({path}, '/\\.\\.?$') then {path} || '/' else {path} end, '/')[2:]"
    return f"list_reduce(list_prepend('', {parts}), lambda done, part: case part when '..' then regexp_replace(done, '/[^/]*$', '') when '.' then done else done || '/' || part end)"


def _resolved_sql(base: str, target: str) -> str:
    origin = f"regexp_extract({base}, '^.*?://[^/?#]*', 0, 's')"
    path = f"regexp_extract({base}, '^.*?://[^/?#]*([^?#]*)', 1, 's')"
    own = f"regexp_extract({target}, '^[^?#]*', 0)"
    full = f"(case when starts_with({own}, '/') then {own} else coalesce(nullif(regexp_extract({path}, '^.*/', 0, 's'), ''), '/') || {own} end)"
    return f"""case when regexp_matches({target}, '{_SCHEME}//') then {target}
      when regexp_matches({target}, '{_SCHEME}') or {target} = '' or starts_with({target}, '#') or {origin} = '' then null
      when starts_with({target}, '//') then split_part({base}, '://', 1) || ':' || {target}
      when starts_with({target}, '?') then {origin} || {path} || {target}
      else {origin} || {_without_dots_sql(full)} || substr({target}, length({own}) + 1) end"""


OP7_SQL = rf"""
with recursive marked as (
  select url as a, html, regexp_replace(regexp_extract(html, '<base\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is'), '&(amp|#38|#x26);', '&', 'gi') as of_base
  from pages where url is not null and (lower(html) like '%canonical%' or lower(html) like '%http-equiv%')),
link as (
  select a, coalesce({_resolved_sql("a", "of_base")}, a) as base, unnest(
      regexp_extract_all(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is') ||
      regexp_extract_all(html, '<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1, 'is') ||
      regexp_extract_all(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*["'']?([^"''\s>]+)', 1, 'is') ||
      regexp_extract_all(html, '<meta\b[^>]*\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*["'']?([^"''\s>]+)[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b', 1, 'is')) as found
  from marked),
target as (select a, base, regexp_replace(found, '&(amp|#38|#x26);', '&', 'gi') as named from link),
edge as (select a, b from (select a, {_resolved_sql("base", "named")} as b from target) where b is not null),
both_ways as (select a, b from edge union select b, a from edge),
reach as (select a, a as r from both_ways union select e.b, reach.r from reach join both_ways e on e.a = reach.a),
node as (select page_id, url, url as u from pages union all select distinct null::bigint, null, a from both_ways),
part as (
  select page_id, url, u, case when contains(u, '://') then substr(u, instr(u, '://') + 3) else '' end as rest from node),
split_url as (
  select page_id, url, u, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') as host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from part),
ruled as (select *, case
{_RULE_SQL}
      end as rule from split_url),
own as (select *, case {" ".join(f"when rule = '{rule}' then '{verdict}'" for verdict, rule in RULES)} end as own from ruled),
passed as (
  select reach.a as u, min(own.own) as passed_on
  from reach join own on own.u = reach.r and own.page_id is null group by reach.a)
select page_id, host, path, rule, coalesce(own, passed_on, 'allow') as verdict, own.url
from own left join passed on passed.u = own.u
where page_id is not null
"""
