"""URL filters: pattern rules indexed by their rarest literal token (operator 6).

A rule is a regular expression over ``host/path`` with an action. Rules are indexed by
one literal token each: the token, among those every matching url must hold, that is
rarest in the url table itself. Urls are cut into tokens once; an equi-join of url tokens
with the index fetches candidate rules, and only those run their regular expression.
A page takes the longest rule that fits.

Two kinds of rules share the index. Path rules (host and path prefix; they fit the host
and its subdomains) carry their own text; method rules are patterns for tracking links
and the like, tried only where no path rule fits; they alone see the query. Where none fits, a url with a host is
allowed and one without is blocked.

Scale: tokens are counted with map-side aggregation, a url meets only rules whose rarest
token it holds, and the index is broadcast only while it has at most ``BROADCAST_RULES``
rules; a longer list is joined by token with the hot tokens split by adaptive execution.

Edge cases: null urls and urls without ``://`` have empty host and path; repeated rows are
judged row by row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 10_000
# The path rules of the contract (action, host, path).
PATH_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
              ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# name, action, required literal tokens, pattern over host, path and query as one lower-case text.
METHOD_RULES = (
    ("tracking", "block", ("utm_source",), r"[?&]utm_source="),
    ("referral", "block", ("ref",), r"[?&]ref=[a-z0-9]+"),
    ("ad-host", "block", ("ads",), r"^(?:[^/]*\.)?ads\.[^/]+/"),
    ("login", "block", ("login",), r"/login(?:[/.?]|$)"),
)
_TOKEN = "[^a-z0-9_]+"


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.expr("substr(url, instr(url, '://') + 3)")), F.lit(""))


def path_of(url: Column) -> Column:
    tail = F.regexp_replace(_rest(url), r"^[^/?#]*", "")
    return F.regexp_replace(tail, r"(?s)[?#].*$", "")


def rule_table(spark: SparkSession, path_rules=PATH_RULES, method_rules=METHOD_RULES) -> DataFrame:
    """One row per rule: text, action, rank, pattern, and its possible index tokens."""
    rows = []
    for action, host, path in path_rules:
        pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
        rows.append((host + path, action, True, len(host + path), pattern, _literal_tokens(host, path)))
    for name, action, need, pattern in method_rules:
        rows.append((name, action, False, len(pattern), pattern, list(need)))
    return spark.createDataFrame(
        rows, "rule string, action string, by_path boolean, rank int, pattern string, tokens array<string>")


def _literal_tokens(host: str, path: str) -> list[str]:
    """Tokens that every fitting url holds whole: the last one of a path may go on."""
    whole = [t for t in re.split(_TOKEN, host.lower()) if t]
    parts = [t for t in re.split(_TOKEN, path.lower()) if t]
    return whole + (parts if re.search(r"[^a-z0-9_]$", path) else parts[:-1])


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(target), _TOKEN), lambda t: t != ""))


def rule_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each rule under its rarest literal token, by the number of urls that hold it."""
    wanted = rules.select("rule", F.explode("tokens").alias("token"))
    n = (tokens.join(F.broadcast(wanted.select("token").distinct()), "token", "left_semi")
         .groupBy("token").agg(F.count("*").alias("n")))
    best = (wanted.join(n, "token", "left").groupBy("rule")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")))
    return rules.drop("tokens").join(best, "rule")


def judge(pages: DataFrame, path_rules=PATH_RULES, method_rules=METHOD_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern_rule`` for every row of ``pages``."""
    rules = rule_table(pages.sparkSession, path_rules, method_rules)
    urls = pages.select("page_id", "url").withColumn("_rest", _rest(F.col("url")))
    query = F.regexp_extract("_rest", r"(?s)(\?[^#]*)", 1)
    urls = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), query.alias("query"))
    urls = urls.withColumn("target", F.concat("host", "path", "query"))
    # Equal targets are judged once, so a hot url costs one row per map task.
    tokens = (urls.select("target").distinct()
              .select("target", F.explode(url_tokens(F.col("target"))).alias("token")))
    index = rule_index(rules, tokens.select("token"))
    if len(path_rules) + len(method_rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    # Host and path hold no question mark, so path rules end before the first one.
    fits = F.expr("(case when by_path then substring_index(target, '?', 1) else lower(target) end) rlike pattern")
    best = (tokens.join(index, "token").where(fits)
            .groupBy("target").agg(F.max(F.struct("by_path", "rank", "rule", "action")).alias("best")))
    verdict = F.coalesce(F.col("best.action"), F.when(F.col("host") == "", "block").otherwise("allow"))
    return urls.join(best, "target", "left").select(
        "page_id", "host", "path", F.when(F.col("best.by_path"), F.col("best.rule")).alias("rule"),
        verdict.alias("verdict"), F.when(~F.col("best.by_path"), F.col("best.rule")).alias("pattern_rule"))


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    from fleetgrade.llm.common import table

    return judge(table(spark, sf_dir, "pages"))


ORACLE = r"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_replace(regexp_replace(rest, '^[^/?#]*', ''), '[?#](.|\n)*$', '') as path,
             lower(regexp_extract(rest, '\?[^#]*')) as query from u),
r(rule, rhost, rpath, action) as (values ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
f as (select h.page_id, max_by(r.rule, length(r.rule)) as rule, max_by(r.action, length(r.rule)) as action
      from h join r on (h.host = r.rhost or ends_with(h.host, '.' || r.rhost)) and starts_with(h.path, r.rpath) group by h.page_id),
m as (select h.*, f.rule, f.action, case
        when f.rule is not null then null
        when regexp_matches(lower(host || path) || query, '[?&]utm_source=') then 'tracking'
        when regexp_matches(lower(host || path) || query, '/login(?:[/.?]|$)') then 'login'
        when regexp_matches(lower(host || path) || query, '[?&]ref=[a-z0-9]+') then 'referral'
        when regexp_matches(lower(host || path) || query, '^(?:[^/]*\.)?ads\.[^/]+/') then 'ad-host' end as pattern_rule
      from h left join f using (page_id))
select page_id, host, path, rule, coalesce(action, case when pattern_rule is not null or host = '' then 'block' else 'allow' end) as verdict,
       pattern_rule
from m"""
