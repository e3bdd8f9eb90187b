"""Operator 10: URL filters by pattern rules indexed by their rarest literal token.

A rule is a regular expression over host and path with the literal tokens that
any match must hold whole. The index has each rule once, under that of its
tokens which the URLs hold least often; a URL's tokens fetch the candidate
rules, and only their expressions run. Rules without a token are candidates
everywhere. All of it is SQL expressions: up to MAX_RULES rules the index is a
literal map, and no row is shuffled; more rules are a table, joined by token.

Site rules (host and path prefix, allow or block, the longest wins) decide
first; where none fits, a URL that a pattern of BLOCK_PATTERNS fits is blocked
and any other is allowed.

Rows: a null URL or one without "://" has an empty host and path and is
allowed; repeated rows are judged each on their own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rules that a plan may hold as literals.
MAX_RULES = 2000

#: The site rules, (verdict, host, path prefix).
SITE_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Patterns over host and path that mark pages of no use for training: (expression, literal tokens).
BLOCK_PATTERNS = (
    (r"(^|[./-])(ads?|adserver|doubleclick)[0-9]*\.", ()),
    (r"/(wp-)?login(\.[a-z]+)?$", ()),
    (r"(^|[./-])casino([./-]|$)", ("casino",)),
    (r"(^|[./-])porn([./-]|$)", ("porn",)),
    (r"/cart/checkout([/.]|$)", ("cart", "checkout")),
    (r"/cgi-bin/", ("cgi", "bin")),
)


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool


def whole_tokens(host: str, path: str) -> tuple[str, ...]:
    """Tokens of a site rule that stand whole in any URL that it fits: not one that the prefix may cut."""
    tokens = re.findall("[a-z0-9]+", host)
    inner = re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    return tuple(tokens + inner)


def site_rule(verdict: str, host: str, path: str) -> Rule:
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}".replace("\\/", "/").replace("\\-", "-"), whole_tokens(host, path), True)


def rules_of(sites=SITE_RULES, patterns=BLOCK_PATTERNS) -> list[Rule]:
    return [site_rule(*x) for x in sites] + [Rule(p, "block", p, tuple(t), False) for p, t in patterns]


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    url = F.coalesce("url", F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select("page_id", host.alias("host"), F.regexp_extract(url, pattern, 2).alias("path"))


def tokens_of(place: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(place, F.lit("[A-Za-z0-9]+"), F.lit(0)))


def token_counts(parts: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens; as many rows as the rules have tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    held = F.explode(F.array_intersect(tokens_of(F.concat("host", "path")), F.array(*map(F.lit, wanted))))
    return {r["token"]: r["n"] for r in parts.select(held.alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def index_of(rules: list[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Numbers of the rules by rarest token, and of those without."""
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        if r.tokens:
            by.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
    return by, [i for i, r in enumerate(rules) if not r.tokens]


def chosen(parts: DataFrame, longest: Column, patterns: Column) -> DataFrame:
    """longest: (n, name, verdict) of the site rule that decides, or null; patterns: names of the block patterns that fit."""
    named = parts.withColumn("longest", longest).withColumn("patterns", patterns)
    verdict = F.when(F.col("longest").isNotNull(), F.col("longest.verdict")).when(F.size("patterns") > 0, "block").otherwise("allow")
    return named.select("page_id", "host", "path", F.col("longest.name").alias("rule"), verdict.alias("verdict"), "patterns")


def judge(pages: DataFrame, rules: list[Rule] | None = None, most: int = MAX_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, patterns (names of the block patterns that fit).

    Up to `most` rules are a literal index in the plan; more are a table that is joined by token.
    """
    rules = rules_of() if rules is None else rules
    parts = with_parts(pages)
    none = F.array().cast("array<string>")
    if not rules:
        return chosen(parts, F.lit(None).cast("struct<n:int,name:string,verdict:string>"), none)
    if len(rules) > most:
        return judge_by_table(parts, rules)
    by, rest = index_of(rules, token_counts(parts, rules))
    numbers = lambda xs: F.array(*map(F.lit, xs)).cast("array<int>")
    fetched = numbers(rest)
    if by:
        index = F.create_map(*[c for t, xs in sorted(by.items()) for c in (F.lit(t), numbers(xs))])
        fetched = F.concat(F.flatten(F.transform(F.array_intersect(F.col("tokens"), F.map_keys(index)), lambda t: F.element_at(index, t))), numbers(rest))

    def fit(x: Column) -> Column:
        out = F.when(x.isNull(), False)
        for i, r in enumerate(rules):
            out = out.when(x == i, F.col("place").rlike(r.pattern))
        return out.otherwise(False)

    names, verdicts = F.array(*[F.lit(r.name) for r in rules]), F.array(*[F.lit(r.verdict) for r in rules])
    site = numbers([i for i, r in enumerate(rules) if r.site])
    hits = parts.withColumn("place", F.concat("host", "path")).withColumn("tokens", tokens_of(F.col("place"))).withColumn("hits", F.filter(fetched, fit))
    of_site = F.filter("hits", lambda x: F.array_contains(site, x))
    longest = F.array_max(F.transform(of_site, lambda x: F.struct(F.length(F.get(names, x)).alias("n"), F.get(names, x).alias("name"), F.get(verdicts, x).alias("verdict"))))
    return chosen(hits, longest, F.transform(F.filter("hits", lambda x: ~F.array_contains(site, x)), lambda x: F.get(names, x)))


def judge_by_table(parts: DataFrame, rules: list[Rule]) -> DataFrame:
    """As judge(), for any number of rules: distinct places meet the rules by token, and only those run expressions."""
    spark = parts.sparkSession
    every = spark.createDataFrame([(i, r.name, r.verdict, r.pattern, r.site, list(r.tokens)) for i, r in enumerate(rules)], "number int, name string, verdict string, pattern string, site boolean, tokens array<string>")
    places = parts.select("host", "path").distinct()
    held = places.select("host", "path", F.explode(tokens_of(F.concat("host", "path"))).alias("token"))
    wanted = every.select("number", F.explode("tokens").alias("token"))
    counts = held.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(counts, "token", "left").groupBy("number").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    index = every.drop("tokens").join(rarest.select("number", F.col("least.token").alias("token")), "number", "left")
    bare = sum(not r.tokens for r in rules)
    met = held.join(index.where("token is not null"), "token").drop("token")
    if bare:
        # rules without a token are candidates everywhere, each place with all of them
        free = index.where("token is null").agg(F.collect_list(F.struct("number", "name", "verdict", "pattern", "site")).alias("all")).first()["all"]
        loose = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("number", "name", "verdict", "pattern", "site")]) for r in sorted(free)])
        met = met.unionByName(places.withColumn("x", F.explode(loose)).select("host", "path", "x.*"))
    hits = met.where(F.rlike(F.concat("host", "path"), F.col("pattern")))
    longest = F.max(F.when(F.col("site"), F.struct(F.length("name").alias("n"), "name", "verdict")))
    patterns = F.array_sort(F.collect_set(F.when(~F.col("site"), F.struct("number", "name"))))
    best = hits.groupBy(F.col("host").alias("h_"), F.col("path").alias("p_")).agg(longest.alias("l_"), F.transform(patterns, lambda x: x["name"]).alias("fit_"))
    both = parts.join(best, (F.col("host") == F.col("h_")) & (F.col("path") == F.col("p_")), "left")
    return chosen(both, F.col("l_"), F.coalesce("fit_", F.array().cast("array<string>")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages")).drop("patterns")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(rule, verdict, pattern) AS (VALUES ('org/', 'allow', '^(?:[^/]*\.)?org/'), ('example.org/es/', 'block', '^(?:[^/]*\.)?example\.org/es/'), ('example.org/en/1', 'block', '^(?:[^/]*\.)?example\.org/en/1'), ('com/fr/', 'allow', '^(?:[^/]*\.)?com/fr/'), ('com/de/', 'block', '^(?:[^/]*\.)?com/de/')),
m AS (SELECT p.page_id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
      FROM p JOIN r ON regexp_matches(p.host || p.path, r.pattern) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, m.rule,
       CASE WHEN m.rule IS NOT NULL THEN m.verdict WHEN regexp_matches(host || path, '(^|[./-])(ads?|adserver|doubleclick)[0-9]*\.') OR regexp_matches(host || path, '/(wp-)?login(\.[a-z]+)?$') OR regexp_matches(host || path, '(^|[./-])casino([./-]|$)') OR regexp_matches(host || path, '(^|[./-])porn([./-]|$)') OR regexp_matches(host || path, '/cart/checkout([/.]|$)') OR regexp_matches(host || path, '/cgi-bin/') THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN m USING (page_id)
"""
