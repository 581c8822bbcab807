"""URL filters: rules indexed by their rarest literal token; a URL's tokens fetch the rules whose expressions run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinewatch.llm.common import lower_ascii

#: The rules of the query, as (verdict, pattern).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: The token of rules without a literal; no token of a URL holds a slash.
ANY = "/"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _literals(pattern: str) -> list[str]:
    """Whole tokens that a fitting URL must hold; a path's last piece may go on in the URL, so it counts only before a slash."""
    host, _, path = pattern.partition("/")
    return sorted({t for t in [*host.split("."), *path.split("/")[:-1]] if t})


def _expression(pattern: str) -> str:
    """The pattern on host and path: without a host any host fits."""
    host, _, path = pattern.partition("/")
    return rf"(?s)^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}" if host else rf"(?s)^[^/]*/{re.escape(path)}"


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of pages.

    A rule `host/path` fits its host and subdomains where the URL's path starts with the rule's; the longest rule wins
    (ties: block first, then the smaller pattern); without a rule, `default`. Null URL or none with ://: empty host and
    path, no rule. A rule without a whole literal token meets every URL. Repeated rows are judged alike; columns named as the added ones are replaced; an empty table or rule
    list is fine. The rule list is code, not data: it must fit the driver.
    """
    spark = pages.sparkSession
    work = pages.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))}).drop("rule", "verdict")
    sites = work.select("host", "path").filter(F.col("host") != "").distinct()
    tokens = sites.withColumn("token", F.explode(F.array_distinct(F.concat(F.split("host", r"\."), F.split("path", "/"))))).filter(F.col("token") != "")
    literal = [(r, t) for _, r in rules for t in _literals(r)]
    if not rules:
        return work.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    often: dict[str, int] = {}
    if literal:
        wanted = spark.createDataFrame(sorted({(t,) for _, t in literal}), "token string")
        often = {r[0]: r[1] for r in tokens.join(F.broadcast(wanted), "token").groupBy("token").count().collect()}  # a row for each literal of the rules
    index = []
    for verdict, rule in rules:
        own = [t for r, t in literal if r == rule]
        index.append((min(own, key=lambda t: (often.get(t, 0), t)) if own else ANY, rule, verdict, _expression(rule)))
    if any(token == ANY for token, *_ in index):  # some rules hold no whole token: each URL fetches them by a token of its own
        tokens = tokens.unionByName(sites.withColumn("token", F.lit(ANY)))
    by_token = spark.createDataFrame(index, "token string, rule string, verdict string, expression string")
    fits = tokens.join(by_token, "token").filter(F.regexp_like(F.concat("host", "path"), F.col("expression")))
    rank = F.struct(F.char_length("rule").alias("long"), (F.col("verdict") == "block").alias("block"), F.col("rule"), F.col("verdict"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    judged = work.join(best, ["host", "path"], "left")
    return judged.select(*[F.col(f"`{c}`") for c in work.columns], F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


SQL = r"""
with u as (
  select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path
  from pages),
r(rule, verdict, h, p) as (values ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
  ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/'))
select u.page_id, u.host, u.path,
       (select rule from r where (u.host = h or ends_with(u.host, '.' || h)) and starts_with(u.path, p) order by length(rule) desc limit 1) as rule,
       coalesce((select verdict from r where (u.host = h or ends_with(u.host, '.' || h)) and starts_with(u.path, p) order by length(rule) desc limit 1), 'allow') as verdict
from u
"""
