"""URL filters: allow and block rules, then a list of URLs (operator 8).

Rules by host and path decide first, the longest that fits.  Other URLs are
looked up in a list of canonical URLs: a blocked Bloom filter passes those that
may be listed, and only these go to a hash join with the list, which removes
the false positives.  The list is a table or file (:func:`url_list`); the driver
tables bring none, so the query lists the sites that the rules block in good part
(:func:`site_list`).

Defined cases: a null URL, or one without ``://``, has an empty host and path,
fits no rule, is on no list and is allowed; repeated rows get equal verdicts;
a very long URL is judged whole; of rules of equal length that fit (host and
path always differ then) the first by name counts; an empty list blocks nothing; an empty table gives an empty result; other
columns stay (names used inside start with ``_u_``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.llm import bloom
from hydrolake.llm.common import BROADCAST_ROWS, LOWER, UPPER, join_small, stored, table

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: a site is listed from this share of pages that the rules block
SITE_SHARE = 0.25


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def canonical(host: Column, path: Column) -> Column:
    """What the list compares: host and path without a slash at the end; null for no host."""
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", "")))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict``; ``listed``: a column ``url`` of canonical URLs.

    The list is joined by shuffle with the few rows that may be on it, so
    neither side's size is bounded; a URL that very many rows repeat is dealt
    over salts.  Only a list counted small is broadcast: Spark's estimate does
    not see that the list is repeated under the salts.
    """
    spark = pages.sparkSession
    listed = stored(listed.select(F.col("url").alias("_u_listed")).filter("_u_listed is not null").distinct(), "listed")
    bits = spark.sparkContext.broadcast(bloom.build(listed.select(F.xxhash64("_u_listed").alias("h")), "h"))

    @F.pandas_udf("boolean")
    def may_be_listed(h: pd.Series) -> pd.Series:
        return pd.Series(bloom.test(bits.value, h.to_numpy()))

    host, path = host_path(F.col(url_col))
    df = pages.withColumn("host", host).withColumn("path", path)
    df = df.withColumn("_u_rule", longest_rule(F.col("host"), F.col("path"), rules))
    df = df.withColumn("_u_key", F.when(F.col("_u_rule").isNull(), canonical(F.col("host"), F.col("path"))))
    df = stored(df.withColumn("_u_may", F.col("_u_key").isNotNull() & may_be_listed(F.coalesce(F.xxhash64("_u_key"), F.lit(0)))), "judged")
    hits = df.filter("_u_may")
    if listed.count() <= BROADCAST_ROWS:
        hits = hits.join(F.broadcast(listed), F.col("_u_key") == F.col("_u_listed"), "left")
    else:
        salts = 16
        dealt = listed.withColumn("_u_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
        hits = hits.withColumn("_u_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        hits = hits.join(dealt, (F.col("_u_key") == F.col("_u_listed")) & (hits["_u_salt"] == dealt["_u_salt"]), "left").drop("_u_salt")
    rest = df.filter("not _u_may").withColumn("_u_listed", F.lit(None).cast("string"))
    out = hits.unionByName(rest)
    verdict = F.when(F.col("_u_rule").isNotNull(), F.col("_u_rule.verdict")).when(
        F.col("_u_listed").isNotNull(), "block").otherwise("allow")
    return out.withColumn("rule", F.col("_u_rule.rule")).withColumn("verdict", verdict).drop(
        "_u_rule", "_u_key", "_u_may", "_u_listed")


def url_list(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """A table, or a text file read line by line, of URLs as a list for :func:`judge`.

    Entries may leave out the scheme; blanks around them, empty ones and ones that start with ``#`` are passed over.
    """
    entry = F.trim(F.col(url_col))
    host, path = host_path(F.when(F.contains(entry, F.lit("://")), entry).otherwise(F.concat(F.lit("://"), entry)))
    rows = urls.filter((entry != "") & ~entry.startswith("#")).select(canonical(host, path).alias("url"))
    return rows.filter("url is not null").distinct()


def site_list(pages: DataFrame, url_col: str = "url", share: float = SITE_SHARE, rules=RULES) -> DataFrame:
    """Canonical URLs of the sites (hosts) of whose pages the rules block at least ``share``."""
    host, path = host_path(F.col(url_col))
    df = pages.select(host.alias("host"), path.alias("path")).filter("host <> ''")
    # hosts and URLs are folded before the shuffle, however often they repeat
    blocked = F.coalesce(longest_rule(F.col("host"), F.col("path"), rules)["verdict"] == "block", F.lit(False)).cast("int")
    sites = df.groupBy("host").agg(F.avg(blocked).alias("blocked")).filter(F.col("blocked") >= share)
    sites = stored(sites.select("host"), "sites")
    known = df.select("host", canonical(F.col("host"), F.col("path")).alias("url")).distinct()
    n = sites.count()
    # a list counted large is not broadcast: Spark's estimate does not see that it is repeated under salts
    return join_small(known, sites if n <= BROADCAST_ROWS else sites.hint("merge"), ["host"], n, F.xxhash64("url")).select("url").distinct()


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, site_list(pages)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH a AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (
  SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') END AS key,
         CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM b),
s AS (SELECT host FROM c WHERE host <> '' GROUP BY host
      HAVING 4 * count(*) FILTER (WHERE rule IN ('example.com/en/', 'net/es/', 'net/fr/')) >= count(*)),
l AS (SELECT DISTINCT key AS listed FROM c SEMI JOIN s ON c.host = s.host)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM c LEFT JOIN l ON c.key = l.listed
"""
