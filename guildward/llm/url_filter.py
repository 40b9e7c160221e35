"""URL filters: host and path rules, then a listed-URL test by a blocked Bloom filter and an exact join.

JVM-side only. The Bloom filter is a table of 256-bit blocks: eight lanes of 32
bits, one bit a lane for each listed URL. A url picks its block by one hash and
its bits by another, so a probe is one equi-join with the block table; what the
filter passes goes to an exact equi-join with the list.

Defined cases: a null url or one without ``://`` has an empty host and path, no
rule, and is allowed; equal rows give equal rows; an empty list blocks nothing;
a very long url is a key like any other; an empty table gives no rows; of rules
that fit equally long the one later in order of text wins;
other columns of the input pass through ``judge`` unless they are called like
its results, which replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guildward.llm import bloom

#: (verdict, host, path) rules; a host covers its subdomains, a path what starts with it, the longest rule wins.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Families of hosts whose pages the default list holds: the label before the registered domain.
LISTED_FAMILIES = ("spam-farm", "cheap-pills")
#: Bytes of listed URLs that may be broadcast; beyond it the possible hits are shuffled to the list.
BROADCAST_BYTES = 16 << 20
RESULTS = ["host", "path", "rule", "verdict", "listed"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def canonical(host: Column, path: Column) -> Column:
    """Host without www. or m., path without .html and trailing slashes."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html)?/*$", ""))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls where none does. The rules are a parameter, so few."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def listed_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """Default list (canonical): the URLs of all pages of LISTED_FAMILIES, found by a pass over the whole table."""
    host, path = host_and_path(F.col(url))
    found = pages.select(host.alias("host"), canonical(host, path).alias("canonical"))
    return found.where(F.col("host").rlike(rf"(^|\.)({'|'.join(LISTED_FAMILIES)})\.")).select("canonical").distinct()


def on_list(urls: DataFrame, listed: DataFrame, url: str = "canonical") -> DataFrame:
    """urls with boolean ``listed``: the filter passes possible hits, an equi-join on the text decides them."""
    names = urls.columns
    rows = urls.toDF(*[f"c{i}" for i in range(len(names))])
    key = F.col(f"c{names.index(url)}")
    listed = listed.where("canonical is not null").select("canonical").distinct()
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("canonical")), F.lit(0))).first()
    blocks = bloom.blocks_for(n)
    table = bloom.table(listed, "canonical", blocks)
    table = F.broadcast(table) if blocks <= bloom.BROADCAST_BLOCKS else table
    own = [f"c{i}" for i in range(len(names))]
    probe = rows.withColumn("block", bloom.block(key, blocks)).join(table, "block", "left").select(*own, bloom.passed(key).alias("maybe"))
    exact = listed.select(F.col("canonical").alias("exact"))
    if size <= BROADCAST_BYTES:
        out = probe.join(F.broadcast(exact), F.when(F.col("maybe"), key) == F.col("exact"), "left").withColumn("hit", F.col("exact").isNotNull())
    else:  # only the possible hits are shuffled
        hits = probe.where("maybe").join(exact, key == F.col("exact"), "left").withColumn("hit", F.col("exact").isNotNull())
        out = hits.drop("exact").unionByName(probe.where("not maybe").withColumn("hit", F.lit(False)))
    return out.select(*[F.col(c).alias(name) for c, name in zip(own, names, strict=True) if name.lower() != "listed"], F.col("hit").alias("listed"))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """pages with RESULTS; a rule decides first, then the list."""
    names = pages.columns
    df = pages.toDF(*[f"c{i}" for i in range(len(names))])
    host, path = host_and_path(F.col(f"c{names.index(url)}"))
    df = df.withColumns({"host": host, "path": path})
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "verdict": verdict, "canonical": canonical(F.col("host"), F.col("path"))})
    df = on_list(df, listed).withColumn("verdict", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")))
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c.lower() not in RESULTS], *RESULTS)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


OP2_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), r AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), h AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM r
), rules(kind, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit AS (
  SELECT page_id, max_by(rules.h || rules.p, length(rules.h || rules.p)) AS rule,
         max_by(kind, length(rules.h || rules.p)) AS kind
  FROM h JOIN rules ON (h.host = rules.h OR ends_with(h.host, '.' || rules.h)) AND starts_with(h.path, rules.p)
  GROUP BY page_id
), c AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html)?/*$', '') AS canonical FROM h
), listed AS (
  SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)\.')
)
SELECT c.page_id, c.host, c.path, fit.rule, coalesce(fit.kind, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       l.canonical IS NOT NULL AS listed
FROM c LEFT JOIN fit USING (page_id) LEFT JOIN listed l ON c.canonical = l.canonical
"""
