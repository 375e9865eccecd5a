"""URL filters by hashed expressions.

Each URL's host and path expand into expressions, one for each host suffix of whole labels and each
path prefix; a rule is such an expression.  Expressions meet rules in an equi-join on the first 32
bits of their SHA-256, and the full digests confirm.  Of the rules that fit, the longest decides
(ties: the longer host); without a rule the verdict is ``DEFAULT``.

Only suffixes of as many labels and prefixes of as many characters as some rule has are expanded, so
a URL gives at most labels x lengths rows, however long it is.  Equal (host, path) pairs are judged
once, so a host that a third of all pages share costs one row for each of its paths.

Null URLs and URLs without ``://`` have an empty host and path, which no rule fits; they are dealt by
their page ids, so they don't meet in one task.  Very long URLs are judged whole.  Repeated rows are
rows of the result each; a null page_id stays.  Extra columns are ignored, whatever their names, and an
empty table gives no rows.  Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

# Verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule lists up to this many entries are broadcast; longer ones are shuffled.
BROADCAST_RULES = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path).cast("binary"), 256)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url)."""
    spark = pages.sparkSession
    table = spark.createDataFrame([(v, h, p) for v, h, p in dict.fromkeys(rules)], "rule_verdict string, rule_host string, rule_path string")
    table = table.withColumns({"rule_digest": digest(F.col("rule_host"), F.col("rule_path")), "rule": F.concat("rule_host", "rule_path")}).withColumn("prefix", F.substring("rule_digest", 1, 8))
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    host, path = host_and_path(F.coalesce(F.col("url").cast("string"), F.lit("")))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = named.where("host <> '' or path <> ''").select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.array_compact(F.array(*(F.when(F.size(parts) >= n, F.substring_index("host", ".", -n)) for n in labels)))
    prefixes = F.array_compact(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)))
    expressions = known.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("host", "path", "suffix", F.explode("prefixes").alias("start"))
    expressions = expressions.withColumn("digest", digest(F.col("suffix"), F.col("start"))).withColumn("prefix", F.substring("digest", 1, 8))
    table = F.broadcast(table) if len(rules) <= BROADCAST_RULES else table
    fits = expressions.join(table, "prefix").where(F.col("digest") == F.col("rule_digest"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule", "rule_verdict")).alias("best"))
    # a rule's path isn't empty, so no key made of a page id meets one
    bare = (F.col("host") == "") & (F.col("path") == "")
    named = named.withColumn("key", F.when(bare, F.xxhash64("page_id").cast("string")).otherwise(F.col("host")))
    best = best.withColumnRenamed("host", "key")
    return named.join(best, ["key", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(tables.read(spark, sf_dir, "pages").select("page_id", "url"))


ORACLE = f"""
WITH rules(rule_verdict, rule_host, rule_path) AS (VALUES {", ".join(str(r) for r in RULES)}),
parts AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM (SELECT DISTINCT host, path FROM named) k
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, n.host, n.path, rule, coalesce(rule_verdict, '{DEFAULT}') AS verdict
FROM named n LEFT JOIN best b ON n.host = b.host AND n.path = b.path
"""
