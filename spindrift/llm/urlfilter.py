"""URL filters: host-suffix and path-prefix expressions joined with rules on short hash prefixes.

Every distinct (host, path) is expanded into the expressions that a rule could be written as: each
suffix of the host with as many labels as some rule's host, with each prefix of the path whose length some
rule's path has.
Expressions meet rules by the first bytes of their SHA-256; a hit counts only if the whole digest
agrees too. Of the rules that fit, the longest wins. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import table

#: The rules of the registered query as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Hex digits of the digest that the equi-join uses.
SHORT = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the rules see them; both empty for a null url or one without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def expression_digest(host: Column, path: Column) -> Column:
    """The separator keeps ('a/', 'b') and ('a', '/b') apart: no host holds a slash."""
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The rules as literals of the plan."""
    kind = "array<struct<host:string,path:string,verdict:string>>"
    made = F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(r, ("host", "path", "verdict"), strict=True))) for r in rules))
    return spark.range(1).select(F.inline(made.cast(kind)))


def host_suffixes(host: Column, sizes: list[int]) -> Column:
    """The suffixes of the host that have one of the given numbers of labels: no other can be a rule's."""
    labels = F.length(host) - F.length(F.translate(host, ".", "")) + 1
    return F.array_compact(F.array(*(F.when(labels >= n, F.substring_index(host, ".", -n)) for n in sizes)).cast("array<string>"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict``; repeated rules count once, and where a host and
    path have both verdicts, block wins. Rules of equal length: the longer host wins. URLs that no
    rule fits get ``default``. Input columns of the new names are replaced. An empty table of pages
    gives no rows, an empty table of rules the default for all; a rule with a null host or path never
    fits. A URL of any length makes one expression for each pair of a rule's number of labels and length of
    path, however many labels its host has. Rows that repeat are judged each.
    """
    host, path = url_parts(F.col(url))
    pages = pages.drop("rule", "verdict").withColumns({"host": host, "path": path})
    keyed = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_chars"), F.length("path").alias("path_chars"), expression_digest(F.col("host"), F.col("path")).alias("digest"))
    labels = (F.length("host") - F.length(F.translate("host", ".", "")) + 1).alias("labels")
    shapes = rules.where("host is not null and path is not null").agg(F.collect_set(labels).alias("labels"), F.collect_set(F.length("path")).alias("chars")).first()
    sizes, lengths = sorted(shapes["labels"]), sorted(shapes["chars"])  # one for each number of labels, one for each length of a path
    wanted = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    hosts = pages.select("host", "path").distinct()
    spread = hosts.select("host", "path", F.explode(host_suffixes(F.col("host"), sizes)).alias("suffix"))
    spread = spread.select("host", "path", "suffix", F.explode(F.filter(wanted, lambda n: n <= F.length("path"))).alias("n"))
    spread = spread.select("host", "path", expression_digest(F.col("suffix"), F.substring("path", F.lit(1), F.col("n"))).alias("own"))
    hit = spread.withColumn("short", F.substring("own", 1, SHORT)).join(keyed.withColumn("short", F.substring("digest", 1, SHORT)), "short").where("own = digest")
    best = F.max(F.struct(F.length("rule").alias("n"), "host_chars", "verdict", "rule")).alias("best")
    found = hit.groupBy("host", "path").agg(best)
    out = pages.join(found, ["host", "path"], "left")
    return out.withColumns({"rule": F.col("best.rule"), "verdict": F.coalesce(F.col("best.verdict"), F.lit(default))}).drop("best")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH parts AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM parts
), r(rh, rp, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fit AS (
  SELECT page_id, host, path, rh || rp AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
  FROM p LEFT JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fit WHERE k = 1
"""
