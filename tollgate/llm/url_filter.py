"""URL filters: host-suffix and path-prefix expressions, hash-prefix join, digest confirmation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Rules of the registered query: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Hex digits of a digest that the first, coarse join compares (4 bytes).
PREFIX_HEX = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where the host rule finds no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules as (rule, verdict, digest, prefix, weight); a repeated host and path keeps the block."""
    frame = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    frame = frame.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    text = F.concat("host", "path")
    digest = F.sha2(F.concat_ws("\n", "host", "path"), 256)
    return frame.select(text.alias("rule"), "verdict", digest.alias("digest"), F.substring(digest, 1, PREFIX_HEX).alias("prefix"), F.length(text).alias("weight"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every row's url: (id, host, path, rule, verdict).

    A rule fits its host and all subdomains where the path starts with the rule's path; of several
    the longest (host and path together) wins, at equal length the lexically greater. Expressions
    are made only for the label counts and path lengths that the rules have, so a url of any length
    costs a few digests. Each is joined on its digest's first 4 bytes, then the full digests must
    agree. Null urls and urls without ``://`` have an empty host and path and fit no rule; every
    input row gives one row, repeated rows and null ids included; other columns are not read. No
    rules: all rows get ``default``.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    base = base.select("id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    if not rules:
        return base.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    known = rule_table(spark, rules)
    # The verdict depends on (host, cut path) alone: judge the distinct few, not every page.
    cut = F.substring("path", 1, max(lengths))
    keyed = base.withColumn("cut", cut)
    hosts = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in labels]))
    paths = F.array_distinct(F.array(*[F.substring("cut", 1, n) for n in lengths]))
    ways = keyed.where("host != ''").select("host", "cut").distinct()
    ways = ways.select("host", "cut", F.explode(hosts).alias("suffix"), paths.alias("heads"))
    ways = ways.select("host", "cut", "suffix", F.explode("heads").alias("head"))
    ways = ways.withColumn("full", F.sha2(F.concat_ws("\n", "suffix", "head"), 256)).withColumn("prefix", F.substring("full", 1, PREFIX_HEX))
    found = ways.join(known, "prefix").where("full = digest")
    best = found.groupBy("host", "cut").agg(F.max(F.struct("weight", "rule", "verdict")).alias("best"))
    # Written once, so that the join below has an exchange of its own on both sides and a hot host can be split.
    best = materialize(best.select(F.col("host").alias("r_host"), F.col("cut").alias("r_cut"), "best.rule", "best.verdict"), "verdicts")
    out = keyed.join(best, (F.col("host") == F.col("r_host")) & (F.col("cut") == F.col("r_cut")), "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow") -> str:
    """The same verdicts in DuckDB SQL, by comparing every url with every rule."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH rules(verdict, host, path) AS (VALUES {values}),
 cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
 parts AS (SELECT page_id, url,
   coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}'), '') AS host,
   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
   row_number() OVER () AS n FROM cut),
 fits AS (SELECT p.n, r.host || r.path AS rule, r.verdict,
   row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, r.host || r.path DESC, r.verdict DESC) AS k
   FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, '{default}') AS verdict
FROM parts p LEFT JOIN fits f ON f.n = p.n AND f.k = 1"""
