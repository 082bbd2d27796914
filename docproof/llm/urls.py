"""URL filter: host-suffix and path-prefix expressions, joined to rules on short hash prefixes.

Every distinct (host, path) is expanded only into the expressions that some rule could equal: host suffixes with as
many labels, and path prefixes with as many characters, as occur together in a rule. An expression meets rules by the
first 32 bits of its SHA-256, full digests confirm the match, and the longest rule decides.

Edge cases: a null URL or one without ``://`` has an empty host and path and fits no rule; rules with a null or empty
host, or a null path or verdict, never fit; equal URLs and repeated rows each get their own result row; an empty table
gives an empty result. Of rules of equal length the one with the longer host wins, then ``block`` before ``allow``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_DIGITS = 8
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their digests; hosts in lower case."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    rules = rules.filter("rule_host != '' AND rule_path IS NOT NULL AND verdict IS NOT NULL")
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    return rules.withColumn("rule_digest", digest).withColumn("prefix", F.substring("rule_digest", 1, PREFIX_DIGITS))


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
               default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``; ``default`` where no rule fits.

    The distinct shapes of the rules (labels of the host, length of the path) are read by the driver: they are bounded
    by the longest host and path of a rule, not by the number of rules or pages.
    """
    ready = prepare_rules(rules)
    shapes = ready.select(_labels(F.col("rule_host")).alias("labels"), F.length("rule_path").alias("chars")).distinct()
    split = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    host, path = F.col("host"), F.col("path")
    options = [
        F.when(
            (_labels(host) >= s["labels"]) & (F.length(path) >= s["chars"]),
            F.struct(F.substring_index(host, ".", -s["labels"]).alias("h"), F.substring(path, 1, s["chars"]).alias("p")),
        )
        for s in sorted(shapes.collect())
    ]
    none = F.lit(None).cast("struct<h:string,p:string>")
    urls = split.filter("host != ''").select("host", "path").distinct()
    expressions = urls.select("host", "path", F.explode(F.array_compact(F.array(none, *options))).alias("e"))
    expressions = expressions.withColumn("digest", _digest(F.col("e.h"), F.col("e.p")))
    expressions = expressions.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS)).drop("e")
    fits = expressions.join(ready, "prefix").filter("digest = rule_digest")
    order = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("chars"),
        F.length("rule_host").alias("host_chars"),
        F.col("verdict").alias("verdict"),
        F.concat("rule_host", "rule_path").alias("rule"),
    )
    best = fits.groupBy("host", "path").agg(F.max(order).alias("best"))
    judged = split.join(best, ["host", "path"], "left")
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
