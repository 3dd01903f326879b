"""URL block and allow lists by hashed host-suffix / path-prefix expressions (built-in functions only).

A rule is ``(host, path, verdict)``.  It fits its host and every subdomain when the url's path starts
with the rule's path; the longest rule string (host plus path) wins, then the longer host, then
``allow`` before ``block``.

Every distinct (host, path) of the table is expanded into host suffixes (cut at dots) and path prefixes,
as far as some rule has a host of so many labels or a folder of that length: a megabyte of slashes makes no
more rows than any other url.  An expression ``suffix + prefix`` meets the rules by the first 32 bits of its
SHA-256 in an equi-join; the full digest and the rest of the rule's path are compared afterwards.  A
rule whose path does not end at a slash is filed under its last folder, so no prefix is missed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.storage import ascii_lower

RULE_SCHEMA = "rule_host string, rule_path string, rule_verdict string"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def rules_frame(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A rule table from ``(host, path, verdict)`` tuples."""
    return spark.createDataFrame([tuple(r) for r in rules], RULE_SCHEMA)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host + path of the rule that decides, or null) and ``verdict``.

    Null urls, urls without ``://`` and empty hosts match no rule and get ``default``.  Repeated rows
    each keep their verdict; an empty table gives an empty result.  Columns of ``pages`` named like one
    of the four results are replaced.  Rules with a null host are ignored; a null path counts as empty.
    The rule table is joined, never collected: Spark broadcasts it only below its size threshold.
    """
    asked = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).drop("rule", "verdict")
    r = rules.where(F.col("rule_host").isNotNull() & F.col("rule_verdict").isNotNull()).select(
        ascii_lower("rule_host").alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), "rule_verdict"
    )
    folder = F.regexp_extract("rule_path", r"(?s)^(.*/)", 1)
    r = r.withColumn("full", _digest(F.concat_ws("\n", "rule_host", folder))).withColumn("short", _short(F.col("full")))

    # only as many labels, and folders of just those lengths, as some rule has: few numbers, whatever a url holds
    shapes = r.agg(F.collect_set(_labels(F.col("rule_host"))), F.collect_set(F.length(folder))).first()
    counts, lengths = (F.array(*[F.lit(x) for x in sorted(found)]).cast("array<int>") for found in shapes)
    keys = asked.where(F.col("host") != "").select("host", "path").distinct()
    suffixes = F.transform(F.filter(counts, lambda n: n <= _labels(F.col("host"))), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    folders = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    e = keys.withColumn("suffix", F.explode(suffixes)).withColumn("folder", F.explode(folders))
    e = e.select("host", "path", "suffix", _digest(F.concat_ws("\n", "suffix", "folder")).alias("digest"))
    e = e.withColumn("short", _short(F.col("digest")))
    hit = e.join(r, "short").where((F.col("digest") == F.col("full")) & (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("n"),
        F.length("rule_host").alias("m"),
        (F.col("rule_verdict") == "allow").alias("a"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    best = hit.groupBy("host", "path").agg(F.max(rank).alias("best"))
    out = asked.join(best, ["host", "path"], "left")
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*columns, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
