"""URL filters: a sort-merge range join of urls with nested allow and block rules.

A rule covers all keys that start with its own key (reversed host, then path): an interval. Intervals of prefixes nest or are
apart, so a sorted sweep over their ends keeps a stack of active rules, and a url's rule is the top of the stack at its key.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, rank_in

BLOCK, ALLOW = "block", "allow"
#: Sampled keys for each cut between two blocks of the sweep, and bytes of a cut; both only balance the work.
SAMPLE, CUT_BYTES = 64, 96

_HOST, _PATH = r"(?s)://([^/?#]*)", r"(?s)://[^/?#]*([^?#]*)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    """Bytes that sort as the labels from the top domain on, then the path."""
    return F.encode(F.concat(F.translate(F.array_join(labels, "."), "\0", "?"), F.lit("\0"), path), "utf-8")


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _rules(rules: DataFrame) -> DataFrame:
    clean = rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict")
    return clean.groupBy("h", "p").agg(F.min(F.when(F.col("verdict") == ALLOW, F.lit(ALLOW)).otherwise(F.lit(BLOCK))).alias("a"),
                                       F.max(F.when(F.col("verdict") == ALLOW, F.lit(ALLOW)).otherwise(F.lit(BLOCK))).alias("b")).select(
        _key(_labels(F.col("h")), F.col("p")).alias("key"), F.size(_labels(F.col("h"))).alias("n_labels"),
        F.struct((F.length("h") + F.length("p")).alias("length"), F.length("h").alias("host_length"), F.concat("h", "p").alias("rule"),
                 F.when((F.col("a") == BLOCK) | (F.col("b") == BLOCK), F.lit(BLOCK)).otherwise(F.lit(ALLOW)).alias("verdict")).alias("top"))


def _cuts(keys: DataFrame, n: int) -> list[bytes]:
    """At most n - 1 keys that split all keys about evenly, from the keys with the smallest hashes."""
    sample = keys.select(F.substring("key", 1, CUT_BYTES).alias("key"), F.xxhash64("key").alias("hash")).orderBy("hash").limit(SAMPLE * n)
    found = sorted(bytes(r.key) for r in sample.collect())
    return sorted({found[i * len(found) // n] for i in range(1, n)}) if found else []


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = ALLOW) -> DataFrame:
    """One row a page: the columns of ``keep``, host, path, rule, verdict.

    ``rules``: host, path, verdict (``allow``, else ``block``). A rule fits its host and all subdomains if the path of the url
    starts with the rule's; the longest (host and path together) wins, of equally long ones the one with the longer host. Of equal
    rules with both verdicts ``block`` counts. Urls that no rule fits, null urls and urls without ``://`` (empty host and path)
    get a null rule and ``default``. Null hosts and paths of rules count as empty. Repeated pages are judged one by one.

    Each different (host, path) is swept once, for each ending of its host that is not deeper than the deepest rule. Blocks are
    key ranges; a rule that reaches into several blocks is entered in each, so every block has its whole stack.
    """
    pages = pages.select(*keep, url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rules = _rules(rules)
    deepest = rules.agg(F.max("n_labels")).first()[0]
    if deepest is None:
        return pages.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    n = partitions(pages)
    probes = pages.select("host", "path").distinct().withColumn("labels", F.slice(_labels(F.col("host")), 1, deepest)).select(
        "host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.slice("labels", 1, i))).alias("labels")).select(
        "host", "path", _key(F.col("labels"), F.col("path")).alias("key"))
    cuts = _cuts(probes, n)
    at = (lambda c: rank_in(F.array(*[F.lit(x) for x in cuts]), len(cuts), c)) if cuts else (lambda c: F.lit(0))

    end = F.concat("key", F.lit(b"\xff"))  # above all that starts with the key: UTF-8 has no such byte
    spans = rules.select("key", "top", end.alias("end"), F.length("key").cast("long").alias("size"), at(F.col("key")).alias("first"), at(end).alias("last"))
    starts = spans.select(F.explode(F.sequence("first", "last")).alias("block"), "*").select(
        "block", F.when(F.col("block") == F.col("first"), F.col("key")).otherwise(F.lit(b"")).alias("pos"), F.col("size").alias("turn"), F.lit(1).alias("step"), "top")
    ends = spans.select(F.col("last").alias("block"), F.col("end").alias("pos"), (-F.col("size")).alias("turn"), F.lit(-1).alias("step"),
                        F.lit(None).cast(rules.schema["top"].dataType).alias("top"))
    sweep = Window.partitionBy("block").orderBy("pos", "turn").rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("block", "depth").orderBy("pos", "turn").rowsBetween(Window.unboundedPreceding, 0)
    nothing = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rules.schema["top"].dataType])
    # The stack: a start puts its rule on top; an end gives back the last rule that was started one level below.
    events = starts.union(ends).withColumn("depth", F.sum("step").over(sweep)).select(
        "block", "pos", "turn", F.coalesce(F.last("top", ignorenulls=True).over(level), nothing).alias("top"),
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    asked = probes.select(at(F.col("key")).alias("block"), F.col("key").alias("pos"), F.lit(2**62).alias("turn"),
                          F.lit(None).cast(rules.schema["top"].dataType).alias("top"), "host", "path")
    found = (events.union(asked).withColumn("top", F.last("top", ignorenulls=True).over(sweep))
             .filter(F.col("host").isNotNull() & F.col("top.rule").isNotNull()).groupBy("host", "path").agg(F.max("top").alias("top")))
    return pages.join(found, ["host", "path"], "left").select(
        *keep, "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
