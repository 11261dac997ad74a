"""URL filters by a sort-merge range join on reversed hosts and paths.

``com.example.`` is the key of example.com: a rule's key is a prefix of the keys of its host and all
subdomains, and its path a prefix of the paths it fits, so every rule is an interval of sorted keys and
intervals nest. Two sweeps of one kind follow: distinct hosts among the hosts that have rules, then
distinct paths, below each such host, among its rules' paths. In both, points and rules are sorted
together by ranges; the rules open at a point are those on the stack left by the nearest rule before it,
as far as their prefixes still hold. A stack is as long as prefixes nest, however many rules a host has,
and the pages of a hot host are dealt by their paths. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import checkpoints

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of covered hosts that are sent to all workers; beyond, each host's pages are dealt to SHARES tasks.
MOST_SENT = 100_000
SHARES = 16


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def rule_table(spark, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(action, pattern) to rows action, rule, host, path. A pattern is a host and, from its first ``/``, a path prefix."""
    rows = [(action, p, p.partition("/")[0].lower(), "".join(p.partition("/")[1:])) for action, p in rules]
    return spark.createDataFrame(rows, "action string, rule string, host string, path string")


def stacks(rules: DataFrame, ends: Column) -> DataFrame:
    """rules (space, key; distinct) with stack: the keys of their space that are prefixes of the key, itself among them. ends: how long a prefix may be (array of lengths)."""
    above = rules.select("space", "key", F.explode(F.transform(ends, lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("up"))
    return above.join(rules.select("space", F.col("key").alias("up")), ["space", "up"], "left_semi").groupBy("space", "key").agg(F.collect_list("up").alias("stack"))


def sweep(points: DataFrame, laid: DataFrame) -> DataFrame:
    """points (space, key; distinct) that lie in an interval, with stack: the keys of all intervals around them. laid: ``stacks``."""
    opened = laid.select("space", "key", F.lit(0).alias("kind"), "stack")
    both = opened.unionByName(points.select("space", "key", F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("stack")))
    sorted_ = both.repartitionByRange("space", "key", "kind").withColumn("part", F.spark_partition_id()).checkpoint()  # stored: the ranges must not be drawn anew
    rule = F.when(F.col("kind") == 0, F.struct("space", "stack"))
    within = Window.partitionBy("part").orderBy("space", "key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = sorted_.withColumn("last", F.last(rule, ignorenulls=True).over(within)).filter("kind = 1")
    ends = sorted_.groupBy("part").agg(F.max(F.when(F.col("kind") == 0, F.struct("space", "key", "stack"))).alias("end"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", F.last(F.when(F.col("end").isNotNull(), F.struct("end.space", "end.stack")), ignorenulls=True).over(before).alias("carry"))  # a row for each partition
    joined = swept.join(F.broadcast(carried), "part").withColumn("last", F.coalesce("last", "carry"))
    held = F.when(F.col("last.space") == F.col("space"), F.filter("last.stack", lambda p: F.col("key").startswith(p)))
    return joined.select("space", "key", held.alias("stack")).filter(F.size("stack") > 0)


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """pages (url and any columns) with host, path, rule and verdict.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there
    up to ``?``, ``#`` or the end; a null url or one without ``://`` has both empty. A rule fits its host and
    all subdomains if the path starts with its path; the longest pattern wins, then the longer host,
    then the lesser text, then the lesser action. Rules without a host or path are left out. Without a
    rule the verdict is ``otherwise``. Repeated rows stay; columns named as the result's are replaced.
    """
    checkpoints.ensure(pages.sparkSession)
    names = pages.drop("host", "path", "rule", "verdict").columns
    parsed = pages.select(*names, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = rules.filter("host IS NOT NULL AND path IS NOT NULL").withColumn("space", key_of(F.col("host")))
    best_of = F.struct(-F.length("rule"), "rule", "action")  # among rules of one host and path
    own = own.groupBy("space", "path").agg(F.min_by(F.struct("rule", "action", F.length("rule").alias("size"), F.length("host").alias("depth")), best_of).alias("r")).checkpoint()

    # hosts: which hosts that have rules lie above a page's
    hosts = own.select(F.lit("").alias("space"), F.col("space").alias("key")).distinct()
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), "[.]")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.length(F.array_join(F.slice(labels, 1, n), ".")) + 1)
    asked = parsed.select("host").distinct().select(F.lit("").alias("space"), key_of(F.col("host")).alias("key"))
    covered = sweep(asked, stacks(hosts, ends)).select("key", F.explode("stack").alias("space")).checkpoint()  # a row for each rule host above

    # paths: the longest rule path below each of these
    urls = parsed.select(key_of(F.col("host")).alias("key"), "path", "host").distinct()
    if covered.count() <= MOST_SENT:
        met = urls.join(F.broadcast(covered), "key")
    else:
        dealt = covered.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        met = urls.withColumn("share", F.pmod(F.xxhash64("path"), F.lit(SHARES)).cast("int")).join(dealt, ["key", "share"]).drop("share")
    met = met.select("host", "space", "path").checkpoint()
    paths = own.select("space", F.col("path").alias("key"))
    laid = stacks(paths, F.sequence(F.lit(0), F.length("key")))
    found = sweep(met.select("space", F.col("path").alias("key")).distinct(), laid).select("space", F.col("key").alias("path"), F.array_max(F.transform("stack", lambda p: F.struct(F.length(p).alias("n"), p.alias("prefix"))))["prefix"].alias("prefix"))
    ruled = found.join(own.select("space", F.col("path").alias("prefix"), "r"), ["space", "prefix"]).select("space", "path", "r")
    order = F.struct(-F.col("r.size"), -F.col("r.depth"), "r.rule", "r.action")
    best = met.join(ruled, ["space", "path"]).groupBy("host", "path").agg(F.min_by("r", order).alias("r"))
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("r.rule").alias("_r"), F.col("r.action").alias("_a"))
    # inner columns stand last, so that pages may have columns of the same names
    left = parsed.select(F.struct(*names).alias("row"), "host", "path") if names else parsed
    out = left.join(best, (left["host"] == best["_h"]) & (left["path"] == best["_p"]), "left")
    return out.select("row.*", "host", "path", F.col("_r").alias("rule"), F.coalesce("_a", F.lit(otherwise)).alias("verdict"))
