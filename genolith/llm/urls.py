"""URL filters as a sort-merge range join of canonical keys with nested prefix intervals.

A rule (host, path) has the canonical key `reversed host + NUL + path`; the urls that it fits are
those with a key in the interval of that prefix, where a url has one key for its host and one for
each parent domain. Prefix intervals nest or are disjoint, so a sweep over the sorted keys that
carries the stack of the rule opened last knows all rules that can be open at a key: those of the
stack that the key has not left yet.

The sweep runs in parallel over ranges of keys. The ranges come from quantiles of a bounded sample
of keys; a key that fills several quantiles (one url or host with a large part of all rows) gets as
many salts, so no range outgrows the others. The sample steers balance only, never results.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genolith.llm.common import let

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SAMPLE, RANGES, STEP = 8_192, 512, 24


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _ranges(keys: DataFrame, sample: int, ranges: int, least: int) -> tuple[list[str], list[int]]:
    """Lower bounds of key ranges and the number of salts of each, from a bounded sample of the rows of keys (`least` rows at least).

    A bound on the hash comes before the limit, so a task sends its share of the sample and not a whole one.
    """
    rank = F.xxhash64("rid", "key")
    few = keys if least <= 4 * sample else keys.where(rank < F.lit(int(2**64 * (4 * sample / least)) - 2**63))
    got = sorted((r.key for r in few.orderBy(rank).limit(sample).collect()), key=lambda k: k.encode())
    bounds: dict[str, int] = {"": 1}
    for i in range(1, ranges):
        if got:
            k = got[i * len(got) // ranges]
            bounds[k] = bounds.get(k, 0) + 1
    return list(bounds), list(bounds.values())


def _range_of(key: Column, bounds: list[str]) -> Column:
    """Index of the last bound <= key; looks among every STEP-th bound first."""
    lows = F.array(*[F.lit(b) for b in bounds])
    coarse = F.array(*[F.lit(b) for b in bounds[::STEP]])
    block = F.size(F.filter(coarse, lambda b: b <= key)) - 1
    return let(block, lambda c: c * STEP + F.size(F.filter(F.slice(lows, c * STEP + 1, STEP), lambda b: b <= key)) - 1)


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", sample: int = SAMPLE, ranges: int = RANGES) -> DataFrame:
    """keep, host, path, rule (host + path; null if none fits) and verdict of each row of pages.

    rules: host, path, verdict. Of the rules that fit, the longest wins, then the one with the longer
    host, then the greater string. Without one the verdict is `default`. Each row of pages gives one row, so repeated rows stay;
    null or malformed urls have empty host and path. Equal rules with two verdicts: the greater verdict.
    Other columns of pages aren't read. Empty pages or rules are fine.
    """
    rid = F.monotonically_increasing_id()
    host, path = url_parts(F.col(url))
    base = pages.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path")).withColumn("rid", rid)
    labels = F.reverse(F.split("host", r"\."))
    keys = (
        base.withColumn("labels", labels).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("labels"))))
        .withColumn("key", F.concat(F.array_join(F.slice("labels", 1, F.col("n")), "."), F.lit("\0"), "path"))
        .withColumn("full", F.col("n") == F.size("labels"))
    )
    bounds, salts = _ranges(keys.select("rid", "key"), sample, ranges, pages.count())
    low, salted = F.array(*[F.lit(b) for b in bounds]), F.array(*[F.lit(s) for s in salts])

    known = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(F.concat(_reversed(F.col("host")), F.lit("\0"), "path").alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("hosts"), "verdict")
        .groupBy("key", "rule", "hosts").agg(F.max("verdict").alias("verdict"))
    )
    # the stack of each rule: the rules around it and itself
    outer = known.select(F.col("key").alias("outer"), F.struct(F.length("rule").alias("size"), "hosts", "rule", "verdict", F.col("key").alias("prefix")).alias("item"))
    prefixes = known.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("outer"))
    stacks = prefixes.join(outer, "outer").groupBy("key").agg(F.collect_list("item").alias("stack"))

    # a rule opens in the range of its key and again at the start of each later range that its interval reaches
    last = F.concat("key", F.lit("\U0010ffff"))
    opened = (
        stacks.withColumn("r", F.explode(F.sequence(_range_of(F.col("key"), bounds), _range_of(last, bounds))))
        .withColumn("s", F.explode(F.sequence(F.lit(0), F.get(salted, F.col("r")) - 1)))
        .select("r", "s", F.greatest("key", F.get(low, F.col("r"))).alias("key"), F.length("key").alias("depth"), "stack")
    )
    nothing = F.lit(None)
    asked = (
        keys.withColumn("r", _range_of(F.col("key"), bounds))
        .withColumn("s", F.pmod(F.xxhash64("rid"), F.get(salted, F.col("r"))).cast("int"))
        .select("r", "s", "key", F.lit(1 << 30).alias("depth"), nothing.cast(stacks.schema["stack"].dataType).alias("stack"), "rid", "full", *[c for c in base.columns if c != "rid"])
    )
    sweep = Window.partitionBy("r", "s").orderBy("key", "depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = asked.unionByName(opened, allowMissingColumns=True).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("rid is not null")
    best = F.array_max(F.filter("open", lambda x: F.startswith(F.col("key"), x["prefix"])))
    found = swept.withColumn("best", best).where("full or best is not null")
    carried = [c for c in base.columns if c != "rid"]
    each = found.groupBy("rid").agg(F.max("best").alias("best"), *[F.max(F.when(F.col("full"), F.col(c))).alias(c) for c in carried])
    return each.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
