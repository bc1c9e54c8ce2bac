"""URL rules by a sort-merge range join.

A rule (host, path, verdict) fits its host and all subdomains where the path of the URL starts with its
own. Hosts are keyed by their labels in reverse order, each ended by a sign below every other, so that
"the host and its subdomains" is an interval of keys that begins at the rule's key. Rules and URLs are
sorted together by key and swept in that order with a stack of active rules: intervals nest, and an
interval of depth d is the d-th on the stack. Along the sweep the stack is, for each depth, the
last rule of that depth; those whose interval has ended are seen by their key. A second sweep does the
same for the paths of the hosts found. The longest fitting rule wins (by host and path together, then host).

The sweep is cut into ranges of nearly equal size; a range starts with the stack that the ranges before
it leave. Rows are sorted by host, path and a hash, so a frequent host spreads over many ranges.

Nulls: a null url, or one without ``://``, has an empty host and path and fits no rule. Equal urls are
swept once. Rules with a null part are left out; of equal rules, block wins. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut, join_small

_END = "\x01"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    """com.example -> com<end>example<end>: a host's key starts the keys of its subdomains and of nothing else."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), _END), F.lit(_END))


def sweep(points: DataFrame, rules: DataFrame, depths: int, blocks: int) -> DataFrame:
    """points: group, key, and more; rules: group, key, depth (1 to depths, 1 outermost), rule (any value).
    Adds to each point ``active``, the rules of its group whose key starts its own, outermost first."""
    more = [c for c in points.columns if c not in ("group", "key")]
    kind = rules.schema["rule"].dataType
    both = points.select("group", "key", F.struct(*more).alias("_point"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast(kind).alias("rule")).unionByName(
        rules.select("group", "key", F.lit(None).cast(points.select(F.struct(*more)).schema[0].dataType).alias("_point"), "depth", "rule")
    )
    # rules come before the points of their key, outer ones first
    both = both.withColumn("_after", F.col("depth").isNull().cast("int")).withColumn("_tie", F.xxhash64("_point"))
    order = ["group", "key", "_after", "_tie", "depth"]
    swept = cut(both.repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id()))
    stack = [F.last(F.when(F.col("depth") == d, F.struct("group", "key", "rule")), ignorenulls=True) for d in range(1, depths + 1)]
    ends = swept.where("depth is not null").groupBy("_block").agg(*[F.max_by(F.when(F.col("depth") == d, F.struct("group", "key", "rule")), F.when(F.col("depth") == d, F.struct(*order))).alias(f"e{d}") for d in range(1, depths + 1)])
    # one row for each range: what the ranges before it leave on the stack
    every = swept.select("_block").distinct().join(ends, "_block", "left")
    prior = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut(every.select("_block", *[F.last(f"e{d}", ignorenulls=True).over(prior).alias(f"c{d}") for d in range(1, depths + 1)]))
    along = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = swept.select("*", *[s.over(along).alias(f"s{d}") for d, s in enumerate(stack, 1)]).where("depth is null")
    found = join_small(found, carried, ["_block"])
    levels = F.array(*[F.coalesce(f"s{d}", f"c{d}") for d in range(1, depths + 1)])
    active = F.filter(levels, lambda r: r.isNotNull() & (r["group"] == F.col("group")) & F.startswith(F.col("key"), r["key"]))
    return found.select("group", "key", "_point.*", F.transform(active, lambda r: r["rule"]).alias("active"))


def _prefix_depth(rules: DataFrame) -> DataFrame:
    """rules: group, key, rule. Adds depth: how many rules of the group, itself included, have keys that start its own."""
    lengths = F.sequence(F.lit(0), F.length("key"))
    begun = rules.select("group", F.col("key").alias("_whole"), F.explode(F.transform(lengths, lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("key"))
    nested = begun.join(rules.select("group", "key"), ["group", "key"]).groupBy("group", F.col("_whole").alias("key")).agg(F.count("*").cast("int").alias("depth"))
    return rules.join(nested, ["group", "key"])


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (host and path; null where none fits) and verdict. rules: host, path, verdict.
    Columns of pages with those names are replaced."""
    spark = pages.sparkSession
    rules = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    pages = pages.drop("host", "path", "rule", "verdict").withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    seen = cut(pages.select("host", "path").distinct())
    blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    hosts = cut(_prefix_depth(rules.select(F.lit("").alias("group"), reversed_key(F.col("host")).alias("key"), F.col("host").alias("rule")).distinct()))
    deepest = hosts.agg(F.max("depth")).first()[0]
    if deepest is None:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    by_host = sweep(seen.select(F.lit("").alias("group"), reversed_key(F.col("host")).alias("key"), "host", "path"), hosts.select("group", "key", "depth", "rule"), deepest, blocks)
    fits = by_host.select(F.explode("active").alias("group"), F.col("path").alias("key"), "host")
    paths = cut(_prefix_depth(rules.select(F.col("host").alias("group"), F.col("path").alias("key"), F.struct("host", "path", "verdict").alias("rule"))))
    by_path = sweep(fits, paths.select("group", "key", "depth", "rule"), paths.agg(F.max("depth")).first()[0], blocks)
    best = by_path.select("host", F.col("key").alias("path"), F.explode("active").alias("r"))
    rank = F.struct(F.length("r.host") + F.length("r.path"), F.length("r.host"))
    best = best.groupBy("host", "path").agg(F.max_by("r", rank).alias("_r"))
    joined = pages.join(best, ["host", "path"], "left")
    names = [c for c in pages.columns if c not in ("host", "path")]
    return joined.select(*names, "host", "path", F.concat("_r.host", "_r.path").alias("rule"), F.coalesce("_r.verdict", F.lit(default)).alias("verdict"))


#: The rules of the registered query.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")
