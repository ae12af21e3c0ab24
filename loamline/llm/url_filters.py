"""URL filter rules applied by a sort-merge range join.

A host is turned around label by label (``a.example.net`` becomes ``net.example.a.``), so a rule's host stands for the
interval of keys that start with its own turned host: the host itself and all subdomains. Rules and distinct hosts are
sorted together; a sweep over the sorted keys keeps a stack of the active nested rules, one place for each number of
labels, which is popped as soon as a key leaves the rule's interval. The paths of the rules on the stack are then
compared with the url's path and the longest rule wins.

The sweep runs in ranges of keys: the bounds are quantiles of a bounded sample of hosts and only decide where the ranges
begin, and each rule is present in every range that its interval touches. Only distinct hosts are swept; the verdicts
go back to the urls by a join that treats hosts with very many urls apart.

Defined results: a null url or one without ``://`` has an empty host and path and no rule; urls of any length are compared whole; an
empty table gives no rows; repeated rows each get their verdict; of equally long rules the first verdict in the alphabet wins; other
columns, whatever their names, are not needed and stay only if named in ``keep`` (a name of the results is theirs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, join_uneven, materialize, partitions

#: Hosts sampled for each range of the sweep; they only set the bounds between ranges.
SAMPLE_PER_RANGE = 32
LAST = "\U0010ffff"

#: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by a dot: a key starts with a rule's key if the host is the rule's or below it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _stacked(rules: DataFrame) -> DataFrame:
    """One row for each rule host: its key, its number of labels, its path rules (longest first)."""
    one = F.struct((-F.length(F.concat("host", "path"))).alias("order"), F.col("verdict"), F.col("path"), F.concat("host", "path").alias("rule"))
    return rules.groupBy("host").agg(F.sort_array(F.collect_set(one)).alias("paths")).select(host_key(F.col("host")).alias("key"), "paths").withColumn("depth", F.size(F.split("key", r"\.")) - 1)


def active_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts (host, ...) with column stack: the path rules of all rules whose host is the host or above it."""
    spark = hosts.sparkSession
    heads = _stacked(rules)
    deepest = heads.agg(F.max("depth")).first()[0] or 0
    if not deepest:
        return hosts.withColumn("stack", F.array().cast("array<struct<order:int,verdict:string,path:string,rule:string>>"))
    keyed = hosts.withColumn("key", host_key(F.col("host")))
    ranges = max(1, partitions(spark))
    sample = keyed.select("key", F.xxhash64("key").alias("h")).orderBy("h", "key").limit(SAMPLE_PER_RANGE * ranges)
    keys = sorted(r[0] for r in sample.select("key").collect())
    bounds = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<string>")

    def at(k: Column) -> Column:
        return F.size(F.filter(edges, lambda b: b <= k))

    begin = heads.withColumn("range", F.explode(F.sequence(at(F.col("key")), at(F.concat("key", F.lit(LAST))))))
    begin = begin.select("range", "key", F.lit(0).alias("kind"), F.struct("key", "paths").alias("rule"), "depth", F.lit(None).cast("string").alias("host"))
    probe = keyed.select(at(F.col("key")).alias("range"), "key", F.lit(1).alias("kind"), F.lit(None).cast(begin.schema["rule"].dataType).alias("rule"), F.lit(None).cast("int").alias("depth"), "host")
    order = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = [F.last(F.when(F.col("depth") == d, F.col("rule")), ignorenulls=True).over(order).alias(f"place{d}") for d in range(deepest, 0, -1)]
    swept = begin.unionByName(probe).select("kind", "key", "host", *places).filter("kind = 1")
    on_stack = F.filter(F.array(*[F.col(f"place{d}") for d in range(deepest, 0, -1)]), lambda r: r.isNotNull() & F.col("key").startswith(r["key"]))
    return swept.select("host", F.flatten(F.transform(on_stack, lambda r: r["paths"])).alias("stack"))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), otherwise: str = "allow") -> DataFrame:
    """keep, host, path, rule (null if none fits) and verdict of every row. Columns to keep may have any names but the four."""
    own = [f"_keep{i}" for i in range(len(keep))]
    urls = pages.select(*(F.col(k).alias(o) for k, o in zip(keep, own, strict=True)), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    total = pages.count()
    hosts = urls.groupBy("host").agg(F.count(F.lit(1)).alias("urls"))
    hosts = materialize(hosts, "hosts")
    stacks = active_rules(hosts.select("host"), rules).filter(F.size("stack") > 0).join(hosts, "host")
    stacks = materialize(stacks, "host-rules")
    joined = join_uneven(urls, stacks, "host", "urls", total)
    fits = F.filter("stack", lambda r: F.col("path").startswith(r["path"]))
    best = F.get(F.array_sort(fits), F.lit(0))
    kept = [F.col(o).alias(k) for k, o in zip(keep, own, strict=True) if k not in ("host", "path", "rule", "verdict")]
    return joined.withColumn("best", best).select(*kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
