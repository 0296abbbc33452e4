"""URL filters: a sort-merge range join of reversed-host keys with nested rule intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Sorts after every key that starts with the key it is put behind.
LAST = "\U0010ffff"


def _split(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot: a host's subdomains have its key as a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_segments(rules: DataFrame) -> DataFrame:
    """Points of the key axis where the stack of active rules changes: (key, stack).

    Every rule covers [key, key + LAST). Such intervals nest or are disjoint, so the stack at a key's start is
    its own rules and those of its ancestors, and behind its end that of its nearest ancestor. Ancestors come
    from an equi-join on the key's own prefixes, of which there are as many as the host has labels.
    """
    r = (
        rules.where("host is not null and host != ''")
        .select(F.lower("host").alias("host"), F.coalesce("path", F.lit("/")).alias("path"), "verdict")
        .dropDuplicates()
        .withColumn("key", host_key(F.col("host")))
    )
    at_key = r.groupBy("key").agg(F.collect_list(F.struct("host", "path", "verdict")).alias("own"))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    chain = at_key.select("key", F.posexplode(F.transform(labels, lambda x, i: F.concat(F.array_join(F.slice(labels, 1, i + 1), "."), F.lit(".")))).alias("depth", "above"))
    stacks = (
        chain.join(at_key.select(F.col("key").alias("above"), "own"), "above")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("depth", "above", "own"))).alias("chain"))
    )
    begin = stacks.select("key", F.flatten(F.col("chain.own")).alias("stack"))
    end = stacks.select(F.concat("key", F.lit(LAST)).alias("key"), F.flatten(F.slice(F.col("chain.own"), 1, F.greatest(F.size("chain") - 1, F.lit(0)))).alias("stack"))
    return begin.unionByName(end)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """Columns `keep`, then host, path, rule and verdict, one row per row of `pages`.

    rules: (host, path, verdict). A rule fits its host and all subdomains if the URL's path starts with the rule's;
    of several the longest (host and path together, then host) wins; none gives a null rule and `default`.
    Rows and segment starts meet in one range partitioning by key, written to the shared folder, so every row and every
    rule is there once and a hot host is cut into as many pieces as others are (rows of one key by a hash). In each piece,
    in the order of keys, a row takes the last stack before it; where its piece has none yet, the last one of the pieces
    before, carried over in a table of one row per piece. All path rules of one host lie in one stack.

    Null or malformed URLs have empty host and path and the default verdict; repeated rows stay; other columns of
    `pages` are ignored, so clashing names do no harm; an empty table or rule set gives no rows, or no rules.
    """
    spark = pages.sparkSession
    pieces = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    host, path = _split(F.col(url))
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(1))
    rows = pages.select(kept.alias("kept"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host"))).withColumn("tie", F.xxhash64("kept", "path")).withColumn("is_row", F.lit(1))
    both = rows.unionByName(rule_segments(rules).withColumn("is_row", F.lit(0)), allowMissingColumns=True)
    dealt = both.repartitionByRange(pieces, "key", "is_row", "tie").withColumn("piece", F.spark_partition_id())
    dealt = Scratch(spark, "urls").keep(dealt, "dealt")  # written, so that a rerun can't deal otherwise
    sweep = Window.partitionBy("piece").orderBy("key", "is_row").rowsBetween(Window.unboundedPreceding, 0)
    ends = dealt.groupBy("piece").agg(F.max_by("stack", F.when(F.col("is_row") == 0, F.col("key"))).alias("end"))
    carried = ends.select("piece", F.last("end", ignorenulls=True).over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    both = dealt.withColumn("inside", F.last("stack", ignorenulls=True).over(sweep)).where("is_row = 1").join(F.broadcast(carried), "piece", "left")
    fits = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("h"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))
    return (
        both.withColumn("active", F.coalesce("inside", "carried"))
        .withColumn("best", best)
        .select(*[F.col("kept")[c].alias(c) for c in keep], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )
