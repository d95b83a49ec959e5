"""URL filters as a sort-merge range join.

A rule (host, path) fits a url whose host is the rule's or a subdomain of it and whose path starts
with the rule's. The canonical key of a rule is its host with reversed labels, a separator and its path;
so every rule is an interval of keys, and intervals are nested or apart. A url has one key for each
suffix of its host. Keys and interval bounds are sorted together by ranges, and a sweep carries
the innermost open rule: a start opens its rule, an end goes back to the rule around it. Range partitions
are swept in parallel; each starts with the rule that was open at the end of those before it.
Only DataFrame functions are used. A url that many pages have is judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoloom.llm.common import let, lower_ascii
from echoloom.operators.ordering import range_sorted

#: Separates host and path in keys; lower than any character of a host label.
MARK = "\u0001"
#: Above every character that may follow in a key.
LAST = "\U0010ffff"
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(_rest(url), "^[^/?#]*", 0))), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit(MARK), path)


def bounds(rules: DataFrame) -> DataFrame:
    """(key, kind, open) of every interval bound: kind 0 starts a rule, kind 2 ends it.

    `open` is the rule that is innermost after the bound: the rule itself at its start, the rule
    around it (longest proper prefix of the path, same host) at its end, with a NULL name if there is none.
    """
    known = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").where("host is not null and path is not null and host <> ''")
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # both: block
    rule = F.struct(F.concat("host", "path").alias("rule"), F.col("verdict"))
    named = known.select("host", "path", rule.alias("rule"))
    shorter = F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda n: F.substring(F.col("path"), F.lit(1), n))
    prefixes = named.where("path <> ''").select("host", F.col("path").alias("whole"), F.explode(shorter).alias("path"))
    around = prefixes.join(named, ["host", "path"]).groupBy("host", "whole").agg(F.max_by("rule", F.length("path")).alias("outer"))
    both = named.join(around.withColumnRenamed("whole", "path"), ["host", "path"], "left")
    both = both.withColumn("key", _key(reversed_labels(F.col("host")), F.col("path")))
    nothing = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    start = F.struct(F.col("key"), F.lit(0).alias("kind"), F.col("rule").alias("open"))
    end = F.struct(F.concat("key", F.lit(LAST)).alias("key"), F.lit(2).alias("kind"), F.coalesce("outer", nothing).alias("open"))
    return both.select(F.explode(F.array(start, end)).alias("b")).select("b.*")


def swept(keys: DataFrame, bounds_: DataFrame) -> DataFrame:
    """`keys` (key and other columns) with `open`: the innermost rule whose interval holds the key, or NULL."""
    kind = "struct<rule:string,verdict:string>"
    own = [c for c in keys.columns if c != "key"]
    rows = keys.withColumn("kind", F.lit(1)).withColumn("open", F.lit(None).cast(kind))
    rows = rows.unionByName(bounds_.withColumn("open", F.col("open").cast(kind)), allowMissingColumns=True)
    placed = range_sorted(rows, ["key", "kind", *own])
    # one row per range partition: the rule open at its start
    last = placed.groupBy("__pid").agg(F.max_by(F.when(F.col("kind") != 1, F.col("open")), F.when(F.col("kind") != 1, F.struct("key", "kind"))).alias("end"))
    before = W.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(F.col("__pid"), F.last("end", ignorenulls=True).over(before).alias("carried"))
    inside = W.partitionBy("__pid").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    open_ = placed.withColumn("open", F.last("open", ignorenulls=True).over(inside)).where("kind = 1")
    joined = open_.join(F.broadcast(carried), "__pid")  # as many rows as partitions
    return joined.withColumn("open", F.coalesce("open", "carried")).drop("carried", "kind", "__pid")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of `pages` (page_id, url).

    rules: verdict, host, path. The longest fitting rule wins (host and path together; of equally
    long ones that with the longer host); without one the verdict is `default`. NULL urls and urls
    without `://` have an empty host and path and fit no rule. Two rules for the same host and path
    count as one that blocks; rules with a NULL or an empty host are void. Repeated pages give
    repeated rows.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = rows.where("host <> ''").select("host", "path").distinct()
    ends = lambda labels: F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: _key(F.slice(labels, F.lit(1), n), F.col("path")))
    keys = urls.select("host", "path", F.explode(let(reversed_labels(F.col("host")), ends)).alias("key"))
    found = swept(keys, bounds(rules)).where("open.rule is not null")
    # the rule's host part is the key's: of rules of the same length the later key has the longer host
    best = found.groupBy("host", "path").agg(F.max_by("open", F.struct(F.length("open.rule"), F.length("key"))).alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
