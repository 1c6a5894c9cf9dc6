"""URL filters: every url judged by the longest rule that fits it, by a sorted sweep over nested intervals.

A rule is a host and the start of a path. Written with its labels reversed (``org.example.``),
a host is the start of the keys of all its subdomains, so a rule's host is an interval of keys, and
two intervals are nested or apart. Keys of urls and both ends of every interval are sorted
together; at each end the stack of active nested hosts is known beforehand (a host, and those of
its parents that have rules), so a url takes the stack of the last end before it. The paths of
the active hosts are intervals too, and a second sweep of the same kind takes, for each of a
url's active hosts, the longest path that is open there.

The sort is by ranges: ends are dealt to ranges with the urls, and a range begins with the
stack that the ranges before it leave. So no rule is sent to all urls, no pair of a url and a
rule that doesn't hold it is formed, a host with very many urls lies across many ranges, and one
with very many rules costs no url more than another. Only ids and urls are read, by SQL functions.

Defined results: the host is what stands after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z
in lower case (a port is part of it), the path what follows up to ``?`` or ``#``; both are empty for
a null url or one without ``://``, and such a url fits no rule but one of an empty host. The longest
rule has most characters in host and path together, then in the host; of rules that repeat host
and path with several verdicts the last by name stands (block, not allow). Rules of null host or
verdict are left out, a null path is empty. Repeated rows and null ids count each for itself, long
urls are read whole, other columns not at all; without rules all is judged by ``default``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollsmith.llm.common import materialize, tidy



def host_and_path(url: Column) -> tuple[Column, Column]:
    """A url's host, A-Z in lower case, and its path."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list of (verdict, host, path) as a table."""
    cells = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for v, h, p in rules]
    empty = F.array().cast("array<struct<host:string,path:string,verdict:string>>")
    return spark.range(1).select(F.inline(F.array(*cells) if cells else empty))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, "[.]", -1))


def _key(labels: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("."))


def _path_key(host_key: Column, path: Column) -> Column:
    return F.concat(host_key.cast("binary"), F.unhex(F.lit("FE")), path.cast("binary"))


def _ends(intervals: DataFrame) -> DataFrame:
    """``key, stack`` of both ends of ``key, inside, outside``: what is active from there on."""
    first, last = F.struct("key", F.col("inside").alias("stack")), F.struct(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.col("outside").alias("stack"))
    return intervals.select(F.inline(F.array(first, last)))


def _swept(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """``points`` (``key, _row`` and more) with the ``stack`` of the last interval's end at or before their key."""
    ends = _ends(intervals).withColumn("_kind", F.lit(0))
    met = ends.unionByName(points.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    dealt = materialize(met.repartitionByRange("key", "_kind", "_row").withColumn("_range", F.spark_partition_id()))
    left = dealt.groupBy("_range").agg(F.max_by("stack", F.when(F.col("_kind") == 0, F.col("key"))).alias("_left"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    held = left.select("_range", F.last("_left", ignorenulls=True).over(before).alias("_held"))
    so_far = Window.partitionBy("_range").orderBy("key", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.withColumn("_seen", F.last("stack", ignorenulls=True).over(so_far)).where("_kind = 1").join(held, "_range")
    return swept.withColumn("stack", F.coalesce("_seen", "_held", F.array())).drop("_seen", "_held", "_range", "_kind")


def _host_intervals(rules: DataFrame) -> DataFrame:
    """Each rule host's interval; active inside are it and those of its parents that have rules."""
    hosts = rules.select("labels", "host_key").distinct()
    prefixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: _key(F.slice("labels", F.lit(1), n)))
    nested = hosts.select("host_key", F.explode(prefixes).alias("prefix")).join(hosts.select(F.col("host_key").alias("prefix")), "prefix")
    stacks = nested.groupBy("host_key").agg(F.sort_array(F.collect_list("prefix")).alias("inside"))
    return stacks.select(F.col("host_key").cast("binary").alias("key"), "inside", F.slice("inside", F.lit(1), F.size("inside") - 1).alias("outside"))


def _path_intervals(rules: DataFrame) -> DataFrame:
    """Each rule's interval of its host's paths; active inside is the rule, outside the longest that it is nested in."""
    told = rules.select("host_key", "path", F.length("path").alias("size"), F.struct(F.length("rule").alias("length"), F.length("host_key").alias("of_host"), "rule", "verdict").alias("top"))
    sizes = told.groupBy("host_key").agg(F.collect_set("size").alias("sizes"))
    shorter = F.filter("sizes", lambda n: n < F.col("size"))
    starts = told.join(sizes, "host_key").select("host_key", "path", F.explode(shorter).alias("n"))
    starts = starts.select("host_key", "path", F.col("path").substr(F.lit(1), F.col("n")).alias("start"))
    outer = told.select("host_key", F.col("path").alias("start"), F.struct("size", "top").alias("outer"))
    above = starts.join(outer, ["host_key", "start"]).groupBy("host_key", "path").agg(F.max("outer")["top"].alias("outer"))
    found = told.join(above, ["host_key", "path"], "left")
    return found.select(_path_key(F.col("host_key"), F.col("path")).alias("key"), F.array("top").alias("inside"), F.when(F.col("outer").isNull(), F.array().cast(f"array<{told.schema['top'].dataType.simpleString()}>")).otherwise(F.array("outer")).alias("outside"))


@tidy
def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``host, path, rule, verdict`` of every url, by the longest of ``rules`` (``host, path, verdict``) that fits it."""
    lower = F.translate(F.col("host"), string.ascii_uppercase, string.ascii_lowercase)
    known = rules.where("host is not null and verdict is not null").select(lower.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = known.select(F.concat("host", "path").alias("rule"), "path", "verdict", _labels(F.col("host")).alias("labels")).withColumn("host_key", _key(F.col("labels")))
    host, path = host_and_path(F.col(url_col))
    points = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("_row"))
    points = points.withColumn("key", _key(_labels(F.col("host"))).cast("binary"))
    swept = materialize(_swept(points, _host_intervals(known)))
    none = F.lit(None).cast("string")
    apart = swept.where(F.size("stack") == 0).select("id", "host", "path", none.alias("rule"), none.alias("verdict"))
    inside = swept.where(F.size("stack") > 0).select("id", "host", "path", "_row", F.explode("stack").alias("host_key"))
    tops = _swept(inside.withColumn("key", _path_key(F.col("host_key"), F.col("path"))).drop("host_key"), _path_intervals(known))
    judged = tops.groupBy("_row").agg(*[F.first(c).alias(c) for c in ("id", "host", "path")], F.max(F.get("stack", F.lit(0))).alias("top"))
    found = apart.unionByName(judged.select("id", "host", "path", "top.rule", "top.verdict"))
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
