"""URL filters by a sort-merge range join (operator 2).

A host is turned round label by label (``blog.example.org`` becomes
``org.example.blog.``), so the hosts that a rule fits, its own and all
subdomains, are one interval of the sorted keys.  URLs and rules are sorted by
key together; a sweep keeps the rules whose intervals are open on a stack, nested
ones above, and asks them for the longest rule that fits the path.

URLs are range-partitioned by key and id, so a host with a third of all pages
is cut into several partitions; every rule is copied to the partitions that its
interval meets.  Only the key range of each partition passes through the driver.

Nulls and edge cases: a null URL or one without ``://`` has an empty host and path;
no rule fits it unless its host is empty, too.  A rule with an empty host fits every
host; rules with a null are ignored.  Of rules of equal length that with the longer
host wins, then ``block``.  Repeated rows are judged each; without rules every URL gets
the default; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the contract: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def reversed_host(host):
    """Sort key of a host column: labels from the right, each with a full stop."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit(".")))


def url_parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, key)`` of every row."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, at + 3)")).otherwise("")
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    return (pages.select(F.col(id_col).alias("page_id"), url.alias("url")).withColumn("at", F.locate("://", F.col("url")))
            .withColumn("rest", rest).withColumn("raw", host)
            .select("page_id", F.translate("raw", UPPER, LOWER).alias("host"),
                    F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), r"^[^?#]*", 0).alias("path"))
            .withColumn("key", reversed_host(F.col("host"))))


class _Open:
    """The rules of one host: verdict by path, and which path lengths there are."""

    def __init__(self, key: bytes):
        self.key, self.paths, self.sizes = key, {}, []

    def add(self, host: str, path: str, verdict: str) -> None:
        if path not in self.paths and len(path) not in self.sizes:
            bisect.insort(self.sizes, len(path))
        if path not in self.paths or verdict == "block":
            self.paths[path] = (len(host) + len(path), len(host), host + path, verdict)

    def longest(self, path: str):
        for n in reversed(self.sizes):
            if n <= len(path) and (rule := self.paths.get(path[:n])):
                return rule
        return None


SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow",
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict``; the verdict of a URL that
    no rule fits is ``default``, and its rule is null."""
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = materialize(
        url_parts(pages, id_col, url_col).withColumn("page_id", F.col("page_id").cast("long"))
        .repartitionByRange(parts, "key", "page_id").withColumn("part", F.spark_partition_id()), "urls")
    ranges = sorted((r["a"].encode(), r["b"].encode(), r["part"]) for r in
                    urls.groupBy("part").agg(F.min("key").alias("a"), F.max("key").alias("b")).collect())
    low, high = [r[0] for r in ranges], [r[1] for r in ranges]

    def copy(batches: Iterator[pa.RecordBatch]):
        """Rules to all partitions with a key in their interval."""
        for batch in batches:
            out = [[], [], [], [], []]
            for host, path, verdict, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = key.encode()
                first = bisect.bisect_left(high, raw)
                # Keys of the interval begin with the rule's key; 0xff ends it.
                last = bisect.bisect_right(low, raw + b"\xff")
                for _, _, part in ranges[first:last]:
                    for column, v in zip(out, (part, key, host, path, verdict), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), *(pa.array(c, pa.string()) for c in out[1:])],
                ["part", "key", "host", "path", "verdict"])

    copied = (rules.where("host is not null and path is not null and verdict is not null")
              .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
              .withColumn("key", reversed_host(F.col("host")))
              .mapInArrow(copy, "part int, key string, host string, path string, verdict string")
              .withColumn("page_id", F.lit(None).cast("long")).withColumn("kind", F.lit(0)))
    both = urls.withColumn("verdict", F.lit(None).cast("string")).withColumn("kind", F.lit(1)).unionByName(copied)

    def sweep(batches: Iterator[pa.RecordBatch]):
        stack: list[_Open] = []
        now = None
        for batch in batches:
            out = [[], [], [], [], []]
            for part, key, kind, page, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, stack = part, []
                raw = key.encode()
                while stack and not raw.startswith(stack[-1].key):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != raw:
                        stack.append(_Open(raw))
                    stack[-1].add(host, path, verdict)
                    continue
                fits = [rule for level in stack if (rule := level.longest(path))]
                _, _, rule, verdict = max(fits) if fits else (0, 0, None, default)
                for column, v in zip(out, (page, host, path, rule, verdict), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), *(pa.array(c, pa.string()) for c in out[1:])],
                ["page_id", "host", "path", "rule", "verdict"])

    return (both.select("part", "key", "kind", "page_id", "host", "path", "verdict")
            .repartition(parts, "part").sortWithinPartitions("part", "key", "kind").mapInArrow(sweep, SCHEMA))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
s AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM s),
rules(rh, rp, rv) AS (VALUES {_VALUES}),
best AS (
  SELECT p.page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict
  FROM p JOIN rules ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM p LEFT JOIN best ON p.page_id = best.page_id
"""
