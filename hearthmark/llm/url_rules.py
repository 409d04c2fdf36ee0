"""Block and allow rules for urls, by a sort-merge join of points with nested intervals.

1.  A host is written back to front with a dot after each label (``en.example.net`` is ``net.example.en.``), and the path
    follows. So a rule's host and all its subdomains are the keys that begin with the rule's reversed host: an interval.
    Two such intervals are nested or apart.
2.  Keys are dealt out by ranges. The cut points are quantiles of a sample of keys; each key carries a number of its row at
    the end, so that a host, or one url, that a third of all rows have is cut as well. A rule goes to every range that its
    interval meets: for all rules together that is one range each, and one more per cut point and label of it.
3.  Within a range, sorted by key, a sweep keeps the stack of the active rules' hosts, each with its paths. A url asks the
    hosts on the stack for their longest path that its own begins with. The longest rule wins, host and path together.

A task holds the stack: the paths of the rules of one host and those it lies in. Rows stream past.

Defined results: of equally long rules the one with the longer host wins; of equal rules block. A null url, or one without
``://``, has an empty host and path and meets no rule. Labels may be empty, and a port or user is part of its label, as the
host is all up to the path. A rule with a null host or path is no rule; without rules every url gets the default verdict.
Rows that repeat are rows of their own, an empty table gives no rows, and extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Host, path and verdict of the rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

DEFAULT = "allow"
SAMPLE = 16_384      # keys, on average, that the cut points are taken from
RANGES_PER_PARTITION = 2
RULES_SCHEMA = "host string, path string, verdict string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE, _URL = 0, 1


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, RULES_SCHEMA)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """Labels back to front, a dot after each; nothing for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit(".")))


def cut_points(keys: DataFrame, ranges: int, sample: int = SAMPLE) -> list[str]:
    """Sorted keys that part the rows into about ``ranges`` equal ranges; about ``sample`` keys reach the driver, by their hash."""
    share = sample / max(1, keys.count())
    some = keys if share >= 1 else keys.where(F.xxhash64("key", F.lit(1)) < int((2 * share - 1) * (1 << 63)))
    drawn = sorted(r.key for r in some.select("key").collect())
    return sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if drawn else []


def range_of(key: Column, cuts: list[str]) -> Column:
    """How many cut points are not above the key: a binary search in halving steps."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(c) for c in cuts])
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]

    def step(at: Column, by: Column) -> Column:
        reach = at + by
        return F.when((reach <= len(cuts)) & (F.get(table, reach - 1) <= key), reach).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


class Stack:
    """Hosts of the active rules, outermost first, each with its paths."""

    def __init__(self) -> None:
        self.range: int | None = None
        self.active: list[tuple[str, dict[str, str], set[int]]] = []

    def move(self, to: int, key: str) -> None:
        """Leave the rules that neither the range nor the key belongs to any more."""
        if to != self.range:
            self.range, self.active = to, []
        while self.active and not key.startswith(self.active[-1][0]):
            self.active.pop()

    def enter(self, host: str, path: str, verdict: str) -> None:
        if not self.active or self.active[-1][0] != host:
            self.active.append((host, {}, set()))
        _, paths, lengths = self.active[-1]
        paths[path] = "block" if "block" in (verdict, paths.get(path)) else verdict
        lengths.add(len(path))

    def longest(self, path: str) -> tuple[str, str, str] | None:
        """Reversed host, path and verdict of the longest rule that fits."""
        best, length = None, -1
        for host, paths, lengths in reversed(self.active):
            for n in sorted(lengths, reverse=True):
                if n <= len(path) and path[:n] in paths:
                    if len(host) + n > length:
                        best, length = (host, path[:n], paths[path[:n]]), len(host) + n
                    break
        return best


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """range, key, kind, host key, path, verdict, nth in order of range, key and kind -> nth, host key and path of the rule, verdict."""
    stack = Stack()
    for batch in batches:
        out = []
        for in_range, key, kind, host_key, path, verdict, nth in zip(*(c.to_pylist() for c in batch.columns)):
            stack.move(in_range, key)
            if kind == _RULE:
                stack.enter(host_key, path, verdict)
            else:
                found = stack.longest(path)
                out.append((nth, *(found or (None, None, None))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.struct(_row_type(batch)), pa.string(), pa.string(), pa.string()))],
                                             ["row", "rule_host", "rule_path", "rule_verdict"])


def _row_type(batch: pa.RecordBatch) -> list[pa.Field]:
    return list(batch.schema.field("row").type)


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule (host and path of the longest that fits, or null), verdict of every row."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.struct(F.col("page_id"), host.alias("host"), path.alias("path")).alias("row"))
    host_key = reversed_host(F.col("row.host"))
    # the row's number after a character that sorts first: equal urls lie side by side and may still be parted
    number = F.hex(F.xxhash64(F.col("row.page_id"), F.monotonically_increasing_id()))
    keys = urls.select("row", F.concat(host_key, F.col("row.path"), F.lit("\x01"), number).alias("key"))
    ranges = ranges or RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = cut_points(keys, ranges)

    points = keys.select(range_of(F.col("key"), cuts).alias("range"), "key", F.lit(_URL).alias("kind"), F.lit(None).cast("string").alias("host_key"), F.col("row.path").alias("path"),
                         F.lit(None).cast("string").alias("verdict"), "row")
    named = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        reversed_host(F.translate("host", _UPPER, _LOWER)).alias("host_key"), "path", "verdict")
    # the interval ends where the last dot would be the next character
    end = F.concat(F.expr("left(host_key, length(host_key) - 1)"), F.lit("/"))
    spread = named.where("host_key <> ''").select(F.explode(F.sequence(range_of(F.col("host_key"), cuts), range_of(end, cuts))).alias("range"),
                                                  F.col("host_key").alias("key"), F.lit(_RULE).alias("kind"), "host_key", "path", "verdict",
                                                  F.lit(None).cast(keys.schema["row"].dataType).alias("row"))
    dealt = points.unionByName(spread).repartition(ranges, "range").sortWithinPartitions("range", "key", "kind")
    row = keys.schema["row"].dataType.simpleString()
    swept = dealt.mapInArrow(_sweep, f"row {row}, rule_host string, rule_path string, rule_verdict string")
    shown = F.concat(F.array_join(F.reverse(F.split(F.expr("left(rule_host, length(rule_host) - 1)"), "\\.", -1)), "."), F.col("rule_path"))
    return swept.select("row.page_id", "row.host", "row.path", shown.alias("rule"), F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


def kept(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """The ids of pages that may stay."""
    return judged(pages, rules, default).where("verdict = 'allow'").select("page_id")


def oracle_sql(rules: list[tuple[str, str, str]] = RULES, default: str = DEFAULT, source: str = "pages") -> str:
    """All rules against all urls."""
    listed = " UNION ALL ".join(f"SELECT '{h}' AS rule_host, '{p}' AS rule_path, '{v}' AS rule_verdict" for h, p, v in rules)
    host = reduce(lambda sql, pair: f"replace({sql}, '{pair[0]}', '{pair[1]}')", zip(_UPPER, _LOWER), "regexp_extract(rest, '^[^/?#]*')")
    return f"""
    WITH rules AS ({listed}),
    urls AS (SELECT row_number() OVER () AS nth, page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {source}),
    cut AS (SELECT nth, page_id, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
    fits AS (SELECT nth, first(r ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC, rule_verdict DESC) AS best
        FROM cut JOIN rules r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY nth)
    SELECT page_id, host, path, best.rule_host || best.rule_path AS rule, coalesce(best.rule_verdict, '{default}') AS verdict FROM cut LEFT JOIN fits USING (nth)"""
