"""Target lists in, snapshots and ordered details out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthmark.operators.skew import ranked


def parse_targets(lines: DataFrame, source: str, priority: int = 0) -> DataFrame:
    """'url' or 'url,external id' lines; blanks and # comments are skipped.

    A line without an id gets one from its URL (a line number would not survive a parallel read).
    """
    v = F.trim("value")
    parts = F.split(v, ",")
    url = F.trim(F.get(parts, F.lit(0)))
    given = F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit(""))
    return lines.where((v != "") & ~v.startswith("#")).select(
        F.lit(source).alias("source"), F.coalesce(given, F.concat(F.lit("product-"), F.substring(F.md5(url), 1, 12))).alias("external_id"),
        url.alias("url"), F.lit(priority).alias("priority")).dropDuplicates(["source", "external_id"])


def read_targets(spark: SparkSession, path: str, source: str, priority: int = 0) -> DataFrame:
    return parse_targets(spark.read.text(path), source, priority)


def write_snapshot(df: DataFrame, path: str, date_col: str = "date") -> None:
    """Replace exactly the days present in ``df``; other days stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(path)


def collect_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], bucket: Column, page: int) -> DataFrame:
    """Nested JSON arrays of a key's rows in order, in pages of at most ``page`` items.

    Small keys come as one page; a key of any size stays whole over several pages.
    """
    r = ranked(df, keys, order, bucket, "_pos")
    r = r.withColumn("page", F.floor((F.col("_pos") - 1) / page))
    items = F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.struct(*fields).alias("item")))), lambda x: x["item"])
    return r.groupBy(*keys, "page").agg(F.count(F.lit(1)).alias("items"), F.to_json(items).alias("json"))
