"""Band joins: what lies within a reach of a whole number, per key, without a window over the whole key.

The line of numbers is cut into bins of twice the reach. Whatever a row can reach lies in its own bin and in the nearer
one of the two beside it, so every row is sent to these two and is answered in its own. A bin holds at most as many rows as
there are numbers in it, once rows are reduced to one per key and number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def with_bins(df: DataFrame, at: str, reach: int) -> DataFrame:
    """Each row in its own bin (``_own``) and in the nearer one beside it; column ``_bin``."""
    width = 2 * reach
    own = F.floor(F.col(at) / width).cast("long")
    beside = F.when(F.col(at) - own * width < reach, own - 1).otherwise(own + 1)
    both = F.array(F.struct(own.alias("bin"), F.lit(True).alias("own")), F.struct(beside.alias("bin"), F.lit(False).alias("own")))
    return df.withColumn("_b", F.explode(both)).select(*df.columns, F.col("_b.bin").alias("_bin"), F.col("_b.own").alias("_own"))


def within(df: DataFrame, keys: Sequence[str], at: str, reach: int, found: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``df`` (one row per keys and ``at``, a whole number) with one column per entry of ``found``.

    An entry is (aggregate of the rows below, aggregate of the rows above) of those whose ``at`` differs by 1 to ``reach``;
    the column is a struct of ``below`` and ``above``.
    """
    sides = Window.partitionBy(*keys, "_bin").orderBy(at)
    below, above = sides.rangeBetween(-reach, -1), sides.rangeBetween(1, reach)
    cols = [_both(low, below, high, above).alias(name) for name, (low, high) in found.items()]
    return with_bins(df, at, reach).select(*df.columns, "_own", *cols).where("_own").drop("_own")


def _both(low: Column, below: WindowSpec, high: Column, above: WindowSpec) -> Column:
    return F.struct(low.over(below).alias("below"), high.over(above).alias("above"))
