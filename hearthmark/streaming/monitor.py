"""Continuous forms of the monitor: price changes, ingest counters, enrichment with price levels.

Sinks write one folder per micro-batch and overwrite it on a replay, so a restarted query
never doubles its output.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hearthmark.operators.monitor import good_deals
from hearthmark.operators.skew import latest_by
from hearthmark.session import shared_folder

CHANGE_SCHEMA = "id long, seen_at timestamp, price double, old_price double, change string"
STATE_SCHEMA = "last_at timestamp, last_price double, open_at array<timestamp>, open_price array<double>"


def _events(before: float | None, points: list[tuple]) -> dict[tuple, tuple]:
    """(old price, NEW or PRICE_CHANGE) of the points that change something; ``points`` are in order."""
    found = {}
    for at, price in points:
        if before is None or price != before:
            found[at, price] = (before, "NEW" if before is None else "PRICE_CHANGE")
        before = price
    return found


def price_changes(offers: DataFrame, watermark: str = "1 day", ttl: str | None = None) -> DataFrame:
    """NEW / PRICE_CHANGE events of a stream of (id, seen_at, price), keyed by those three.

    A point may arrive late, as long as it is younger than the watermark: then the events that it alters are sent again,
    and one that no longer holds is sent with a NULL change. So the last row per key (``last_state``) does not depend on
    how the input was cut into batches. State per id: the newest point the watermark has passed, and the points after it.
    Exact repeats are dropped first. With ``ttl`` an id not seen for so long is forgotten, and would be NEW again.
    """
    ttl_ms = None if ttl is None else int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_at, last_price, open_at, open_price = state.get if state.exists else (None, None, [], [])
        known = [(pd.Timestamp(t), p) for t, p in zip(open_at, open_price)]
        told = _events(last_price, known)
        points = set(known)
        for rows in batches:
            points.update(zip(rows.seen_at, rows.price))
        points = sorted(points)
        events = _events(last_price, points)
        news = [(t, p, *events.get((t, p), (None, None))) for t, p in points if events.get((t, p)) != told.get((t, p))]
        passed = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        settled = [x for x in points if x[0] <= passed]
        if settled:
            last_at, last_price = settled[-1]
        rest = points[len(settled):]
        state.update((last_at, last_price, [t.to_pydatetime() for t, _ in rest], [float(p) for _, p in rest]))
        if ttl_ms is not None:
            newest = int((points[-1][0] if points else pd.Timestamp(last_at)).timestamp() * 1000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs() + 1) + ttl_ms)
        if news:
            out = pd.DataFrame(news, columns=["seen_at", "price", "old_price", "change"])
            yield out.assign(id=key[0], old_price=out.old_price.astype(float))[["id", "seen_at", "price", "old_price", "change"]]

    clean = (offers.select("id", F.col("seen_at").cast("timestamp").alias("seen_at"), "price").withWatermark("seen_at", watermark)
             .dropDuplicatesWithinWatermark(["id", "seen_at", "price"]))
    timeout = GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.EventTimeTimeout
    return clean.groupBy("id").applyInPandasWithState(step, CHANGE_SCHEMA, STATE_SCHEMA, "append", timeout)


def hourly_counters(offers: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Arrivals per hour of event time."""
    e = offers.select(F.col("seen_at").cast("timestamp").alias("seen_at")).withWatermark("seen_at", watermark)
    return e.groupBy(F.window("seen_at", "1 hour")).agg(F.count(F.lit(1)).alias("arrivals")).select(
        F.col("window.start").alias("hour"), "arrivals")


def enrich(offers: DataFrame, stats: DataFrame) -> DataFrame:
    """Offers of a stream beside the price level of their district and rooms, and the deal flag."""
    return good_deals(offers, stats)


def work_folder(spark: SparkSession) -> str:
    """New folder for one query, below the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{os.urandom(6).hex()}"


def run_available(df: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process everything the source holds now and return what was written, with its ``batch``."""
    spark = df.sparkSession
    folder = folder or work_folder(spark)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    q = (df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).start())
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(df.schema.add("batch", "long")).parquet(f"{folder}/out")


def last_state(written: DataFrame, keys: list[str]) -> DataFrame:
    """Final row per key of an update-mode query."""
    return latest_by(written, keys, ["batch"]).drop("batch")
