"""Streaming queries over the events table, run to the end of what is there."""

from pyspark.sql import functions as F

from hearthmark.operators import monitor
from hearthmark.plans.q_market import r
from hearthmark.plans.registry import query, snippet
from hearthmark.streaming import monitor as stream


def offers(t):
    """Events as offers: id, instant, price, district and rooms."""
    raw = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return raw.select(F.col("user_id").alias("id"), F.col("ts").alias("seen_at"), F.col("value").alias("price"), F.col("event_type").alias("district"),
                      (F.col("user_id") % 4).cast("int").alias("rooms"), "event_id")


PRICE_CHANGES = """
    SELECT id, seen_at, price, old_price, CASE WHEN rn = 1 THEN 'NEW' ELSE 'PRICE_CHANGE' END AS change FROM (
        SELECT user_id AS id, ts AS seen_at, value AS price, lag(value) OVER w AS old_price, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value))
    WHERE rn = 1 OR old_price <> price"""


def standing_changes(written):
    """Events that hold after all batches."""
    return stream.last_state(written, ["id", "seen_at", "price"]).where("change IS NOT NULL").withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))


@query("stream_price_changes", PRICE_CHANGES)
def _(t):
    return standing_changes(stream.run_available(stream.price_changes(offers(t).select("id", "seen_at", "price"))))


@query("stream_price_changes_late", PRICE_CHANGES)
def _(t):
    """The same events in several batches, every third one a batch late."""
    folder = stream.work_folder(t.spark)
    e = t.events.select(F.col("user_id").alias("id"), F.col("ts").alias("seen_at"), F.col("value").alias("price"))
    late = F.pmod(F.xxhash64("id", "seen_at"), F.lit(3)) == 0
    for k, part in enumerate((e.where(~late), e.where(late))):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in/part={k}")
    raw = t.spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    # the delay covers the whole table: what comes a batch late is never too late
    return standing_changes(stream.run_available(stream.price_changes(raw, "100000 days"), folder=folder))


@query("stream_hourly_counters", "SELECT date_trunc('hour', ts) AS hour, count(*) AS arrivals FROM events GROUP BY 1")
def _(t):
    out = stream.last_state(stream.run_available(stream.hourly_counters(offers(t)), "update"), ["hour"])
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


snippet("event_stats", """
    SELECT event_type AS district, CAST(user_id % 4 AS INT) AS rooms, quantile_cont(value, 0.5) AS median_price, quantile_cont(value, 0.25) AS p25_price
    FROM events WHERE value > 0 GROUP BY 1, 2 HAVING count(*) >= 5""")


@query("stream_enriched", """
    SELECT event_id, coalesce(user_id % 4 <> 0 AND value > 0 AND value < p25_price, false) AS is_good_deal,
           round(CASE WHEN user_id % 4 <> 0 AND value > 0 AND value < p25_price THEN (1 - value / median_price) * 100 END, 4) AS discount_pct
    FROM events LEFT JOIN event_stats s ON s.district = event_type AND s.rooms = user_id % 4""")
def _(t):
    known = t.events.select(F.col("event_type").alias("district"), (F.col("user_id") % 4).cast("int").alias("rooms"), F.col("value").alias("price"),
                            F.lit(50.0).alias("area_total"), F.lit(True).alias("is_active"), F.lit(False).alias("is_error"))
    out = stream.run_available(stream.enrich(offers(t), monitor.deal_stats(known)))
    return r(out.select("event_id", "is_good_deal", "discount_pct"))
