"""Product offers, failures and the work list as table transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthmark.operators.market import ts
from hearthmark.operators.merge import last_rows, merge
from hearthmark.operators.skew import latest_by


def latest_offers(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Newest offer per active product."""
    last = latest_by(offers, ["product_id"], ["collected_at", "price_minor"])
    return products.where("is_active").withColumnRenamed("id", "product_id").join(last, "product_id")


def facet(products: DataFrame, brand: str | None = None, category: str | None = None, path: str = "category_path") -> DataFrame:
    if brand is not None:
        products = products.where(F.col("brand") == brand)
    if category is not None:
        products = products.where(F.array_contains(path, category))
    return products


def failure_summary(failures: DataFrame, runs: DataFrame) -> DataFrame:
    """Failures per run and error type, and how many are still unresolved."""
    per = failures.groupBy("run_id", "error_type").agg(
        F.count(F.lit(1)).alias("failures"), F.count_if(F.col("resolved_at").isNull()).alias("unresolved"),
        F.max("failed_at").alias("last_failure"))
    return runs.select(F.col("id").alias("run_id"), "source_id").join(per, "run_id")


# States of a work item that may be taken.
OPEN_TASKS = ("pending", "retrying")


def merge_tasks(tasks: DataFrame, incoming: DataFrame, as_of: str) -> DataFrame:
    """Work list after new requests: url, priority and metadata are replaced, progress is kept."""
    return merge(tasks, incoming, ["source", "external_id"], overwrite=["url", "priority", "metadata"],
                 set_on_insert={"status": F.lit("pending"), "retry_count": F.lit(0), "created_at": ts(as_of)})


def next_batch(tasks: DataFrame, n: int) -> DataFrame:
    return (tasks.where(F.col("status").isin(*OPEN_TASKS))
            .orderBy(F.desc("priority"), F.asc("created_at"), "source", "external_id").limit(n))


def transition(tasks: DataFrame, outcomes: DataFrame, as_of: str, order: Sequence[str] = ()) -> DataFrame:
    """Apply one outcome per task: ok completes; a failure retries while allowed, else fails.

    ``outcomes``: source, external_id, ok, retry, error; of several for one task the last along ``order`` counts.
    """
    outcomes = last_rows(outcomes, ["source", "external_id"], order)
    o = outcomes.select("source", "external_id", F.struct("ok", "retry", "error").alias("_o"))
    j = tasks.join(o, ["source", "external_id"], "left")
    hit, ok = F.col("_o").isNotNull(), F.col("_o.ok")
    again = F.col("_o.retry") & (F.col("retry_count") < F.col("max_retries"))
    return (j.withColumn("_status", F.when(~hit, F.col("status")).when(ok, "completed").when(again, "retrying").otherwise("failed"))
            .withColumn("completed_at", F.when(hit & (ok | ~again), ts(as_of)).otherwise(F.col("completed_at")))
            .withColumn("error_message", F.when(hit & ~ok, F.col("_o.error")).otherwise(F.col("error_message")))
            .withColumn("retry_count", F.when(hit & ~ok, F.col("retry_count") + 1).otherwise(F.col("retry_count")))
            .withColumn("status", F.col("_status")).drop("_status", "_o"))


def task_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count(F.lit(1)).alias("cnt"))
