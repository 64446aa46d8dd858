"""Incremental runs as streams: checkpoints hold what was read, tables hold what was seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH, LOTS = 50, (20, 20, 10)


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is neither in the seen table nor before in this batch (the smallest row stays)."""
    once = df.dropDuplicates(keys)
    return once.join(seen.select(*keys).distinct(), keys, "left_anti")


def lots(df: DataFrame, order: list[str], sizes: tuple[int, ...] = LOTS) -> DataFrame:
    """A batch of at most sum(sizes) rows in order, each with its lot."""
    from pyspark.sql import Window

    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    ranked = df.orderBy(*order).limit(ends[-1]).withColumn("rn", F.row_number().over(Window.orderBy(*order)))  # a bounded batch
    lot = F.lit(len(sizes))
    for i in range(len(sizes) - 1, 0, -1):
        lot = F.when(F.col("rn") <= ends[i - 1], i).otherwise(lot)
    return ranked.withColumn("lot", lot).drop("rn")


def scheduled_batch(pending: DataFrame, arrived: DataFrame, keys: list[str], limit: int = 50) -> DataFrame:
    """Items waiting and newly arrived, each once, with ``taken``: the next ``limit`` of them, those that wait first and then by key; the rest is carried over."""
    rows = pending.select(*keys, F.lit(0).alias("age")).unionByName(arrived.select(*keys, F.lit(1).alias("age"))).groupBy(*keys).agg(F.min("age").alias("age"))
    batch = rows.orderBy("age", *keys).limit(limit).select(*keys, F.lit(True).alias("taken"))  # so many at most
    return rows.join(batch, keys, "left").select(*keys, (F.col("age") == 0).alias("waited"), F.coalesce("taken", F.lit(False)).alias("taken"))


def run_available(stream: DataFrame, checkpoint: str, process: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process all files that are there now, batch by batch; a rerun goes on where the checkpoint stands."""
    query = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_unseen(target: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch function that appends new rows to a Parquet table; a repeated batch adds nothing."""

    def process(batch: DataFrame, batch_id: int) -> None:
        from ..sources.readers import exists

        spark = batch.sparkSession
        seen = spark.read.schema(batch.schema).parquet(target) if exists(spark, target) else spark.createDataFrame([], batch.schema)
        unseen(batch, seen, keys).write.mode("append").parquet(target)

    return process


def windowed_funnel(events: DataFrame, time: str, stage: Column, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: counts per stage and tumbling window, with a watermark; for batches and streams alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), stage.alias("stage")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "stage", "n")


def reserve(ledger: DataFrame, day: str, kind: str, limit: int, amount: int) -> DataFrame:
    """One row: what a budget has left for a day and kind, and whether ``amount`` may still be reserved."""
    used = F.coalesce(F.sum(F.when((F.col("day") == day) & (F.col("kind") == kind) & (F.col("state") != "released"), F.col("amount"))), F.lit(0))
    return ledger.agg(used.alias("used")).select("used", (F.lit(limit) - F.col("used")).alias("left"), (F.col("used") + amount <= limit).alias("granted"))


def succeeded(log: DataFrame, run_id: str) -> DataFrame:
    """Targets that a run has done; the rest is resumed by an anti-join."""
    return log.where((F.col("run_id") == run_id) & (F.col("status") == "succeeded")).select("target_id").distinct()


def eligible_new(arrived: DataFrame, processed: DataFrame, frozen: DataFrame, keys: list[str], key: str = "doc_id") -> DataFrame:
    """Arrivals that were not processed in this form (all of ``keys``) and whose document is not frozen; ones without text are left out, and of equal ones any stays."""
    return unseen(arrived.where("coalesce(trim(text), '') <> ''"), processed, keys).join(frozen.select(key).distinct(), key, "left_anti")
