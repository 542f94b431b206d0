"""Status events as a stream, folded to the last state of each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def last_states(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """key, state and n_events; the same for a stream (in complete or update mode) and for a table."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count("*").alias("n_events"))


def deduplicated(events: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """events without repetitions that come within the delay; state beyond the watermark is dropped."""
    timed = events.withColumn(ts, F.to_timestamp_ltz(ts))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def fold_into_table(events: DataFrame, key: str, state: str, order: list[str], folder: str) -> DataFrame:
    """key, state and n_events of a stream of events, read to its end.

    Each micro-batch is folded by itself and added to a table under folder, one row for each key; the table is folded
    again when it is read, so neither the state store nor the driver holds the keys. A micro-batch that is run again after a failure
    replaces what it wrote before.
    """
    spark = events.sparkSession

    def step(batch: DataFrame, epoch: int) -> None:
        part = batch.groupBy(key).agg(F.max(F.struct(*order, F.col(state).alias("state"))).alias("last"), F.count("*").alias("n"))
        part.write.mode("overwrite").parquet(f"{folder}/states/epoch={epoch}")

    events.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(f"{folder}/states")
    return kept.groupBy(key).agg(F.max("last").getField("state").alias("state"), F.sum("n").alias("n_events"))


def on_completion(states: DataFrame, done: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Calls done with the keys that reached a terminal state in each micro-batch; every is the poll interval, None runs once."""

    def step(batch: DataFrame, epoch: int) -> None:
        done(batch.where(F.col("state").isin("done", "failed")), epoch)

    writer = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def poll(ask: Callable[[], str], timeout: float = 1800, interval: float = 3, clock: Callable[[], float] | None = None, sleep: Callable[[float], None] | None = None) -> tuple[str, bool]:
    """Asks until the state is terminal or the time is over, and whether it was; the time is looked at after an answer."""
    import time

    clock, sleep = clock or time.monotonic, sleep or time.sleep
    end = clock() + timeout
    while True:
        state = ask()
        if state in ("done", "failed"):
            return state, False
        if clock() >= end:
            return state, True
        sleep(interval)
