"""Probe fan-out as a stream (R5, S7, D6): each tick sends one request to every
server that is monitored at that time.

Ticks come from Spark's rate-per-micro-batch source, one row a batch, so the
time of a tick follows from its row and a replayed batch has the same tick.
Each batch loads the monitored set anew and so sees the registry's newest version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.messages import probe_request_json
from pulsegrid.functions.timefmt import ts_literal

_OUT = "tick timestamp_ntz, value string, batch_id long"
_LONGEST_ADVANCE = (1 << 31) - 1  # milliseconds, the source's own limit (24.8 days)


def tick_source(spark: SparkSession, start_millis: int, cycle_millis: int) -> DataFrame:
    """Ticks ``timestamp`` from ``start_millis`` (UTC, epoch), one per batch.

    The source takes advances of up to ``_LONGEST_ADVANCE`` only; the ticks of
    a longer cycle are computed from their number, which it counts as well."""
    long_cycle = cycle_millis > _LONGEST_ADVANCE
    ticks = (spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1)
             .option("startTimestamp", start_millis)
             .option("advanceMillisPerBatch", 1 if long_cycle else cycle_millis).load())
    if long_cycle:
        ticks = ticks.withColumn("timestamp", F.timestamp_millis(F.lit(start_millis) + F.col("value") * cycle_millis))
    return ticks


def fan_out_writer(monitored: Callable[[DataFrame], DataFrame], out_path: str):
    """foreachBatch function. ``monitored(tick)`` returns the servers to probe,
    given the batch's tick as a one-row frame (tick), with a ``tick`` column."""
    def write(batch: DataFrame, batch_id: int) -> None:
        ticks = batch.select(F.to_timestamp_ntz(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS")).alias("tick"))
        rows = monitored(ticks).select("tick", probe_request_json("server_id", "server_name", "ipv4").alias("value"))
        rows.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
    return write


def start_fan_out(ticks: DataFrame, monitored: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str,
                  available_now: bool = True, processing_time: str = "60 seconds"):
    """With ``available_now`` one tick, then it stops; else one per trigger."""
    w = ticks.writeStream.foreachBatch(fan_out_writer(monitored, out_path)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def at_tick(servers: Callable[[], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """The active servers of the version that ``servers()`` reads at the tick."""
    def monitored(ticks: DataFrame) -> DataFrame:
        tick = ticks.first()["tick"]  # one row
        return servers().where(~F.col("is_deleted")).withColumn("tick", ts_literal(tick))
    return monitored


def read_fan_out(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.schema(_OUT).parquet(out_path).select("tick", "value")
