"""Message-log stand-in: a folder of JSON-lines files of (seq, value).

``seq`` plays the role of the Kafka offset (arrival order). On a cluster
with the Kafka package use ``kafka_source`` / ``kafka_sink`` instead; the
rest of each stream is unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import schemas as S
from pulsegrid.session import path_exists


def file_source(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """All new files a trigger, or at most ``max_files_per_trigger``."""
    r = spark.readStream.schema(S.MESSAGE_LOG)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def latest_start(spark: SparkSession, path: str, checkpoint: str) -> int:
    """Number of the last message in the log when the stream with this
    checkpoint first started (-1: none), as ``startingOffsets=latest`` does. It
    is kept beside the checkpoint, so a restart goes on where the stream was."""
    place = f"{checkpoint.rstrip('/')}-start"
    if not path_exists(spark, place):
        log = (spark.read.schema(S.MESSAGE_LOG).json(path) if path_exists(spark, path)
               else spark.createDataFrame([], S.MESSAGE_LOG))
        log.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("seq")).write.parquet(place)
    return spark.read.schema("seq long").parquet(place).first()["seq"]


def file_source_from_latest(spark: SparkSession, path: str, checkpoint: str,
                            max_files_per_trigger: int | None = None) -> DataFrame:
    """The messages that come after the stream's first start."""
    start = latest_start(spark, path, checkpoint)
    return file_source(spark, path, max_files_per_trigger).where(F.col("seq") > start)


def publish_files(messages: DataFrame, path: str) -> None:
    """Append (seq, value) messages as JSON lines: one job, all tasks write.

    Files hold ranges of ``seq``; how many there are follows the size of the
    data. The streams do not rely on the order in which files are read.
    """
    messages.repartitionByRange("seq").write.mode("append").json(path)


def kafka_source(spark: SparkSession, servers: str, topic: str,
                 max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Kafka topic as (seq, value); needs the spark-sql-kafka package."""
    raw = (spark.readStream.format("kafka")
           .option("kafka.bootstrap.servers", servers).option("subscribe", topic)
           .option("startingOffsets", "latest"))
    if max_offsets_per_trigger:
        raw = raw.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    raw = raw.load()
    # offsets are per partition; (offset, partition) orders arrival within one
    seq = F.col("offset") * F.lit(1 << 16) + F.col("partition")
    return raw.select(seq.alias("seq"), F.col("value").cast("string").alias("value"))


def kafka_sink(messages: DataFrame, servers: str, topic: str) -> None:
    """Publish a batch of ``value`` messages (K3); needs the Kafka package."""
    (messages.select(F.col("value").cast("string").alias("value")).write.format("kafka")
     .option("kafka.bootstrap.servers", servers).option("topic", topic).save())
