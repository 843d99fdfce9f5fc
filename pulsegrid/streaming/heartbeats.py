"""Heartbeat streams.

Source: a message log. With Kafka on the classpath use
``heartbeat_kafka_source``; the test stand-in is a folder of JSON-lines
files ``{"seq": <offset>, "value": "<message>"}`` read with the file source.

* ``start_archive``  history append (K1): decoded heartbeats -> Parquet
  partitioned by ``dt`` through the built-in file sink, whose metadata log
  makes each micro-batch exactly-once (a replayed batch is not duplicated).
* ``start_status``   current status (R2, K2): each micro-batch is reduced to
  the latest heartbeat per server and written, idempotently, to
  ``status_log/stream=<id>/batch_id=<n>``. ``compact_status`` folds the log
  into a new registry snapshot and removes what it folded; ``status_view``
  reads the snapshot and the newer batches. ``compact_status_buckets`` folds
  it into a registry laid out by id, rewriting the touched buckets alone.
  Per-batch work is proportional to the batch, never to the registry.
* ``start_status_changes``  the same with keyed state: a batch emits only the
  servers whose status has changed.
* ``start_daily``    daily uptime (R6): each micro-batch writes its partial
  sums per day and server, which are merged level by level; the report adds
  them up, late messages included.

Every query checkpoints offsets and state in ``checkpointLocation`` (R4);
``trigger(availableNow=True)`` drains what is there and stops (R3).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid import schemas as S
from pulsegrid.session import drop_dir, list_dir, path_exists
from pulsegrid.streaming import log, snapshots
from pulsegrid.functions.messages import decode_heartbeats, heartbeat_json
from pulsegrid.operators.heartbeats import latest_status
from pulsegrid.operators.registry import apply_status
from pulsegrid.operators.uptime import top_per_day


# ---------------------------------------------------------------- sources

def heartbeat_file_source(spark: SparkSession, path: str, max_files_per_trigger: int | None = None
                          ) -> DataFrame:
    """Message log stand-in: JSON-lines files of (seq, value)."""
    return log.file_source(spark, path, max_files_per_trigger)


def heartbeat_kafka_source(spark: SparkSession, servers: str, topic: str,
                           max_offsets_per_trigger: int | None = None) -> DataFrame:
    return log.kafka_source(spark, servers, topic, max_offsets_per_trigger)


def write_message_files(heartbeats: DataFrame, path: str) -> None:
    """Publish heartbeats (seq, server_id, status, ts) as worker messages."""
    log.publish_files(heartbeats.select("seq", heartbeat_json().alias("value")), path)


# ---------------------------------------------------------------- K1 archive

def archive_frame(messages: DataFrame, dedup_within: str | None = None) -> DataFrame:
    """Decoded heartbeats with their day.

    With ``dedup_within`` (e.g. '1 hour') a message redelivered by the log
    (same ``seq``) is written once, with state bounded by the watermark --
    but any message arriving later than that delay is then dropped as late.
    The lossless route is the default (no stream dedup) followed by
    ``compact_archive_days``, which removes copies exactly: a redelivered
    message carries the same timestamp, so it lands in the same day."""
    hb = decode_heartbeats(messages)
    if dedup_within:
        hb = (hb.withColumn("_et", F.col("ts").cast("timestamp"))
                .withWatermark("_et", dedup_within)
                .dropDuplicatesWithinWatermark(["seq"])
                .drop("_et"))
    return hb.withColumn("dt", F.to_date("ts"))


def start_archive(messages: DataFrame, sink: str, checkpoint: str,
                  available_now: bool = True, processing_time: str = "1 second",
                  dedup_within: str | None = None):
    w = (archive_frame(messages, dedup_within).writeStream.format("parquet")
         .option("path", sink).option("checkpointLocation", checkpoint)
         .partitionBy("dt").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


SEQ_BUCKET = 1 << 16  # numbers of a bucket of the archived ranges
_RANGES = "first long, last long"


def _ranges(rows: DataFrame) -> DataFrame:
    """The runs of consecutive ``seq`` as (first, last), cut at buckets: a run
    is found inside a bucket, so no task sees more than one bucket's numbers."""
    seqs = rows.select("seq", F.floor(F.col("seq") / SEQ_BUCKET).alias("bucket")).distinct()
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("seq"))
    return (seqs.withColumn("run", F.col("seq") - place).groupBy("bucket", "run")
            .agg(F.min("seq").alias("first"), F.max("seq").alias("last")).select("first", "last"))


def once_writer(sink: str):
    """foreachBatch function: appends the heartbeats of a batch whose ``seq``
    the archive does not have yet, each once, to the batch's own folder, and
    then the ranges of their numbers to the folder of the ranges.

    Redelivered messages add nothing, late ones all they bring, without a
    delay and without state that grows with the messages: the ranges of a log
    that is read in order are few. A batch that is replayed, whole or after a
    stop between the two writes, rewrites its own two folders and does not
    count its own ranges as archived.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, f"stream={stream_id(batch)}/batch_id={batch_id}"
        rows = batch.withColumn("bucket", F.floor(F.col("seq") / SEQ_BUCKET))
        if path_exists(spark, f"{sink}/ranges"):
            have = (spark.read.schema(f"{_RANGES}, stream string, batch_id long").parquet(f"{sink}/ranges")
                    .where((F.col("stream") != stream_id(batch)) | (F.col("batch_id") != batch_id))
                    .withColumn("bucket", F.floor(F.col("first") / SEQ_BUCKET)).select("bucket", "first", "last"))
            rows = rows.join(have, (rows["bucket"] == have["bucket"]) & (rows["seq"] >= have["first"])
                             & (rows["seq"] <= have["last"]), "left_anti")
        new = rows.drop("bucket").dropDuplicates(["seq"])
        path = f"{sink}/rows/{own}"
        new.write.mode("overwrite").partitionBy("dt").parquet(path)
        stored = spark.read.schema("seq long, dt date").parquet(path)
        _ranges(stored).write.mode("overwrite").parquet(f"{sink}/ranges/{own}")
    return write


def start_archive_once(messages: DataFrame, sink: str, checkpoint: str,
                       available_now: bool = True, processing_time: str = "1 second"):
    """History append that a redelivered log does not double (K1)."""
    w = (archive_frame(messages).writeStream.foreachBatch(once_writer(sink))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def read_archive_once(spark: SparkSession, sink: str) -> DataFrame:
    """(seq, server_id, status, ts, dt) of the archive of ``start_archive_once``."""
    rows = spark.read.schema("seq long, server_id string, status string, ts timestamp_ntz, stream string, "
                             "batch_id long, dt date").parquet(f"{sink}/rows")
    return rows.select("seq", "server_id", "status", "ts", "dt")


def write_history(heartbeats: DataFrame, path: str, max_records_per_file: int = 5_000_000,
                  replace: str = "all") -> None:
    """Batch layout of the history: Parquet partitioned by ``dt`` and, inside
    each day, clustered by server.

    Rows are range-partitioned on (dt, server_id, ts) and sorted that way, so
    every file holds a narrow band of servers: a report's partial aggregate
    collapses each file to a few rows before the shuffle (with arrival order
    every task would see nearly every server), Parquet min/max statistics on
    ``server_id`` skip row groups for per-server reads, and a server holding a
    third of all rows still spreads over several tasks (split on ``ts``).

    ``replace='all'`` rewrites the table; ``'days'`` replaces only the days
    present in ``heartbeats`` (dynamic partition overwrite), which is how the
    streamed archive (arrival order, small files) is compacted day by day.
    """
    out = heartbeats.withColumn("dt", F.to_date("ts"))
    w = (out.repartitionByRange("dt", "server_id", "ts")
         .sortWithinPartitions("dt", "server_id", "ts")
         .write.mode("overwrite").partitionBy("dt")
         .option("maxRecordsPerFile", max_records_per_file))
    if replace == "days":
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def compact_archive_days(spark: SparkSession, archive: str, history: str, days: list,
                         dedup: bool = True) -> None:
    """Rewrite the given days of the streamed archive into the clustered
    history table (only those day partitions are replaced). Redelivered
    copies of a message (same ``seq``) are kept once."""
    src = read_archive(spark, archive).where(F.col("dt").isin(list(days)))
    if dedup:
        src = src.dropDuplicates(["seq"])
    write_history(src.drop("dt"), history, replace="days")


def read_archive(spark: SparkSession, sink: str) -> DataFrame:
    """History as written by the archive: (seq, server_id, status, ts, dt)."""
    return spark.read.parquet(sink).select("seq", "server_id", "status", "ts",
                                           F.col("dt").cast("date").alias("dt"))


# ---------------------------------------------------------------- R2/K2 status

def stream_id(batch: DataFrame) -> str:
    """Id of the running query, which its checkpoint keeps over restarts; a
    query with a new checkpoint has another and counts its batches from 0."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def status_batch_writer(log_path: str):
    """foreachBatch function: compact one micro-batch and write it to the
    folder of its stream and number (overwrite -> a replayed batch rewrites
    the same data)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        latest_status(batch).write.mode("overwrite").parquet(
            f"{log_path}/stream={stream_id(batch)}/batch_id={batch_id}")
    return write


def start_status(messages: DataFrame, log_path: str, checkpoint: str,
                 available_now: bool = True, processing_time: str = "1 second"):
    hb = decode_heartbeats(messages)
    w = (hb.writeStream.foreachBatch(status_batch_writer(log_path))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


STATUS_LOG = ("server_id string, status string, last_ping_at timestamp_ntz, seq long, stream string, "
              "batch_id long")


def read_status_log(spark: SparkSession, log_path: str, folded: dict[str, int] | None = None) -> DataFrame:
    """Logged batches, of each stream those above its number in ``folded``;
    none if nothing has been logged yet."""
    if not path_exists(spark, log_path):
        return spark.createDataFrame([], STATUS_LOG)
    rows = spark.read.schema(STATUS_LOG).parquet(log_path)
    for stream, last in (folded or {}).items():
        rows = rows.where((F.col("stream") != stream) | (F.col("batch_id") > last))
    return rows


def logged_batches(spark: SparkSession, log_path: str) -> dict[str, list[int]]:
    """The numbers of the batches in the log, by stream (folder names only)."""
    return {name.removeprefix("stream="): sorted(
                int(b.removeprefix("batch_id=")) for b in list_dir(spark, f"{log_path}/{name}")
                if b.startswith("batch_id="))
            for name in list_dir(spark, log_path) if name.startswith("stream=")}


def current_status(servers: DataFrame, status_log: DataFrame) -> DataFrame:
    """Registry with every logged status applied: the global latest per
    server by (last_ping_at, seq) over all batches, then the update join.
    Equal to folding the batches one by one, whatever the split."""
    hb = status_log.select("server_id", "status", F.col("last_ping_at").alias("ts"), "seq")
    return apply_status(servers, latest_status(hb))


def compact_status(spark: SparkSession, servers: DataFrame, log_path: str, snapshots_root: str,
                   version: int) -> None:
    """Fold the log into the registry and write it as snapshot ``version``.

    The registry is the current snapshot, or ``servers`` if there is none. The
    snapshot records the last batch of each stream that it folds; once it is
    committed, the folded batches are removed. A stop in between leaves
    batches that readers skip by their number and the next compaction removes.
    A batch that arrives meanwhile is in neither the fold nor its record.
    """
    done = snapshots.folded(spark, snapshots_root)
    base = servers if done is None else snapshots.read_current(spark, snapshots_root)
    present = logged_batches(spark, log_path)
    last = dict(done or {}) | {stream: numbers[-1] for stream, numbers in present.items() if numbers}
    rows = read_status_log(spark, log_path, done)
    for stream, number in last.items():
        rows = rows.where((F.col("stream") != stream) | (F.col("batch_id") <= number))
    rows = rows.where(F.col("stream").isin(list(last)))
    snapshots.write_version(current_status(base, rows), snapshots_root, version, last)
    for stream, numbers in present.items():
        for number in numbers:
            drop_dir(spark, f"{log_path}/stream={stream}/batch_id={number}")


def status_view(spark: SparkSession, servers: DataFrame, log_path: str, snapshots_root: str) -> DataFrame:
    """The registry as of now: the snapshot with the newer batches applied."""
    done = snapshots.folded(spark, snapshots_root)
    base = servers if done is None else snapshots.read_current(spark, snapshots_root)
    return current_status(base, read_status_log(spark, log_path, done))


def fold_status(key, pieces, state):
    """The state of one server after a batch, and its row if its status changed.
    Works on the arrays alone: a frame operation costs more than a few rows."""
    held = state.get if state.exists else None
    best = held
    for rows in pieces:
        micros = rows["micros"].to_numpy()
        seqs = rows["seq"].to_numpy()
        latest = np.flatnonzero(micros == micros.max())
        at = latest[seqs[latest].argmax()]
        if best is None or (micros[at], seqs[at]) > (best[1], best[2]):
            best = (rows["status"].iat[at], int(micros[at]), int(seqs[at]))
    if best is not held:
        state.update(best)
        if held is None or held[0] != best[0]:
            yield pd.DataFrame({"server_id": [key[0]], "status": [best[0]],
                                "last_ping_at": [pd.Timestamp(best[1], unit="us")], "seq": [best[2]]})


def status_change_stream(heartbeats: DataFrame) -> DataFrame:
    """(server_id, status, last_ping_at, seq) of servers whose status is another
    than before, once per micro-batch (R2, A8): the state of a server is its
    latest heartbeat by (ts, seq); a batch that leaves its status as it was,
    or brings older heartbeats only, emits nothing for it. A server's rows of
    a batch come in bounded pieces, so none is gathered whole."""
    kind = "server_id string, status string, last_ping_at timestamp_ntz, seq long"
    timed = heartbeats.where(F.col("ts").isNotNull()).select(
        "server_id", "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "seq")
    return timed.groupBy("server_id").applyInPandasWithState(
        fold_status, kind, "status string, micros long, seq long", "update", "NoTimeout")


def start_status_changes(messages: DataFrame, out_path: str, checkpoint: str,
                         available_now: bool = True, processing_time: str = "1 second"):
    """Writes the changes of each micro-batch to its own folder (a replayed
    batch rewrites it)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/stream={stream_id(batch)}/batch_id={batch_id}")

    w = (status_change_stream(decode_heartbeats(messages)).writeStream.outputMode("update")
         .foreachBatch(write).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


# ------------------------------------------------- K2, D5 registry in buckets

def _bucket(buckets: int) -> F.Column:
    return F.pmod(F.xxhash64("server_id"), F.lit(buckets)).cast("int").alias("bucket")


def write_registry_buckets(servers: DataFrame, path: str, buckets: int = 256) -> None:
    """The registry laid out by a hash of the id: one folder a bucket. Choose
    ``buckets`` so that one is a few files; they stay what they are."""
    (servers.withColumn("bucket", _bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket", "server_id")
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def read_registry_buckets(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(S.SERVERS.fields + [T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def compact_status_buckets(spark: SparkSession, log_path: str, path: str, buckets: int = 256) -> int:
    """Folds the status log into the registry's buckets, writing those alone
    that hold a server the log changes; returns how many.

    The touched buckets are replaced by a dynamic partition overwrite. A stop
    before the log's folders are removed is harmless: an update applies only
    if it is not older than what is stored, so folding again gives the same.
    """
    present = logged_batches(spark, log_path)
    rows = read_status_log(spark, log_path)
    rows = rows.where(F.exists(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(n[-1]).alias("n"))
                                         for s, n in present.items() if n]),
                               lambda x: (x["s"] == F.col("stream")) & (F.col("batch_id") <= x["n"]))
                      if any(present.values()) else F.lit(False))
    latest = latest_status(rows.select("server_id", "status", F.col("last_ping_at").alias("ts"), "seq"))
    touched = [r[0] for r in latest.select(_bucket(buckets)).distinct().collect()]  # at most all buckets
    if touched:
        held = read_registry_buckets(spark, path).where(F.col("bucket").isin(touched))
        (apply_status(held, latest).repartition("bucket").sortWithinPartitions("bucket", "server_id")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
    for stream, numbers in present.items():
        for number in numbers:
            drop_dir(spark, f"{log_path}/stream={stream}/batch_id={number}")
    return len(touched)


# ---------------------------------------------------------------- R6 daily

# Sums and extremes of one micro-batch per day and server; they add up.
DAILY_PART = ("day date, server_id string, n_on long, n_status long, doc_count long, "
              "start_ping_at timestamp_ntz, last_ping_at timestamp_ntz")


FOLD = 32  # folders of one level that are merged into one of the next


def _daily_sums(parts: DataFrame) -> DataFrame:
    return parts.groupBy("day", "server_id").agg(
        F.sum("n_on").alias("n_on"), F.sum("n_status").alias("n_status"), F.sum("doc_count").alias("doc_count"),
        F.min("start_ping_at").alias("start_ping_at"), F.max("last_ping_at").alias("last_ping_at"))


def daily_batch_writer(parts_path: str, fold: int = FOLD):
    """foreachBatch function: one row per day and server that the batch has,
    in a folder of the batch (a replayed batch rewrites the same rows), then
    ``fold_daily``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        known = batch.where(F.col("server_id").isNotNull()).select(
            F.to_date("ts").alias("day"), "server_id", F.when(F.col("status") == "on", 1).otherwise(0).alias("n_on"),
            F.when(F.col("status").isNotNull(), 1).otherwise(0).alias("n_status"), F.lit(1).alias("doc_count"),
            F.col("ts").alias("start_ping_at"), F.col("ts").alias("last_ping_at"))
        stream = stream_id(batch)
        _daily_sums(known).write.mode("overwrite").parquet(
            f"{parts_path}/stream={stream}/level=0/first={batch_id}/last={batch_id}")
        fold_daily(batch.sparkSession, parts_path, stream, fold)
    return write


def _folders(spark: SparkSession, root: str) -> dict[int, list[tuple[int, int]]]:
    """The committed folders of a stream's partial sums: level -> (first batch,
    last batch), those that a folder of a higher level covers left out."""
    out, covered = {}, -1
    levels = sorted((int(n.removeprefix("level=")) for n in list_dir(spark, root) if n.startswith("level=")),
                    reverse=True)
    for level in levels:
        spans = []
        for first in list_dir(spark, f"{root}/level={level}"):
            for last in list_dir(spark, f"{root}/level={level}/{first}"):
                if path_exists(spark, f"{root}/level={level}/{first}/{last}/_SUCCESS"):
                    spans.append((int(first.removeprefix("first=")), int(last.removeprefix("last="))))
        out[level] = sorted(s for s in spans if s[0] > covered)
        covered = max([covered, *(s[1] for s in spans)])
    return out


def fold_daily(spark: SparkSession, parts_path: str, stream: str, fold: int = FOLD) -> None:
    """Merges partial sums level by level: ``fold`` folders of a level become
    one of the next, as minutes become hours and hours days. A folder counts
    once its ``_SUCCESS`` mark is there, and hides what it covers; only then
    are its parts removed, and a stop in between leaves parts that readers
    pass over. So the folders that a report reads grow with the logarithm of
    the number of batches."""
    root, level = f"{parts_path}/stream={stream}", 0
    while True:
        spans = _folders(spark, root).get(level, [])
        if len(spans) < fold:
            return
        first, last = spans[0][0], spans[-1][1]
        parts = spark.read.schema(DAILY_PART).parquet(
            *[f"{root}/level={level}/first={a}/last={b}" for a, b in spans])
        _daily_sums(parts).write.mode("overwrite").parquet(f"{root}/level={level + 1}/first={first}/last={last}")
        for a in {a for a, _ in spans}:
            drop_dir(spark, f"{root}/level={level}/first={a}")
        level += 1


def start_daily(messages: DataFrame, parts_path: str, checkpoint: str,
                available_now: bool = True, processing_time: str = "1 minute", fold: int = FOLD):
    """Daily uptime stream (R6): every micro-batch adds its partial sums. No
    message is too late, and the open day can be read like any other."""
    w = (decode_heartbeats(messages).writeStream.foreachBatch(daily_batch_writer(parts_path, fold))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def daily_folders(spark: SparkSession, parts_path: str) -> list[str]:
    """The folders that hold every batch of every stream once."""
    return [f"{parts_path}/{stream}/level={level}/first={a}/last={b}"
            for stream in list_dir(spark, parts_path) if stream.startswith("stream=")
            for level, spans in _folders(spark, f"{parts_path}/{stream}").items() for a, b in spans]


def read_daily(spark: SparkSession, parts_path: str, cap: int | None = S.REPORT_CAP) -> DataFrame:
    """The daily report of all that arrived, with the columns and the cap of
    ``uptime_daily``."""
    paths = daily_folders(spark, parts_path)
    parts = (spark.read.schema(DAILY_PART).parquet(*paths) if paths
             else spark.createDataFrame([], DAILY_PART))
    total = _daily_sums(parts)
    ratio = F.coalesce(F.col("n_on") / F.nullif(F.col("n_status"), F.lit(0)), F.lit(0.0))
    rows = total.select("day", "server_id", "start_ping_at", "last_ping_at",
                        ratio.alias("uptime_ratio"), "doc_count")
    return top_per_day(rows, cap) if cap else rows
