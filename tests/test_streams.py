"""Streams: restart from the checkpoint, idempotent batch writes, snapshots."""

from pyspark.sql import functions as F

from pulsegrid.session import shared_dir
from pulsegrid.sources import fixtures as fx
from pulsegrid.streaming import heartbeats as streams
from pulsegrid.streaming import snapshots


def test_archive_restart_is_exactly_once(spark, sf001):
    hb = fx.hb(spark, sf001)
    n = hb.count()
    mid = hb.agg(F.percentile_approx("seq", 0.5)).first()[0]
    src = shared_dir(spark, "t-src")
    sink, ckpt = shared_dir(spark, "t-sink"), shared_dir(spark, "t-ckpt")
    streams.write_message_files(hb.where(F.col("seq") <= mid), src)
    streams.start_archive(streams.heartbeat_file_source(spark, src), sink, ckpt).awaitTermination()
    first = streams.read_archive(spark, sink).count()
    assert 0 < first < n
    # restart over the same checkpoint: nothing new -> nothing written again
    streams.start_archive(streams.heartbeat_file_source(spark, src), sink, ckpt).awaitTermination()
    assert streams.read_archive(spark, sink).count() == first
    # more messages arrive; the restarted query continues where it stopped
    streams.write_message_files(hb.where(F.col("seq") > mid), src)
    streams.start_archive(streams.heartbeat_file_source(spark, src), sink, ckpt).awaitTermination()
    out = streams.read_archive(spark, sink)
    assert out.count() == n
    assert out.select("seq").distinct().count() == n
    # the archive is partitioned by day and a day filter prunes partitions
    plan = out.where(F.col("dt") == "2024-01-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_status_batch_write_is_idempotent(spark, sf001):
    hb = fx.hb(spark, sf001)
    log = shared_dir(spark, "t-log")
    writer = streams.status_batch_writer(log)
    writer(hb, 0)
    writer(hb, 0)  # a replayed batch rewrites the same folder
    writer(hb.where("seq % 2 = 0"), 1)
    got = streams.read_status_log(spark, log)
    assert got.where("batch_id = 0").count() == hb.select("server_id").distinct().count()
    cur = streams.current_status(fx.servers(spark, sf001), got)
    from pulsegrid.operators.heartbeats import latest_status
    from pulsegrid.operators.registry import apply_status
    want = apply_status(fx.servers(spark, sf001), latest_status(hb))
    assert sorted(cur.collect(), key=str) == sorted(want.collect(), key=str)


def test_snapshot_versions(spark, sf001):
    root = shared_dir(spark, "t-snap")
    assert snapshots.current_version(spark, root) is None
    reg = fx.servers(spark, sf001)
    snapshots.write_version(reg, root, 0)
    from pulsegrid.operators.registry import soft_delete
    reg1, _ = soft_delete(snapshots.read_current(spark, root),
                          reg.select(F.col("server_id").cast("long").alias("rn"), "server_id").limit(5))
    snapshots.write_version(reg1, root, 1)
    assert snapshots.current_version(spark, root) == 1
    cur = snapshots.read_current(spark, root)
    assert cur.count() == reg.count()
    assert cur.where("is_deleted").count() >= reg.where("is_deleted").count()


def test_history_layout_clustered_and_day_compaction(spark, sf001):
    import datetime as dt
    hb = fx.hb(spark, "/root/testdata/sf0.01")
    hist = shared_dir(spark, "t-hist")
    # as on a cluster: many more partitions than days
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "240")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        streams.write_history(hb, hist)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = streams.read_archive(spark, hist)
    assert back.count() == hb.count()
    # each file covers a narrow band of the servers of its day
    per_file = (back.withColumn("f", F.input_file_name())
                    .groupBy("f", "dt").agg(F.countDistinct("server_id").alias("n")))
    per_day = back.groupBy("dt").agg(F.countDistinct("server_id").alias("n"))
    assert per_file.agg(F.max("n")).first()[0] * 3 < per_day.agg(F.min("n")).first()[0]
    # the streamed archive replaces only its own days in the history
    src = shared_dir(spark, "t-src2")
    sink, ckpt = shared_dir(spark, "t-sink2"), shared_dir(spark, "t-ckpt2")
    day = dt.date(2024, 1, 2)
    streams.write_message_files(hb.where(F.to_date("ts") == day), src)
    streams.start_archive(streams.heartbeat_file_source(spark, src), sink, ckpt).awaitTermination()
    streams.compact_archive_days(spark, sink, hist, [day])
    again = streams.read_archive(spark, hist)
    assert again.count() == hb.count()
    assert again.where(F.col("dt") == day).count() == hb.where(F.to_date("ts") == day).count()


def test_archive_drops_redelivered_messages(spark, sf001):
    hb = fx.hb(spark, sf001)
    src = shared_dir(spark, "t-dup-src")
    sink, ckpt = shared_dir(spark, "t-dup-sink"), shared_dir(spark, "t-dup-ckpt")
    streams.write_message_files(hb, src)
    # the log redelivers a slice of messages in a later file
    streams.write_message_files(hb.where("seq % 7 = 0"), src)
    q = streams.start_archive(streams.heartbeat_file_source(spark, src), sink, ckpt,
                              dedup_within="1 hour")
    q.awaitTermination()
    out = streams.read_archive(spark, sink)
    assert out.count() == hb.count() == out.select("seq").distinct().count()


def test_compaction_removes_redelivered_copies(spark, sf001):
    import datetime as dt
    hb = fx.hb(spark, sf001)
    day = dt.date(2024, 1, 3)
    one_day = hb.where(F.to_date("ts") == day)
    src = shared_dir(spark, "t-dup2-src")
    sink, ckpt = shared_dir(spark, "t-dup2-sink"), shared_dir(spark, "t-dup2-ckpt")
    streams.write_message_files(one_day, src)
    streams.write_message_files(one_day.where("seq % 2 = 0"), src)  # redelivery
    streams.start_archive(streams.heartbeat_file_source(spark, src), sink, ckpt).awaitTermination()
    assert streams.read_archive(spark, sink).count() > one_day.count()  # stream keeps copies
    hist = shared_dir(spark, "t-dup2-hist")
    streams.compact_archive_days(spark, sink, hist, [day])
    assert streams.read_archive(spark, hist).count() == one_day.count()


def test_daily_stream_keeps_late_messages_and_the_open_day(spark, sf001):
    """Two runs over one checkpoint, later half first, equal the batch report."""
    from pulsegrid.operators.uptime import uptime_daily
    hb = fx.hb(spark, sf001)
    mid = hb.agg(F.percentile_approx("ts", 0.5)).first()[0]
    src = shared_dir(spark, "t-d-src")
    parts, ckpt = shared_dir(spark, "t-d-parts"), shared_dir(spark, "t-d-ckpt")
    for half in (F.col("ts") > mid, F.col("ts") <= mid):
        streams.write_message_files(hb.where(half), src)
        streams.start_daily(streams.heartbeat_file_source(spark, src), parts, ckpt).awaitTermination()
    for cap in (10_000, 3, None):
        got = streams.read_daily(spark, parts, cap)
        assert sorted(got.collect()) == sorted(uptime_daily(hb, cap).collect())


def test_status_view_over_snapshot_and_newer_batches(spark, sf001):
    hb, reg = fx.hb(spark, sf001), fx.servers(spark, sf001)
    log, root = shared_dir(spark, "t-v-log"), shared_dir(spark, "t-v-snap")
    writer = streams.status_batch_writer(log)
    writer(hb.where("seq % 3 = 0"), 0)
    streams.compact_status(spark, reg, log, root, 0)
    streams.compact_status(spark, reg, log, root, 1)  # nothing new: the same registry
    writer(hb.where("seq % 3 <> 0"), 1)
    from pulsegrid.operators.heartbeats import latest_status
    from pulsegrid.operators.registry import apply_status
    want = sorted(apply_status(reg, latest_status(hb)).collect(), key=str)
    assert sorted(streams.status_view(spark, reg, log, root).collect(), key=str) == want
    streams.compact_status(spark, reg, log, root, 2)
    assert sorted(snapshots.read_current(spark, root).collect(), key=str) == want
