"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Inputs are the adapters of ``pulsegrid.sources.fixtures`` over whole
tables. Parameters (report window, page, probe window, as-of time) are
fixed per key so the SQL oracle (``pulsegrid.plans.oracle``) can state the
same query.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import exports, heartbeats, imports, messages, pages, registry, uptime
from pulsegrid.session import apply_sql_defaults, shared_dir
from pulsegrid.functions.messages import (
    decode_heartbeats, decode_probe_requests, heartbeat_json, parsed_json,
)
from pulsegrid.sources import fixtures as fx
from pulsegrid.sources import sheets
from pulsegrid.streaming import heartbeats as streams
from pulsegrid.streaming import log, mail, probes

# Fixed parameters of the registered queries.
REPORT_FROM = "2024-01-05 00:00:00"
REPORT_TO = "2024-01-12 00:00:00"
PROBE_FROM = "2024-01-01 00:00:00"
PROBE_TO = "2024-01-01 01:00:00"
PROBE_CYCLE_SECONDS = 60
PATCH_AS_OF = "2024-02-01 00:00:00"
REGISTRY_BUCKETS = 16


def q_uptime_report(spark: SparkSession, d: str) -> DataFrame:
    return uptime.uptime_report(fx.hb_nulls(spark, d), REPORT_FROM, REPORT_TO)


def q_uptime_report_archive(spark, d):
    """The flagship report over the archive layout: history written as
    Parquet partitioned by day, the range prunes partitions (S4)."""
    path = shared_dir(spark, "history")
    streams.write_history(fx.hb_nulls(spark, d), path)
    return uptime.uptime_report(streams.read_archive(spark, path), REPORT_FROM, REPORT_TO)


def q_uptime_report_capped(spark, d):
    return uptime.rank_report(uptime.uptime_all(fx.hb_wide(spark, d)))


def q_uptime_daily(spark, d):
    return uptime.uptime_daily(fx.hb(spark, d))


def q_export_report(spark, d):
    return exports.export_report(uptime.uptime_report(fx.hb(spark, d), REPORT_FROM, REPORT_TO))


def q_heartbeat_latest(spark, d):
    return heartbeats.latest_status(fx.hb(spark, d)).select("server_id", "status", "last_ping_at")


def q_heartbeat_decode(spark, d):
    return heartbeats.decode_heartbeats(fx.raw_messages(spark, d))


def q_status_upsert(spark, d):
    reg = registry.apply_status(fx.servers(spark, d), heartbeats.latest_status(fx.hb(spark, d)))
    return reg.select("server_id", "status", "last_ping_at", "is_deleted")


def q_list_servers(spark, d):
    return registry.list_servers(fx.servers(spark, d), 20, 120, "created_at", desc=True)


def q_list_servers_deep(spark, d):
    """The last full hundred of the ids that the registry can have."""
    servers = fx.servers(spark, d)
    n = registry.count_servers(servers).first()["total"]
    return registry.list_servers(servers, max(0, n - 130), max(0, n - 130) + 100, "server_name")


def q_list_servers_paged(spark, d):
    """The same page from files in list order and their index."""
    servers, root = fx.servers(spark, d), shared_dir(spark, "pages")
    pages.write_pages(servers, root, [("server_name", False)])
    n = registry.count_servers(servers).first()["total"]
    return pages.read_page(spark, root, max(0, n - 130), max(0, n - 130) + 100, "server_name")


def q_count_servers(spark, d):
    return registry.count_servers(fx.servers(spark, d))


def q_export_servers(spark, d):
    page = registry.list_servers(fx.servers(spark, d), 0, 100, "server_name")
    return exports.export_servers(page, "server_name")


def q_page_requests_check(spark, d):
    return registry.check_page_requests(fx.page_requests(spark, d))


def q_report_requests_check(spark, d):
    return messages.check_report_requests(fx.report_requests(spark, d))


def q_create_conflicts(spark, d):
    return imports.create_servers(fx.servers(spark, d), fx.creates(spark, d)).select(
        "server_id", "outcome")


def q_patch_servers(spark, d):
    _, outcomes = registry.patch_servers(fx.servers(spark, d), fx.patches(spark, d), PATCH_AS_OF)
    return outcomes


def q_patch_registry(spark, d):
    changed, _ = registry.patch_servers(fx.servers(spark, d), fx.patches(spark, d), PATCH_AS_OF)
    return changed.select("server_id", "server_name", "ipv4", "metadata_updated_at")


def q_soft_delete(spark, d):
    _, outcomes = registry.soft_delete(fx.servers(spark, d), fx.patches(spark, d))
    return outcomes


def q_delete_registry(spark, d):
    changed, _ = registry.soft_delete(fx.servers(spark, d), fx.patches(spark, d))
    return changed.select("server_id", "server_name", "is_deleted")


def q_monitored_set(spark, d):
    return registry.monitored_set(fx.changelog(spark, d)).select("server_id", "seq")


def q_monitored_resync(spark, d):
    """The set at the end of each quarter of the log, with a resync between."""
    log_rows = fx.changelog(spark, d)
    last = log_rows.agg(F.max("seq")).first()[0]
    return registry.monitored_resync(log_rows, [last * i // 4 for i in (1, 2, 3)])


def q_monitored_registry(spark, d):
    return registry.monitored_from_registry(fx.servers(spark, d))


def q_import_rows(spark, d):
    recs = imports.sheet_records(fx.imp_sheet_rows(spark, d))
    return recs.select("file_id", F.col("row_no").alias("rn"))


def q_import_ipv4_split(spark, d):
    return imports.split_ipv4(fx.imp_simple(spark, d)).select("rn", "server_id", "valid")


def q_import_merge(spark, d):
    return imports.greedy_merge(fx.imp_chain(spark, d), fx.registry_small(spark, d)).select(
        "rn", "server_id", "server_name", "outcome")


def q_import_sheet_files(spark, d):
    """Sheets written as CSV files -> reader -> ordered import against the
    registry; files are imported in path order."""
    path = shared_dir(spark, "sheets")
    fx.write_sheet_files(fx.imp_sheet_table(spark, d), path)
    rows = sheets.read_csv_sheets(spark, path)
    res = imports.import_sheets(rows, fx.servers(spark, d).select("server_id", "server_name"))
    return res.select("row_no", "server_id", "server_name", "outcome")


def q_sheet_roundtrip(spark, d):
    """Names with quotes, commas, line breaks and outer blanks, written by the
    export sink and read by the import reader."""
    path = shared_dir(spark, "odd-sheets")
    fx.write_sheet_files(fx.odd_sheet_table(spark, d), path)
    recs = imports.sheet_records(sheets.read_csv_sheets(spark, path), header_rows=1)
    file_no = F.regexp_extract("file_id", "file_no=([0-9]+)", 1).cast("long")
    return recs.select(file_no.alias("file_no"), "row_no", "server_id", "server_name", "ipv4")


def q_import_summary(spark, d):
    return imports.import_summary(imports.import_records(fx.imp_simple(spark, d)))


def q_import_result_rows(spark, d):
    return imports.import_results(imports.import_records(fx.imp_simple(spark, d)))


def q_import_new_rows(spark, d):
    res = imports.import_records(fx.imp_simple(spark, d))
    new = imports.as_server_rows(res.where(F.col("outcome") == imports.ACCEPTED), PATCH_AS_OF)
    return new.select("server_id", "server_name", "ipv4", "status", "created_at", "is_deleted")


def q_probe_requests(spark, d):
    mon = registry.monitored_from_registry(fx.servers(spark, d))
    return messages.probe_requests(mon, PROBE_FROM, PROBE_TO, PROBE_CYCLE_SECONDS)


def q_probe_messages(spark, d):
    mon = registry.monitored_from_registry(fx.servers(spark, d))
    return messages.probe_messages(messages.probe_requests(mon, PROBE_FROM, PROBE_TO, PROBE_CYCLE_SECONDS))


def q_classify_probe(spark, d):
    return messages.classify_probe(fx.probe_results(spark, d))


def q_probe_request_decode(spark, d):
    return decode_probe_requests(fx.probe_log(spark, d))


def q_probe_heartbeats(spark, d):
    """The worker: messages -> requests -> outcomes -> heartbeats -> messages,
    read again as the writers read them."""
    hb = messages.probe_heartbeats(decode_probe_requests(fx.probe_log(spark, d)), fx.probe_results(spark, d))
    return decode_heartbeats(hb.select("seq", heartbeat_json().alias("value")))


def q_mail_outbox(spark, d):
    return messages.outbox_by_receiver(messages.mail_outbox(fx.report_requests(spark, d)))


def q_mail_messages(spark, d):
    """The message text, taken apart again."""
    m = parsed_json(messages.mail_outbox(fx.report_requests(spark, d)), keep="req_id")
    get = lambda path, kind="string": F.try_variant_get("m", f"$.Mail.{path}", kind)
    return m.select("req_id", get("From").alias("sender"), F.array_join(get("To", "array<string>"), "|").alias("receivers"),
                    get("Subject").alias("subject"), get("Body").alias("body"),
                    get("Attachments[0].Filename").alias("filename"), get("Attachments[0].Data").alias("data"))


def q_attachment_names(spark, d):
    paths = fx.stored_paths(spark, d)
    return paths.select("path", messages.base_name("path").alias("filename"))


def q_attachment_listing(spark, d):
    """The files of a store: here the import sheets, one in each folder."""
    store = shared_dir(spark, "store")
    fx.write_sheet_files(fx.imp_sheet_table(spark, d), store)
    files = messages.list_attachment_files(spark, store)
    return files.select(F.regexp_extract("path", "file_no=([0-9]+)", 1).cast("long").alias("file_no"),
                        F.regexp_extract("filename", "[.]([a-z]+)$", 1).alias("kind"))


def q_mail_ready(spark, d):
    return messages.attachment_ready(fx.mail_items(spark, d), fx.mail_files(spark, d))


# ------------------------------------------------------------------ streams
# Each publishes the heartbeat adapter as message files into a fresh folder
# under the shared checkpoint folder, drains it with availableNow and
# returns what the sink holds.

def _publish_hb(spark, d, label):
    src = shared_dir(spark, f"{label}-src")
    streams.write_message_files(fx.hb(spark, d), src)
    return src


def q_heartbeat_archive(spark, d):
    src = _publish_hb(spark, d, "archive")
    sink, ckpt = shared_dir(spark, "archive-sink"), shared_dir(spark, "archive-ckpt")
    q = streams.start_archive(streams.heartbeat_file_source(spark, src), sink, ckpt)
    q.awaitTermination()
    return streams.read_archive(spark, sink)


def q_archive_from_latest(spark, d):
    """A stream that starts at the log's end: what was there before is not
    read, what comes later is, after a restart too."""
    hb = fx.hb(spark, d)
    middle = hb.agg(F.max("seq")).first()[0] // 2
    src, sink, ckpt = (shared_dir(spark, f"latest-{n}") for n in ("src", "sink", "ckpt"))
    for part in (F.col("seq") <= middle, F.col("seq") > middle):
        streams.write_message_files(hb.where(part), src)
        source = log.file_source_from_latest(spark, src, ckpt)
        streams.start_archive(source, sink, ckpt).awaitTermination()
    return streams.read_archive(spark, sink)


def q_archive_once(spark, d):
    """The log archived, then read again from its start by another stream,
    together with messages that were late."""
    late = F.col("seq") % 10 == 3
    src, sink = shared_dir(spark, "once-src"), shared_dir(spark, "once-sink")
    streams.write_message_files(fx.hb(spark, d).where(~late), src)
    for run in range(2):
        ckpt = shared_dir(spark, "once-ckpt")
        streams.start_archive_once(streams.heartbeat_file_source(spark, src), sink, ckpt).awaitTermination()
        if not run:
            streams.write_message_files(fx.hb(spark, d).where(late), src)
    return streams.read_archive_once(spark, sink)


def q_status_stream(spark, d):
    src = _publish_hb(spark, d, "status")
    path, ckpt = shared_dir(spark, "status-log"), shared_dir(spark, "status-ckpt")
    q = streams.start_status(streams.heartbeat_file_source(spark, src), path, ckpt)
    q.awaitTermination()
    reg = streams.current_status(fx.servers(spark, d), streams.read_status_log(spark, path))
    return reg.select("server_id", "status", "last_ping_at", "is_deleted")


def q_status_compacted(spark, d):
    """The registry after two compactions with a stream run before each."""
    path, ckpt = shared_dir(spark, "status-log"), shared_dir(spark, "status-ckpt")
    src, snaps = shared_dir(spark, "status-src"), shared_dir(spark, "status-snapshots")
    for version, half in enumerate((F.col("seq") % 2 == 0, F.col("seq") % 2 == 1)):
        streams.write_message_files(fx.hb(spark, d).where(half), src)
        streams.start_status(streams.heartbeat_file_source(spark, src), path, ckpt).awaitTermination()
        streams.compact_status(spark, fx.servers(spark, d), path, snaps, version)
    view = streams.status_view(spark, fx.servers(spark, d), path, snaps)
    return view.select("server_id", "status", "last_ping_at", "is_deleted")


def q_status_bucketed(spark, d):
    """The registry in buckets after two compactions of the touched ones."""
    path, ckpt = shared_dir(spark, "bucket-log"), shared_dir(spark, "bucket-ckpt")
    src, reg = shared_dir(spark, "bucket-src"), shared_dir(spark, "bucket-registry")
    streams.write_registry_buckets(fx.servers(spark, d), reg, REGISTRY_BUCKETS)
    for half in (F.col("seq") % 2 == 0, F.col("seq") % 2 == 1):
        streams.write_message_files(fx.hb(spark, d).where(half), src)
        streams.start_status(streams.heartbeat_file_source(spark, src), path, ckpt).awaitTermination()
        streams.compact_status_buckets(spark, path, reg, REGISTRY_BUCKETS)
    return streams.read_registry_buckets(spark, reg).select("server_id", "status", "last_ping_at", "is_deleted")


def q_status_changes(spark, d):
    """Two runs of the change stream, its changes folded to the last of each server."""
    src, out, ckpt = (shared_dir(spark, f"changes-{n}") for n in ("src", "out", "ckpt"))
    for half in (F.col("seq") % 2 == 0, F.col("seq") % 2 == 1):
        streams.write_message_files(fx.hb(spark, d).where(half), src)
        streams.start_status_changes(streams.heartbeat_file_source(spark, src), out, ckpt).awaitTermination()
    changes = spark.read.schema(streams.STATUS_LOG).parquet(out)
    return heartbeats.latest_status(changes.withColumnRenamed("last_ping_at", "ts")).select("server_id", "status")


def q_probe_stream(spark, d):
    """Ticks at the quarters of the time in which the servers were created; a
    deleted server is gone half an hour after its creation."""
    servers = fx.servers(spark, d)
    start = int(dt.datetime.fromisoformat(PROBE_FROM).replace(tzinfo=dt.timezone.utc).timestamp())
    # as seconds: the times may be later than Python's
    cycle = (servers.agg(F.unix_seconds(F.max("created_at").cast("timestamp"))).first()[0] - start) // 4

    def monitored(ticks):
        gone = F.col("is_deleted") & (F.col("created_at") + F.expr("interval 30 minutes") <= F.col("tick"))
        return servers.crossJoin(F.broadcast(ticks)).where((F.col("created_at") <= F.col("tick")) & ~gone)  # one row

    out, ckpt = shared_dir(spark, "probe-out"), shared_dir(spark, "probe-ckpt")
    millis = start * 1000
    for _ in range(4):  # a tick a run, resumed from the checkpoint
        probes.start_fan_out(probes.tick_source(spark, millis, cycle * 1000), monitored, out, ckpt).awaitTermination()
    return probes.read_fan_out(spark, out)


def q_uptime_stream(spark, d):
    src = _publish_hb(spark, d, "daily")
    parts, ckpt = shared_dir(spark, "daily-parts"), shared_dir(spark, "daily-ckpt")
    streams.start_daily(streams.heartbeat_file_source(spark, src), parts, ckpt).awaitTermination()
    return streams.read_daily(spark, parts)


def q_mail_stream(spark, d):
    src = shared_dir(spark, "mail-src")
    log.publish_files(fx.raw_mails(spark, d), src)
    out, ckpt = shared_dir(spark, "mail-out"), shared_dir(spark, "mail-ckpt")
    q = mail.start_mail_worker(log.file_source(spark, src), fx.mail_files(spark, d), out, ckpt)
    q.awaitTermination()
    return mail.read_mail_results(spark, out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "uptime_report": q_uptime_report,
    "uptime_report_archive": q_uptime_report_archive,
    "uptime_report_capped": q_uptime_report_capped,
    "uptime_daily": q_uptime_daily,
    "export_report": q_export_report,
    "heartbeat_latest": q_heartbeat_latest,
    "heartbeat_decode": q_heartbeat_decode,
    "status_upsert": q_status_upsert,
    "list_servers": q_list_servers,
    "count_servers": q_count_servers,
    "export_servers": q_export_servers,
    "page_requests_check": q_page_requests_check,
    "report_requests_check": q_report_requests_check,
    "create_conflicts": q_create_conflicts,
    "patch_servers": q_patch_servers,
    "soft_delete": q_soft_delete,
    "monitored_set": q_monitored_set,
    "monitored_registry": q_monitored_registry,
    "import_rows": q_import_rows,
    "import_ipv4_split": q_import_ipv4_split,
    "import_merge": q_import_merge,
    "import_sheet_files": q_import_sheet_files,
    "import_summary": q_import_summary,
    "probe_requests": q_probe_requests,
    "classify_probe": q_classify_probe,
    "mail_outbox": q_mail_outbox,
    "mail_ready": q_mail_ready,
    "mail_stream": q_mail_stream,
    "heartbeat_archive": q_heartbeat_archive,
    "status_stream": q_status_stream,
    "uptime_stream": q_uptime_stream,
    "list_servers_deep": q_list_servers_deep,
    "patch_registry": q_patch_registry,
    "delete_registry": q_delete_registry,
    "sheet_roundtrip": q_sheet_roundtrip,
    "import_result_rows": q_import_result_rows,
    "import_new_rows": q_import_new_rows,
    "probe_messages": q_probe_messages,
    "probe_request_decode": q_probe_request_decode,
    "probe_heartbeats": q_probe_heartbeats,
    "mail_messages": q_mail_messages,
    "attachment_names": q_attachment_names,
    "status_compacted": q_status_compacted,
    "monitored_resync": q_monitored_resync,
    "list_servers_paged": q_list_servers_paged,
    "attachment_listing": q_attachment_listing,
    "archive_once": q_archive_once,
    "archive_from_latest": q_archive_from_latest,
    "status_bucketed": q_status_bucketed,
    "status_changes": q_status_changes,
    "probe_stream": q_probe_stream,
}


def _with_defaults(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_sql_defaults(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _with_defaults(v) for k, v in QUERIES.items()}
