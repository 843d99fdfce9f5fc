"""Message preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.messages import probe_request_json
from pulsegrid.functions.predicates import probe_status, report_request_error
from pulsegrid.functions.timefmt import ts_literal

# Mail text of the report message.
MAIL_SUBJECT = "Server uptime report"
MAIL_BODY = "Please find the attached report."
MAIL_FROM = ""

TICK_RUN = 1000  # ticks of a server that one row holds at a time


def probe_requests(monitored: DataFrame, start, end, cycle_seconds: int) -> DataFrame:
    """One probe request per monitored server per tick.

    Ticks are ``start, start+cycle, ...`` up to ``end`` inclusive. Each server
    row generates its own ticks (``explode(sequence)``): a narrow
    per-row generator, no join, no shuffle; output grows as servers x ticks.
    -> (tick, server_id, server_name, ip)
    """
    # in two steps, so that no row ever holds more than one run of ticks
    step = f"make_dt_interval(0, 0, 0, {int(cycle_seconds)})"
    run = f"make_dt_interval(0, 0, 0, {int(cycle_seconds) * TICK_RUN})"
    starts = F.sequence(ts_literal(start), ts_literal(end), F.expr(run))
    runs = monitored.select(F.explode(starts).alias("first"), "server_id", "server_name",
                            F.col("ipv4").alias("ip"))
    last = F.least(F.col("first") + F.expr(f"make_dt_interval(0, 0, 0, {int(cycle_seconds) * (TICK_RUN - 1)})"),
                   ts_literal(end))
    return runs.select(F.explode(F.sequence("first", last, F.expr(step))).alias("tick"),
                       "server_id", "server_name", "ip")


def probe_messages(requests: DataFrame) -> DataFrame:
    """Probe requests -> message value (JSON text) for the ping topic."""
    return requests.select("tick", probe_request_json("server_id", "server_name", "ip")
                           .alias("value"))


def classify_probe(results: DataFrame) -> DataFrame:
    """Probe results (seq, server_id, error, packets_recv) -> heartbeats
    (seq, server_id, status) (P10)."""
    return results.select("seq", "server_id",
                          probe_status("error", "packets_recv").alias("status"))


def probe_heartbeats(requests: DataFrame, results: DataFrame) -> DataFrame:
    """The worker's chain: decoded probe requests (seq, server_id, ...) and the
    probes' results (seq, error, packets_recv, probed_at) -> heartbeats
    (seq, server_id, status, ts). A request whose probe has not ended
    has none to report and gives no heartbeat."""
    j = requests.select("seq", "server_id").join(results.drop("server_id"), "seq")
    return j.select("seq", "server_id", probe_status("error", "packets_recv").alias("status"),
                    F.col("probed_at").alias("ts"))


def check_report_requests(requests: DataFrame) -> DataFrame:
    """(req_id, from_ts, to_ts, receivers) -> (req_id, error)."""
    return requests.select("req_id",
                           report_request_error("from_ts", "to_ts", "receivers").alias("error"))


def report_filename(req_id_col: str = "req_id", ext: str = "csv") -> F.Column:
    """``report-<id>.<ext>``; a deterministic id so retries name the same file."""
    return F.concat(F.lit("report-"), F.col(req_id_col).cast("string"), F.lit(f".{ext}"))


def mail_outbox(requests: DataFrame) -> DataFrame:
    """Valid report requests -> one outbox message each.

    Columns: req_id, receivers, subject, body, filename, value (the message
    JSON with Go's field names; the attachment travels by name, empty data).
    """
    err = report_request_error("from_ts", "to_ts", "receivers")
    valid = requests.where(err.isNull())
    fname = report_filename()
    mail = F.struct(
        F.lit(MAIL_FROM).alias("From"), F.col("receivers").alias("To"),
        F.lit(MAIL_SUBJECT).alias("Subject"), F.lit(MAIL_BODY).alias("Body"),
        F.array(F.struct(fname.alias("Filename"),
                         F.lit(b"").cast("binary").alias("Data"))).alias("Attachments"))
    return valid.select("req_id", "receivers", F.lit(MAIL_SUBJECT).alias("subject"),
                        F.lit(MAIL_BODY).alias("body"), fname.alias("filename"),
                        F.to_json(F.struct(mail.alias("Mail"))).alias("value"))


def outbox_by_receiver(outbox: DataFrame) -> DataFrame:
    """One row per (message, receiver): req_id, receiver, subject, body, filename."""
    return outbox.select("req_id", F.explode("receivers").alias("receiver"), "subject", "body",
                         "filename")


def base_name(path_col) -> F.Column:
    """Base name of a path."""
    c = F.col(path_col) if isinstance(path_col, str) else path_col
    return F.element_at(F.split(c, "/"), -1)


def list_attachment_files(spark, root: str) -> DataFrame:
    """Attachment store listing (S6): (filename, path, length) without
    reading file contents."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "length"))
    return files.select(base_name("path").alias("filename"), "path", "length")


def attachment_ready(items: DataFrame, files: DataFrame) -> DataFrame:
    """Flat attachments (mail_id, pos, filename) ⟕ files (filename) ->
    (mail_id, ready) (J5).

    A mail is ready when every attachment is found; a mail with no
    attachments (filename NULL after the outer explode) is ready. Only the
    names that the mails ask for are looked up; the join strategy is left to
    the runtime sizes. ``bool_and`` is a partial aggregate, so a mail with
    many attachments is not a hot group.
    """
    asked = items.select("filename").where(F.col("filename").isNotNull()).distinct()
    names = (asked.join(files.select("filename"), "filename", "left_semi")
             .withColumn("_found", F.lit(True)))
    j = items.join(names, "filename", "left")
    ok = F.col("filename").isNull() | F.coalesce(F.col("_found"), F.lit(False))
    return j.groupBy("mail_id").agg(F.bool_and(ok).alias("ready"))


def mail_ready(mails: DataFrame, files: DataFrame) -> DataFrame:
    """Nested mail requests (mail_id, Mail struct) -> (mail_id, ready)."""
    flat = mails.select("mail_id", F.posexplode_outer("Mail.Attachments").alias("pos", "att"))
    items = flat.select("mail_id", "pos", F.col("att.Filename").alias("filename"))
    return attachment_ready(items, files)
