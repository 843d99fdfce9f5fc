"""Adapters: the driver's tables seen as this domain's inputs (FIXTURES.md §2).

Every adapter reads a whole base table (no id subsets), so the work of each
query grows with the data. The SQL oracle (``pulsegrid.plans.oracle``)
spells the same adapters in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.exports import CSV_OPTIONS
from pulsegrid.sources.tables import read_table


def _t(spark, d, name):
    return read_table(spark, d, name)


def _on_off(cond):
    return F.when(cond, F.lit("off")).otherwise(F.lit("on"))


def hb(spark: SparkSession, d: str) -> DataFrame:
    """Heartbeat history (events): error -> off, everything else -> on."""
    e = _t(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"),
                    F.col("user_id").cast("string").alias("server_id"),
                    _on_off(F.col("event_type") == "error").alias("status"),
                    F.col("ts"))


def hb_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Like ``hb`` with NULL statuses: server 7 only nulls, every 11th event null."""
    e = _t(spark, d, "events")
    status = (F.when((F.col("user_id") == 7) | (F.col("event_id") % 11 == 0), F.lit(None))
               .when(F.col("event_type") == "error", F.lit("off"))
               .otherwise(F.lit("on")))
    return e.select(F.col("event_id").alias("seq"),
                    F.col("user_id").cast("string").alias("server_id"),
                    status.cast("string").alias("status"), F.col("ts"))


def hb_wide(spark: SparkSession, d: str) -> DataFrame:
    """Many servers (one per order): exercises the 10,000-server report cap."""
    li = _t(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
                     F.col("l_orderkey").cast("string").alias("server_id"),
                     _on_off(F.col("l_returnflag") == "R").alias("status"),
                     F.col("l_shipdate").alias("ts"))


def servers(spark: SparkSession, d: str) -> DataFrame:
    """Registry: one server per customer; every 10th soft-deleted."""
    c = _t(spark, d, "customer")
    k = F.col("c_custkey")

    def octet(div):
        return (F.floor(k / div).cast("bigint") % 256).cast("string")

    return c.select(
        k.cast("string").alias("server_id"),
        F.col("c_name").alias("server_name"),
        F.concat(F.lit("10."), octet(65536), F.lit("."), octet(256), F.lit("."),
                 (k % 256).cast("string")).alias("ipv4"),
        F.lit("UNKNOWN").alias("status"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + c_custkey * interval '1' minute")
         .alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("metadata_updated_at"),
        # some servers were pinged before the events, some after them
        F.when(k % 6 == 0, F.expr("timestamp_ntz'2030-01-01 00:00:00'"))
         .when(k % 3 == 0, F.expr("timestamp_ntz'2020-01-01 00:00:00'")).alias("last_ping_at"),
        (k % 10 == 9).alias("is_deleted"))


def imp_simple(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    k = F.col("p_partkey")
    ipv4 = (F.when(k % 7 == 3, F.lit("300.1.1.1"))
             .when(k % 13 == 5, F.lit("01.2.3.4"))
             .otherwise(F.lit("10.0.0.1")))
    return p.select(k.alias("rn"),
                    F.concat(F.lit("s"), F.floor(k / 4).cast("string")).alias("server_id"),
                    F.col("p_name").alias("server_name"), ipv4.alias("ipv4"))


SHEET_ROWS = 100  # rows of a sheet file, so their number grows with the table


def imp_sheet_table(spark: SparkSession, d: str) -> DataFrame:
    """``imp_simple`` laid out as sheets of SHEET_ROWS parts: file_no and the
    columns No, ServerID, ServerName, IPv4 (the first is ignored on import)."""
    s = imp_simple(spark, d)
    return s.select(F.floor(F.col("rn") / SHEET_ROWS).cast("long").alias("file_no"),
                    F.col("rn").alias("No"), F.col("server_id").alias("ServerID"),
                    F.col("server_name").alias("ServerName"), F.col("ipv4").alias("IPv4"))


def odd_sheet_table(spark: SparkSession, d: str) -> DataFrame:
    """Sheets whose names hold quotes, commas, line breaks and outer blanks."""
    k = F.col("No") % 6
    name = (F.when(k == 0, F.concat(F.lit('a"b, '), F.col("ServerName")))
             .when(k == 1, F.concat(F.lit("  "), F.col("ServerName"), F.lit(" ")))
             .when(k == 2, F.concat(F.col("ServerName"), F.lit("\nsecond line")))
             .when(k == 3, F.concat(F.lit('"'), F.col("ServerName"), F.lit('"')))
             .when(k == 4, F.concat(F.lit(",\\"), F.col("ServerName")))
             .otherwise(F.col("ServerName")))
    return imp_sheet_table(spark, d).withColumn("ServerName", name)


def write_sheet_files(sheet_table: DataFrame, path: str) -> None:
    """One CSV file with a header line per sheet folder, rows in ``No`` order."""
    (sheet_table.repartition("file_no").sortWithinPartitions("file_no", "No")
     .write.mode("overwrite").partitionBy("file_no").options(**CSV_OPTIONS).csv(path))


def imp_chain(spark: SparkSession, d: str) -> DataFrame:
    """Import rows whose id and name groups chain into each other (whole orders)."""
    o = _t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("rn"),
                    F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("server_id"),
                    F.concat(F.lit("n"), F.floor(F.col("o_orderkey") / 12).cast("string"))
                     .alias("server_name"),
                    F.lit("10.0.0.1").alias("ipv4"))


def imp_files(spark: SparkSession, d: str) -> DataFrame:
    """Sheet data rows (header already skipped): one sheet per SHEET_ROWS
    parts; ``ncell`` cells per row."""
    p = _t(spark, d, "part")
    k = F.col("p_partkey")
    ncell = F.when(k % 997 == 5, F.lit(2)).otherwise(F.lit(4))
    return p.select(F.floor(k / SHEET_ROWS).cast("string").alias("file_id"), k.alias("rn"), ncell.alias("ncell"))


def imp_sheet_rows(spark: SparkSession, d: str) -> DataFrame:
    """``imp_files`` in the reader's shape (file_id, row_no, cells)."""
    f = imp_files(spark, d)
    cells = F.array_repeat(F.lit("x"), F.col("ncell"))
    return f.select("file_id", F.col("rn").alias("row_no"), cells.alias("cells"))


def changelog(spark: SparkSession, d: str) -> DataFrame:
    """Monitored-set changes: status F = delete, otherwise put."""
    o = _t(spark, d, "orders")
    op = F.when(F.col("o_orderstatus") == "F", F.lit("delete")).otherwise(F.lit("put"))
    return o.select(F.col("o_orderkey").alias("seq"),
                    F.col("o_custkey").cast("string").alias("server_id"), op.alias("op"))


def patches(spark: SparkSession, d: str) -> DataFrame:
    """Patch requests in ``rn`` order: '' name and NULL ipv4 mean no change.
    Three requests to a server, names wanted by several servers, names that
    other servers hold, and addresses that are none."""
    c = _t(spark, d, "customer")
    k = F.col("c_custkey")
    name = (F.when(k % 10 == 5, F.col("c_name"))
             .when(k % 2 == 0, F.lit(""))
             .otherwise(F.concat(F.lit("new-"), F.floor(k / 4).cast("string"))))
    ipv4 = (F.when(k % 11 == 4, F.lit("300.1.1.1")).when(k % 3 == 0, F.lit(None))
             .otherwise(F.concat(F.lit("10.9.9."), (k % 256).cast("string")))).cast("string")
    return c.select(k.alias("rn"), (F.floor(k / 3) * 5).cast("string").alias("server_id"),
                    name.alias("server_name"), ipv4.alias("ipv4"))


def creates(spark: SparkSession, d: str) -> DataFrame:
    """Create requests with conflicts in the batch and with the registry, and
    addresses that are none."""
    c = _t(spark, d, "customer")
    k = F.col("c_custkey")
    name = (F.when(k % 4 == 0, F.col("c_name"))
             .otherwise(F.concat(F.lit("srv-"), F.floor(k / 3).cast("string"))))
    ipv4 = F.when(k % 9 == 2, F.lit("1.2.3")).otherwise(F.lit("10.1.1.1"))
    return c.select((F.floor(k / 2) * 15).cast("string").alias("server_id"), name.alias("server_name"),
                    ipv4.alias("ipv4"), k.alias("rn"))


def registry_small(spark: SparkSession, d: str) -> DataFrame:
    """Keys held before an import: one row per supplier."""
    n = _t(spark, d, "supplier")
    return n.select(F.concat(F.lit("s"), (F.col("s_suppkey") * 2).cast("string")).alias("server_id"),
                    F.concat(F.lit("n"), (F.col("s_suppkey") * 3).cast("string")).alias("server_name"))


def _attachment():
    return F.concat(F.lit("report-"), F.col("conv_id").cast("string"), F.lit("-"),
                    F.col("turn").cast("string"), F.lit(".csv"))


def mail_items(spark: SparkSession, d: str) -> DataFrame:
    """One row per attachment: (mail_id, pos, filename)."""
    c = _t(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("mail_id"), F.col("turn").alias("pos"),
                    _attachment().alias("filename"))


def mail_requests(spark: SparkSession, d: str) -> DataFrame:
    """One mail request per conversation: (mail_id, attachments) with the
    attachment names in turn order (a message carries its own list, which its
    sender made: the group is one message)."""
    items = mail_items(spark, d)
    att = F.array_sort(F.collect_list(F.struct("pos", "filename")))
    return items.groupBy("mail_id").agg(F.transform(att, lambda x: x["filename"])
                                        .alias("attachments"))


def raw_mails(spark: SparkSession, d: str) -> DataFrame:
    """Mail message log (seq, value): the requests, every seventh of them
    malformed in one of five ways."""
    from pulsegrid.streaming.mail import mail_json
    m = mail_requests(spark, d).select(F.col("mail_id").alias("seq"), mail_json().alias("value"))
    k = F.col("seq") % 35
    value = (F.when(k == 28, F.concat("value", F.lit(',"Mail":{}')))
              .when(k == 0, F.concat("value", F.lit(" x")))
              .when(k == 7, F.lit('{"Mail":{"Attachments":"oops"}}'))
              .when(k == 14, F.lit('{"Mail":{"To":"x"}}'))
              .when(k == 21, F.lit('{"Mail":{"Attachments":[{"Filename":1}]}}'))
              .otherwise(F.col("value")))
    return m.select("seq", value.alias("value"))


def mail_files(spark: SparkSession, d: str) -> DataFrame:
    """Attachment files present in the file store (base names)."""
    c = _t(spark, d, "conversations")
    return c.where((F.col("conv_id") + F.col("turn")) % 5 != 0).select(_attachment().alias("filename")).distinct()


def stored_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the attachment store."""
    return mail_files(spark, d).select(F.concat(F.lit("/store/2024/"), "filename").alias("path"))


def raw_messages(spark: SparkSession, d: str) -> DataFrame:
    """Heartbeat message log with classes by event_id % 50: not JSON, bad
    timestamp, missing fields, extra field, text after the object, an object
    for an id, a number for a status, a time before 1970, null id, more
    members or values after the object, names in another case, repeated
    members (the last, null, of another type), valid."""
    e = _t(spark, d, "events")
    sid = F.col("user_id").cast("string")
    cls = F.col("event_id") % 50
    day = F.lpad((F.lit(1) + F.col("event_id") % 28).cast("string"), 2, "0")
    status = F.when(F.col("event_type") == "error", F.lit("off")).otherwise(F.lit("on"))
    value = (F.when(cls == 0, F.lit("not json"))
              .when(cls == 1, F.concat(F.lit('{"server_id":"'), sid,
                                       F.lit('","status":"on","timestamp":"yesterday"}')))
              .when(cls == 2, F.concat(F.lit('{"server_id":"'), sid, F.lit('"}')))
              .when(cls == 3, F.concat(F.lit('{"server_id":"'), sid,
                                       F.lit('","status":"on","extra":1,'
                                             '"timestamp":"2024-01-01T00:00:00Z"}')))
              .when(cls == 4, F.concat(F.lit('{"server_id":"'), sid,
                                       F.lit('","status":"on","timestamp":"2024-01-01T00:00:00Z"}]')))
              .when(cls == 5, F.lit('{"server_id":{"a":1},"status":"on","timestamp":"2024-01-01T00:00:00Z"}'))
              .when(cls == 6, F.concat(F.lit('{"server_id":"'), sid,
                                       F.lit('","status":1,"timestamp":"2024-01-01T00:00:00Z"}')))
              .when(cls == 7, F.concat(F.lit('{"server_id":"'), sid,
                                       F.lit('","status":"on","timestamp":"1969-12-31T23:59:58.25Z"}')))
              .when(cls == 8, F.lit('{"server_id":null,"status":"on","timestamp":"2024-01-01T00:00:00Z"}'))
              .when(cls == 9, F.concat(_good(sid), F.lit(',"x":1')))
              .when(cls == 10, F.concat(_good(sid), F.lit(',"m2":{"q":[1]}')))
              .when(cls == 11, F.concat(_good(sid), F.lit(','), _good(sid)))
              .when(cls == 12, F.concat(_good(sid), F.lit('} x')))
              .when(cls == 13, F.concat(F.lit('{"Server_ID":"'), sid,
                                        F.lit('","STATUS":"off","TimeStamp":"2024-01-02T03:04:05Z"}')))
              .when(cls == 14, F.concat(F.lit('{"server_id":"first","SERVER_ID":"'), sid,
                                        F.lit('","status":"on","status":"off","timestamp":"2024-01-01T00:00:00Z"}')))
              .when(cls == 15, F.concat(F.lit('{"server_id":"'), sid,
                                        F.lit('","server_id":null,"status":"on","timestamp":"2024-01-01T00:00:00Z"}')))
              .when(cls == 16, F.concat(F.lit('{"server_id":7,"server_id":"'), sid,
                                        F.lit('","status":"on","timestamp":"2024-01-01T00:00:00Z"}')))
              .when(cls == 17, F.concat(F.lit(' '), _good(sid), F.lit('\n')))
              .when(cls == 18, F.concat(F.lit('{"a":{"b":1,"b":2},"timestamp":"2024-01-01T00:00:00Z","server_id":"'),
                                        sid, F.lit('"}')))
              .otherwise(F.concat(F.lit('{"server_id":"'), sid, F.lit('","status":"'), status,
                                  F.lit('","timestamp":"2024-01-'), day, F.lit('T00:00:00Z"}'))))
    return e.select(F.col("event_id").alias("seq"), value.alias("value"))


def _good(sid):
    return F.concat(F.lit('{"server_id":"'), sid, F.lit('","status":"on","timestamp":"2024-01-01T00:00:00Z"}'))


def probe_results(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    err = F.when(F.col("event_type") == "error", F.lit("timeout")).otherwise(F.lit(None))
    return e.select(F.col("event_id").alias("seq"),
                    F.col("user_id").cast("string").alias("server_id"),
                    err.cast("string").alias("error"),
                    (F.col("event_id") % 3).alias("packets_recv"),
                    F.col("ts").alias("probed_at"))


def probe_log(spark: SparkSession, d: str) -> DataFrame:
    """Probe request messages (seq, value), one per event; every 20th is no
    request: a number for an address, two objects, or more members after the
    object; every 20th has names in another case."""
    e = _t(spark, d, "events")
    value = F.to_json(F.struct(F.col("user_id").cast("string").alias("ServerID"),
                               F.concat(F.lit('n"'), F.col("user_id").cast("string")).alias("ServerName"),
                               F.lit("10.0.0.1").alias("IP")))
    cls = F.col("event_id") % 60
    value = (F.when(cls == 0, F.lit('{"ServerID":"1","IP":5}')).when(cls == 20, F.concat(value, value))
              .when(cls == 40, F.concat(value, F.lit(',"m2":{}')))
              .when(cls % 20 == 7, F.concat(F.lit('{"ip":"10.9.9.9","serverid":"'), F.col("user_id").cast("string"),
                                            F.lit('","Serverid":null}')))
              .otherwise(value))
    return e.select(F.col("event_id").alias("seq"), value.alias("value"))


def page_requests(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    k = F.col("p_partkey")
    sort = (F.when(k % 4 == 0, F.lit("created_at")).when(k % 4 == 1, F.lit("server_name"))
             .when(k % 4 == 2, F.lit("status")).otherwise(F.lit("SERVER_NAME")))
    return p.select(k.alias("req_id"), (k % 12 - 2).cast("int").alias("from_row"),
                    (k % 12 - 2 + k * 3 % 150 - 5).cast("int").alias("to_row"),
                    sort.alias("sort_field"))


def report_requests(spark: SparkSession, d: str) -> DataFrame:
    """Report requests with none to three receivers, good and bad."""
    p = _t(spark, d, "part")
    k = F.col("p_partkey")
    own = F.concat(F.lit("ops"), k.cast("string"), F.lit("@example.com"))
    named = F.concat(F.lit("Ops Team <o."), k.cast("string"), F.lit("@x.example.org>"))
    receivers = (F.when(k % 7 == 0, F.array().cast("array<string>"))
                  .when(k % 7 == 1, F.array(F.lit("no-at-sign")))
                  .when(k % 7 == 2, F.array(own, named))
                  .when(k % 7 == 3, F.array(own, F.lit("a..b@c.example")))
                  .when(k % 7 == 4, F.array(named, own, F.lit("last@example.net")))
                  .otherwise(F.array(own)))
    return p.select(k.alias("req_id"),
                    F.expr("timestamp_ntz'2024-01-05 00:00:00'").alias("from_ts"),
                    F.expr("timestamp_ntz'2024-01-04 00:00:00' + (p_partkey % 3) * interval '1' day")
                     .alias("to_ts"),
                    receivers.alias("receivers"))
