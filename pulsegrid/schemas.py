"""Fixed StructTypes of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# servers registry: server_id and server_name are both unique keys; a
# soft-deleted row still owns both.
SERVERS = T.StructType([
    T.StructField("server_id", T.StringType(), False),
    T.StructField("server_name", T.StringType(), False),
    T.StructField("ipv4", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("metadata_updated_at", T.TimestampNTZType(), True),
    T.StructField("last_ping_at", T.TimestampNTZType(), True),
    T.StructField("is_deleted", T.BooleanType(), True),
])

# heartbeat after decode; seq = arrival order (Kafka offset or file counter)
HEARTBEAT = T.StructType([
    T.StructField("seq", T.LongType(), True),
    T.StructField("server_id", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
])

# wire form of a heartbeat message: timestamp kept as text so the decode
# rule can check its shape
HEARTBEAT_WIRE = T.StructType([
    T.StructField("server_id", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("timestamp", T.StringType(), True),
    T.StructField("_corrupt_record", T.StringType(), True),
])

# stream stand-in for a message log: one JSON line per message
MESSAGE_LOG = T.StructType([
    T.StructField("seq", T.LongType(), True),
    T.StructField("value", T.StringType(), True),
])

UPTIME_ROW = T.StructType([
    T.StructField("server_id", T.StringType(), True),
    T.StructField("start_ping_at", T.TimestampNTZType(), True),
    T.StructField("last_ping_at", T.TimestampNTZType(), True),
    T.StructField("uptime_ratio", T.DoubleType(), False),
    T.StructField("doc_count", T.LongType(), False),
])

ATTACHMENT = T.StructType([
    T.StructField("Filename", T.StringType(), True),
    T.StructField("Data", T.BinaryType(), True),
])

# mail request message; the reference's structs carry no JSON tags, so the
# keys are the Go field names
MAIL_REQUEST = T.StructType([
    T.StructField("Mail", T.StructType([
        T.StructField("From", T.StringType(), True),
        T.StructField("To", T.ArrayType(T.StringType()), True),
        T.StructField("Subject", T.StringType(), True),
        T.StructField("Body", T.StringType(), True),
        T.StructField("Attachments", T.ArrayType(ATTACHMENT), True),
    ]), True),
])

# one decoded sheet row: file, position (0 = header), cells by position
SHEET_ROW = T.StructType([
    T.StructField("file_id", T.StringType(), True),
    T.StructField("row_no", T.LongType(), True),
    T.StructField("cells", T.ArrayType(T.StringType()), True),
])

# Vocabulary of outcome / error columns (fixed values: must equal the
# reference's error texts).
ERR_INVALID_IP = "invalid ipv4"
ERR_INVALID_SORT = "invalid sort field or order"
ERR_INVALID_PAGINATION = "invalid pagination"
ERR_DUPLICATE = "duplicate server id or server name"
ERR_NOT_FOUND = "record not found"
ERR_INVALID_IMPORT = "file have invalid data or format"
ERR_INVALID_TIME_RANGE = "invalid time range"
ERR_INVALID_EMAIL = "invalid email"

# status vocabulary actually stored (T1): default, and the probe outcomes
STATUS_UNKNOWN = "UNKNOWN"
STATUS_ON = "on"
STATUS_OFF = "off"

# fixed values: list sort fields, page width cap, report cap
SORT_FIELDS = ("created_at", "server_name")
MAX_PAGE_WIDTH = 100
REPORT_CAP = 10000
