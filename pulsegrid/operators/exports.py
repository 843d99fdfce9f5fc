"""Exports (K4, K5, W1): projection, order number, formatted times.

The order number is the global position in the page's or report's order
(``with_positions``), so it needs no single-partition window at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.timefmt import format_time
from pulsegrid.operators.ranks import with_positions

# Column headers of the two export files.
SERVER_HEADERS = ["Order number", "ServerID", "ServerName", "Ipv4", "Status", "CreateAt",
                  "MetadataUpdatedAt", "LastPingAt"]
REPORT_HEADERS = ["Order number", "ServerID", "Uptime Ratio", "Start Ping At", "Last Ping At",
                  "Total Checks"]


def export_servers(page: DataFrame, sort_field: str = "created_at", desc: bool = False
                   ) -> DataFrame:
    """A listed page -> export rows with snake-case names."""
    key = F.col(sort_field).desc() if desc else F.col(sort_field).asc()
    placed = with_positions(page, [key, F.col("server_id").asc()])
    return placed.select(
        (F.col("position") + 1).alias("order_number"), "server_id", "server_name", "ipv4",
        "status", format_time("created_at").alias("created_at"),
        format_time("metadata_updated_at").alias("metadata_updated_at"),
        format_time("last_ping_at").alias("last_ping_at"))


def export_report(report: DataFrame) -> DataFrame:
    """An uptime report -> export rows, numbered in report order."""
    placed = with_positions(report, [F.desc("doc_count"), F.asc("server_id")])
    return placed.select(
        (F.col("position") + 1).alias("order_number"), "server_id", "uptime_ratio",
        format_time("start_ping_at").alias("start_ping_at"),
        format_time("last_ping_at").alias("last_ping_at"),
        F.col("doc_count").alias("total_checks"))


def with_headers(rows: DataFrame, headers: list[str]) -> DataFrame:
    """Rename export columns to the file headers, in order."""
    return rows.toDF(*headers)


CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "emptyValue": "",
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(rows: DataFrame, path: str, headers: list[str] | None = None) -> None:
    """CSV sink with a header line, rows in the order of their first column:
    quotes are doubled, blanks and line breaks kept, so the import reader
    gives back the same texts. A page or report is small enough for one file;
    a result without a cap becomes several files, in order."""
    out = rows.orderBy(rows.columns[0])
    out = with_headers(out, headers) if headers else out
    out.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
