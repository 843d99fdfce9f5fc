"""End-to-end jobs of the reference's entry points, built from the operators.

* ``report_job``  POST /servers/report and the daily timer: validate the
  request, compute the uptime report over the history, write the export
  file, and return the outbox message that points at it.
* ``import_job``  POST /servers/import: read sheet files, validate, insert
  in order, return per-row results, the summary and the new registry.
* ``export_job``  GET /servers/export: one page of the registry as a file.

Request parameters are scalars handled on the driver (control plane); the
data work is distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import schemas as S
from pulsegrid.functions.timefmt import to_datetime
from pulsegrid.operators import exports, imports, messages, registry, uptime


def report_job(spark: SparkSession, history: DataFrame, start, end, receivers: list[str],
               out_root: str, report_id: str, cap: int | None = S.REPORT_CAP) -> DataFrame:
    """Validate, report, export, and prepare the mail.

    Returns the outbox row (req_id, receivers, subject, body, filename,
    value). Raises ValueError with the reference's error text on an invalid
    request (from after to, no receiver, bad address).
    """
    req = spark.createDataFrame(
        [(report_id, to_datetime(start), to_datetime(end), list(receivers))],
        "req_id string, from_ts timestamp_ntz, to_ts timestamp_ntz, receivers array<string>")
    err = messages.check_report_requests(req).first()["error"]
    if err is not None:
        raise ValueError(err)
    rep = uptime.uptime_report(history, start, end, cap)
    fname = f"report-{report_id}.csv"
    exports.write_csv(exports.export_report(rep), f"{out_root}/{fname}", exports.REPORT_HEADERS)
    return messages.mail_outbox(req)


def import_job(spark: SparkSession, sheets: DataFrame, servers: DataFrame, created_at=None
               ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """-> (per-row results, summary, rejected files, new registry).

    Rows accepted by the ordered insert are appended to the registry with
    the default status (P14); the registry passed in must hold every row
    (soft-deleted too), since deleted rows still own their keys.
    """
    results = imports.import_sheets(sheets, servers.select("server_id", "server_name"))
    summary = imports.import_summary(results)
    bad_files = imports.rejected_files(sheets, header_rows=1)
    accepted = results.where(F.col("outcome") == imports.ACCEPTED)
    new_registry = servers.unionByName(imports.as_server_rows(accepted, created_at))
    return results, summary, bad_files, new_registry


def export_job(servers: DataFrame, from_row: int, to_row: int, sort_field: str, desc: bool,
               path: str) -> DataFrame:
    page = registry.list_servers(servers, from_row, to_row, sort_field, desc)
    rows = exports.export_servers(page, sort_field, desc)
    exports.write_csv(rows, path, exports.SERVER_HEADERS)
    return rows
