"""Uptime report over heartbeat history.

Plan shape (checked with ``explain``): Parquet scan with the time range (and
the ``dt`` partition range when the table is partitioned) pushed into the
scan -> partial hash aggregate -> one exchange on the group key -> final
aggregate -> ratio -> top-N. A server that holds a third of all heartbeats
costs one partial row per map task, so hot keys do not skew the final stage.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import schemas as S
from pulsegrid.functions.timefmt import second_floor, ts_literal


def uptime_aggregates(ts: str = "ts", status: str = "status") -> list[Column]:
    """Per-group aggregates; ``uptime_ratio`` is finished by ``with_ratio``.

    The ratio's denominator counts non-NULL statuses (not rows); the row
    count is ``doc_count``.
    """
    return [
        F.min(ts).alias("start_ping_at"),
        F.max(ts).alias("last_ping_at"),
        F.count_if(F.col(status) == S.STATUS_ON).alias("_on"),
        F.count(status).alias("_checked"),
        F.count(F.lit(1)).alias("doc_count"),
    ]


def with_ratio(agg: DataFrame) -> DataFrame:
    """on / checked, 0.0 when nothing was checked (no division by zero)."""
    ratio = F.when(F.col("_checked") > 0, F.col("_on") / F.col("_checked")).otherwise(F.lit(0.0))
    return agg.withColumn("uptime_ratio", ratio.cast("double")).drop("_on", "_checked")


def in_range(hb: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Half-open ``[start, end)`` with both bounds truncated to whole seconds.

    When the history is partitioned by ``dt`` (the archive layout), the
    matching day range is added so whole partitions are pruned.
    """
    lo, hi = second_floor(start), second_floor(end)
    like = hb.schema[ts].dataType
    out = hb.where((F.col(ts) >= ts_literal(lo, like)) & (F.col(ts) < ts_literal(hi, like)))
    if "dt" in hb.columns:
        last_day = hi.date() if hi.time() != dt.time(0) else hi.date() - dt.timedelta(days=1)
        out = out.where(F.col("dt").between(F.lit(lo.date()), F.lit(last_day)))
    return out


def rank_report(report: DataFrame, cap: int | None = S.REPORT_CAP) -> DataFrame:
    """Order by group size desc, then key asc; keep at most ``cap`` servers.

    ``orderBy().limit()`` plans as one TakeOrderedAndProject: each task keeps
    its own top ``cap`` and only those rows reach the final merge.
    """
    ordered = report.orderBy(F.desc("doc_count"), F.asc("server_id"))
    return ordered.limit(cap) if cap else ordered


def uptime_report(hb: DataFrame, start, end, cap: int | None = S.REPORT_CAP,
                  ts: str = "ts") -> DataFrame:
    """Uptime per server over ``[start, end)``.

    Columns: server_id, start_ping_at, last_ping_at, uptime_ratio, doc_count.
    ``start == end`` is valid and gives an empty report.
    """
    rows = in_range(hb.select("server_id", "status", ts, *(["dt"] if "dt" in hb.columns else [])),
                    start, end, ts)
    return rank_report(uptime_all(rows, ts), cap)


def uptime_all(hb: DataFrame, ts: str = "ts") -> DataFrame:
    """Uptime per server over every row given (no range, no cap)."""
    known = hb.where(F.col("server_id").isNotNull())  # a terms bucket needs a value
    agg = with_ratio(known.groupBy("server_id").agg(*uptime_aggregates(ts)))
    return agg.select("server_id", "start_ping_at", "last_ping_at", "uptime_ratio", "doc_count")


def top_k_per_group(df: DataFrame, group_cols: list[str], order_cols: list[Column], k: int,
                    split_key: str | None = None, splits: int = 64) -> DataFrame:
    """Keep the first ``k`` rows of every group by ``order_cols``.

    A group may be huge (one day of a large fleet), so it is first split into
    ``splits`` sub-groups by a hash of ``split_key``; each sub-group keeps its
    own top ``k``, and only those survivors meet in the final per-group
    ranking. No task ever sorts more than ``splits * k`` rows of one group
    (plus what the partial window-group limit already removed map-side).
    """
    work = df
    if split_key is not None and splits > 1:
        salt = F.pmod(F.xxhash64(F.col(split_key)), F.lit(splits))
        w1 = Window.partitionBy(*group_cols, salt).orderBy(*order_cols)
        work = work.withColumn("_rk", F.row_number().over(w1)).where(F.col("_rk") <= k).drop("_rk")
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return work.withColumn("_rk", F.row_number().over(w2)).where(F.col("_rk") <= k).drop("_rk")


def top_per_day(report: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` servers of every day with the most documents."""
    return top_k_per_group(report, ["day"], [F.desc("doc_count"), F.asc("server_id")], cap,
                           split_key="server_id")


def uptime_daily(hb: DataFrame, cap: int | None = S.REPORT_CAP, ts: str = "ts",
                 start=None, end=None) -> DataFrame:
    """Daily uptime report for every UTC day at once (re-aim of the daily
    timer, which reports the previous 24 h at midnight).

    Columns: day, server_id, start_ping_at, last_ping_at, uptime_ratio,
    doc_count. Each day keeps its top ``cap`` servers like a single report.
    """
    rows = hb
    if start is not None and end is not None:
        rows = in_range(hb, start, end, ts)
    day = F.to_date(F.col(ts)).alias("day")
    rows = rows.where(F.col("server_id").isNotNull())
    agg = with_ratio(rows.groupBy(day, "server_id").agg(*uptime_aggregates(ts)))
    if cap:
        agg = top_per_day(agg, cap)
    return agg.select("day", "server_id", "start_ping_at", "last_ping_at", "uptime_ratio",
                      "doc_count")
