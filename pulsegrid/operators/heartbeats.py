"""Heartbeat operators: status projection (P3) and latest per server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.messages import decode_heartbeats  # noqa: F401  (re-export)


# Fixed-width exact order key for (ts, seq): microseconds and seq (shifted
# to be non-negative) side by side in one DECIMAL(38,0). Hash aggregation
# accepts decimal buffers, while max_by over a struct forces a sort-based
# aggregate (each map task would sort all of its input).
def _dec(v: int) -> Column:
    return F.lit(str(v)).cast("decimal(38,0)")


SEQ_SHIFT = 1 << 63
SEQ_SPAN = 10 ** 20


def _time_seq_key(ts: str, seq: str) -> Column:
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(38,0)")
    return (micros * _dec(SEQ_SPAN) + F.col(seq).cast("decimal(38,0)")
            + _dec(SEQ_SHIFT)).cast("decimal(38,0)")


def _seq_of_key(k: Column) -> Column:
    # pmod: times before 1970 make the key negative
    return (F.pmod(k, _dec(SEQ_SPAN)) - _dec(SEQ_SHIFT)).cast("long")


def latest_status(hb: DataFrame, order_by: str = "time", ts: str = "ts") -> DataFrame:
    """Last heartbeat per server -> (server_id, status, last_ping_at, seq).

    ``order_by='time'`` picks the latest by (timestamp, seq): deterministic,
    independent of how the stream was split into batches. ``'arrival'`` uses
    ``seq`` alone (the reference's buffer overwrite order).

    Two aggregates: the heavy one, over every heartbeat, is a hash aggregate
    (partial per map task, one exchange) of the exact (ts, seq) order key per
    (server, status); the winner per server is then picked among those few
    rows per server. A very hot server costs one row per status per task.
    """
    if order_by == "time":
        key = _time_seq_key(ts, "seq")
        per = hb.groupBy("server_id", "status").agg(F.max(key).alias("_k"),
                                                    F.max(ts).alias("_t"))
        seq = _seq_of_key(F.col("_k"))
    else:
        per = hb.groupBy("server_id", "status").agg(F.max("seq").alias("_k"),
                                                    F.max_by(ts, "seq").alias("_t"))
        seq = F.col("_k")
    win = F.max_by(F.struct(F.col("status"), F.col("_t").alias("ts"), seq.alias("seq")),
                   F.col("_k"))
    return (per.groupBy("server_id").agg(win.alias("_l"))
               .select("server_id", F.col("_l.status").alias("status"),
                       F.col("_l.ts").alias("last_ping_at"), F.col("_l.seq").alias("seq")))
