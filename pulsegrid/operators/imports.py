"""Bulk import (S5 rows, P7, P6, P14, J2, D1, D2, A9, U1).

The reference inserts the rows of a sheet one at a time; a row fails when
its id *or* its name is already held by an existing row (deleted rows
included) or by a row accepted earlier in the same import. With two unique
keys, "first row per id and first row per name" is wrong: a row rejected
for its name must not block a later row with the same id. ``greedy_merge``
computes the exact sequential answer in few distributed passes over ranges
of the insert order:

  pass: every range is replayed in order, all ranges at once. A row whose id
  or name an accepted row of the range holds is rejected. A row that shares
  one with an undecided row before it, in an earlier range or in this one,
  stays undecided. Every other row is accepted. Undecided rows that share an
  id or a name with an accepted row are then dropped, the others go on.

It is exact: what precedes an accepted row and shares a key with it is
already rejected. The first range with undecided rows is decided whole in
each pass, and so is whatever hangs on rows of one range only, however long
the chain. Ranges have at most ``RANGE_ROWS`` rows; keys meet over ranges by
group minima (partial aggregation, safe for a key that holds a third of the
rows) and equi joins. Each pass is one table in the shared checkpoint folder.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid import schemas as S
from pulsegrid.functions.predicates import ipv4_ok
from pulsegrid.functions.timefmt import ts_literal
from pulsegrid.operators.ranks import with_positions
from pulsegrid.session import drop_dir, shared_dir

ACCEPTED = "success"


# ---------------------------------------------------------------- sheet rows

def trim_trailing_empty(cells) -> F.Column:
    """Drop trailing empty cells (a spreadsheet row ends at its last value)."""
    c = F.col(cells) if isinstance(cells, str) else cells
    last = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))), F.lit(0),
                       lambda acc, i: F.when(F.coalesce(F.get(c, i - 1), F.lit("")) != "", i)
                                       .otherwise(acc))
    return F.when(F.size(c) > 0, F.slice(c, 1, last)).otherwise(c)


def sheet_records(rows: DataFrame, header_rows: int = 0) -> DataFrame:
    """Sheet rows (file_id, row_no, cells) -> import records.

    Rows with ``row_no < header_rows`` are the header and skipped. A file in
    which any data row has fewer than 4 cells is rejected as a whole (no
    record survives); a file with no data rows yields nothing, not an error.
    Cell 0 is ignored; cells 1, 2, 3 are id, name, ipv4.

    The per-file check is a group-by (partial aggregation) plus an anti join,
    so one huge file is never gathered into a single task.
    """
    data = rows.where(F.col("row_no") >= header_rows)
    bad = (data.where(F.size("cells") < 4).select("file_id").distinct())
    ok = data.join(bad, "file_id", "left_anti")
    return ok.select("file_id", "row_no",
                     F.get(F.col("cells"), 1).alias("server_id"),
                     F.get(F.col("cells"), 2).alias("server_name"),
                     F.get(F.col("cells"), 3).alias("ipv4"))


def rejected_files(rows: DataFrame, header_rows: int = 0) -> DataFrame:
    """Files refused with "file have invalid data or format"."""
    data = rows.where(F.col("row_no") >= header_rows)
    return (data.groupBy("file_id").agg(F.count_if(F.size("cells") < 4).alias("short_rows"))
                .where(F.col("short_rows") > 0)
                .select("file_id", F.lit(S.ERR_INVALID_IMPORT).alias("error")))


# ---------------------------------------------------------------- validation

def split_ipv4(records: DataFrame) -> DataFrame:
    """Add ``valid``: the IPv4 check that splits records before insert."""
    return records.withColumn("valid", ipv4_ok("ipv4"))


def as_server_rows(records: DataFrame, created_at=None) -> DataFrame:
    """Accepted records -> registry rows with the default status."""
    stamp = ts_literal(created_at if created_at is not None
                       else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    return records.select(
        "server_id", "server_name", "ipv4", F.lit(S.STATUS_UNKNOWN).alias("status"),
        stamp.alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("metadata_updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_ping_at"),
        F.lit(False).alias("is_deleted"))


# ---------------------------------------------------------------- greedy merge

def _freeze(df: DataFrame) -> DataFrame:
    """Materialise a pass as a Parquet table in the shared checkpoint folder
    and read it back: lineage is cut and the next pass starts from a plain
    scan. (A checkpointed Dataset keeps the inferred constraints of the plan
    it came from; over many passes of self-joins those grow until planning
    alone exhausts the driver, so a written table is used instead.)"""
    path = shared_dir(df.sparkSession, "import-round")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


RANGE_ROWS = 50_000  # rows of the insert order that one task replays


def _replay(rows: pd.DataFrame) -> pd.DataFrame:
    """One range in insert order: adds ``state``, 'a'ccepted, 'r'ejected or
    'u'ndecided. Rows with ``waits`` are marks of positions: an undecided row
    of an earlier range has the id or the name. A null key conflicts with none."""
    waiting = set(rows.loc[rows["waits"], "position"])
    rows = rows[~rows["waits"]].sort_values("position")
    ids, names, states = {}, {}, []
    for position, sid, name in zip(rows["position"], rows["server_id"], rows["server_name"]):
        held = ids.get(sid), names.get(name)
        state = "r" if "a" in held else "u" if position in waiting or "u" in held else "a"
        if state != "r":
            if sid is not None:
                ids[sid] = state
            if name is not None:
                names[name] = state
        states.append(state)
    return rows[["position", "range", "rn", "server_id", "server_name"]].assign(state=states)


def _waits(undecided: DataFrame, key: str) -> DataFrame:
    """Marks (position, range, waits) of the rows whose key an earlier range
    has: the first range of each key that more than one range has, met again
    by an equi join of the key and the position alone."""
    first = undecided.groupBy(key).agg(F.min("range").alias("_first"), F.max("range").alias("_last"))
    later = first.where("_first < _last").drop("_last")
    return (undecided.select(key, "position", "range").join(later, key).where("_first < range")
            .select("position", "range", F.lit(True).alias("waits")))


def greedy_merge(candidates: DataFrame, registry: DataFrame | None = None,
                 range_rows: int = RANGE_ROWS) -> DataFrame:
    """Exact sequential insert of ``candidates`` (rn, server_id, server_name)
    against ``registry`` (server_id, server_name; every row, deleted too).

    ``rn`` is the insert order and must be unique (any orderable type).
    Returns every candidate with ``outcome`` = 'success' or the duplicate
    error, and ``pass`` (the pass that accepted it).
    """
    cand = candidates.select("rn", "server_id", "server_name")
    fresh = cand
    if registry is not None:
        fresh = (fresh.join(registry.select("server_id"), "server_id", "left_anti")
                      .join(registry.select("server_name"), "server_name", "left_anti"))
    # Pre-reduce identical (id, name) pairs to their first row: a later copy
    # always loses to the earlier one (or for the same reason).
    alone = F.when(F.col("server_id").isNull() | F.col("server_name").isNull(), F.col("rn"))
    once = fresh.groupBy("server_id", "server_name", alone.alias("alone")).agg(F.min("rn").alias("rn")).drop("alone")
    spark = cand.sparkSession
    if isinstance(cand.schema["rn"].dataType, (T.LongType, T.IntegerType)):
        placed = once.withColumn("position", F.col("rn").cast("long"))  # unique: a range has no more rows
    else:
        placed = with_positions(once, [F.col("rn").asc()])
    columns = ["position", "range", "rn", "server_id", "server_name"]
    left = _freeze(placed.withColumn("range", F.floor(F.col("position") / range_rows)).select(*columns))
    states = T.StructType(left.schema.fields + [T.StructField("state", T.StringType())])
    steps, passes = shared_dir(spark, "import-steps"), 0  # one table, a folder a pass
    while not left.isEmpty():
        passes += 1
        marks = _waits(left, "server_id").union(_waits(left, "server_name"))
        (left.withColumn("waits", F.lit(False)).unionByName(marks, allowMissingColumns=True)
         .groupBy("range").applyInPandas(_replay, states)
         .write.option("compression", "zstd").parquet(f"{steps}/pass={passes}"))
        step = spark.read.schema(states).parquet(f"{steps}/pass={passes}")
        won = step.where("state = 'a'")
        after = _freeze(step.where("state = 'u'").select(*columns)
                        .join(won.select("server_id"), "server_id", "left_anti")
                        .join(won.select("server_name"), "server_name", "left_anti").select(*columns))
        drop_dir(spark, left.stored_path)
        left = after
    acc_keys = (spark.read.schema(T.StructType(states.fields + [T.StructField("pass", T.IntegerType())]))
                .parquet(steps).where("state = 'a'").select("rn", "pass") if passes else
                cand.select("rn", F.lit(None).cast("int").alias("pass")).where(F.lit(False)))
    return (cand.join(acc_keys, "rn", "left")
                .select("rn", "server_id", "server_name",
                        F.when(F.col("pass").isNotNull(), F.lit(ACCEPTED))
                         .otherwise(F.lit(S.ERR_DUPLICATE)).alias("outcome"),
                        "pass"))


def import_records(records: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """IPv4 split + greedy insert of import records (rn, server_id,
    server_name, ipv4) -> (rn, server_id, server_name, ipv4, outcome).

    Invalid IPv4 rows never reach the insert and fail with "invalid ipv4".
    """
    split = _freeze(split_ipv4(records))  # read the sheets once
    merged = greedy_merge(split.where("valid"), registry).select("rn", "outcome")
    return split.join(merged, "rn", "left").select(
        "rn", "server_id", "server_name", "ipv4", F.coalesce("outcome", F.lit(S.ERR_INVALID_IP)).alias("outcome"))


def import_sheets(rows: DataFrame, registry: DataFrame | None = None,
                  header_rows: int = 1) -> DataFrame:
    """Sheet rows of one or many files -> per-row import results.

    Files are imported in ``file_id`` order, rows in ``row_no`` order: the
    insert order key ``rn`` is the row's position in that order. Rows of
    rejected files do not appear; see ``rejected_files``. -> the columns of
    ``import_records`` with file_id and row_no.
    """
    recs = sheet_records(_freeze(rows.select("file_id", "row_no", "cells")), header_rows)
    keyed = with_positions(recs, [F.col("file_id").asc(), F.col("row_no").asc()], "rn")
    done = import_records(keyed.select("rn", "server_id", "server_name", "ipv4"), registry)
    return done.join(keyed.select("rn", "file_id", "row_no"), "rn")


def import_results(results: DataFrame) -> DataFrame:
    """The result lists of an import as rows (A9, U1): (class, position, server_id).

    Successes in ``rn`` order; failures: failed inserts in ``rn`` order, then
    the rows with an invalid address in ``rn`` order.
    """
    ok = F.col("outcome") == ACCEPTED
    cls = F.when(ok, F.lit("success")).otherwise(F.lit("failed"))
    late = (F.col("outcome") == S.ERR_INVALID_IP).cast("int")
    keyed = results.select(cls.alias("class"), late.alias("late"), "rn", "server_id")
    placed = with_positions(keyed, [F.col("class").desc(), F.col("late").asc(), F.col("rn").asc()])
    first = placed.groupBy("class").agg(F.min("position").alias("first"))  # two rows
    return placed.join(first, "class").select(
        "class", (F.col("position") - F.col("first")).alias("position"), "server_id")


def import_summary(results: DataFrame) -> DataFrame:
    """Import result (A9 + U1): counts of successes and failures. The id
    lists are the rows of ``import_results``."""
    cls = F.when(F.col("outcome") == ACCEPTED, F.lit("success")).otherwise(F.lit("failed"))
    return results.groupBy(cls.alias("outcome")).agg(F.count(F.lit(1)).alias("total"))


def create_servers(servers: DataFrame, creates: DataFrame) -> DataFrame:
    """Create requests (D1): IPv4 check, then insert unless the id or the
    name is held by any registry row (deleted included) or by an earlier
    accepted create (requests are applied in ``rn`` order).

    -> (server_id, outcome) with outcome 'created', duplicate or invalid ipv4.
    """
    res = import_records(creates.select("rn", "server_id", "server_name", "ipv4"),
                         servers.select("server_id", "server_name"))
    return res.select("rn", "server_id",
                      F.when(F.col("outcome") == ACCEPTED, F.lit("created"))
                       .otherwise(F.col("outcome")).alias("outcome"))
