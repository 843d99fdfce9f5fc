"""Server registry as table -> table operators (P1, P2, P9, P12, O1, O2, A7,
J1, J3, J4, D1, D3-D6, S7).

The registry is a DataFrame with the ``schemas.SERVERS`` columns. Changes
return a new registry DataFrame (write it as a new snapshot version with
``pulsegrid.streaming.snapshots``) plus a per-request outcome table.
Conflict and lookup checks are equi joins on one key each (never an OR
join), so every one is a hash/sort-merge join that AQE can re-plan.
"""

from __future__ import annotations

import datetime as dt
import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid import schemas as S
from pulsegrid.functions.predicates import (
    clamp_page_end, ipv4_ok, page_request_error,
)
from pulsegrid.functions.timefmt import ts_literal
from pulsegrid.operators.ranks import with_positions
from pulsegrid.session import drop_dir, shared_dir

DTO_COLUMNS = ["server_id", "server_name", "status", "ipv4", "created_at",
               "metadata_updated_at", "last_ping_at"]


def active(servers: DataFrame) -> DataFrame:
    """Rows not soft-deleted."""
    return servers.where(~F.col("is_deleted"))


def count_servers(servers: DataFrame) -> DataFrame:
    """Total active servers, independent of any page."""
    return active(servers).agg(F.count(F.lit(1)).alias("total"))


def validate_page(from_row: int, to_row: int, sort_field: str) -> tuple[int, int]:
    """Scalar form of the page check for a single request: raises on an
    invalid request, returns the clamped (from, to)."""
    if sort_field not in S.SORT_FIELDS:
        raise ValueError(S.ERR_INVALID_SORT)
    if to_row - from_row <= 0 or from_row < 0 or to_row <= 0:
        raise ValueError(S.ERR_INVALID_PAGINATION)
    return from_row, min(to_row, from_row + S.MAX_PAGE_WIDTH)


def check_page_requests(requests: DataFrame) -> DataFrame:
    """Table of page requests -> (req_id, from_row, to_row clamped, error)."""
    err = page_request_error("from_row", "to_row", "sort_field")
    return requests.select(
        "req_id", F.col("from_row").cast("long").alias("from_row"),
        F.when(err.isNull(), clamp_page_end("from_row", "to_row"))
         .otherwise(F.col("to_row").cast("long")).alias("to_row"),
        err.alias("error"))


def list_servers(servers: DataFrame, from_row: int, to_row: int,
                 sort_field: str = "created_at", desc: bool = False) -> DataFrame:
    """One page of active servers (O1, O2, P12), at most 100 rows.

    Ordered by ``sort_field`` (asc/desc) with ``server_id`` as tie-breaker,
    so pages are stable and concatenate to the full sort; NULL values come
    first ascending and last descending. One plan at every offset: the sort
    keys alone are range-partitioned and numbered (``with_positions``), and
    the page's keys fetch their rows.
    """
    lo, hi = validate_page(from_row, to_row, sort_field)
    base = active(servers)
    key = F.col(sort_field).desc() if desc else F.col(sort_field).asc()
    placed = with_positions(base.select(sort_field, "server_id"), [key, F.col("server_id").asc()])
    page = placed.where((F.col("position") >= lo) & (F.col("position") < hi)).select("server_id")
    return (base.join(page, "server_id", "left_semi").orderBy(key, F.col("server_id").asc())
            .limit(hi - lo).select(*DTO_COLUMNS))


def apply_status(servers: DataFrame, latest: DataFrame) -> DataFrame:
    """Bulk status update (J1 / D5): ``UPDATE servers FROM latest``.

    Unmatched registry rows are unchanged, unknown ids in ``latest`` are
    dropped, deleted rows are updated too (no is_deleted filter). An update
    only applies when it is not older than the stored ``last_ping_at``, so
    folding batches in order equals one global latest.

    ``latest`` has at most one row per server (the output of
    ``latest_status``); the join is a left outer equi join on server_id,
    broadcast by AQE when the runtime size is small, shuffled otherwise.
    """
    upd = latest.select(F.col("server_id"), F.col("status").alias("_new_status"),
                        F.col("last_ping_at").alias("_new_ping"))
    j = servers.join(upd, "server_id", "left")
    take = F.col("_new_ping").isNotNull() & (
        F.col("last_ping_at").isNull() | (F.col("_new_ping") >= F.col("last_ping_at")))
    return (j.withColumn("status", F.when(take, F.col("_new_status")).otherwise(F.col("status")))
             .withColumn("last_ping_at",
                         F.when(take, F.col("_new_ping")).otherwise(F.col("last_ping_at")))
             .select(*servers.columns))


def _stamp(as_of) -> F.Column:
    """One literal, so that all jobs over a result see the same time."""
    return ts_literal(as_of if as_of is not None
                      else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


RANGE_ROWS = 50_000  # requests of the order that one task replays


def _replay(rows: pd.DataFrame) -> pd.DataFrame:
    """One range of renames in order: ``ok`` where it is still unknown.

    ``state``: what is known of the wanted name at the range's start, 'held'
    by ``holder``, 'free' or 'unknown'; a holder may also have come later, at
    ``since``. A request for an unknown name is left open, and from there on
    the names that its server may have left are unknown.
    """
    rows = rows.sort_values("position")
    state, since, names_of = {}, {}, defaultdict(set)
    for name, known, holder, at in zip(rows["want"], rows["state"], rows["holder"], rows["since"]):
        if name not in state:
            state[name] = holder if known == "held" else known == "free" or None
            since[name] = at if at == at and at is not None else -math.inf
            if known == "held":
                names_of[holder].add(name)
    out = []
    for position, server, name, ok in zip(rows["position"], rows["server_id"], rows["want"], rows["ok"]):
        holder = state[name]  # True: free, None: unknown
        if ok is None:
            ok = None if holder is None else holder is True or holder == server
        if ok is not False:
            for left in [n for n in names_of[server] if n != name and since[n] < position]:
                names_of[server].discard(left)
                state[left] = True if ok else None
            if ok and holder != server:
                names_of[holder].discard(name)
                names_of[server].add(name)
                state[name], since[name] = server, position
        out.append(ok)
    return rows[["position", "range", "rn", "server_id", "want"]].assign(ok=pd.Series(out, rows.index, object))


def _known_names(left: DataFrame, held: DataFrame) -> DataFrame:
    """What is known of every name that an undecided request wants: its
    ``holder`` after all that is decided before, ``since`` when, ``until`` the
    holder's next rename to another name that has not failed; ``free`` from
    ``free_at`` on if nobody has it or that rename is known to succeed, and
    the ``next`` undecided request for it then."""
    after = lambda at, since: F.col(since).isNull() | (F.col(at) > F.col(since))
    wanted = left.where("ok is null").groupBy(F.col("want").alias("name")).agg(F.min("position").alias("first"))
    taken = (left.where("ok").join(wanted, F.col("want") == F.col("name")).where("position < first")
             .groupBy("name").agg(F.max(F.struct("position", "server_id")).alias("taken")))
    names = wanted.join(held, "name", "left").join(taken, "name", "left").select(
        "name", F.coalesce("taken.server_id", "holder").alias("holder"), F.col("taken.position").alias("since"))
    leaves = (left.join(names.where("holder is not null"), F.col("server_id") == F.col("holder"))
              .where(after("position", "since") & (F.col("want") != F.col("name")))
              .groupBy("name").agg(F.min(F.struct("position", "ok")).alias("leave")))
    known = names.join(leaves, "name", "left").select(
        "name", "holder", "since", F.col("leave.position").alias("until"),
        (F.col("holder").isNull() | F.coalesce("leave.ok", F.lit(False))).alias("free"),
        F.coalesce("leave.position", "since").alias("free_at"))
    following = (left.where("ok is null").join(known.where("free"), F.col("want") == F.col("name"))
                 .where(after("position", "free_at")).groupBy("name").agg(F.min("position").alias("next")))
    return known.join(following, "name", "left")


def _rename_in_order(held: DataFrame, wants: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The renames (rn, server_id, want) that succeed when all are applied
    one after the other by ``rn``.

    ``held``: (name, holder), the servers that have a wanted name at first;
    ``wants``: (rn, server_id, want), active servers only. A rename succeeds
    if no other server has the name at that time; a name given up is free for
    later ones. Every wanted name has a history of its own: its holder has it
    until the holder's next rename to another name that does not fail, and
    until then all others fail, at once and however many they are. If that
    rename is known to succeed the name is free from there on, and the first
    request for it succeeds, whatever else its server asked for before.

    A pass finds out what is known of every name, by aggregates and equi
    joins over all requests, and replays all ranges of the order at once from
    what is known at their starts. It decides the first range with undecided
    requests whole, chains of any length with it, and in the others all that
    hangs on known names; so passes grow neither with the requests for a name
    nor with how often it changes hands inside a range. A range has at most
    ``range_rows`` requests (integers ``rn`` are cut as they are).
    """
    spark = wants.sparkSession
    if isinstance(wants.schema["rn"].dataType, (T.LongType, T.IntegerType)):
        placed = wants.withColumn("position", F.col("rn").cast("long"))
    else:
        placed = with_positions(wants, [F.col("rn").asc()])
    left = _stored(placed.select("position", F.floor(F.col("position") / range_rows).alias("range"), "rn",
                                 "server_id", "want", F.lit(None).cast("boolean").alias("ok")), "renames")
    begins = lambda at: F.floor(F.col(at) / range_rows)
    while not left.where("ok is null").isEmpty():
        known = _known_names(left, held).withColumnRenamed("name", "want")
        state = (F.when(F.col("holder").isNotNull() & (F.col("until").isNull() | (begins("until") >= F.col("range"))), "held")
                 .when(F.col("free") & (F.col("free_at").isNull() | (begins("free_at") < F.col("range")))
                       & (F.col("next").isNull() | (begins("next") >= F.col("range"))), "free").otherwise("unknown"))
        rows = left.join(known, "want", "left").withColumn("state", state).withColumn("ok", F.when(
            F.col("ok").isNull() & F.col("holder").isNotNull() & (F.col("until").isNull() | (F.col("position") < F.col("until"))),
            F.col("server_id") == F.col("holder")).otherwise(F.col("ok")))
        done = rows.select(*left.columns, "holder", "since", "state").groupBy("range").applyInPandas(_replay, left.schema)
        step = _stored(done.where("ok is null or ok"), "renames")  # without the failed
        drop_dir(spark, left.stored_path)
        left = step
    return left.select("rn", "server_id", "want")


def patch_servers(servers: DataFrame, patches: DataFrame, as_of=None
                  ) -> tuple[DataFrame, DataFrame]:
    """Patches by id (J3 / D3), applied in ``rn`` order -> (registry, outcomes).

    ``patches``: (rn, server_id, server_name, ipv4), rn unique. Per request:
    a non-empty ipv4 must be valid; the id must name an active server (else
    not found); a non-empty new name must not be held by another server at
    that time (deleted rows included). Empty or NULL fields mean "no change";
    ``metadata_updated_at`` is stamped with ``as_of`` (default: current time).
    Only renames depend on each other (``_rename_in_order``); a server's ipv4
    is that of its last successful request that has one.

    outcomes: rn, server_id, outcome, one row for each request.
    """
    stamp = _stamp(as_of)
    p = patches.select("rn", "server_id", F.nullif(F.col("server_name"), F.lit("")).alias("want"),
                       F.nullif(F.col("ipv4"), F.lit("")).alias("new_ip"))
    found = active(servers).select("server_id", F.lit(True).alias("found"))
    checked = _stored(p.join(found, "server_id", "left").withColumn(
        "error", F.when(F.col("new_ip").isNotNull() & ~ipv4_ok("new_ip"), F.lit(S.ERR_INVALID_IP))
                  .when(F.col("found").isNull(), F.lit(S.ERR_NOT_FOUND))).drop("found"), "patches")
    wants = checked.where("error is null and want is not null").select("rn", "server_id", "want")
    held = servers.join(wants.select(F.col("want").alias("server_name")), "server_name", "left_semi").select(
        F.col("server_name").alias("name"), F.col("server_id").alias("holder"))
    renamed = _rename_in_order(held, wants)
    names = renamed.groupBy("server_id").agg(F.max_by("want", "rn").alias("name"))
    done = checked.join(renamed.select("rn", F.lit(True).alias("ok")), "rn", "left").withColumn(
        "outcome", F.coalesce("error", F.when(F.col("want").isNotNull() & F.col("ok").isNull(),
                                              F.lit(S.ERR_DUPLICATE)), F.lit("updated")))
    done = _stored(done.select("rn", "server_id", "want", "new_ip", "outcome"), "patched")
    good = done.where("outcome = 'updated'")
    last_ip = good.where("new_ip is not null").groupBy("server_id").agg(F.max("rn").alias("rn")) \
                  .join(good.select("rn", "new_ip"), "rn").select("server_id", "new_ip")
    changed = (good.select("server_id").distinct().join(last_ip, "server_id", "left")
               .join(names, "server_id", "left").select("server_id", "new_ip", "name", F.lit(True).alias("hit")))
    registry = (servers.join(changed, "server_id", "left")
                .withColumn("server_name", F.coalesce("name", "server_name"))
                .withColumn("ipv4", F.coalesce("new_ip", "ipv4"))
                .withColumn("metadata_updated_at", F.when(F.col("hit"), stamp).otherwise(F.col("metadata_updated_at")))
                .select(*servers.columns))
    return registry, done.select("rn", "server_id", "outcome")


def soft_delete(servers: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Soft deletes by id (J4 / D4), in ``rn`` order -> (registry, outcomes).

    ``requests``: (rn, server_id). The first request for an active server
    deletes it; one for an unknown or deleted server, and every later one for
    the same server, is "record not found". outcomes: rn, server_id, outcome.
    """
    req = requests.select("rn", "server_id")
    first = req.groupBy("server_id").agg(F.min("rn").alias("rn"))
    hit = first.join(active(servers).select("server_id"), "server_id", "left_semi")
    outcomes = (req.join(hit.select("rn", F.lit(True).alias("hit")), "rn", "left")
                .select("rn", "server_id", F.when(F.col("hit"), F.lit("deleted"))
                        .otherwise(F.lit(S.ERR_NOT_FOUND)).alias("outcome")))
    gone = hit.select("server_id", F.lit(True).alias("gone"))
    registry = (servers.join(gone, "server_id", "left")
                .withColumn("is_deleted", F.col("is_deleted") | F.coalesce("gone", F.lit(False)))
                .select(*servers.columns))
    return registry, outcomes


def monitored_from_registry(servers: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Monitored set loaded from the registry (S7): id, name, ipv4.

    Active servers by default; ``include_deleted=True`` reproduces the
    reference's start-up load, which has no is_deleted filter.
    """
    src = servers if include_deleted else active(servers)
    return src.select("server_id", "server_name", "ipv4")


def monitored_set(changelog: DataFrame) -> DataFrame:
    """Replay a changelog of (seq, server_id, op[, payload...]).

    The last change per server by ``seq`` wins; a final ``delete`` removes
    the server. The pass over the whole log is a hash aggregate (``max(seq)``
    per server and op); the winning op per server is then picked among at
    most a few rows per server. Payload columns, when present, are joined
    back on the unique (server_id, seq) of the surviving entries.
    -> (server_id, seq[, payload...])
    """
    payload = [c for c in changelog.columns if c not in ("server_id", "seq", "op")]
    per_op = changelog.groupBy("server_id", "op").agg(F.max("seq").alias("seq"))
    last = per_op.groupBy("server_id").agg(F.max_by("op", "seq").alias("op"),
                                           F.max("seq").alias("seq"))
    live = last.where(F.col("op") != "delete").select("server_id", "seq")
    if payload:
        live = live.join(changelog.select("server_id", "seq", *payload), ["server_id", "seq"])
    return live


def monitored_resync(changelog: DataFrame, resyncs: list[int], include_deleted: bool = True) -> DataFrame:
    """The monitored set at the end of each period between resyncs.

    ``changelog``: (seq, server_id, op), op 'delete' or a put; ``resyncs``: the
    positions, in ``seq``, of the resyncs (start-ups; few). A resync replaces
    the whole set by the registry as of its position: every server that a
    change before it has put, deleted ones too unless ``include_deleted`` is
    false (the reference loads without an is_deleted filter). Changes from
    there on overlay it: a put sets a server, a delete removes it. Before the
    first resync (period 0) the set starts empty.

    -> (period, server_id, seq): ``seq`` of the put that the entry holds.
    An as-of merge without a join: the log is reduced to one row per server
    and period by hash aggregates; a server's few periods then give its rows.
    """
    points = F.array(*[F.lit(int(r)).cast("long") for r in sorted(resyncs)]).cast("array<long>")
    put = F.col("op") != "delete"
    logged = changelog.where("server_id is not null and seq is not null and op is not null").select(
        "server_id", "seq", "op", F.size(F.filter(points, lambda r: r <= F.col("seq"))).alias("period"))
    of_period = logged.groupBy("server_id", "period").agg(
        F.max("seq").alias("last"), F.max(F.when(put, F.col("seq"))).alias("put"))
    servers = of_period.groupBy("server_id").agg(F.collect_list(F.struct("period", "last", "put")).alias("periods"),
                                                 F.min(F.when(F.col("put").isNotNull(), F.col("period"))).alias("born"))
    each = servers.where("born is not null").select(
        "server_id", "periods", F.explode(F.sequence("born", F.lit(len(resyncs)))).alias("period"))
    own = F.get(F.filter("periods", lambda x: x["period"] == F.col("period")), 0)
    before = F.filter("periods", lambda x: x["period"] < F.col("period"))
    rows = each.select("server_id", "period", own.alias("own"), F.array_max(F.transform(before, lambda x: x["put"]))
                       .alias("loaded"), F.array_max(F.transform(before, lambda x: x["last"])).alias("changed"))
    here = F.when(F.col("own.last").isNotNull(), F.col("own.last") == F.col("own.put")).otherwise(
        F.col("loaded").isNotNull() & (F.lit(include_deleted) | (F.col("loaded") == F.col("changed"))))
    return rows.where(F.coalesce(here, F.lit(False))).select(
        "period", "server_id", F.coalesce("own.put", "loaded").alias("seq"))
