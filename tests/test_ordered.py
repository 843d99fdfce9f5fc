"""Ordered batches over many ranges, resyncs, pages, buckets, folded sums,
redelivery and strict decoding: against plain sequential versions."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid import schemas as S
from pulsegrid.functions.messages import decode_heartbeats, decode_probe_requests
from pulsegrid.operators import imports, pages, registry
from pulsegrid.session import list_dir, shared_dir
from pulsegrid.sources import fixtures as fx
from pulsegrid.streaming import heartbeats as streams
from pulsegrid.streaming import mail, probes, snapshots

T0 = dt.datetime(2024, 1, 1)


def sequential_insert(rows):
    ids, names, ok = set(), set(), set()
    for rn, sid, name in sorted(rows):
        if (sid is None or sid not in ids) and (name is None or name not in names):
            ids.add(sid)
            names.add(name)
            ok.add(rn)
    return ok


@pytest.mark.parametrize("range_rows", [1, 13, 100_000])
def test_import_over_ranges(spark, range_rows):
    rnd = random.Random(range_rows)
    n = 40 if range_rows == 1 else 400
    rows = [(i * 3 - 50, f"s{rnd.randrange(n // 4)}" if i % 5 else "hot", f"n{rnd.randrange(n // 3)}") for i in range(n)]
    rows += [(10_000 + i, None if i % 2 else "x", None if i % 3 else "y") for i in range(6)]
    cand = spark.createDataFrame(rows, "rn long, server_id string, server_name string").repartition(5)
    got = imports.greedy_merge(cand, range_rows=range_rows).collect()
    assert {r.rn for r in got if r.outcome == "success"} == sequential_insert(rows)
    assert len(got) == len(rows)


def test_import_by_other_orders(spark):
    rows = [(f"k{i:03}", f"s{i % 7}", f"n{i % 11}") for i in range(100)]
    cand = spark.createDataFrame(rows, "rn string, server_id string, server_name string")
    got = {r.rn for r in imports.greedy_merge(cand, range_rows=9).collect() if r.outcome == "success"}
    assert got == sequential_insert(rows)


def sequential_renames(held, wants):
    holder = dict(held)
    name_of = {s: n for n, s in held.items()}
    ok = set()
    for rn, server, want in sorted(wants):
        if holder.get(want, server) == server:
            if name_of.get(server) != want:
                holder.pop(name_of.get(server), None)
            holder[want], name_of[server] = server, want
            ok.add(rn)
    return ok


def renamed(spark, held, wants, range_rows):
    h = spark.createDataFrame(list(held.items()), "name string, holder string")
    w = spark.createDataFrame(wants, "rn long, server_id string, want string").repartition(4)
    return {r.rn for r in registry._rename_in_order(h, w, range_rows).collect()}


@pytest.mark.parametrize("seed,range_rows", [(1, 4), (2, 17), (3, 10_000)])
def test_renames_over_ranges(spark, seed, range_rows):
    rnd = random.Random(seed)
    held = {f"n{i}": f"s{i}" for i in range(14)}
    wants = [(i * 2, f"s{rnd.randrange(18)}", f"n{rnd.randrange(20)}" if rnd.random() < 0.7 else "n3")
             for i in range(30 if range_rows < 5 else 120)]
    assert renamed(spark, held, wants, range_rows) == sequential_renames(held, wants)


def test_renames_that_hand_on(spark):
    """A name that changes hands after every second request, and a chain in
    which each server waits for the name of the one before."""
    held = {f"c{i}": f"s{i}" for i in range(40)} | {"hot": "t0"}
    wants = [(i, f"s{i}", f"c{i - 1}" if i else "away") for i in range(40)]
    for i in range(30):
        wants += [(1000 + 3 * i, f"t{i + 1}", "hot"), (1001 + 3 * i, f"t{i}", f"free{i}"), (1002 + 3 * i, f"t{i + 1}", "hot")]
    for range_rows in (25, 100_000):
        assert renamed(spark, held, wants, range_rows) == sequential_renames(held, wants)


def test_refused_renames_cost_no_jobs(spark):
    """10,000 requests for a name that is held take as many jobs as 10."""
    jobs, tracker = [], spark.sparkContext.statusTracker()
    for n in (10, 10_000):
        servers = spark.createDataFrame(
            [(f"s{i}", f"n{i}", "1.1.1.1", "UNKNOWN", T0, None, None, False) for i in range(50)], S.SERVERS)
        patches = spark.range(n).select(F.col("id").alias("rn"), F.concat(F.lit("s"), 1 + F.col("id") % 49).alias("server_id"),
                                        F.lit("n0").alias("server_name"), F.lit("").alias("ipv4"))
        spark.sparkContext.setJobGroup(f"renames-{n}", "renames")
        _, out = registry.patch_servers(servers, patches, "2024-02-01")
        assert {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()} == {S.ERR_DUPLICATE: n}
        jobs.append(len(tracker.getJobIdsForGroup(f"renames-{n}")))
    assert jobs[1] <= jobs[0] + 2  # a small join may be planned another way


# ------------------------------------------------------------ messages

TIME = '"timestamp":"2024-01-01T00:00:00Z"'
GOOD = '{"server_id":"a","status":"on",' + TIME + "}"


@pytest.mark.parametrize("text,want", [
    (GOOD, ("a", "on")), (f" {GOOD}\n", ("a", "on")), (GOOD + ',"x":1', None), (GOOD + ',"m2":{"q":[1]}', None),
    (GOOD + "," + GOOD, None), (GOOD + "]", None), (GOOD + "} x", None), (GOOD + " x", None), ("[" + GOOD + "]", None),
    ("", None), (None, None), ("null", None), ("5", None), (GOOD[:-1], None), ("{" + TIME + "}", ("", "")),
    ('{"SERVER_ID":"b","Status":"off",' + TIME + "}", ("b", "off")),
    ('{"server_id":"b","Server_ID":"c",' + TIME + "}", ("c", "")),
    ('{"Server_ID":"c","server_id":"b",' + TIME + "}", ("b", "")),
    ('{"server_id":"b","server_id":null,' + TIME + "}", ("b", "")),
    ('{"server_id":1,"server_id":"b",' + TIME + "}", None), ('{"status":["on"],' + TIME + "}", None),
    ('{"x":{"y":1,"y":2},"server_id":"d",' + TIME + "}", ("d", "")),
    ('{"server_id":"e","timestamp":"2024-13-01T00:00:00Z"}', None),
    ('{"ſerver_id":"f",' + TIME + "}", ("f", "")),
])
def test_decode(spark, text, want):
    df = spark.createDataFrame([(1, text)], "seq long, value string")
    got = [(r.server_id, r.status) for r in decode_heartbeats(df).collect()]
    assert got == ([want] if want else [])


def test_decode_of_other_messages(spark):
    probes = ['{"ServerID":"1","ServerName":"n","IP":"2"}', '{"serverid":"1","IP":null}', '{"ServerID":"1"},"IP":"2"']
    df = spark.createDataFrame(list(enumerate(probes)), "seq long, value string")
    assert sorted(tuple(r) for r in decode_probe_requests(df).collect()) == [(0, "1", "n", "2"), (1, "1", "", "")]
    mails = ['{"mail":{"attachments":[{"FileName":"a"},{"filename":null},null]}}', '{"Mail":null}', "{}",
             '{"Mail":{"To":["x",1]}}', '{"Mail":{"Attachments":[{"Filename":1}]}}', '{"Mail":{}},"Mail":{}',
             '{"Mail":{"From":{}}}', '{"Mail":[]}']
    df = spark.createDataFrame(list(enumerate(mails)), "seq long, value string")
    got = {r.mail_id: r.Mail.Attachments and [a.Filename for a in r.Mail.Attachments] for r in mail.decode_mail(df).collect()}
    assert got == {0: ["a", "", ""], 1: None, 2: None}


# ------------------------------------------------------------ registry

def test_resync(spark):
    rnd = random.Random(4)
    log = [(i, f"s{rnd.randrange(12)}", rnd.choice(["put", "delete", "put"])) for i in range(1, 120)]
    log += [(200, None, "put"), (201, "late", "put"), (202, "never", "delete")]
    resyncs = [30, 31, 90, 203]
    for deleted in (True, False):
        want = set()
        for period in range(len(resyncs) + 1):
            start = resyncs[period - 1] if period else 0
            stop = resyncs[period] if period < len(resyncs) else 10 ** 6
            known, live, cache = {}, {}, {}
            for seq, sid, op in log:
                if sid is None or seq >= start:
                    continue
                if op == "delete":
                    live.pop(sid, None)
                else:
                    known[sid] = live[sid] = seq
            if period:
                cache = dict(known if deleted else live)
            for seq, sid, op in log:
                if sid is not None and start <= seq < stop:
                    if op == "delete":
                        cache.pop(sid, None)
                    else:
                        cache[sid] = seq
            want |= {(period, s, q) for s, q in cache.items()}
        df = spark.createDataFrame(log, "seq long, server_id string, op string").repartition(3)
        assert {tuple(r) for r in registry.monitored_resync(df, resyncs, deleted).collect()} == want
    assert registry.monitored_resync(df.limit(0), [5]).count() == 0
    assert {tuple(r) for r in registry.monitored_resync(df, []).collect()} == {
        (0, r.server_id, r.seq) for r in registry.monitored_set(df.where("server_id is not null")).collect()}


def test_pages_read_few_files(spark, sf001):
    servers = fx.servers(spark, sf001).withColumn(
        "created_at", F.when(F.col("server_id") % 5 != 0, F.date_trunc("hour", "created_at").cast("timestamp_ntz")))
    root = shared_dir(spark, "t-pages")
    pages.write_pages(servers, root, file_rows=20)
    total = registry.count_servers(servers).first()["total"]
    for field, desc, lo, hi in (("created_at", False, 0, 30), ("created_at", True, 95, 170), ("server_name", False, 19, 21),
                                ("server_name", True, total - 3, total + 50), ("created_at", False, total + 5, total + 9)):
        want = [tuple(r) for r in registry.list_servers(servers, lo, hi, field, desc).collect()]
        assert [tuple(r) for r in pages.read_page(spark, root, lo, hi, field, desc).collect()] == want
        assert len(pages.page_files(spark, root, lo, hi, field, desc)) <= (hi - lo) // 20 + 3
    with pytest.raises(ValueError):
        pages.read_page(spark, root, 5, 5)


# ------------------------------------------------------------ streams

def test_status_log_before_the_first_batch(spark, sf001):
    log, root = shared_dir(spark, "t-none"), shared_dir(spark, "t-none-snap")
    servers = fx.servers(spark, sf001)
    assert streams.read_status_log(spark, log).count() == 0
    assert streams.status_view(spark, servers, log, root).count() == servers.count()
    streams.compact_status(spark, servers, log, root, 0)
    assert snapshots.folded(spark, root) == {} and snapshots.read_current(spark, root).count() == servers.count()


def test_a_new_checkpoint_is_another_stream(spark, sf001):
    """Batches of a stream that starts again from 0 are not taken for folded."""
    hb, reg = fx.hb(spark, sf001), fx.servers(spark, sf001)
    log, root = shared_dir(spark, "t-two-log"), shared_dir(spark, "t-two-snap")
    for version, half in enumerate((F.col("seq") % 2 == 0, F.col("seq") % 2 == 1)):
        src = shared_dir(spark, "t-two-src")
        streams.write_message_files(hb.where(half), src)
        streams.start_status(streams.heartbeat_file_source(spark, src), log, shared_dir(spark, "t-two-ckpt")).awaitTermination()
        streams.compact_status(spark, reg, log, root, version)
    assert len(snapshots.folded(spark, root)) == 2 and not any(streams.logged_batches(spark, log).values())
    want = streams.current_status(reg, hb.select("server_id", "status", F.col("ts").alias("last_ping_at"), "seq"))
    assert sorted(snapshots.read_current(spark, root).collect(), key=str) == sorted(want.collect(), key=str)


def test_compaction_writes_touched_buckets_only(spark, sf001):
    servers, path, log = fx.servers(spark, sf001), shared_dir(spark, "t-buckets"), shared_dir(spark, "t-bucket-log")
    streams.write_registry_buckets(servers, path, 32)
    before = {b: list_dir(spark, f"{path}/{b}") for b in list_dir(spark, path) if b.startswith("bucket=")}
    few = spark.createDataFrame([(i, f"{i}", "on", T0 + dt.timedelta(days=4000)) for i in (3, 5, 8)] + [(9, "unknown", "on", T0)],
                                "seq long, server_id string, status string, ts timestamp_ntz")
    streams.status_batch_writer(log)(few, 0)
    assert streams.compact_status_buckets(spark, log, path, 32) <= 4
    after = {b: list_dir(spark, f"{path}/{b}") for b in list_dir(spark, path) if b.startswith("bucket=")}
    assert sum(before[b] != after[b] for b in before) <= 4 and set(before) == set(after)
    got = streams.read_registry_buckets(spark, path)
    assert got.count() == servers.count()
    assert {r.server_id for r in got.where("status = 'on'").collect()} == {"3", "5", "8"}
    assert streams.compact_status_buckets(spark, log, path, 32) == 0  # nothing logged


def test_daily_sums_are_folded(spark, sf001):
    from pulsegrid.operators.uptime import uptime_daily
    hb, parts = fx.hb(spark, sf001), shared_dir(spark, "t-fold")
    writer = streams.daily_batch_writer(parts, fold=2)
    for i in range(7):
        writer(hb.where(F.col("seq") % 7 == i), i)
        if i == 4:
            writer(hb.where(F.col("seq") % 7 == i), i)  # replayed
    folders = streams.daily_folders(spark, parts)
    assert sorted(f.split("/level=")[1] for f in folders) == ["0/first=6/last=6", "1/first=4/last=5", "2/first=0/last=3"]
    assert sorted(streams.read_daily(spark, parts).collect()) == sorted(uptime_daily(hb).collect())
    assert streams.read_daily(spark, shared_dir(spark, "t-no-fold")).count() == 0


def test_archive_once(spark, sf001):
    hb = fx.hb(spark, sf001).withColumn("dt", F.to_date("ts"))
    sink = shared_dir(spark, "t-once")
    writer = streams.once_writer(sink)
    writer(hb.where("seq % 3 <> 0").union(hb.where("seq % 6 = 1")), 0)  # some twice in a batch
    writer(hb.where("seq % 3 <> 0").union(hb.where("seq % 6 = 0")), 1)  # redelivered, and new ones
    writer(hb.where("seq % 3 <> 0").union(hb.where("seq % 6 = 0")), 1)  # replayed
    writer(hb, 2)
    assert sorted(streams.read_archive_once(spark, sink).collect()) == sorted(
        hb.select("seq", "server_id", "status", "ts", "dt").collect())


def test_status_changes_only(spark):
    rows = [(i, f"s{i % 3}", "on" if i < 30 or i % 3 else "off", T0 + dt.timedelta(minutes=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, server_id string, status string, ts timestamp_ntz")
    src, out, ckpt = (shared_dir(spark, f"t-ch-{n}") for n in ("src", "out", "ckpt"))
    seen = []
    for part in (df.where("seq < 20"), df.where("seq >= 20 and seq < 30"), df.where("seq >= 30")):
        streams.write_message_files(part, src)
        streams.start_status_changes(streams.heartbeat_file_source(spark, src), out, ckpt).awaitTermination()
        rows = spark.read.schema(streams.STATUS_LOG).parquet(out).collect()
        seen.append(sorted((r.server_id, r.status) for r in rows))
    assert seen[0] == seen[1] == [("s0", "on"), ("s1", "on"), ("s2", "on")]
    assert seen[2] == sorted(seen[0] + [("s0", "off")])


def test_ticks_of_cycles_beyond_the_sources_limit(spark):
    """A cycle of 40 days has more milliseconds than an int holds."""
    day = 86_400_000
    for cycle in (day, 40 * day):
        out, ckpt = shared_dir(spark, "t-ticks"), shared_dir(spark, "t-ticks-ckpt")
        server = spark.createDataFrame([("1", "n", "10.0.0.1", False)],
                                       "server_id string, server_name string, ipv4 string, is_deleted boolean")
        for _ in range(3):  # a tick a run, resumed from the checkpoint
            ticks = probes.tick_source(spark, 19_723 * day, cycle)
            probes.start_fan_out(ticks, probes.at_tick(lambda: server), out, ckpt).awaitTermination()
        got = sorted(r["tick"] for r in probes.read_fan_out(spark, out).collect())
        assert got == [T0 + dt.timedelta(milliseconds=cycle * i) for i in range(3)]


def test_ranges_wait_by_narrow_marks(spark):
    """Keys meet over ranges by key and position alone: the rest of a row moves once a pass."""
    rows = [(i, i // 2, f"s{i % 7}", f"n{i % 5}") for i in range(12)]
    left = spark.createDataFrame(rows, "position long, range long, server_id string, server_name string")
    marks = imports._waits(left, "server_id")
    assert marks.columns == ["position", "range", "waits"]
    assert sorted(r["position"] for r in marks.collect()) == [7, 8, 9, 10, 11]


def test_status_fold_works_on_arrays():
    class Rows(pd.DataFrame):
        def sort_values(self, *args, **kwargs):
            raise AssertionError("a frame operation for each server")
        __getitem__ = lambda self, c: pd.DataFrame.__getitem__(self, c) if isinstance(c, str) else self.sort_values()

    class State:
        exists = False

        def update(self, value):
            self.exists, self.get = True, value

    state, piece = State(), lambda *rows: Rows(rows, columns=["micros", "seq", "status"])
    first = list(streams.fold_status(("a",), iter([piece((5, 1, "on"), (9, 2, "off")), piece((9, 3, "on"), (2, 8, "off"))]), state))
    assert [tuple(r) for f in first for r in f[["status", "seq"]].to_numpy()] == [("on", 3)] and state.get == ("on", 9, 3)
    assert not list(streams.fold_status(("a",), iter([piece((9, 4, "on"), (8, 9, "off"))]), state)) and state.get == ("on", 9, 4)
    assert not list(streams.fold_status(("a",), iter([piece((3, 99, "off"))]), state)) and state.get == ("on", 9, 4)
