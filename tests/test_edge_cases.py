"""Hand-built cases for each semantic trap (FIXTURES.md §4, SURVEY §1.4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrid import schemas as S
from pulsegrid.functions.messages import decode_heartbeats
from pulsegrid.functions.predicates import ipv4_ok
from pulsegrid.operators import exports, imports, messages, registry, uptime
from pulsegrid.operators.heartbeats import latest_status

T0 = dt.datetime(2024, 1, 1)


def hb_df(spark, rows):
    return spark.createDataFrame(rows, "seq long, server_id string, status string, ts timestamp_ntz")


def servers_df(spark, rows):
    full = [(i, n, ip, "UNKNOWN", T0, None, None, d) for i, n, ip, d in rows]
    return spark.createDataFrame(full, S.SERVERS)


VALID_IPS = ["1.2.3.4", "0.0.0.0", "255.255.255.255", "::ffff:1.2.3.4", "::FFFF:10.0.0.1"]
INVALID_IPS = ["01.2.3.4", "256.1.1.1", "1.2.3", "1.2.3.4.5", "", " 1.2.3.4", "1.2.3.4\n",
               "::1", None, "1.2.3.04", "a.b.c.d"]


def test_ipv4(spark):
    rows = [(ip, True) for ip in VALID_IPS] + [(ip, False) for ip in INVALID_IPS]
    df = spark.createDataFrame(rows, "ip string, want boolean")
    got = df.select("ip", "want", ipv4_ok("ip").alias("got")).collect()
    assert all(r.got == r.want for r in got), [r for r in got if r.got != r.want]


def test_bounds_half_open_and_second_truncated(spark):
    rows = [(1, "a", "on", dt.datetime(2024, 1, 5)),              # at from: in
            (2, "a", "on", dt.datetime(2024, 1, 12)),             # at to: out
            (3, "a", "off", dt.datetime(2024, 1, 11, 23, 59, 59, 999999)),
            (4, "b", "on", dt.datetime(2024, 1, 4, 23, 59, 59))]
    hb = hb_df(spark, rows)
    r = uptime.uptime_report(hb, "2024-01-05 00:00:00.7", "2024-01-12 00:00:00.9").collect()
    assert [(x.server_id, x.doc_count) for x in r] == [("a", 2)]
    assert r[0].start_ping_at == dt.datetime(2024, 1, 5)
    assert r[0].uptime_ratio == 0.5


def test_ratio_counts_non_null_statuses(spark):
    rows = [(1, "x", "on", T0), (2, "x", "on", T0), (3, "x", "off", T0),
            (4, "y", "on", T0), (5, "y", None, T0),
            (6, "z", None, T0), (7, "z", None, T0)]
    r = {x.server_id: x for x in uptime.uptime_all(hb_df(spark, rows)).collect()}
    assert r["x"].uptime_ratio == pytest.approx(2 / 3)
    assert (r["y"].uptime_ratio, r["y"].doc_count) == (1.0, 2)
    assert (r["z"].uptime_ratio, r["z"].doc_count) == (0.0, 2)


def test_report_from_equals_to_is_empty(spark):
    hb = hb_df(spark, [(1, "a", "on", T0)])
    assert uptime.uptime_report(hb, T0, T0).count() == 0


def test_report_cap_and_order(spark):
    rows = [(i, f"s{i % 5}", "on", T0) for i in range(20)] + [(100, "s9", "on", T0)]
    r = uptime.rank_report(uptime.uptime_all(hb_df(spark, rows)), cap=3).collect()
    assert [x.server_id for x in r] == ["s0", "s1", "s2"]


def test_daily_cap_per_day(spark):
    # day 1: s0..s4 six rows each, s5 s6 five; day 2: s5 s6 five rows, the rest four
    rows = [(i, f"s{i % 7}", "on", T0 + dt.timedelta(days=int(i >= 40), minutes=i))
            for i in range(70)]
    r = uptime.uptime_daily(hb_df(spark, rows), cap=2).collect()
    assert sorted((x.day.isoformat(), x.server_id, x.doc_count) for x in r) == [
        ("2024-01-01", "s0", 6), ("2024-01-01", "s1", 6),
        ("2024-01-02", "s5", 5), ("2024-01-02", "s6", 5)]


def test_latest_by_time_then_seq(spark):
    rows = [(1, "a", "on", T0), (2, "a", "off", T0), (3, "a", "on", T0 - dt.timedelta(1))]
    by_time = latest_status(hb_df(spark, rows)).collect()[0]
    assert (by_time.status, by_time.seq) == ("off", 2)
    by_arrival = latest_status(hb_df(spark, rows), order_by="arrival").collect()[0]
    assert (by_arrival.status, by_arrival.seq) == ("on", 3)


def test_status_update_unknown_ids_dropped_deleted_updated(spark):
    reg = servers_df(spark, [("a", "na", "1.1.1.1", False), ("d", "nd", "1.1.1.2", True)])
    latest = spark.createDataFrame(
        [("a", "on", T0), ("d", "off", T0), ("zz", "on", T0)],
        "server_id string, status string, last_ping_at timestamp_ntz")
    out = {r.server_id: r for r in registry.apply_status(reg, latest).collect()}
    assert set(out) == {"a", "d"}
    assert out["a"].status == "on" and out["d"].status == "off"


def test_status_update_older_heartbeat_does_not_win(spark):
    reg = servers_df(spark, [("a", "na", "1.1.1.1", False)])
    new = spark.createDataFrame([("a", "on", T0)], "server_id string, status string, "
                                                   "last_ping_at timestamp_ntz")
    old = spark.createDataFrame([("a", "off", T0 - dt.timedelta(hours=1))],
                                "server_id string, status string, last_ping_at timestamp_ntz")
    r = registry.apply_status(registry.apply_status(reg, new), old).collect()[0]
    assert (r.status, r.last_ping_at) == ("on", T0)


def test_chain_import(spark):
    cand = spark.createDataFrame([(1, "A", "x"), (2, "B", "x"), (3, "B", "y")],
                                 "rn long, server_id string, server_name string")
    r = {x.rn: x.outcome for x in imports.greedy_merge(cand).collect()}
    assert r == {1: "success", 2: S.ERR_DUPLICATE, 3: "success"}


def test_deleted_keys_conflict(spark):
    reg = servers_df(spark, [("a", "na", "1.1.1.1", True)])
    creates = spark.createDataFrame(
        [(1, "a", "new", "1.1.1.1"), (2, "b", "na", "1.1.1.1"), (3, "c", "nc", "1.1.1.1"),
         (4, "e", "ne", "300.1.1.1"), (5, "c", "other", "1.1.1.1")],
        "rn long, server_id string, server_name string, ipv4 string")
    r = {x.rn: x.outcome for x in imports.create_servers(reg, creates).collect()}
    assert r == {1: S.ERR_DUPLICATE, 2: S.ERR_DUPLICATE, 3: "created", 4: S.ERR_INVALID_IP,
                 5: S.ERR_DUPLICATE}


def test_import_summary_order(spark):
    recs = spark.createDataFrame(
        [(1, "a", "n1", "1.1.1.1"), (2, "b", "n2", "bad"), (3, "a", "n3", "1.1.1.1"),
         (4, "c", "n4", "1.1.1.1")],
        "rn long, server_id string, server_name string, ipv4 string")
    done = imports.import_records(recs)
    assert {r.outcome: r.total for r in imports.import_summary(done).collect()} == {"success": 2, "failed": 2}
    rows = sorted(tuple(r) for r in imports.import_results(done).collect())
    assert rows == [("failed", 0, "a"), ("failed", 1, "b"), ("success", 0, "a"), ("success", 1, "c")]


def test_sheet_header_only_and_short_row(spark):
    rows = spark.createDataFrame(
        [("f1", 0, ["h0", "h1", "h2", "h3"]),
         ("f2", 0, ["h0", "h1", "h2", "h3"]), ("f2", 1, ["0", "a", "n", "1.1.1.1"]),
         ("f2", 2, ["0", "b", "m"]),
         ("f3", 0, ["h"]), ("f3", 1, ["0", "c", "k", "1.1.1.1", "extra"])],
        S.SHEET_ROW)
    recs = imports.sheet_records(rows, header_rows=1).collect()
    assert [(r.file_id, r.server_id, r.ipv4) for r in recs] == [("f3", "c", "1.1.1.1")]
    bad = [r.file_id for r in imports.rejected_files(rows, header_rows=1).collect()]
    assert bad == ["f2"]


def test_mail_ready(spark):
    mails = spark.createDataFrame(
        [(1, ("", ["a@b"], "s", "b", []))],
        "mail_id long, Mail struct<From:string,To:array<string>,Subject:string,Body:string,"
        "Attachments:array<struct<Filename:string,Data:binary>>>")
    mails = mails.unionByName(spark.createDataFrame(
        [(2, ("", ["a@b"], "s", "b", [("r1.csv", None), ("r2.csv", None)])),
         (3, ("", ["a@b"], "s", "b", [("r1.csv", None)]))], mails.schema))
    files = spark.createDataFrame([("r1.csv",)], "filename string")
    r = {x.mail_id: x.ready for x in messages.mail_ready(mails, files).collect()}
    assert r == {1: True, 2: False, 3: True}


def test_page_requests(spark):
    req = spark.createDataFrame(
        [(1, 0, 250, "created_at"), (2, 5, 5, "server_name"), (3, -1, 3, "created_at"),
         (4, 0, 10, "status"), (5, 0, 10, None), (6, 3, 50, "server_name")],
        "req_id long, from_row int, to_row int, sort_field string")
    r = {x.req_id: (x.to_row, x.error) for x in registry.check_page_requests(req).collect()}
    assert r == {1: (100, None), 2: (5, S.ERR_INVALID_PAGINATION),
                 3: (3, S.ERR_INVALID_PAGINATION), 4: (10, S.ERR_INVALID_SORT),
                 5: (10, S.ERR_INVALID_SORT), 6: (50, None)}
    with pytest.raises(ValueError):
        registry.validate_page(0, 10, "status")


def test_report_requests(spark):
    t = dt.datetime(2024, 1, 5)
    req = spark.createDataFrame(
        [(1, t, t, ["a@b.c"]), (2, t, t - dt.timedelta(1), ["a@b.c"]), (3, t, t, []),
         (4, t, t, ["no-at-sign"]), (5, t, t, ["a@b.c", "x y@z"])],
        "req_id long, from_ts timestamp_ntz, to_ts timestamp_ntz, receivers array<string>")
    r = {x.req_id: x.error for x in messages.check_report_requests(req).collect()}
    assert r == {1: None, 2: S.ERR_INVALID_TIME_RANGE, 3: S.ERR_INVALID_EMAIL,
                 4: S.ERR_INVALID_EMAIL, 5: S.ERR_INVALID_EMAIL}
    out = messages.mail_outbox(req).collect()
    assert [(o.req_id, o.filename) for o in out] == [(1, "report-1.csv")]
    assert '"Subject":"Server uptime report"' in out[0].value
    assert '"Attachments":[{"Filename":"report-1.csv","Data":""}]' in out[0].value


MESSAGES = [
    (1, '{"server_id":"a","status":"on","timestamp":"2024-01-01T00:00:00Z"}', True),
    (2, '{"server_id":"a","status":"on","timestamp":"2024-01-01T01:00:00+01:00"}', True),
    (3, '{"server_id":"a","status":"on","timestamp":"2024-01-01T00:00:00.123456789Z"}', True),
    (4, '{"server_id":"a","timestamp":"2024-01-01T00:00:00Z"}', True),
    (5, 'not json', False),
    (6, '{"server_id":"a","status":"on"}', False),
    (7, '{"server_id":"a","status":"on","timestamp":"2024-01-01 00:00:00"}', False),
    (8, '{"server_id":"a","status":"on","timestamp":"2024-02-30T00:00:00Z"}', False),
    (9, '{"server_id":"a","status":"on","timestamp":"yesterday"}', False),
    (10, 'null', False),
    (11, '[1,2]', False),
]


def test_decode_rules(spark):
    df = spark.createDataFrame([(s, v) for s, v, _ in MESSAGES], "seq long, value string")
    got = {r.seq: r for r in decode_heartbeats(df).collect()}
    assert set(got) == {s for s, _, ok in MESSAGES if ok}
    assert got[2].ts == dt.datetime(2024, 1, 1)
    assert got[3].ts == dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
    assert got[4].status == ""


def test_probe_classification(spark):
    df = spark.createDataFrame([(1, "a", None, 1), (2, "a", "timeout", 1), (3, "a", None, 0),
                                (4, "a", None, None)],
                               "seq long, server_id string, error string, packets_recv long")
    r = {x.seq: x.status for x in messages.classify_probe(df).collect()}
    assert r == {1: "on", 2: "off", 3: "off", 4: "off"}


def test_probe_requests_ticks(spark):
    mon = spark.createDataFrame([("a", "na", "1.1.1.1")], "server_id string, server_name string, "
                                                          "ipv4 string")
    r = messages.probe_requests(mon, "2024-01-01 00:00:00", "2024-01-01 00:02:00", 60).collect()
    assert [x.tick for x in r] == [T0, T0 + dt.timedelta(minutes=1), T0 + dt.timedelta(minutes=2)]
    js = messages.probe_messages(messages.probe_requests(mon, T0, T0, 60)).collect()[0].value
    assert js == '{"ServerID":"a","ServerName":"na","IP":"1.1.1.1"}'


def test_patch_and_delete(spark):
    reg = servers_df(spark, [("a", "na", "1.1.1.1", False), ("b", "nb", "1.1.1.2", False),
                             ("d", "nd", "1.1.1.3", True)])
    patches = spark.createDataFrame(
        [(1, "a", "", None), (2, "b", "nd", None), (3, "d", "x", None), (4, "zz", "y", None),
         (5, "a2", "q", "999.1.1.1"), (6, "a", "nb", "2.2.2.2"), (7, "b", "free", "3.3.3.3"),
         (8, "a", "nb", None), (9, "b", "na", ""), (10, "a", "nb", "4.4.4.4")],
        "rn long, server_id string, server_name string, ipv4 string")
    new_reg, out = registry.patch_servers(reg, patches, "2024-02-01 00:00:00")
    assert [r.outcome for r in sorted(out.collect())] == [
        "updated", S.ERR_DUPLICATE, S.ERR_NOT_FOUND, S.ERR_NOT_FOUND, S.ERR_INVALID_IP, S.ERR_DUPLICATE,
        "updated", "updated", "updated", "updated"]  # a takes the name that b gave up, b then a's
    rows = {r.server_id: r for r in new_reg.collect()}
    assert len(rows) == 3 and new_reg.count() == 3
    assert (rows["a"].server_name, rows["a"].ipv4) == ("nb", "4.4.4.4")
    assert (rows["b"].server_name, rows["b"].ipv4) == ("na", "3.3.3.3")
    assert rows["a"].metadata_updated_at == dt.datetime(2024, 2, 1) and rows["d"].metadata_updated_at is None
    ids = spark.createDataFrame([(1, "a"), (2, "d"), (3, "zz"), (4, "a")], "rn long, server_id string")
    reg2, dout = registry.soft_delete(reg, ids)
    assert {r.rn: r.outcome for r in dout.collect()} == {
        1: "deleted", 2: S.ERR_NOT_FOUND, 3: S.ERR_NOT_FOUND, 4: S.ERR_NOT_FOUND}
    assert registry.count_servers(reg2).first().total == 1


def test_times_before_1970_and_strict_messages(spark):
    from pulsegrid.functions.messages import decode_heartbeats
    from pulsegrid.operators.heartbeats import latest_status
    from pulsegrid.streaming.mail import decode_mail
    head = '{"server_id":"a","status":"on","timestamp":"'
    values = [head + '0001-01-01T00:00:00Z"}', head + '1969-12-31T23:59:59Z"}', head + '2024-01-01T00:00:00Z"} x',
              head + '2024-01-01T00:00:00Z"}]', '{"server_id":{"a":1},"timestamp":"2024-01-01T00:00:00Z"}',
              '{"server_id":7,"timestamp":"2024-01-01T00:00:00Z"}', "null", '"text"', "", None]
    df = spark.createDataFrame(list(enumerate(values)), "seq long, value string")
    hb = decode_heartbeats(df)
    assert sorted(r.seq for r in hb.collect()) == [0, 1]
    last = latest_status(hb).first()
    assert (last.seq, last.last_ping_at) == (1, dt.datetime(1969, 12, 31, 23, 59, 59))
    mails = ['{"Mail":{"Attachments":[{"Filename":"f","Data":null}]}}', '{"Mail":{"Attachments":"oops"}}',
             '{"Mail":{"To":"x"}}', '{"Mail":{"Attachments":[{"Filename":1}]}}', '{"Mail":{}} {}', '{"Mail":{"To":["x"]}}']
    got = decode_mail(spark.createDataFrame(list(enumerate(mails)), "seq long, value string")).collect()
    assert sorted(r.mail_id for r in got) == [0, 5]


def test_addresses(spark):
    from pulsegrid.functions.predicates import email_ok, ipv4_ok
    good = ["a@b.c", "Bob <a@b.c>", '"B, C" <a@b>', " a.b+c@d-e.f ", "é@b.c"]
    bad = ["a..b@c", "a@", "@b", "a b@c", "Bob a@b.c", "a@b.c>", ".a@b", "", None]
    df = spark.createDataFrame([(x,) for x in good + bad], "x string")
    assert [r[0] for r in df.select(email_ok("x")).collect()] == [True] * len(good) + [False] * len(bad)
    good = ["1.2.3.4", "::ffff:1.2.3.4", "::FFFF:102:304", "0:0:0:0:0:ffff:1.2.3.4", "0000:0000::ffff:0102:0304"]
    bad = ["01.2.3.4", "1.2.3", "::ffff:1.2.3.256", "::1", "::fffe:1.2.3.4", "0:0:0:0:0:0:ffff:1.2.3.4", "1.2.3.4\n"]
    df = spark.createDataFrame([(x,) for x in good + bad], "x string")
    assert [r[0] for r in df.select(ipv4_ok("x")).collect()] == [True] * len(good) + [False] * len(bad)


def test_null_server_is_in_no_report(spark):
    from pulsegrid.operators import uptime
    hb = spark.createDataFrame([(1, None, "on", T0), (2, "a", "on", T0)],
                               "seq long, server_id string, status string, ts timestamp_ntz")
    assert [r.server_id for r in uptime.uptime_all(hb).collect()] == ["a"]
    assert [r.server_id for r in uptime.uptime_daily(hb).collect()] == ["a"]


def test_monitored_set_include_deleted(spark):
    reg = servers_df(spark, [("a", "na", "1.1.1.1", False), ("d", "nd", "1.1.1.3", True)])
    assert registry.monitored_from_registry(reg).count() == 1
    assert registry.monitored_from_registry(reg, include_deleted=True).count() == 2


def test_exports_format_zero_time(spark):
    reg = servers_df(spark, [("a", "na", "1.1.1.1", False), ("b", "nb", "1.1.1.2", False)])
    page = registry.list_servers(reg, 0, 10, "server_name", desc=True)
    rows = exports.export_servers(page, "server_name", desc=True).collect()
    assert [(r.order_number, r.server_id) for r in rows] == [(1, "b"), (2, "a")]
    assert rows[0].created_at == "2024-01-01 00:00:00"
    assert rows[0].last_ping_at == "0001-01-01 00:00:00"
    named = exports.with_headers(exports.export_servers(page), exports.SERVER_HEADERS)
    assert named.columns[0] == "Order number" and named.columns[-1] == "LastPingAt"


def test_monitored_set_keeps_payload_of_last_put(spark):
    log = spark.createDataFrame(
        [(1, "a", "put", "n1"), (2, "a", "put", "n2"), (3, "b", "put", "m1"),
         (4, "b", "delete", None), (5, "c", "delete", None), (6, "c", "put", "k1")],
        "seq long, server_id string, op string, server_name string")
    got = {r.server_id: (r.seq, r.server_name) for r in registry.monitored_set(log).collect()}
    assert got == {"a": (2, "n2"), "c": (6, "k1")}
