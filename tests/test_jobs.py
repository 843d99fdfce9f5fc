"""End-to-end jobs: report -> file -> outbox; import -> registry; export;
attachment listing; status compaction."""

import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from pulsegrid import schemas as S
from pulsegrid.operators import exports, messages
from pulsegrid.plans import jobs
from pulsegrid.sources import fixtures as fx
from pulsegrid.sources.sheets import read_xlsx_sheets, write_xlsx
from pulsegrid.streaming import heartbeats as streams
from pulsegrid.streaming import snapshots


def _read_csv(folder):
    files = glob.glob(os.path.join(folder, "part-*.csv"))
    assert len(files) == 1
    with open(files[0], newline="") as f:
        return list(csv.reader(f))


def test_report_job(spark, sf001, tmp_path):
    hb = fx.hb(spark, sf001)
    out = jobs.report_job(spark, hb, "2024-01-05", "2024-01-12", ["ops@example.com"],
                          str(tmp_path), "r1").collect()
    assert out[0].filename == "report-r1.csv"
    rows = _read_csv(str(tmp_path / "report-r1.csv"))
    assert rows[0] == exports.REPORT_HEADERS
    assert [int(r[0]) for r in rows[1:]] == list(range(1, len(rows)))
    counts = [int(r[5]) for r in rows[1:]]
    assert counts == sorted(counts, reverse=True)
    with pytest.raises(ValueError, match=S.ERR_INVALID_TIME_RANGE):
        jobs.report_job(spark, hb, "2024-01-12", "2024-01-05", ["a@b.c"], str(tmp_path), "r2")
    with pytest.raises(ValueError, match=S.ERR_INVALID_EMAIL):
        jobs.report_job(spark, hb, "2024-01-05", "2024-01-12", [], str(tmp_path), "r3")


def test_import_job(spark, sf001, tmp_path):
    reg = fx.servers(spark, sf001)
    existing = reg.first()
    write_xlsx(str(tmp_path / "a.xlsx"), [
        ["No", "ServerID", "ServerName", "IPv4"],
        ["1", "new-1", "name-1", "10.0.0.1"],
        ["2", existing.server_id, "name-2", "10.0.0.2"],
        ["3", "new-3", "name-1", "10.0.0.3"],
        ["4", "new-4", "name-4", "10.0.0.256"]])
    sheets = read_xlsx_sheets(spark, str(tmp_path))
    res, summary, bad, new_reg = jobs.import_job(spark, sheets, reg, "2024-03-01 00:00:00")
    got = sorted((r.row_no, r.outcome) for r in res.collect())
    assert got == [(1, "success"), (2, S.ERR_DUPLICATE), (3, S.ERR_DUPLICATE),
                   (4, S.ERR_INVALID_IP)]
    assert {r.outcome: r.total for r in summary.collect()} == {"success": 1, "failed": 3}
    assert bad.count() == 0
    assert new_reg.count() == reg.count() + 1
    added = new_reg.where("server_id = 'new-1'").first()
    assert (added.status, added.is_deleted) == ("UNKNOWN", False)


def test_export_job(spark, sf001, tmp_path):
    path = str(tmp_path / "servers")
    jobs.export_job(fx.servers(spark, sf001), 0, 500, "server_name", False, path)
    rows = _read_csv(path)
    assert rows[0] == exports.SERVER_HEADERS
    assert len(rows) == 101  # page width clamped to 100
    assert "0001-01-01 00:00:00" in {r[7] for r in rows[1:]}


def test_attachment_listing(spark, tmp_path):
    store = tmp_path / "store" / "2024"
    store.mkdir(parents=True)
    (store / "report-1.csv").write_text("x")
    (tmp_path / "store" / "report-2.csv").write_text("y")
    files = messages.list_attachment_files(spark, str(tmp_path / "store"))
    assert sorted(r.filename for r in files.collect()) == ["report-1.csv", "report-2.csv"]
    items = spark.createDataFrame([(1, 0, "report-1.csv"), (1, 1, "report-2.csv"),
                                   (2, 0, "report-3.csv")],
                                  "mail_id long, pos long, filename string")
    r = {x.mail_id: x.ready for x in messages.attachment_ready(items, files).collect()}
    assert r == {1: True, 2: False}


def test_compact_status(spark, sf001):
    from pulsegrid.session import shared_dir
    hb = fx.hb(spark, sf001)
    log = shared_dir(spark, "t-log")
    writer = streams.status_batch_writer(log)
    writer(hb.where("seq % 3 = 0"), 0)
    writer(hb.where("seq % 3 <> 0"), 1)
    root = shared_dir(spark, "t-snap")
    streams.compact_status(spark, fx.servers(spark, sf001), log, root, 7)
    assert streams.read_status_log(spark, log).count() == 0  # what is folded is removed
    assert snapshots.folded(spark, root) == {"none": 1}
    cur = snapshots.read_current(spark, root)
    assert snapshots.current_version(spark, root) == 7
    on_off = cur.where(F.col("status").isin("on", "off")).count()
    older = fx.servers(spark, sf001).where("last_ping_at is null or last_ping_at < timestamp_ntz'2024-01-01'")
    assert on_off == hb.select("server_id").distinct().join(older, "server_id").count()


def test_registry_versions_through_changes(spark, sf001, tmp_path):
    """create/import -> patch -> delete -> statuses, each a committed version."""
    from pulsegrid.operators import registry
    from pulsegrid.operators.heartbeats import latest_status
    from pulsegrid.session import shared_dir
    root = shared_dir(spark, "t-reg")
    snapshots.write_version(fx.servers(spark, sf001), root, 0)
    write_xlsx(str(tmp_path / "imp.xlsx"), [["No", "ServerID", "ServerName", "IPv4"],
                                            ["1", "x1", "host-x1", "10.1.0.1"],
                                            ["2", "x2", "host-x2", "10.1.0.2"]])
    _, _, _, v1 = jobs.import_job(spark, read_xlsx_sheets(spark, str(tmp_path)),
                                  snapshots.read_current(spark, root), "2024-03-01 00:00:00")
    snapshots.write_version(v1, root, 1)
    patches = spark.createDataFrame([(1, "x1", "renamed", None)],
                                    "rn long, server_id string, server_name string, ipv4 string")
    v2, _ = registry.patch_servers(snapshots.read_current(spark, root), patches,
                                   "2024-03-02 00:00:00")
    snapshots.write_version(v2, root, 2)
    v3, _ = registry.soft_delete(snapshots.read_current(spark, root),
                                 spark.createDataFrame([(1, "x2")], "rn long, server_id string"))
    snapshots.write_version(v3, root, 3)
    hb = spark.createDataFrame([(1, "x1", "on", __import__("datetime").datetime(2024, 3, 3))],
                               "seq long, server_id string, status string, ts timestamp_ntz")
    v4 = registry.apply_status(snapshots.read_current(spark, root), latest_status(hb))
    snapshots.write_version(v4, root, 4)
    cur = {r.server_id: r for r in snapshots.read_current(spark, root).collect()}
    assert cur["x1"].server_name == "renamed" and cur["x1"].status == "on"
    assert cur["x2"].is_deleted
    assert len(cur) == fx.servers(spark, sf001).count() + 2
    # older versions stay readable
    assert spark.read.parquet(f"{root}/v=1").where("server_id = 'x1'").first().server_name == \
        "host-x1"


def test_long_chain_import_is_exact(spark):
    """Rows alternate conflicts on id and name: rounds grow with the chain,
    the answer stays the sequential one."""
    from pulsegrid.operators import imports
    n = 24
    rows = [(i, f"id{(i + 1) // 2}", f"n{i // 2}") for i in range(n)]
    ids, names, want = set(), set(), set()
    for rn, sid, name in rows:
        if sid not in ids and name not in names:
            ids.add(sid)
            names.add(name)
            want.add(rn)
    res = imports.greedy_merge(spark.createDataFrame(
        rows, "rn long, server_id string, server_name string")).collect()
    assert {r.rn for r in res if r.outcome == "success"} == want
