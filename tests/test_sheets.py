"""Import-sheet readers and the file import path."""

from pulsegrid import schemas as S
from pulsegrid.operators import imports
from pulsegrid.sources.sheets import read_csv_sheets, read_xlsx_sheets, write_xlsx, xlsx_rows

HEADER = ["No", "ServerID", "ServerName", "IPv4"]


def test_xlsx_roundtrip(tmp_path):
    p = tmp_path / "a.xlsx"
    write_xlsx(str(p), [HEADER, ["1", "s1", "n1", "1.1.1.1", ""], [], ["3", "s3", "n3"]])
    assert xlsx_rows(p.read_bytes()) == [HEADER, ["1", "s1", "n1", "1.1.1.1"], [],
                                         ["3", "s3", "n3"]]


def test_read_and_import_files(spark, tmp_path):
    d = tmp_path / "sheets"
    d.mkdir()
    write_xlsx(str(d / "a.xlsx"), [HEADER, ["1", "s1", "n1", "1.1.1.1"],
                                   ["2", "s2", "n1", "1.1.1.2"], ["3", "s2", "n3", "01.1.1.1"],
                                   ["4", "s2", "n4", "1.1.1.4"]])
    write_xlsx(str(d / "b.xlsx"), [HEADER, ["1", "s9", "n9", "1.1.1.9"], ["2", "s8", "n8"]])
    write_xlsx(str(d / "c.xlsx"), [HEADER])
    (d / "broken.xlsx").write_bytes(b"not a zip")
    rows = read_xlsx_sheets(spark, str(d))
    bad = {r.file_id.rsplit("/", 1)[-1] for r in imports.rejected_files(rows, 1).collect()}
    assert bad == {"b.xlsx", "broken.xlsx"}
    res = imports.import_sheets(rows).collect()
    got = sorted((r.row_no, r.server_id, r.outcome) for r in res)
    assert got == [(1, "s1", "success"), (2, "s2", S.ERR_DUPLICATE),
                   (3, "s2", S.ERR_INVALID_IP), (4, "s2", "success")]


def test_csv_sheets(spark, tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    (d / "a.csv").write_text('No,ServerID,ServerName,IPv4\n1,s1,"name, with comma",1.1.1.1,,\n'
                             '2,s2,"say ""hi""",1.1.1.2\n')
    (d / "c.csv").write_text('No,ServerID,ServerName,IPv4\n1,s5,"two\nlines"," 1.1.1.5 "\n')
    (d / "b.csv").write_text("No,ServerID,ServerName,IPv4\n1,s3,n3\n")
    rows = read_csv_sheets(spark, str(d))
    recs = sorted((r.row_no, r.server_id, r.server_name) for r in
                  imports.sheet_records(rows, header_rows=1).collect())
    assert recs == [(1, "s1", "name, with comma"), (1, "s5", "two\nlines"), (2, "s2", 'say "hi"')]
