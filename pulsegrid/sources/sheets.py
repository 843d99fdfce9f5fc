"""Import-sheet readers (S5): many files at once -> (file_id, row_no, cells).

A sheet file is the unit of an import (one upload), so each file is read by
one task; files spread over all tasks. Row 0 is the header. Trailing empty
cells are trimmed, as a spreadsheet reader reports a row up to its last
value.

* CSV: Spark's reader in multi-line mode.
* XLSX: ``binaryFile`` + ``mapInPandas``; the workbook is a zip of XML parts
  read with the standard library (first sheet only, shared strings and
  inline strings resolved, gaps between rows kept as empty rows).
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import schemas as S
from pulsegrid.operators.imports import trim_trailing_empty

def read_csv_sheets(spark: SparkSession, path: str, columns: int = 4) -> DataFrame:
    """CSV sheets by Spark's own reader: quoted cells may hold commas, doubled
    quotes, line breaks and outer blanks. Rows are streamed and numbered in one
    scan, so a file need not fit in memory; files spread over the tasks, but a file with line
    breaks in cells has no place to split at and is read by one task. The
    first ``columns`` cells are kept (an import uses no more)."""
    schema = ", ".join(f"c{i} string" for i in range(columns))
    raw = (spark.read.schema(schema).option("recursiveFileLookup", "true")
           .options(multiLine=True, quote='"', escape='"', header=False, mode="PERMISSIVE", nullValue=None,
                    ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))
    cells = F.array(*[F.coalesce(f"c{i}", F.lit("")) for i in range(columns)])
    return raw.select(F.col("_metadata.file_path").alias("file_id"), trim_trailing_empty(cells).alias("cells")) \
              .mapInArrow(_row_numbers, S.SHEET_ROW)


def _row_numbers(batches):
    """Rows with their number in the file: a task reads a file from its first
    row to its last, one file after the other, so it only has to count."""
    file, n = None, -1
    for b in batches:
        numbers = []
        for f in b.column(0).to_pylist():
            file, n = f, n + 1 if f == file else 0
            numbers.append(n)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers, pa.int64()), b.column(1)],
                                         names=["file_id", "row_no", "cells"])


# ------------------------------------------------------------------- XLSX

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "rel": "http://schemas.openxmlformats.org/package/2006/relationships"}
_CELL_REF = re.compile(r"([A-Z]+)(\d+)")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet_path(z: zipfile.ZipFile) -> str | None:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = wb.find("m:sheets/m:sheet", _NS)
    if sheet is None:
        return None
    rid = sheet.get(f"{{{_NS['r']}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for rel in rels.findall("rel:Relationship", _NS):
        if rel.get("Id") == rid:
            target = rel.get("Target").lstrip("/")
            return target if target.startswith("xl/") else f"xl/{target}"
    return None


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t"))
            for si in root.findall("m:si", _NS)]


def xlsx_rows(content: bytes) -> list[list[str]]:
    """Rows of the first sheet as lists of cell texts (trailing empties
    trimmed, missing rows as empty lists). Raises on a broken workbook."""
    z = zipfile.ZipFile(io.BytesIO(content))
    path = _first_sheet_path(z)
    if path is None:
        raise ValueError(S.ERR_INVALID_IMPORT)
    strings = _shared_strings(z)
    rows: dict[int, dict[int, str]] = {}
    m = f"{{{_NS['m']}}}"
    for _, el in ET.iterparse(z.open(path)):
        if el.tag != f"{m}row":
            continue
        r_idx = int(el.get("r")) - 1
        cells: dict[int, str] = {}
        for pos, c in enumerate(el.findall(f"{m}c")):
            ref = c.get("r")
            ci = _col_index(_CELL_REF.match(ref).group(1)) if ref else pos
            kind = c.get("t")
            if kind == "s":
                v = c.find(f"{m}v")
                text = strings[int(v.text)] if v is not None and v.text else ""
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{m}t"))
            else:
                v = c.find(f"{m}v")
                text = v.text if v is not None and v.text else ""
            cells[ci] = text
        rows[r_idx] = cells
        el.clear()
    out: list[list[str]] = []
    last_row = max((i for i, cs in rows.items() if any(v != "" for v in cs.values())), default=-1)
    for i in range(last_row + 1):
        cs = rows.get(i, {})
        width = max((j + 1 for j, v in cs.items() if v != ""), default=0)
        out.append([cs.get(j, "") for j in range(width)])
    return out


def _decode_batches(batches):
    for pdf in batches:
        recs = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                rows = xlsx_rows(bytes(content))
            except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError):  # an invalid import
                rows = None
            if rows is None:
                # one marker row of zero cells: the whole file is rejected
                recs.append((path, 1, []))
                continue
            recs.extend((path, i, r) for i, r in enumerate(rows))
        yield pd.DataFrame(recs, columns=["file_id", "row_no", "cells"])


def read_xlsx_sheets(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path).select("path", "content"))
    return files.mapInPandas(_decode_batches, schema=S.SHEET_ROW)


def write_xlsx(path: str, rows: list[list[str]]) -> None:
    """Minimal single-sheet workbook with inline strings (test helper)."""
    def cell(ci, ri, v):
        ref = ""
        n = ci + 1
        while n:
            n, rem = divmod(n - 1, 26)
            ref = chr(65 + rem) + ref
        esc = (v.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        return f'<c r="{ref}{ri + 1}" t="inlineStr"><is><t>{esc}</t></is></c>'
    body = "".join(f'<row r="{ri + 1}">' + "".join(cell(ci, ri, v) for ci, v in enumerate(r))
                   + "</row>" for ri, r in enumerate(rows))
    main = _NS["m"]
    parts = {
        "[Content_Types].xml":
            '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/'
            'package/2006/content-types"><Default Extension="rels" ContentType="application/'
            'vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" '
            'ContentType="application/xml"/></Types>',
        "xl/workbook.xml":
            f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}" xmlns:r="{_NS["r"]}">'
            '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels":
            f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_NS["rel"]}">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
            'relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml":
            f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}"><sheetData>{body}'
            '</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
