"""Workbooks (XLSX) in and out, by the formats of their parts: no reader of
spreadsheets is needed."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = "file string, sheet string, row_num int, cells array<string>, error string"
#: Rows of a sheet, at most, by the format.
MOST_ROWS = 1_048_576
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "p": "http://schemas.openxmlformats.org/package/2006/relationships"}


def column_number(reference: str) -> int:
    """From 0: ``A1`` is 0, ``AB7`` 27."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{{{_NS['m']}}}t"))


def _number(raw: str) -> str:
    """As a person would write it: 3.0 is 3."""
    try:
        x = float(raw)
    except ValueError:
        return raw
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else str(x)


def sheets_of(data: bytes) -> Iterator[tuple[str, Iterator[tuple[int, list[str | None]]]]]:
    """(name, rows) of a workbook's sheets in order; rows are (number from 1, cells)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).findall("p:Relationship", _NS)}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS):
            target = targets[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).findall("m:sheetData/m:row", _NS):
                cells: list[str | None] = []
                for c in row.findall("m:c", _NS):
                    at = column_number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    v, kind = c.find("m:v", _NS), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = _text(c)
                    elif v is not None and v.text is not None:
                        cells[at] = shared[int(v.text)] if kind == "s" else v.text if kind in ("str", "e") else {"1": "True", "0": "False"}[v.text] if kind == "b" else _number(v.text)
                rows.append((int(row.get("r", len(rows) + 1)), cells))
            yield sheet.get("name"), iter(rows)


def read_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of all workbooks of a folder as rows (file, sheet, row_num,
    cells, error), without temporary files. A sheet without rows is one row with
    no number; a file that cannot be read is one row with its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    files = files.select(name.alias("file"), "content").where(~F.col("file").startswith("~$") & ~F.col("file").startswith(".~"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in GRID.split(", ")]
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                out = []
                try:
                    for sheet, rows in sheets_of(bytes(content)):
                        got = [(file, sheet, n, cells, None) for n, cells in rows]
                        out += got or [(file, sheet, None, None, None)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError, TypeError) as e:
                    out = [(file, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(out, columns=columns).astype({"row_num": "Int32"})

    return files.mapInPandas(run, GRID)


def _sheet_xml(rows: Iterator[list]) -> bytes:
    out = ['<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="%s"><sheetData>' % _NS["m"]]
    n = 0
    for n, cells in enumerate(rows, 1):
        if n > MOST_ROWS:
            raise ValueError(f"a sheet holds {MOST_ROWS} rows at most")
        made = []
        for k, value in enumerate(cells):
            if value is None or value == "":
                continue
            letters, at = "", k + 1
            while at:
                at, rest = divmod(at - 1, 26)
                letters = chr(65 + rest) + letters
            if isinstance(value, int):
                made.append(f'<c r="{letters}{n}"><v>{value}</v></c>')
            else:
                clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
                made.append(f'<c r="{letters}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>')
        out.append(f'<row r="{n}">{"".join(made)}</row>')
    out.append("</sheetData></worksheet>")
    return "".join(out).encode()


def workbook(sheets: list[tuple[str, Iterator[list]]]) -> bytes:
    """A workbook of (name, rows of cells)."""
    kinds = "http://schemas.openxmlformats.org/package/2006/content-types"
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{kinds}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_NS["p"]}"><Relationship Id="rId1" Type="{_NS["r"]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        named = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, (n, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}"><sheets>{named}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{_NS["r"]}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_NS["p"]}">{links}</Relationships>')
        for k, (_, rows) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", _sheet_xml(rows))
    return data.getvalue()


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """One file, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at:at + (1 << 20)]))
    finally:
        out.close()
