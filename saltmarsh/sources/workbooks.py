"""Workbook files (XLSX) as a data source: one task for each sheet of each file, its rows streamed from the file's XML.

``spark.dataSource.register(Workbooks)``, then ``spark.read.format("workbooks").option("path", folder).load()``. A task reads the
file's directory of parts and the parts that its sheet needs, through any file system that Arrow can open by the path's uri.
Only the shared strings and the styles of the file are held; rows are not.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, sheet string, sheet_no int, row long, cells array<struct<col: int, value: string>>, error string"

# Fixed values of the format: numbers of the built-in formats that show dates or times, and the relation's name space.
DATE_FORMATS = (*range(14, 23), *range(45, 48))
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


@dataclass
class Sheet(InputPartition):
    path: str
    name: str
    number: int
    part: str | None
    dates_from_1904: bool
    error: str | None = None


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _text(element: ElementTree.Element) -> str:
    """A string item's text: all its runs, without phonetic hints."""
    return "".join((child.text or "") if _tag(child) == "t" else _text(child) if _tag(child) == "r" else "" for child in element)


def _children(archive: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """The part's elements of one tag as they end, each emptied afterwards; none where the file has no such part."""
    if part not in archive.namelist():
        return
    with archive.open(part) as stream:
        parents: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                parents.append(element)
                continue
            parents.pop()
            if _tag(element) == tag:
                yield element
                element.clear()
                if parents:
                    parents[-1].remove(element)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def files(path: str) -> list[str]:
    """The workbooks of a folder, or the file itself, in order of their names."""
    system, own = _open(path)
    if system.get_file_info(own).type == fs.FileType.File:
        return [path]
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(own)) if f.type == fs.FileType.File and f.base_name.lower().endswith((".xlsx", ".xlsm")))
    return [f"{path.rstrip('/')}/{name.rpartition('/')[2]}" for name in names]


def sheets(path: str) -> list[Sheet]:
    """The file's sheets in the order of its tabs; a file that can't be read gives one that says so."""
    try:
        system, own = _open(path)
        with system.open_input_file(own) as source, zipfile.ZipFile(source) as archive:
            targets = {e.get("Id"): e.get("Target", "") for e in _children(archive, "xl/_rels/workbook.xml.rels", "Relationship")}
            early = any(e.get("date1904") in ("1", "true") for e in _children(archive, "xl/workbook.xml", "workbookPr"))
            tabs = [(e.get("name"), targets.get(e.get(RELATION), "")) for e in _children(archive, "xl/workbook.xml", "sheet")]
        return [Sheet(path, name, k, to.lstrip("/") if to.startswith("/") else f"xl/{to}", early) for k, (name, to) in enumerate(tabs)]
    except Exception as e:  # a broken file is a row of its own, not the end of the job
        return [Sheet(path, "", 0, None, False, f"{type(e).__name__}: {e}")]


def column(reference: str) -> int:
    """Number of a cell's column from 0: A, B, ..., Z, AA, ..."""
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def shows_date(code: str) -> bool:
    """Whether a number format has a part of a date or time outside quotes, brackets and escapes."""
    return re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", code).lower().replace("general", "")) is not None


def number(text: str, is_date: bool, dates_from_1904: bool) -> str:
    """Whole numbers without a fraction; dates as ``YYYY-MM-DD hh:mm:ss``, below one day as ``hh:mm:ss``."""
    value = float(text)
    if not is_date:
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    seconds = datetime.timedelta(seconds=round(value * 86400))
    if not dates_from_1904 and seconds < datetime.timedelta(days=1):
        return str((datetime.datetime.min + seconds).time())
    zero = datetime.datetime(1904, 1, 1) if dates_from_1904 else datetime.datetime(1899, 12, 31 if value < 60 else 30)  # the format counts a 29 February 1900
    return str(zero + seconds)


def rows(sheet: Sheet) -> Iterator[tuple]:
    """The sheet's rows that have a cell, with their numbers from 1. Blank cells are left out. A row that can't be read has its
    error and no cells; after broken XML one last row has the error."""
    if sheet.error:
        yield sheet.path, sheet.name, sheet.number, None, [], sheet.error
        return
    at = 0
    try:
        system, own = _open(sheet.path)
        with system.open_input_file(own) as source, zipfile.ZipFile(source) as archive:
            if sheet.part not in archive.namelist():
                raise KeyError(f"no part {sheet.part}")
            strings = [_text(e) for e in _children(archive, "xl/sharedStrings.xml", "si")]
            codes = {int(e.get("numFmtId")): shows_date(e.get("formatCode", "")) for e in _children(archive, "xl/styles.xml", "numFmt")}
            styles = [f for e in _children(archive, "xl/styles.xml", "cellXfs") for f in (int(x.get("numFmtId", 0)) for x in e)]
            dated = [codes.get(f, f in DATE_FORMATS) for f in styles]
            for element in _children(archive, sheet.part, "row"):
                at = int(element.get("r") or at + 1)
                try:
                    found = list(_cells(element, strings, dated, sheet.dates_from_1904))
                except Exception as e:
                    yield sheet.path, sheet.name, sheet.number, at, [], f"{type(e).__name__}: {e}"
                    continue
                if found:
                    yield sheet.path, sheet.name, sheet.number, at, found, None
    except Exception as e:
        yield sheet.path, sheet.name, sheet.number, at + 1, [], f"{type(e).__name__}: {e}"


def _cells(row: ElementTree.Element, strings: list[str], dated: list[bool], dates_from_1904: bool) -> Iterator[tuple[int, str]]:
    col = -1
    for cell in (c for c in row if _tag(c) == "c"):
        col = column(cell.get("r")) if cell.get("r") else col + 1
        kind, own = cell.get("t", "n"), {_tag(c): c for c in cell}
        if kind == "inlineStr":
            text = _text(own["is"]) if "is" in own else None
        elif "v" not in own or own["v"].text is None:
            text = None
        elif kind == "s":
            text = strings[int(own["v"].text)]
        elif kind == "b":
            text = "True" if own["v"].text == "1" else "False"
        elif kind in ("str", "d"):
            text = own["v"].text
        elif kind == "e":
            text = None  # an error such as #N/A is no value
        else:
            style = int(cell.get("s", 0))
            text = number(own["v"].text, dated[style] if dated else False, dates_from_1904)
        if text:
            yield col, text


class Workbooks(DataSource):
    """Rows of the sheets of all workbooks in a folder. Option ``path``; option ``sheets``: ``first`` (default) or ``all``."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SheetReader(self.options["path"], self.options.get("sheets", "first"))


class SheetReader(DataSourceReader):
    def __init__(self, path: str, which: str):
        self.path, self.which = path, which

    def partitions(self) -> list[Sheet]:
        every = [s for f in files(self.path) for s in sheets(f)]
        return [s for s in every if self.which == "all" or s.number == 0]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        yield from rows(partition) if isinstance(partition, Sheet) else ()


def write(rows: DataFrame, path: str) -> None:
    """Workbooks of one sheet with the rows and their columns' names: one for each Arrow batch (10,000 rows, or the session's setting).
    Numbers become number cells, nulls blank ones, anything else text. A task that runs again writes the same names."""
    fs.FileSystem.from_uri(path)[0].create_dir(fs.FileSystem.from_uri(path)[1])

    def save(batches):
        for k, batch in enumerate(batches):
            system, own = _open(f"{path}/{TaskContext.get().partitionId():05d}-{k:05d}.xlsx")
            with system.open_output_stream(own) as to:
                to.write(_book(batch))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], ["n"])

    rows.mapInArrow(save, "n long").count()


def _book(batch: pa.RecordBatch) -> bytes:
    def cell(x) -> str:
        if x is None:
            return "<c/>"
        return f"<c><v>{x}</v></c>" if isinstance(x, (int, float)) and not isinstance(x, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(x))}</t></is></c>'

    own, out = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", io.BytesIO()
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{parts}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{parts}.worksheet+xml"/></Types>')
        relation = lambda to, kind: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{office}/{kind}" Target="{to}"/></Relationships>'
        z.writestr("_rels/.rels", relation("xl/workbook.xml", "officeDocument"))
        z.writestr("xl/_rels/workbook.xml.rels", relation("worksheets/sheet1.xml", "worksheet"))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{own}" xmlns:r="{office}"><sheets><sheet name="Listings" sheetId="1" r:id="r1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<worksheet xmlns="{own}"><sheetData>'.encode())
            for row in ([*batch.schema.names], *zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                sheet.write(f"<row>{''.join(map(cell, row))}</row>".encode())
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()
