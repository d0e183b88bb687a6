"""Workbooks written by hand: shared strings, blanks, dates, broken rows and files."""

import zipfile

import pytest

from saltmarsh.sources import tables, workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path, *tabs, strings=(), formats=(), early=False):
    """A workbook whose tabs are given as the XML of their rows."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        named = "".join(f'<sheet name="s{k}" sheetId="{k + 1}" r:id="r{k}"/>' for k in range(len(tabs)))
        z.writestr("xl/workbook.xml", f'<workbook {NS} {REL}><workbookPr date1904="{int(early)}"/><sheets>{named}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="{"/xl/" if k % 2 else ""}worksheets/t{k}.xml"/>' for k in range(len(tabs))) + "</Relationships>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        if formats:
            z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="&quot;day&quot; 0.00"/></numFmts><cellXfs>' + "".join(f'<xf numFmtId="{f}"/>' for f in formats) + "</cellXfs></styleSheet>")
        for k, rows in enumerate(tabs):
            z.writestr(f"xl/worksheets/t{k}.xml", f"<worksheet {NS}><sheetData>{rows}") if rows.endswith("<broken") else z.writestr(f"xl/worksheets/t{k}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")


def read(spark, path, which="all"):
    spark.dataSource.register(workbooks.Workbooks)
    found = spark.read.format("workbooks").option("path", str(path)).option("sheets", which).load()
    return sorted(((r.path.rpartition("/")[2], r.sheet, r.row, [tuple(c) for c in r.cells], r.error and r.error.split(":")[0]) for r in found.collect()), key=repr)


def test_cells(spark, tmp_path):
    rows = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="AB2" t="s"><v>1</v></c><c r="AC2"/></row><row r="3"/><row r="5"><c t="inlineStr"><is><t>in</t></is></c><c><v>250000</v></c><c><v>0.25</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><v>sum</v></c></row>'
    dates = '<row r="1"><c s="1"><v>45292</v></c><c s="2"><v>45292.5</v></c><c s="3"><v>7</v></c><c s="1"><v>0.75</v></c><c s="1"><v>1</v></c></row>'
    book(tmp_path / "a.xlsx", rows, dates, strings=["<t>Name</t>", "<r><t>Ask</t></r><r><t>ing</t></r><rPh><t>x</t></rPh>"], formats=[0, 14, 164, 165])
    want = [
        ("a.xlsx", "s0", 2, [(0, "Name"), (27, "Asking")], None),
        ("a.xlsx", "s0", 5, [(0, "in"), (1, "250000"), (2, "0.25"), (3, "True"), (5, "sum")], None),
        ("a.xlsx", "s1", 1, [(0, "2024-01-01 00:00:00"), (1, "2024-01-01 12:00:00"), (2, "7"), (3, "18:00:00"), (4, "1900-01-01 00:00:00")], None),
    ]
    assert read(spark, tmp_path) == want
    assert [r[1] for r in read(spark, f"file://{tmp_path}/a.xlsx", "first")] == ["s0", "s0"]
    book(tmp_path / "a.xlsx", dates, formats=[0, 14, 164, 165], early=True)
    assert read(spark, tmp_path)[0][3][0] == (0, "2028-01-02 00:00:00")


def test_errors_stay_in_their_rows(spark, tmp_path):
    good = '<row r="{}"><c t="inlineStr"><is><t>x</t></is></c></row>'
    book(tmp_path / "a.xlsx", good.format(1) + '<row r="2"><c t="s"><v>9</v></c></row>' + good.format(3) + '<row r="4"><c><v>much</v></c></row>' + good.format(5))
    book(tmp_path / "b.xlsx", good.format(1) + "<broken")
    (tmp_path / "c.xlsx").write_text("no archive" * 99)
    (tmp_path / "d.csv").write_text("x")
    got = read(spark, tmp_path)
    assert sorted((f, r, e) for f, _, r, _, e in got if f != "c.xlsx") == [("a.xlsx", 1, None), ("a.xlsx", 2, "IndexError"), ("a.xlsx", 3, None), ("a.xlsx", 4, "ValueError"), ("a.xlsx", 5, None), ("b.xlsx", 1, None), ("b.xlsx", 2, "ParseError")]
    assert [(r, e) for f, _, r, _, e in got if f == "c.xlsx"] == [(None, "BadZipFile")]


def test_listings(spark, tmp_path):
    cell = lambda *texts: "<row>" + "".join("<c/>" if t is None else f'<c t="inlineStr"><is><t>{t}</t></is></c>' for t in texts) + "</row>"
    book(tmp_path / "a.xlsx", cell("Business Name", "Asking", "City") + cell("Deli", "$5k", "Austin, TX") + cell(None, "$7", None) + cell("Home with 3 bed 2 bath", "$9", "x"))
    book(tmp_path / "b.xlsx", cell("Asking", "Other Title", "Name") + cell("$1", None, "Cafe"))
    book(tmp_path / "e.xlsx", "")
    got = sorted((r.title, r.price, r.city, r.state, r.url, r.description) for r in tables.workbook_listings(spark, str(tmp_path), "http://f").collect())
    assert got == [
        ("Business Listing 2", 7.0, None, None, "http://f/a.xlsx#row1", "Asking: $7"),
        ("Cafe", 1.0, None, None, "http://f/b.xlsx#row0", "Asking: $1 | Name: Cafe"),
        ("Deli", 5000.0, "Austin", "TX", "http://f/a.xlsx#row0", "Business Name: Deli | Asking: $5k | City: Austin, TX"),
    ]


@pytest.mark.parametrize("code, dated", [("General", False), ("0.00", False), ("[Red]0", False), ('"d"0', False), ("mm/dd/yy", True), ("[h]:mm", True), ("d\\-m", True)])
def test_formats(code, dated):
    assert workbooks.shows_date(code) == dated
