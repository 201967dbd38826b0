"""Workbooks (.xlsx) with the standard library: cells of the active sheet, and small workbooks for people. Sheets are made for readers and fit one machine."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

# Name spaces and parts of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def tag(name: str) -> str:
    return f"{{{MAIN}}}{name}"


def column_of(ref: str) -> int:
    """The number of a cell's column, from 0."""
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def shown(value: str) -> str:
    """A number as a person would write it: whole numbers without a point."""
    try:
        x = float(value)
    except ValueError:
        return value
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def sheet_paths(book: zipfile.ZipFile) -> tuple[list[tuple[str, str]], int]:
    """(name, part) of each sheet, and which one is active."""
    top = ElementTree.fromstring(book.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    view = top.find(f"{tag('bookViews')}/{tag('workbookView')}")
    sheets = []
    for s in top.iter(tag("sheet")):
        to = links[s.get(f"{{{LINKS}}}id")]
        sheets.append((s.get("name"), to.lstrip("/") if to.startswith("/") else f"xl/{to}"))
    return sheets, int(view.get("activeTab", 0)) if view is not None else 0


def rows(data: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet (the active one, if none is named) as text; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        sheets, active = sheet_paths(book)
        part = dict(sheets)[sheet] if sheet is not None else sheets[min(active, len(sheets) - 1)][1]
        words: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            words = ["".join(t.text or "" for t in s.iter(tag("t"))) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(tag("si"))]
        with book.open(part) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != tag("row"):
                    continue
                out: list[str | None] = []
                for cell in row.iter(tag("c")):
                    at = column_of(cell.get("r", "")) if cell.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    kind, value = cell.get("t", "n"), cell.find(tag("v"))
                    if kind == "inlineStr":
                        out[at] = "".join(t.text or "" for t in cell.iter(tag("t")))
                    elif value is not None and value.text is not None:
                        v = value.text
                        out[at] = words[int(v)] if kind == "s" else {"1": "True", "0": "False"}.get(v, v) if kind == "b" else shown(v) if kind == "n" else v
                yield out
                row.clear()


def names(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        return [n for n, _ in sheet_paths(book)[0]]


def cell_xml(ref: str, value, style: int) -> str:
    mark = f' s="{style}"' if style else ""
    if value is None:
        return f'<c r="{ref}"{mark}/>'
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{ref}"{mark}><v>{value}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c r="{ref}"{mark} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def letters(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, r = divmod(column - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(sheets: list[tuple[str, Iterable[list], bool, list[int]]], marked=lambda row: False) -> bytes:
    """A workbook of (name, rows, hidden, widths); rows of the first sheet that `marked` picks are coloured."""
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}"{" state=" + quoteattr("hidden") if hidden else ""} r:id="r{i}"/>' for i, (n, _, hidden, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships">{links}<Relationship Id="s" Type="{LINKS}/styles" Target="styles.xml"/></Relationships>')
        fills = '<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFC7CE"/></patternFill></fill></fills>'
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts>{fills}<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fillId="2" applyFill="1"/></cellXfs></styleSheet>')
        for i, (_, lines, _, widths) in enumerate(sheets, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                cols = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths, 1))
                f.write(f'{head}<worksheet xmlns="{MAIN}">{"<cols>" + cols + "</cols>" if cols else ""}<sheetData>'.encode())
                for n, line in enumerate(lines, 1):
                    style = int(i == 1 and n > 1 and marked(line))
                    f.write(f'<row r="{n}">{"".join(cell_xml(f"{letters(k)}{n}", v, style) for k, v in enumerate(line))}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()
