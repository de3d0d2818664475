"""Spreadsheets (.xlsx) by the standard library: ranges such as A1:C4, A1:B* or A1:*4."""

from __future__ import annotations

import re
import zipfile
from datetime import datetime
from pathlib import Path
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from .literal import frame

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def parse_range(text: str) -> tuple[int, int, int | None, int | None]:
    """First column, first row, last column (None: any), last row (None: any); one wildcard at most, in the second corner."""
    m = re.fullmatch(r"([A-Za-z]+)(\d+):([A-Za-z]+|\*)(\d+|\*)", text.strip())
    if not m or (m[3] == "*" and m[4] == "*"):
        raise ValueError(f"bad range {text!r}")
    return column_number(m[1]), int(m[2]), None if m[3] == "*" else column_number(m[3]), None if m[4] == "*" else int(m[4])


def _sheets(z: zipfile.ZipFile) -> dict[str, str]:
    targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = ET.fromstring(z.read("xl/workbook.xml"))
    return {s.get("name", ""): "xl/" + targets[s.get(f"{{{_REL}}}id")].removeprefix("/xl/") for s in book.iter(f"{{{_MAIN}}}sheet")}


def read_cells(file: str, sheet: str) -> dict[tuple[int, int], object]:
    """(row, column) -> text, number or truth value."""
    with zipfile.ZipFile(file) as z:
        sheets = _sheets(z)
        if sheet not in sheets:
            raise ValueError(f"no sheet {sheet!r} in {file}; there are {', '.join(sheets)}")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_MAIN}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        cells: dict[tuple[int, int], object] = {}
        for c in ET.fromstring(z.read(sheets[sheet])).iter(f"{{{_MAIN}}}c"):
            m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
            v, kind = c.find(f"{{{_MAIN}}}v"), c.get("t", "n")
            if not m:
                continue
            at = int(m[2]), column_number(m[1])
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_MAIN}}}t"))
            elif v is not None and v.text is not None:
                cells[at] = shared[int(v.text)] if kind == "s" else v.text == "1" if kind == "b" else v.text if kind == "str" else _number(v.text)
        return cells


def _number(text: str) -> float | str:
    try:
        return float(text)
    except ValueError:
        return text


def excel_source(spark: SparkSession, file: str, sheet: str, area: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of a range; without columns the first row holds their names. Ranges without a last row end at the first empty one."""
    x1, y1, x2, y2 = parse_range(area)
    cells = read_cells(file, sheet)
    x2 = x2 or max((x for (y, x) in cells if y >= y1), default=x1)
    rows, y = [], y1
    while y2 is None or y <= y2:
        row = [cells.get((y, x)) for x in range(x1, x2 + 1)]
        if y2 is None and all(v in (None, "") for v in row):
            break
        rows.append(row)
        y += 1
    if not columns:
        columns, rows = [str(v) for v in rows[0]], rows[1:]
    if len(columns) != x2 - x1 + 1:
        raise ValueError(f"{len(columns)} columns for a range of {x2 - x1 + 1}")
    return frame(spark, rows, columns)


def write_excel(rows: list[list], file: str, sheet: str, area: str = "A1:*1", overwrite: bool = False, template: str | None = None, transpose: bool = False) -> None:
    """Writes rows from the range's corner, no header; fails where a fixed side of the range doesn't fit."""
    path = Path(file)
    if path.exists() and not overwrite:
        raise FileExistsError(f"{file} exists; set OVERWRITE")
    x1, y1, x2, y2 = parse_range(area)
    if transpose:
        rows = [list(r) for r in zip(*rows, strict=True)]
    wide = max((len(r) for r in rows), default=0)
    if x2 is not None and rows and wide != x2 - x1 + 1:
        raise ValueError(f"{wide} columns do not fit {area}")
    if y2 is not None and len(rows) > y2 - y1 + 1:
        raise ValueError(f"{len(rows)} rows do not fit {area}")
    cells = {(y1 + i, x1 + j): v for i, r in enumerate(rows) for j, v in enumerate(r) if v is not None}
    if template:
        _fill(template, file, sheet, cells)
    else:
        _new(file, sheet, cells)


def _by_row(cells: dict[tuple[int, int], object]) -> dict[int, list[tuple[int, object]]]:
    out: dict[int, list[tuple[int, object]]] = {}
    for (y, x), v in sorted(cells.items(), key=lambda c: c[0]):
        out.setdefault(y, []).append((x, v))
    return out


def _fill(template: str, file: str, sheet: str, cells: dict[tuple[int, int], object]) -> None:
    """A copy of the book in which the cells have new values; styles, other cells and other sheets stay."""
    tag = lambda name: f"{{{_MAIN}}}{name}"
    with zipfile.ZipFile(template) as old:
        parts = {i.filename: old.read(i.filename) for i in old.infolist()}
        sheets = _sheets(old)
    if sheet not in sheets:
        raise ValueError(f"no sheet {sheet!r} in {template}; there are {', '.join(sheets)}")
    for prefix, uri in re.findall(rb'xmlns:?(\w*)="([^"]+)"', parts[sheets[sheet]]):
        if not re.fullmatch(rb"ns\d+", prefix):
            ET.register_namespace(prefix.decode(), uri.decode())
    root = ET.fromstring(parts[sheets[sheet]])
    data = root.find(tag("sheetData"))
    lines = {int(r.get("r", 0)): r for r in data}
    for y, values in _by_row(cells).items():
        line = lines.setdefault(y, ET.Element(tag("row"), {"r": str(y)}))
        own = {column_number(re.sub(r"\d", "", c.get("r", ""))): c for c in line}
        for x, v in values:
            new = ET.fromstring(_cell(y, x, v).replace("<c ", f'<c xmlns="{_MAIN}" ', 1))
            if x in own and own[x].get("s"):
                new.set("s", own[x].get("s"))
            own[x] = new
        line[:] = [own[x] for x in sorted(own)]
        line.attrib.pop("spans", None)
    data[:] = [lines[y] for y in sorted(lines)]
    for size in root.findall(tag("dimension")):
        root.remove(size)
    parts[sheets[sheet]] = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)


def _new(file: str, sheet: str, cells: dict[tuple[int, int], object]) -> None:
    body = "".join(f'<row r="{y}">{"".join(_cell(y, x, v) for x, v in values)}</row>' for y, values in _by_row(cells).items())
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", head + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", head + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", head + f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", head + f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", head + f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>')


def _cell(y: int, x: int, v: object) -> str:
    at = f"{column_letters(x)}{y}"
    if isinstance(v, bool):
        return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{at}"><v>{v!r}</v></c>'
    text = v.strftime("%Y-%m-%dT%H:%M:%SZ") if isinstance(v, datetime) else str(v)
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
