"""Workbooks of the Office Open XML format, with the standard library alone: first sheets as rows of text, and styled sheets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows that a sheet may have.
MOST_ROWS = 1_048_576
# Colours of the header and of kinds of cells.
HEADER_FILL, HEADER_FONT = "1D4ED8", "FFFFFF"
FILLS = {"missing": "F8D7DA", "outlier": "FFF3CD", "median": "D4EDDA", "imputed": "FFD1DC"}
# Number formats of kinds of columns.
FORMATS = {"text": "@", "integer": "#,##0", "numeric": "#,##0.##", "date": "yyyy-mm-dd"}


def _place(reference: str) -> int:
    """The column's number, from 0, of a reference such as AB12."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _letters(place: int) -> str:
    out, n = "", place + 1
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def read_rows(data: bytes, sheet: int = 0) -> Iterator[list[str | None]]:
    """The rows of a sheet as text; empty cells are None. Numbers are as they are stored, booleans TRUE and FALSE."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = [links[s.get(_LINK)] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        shared = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        target = sheets[sheet].lstrip("/")
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list[str | None] = []
                for k, cell in enumerate(row.iter(f"{_MAIN}c")):
                    at = _place(cell.get("r")) if cell.get("r") else k
                    out += [None] * (at + 1 - len(out))
                    value, kind = cell.find(f"{_MAIN}v"), cell.get("t")
                    if kind == "inlineStr":
                        out[at] = _text(cell)
                    elif value is not None and value.text is not None:
                        out[at] = shared[int(value.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}[value.text] if kind == "b" else value.text
                yield out
                row.clear()


class Styles:
    """Cell formats by (fill, number format, side), each once."""

    def __init__(self) -> None:
        self.formats: list[tuple[str | None, str, str]] = []

    def number(self, fill: str | None, number_format: str, side: str) -> int:
        """0 is the plain format, 1 the header's."""
        key = fill, number_format, side
        if key not in self.formats:
            self.formats.append(key)
        return 2 + self.formats.index(key)

    def xml(self) -> str:
        fills = [HEADER_FILL, *dict.fromkeys(f for f, _, _ in self.formats if f)]
        numbers = list(dict.fromkeys(n for _, n, _ in self.formats))
        fill_xml = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{f}"/></patternFill></fill>' for f in fills)
        cells = '<xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"><alignment horizontal="center" vertical="center" wrapText="1"/></xf>'
        for fill, number, side in self.formats:
            at = 2 + fills.index(fill) if fill else 0
            cells += f'<xf numFmtId="{164 + numbers.index(number)}" fillId="{at}" applyNumberFormat="1" applyFill="{int(bool(fill))}" applyAlignment="1"><alignment horizontal="{side}" vertical="center" wrapText="1"/></xf>'
        formats = "".join(f'<numFmt numFmtId="{164 + i}" formatCode={quoteattr(n)}/>' for i, n in enumerate(numbers))
        return (
            f'<styleSheet xmlns="{_MAIN[1:-1]}"><numFmts count="{len(numbers)}">{formats}</numFmts><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/><color rgb="FF{HEADER_FONT}"/></font></fonts>'
            f'<fills count="{2 + len(fills)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fill_xml}</fills>'
            f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{2 + len(self.formats)}">{cells}</cellXfs></styleSheet>'
        )


class Sheet:
    """A sheet to be written: rows of values (None, numbers or text) with the kind of each cell, where it has one."""

    def __init__(self, name: str, columns: Sequence[str], rows: Iterable[tuple[Sequence, dict[str, str]]], widths: dict[str, int] | None = None, formats: dict[str, str] | None = None, right_to_left: bool = False) -> None:
        self.name, self.columns, self.rows = re.sub(r"[\[\]:*?/\\]", "_", name)[:31], list(columns), rows
        self.widths, self.formats, self.right_to_left = widths or {}, formats or {}, right_to_left


def _clean(value) -> str:
    return escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value)))


def write(path: str, sheets: Sequence[Sheet]) -> None:
    """Writes a workbook to a local file, a row at a time. A sheet with more rows than MOST_ROWS is an error."""
    styles = Styles()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, sheet in enumerate(sheets, 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as f:
                cols = "".join(f'<col min="{i}" max="{i}" width="{sheet.widths.get(c, 12)}" customWidth="1"/>' for i, c in enumerate(sheet.columns, 1))
                view = f'<sheetViews><sheetView workbookViewId="0" rightToLeft="{int(sheet.right_to_left)}"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
                f.write(f'<worksheet xmlns="{_MAIN[1:-1]}">{view}{f"<cols>{cols}</cols>" if cols else ""}<sheetData>'.encode())
                head = "".join(f'<c r="{_letters(i)}1" s="1" t="inlineStr"><is><t xml:space="preserve">{_clean(c)}</t></is></c>' for i, c in enumerate(sheet.columns))
                f.write(f'<row r="1">{head}</row>'.encode())
                for n, (values, kinds) in enumerate(sheet.rows, 2):
                    if n > MOST_ROWS:
                        raise ValueError(f"a sheet holds {MOST_ROWS} rows at most")
                    f.write(f'<row r="{n}">{"".join(_cells(sheet, styles, n, values, kinds))}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
        z.writestr("xl/styles.xml", styles.xml())
        names = "".join(f'<sheet name={quoteattr(s.name)} sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(sheets, 1))
        kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{kind}"><sheets>{names}</sheets></workbook>')
        package = "http://schemas.openxmlformats.org/package/2006"
        links = "".join(f'<Relationship Id="rId{k}" Type="{kind}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}<Relationship Id="rId{len(sheets) + 1}" Type="{kind}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        office = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{office}.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{office}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{office}.styles+xml"/>{parts}</Types>')


def _cells(sheet: Sheet, styles: Styles, n: int, values: Sequence, kinds: dict[str, str]) -> Iterator[str]:
    for i, (c, v) in enumerate(zip(sheet.columns, values, strict=True)):
        number = isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf")
        own = sheet.formats.get(c, FORMATS["integer" if isinstance(v, int) or v.is_integer() else "numeric"] if number else FORMATS["text"])
        side = "right" if number or sheet.right_to_left else "left"
        s = styles.number(FILLS.get(kinds.get(c, "")), own, side)
        at = f'r="{_letters(i)}{n}" s="{s}"'
        yield f"<c {at}/>" if v is None else f"<c {at}><v>{v!r}</v></c>" if number else f'<c {at} t="inlineStr"><is><t xml:space="preserve">{_clean(v)}</t></is></c>'
