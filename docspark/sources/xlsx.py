"""Workbooks: sheets as rows of cells, dates by number format, pictures by anchor."""

from __future__ import annotations

import datetime
import math
import re

from docspark.plans.plan import ConvertError
from docspark.sources.drawing import ShapePictures
from docspark.sources.opc import Archive, Handler, parts_of, resolve_target, targets
from docspark.sources.text import value_text

#: Built-in number formats that are dates or times; of these the ones that are spans of time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}
SPAN_FORMATS = {46}


class _Workbook(Handler):
    def __init__(self) -> None:
        self.sheets: list[tuple[str, str]] = []
        self.since_1904 = False

    def start(self, name, attrs, full, above):
        if name == "sheet" and "name" in attrs:
            self.sheets.append((attrs["name"], next((v for k, v in full.items() if k.endswith(":id")), "")))
        elif name == "workbookPr":
            self.since_1904 = attrs.get("date1904") in ("1", "true")


class _Strings(Handler):
    """Shared strings; phonetic hints are no part of the text."""

    skip = frozenset({"Fallback", "rPh"})

    def __init__(self) -> None:
        self.found: list[str] = []

    def start(self, name, attrs, full, above):
        if name == "si":
            self.found.append("")

    def text(self, data, above):
        if above.parent == "t" and self.found:
            self.found[-1] += data


def _format_id(attrs: dict) -> int:
    """The number of a format; what is no number is the general format."""
    value = attrs.get("numFmtId", "0")
    return int(value) if value.isascii() and value.isdigit() else 0


class _Styles(Handler):
    def __init__(self) -> None:
        self.codes: dict[int, str] = {}
        self.cells: list[int] = []

    def start(self, name, attrs, full, above):
        if name == "numFmt":
            self.codes[_format_id(attrs)] = attrs.get("formatCode", "")
        elif name == "xf" and above.parent == "cellXfs":
            self.cells.append(_format_id(attrs))

    def kind(self, style: int) -> str:
        number = self.cells[style] if 0 <= style < len(self.cells) else 0
        code = self.codes.get(number)
        if code is None:
            return "span" if number in SPAN_FORMATS else "date" if number in DATE_FORMATS else "number"
        code = re.sub(r'"[^"]*"|\\.|_.|\*.', "", code.split(";")[0])
        if re.search(r"\[(h+|m+|s+)\]", code, re.I):
            return "span"
        code = re.sub(r"\[[^\]]*\]", "", code)
        return "date" if re.search(r"[ymdhs]", code, re.I) and "general" not in code.lower() else "number"


def column_number(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def serial_text(serial: float, kind: str, since_1904: bool = False) -> str:
    """A serial day number as text: a span of hours to the nearest second, else date and time as far as it has them.

    A number below 1 is a time alone, a whole one a date alone. What no calendar holds stays a number.
    """
    if not math.isfinite(serial):
        return value_text("float", serial)
    if kind == "span":
        seconds = int(abs(serial) * 86400 + 0.5) * (-1 if serial < 0 else 1)
        hours, rest = divmod(abs(seconds), 3600)
        return f"{'-' if seconds < 0 else ''}{hours}:{rest // 60:02d}:{rest % 60:02d}"
    days, thousandths = divmod(round(serial * 86_400_000), 86_400_000)
    hours, rest = divmod(thousandths // 1000, 3600)
    clock = f"{hours:02d}:{rest // 60:02d}:{rest % 60:02d}"
    if serial < 1:
        return clock
    try:
        day = datetime.date(1904, 1, 1) if since_1904 else datetime.date(1899, 12, 31 if serial < 60 else 30)
        day += datetime.timedelta(days=days)
    except OverflowError:
        return value_text("float", serial)
    return day.isoformat() if serial == int(serial) else f"{day.isoformat()}T{clock}"


class _Sheet(Handler):
    """Cells by row and column, as (kind, value)."""

    skip = frozenset({"Fallback", "rPh"})

    def __init__(self, strings: list[str], styles: _Styles, since_1904: bool):
        self.strings, self.styles, self.since_1904 = strings, styles, since_1904
        self.cells: dict[tuple[int, int], tuple[str, object]] = {}
        self.row = self.col = -1

    def start(self, name, attrs, full, above):
        if name == "row":
            self.row = int(attrs["r"]) - 1 if attrs.get("r", "").isascii() and attrs.get("r", "").isdigit() else self.row + 1
            self.col = -1
        elif name == "c":
            self.col = column_number(attrs["r"]) if attrs.get("r") else self.col + 1
            self.kind, self.value = attrs.get("t", "n"), ""
            self.style = int(attrs.get("s", 0)) if attrs.get("s", "0").isascii() and attrs.get("s", "0").isdigit() else 0

    def text(self, data, above):
        if above.parent == "v" or above.parent == "t" and above.within("is"):
            self.value += data

    def end(self, name, above):
        if name != "c" or self.value == "" and self.kind != "inlineStr":
            return
        if self.kind == "s":
            place = int(self.value) if self.value.strip().isascii() and self.value.strip().isdigit() else -1
            cell = ("text", self.strings[place] if 0 <= place < len(self.strings) else "")
        elif self.kind == "b":
            cell = ("bool", self.value.strip() in ("1", "true"))
        elif self.kind in ("str", "inlineStr", "e", "d"):
            cell = ("text", self.value)
        else:
            try:
                number = float(self.value)
            except ValueError:
                cell = ("text", self.value)
            else:
                kind = self.styles.kind(self.style)
                cell = ("float", number) if kind == "number" else ("text", serial_text(number, kind, self.since_1904))
        self.cells[self.row, self.col] = cell

    def rows(self) -> list[list[tuple[str, object]]]:
        """The used range, from its first row and column; gaps are empty cells."""
        if not self.cells:
            return []
        top, left = min(r for r, _ in self.cells), min(c for _, c in self.cells)
        height, width = max(r for r, _ in self.cells) - top + 1, max(c for _, c in self.cells) - left + 1
        if height * width > 64_000_000:
            raise ConvertError("data", "the sheet's range is too large")
        out: list[list[tuple[str, object]]] = [[("empty", None)] * width for _ in range(height)]
        for (r, c), cell in self.cells.items():
            out[r - top][c - left] = cell
        return out


class _Drawing(Handler):
    """Pictures of a sheet with the row and column of their upper left corner."""

    def __init__(self, to):
        self.pictures = ShapePictures(to)
        self.anchor: dict[str, int] = {}
        self.found: list[tuple[float, float, dict]] = []

    def start(self, name, attrs, full, above):
        if name.endswith("Anchor"):
            self.anchor = {}
        self.pictures.start(name, attrs, above)

    def text(self, data, above):
        if above.parent in ("row", "col") and above.within("from") and data.strip().isdigit():
            self.anchor[above.parent] = int(data)

    def end(self, name, above):
        if picture := self.pictures.end(name):
            self.found.append((self.anchor.get("row", math.inf), self.anchor.get("col", math.inf), picture))


def read_workbook(content: bytes, sheet: str | None = None, pictures: bool = False, **limits: int) -> list[dict]:
    """Sheets (sheet_no, sheet, rows, pictures) in the workbook's order; only the one named, where one is named.

    A worksheet part under several names is read once, under the first.
    """
    archive = Archive(content, **limits)
    archive.check_sizes()
    book = _Workbook()
    archive.walk("xl/workbook.xml", book, required=True)
    rels = archive.relationships("xl/workbook.xml")
    if not book.sheets:
        raise ConvertError("data", "the workbook has no sheets")
    if sheet is not None and sheet not in [n for n, _ in book.sheets]:
        raise ConvertError("usage", f"no sheet {sheet!r}; there are {', '.join(n for n, _ in book.sheets)}")
    strings, styles = _Strings(), _Styles()
    archive.walk("xl/sharedStrings.xml", strings)
    archive.walk("xl/styles.xml", styles)
    out, seen = [], set()
    for number, (name, rel_id) in enumerate(book.sheets):
        rel = rels.get(rel_id)
        part = resolve_target("xl/workbook.xml", rel.target) if rel and rel.kind in ("worksheet", "chartsheet") and not rel.external else None
        if sheet is not None and name != sheet or part in seen:
            continue
        if part is not None:
            seen.add(part)
        reader = _Sheet(strings.found, styles, book.since_1904)
        if part is not None and rel.kind == "worksheet":
            archive.walk(part, reader)
        found = _read_pictures(archive, part) if pictures and part else []
        out.append({"sheet_no": number, "sheet": name, "rows": reader.rows(), "pictures": found})
        if sheet is not None:
            break
    return out


def _read_pictures(archive: Archive, part: str) -> list[dict]:
    """The pictures of the sheet's drawings by row and column of their anchor; those without one come last."""
    found = []
    for drawing in parts_of(part, archive.relationships(part), "drawing"):
        reader = _Drawing(targets(drawing, archive.relationships(drawing)))
        archive.walk(drawing, reader)
        found += reader.found
    return [p for _, _, p in sorted(found, key=lambda x: x[:2])]
