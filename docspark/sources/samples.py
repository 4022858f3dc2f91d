"""Small office files written from Python values, to send tables through the readers and back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from xml.etree import ElementTree

KINDS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def node(tag: str, attrs: dict[str, object] | None = None, *inner: ElementTree.Element | str | None) -> ElementTree.Element:
    """An element with its attributes and what is inside it; prefixes are part of the names."""
    out = ElementTree.Element(tag, {k: str(v) for k, v in (attrs or {}).items()})
    for x in inner:
        if isinstance(x, str):
            if len(out):
                out[-1].tail = (out[-1].tail or "") + x
            else:
                out.text = (out.text or "") + x
        elif x is not None:
            out.append(x)
    return out


def root(tag: str, prefixes: str, *inner: ElementTree.Element | None, **attrs: object) -> ElementTree.Element:
    return node(tag, {f"xmlns:{p}": f"urn:{p}" for p in prefixes.split()} | attrs, *inner)


def package(parts: dict[str, ElementTree.Element | bytes]) -> bytes:
    """A zip file of parts, the same bytes each time."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, part in parts.items():
            archive.writestr(zipfile.ZipInfo(name), part if isinstance(part, bytes) else ElementTree.tostring(part))
    return out.getvalue()


def relations(*targets: tuple[str, str, str] | tuple[str, str, str, bool]) -> ElementTree.Element:
    """Relationships (id, kind, target, whether outside the package)."""
    made = [{"Id": i, "Type": KINDS + kind, "Target": target} | ({"TargetMode": "External"} if more and more[0] else {}) for i, kind, target, *more in targets]
    return node("Relationships", None, *(node("Relationship", attrs) for attrs in made))


def _cell(value: object) -> ElementTree.Element:
    """Text inline, a number or truth value as such, None as a missing value; (number, style) has a format."""
    style = {}
    if isinstance(value, tuple):
        value, style = value[0], {"s": value[1]}
    if isinstance(value, bool):
        return node("c", {"t": "b"} | style, node("v", None, str(int(value))))
    if value is None or isinstance(value, (int, float)):
        return node("c", style, None if value is None else node("v", None, repr(value)))
    return node("c", {"t": "inlineStr"} | style, node("is", None, node("t", None, str(value))))


def workbook(sheets: dict[str, Iterable[Iterable[object]]], pictures: dict[str, list[tuple[int | None, int | None, str]]] | None = None, image: bytes = b"") -> bytes:
    """Sheets of rows; style 1 is a date. Pictures of a sheet are (row, column, text), one image for all."""
    names = list(sheets)
    parts: dict[str, ElementTree.Element | bytes] = {
        "xl/workbook.xml": root("workbook", "r", node("sheets", None, *(node("sheet", {"name": name, "r:id": f"s{i}"}) for i, name in enumerate(names)))),
        "xl/_rels/workbook.xml.rels": relations(*((f"s{i}", "worksheet", f"worksheets/sheet{i}.xml") for i in range(len(names)))),
        "xl/styles.xml": node("styleSheet", None, node("cellXfs", None, node("xf", {"numFmtId": 0}), node("xf", {"numFmtId": 22}))),
    }
    for i, name in enumerate(names):
        data = node("sheetData", None, *(node("row", None, *map(_cell, row)) for row in sheets[name]))
        parts[f"xl/worksheets/sheet{i}.xml"] = node("worksheet", None, data)
        if shown := (pictures or {}).get(name):
            parts[f"xl/worksheets/_rels/sheet{i}.xml.rels"] = relations(("d", "drawing", f"../drawings/drawing{i}.xml"))
            parts[f"xl/drawings/drawing{i}.xml"] = root("x:wsDr", "x a r", *(_anchor(*p) for p in shown))
            parts[f"xl/drawings/_rels/drawing{i}.xml.rels"] = relations(("i", "image", "../media/picture.png"))
            parts["xl/media/picture.png"] = image
    return package(parts)


def _anchor(row: int | None, column: int | None, text: str) -> ElementTree.Element:
    spot = [node(f"x:{k}", None, str(v)) for k, v in (("col", column), ("row", row)) if v is not None]
    shape = node("x:pic", None, node("x:nvPicPr", None, node("x:cNvPr", {"descr": text})), node("x:blipFill", None, node("a:blip", {"r:embed": "i"})))
    return node("x:oneCellAnchor", None, node("x:from", None, *spot), shape)


def words(text: str, *marks: str) -> ElementTree.Element:
    """A run of Word with marks such as b and i."""
    return node("w:r", None, node("w:rPr", None, *(node(f"w:{m}") for m in marks)) if marks else None, node("w:t", {"xml:space": "preserve"}, text))


def paragraph(*inner: ElementTree.Element, style: str | None = None, item: tuple[int, int] | None = None, align: str | None = None) -> ElementTree.Element:
    """A paragraph of Word; item is (list, level)."""
    listed = node("w:numPr", None, node("w:ilvl", {"w:val": item[1]}), node("w:numId", {"w:val": item[0]})) if item else None
    made = [node("w:pStyle", {"w:val": style}) if style else None, listed, node("w:jc", {"w:val": align}) if align else None]
    return node("w:p", None, node("w:pPr", None, *made) if any(x is not None for x in made) else None, *inner)


def word_table(*rows: list[ElementTree.Element], columns: int) -> ElementTree.Element:
    return node("w:tbl", None, node("w:tblGrid", None, *(node("w:gridCol") for _ in range(columns))), *(node("w:tr", None, *row) for row in rows))


def word_cell(*inner: ElementTree.Element, wide: int | None = None, tall: str | None = None) -> ElementTree.Element:
    """A cell of Word; tall is restart for the first of merged cells, and continue for those below."""
    marks = [node("w:gridSpan", {"w:val": wide}) if wide else None, node("w:vMerge", {"w:val": tall}) if tall else None]
    return node("w:tc", None, node("w:tcPr", None, *marks), *inner)


def lists(*formats: tuple[str, ...]) -> ElementTree.Element:
    """A numbering part: list 1 has the first formats, one for each level, and so on."""
    abstract = [node("w:abstractNum", {"w:abstractNumId": i}, *(node("w:lvl", {"w:ilvl": n}, node("w:numFmt", {"w:val": f})) for n, f in enumerate(own))) for i, own in enumerate(formats)]
    return root("w:numbering", "w", *abstract, *(node("w:num", {"w:numId": i + 1}, node("w:abstractNumId", {"w:val": i})) for i in range(len(formats))))


def styles(names: dict[str, str]) -> ElementTree.Element:
    return root("w:styles", "w", *(node("w:style", {"w:type": "paragraph", "w:styleId": i}, node("w:name", {"w:val": name})) for i, name in names.items()))


def notes(kind: str, found: dict[int, list[ElementTree.Element]], separator: int | None = None) -> ElementTree.Element:
    line = [node(f"w:{kind}", {"w:type": "separator", "w:id": separator}, paragraph(words("-")))] if separator is not None else []
    return root(f"w:{kind}s", "w", *line, *(node(f"w:{kind}", {"w:id": i}, *inner) for i, inner in found.items()))


def document(body: Iterable[ElementTree.Element], related: Iterable[tuple] = (), **parts: ElementTree.Element | bytes) -> bytes:
    """A Word file; parts are named by their file below word/, with _ for / and a double one for the dot."""
    more = {"word/" + name.replace("__", ".").replace("_", "/"): part for name, part in parts.items()}
    return package({"word/document.xml": root("w:document", "w r a wp pic", node("w:body", None, *body)), "word/_rels/document.xml.rels": relations(*related)} | more)


def headed(rows: list[list[str]]) -> bytes:
    """A Word file: the first row is a heading; every other one is a paragraph with its first value bold."""
    head, *body = rows
    return document([paragraph(words(" ".join(head)), style="Heading1"), *(paragraph(words(first, "b"), words(" " + " ".join(rest))) for first, *rest in body)])


def shape(kind: str | None, *paragraphs: ElementTree.Element) -> ElementTree.Element:
    """A shape of a slide; a placeholder has a kind, which may be empty."""
    return node("p:sp", None, node("p:ph", {"type": kind} if kind else None) if kind is not None else None, *paragraphs)


def line(text: str, *, bold: bool = False, level: int | None = None, bullet: str | None = None) -> ElementTree.Element:
    """A paragraph of a slide."""
    looks = node("a:pPr", {"lvl": level} if level is not None else None, node(f"a:{bullet}") if bullet else None) if level is not None or bullet else None
    return node("a:p", None, looks, node("a:r", None, node("a:rPr", {"b": 1}) if bold else None, node("a:t", None, text)))


def slides(pages: list[tuple[list[ElementTree.Element], dict]], order: list[int] | None = None, spoken: dict[int, list[ElementTree.Element]] | None = None) -> bytes:
    """A deck of pages (shapes, attributes), shown in an order, with shapes of notes for some."""
    parts: dict[str, ElementTree.Element | bytes] = {}
    for i, (shapes, attrs) in enumerate(pages):
        parts[f"ppt/slides/page{i}.xml"] = root("p:sld", "p a r", *shapes, **attrs)
        if spoken and i in spoken:
            parts[f"ppt/slides/_rels/page{i}.xml.rels"] = relations(("n", "notesSlide", f"../notesSlides/said{i}.xml"))
            parts[f"ppt/notesSlides/said{i}.xml"] = root("p:notes", "p a r", *spoken[i])
    shown = order if order is not None else range(len(pages))
    parts["ppt/presentation.xml"] = root("p:presentation", "p r", node("p:sldIdLst", None, *(node("p:sldId", {"id": 300 + k, "r:id": f"page{i}"}) for k, i in enumerate(shown))))
    parts["ppt/_rels/presentation.xml.rels"] = relations(*((f"page{i}", "slide", f"slides/page{i}.xml") for i in range(len(pages))))
    return package(parts)


def deck(rows: list[list[str]]) -> bytes:
    """A slide for each row: the first value is its title, the others are bullets."""
    return slides([([shape("title", line(first)), shape("body", *map(line, rest))], {}) for first, *rest in rows])
