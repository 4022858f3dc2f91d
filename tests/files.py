"""Small Office files built in memory."""

import struct
import zlib

from docspark.sources import samples as S
from docspark.sources.samples import node, package  # noqa: F401


def png(width=1, height=1):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = (b"\0" + b"\xff\0\0" * width) * height
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def cell(at, value, kind="n", style=None):
    attrs = {"r": at} | ({} if kind == "n" else {"t": kind}) | ({"s": style} if style else {})
    return node("c", attrs, node("is", None, node("t", None, value)) if kind == "inlineStr" else node("v", None, value))


def workbook(number_format="22", sheet="Lakes"):
    """Lakes starts at B2 and leaves out row 4; Empty has no rows; Again is Lakes under another name."""
    rows = {
        2: [cell("B2", "0", "s"), cell("C2", "Depth|m", "inlineStr"), cell("D2", "1", "s")],
        3: [cell("B3", "2", "s"), cell("C3", "3"), cell("D3", "45292", style="1")],
        5: [cell("B5", "1", "b"), cell("C5", "2.5"), cell("D5", "45292.5", style="1"), cell("E5", "#DIV/0!", "e")],
    }
    strings = [node("si", None, node("t", None, "Name")), node("si", None, node("r", None, node("t", None, "Wh")), node("r", None, node("t", None, "en")), node("rPh", None, node("t", None, "no"))), node("si", None, node("t", None, "a*b"))]
    pictures = [(9, 1, "low", "i"), (2, 1, "high", "i"), (1, 1, "none", "missing")]
    anchors = [
        node("x:oneCellAnchor", None, node("x:from", None, node("x:col", None, str(c)), node("x:row", None, str(r))), node("x:pic", None, node("x:nvPicPr", None, node("x:cNvPr", {"descr": text})), node("x:blipFill", None, node("a:blip", {"r:embed": i}))))
        for r, c, text, i in pictures
    ]
    return package(
        {
            "xl/workbook.xml": S.root("workbook", "r", node("sheets", None, *(node("sheet", {"name": n, "r:id": i}) for n, i in ((sheet, "one"), ("Empty", "two"), ("Again", "one"))))),
            "xl/_rels/workbook.xml.rels": S.relations(("one", "worksheet", "worksheets/lakes.xml"), ("two", "worksheet", "/xl/worksheets/empty.xml")),
            "xl/sharedStrings.xml": node("sst", None, *strings),
            "xl/styles.xml": node("styleSheet", None, node("cellXfs", None, node("xf", {"numFmtId": 0}), node("xf", {"numFmtId": number_format}))),
            "xl/worksheets/lakes.xml": S.root("worksheet", "r", node("sheetData", None, *(node("row", {"r": r}, *cells) for r, cells in rows.items()))),
            "xl/worksheets/empty.xml": node("worksheet", None, node("sheetData")),
            "xl/worksheets/_rels/lakes.xml.rels": S.relations(("d", "drawing", "../drawings/d.xml")),
            "xl/drawings/d.xml": S.root("x:wsDr", "x a r", *anchors),
            "xl/drawings/_rels/d.xml.rels": S.relations(("i", "image", "../media/p.png")),
            "xl/media/p.png": png(),
        }
    )


def document(image=None):
    def link(i, text):
        return node("w:hyperlink", {"r:id": i}, S.words(text))

    def reference(i):
        return node("w:r", None, node("w:footnoteReference", {"w:id": i}))

    plain = node("w:r", None, node("w:rPr", None, node("w:i", {"w:val": "0"})), node("w:t", None, "plain"))
    broken = node("w:r", None, node("w:t", None, "one"), node("w:br"), node("w:t", None, "two"))
    drawn = node("wp:inline", None, node("wp:extent", {"cx": 914400, "cy": 914400}), node("wp:docPr", {"descr": "a cat"}), node("pic:pic", None, node("a:blip", {"r:embed": "i1"})))
    say = lambda *texts: [S.paragraph(S.words(t)) for t in texts]
    body = [
        S.paragraph(S.words("Top", "b"), style="Heading1"),
        S.paragraph(S.words("Sub"), style="Zwei", align="both"),
        S.paragraph(S.words("bold ", "b"), plain, S.words(" more"), link("h1", " link"), link("h2", " bad"), reference(3), reference(9)),
        S.paragraph(broken, item=(1, 0)),
        S.paragraph(S.words("deep"), node("w:r", None, node("w:delText", None, "gone")), item=(1, 1)),
        *say("   "),
        S.word_table(
            [S.word_cell(*say("wide"), wide=2)],
            [S.word_cell(*say("tall"), tall="restart"), S.word_cell(*say("x", "y"))],
            [S.word_cell(node("w:p"), tall="continue"), S.word_cell(*say("z"))],
            columns=2,
        ),
        S.paragraph(node("w:r", None, node("w:drawing", None, drawn))),
        node("w:sectPr", None, node("w:headerReference", {"w:type": "default", "r:id": "hd"})),
    ]
    related = [
        ("h1", "hyperlink", "https://x.y/a b", True), ("h2", "hyperlink", "javascript:x", True), ("i1", "image", "media/cat.jpg"), ("n", "numbering", "numbering.xml"),
        ("s", "styles", "styles.xml"), ("f", "footnotes", "footnotes.xml"), ("hd", "header", "header1.xml"),
    ]
    page = node("w:fldSimple", {"w:instr": " PAGE "}, S.words("7"))
    return S.document(
        body, related, numbering__xml=S.lists(("decimal", "bullet")), styles__xml=S.styles({"Zwei": "heading 2"}), footnotes__xml=S.notes("footnote", {3: say("first", "second")}, separator=0),
        header1__xml=S.root("w:hdr", "w", S.paragraph(S.words("Page "), page)), media_cat__jpg=png() if image is None else image,
    )


def deck():
    def page(title, body, **attrs):
        return [S.shape("title", S.line(title)), S.shape("", S.line(body, bold=True), S.line("n", level=1, bullet="buAutoNum")), S.shape(None, S.line("free"))], attrs

    said = [S.shape("body", S.line("say this")), S.shape("sldNum", S.line("1"))]
    return S.slides([page("Hello", "point"), page("Bye", "last", show=0)], order=[0, 1, 0], spoken={0: said})
