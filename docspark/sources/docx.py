"""Word documents: paragraphs, lists, tables, notes and the first section's header and footer, as blocks."""

from __future__ import annotations

from docspark.plans.plan import ConvertError
from docspark.sources.blocks import Builder, Grid, block, run
from docspark.sources.drawing import WordPictures
from docspark.sources.opc import Archive, Handler, parts_of, resolve_target, targets, walk

DOCUMENT = "word/document.xml"
ALIGN = {"left": "left", "start": "left", "center": "center", "right": "right", "end": "right", "both": "justify", "distribute": "justify"}
FIELDS = {"PAGE": "page_number", "NUMPAGES": "page_count", "SECTIONPAGES": "page_count"}


def heading_level(style: str) -> int | None:
    style = style.lower().replace(" ", "")
    if style == "title":
        return 1
    return int(style[7:]) if style[:7] == "heading" and style[7:] in tuple("123456") else None


def number(value: str | None, default: int) -> int:
    return int(value) if value and value.isascii() and value.isdigit() else default


class _Numbering(Handler):
    def __init__(self) -> None:
        self.levels: dict[str, dict[int, str]] = {}
        self.of: dict[str, str] = {}
        self.abstract, self.level, self.num = "", 0, ""

    def start(self, name, attrs, full, above):
        if name == "abstractNum":
            self.abstract = attrs.get("abstractNumId", "")
        elif name == "lvl":
            self.level = number(attrs.get("ilvl"), 0)
        elif name == "numFmt" and above.within("abstractNum"):
            kind = "bullet" if attrs.get("val") in ("bullet", "none") else "numbered"
            self.levels.setdefault(self.abstract, {})[self.level] = kind
        elif name == "num":
            self.num = attrs.get("numId", "")
        elif name == "abstractNumId" and above.within("num"):
            self.of[self.num] = attrs.get("val", "")

    def kind(self, num: str | None, level: int) -> str | None:
        if num is None or num == "0":
            return None
        return self.levels.get(self.of.get(num, ""), {}).get(level, "bullet")


class _Styles(Handler):
    def __init__(self) -> None:
        self.found: dict[str, dict] = {}
        self.now: dict | None = None

    def start(self, name, attrs, full, above):
        if name == "style":
            self.now = {"name": "", "num": None, "align": None, "paragraph": attrs.get("type", "paragraph") == "paragraph"}
            self.found[attrs.get("styleId", "")] = self.now
        elif self.now is not None and above.within("style"):
            if name == "name":
                self.now["name"] = attrs.get("val", "")
            elif name == "numId":
                self.now["num"] = attrs.get("val")
            elif name == "jc" and self.now["paragraph"]:
                self.now["align"] = ALIGN.get(attrs.get("val", ""))


class _Section(Handler):
    """The default header and footer of the first section, by relationship id."""

    def __init__(self) -> None:
        self.ids: dict[str, str] = {}
        self.done = False

    def start(self, name, attrs, full, above):
        if not self.done and name in ("headerReference", "footerReference") and above.within("sectPr") and attrs.get("type", "default") == "default":
            self.ids.setdefault(name[:6], attrs.get("id", ""))

    def end(self, name, above):
        self.done = self.done or name == "sectPr"


class _Notes(Handler):
    """The ordinary notes of a part, each read as a body of its own."""

    def __init__(self, package: dict, to):
        self.package, self.to = package, to
        self.found: dict[str, list[dict]] = {}
        self.body: Body | None = None

    @property
    def skip(self):
        return Body.skip

    def start(self, name, attrs, full, above):
        if name in ("footnote", "endnote"):
            self.id = attrs.get("id", "")
            self.body = Body(self.package, self.to, {}, None) if attrs.get("type", "normal") == "normal" else None
        elif self.body:
            self.body.start(name, attrs, full, above)

    def end(self, name, above):
        if self.body:
            if name in ("footnote", "endnote"):
                self.found[self.id], self.body = self.body.builder.blocks, None
            else:
                self.body.end(name, above)

    def text(self, data, above):
        if self.body:
            self.body.text(data, above)


class Body(Handler):
    """Blocks of a body, note, header or footer. ``numbers`` maps notes to their number, None where references do not count."""

    skip = frozenset({"Fallback", "pPrChange", "rPrChange", "tblGridChange", "tcPrChange"})

    def __init__(self, package: dict, to, notes: dict, numbers: dict | None, page_fields: bool = False):
        self.package, self.to, self.notes, self.numbers, self.page_fields = package, to, notes, numbers, page_fields
        self.builder = Builder()
        self.pictures = WordPictures(to)
        self.instruction: str | None = None
        self.hidden = False

    def _field(self, instruction: str) -> None:
        """What a field saved shows as text; page fields of headers and footers count instead, and hide it."""
        words = instruction.split()
        field = FIELDS.get(words[0].upper()) if words and self.page_fields else None
        if field:
            self.builder.add(run(kind="field", field=field, bold=self.builder.bold, italic=self.builder.italic))
        self.hidden = field is not None

    def start(self, name, attrs, full, above):
        b = self.builder
        if picture := self.pictures.start(name, attrs, above):
            b.image(picture)
        value, in_run = attrs.get("val"), above.within("r")
        if name == "p":
            b.paragraphs.append({"runs": [], "level": 0})
        elif name == "pStyle":
            b.paragraph["style"] = value
        elif name == "numId":
            b.paragraph["num"] = value
        elif name == "ilvl":
            b.paragraph["level"] = number(value, 0)
        elif name == "jc" and above.within("pPr"):
            b.paragraph["align"] = ALIGN.get(value or "")
        elif name == "hyperlink":
            b.link = self.to.links.get(attrs.get("id", ""))
        elif name == "r":
            b.start_run()
        elif name == "fldSimple":
            self._field(attrs.get("instr", ""))
        elif name == "tbl":
            b.grids.append(Grid(listed=False))
        elif b.grids and name == "gridCol":
            b.grids[-1].columns += 1
        elif b.grids and name == "gridSpan" and above.within("tcPr"):
            b.grids[-1].cell["cols"] = max(1, number(value, 1))
        elif b.grids and name == "vMerge" and above.within("tcPr"):
            b.grids[-1].cell["up"] = value != "restart"
        elif in_run:
            self._in_run(name, attrs, value)

    def _in_run(self, name, attrs, value):
        b, on = self.builder, value not in ("0", "false", "off")
        if name == "b":
            b.bold = on
        elif name == "i":
            b.italic = on
        elif name == "tab":
            b.text(" ")
        elif name in ("br", "cr") and attrs.get("type") not in ("page", "column"):
            b.text("\n")
        elif name == "imagedata" and (part := self.to.images.get(attrs.get("id", ""))):
            b.image({"text": attrs.get("title", ""), "image_part": part, "size": None, "link": None})
        elif name in ("footnoteReference", "endnoteReference") and self.numbers is not None:
            key = (name[:-9], attrs.get("id"))
            if key in self.notes:
                b.add(run(kind="note", note=self.numbers.setdefault(key, len(self.numbers) + 1)))
        elif name == "fldChar":
            step = attrs.get("fldCharType")
            if step == "begin":
                self.instruction = ""
            elif step == "separate":
                self._field(self.instruction or "")
                self.instruction = None
            elif step == "end":
                self.instruction, self.hidden = None, False

    def end(self, name, above):
        b = self.builder
        if name == "hyperlink":
            b.link = None
        elif name == "fldSimple":
            self.hidden = False
        elif name == "p":
            if done := b.end_paragraph():
                b.blocks.append(self._classify(done))
        elif name == "tc" and b.grids:
            b.grids[-1].next_cell()
        elif name == "tr" and b.grids:
            b.grids[-1].next_row()
        elif name == "tbl":
            b.end_grid()

    def text(self, data, above):
        if above.within("instrText"):
            if self.instruction is not None:
                self.instruction += data
        elif above.within("t") and not self.hidden:
            self.builder.text(data)

    def _classify(self, done: dict) -> dict:
        own = done.get("style")
        style = self.package["styles"].get(own, {"name": "", "num": None, "align": None})
        align = done.get("align") or style["align"] or "left"
        level = heading_level(own or "") or heading_level(style["name"])
        if level:
            return block("heading", done["runs"], level, align)
        kind = self.package["numbering"].kind(done["num"] if done.get("num") is not None else style["num"], done["level"])
        if kind:
            return block("list_item", done["runs"], done["level"], align, kind)
        return block("paragraph", done["runs"], align=align)


def read_document(content: bytes, **limits: int) -> tuple[list[dict], Archive]:
    """Rows of blocks with section and section_no: header and footer, the body, then notes by number."""
    archive = Archive(content, **limits)
    rels = archive.relationships(DOCUMENT)
    numbering, styles = _Numbering(), _Styles()
    for kind, reader in (("numbering", numbering), ("styles", styles)):
        for part in parts_of(DOCUMENT, rels, kind)[:1]:
            archive.walk(part, reader)
    package = {"numbering": numbering, "styles": styles.found}
    notes: dict = {}
    for kind in ("footnote", "endnote"):
        for part in parts_of(DOCUMENT, rels, kind + "s")[:1]:
            reader = _Notes(package, targets(part, archive.relationships(part)))
            archive.walk(part, reader)
            notes |= {(kind, i): blocks for i, blocks in reader.found.items()}
    numbers: dict = {}
    body, section = Body(package, targets(DOCUMENT, rels), notes, numbers), _Section()
    data = archive.read(DOCUMENT)
    if data is None:
        raise ConvertError("data", f"the package has no part {DOCUMENT}")
    walk(data, section, DOCUMENT)
    walk(data, body, DOCUMENT)
    out = []
    for kind in ("header", "footer"):
        rel = rels.get(section.ids.get(kind, ""))
        if rel and rel.kind == kind and not rel.external:
            part = resolve_target(DOCUMENT, rel.target)
            reader = Body(package, targets(part, archive.relationships(part)), {}, None, page_fields=True)
            archive.walk(part, reader)
            out += [b | {"section": kind, "section_no": 0} for b in reader.builder.blocks]
    out += [b | {"section": "body", "section_no": 0} for b in body.builder.blocks]
    for key, n in sorted(numbers.items(), key=lambda x: x[1]):
        out += [b | {"section": "note", "section_no": n} for b in notes[key]]
    return out, archive
