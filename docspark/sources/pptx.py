"""Slide decks: titles, bodies, tables, pictures and speaker notes, as blocks."""

from __future__ import annotations

from docspark.sources.blocks import Builder, Grid, append_run, block, is_blank, run
from docspark.sources.docx import number
from docspark.sources.drawing import ShapePictures
from docspark.sources.opc import Archive, Handler, parts_of, resolve_target, targets

PRESENTATION = "ppt/presentation.xml"
ALIGN = {"ctr": "center", "r": "right", "just": "justify", "justLow": "justify", "dist": "justify", "thaiDist": "justify"}
BULLETS = {"buNone": "none", "buChar": "bullet", "buBlip": "bullet", "buAutoNum": "numbered"}


class _Deck(Handler):
    def __init__(self) -> None:
        self.ids: list[str] = []

    def start(self, name, attrs, full, above):
        if name == "sldId":
            self.ids += [v for k, v in full.items() if k.endswith(":id")][:1]


class Slide(Handler):
    """One slide, or its speaker notes: of these only the body placeholder's paragraphs."""

    def __init__(self, to, notes: bool = False):
        self.to, self.notes = to, notes
        self.builder, self.pictures = Builder(), ShapePictures(to)
        self.title: list[dict] = []
        self.hidden = False
        self.shape: dict | None = None

    def start(self, name, attrs, full, above):
        b, in_run = self.builder, above.within("r") or above.within("fld")
        if not self.notes:
            self.pictures.start(name, attrs, above)
        if name == "sld":
            self.hidden = attrs.get("show") == "0"
        elif name == "sp":
            self.shape = {"placeholder": None, "paragraphs": []}
        elif name == "ph" and self.shape is not None:
            self.shape["placeholder"] = attrs.get("type", "body")
        elif name == "p":
            b.paragraphs.append({"runs": [], "level": 0, "align": "left", "bullet": None})
        elif name == "pPr":
            b.paragraph.update(level=number(attrs.get("lvl"), 0), align=ALIGN.get(attrs.get("algn", ""), "left"))
        elif name in BULLETS:
            b.paragraph["bullet"] = BULLETS[name]
        elif name in ("r", "fld"):
            b.start_run()
            b.link = None
        elif name == "rPr" and in_run:
            b.bold, b.italic = (attrs.get(k) in ("1", "true") for k in "bi")
        elif name == "hlinkClick" and in_run:
            b.link = self.to.links.get(attrs.get("id", ""))
        elif name == "br":
            b.text("\n")
        elif name == "tbl":
            b.grids.append(Grid(listed=True))
        elif name == "tc" and b.grids:
            left, up = (attrs.get(k) in ("1", "true") for k in ("hMerge", "vMerge"))
            b.grids[-1].cell.update(cols=number(attrs.get("gridSpan"), 1), rows=number(attrs.get("rowSpan"), 1), left=left, up=up)

    def end(self, name, above):
        b = self.builder
        if picture := self.pictures.end(name):
            b.blocks.append(block("paragraph", [run(picture["text"], "image", link=picture["link"], image_part=picture["image_part"], size=picture["size"])]))
        if name in ("r", "fld"):
            b.start_run()
            b.link = None
        elif name == "p":
            done = b.end_paragraph()
            if done and self.shape is not None:
                self.shape["paragraphs"].append(done)
        elif name == "sp" and self.shape is not None:
            shape, self.shape = self.shape, None
            self._place(shape)
        elif name == "tc" and b.grids:
            b.grids[-1].next_cell()
        elif name == "tr" and b.grids:
            b.grids[-1].next_row()
        elif name == "tbl":
            b.end_grid()

    def text(self, data, above):
        if above.within("t"):
            self.builder.text(data)

    def _place(self, shape: dict) -> None:
        """A title joins the heading; other shapes are lists or paragraphs. Bodies and objects have bullets by default."""
        kind, out = shape["placeholder"], self.builder.blocks
        if self.notes:
            if kind == "body":
                out += [block("paragraph", p["runs"], align=p["align"]) for p in shape["paragraphs"]]
        elif kind in ("title", "ctrTitle"):
            for p in shape["paragraphs"]:
                if self.title:
                    append_run(self.title, run(" "))
                for r in p["runs"]:
                    append_run(self.title, r)
        else:
            for p in shape["paragraphs"]:
                bullet = p["bullet"] or ("bullet" if kind in ("body", "obj") else "none")
                if bullet == "none":
                    out.append(block("paragraph", p["runs"], align=p["align"]))
                else:
                    out.append(block("list_item", p["runs"], p["level"], p["align"], bullet))


def read_deck(content: bytes, notes: bool = True, **limits: int) -> tuple[list[dict], Archive]:
    """Rows of blocks, section_no the slide's number: a rule between slides, a heading, the body, the notes."""
    archive = Archive(content, **limits)
    deck = _Deck()
    archive.walk(PRESENTATION, deck, required=True)
    rels = archive.relationships(PRESENTATION)
    out: list[dict] = []
    seen: set[str] = set()
    slide_no = 0
    for rel in (rels.get(i) for i in deck.ids):
        if rel is None or rel.kind != "slide" or rel.external:
            continue
        part = resolve_target(PRESENTATION, rel.target)
        if part in seen:
            continue
        seen.add(part)
        own = archive.relationships(part)
        slide = Slide(targets(part, own))
        if not archive.walk(part, slide):
            continue
        slide_no += 1
        heading = [run(f"Slide {slide_no}")]
        if slide.hidden:
            append_run(heading, run(" (hidden)"))
        if not is_blank(slide.title):
            for r in [run(": "), *slide.title]:
                append_run(heading, r)
        blocks = [block("rule")] * (slide_no > 1) + [block("heading", heading, 2), *slide.builder.blocks]
        out += [b | {"section": "body", "section_no": slide_no} for b in blocks]
        for notes_part in parts_of(part, own, "notesSlide")[:1] if notes else []:
            if notes_part not in seen:
                seen.add(notes_part)
                reader = Slide(targets(notes_part, archive.relationships(notes_part)), notes=True)
                archive.walk(notes_part, reader)
                if reader.builder.blocks:
                    spoken = [block("heading", [run("Notes")], 3), *reader.builder.blocks]
                    out += [b | {"section": "notes", "section_no": slide_no} for b in spoken]
    return out, archive
