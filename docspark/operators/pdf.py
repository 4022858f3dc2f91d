"""Blocks as PDF with the standard fonts: text in order, lists, tables, links, repeated headers and footers.

Layout is bounded: the standard Latin fonts only, no reordering of right-to-left text. Characters outside the fonts are
shown as question marks and reported. Images that cannot be taken as they are show their text.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field, replace
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import DataFrame

from docspark.operators.pdf_images import Picture, column_widths, read_picture, shown_size, widened

#: Widths of the standard sans font for code points 32 to 126, in thousandths of the size.
WIDTHS = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
FONTS = {(False, False): "Helvetica", (True, False): "Helvetica-Bold", (False, True): "Helvetica-Oblique", (True, True): "Helvetica-BoldOblique"}
SCALES = {1: 2.0, 2: 1.6, 3: 1.3, 4: 1.15, 5: 1.05, 6: 1.0}
#: Where a line may end within a word: after a hyphen between letters, after a dash, between ideographs or kana.
BREAKS = re.compile(r"(?<=[^\W\d_]-)(?=[^\W\d_])|(?<=[–—])(?=\w)|(?<=[぀-ヿ㐀-鿿])(?=[぀-ヿ㐀-鿿])")
#: Characters of a header or footer that are repeated on each page.
FURNITURE_LIMIT = 1000


@dataclass(frozen=True)
class Setup:
    width: float
    height: float
    margin: float
    body: float


DOCUMENT, SLIDES = Setup(595.28, 841.89, 72, 11), Setup(960, 540, 48, 16)


def text_width(text: str, size: float, bold: bool = False) -> float:
    return sum(WIDTHS[ord(c) - 32] if 32 <= ord(c) < 127 else 556 for c in text) * size / 1000 * (1.06 if bold else 1)


@dataclass
class Page:
    items: list[str] = field(default_factory=list)
    links: list[tuple[float, float, float, float, str]] = field(default_factory=list)
    images: set[str] = field(default_factory=set)


@dataclass
class Box:
    """A cell in its place: the first of its rows, how many it takes, and its lines."""

    row: int
    rows: int
    x: float
    width: float
    lines: list[list[dict]]


def bands(rows: list[list[Box]]) -> list[range]:
    """Ranges of rows whose borders no cell crosses, each as small as can be."""
    out, start, reach = [], 0, 0
    for i, row in enumerate(rows):
        reach = max([reach, i + 1, *(i + b.rows for b in row)])
        if reach == i + 1:
            out.append(range(start, reach))
            start = reach
    return out


class Layout:
    """Places blocks from top to bottom and starts a page where one is full."""

    def __init__(self, setup: Setup, images: dict[str, Picture | None] | None = None):
        self.setup, self.pages, self.missing = setup, [Page()], set()
        self.images, self.skipped = images or {}, set()
        self.y = setup.height - setup.margin
        self.counters: list[int] = []

    def _room(self, height: float) -> None:
        if self.y - height < self.setup.margin:
            self.pages.append(Page())
            self.y = self.setup.height - self.setup.margin

    def _show(self, page: Page, x: float, y: float, size: float, piece: dict) -> float:
        known = "".join(c if c.encode("cp1252", "ignore") else "?" for c in piece["text"])
        self.missing |= {c for c in piece["text"] if not c.encode("cp1252", "ignore")}
        font = list(FONTS).index((bool(piece["bold"]), bool(piece["italic"])))
        raw = known.encode("cp1252").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)").decode("latin-1")
        page.items.append(f"BT /F{font} {size:.2f} Tf {x:.2f} {y:.2f} Td ({raw}) Tj ET")
        width = text_width(known, size, piece["bold"])
        if piece["link"]:
            page.links.append((x, y - 2, x + width, y + size, piece["link"]))
        return width

    @staticmethod
    def lines(runs: list[dict], width: float, size: float) -> list[list[dict]]:
        """Runs broken at line ends, spaces and BREAKS so that each line fits; a word that is too long is broken."""
        out, line, used = [], [], 0.0

        def put(piece: str, r: dict) -> None:
            nonlocal used
            if line and all(line[-1][k] == r[k] for k in ("bold", "italic", "link")):
                line[-1] = line[-1] | {"text": line[-1]["text"] + piece}
            else:
                line.append({"text": piece, "bold": r["bold"], "italic": r["italic"], "link": r["link"]})
            used += text_width(piece, size, r["bold"])

        for r in runs:
            shown = f"[{r['note']}]" if r["kind"] == "note" else r["text"] if r["kind"] != "image" else f"[{r['text'] or 'image'}]"
            for n, part in enumerate(shown.split("\n")):
                if n:
                    out.append(line)
                    line, used = [], 0.0
                bits = [(bit, i and not k) for i, word in enumerate(part.split(" ")) for k, bit in enumerate(BREAKS.split(word))]
                for bit, after in bits:
                    gap = " " if after else ""
                    if line and used + text_width(gap + bit, size, r["bold"]) > width:
                        out.append(line)
                        line, used, gap = [], 0.0, ""
                    if len(bit) > 1 and text_width(bit, size, r["bold"]) > width:
                        ends = list(accumulate(text_width(c, size, r["bold"]) for c in bit))
                        start = 0
                        while len(bit) - start > 1 and ends[-1] - (ends[start - 1] if start else 0) > width:
                            stop = max(start + 1, bisect_right(ends, width + (ends[start - 1] if start else 0), start))
                            put(gap + bit[start:stop], r)
                            out.append(line)
                            line, used, gap, start = [], 0.0, "", stop
                        bit = bit[start:]
                    if gap + bit:
                        put(gap + bit, r)
        return [*out, line]

    def runs(self, runs: list[dict], size: float, indent: float = 0, align: str = "left", marker: str = "") -> None:
        """Text in lines, and each image that can be shown on its own between them."""
        for shown, group in groupby(runs, lambda r: r["kind"] == "image" and self._shows(r.get("image_part"))):
            if shown:
                for r in group:
                    self._image(r, indent, align)
            else:
                self._text(list(group), size, indent, align, marker)
                marker = ""

    def _shows(self, part: str | None) -> bool:
        if part in self.images and self.images[part] is None:
            self.skipped.add(part)
        return self.images.get(part) is not None

    def _image(self, r: dict, indent: float, align: str) -> None:
        room = self.setup.width - 2 * self.setup.margin - indent
        size = (r["cx"], r["cy"]) if r.get("cx") and r.get("cy") else None
        width, height = shown_size(self.images[r["image_part"]], size, room, self.setup.height - 2 * self.setup.margin - 1)
        self._room(height)
        self.y -= height
        x = self.setup.margin + indent + {"right": room - width, "center": (room - width) / 2}.get(align, 0)
        page = self.pages[-1]
        page.items.append(f"q {width:.2f} 0 0 {height:.2f} {x:.2f} {self.y:.2f} cm /I{sorted(self.images).index(r['image_part'])} Do Q")
        page.images.add(r["image_part"])
        if r["link"]:
            page.links.append((x, self.y, x + width, self.y + height, r["link"]))
        self.y -= self.setup.body * 0.5

    def _text(self, runs: list[dict], size: float, indent: float, align: str, marker: str) -> None:
        width = self.setup.width - 2 * self.setup.margin - indent
        for n, line in enumerate(self.lines(runs, width, size)):
            self._room(size * 1.3)
            self.y -= size * 1.3
            spare = width - sum(text_width(p["text"], size, p["bold"]) for p in line)
            x = self.setup.margin + indent + max(0, {"right": spare, "center": spare / 2}.get(align, 0))
            if not n and marker:
                self._show(self.pages[-1], x - 0.9 * self.setup.body * 1.5, self.y, size, {"text": marker, "bold": False, "italic": False, "link": None})
            for piece in line:
                x += self._show(self.pages[-1], x, self.y, size, piece)
        self.y -= size * 0.5

    def marker(self, level: int, numbered: bool) -> str:
        """Items count within their level; going out forgets the deeper counts."""
        del self.counters[level + 1 :]
        self.counters += [0] * (level + 1 - len(self.counters))
        self.counters[level] += 1
        return f"{self.counters[level]}." if numbered else "•" if level % 2 == 0 else "-"

    def table(self, grid: list[list[dict]]) -> None:
        """Rows from top to bottom; those that a cell of several rows joins stay on one page.

        Joined rows that no page holds are drawn apart, the cell's text in the first; a row that no page holds goes on from
        page to page by lines. On each page that a table goes on to, its header comes again, unless it is over half a page
        high. A header is bold; cells that a short row lacks are empty.
        """
        size, columns, count = self.setup.body, max(map(len, grid), default=0), len(grid)
        if not columns:
            return
        empty = {"covered": False, "cols": 1, "rows": 1, "runs": []}
        grid = [[*row, *[empty] * (columns - len(row))] for row in grid]
        grid[0] = [c | {"runs": [r | {"bold": True} for r in c["runs"] or []]} for c in grid[0]]
        rows = self._boxes(grid, self._widths(grid, columns, size), size)
        heights = self._heights(rows, size)
        whole = self.setup.height - 2 * self.setup.margin
        head = rows[0] if count > 1 and all(b.rows == 1 for b in rows[0]) and heights[0] <= whole / 2 else None
        room = whole - (heights[0] if head is not None else 0)
        apart = [band for band in bands(rows) if len(band) > 1 and sum(heights[i] for i in band) > room]
        if apart:
            for i in (i for band in apart for i in band):
                for b in [b for b in rows[i] if b.rows > 1]:
                    for below in range(i + 1, i + b.rows):
                        rows[below].append(Box(below, 1, b.x, b.width, []))
                    b.rows = 1
            heights = self._heights(rows, size)
        for band in bands(rows):
            again = head if band.start else None
            height = sum(heights[i] for i in band)
            if height > (room if band.start else whole):
                self._long_row(rows[band.start], again, heights[0], size)
                continue
            if self.y - height < self.setup.margin:
                self._next_page(again, heights[0], size)
            top = self.y
            for i in band:
                for b in rows[i]:
                    self._box(b, top, sum(heights[i : i + b.rows]), size)
                top -= heights[i]
            self.y = top
        self.y -= size

    def _boxes(self, grid: list[list[dict]], widths: list[float], size: float) -> list[list[Box]]:
        rows = []
        for i, row in enumerate(grid):
            rows.append([])
            for j, cell in enumerate(row):
                if not cell["covered"]:
                    width = sum(widths[j : j + (cell["cols"] or 1)])
                    taken = min(max(1, cell["rows"] or 1), len(grid) - i)
                    rows[i].append(Box(i, taken, self.setup.margin + sum(widths[:j]), width, self.lines(cell["runs"], width - 8, size)))
        return rows

    @staticmethod
    def _heights(rows: list[list[Box]], size: float) -> list[float]:
        """Rows as high as their cells ask for; what a cell of several rows lacks is shared by its rows."""
        heights = [size * 1.3 + 6] * len(rows)
        for b in sorted((b for row in rows for b in row), key=lambda b: b.rows):
            heights[b.row : b.row + b.rows] = widened(heights[b.row : b.row + b.rows], len(b.lines) * size * 1.3 + 6)
        return heights

    def _next_page(self, head: list[Box] | None, height: float, size: float) -> None:
        self.pages.append(Page())
        self.y = self.setup.height - self.setup.margin
        for b in head or []:
            self._box(b, self.y, height, size)
        self.y -= height if head else 0

    def _long_row(self, row: list[Box], head: list[Box] | None, height: float, size: float) -> None:
        at, most = 0, max(len(b.lines) for b in row)
        while at < most:
            fit = min(int((self.y - self.setup.margin - 6) / (size * 1.3)), most - at)
            if fit < 1:
                self._next_page(head, height, size)
                continue
            own = fit * size * 1.3 + 6
            for b in row:
                self._box(replace(b, lines=b.lines[at : at + fit]), self.y, own, size)
            self.y -= own
            at += fit

    def _box(self, b: Box, top: float, height: float, size: float) -> None:
        page = self.pages[-1]
        page.items.append(f"{b.x:.2f} {top - height:.2f} {b.width:.2f} {height:.2f} re S")
        for n, line in enumerate(b.lines, 1):
            at = b.x + 4
            for piece in line:
                at += self._show(page, at, top - n * size * 1.3, size, piece)

    def _widths(self, grid: list[list[dict]], columns: int, size: float) -> list[float]:
        """A column's narrowest width holds its longest word, its natural one its longest line; wide cells widen theirs evenly."""
        narrow, natural, wide = [8.0] * columns, [8.0] * columns, []
        for row in grid:
            for i, cell in enumerate(row):
                if cell["covered"]:
                    continue
                least = max((text_width(w, size, r["bold"]) for r in cell["runs"] for w in r["text"].split()), default=0) + 8
                most = max((sum(text_width(p["text"], size, p["bold"]) for p in line) for line in self.lines(cell["runs"], 1e9, size)), default=0) + 8.01
                if (span := cell["cols"] or 1) == 1:
                    narrow[i], natural[i] = max(narrow[i], least), max(natural[i], most)
                else:
                    wide.append((i, min(i + span, columns), least, most))
        for i, j, least, most in wide:
            narrow[i:j], natural[i:j] = widened(narrow[i:j], least), widened(natural[i:j], most)
        return column_widths(narrow, natural, self.setup.width - 2 * self.setup.margin)

    def place(self, blocks: list[dict], slides: bool) -> None:
        for b in blocks:
            kind = b["kind"]
            if kind != "list_item":
                self.counters.clear()
            if kind == "rule":
                if slides:
                    self.pages.append(Page())
                    self.y = self.setup.height - self.setup.margin
            elif kind == "table":
                self.table(b["grid"])
            elif kind == "list_item":
                indent = self.setup.body * 1.5 * (b["level"] + 1)
                self.runs(b["runs"], self.setup.body, indent, b["align"], self.marker(b["level"], b["list_kind"] == "numbered"))
            elif kind == "heading":
                self.runs([r | {"bold": True} for r in b["runs"]], self.setup.body * SCALES[b["level"]], align=b["align"])
            else:
                self.runs(b["runs"], self.setup.body, align=b["align"])

    def furniture(self, blocks: list[dict], top: bool) -> None:
        """A header or footer on every page, with its page fields filled in."""
        left = FURNITURE_LIMIT
        kept = []
        for r in (r for b in blocks for r in b["runs"]):
            if left > 0:
                cut = r | {"text": r["text"][:left]} if r["kind"] == "text" else r
                left -= len(r["text"]) if r["kind"] == "text" else 1
                kept.append(cut)
        size = self.setup.body * 0.8
        for n, page in enumerate(self.pages, 1):
            fill = {"page_number": str(n), "page_count": str(len(self.pages))}
            filled = [r | {"text": fill[r["field"]]} if r["kind"] == "field" else r for r in kept]
            lines = self.lines(filled, self.setup.width - 2 * self.setup.margin, size)
            for i, line in enumerate(lines):
                x, y = self.setup.margin, self.setup.height - self.setup.margin / 2 - i * size * 1.3 if top else self.setup.margin / 2 + (len(lines) - 1 - i) * size * 1.3
                for piece in line:
                    x += self._show(page, x, y, size, piece)


def render(blocks: list[dict], slides: bool = False, images: dict[str, Picture | None] | None = None) -> tuple[bytes, list[str], int]:
    """A PDF, the characters that its fonts lack, and how many of its images it leaves out."""
    layout = Layout(SLIDES if slides else DOCUMENT, images)
    layout.place([b for b in blocks if b["section"] in ("body", "notes")], slides)
    for b in (b for b in blocks if b["section"] == "note"):
        first = {"text": f"[{b['section_no']}] ", "bold": False, "italic": False, "link": None, "kind": "text"}
        layout.runs([first, *b["runs"]], layout.setup.body * 0.85)
    for section, top in (("header", True), ("footer", False)):
        if own := [b for b in blocks if b["section"] == section]:
            layout.furniture(own, top)
    return write(layout.pages, layout.setup, layout.images), sorted(layout.missing), len(layout.skipped)


def write(pages: list[Page], setup: Setup, images: dict[str, Picture | None] | None = None) -> bytes:
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    fonts = []
    for name in FONTS.values():
        objects.append(f"<< /Type /Font /Subtype /Type1 /BaseFont /{name} /Encoding /WinAnsiEncoding >>".encode())
        fonts.append(len(objects))
    used = " ".join(f"/F{i} {n} 0 R" for i, n in enumerate(fonts))
    kids, places_of = [], {}
    for number, part in enumerate(sorted(images or {})):
        if (own := images[part]) is not None and any(part in page.images for page in pages):
            objects.append(f"<< /Type /XObject /Subtype /Image /Width {own.width} /Height {own.height} {own.looks} /Length {len(own.data)} >>\nstream\n".encode() + own.data + b"\nendstream")
            places_of[part] = f"/I{number} {len(objects)} 0 R"
    for page in pages:
        data = zlib.compress("\n".join(page.items).encode("latin-1"))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data))
        content, notes = len(objects), []
        for x0, y0, x1, y1, url in page.links:
            safe = url.encode("utf-8").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)")
            objects.append(b"<< /Type /Annot /Subtype /Link /Border [0 0 0] /Rect [%.2f %.2f %.2f %.2f] /A << /S /URI /URI (%s) >> >>" % (x0, y0, x1, y1, safe))
            notes.append(f"{len(objects)} 0 R")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {setup.width} {setup.height}] /Contents {content} 0 R /Resources << /Font << {used} >> /XObject << {' '.join(places_of[p] for p in sorted(page.images))} >> >> /Annots [{' '.join(notes)}] >>".encode())
        kids.append(f"{len(objects)} 0 R")
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(kids)}] >>".encode()
    out, places = bytearray(b"%PDF-1.7\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def pdf(blocks: DataFrame, slides: bool = False, images: DataFrame | None = None) -> DataFrame:
    """(path, pages, missing, more, skipped, text): each document's PDF, laid out in one task with its images (path, part, bytes).

    missing has the first ten characters that the fonts lack, more the number of others, skipped the images left out.
    """
    import json

    from pyspark.sql import functions as F

    def run(key, frame: pd.DataFrame, shown: pd.DataFrame) -> pd.DataFrame:
        own = [json.loads(x) for x in frame.sort_values("seq")["block"]]
        pictures = {part: read_picture(bytes(data)) for part, data in zip(shown["part"], shown["bytes"])}
        data, missing, skipped = render([{"level": None, "align": "left", "list_kind": None, "runs": [], "grid": []} | b for b in own], slides, pictures)
        return pd.DataFrame({"path": [key[0]], "pages": [data.count(b"/Type /Page ")], "missing": ["".join(missing[:10])], "more": [max(0, len(missing) - 10)], "skipped": [skipped], "text": [data]})

    whole = blocks.select("path", "seq", F.to_json(F.struct("section", "section_no", "kind", "level", "align", "list_kind", "runs", "grid"), {"ignoreNullFields": "false"}).alias("block"))
    if images is None:
        images = blocks.sparkSession.createDataFrame([], "path string, part string, bytes binary")
    shown = images.select("path", "part", "bytes").join(blocks.select("path").distinct(), "path", "left_semi")
    both = whole.groupBy("path").cogroup(shown.groupBy("path"))
    return both.applyInPandas(run, "path string, pages int, missing string, more int, skipped int, text binary")
