import io
import math
import os
import re
import sys

import pytest
from files import deck, document, package, png, workbook

from docspark.convert import convert, export_images, main, output_names
from docspark.operators import pdf, sinks
from docspark.plans.plan import ConvertError, Options, plan
from docspark.sources import delimited, docx, files, opc, pptx, xlsx


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("in")
    made = {"a.xlsx": workbook(), "b.docx": document(), "c.pptx": deck(), "d.csv": b'\xef\xbb\xbfx,x,\n1,"two\nlines",3,4\n', "e.csv": b'a\n"open\n', "noname": workbook(), "f.docx": b"not a zip", "g.bin": b"?"}
    for name, data in made.items():
        (at / name).write_bytes(data)
    return str(at)


def texts(results, path):
    return {r.sheet: r.text for r in results.collect() if r.path.endswith(path)}


def test_delimited():
    assert delimited.read_table(b'a,b\r\n1,"x ""y"""\n5" screen,2\n', "csv") == [["a", "b"], ["1", 'x "y"'], ['5" screen', "2"]]
    assert delimited.read_table(b"a\tb,c\n", "tsv") == [["a", "b,c"]]
    for data, message in ((b'a\nb,"x', "line 2: a quoted field is never closed"), (b'a\n"x"y', "line 2: text after"), (b"a\n\xff", "line 2: invalid UTF-8")):
        with pytest.raises(ConvertError, match=message):
            delimited.read_table(data, "csv")
    with pytest.raises(ConvertError, match="cells"):
        delimited.read_table(b"a,b\n" * 10, "csv", cells_limit=19)
    with pytest.raises(ConvertError, match="file is over"):
        delimited.read_table(b"abc", "csv", bytes_limit=2)


def test_workbook():
    one, two = xlsx.read_workbook(workbook())
    assert (one["sheet"], two["sheet"], two["rows"]) == ("Lakes", "Empty", [])
    assert [v for _, v in one["rows"][0]] == ["Name", "Depth|m", "When", None]
    assert one["rows"][1][:3] == [("text", "a*b"), ("float", 3.0), ("text", "2024-01-01")]
    assert one["rows"][2] == [("empty", None)] * 4
    assert one["rows"][3] == [("bool", True), ("float", 2.5), ("text", "2024-01-01T12:00:00"), ("text", "#DIV/0!")]
    assert [xlsx.serial_text(x, k) for x, k in ((1.5, "span"), (0.25, "date"), (60.0, "date"), (1.0, "date"), (1.6 / 86400, "span"), (45292.9999999999, "date"), (math.inf, "date"), (1e300, "date"), (0.0, "date"))] == ["36:00:00", "06:00:00", "1900-02-28", "1900-01-01", "0:00:02", "2024-01-02T00:00:00", "inf", f"1{300 * '0'}", "00:00:00"]
    assert xlsx.serial_text(0.5, "date", since_1904=True) == "12:00:00" and xlsx.serial_text(1.0, "date", since_1904=True) == "1904-01-02"
    with pytest.raises(ConvertError, match="no sheet 'x'; there are Lakes, Empty"):
        xlsx.read_workbook(workbook(), sheet="x")


def test_package_limits():
    data = package({"a": b"x" * 100, "b": b"y" * 100})
    with pytest.raises(ConvertError, match="part a"):
        opc.Archive(data, part_limit=99).read("a")
    archive = opc.Archive(data, part_limit=100, total_limit=150)
    archive.read("a")
    with pytest.raises(ConvertError, match="the package is over"):
        archive.read("b")
    with pytest.raises(ConvertError, match="declares entities"):
        opc.walk(b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>', opc.Handler())
    deep = opc.Handler()
    opc.walk(b"<a>" * 20_000 + b"</a>" * 20_000, deep)
    assert opc.resolve_target("word/document.xml", "../media/./x.png") == "media/x.png"
    assert [opc.is_safe_link(x) for x in ("http:x", "a/b:c", "JavaScript:x", " https://x", "#:")] == [True, True, False, False, True]


def test_document_blocks():
    blocks, _ = docx.read_document(document())
    assert [(b["section"], b["kind"], b["level"]) for b in blocks][:4] == [("header", "paragraph", None), ("body", "heading", 1), ("body", "heading", 2), ("body", "paragraph", None)]
    assert [r["kind"] for r in blocks[0]["runs"]] == ["text", "field"]
    table = next(b for b in blocks if b["kind"] == "table")["grid"]
    assert [[(c["covered"], c["cols"], c["rows"]) for c in row] for row in table] == [[(False, 2, 1), (True, 1, 1)], [(False, 1, 2), (False, 1, 1)], [(True, 1, 1), (False, 1, 1)]]
    assert [b["section_no"] for b in blocks if b["section"] == "note"] == [1, 1]


def test_deck_blocks():
    blocks, _ = pptx.read_deck(deck())
    assert ["".join(r["text"] for r in b["runs"]) for b in blocks if b["kind"] == "heading"] == ["Slide 1: Hello", "Notes", "Slide 2 (hidden): Bye"]
    assert [(b["list_kind"], b["level"]) for b in blocks if b["kind"] == "list_item"][:2] == [("bullet", 0), ("numbered", 1)]
    assert not [b for b in pptx.read_deck(deck(), notes=False)[0] if b["section"] == "notes"]


def test_markdown(spark, folder):
    results, failed = convert(spark, folder, Options("md", images="img"))
    assert {r.path.rpartition("/")[2]: r.code for r in failed.collect()} == {"d.csv": 64, "e.csv": 64, "f.docx": 65, "g.bin": 65}
    assert {r.path for r in results.collect()} | {r.path for r in failed.collect()} == {f"file:{folder}/{n}" for n in os.listdir(folder)}
    assert texts(results, "b.docx")[None] == (
        "# Top\n\n## Sub\n\n**bold** plain more [link](https://x.y/a%20b) bad[^1]\n\n1. one  \n   two\n    - deep\n\n"
        "| wide |        |\n| ---- | ------ |\n| tall | x<br>y |\n|      | z      |\n\n![a cat](img/cat.png)\n\n[^1]: first\n\n    second\n"
    )
    assert texts(results, "c.pptx")[None] == "## Slide 1: Hello\n\n- **point**\n    1. n\n\nfree\n\n### Notes\n\nsay this\n\n---\n\n## Slide 2 (hidden): Bye\n\n- **last**\n    1. n\n\nfree\n"
    assert texts(results, "a.xlsx")["Lakes"].splitlines()[:3] == ["| Name | Depth\\|m | When                |         |", "| ---- | -------- | ------------------- | ------- |", "| a\\*b | 3        | 2024-01-01          |         |"]
    assert texts(results, "a.xlsx")["Lakes"].endswith(" |\n\n![high](img/p.png)\n\n![low](img/p.png)\n")
    assert texts(results, "noname") == texts(results, "a.xlsx")


def test_delimited_and_json(spark, folder):
    results, _ = convert(spark, folder + "/a.xlsx", Options("csv", all_sheets=True))
    assert texts(results, "a.xlsx")["Lakes"] == "Name,Depth|m,When,\na*b,3,2024-01-01,\n,,,\ntrue,2.5,2024-01-01T12:00:00,#DIV/0!\n"
    assert {r["name"] for r in output_names(results, "csv", True).collect()} == {"a-Lakes.csv", "a-Empty.csv"} and texts(results, "a.xlsx")["Empty"] == ""
    assert texts(convert(spark, folder + "/a.xlsx", Options("json", all_sheets=True))[0], "a.xlsx")["Empty"] == "[]\n"
    assert texts(convert(spark, folder + "/a.xlsx", Options("md", all_sheets=True))[0], "a.xlsx")["Empty"] == ""
    results, _ = convert(spark, folder + "/a.xlsx", Options("json", typed=True))
    assert texts(results, "a.xlsx")["Lakes"].startswith('[\n  {\n    "Name": "a*b",\n    "Depth|m": 3,\n    "When": "2024-01-01",\n    "column_4": null\n  },')
    results, _ = convert(spark, folder + "/d.csv", Options("json"))
    assert texts(results, "d.csv")[None] == '[\n  {\n    "x": "1",\n    "x_2": "two\\nlines",\n    "column_3": "3",\n    "column_4": "4"\n  }\n]\n'


def test_images_and_relationships(spark, folder):
    found = files.with_kind(files.scan(spark, folder + "/b.docx"))
    image = files.good(files.read_images(found)).first()
    assert (image["part"], image["format"]) == ("word/media/cat.jpg", "png")
    assert files.good(files.read_relationships(found)).filter("kind = 'hyperlink' AND external").count() == 2
    assert sinks.image_name("a/b.JPG", "jpeg") == "b.JPG" and sinks.image_name("a/b", "png") == "b.png"


def test_images_are_written(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for name, data in (("a", png()), ("b", png() + b"!"), ("c", png()), ("d", b"<svg/>")):
        (tmp_path / f"in/{name}.docx").write_bytes(document(data))
    (tmp_path / "in/e.xlsx").write_bytes(workbook())
    options = Options("md", images="img")
    counts = export_images(spark, str(tmp_path / "in"), options, str(tmp_path / "img"))
    assert {r.path[-6:]: (r.saved, r.skipped) for r in counts.collect()} == {"a.docx": (1, 0), "b.docx": (1, 0), "c.docx": (1, 0), "d.docx": (0, 1), "e.xlsx": (1, 0)}
    results, _ = convert(spark, str(tmp_path / "in"), options)
    for name, data in (("a.docx", png()), ("b.docx", png() + b"!"), ("c.docx", png()), ("e.xlsx", png())):
        links = re.findall(r"!\[[^]]*\]\(([^)]+)\)", next(iter(texts(results, name).values())))
        assert links and all((tmp_path / link).read_bytes() == data for link in links)
    assert len([f for f in (tmp_path / "img").rglob("*") if f.is_file()]) == 3
    (tmp_path / "out").mkdir()
    assert main([str(tmp_path / "in/a.docx"), "--to", "md", "-o", str(tmp_path / "out/a.md"), "--images", str(tmp_path / "pics")]) == 0
    assert "](../pics/cat.png)" in (tmp_path / "out/a.md").read_text() and (tmp_path / "pics/cat.png").read_bytes() == png()
    assert "saved 1 images" in capsys.readouterr().err


def test_pdf(spark, folder):
    results, failed = convert(spark, folder, Options("pdf", output="x"))
    assert {r.path.rpartition("/")[2]: r.code for r in failed.collect()} == {"a.xlsx": 64, "d.csv": 64, "e.csv": 64, "noname": 64, "f.docx": 65, "g.bin": 65}
    made = {r.path.rpartition("/")[2]: bytes(r.text) for r in results.collect()}
    assert set(made) == {"b.docx", "c.pptx"} and all(x.startswith(b"%PDF-1.7") and x.endswith(b"%%EOF\n") for x in made.values())
    assert made["c.pptx"].count(b"/Type /Page ") == 2 and b"https://x.y/a b" in made["b.docx"]
    many = [{"section": "body", "section_no": 0, "kind": "paragraph", "level": None, "align": "left", "list_kind": None, "grid": [], "runs": [{"text": "word " * 40, "bold": False, "italic": False, "link": None, "kind": "text"}]}] * 100
    data, missing, _ = pdf.render([*many, many[0] | {"runs": [many[0]["runs"][0] | {"text": "日本"}]}])
    assert data.count(b"/Type /Page ") > 5 and missing == ["日", "本"]


def test_pdf_images_and_widths(spark, folder):
    from files import png

    from docspark.operators.pdf_images import MOST_PIXELS, column_widths, read_picture, shown_size, widened

    made = pdf.pdf(files.good(files.read_blocks(files.with_kind(files.scan(spark, folder + "/b.docx")))), images=files.good(files.read_images(files.with_kind(files.scan(spark, folder + "/b.docx"))))).first()
    assert made.skipped == 0 and bytes(made.text).count(b"/Subtype /Image") == 1 and b"/XObject << /I0" in bytes(made.text)
    small, huge = read_picture(png(4, 2)), png()[:16] + (100_000).to_bytes(4, "big") * 2 + png()[24:]
    assert (small.width, small.height) == (4, 2) and read_picture(huge) is None and read_picture(b"GIF89a") is None and read_picture(b"\xff\xd8\xff\xe0") is None
    assert 50_000 * 1_000 == MOST_PIXELS
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03"
    assert read_picture(jpeg)[:2] == (32, 16) and "/DCTDecode" in read_picture(jpeg).looks
    assert shown_size(small, None, 100, 100) == (3.0, 1.5) and shown_size(small, (12700 * 30, 12700 * 30), 100, 100) == (30.0, 15.0) and shown_size(small, (12700 * 300, 12700 * 300), 100, 100) == (100.0, 50.0)
    assert column_widths([1, 2], [4, 4], 10) == [4, 4] and column_widths([1, 2], [4, 8], 6) == [2, 4] and column_widths([6, 6], [9, 9], 6) == [3, 3]
    assert widened([1.0, 2.0], 5) == [2.0, 3.0] and widened([1.0, 2.0], 2) == [1.0, 2.0]
    text = lambda t: [{"text": t, "bold": False, "italic": False, "link": None, "kind": "text"}]
    grid = [[{"covered": False, "cols": 1, "rows": 1, "runs": text(t)} for t in row] for row in [["HEAD", "x"], *([str(i), "word " * 30] for i in range(80))]]
    layout = pdf.Layout(pdf.DOCUMENT)
    layout.table(grid)
    assert len(layout.pages) > 2 and all(sum("(HEAD)" in item for item in page.items) == 1 for page in layout.pages)


def test_pdf_rows_and_lines():
    text = lambda t: [{"text": t, "bold": False, "italic": False, "link": None, "kind": "text"}]
    cell = lambda t, rows=1, covered=False: {"covered": covered, "cols": 1, "rows": rows, "runs": text(t)}
    lines = lambda t, width: ["".join(p["text"] for p in line) for line in pdf.Layout.lines(text(t), width, 10)]

    def drawn(grid):
        layout = pdf.Layout(pdf.DOCUMENT)
        layout.table(grid)
        boxes = [[tuple(map(float, i.split()[:4])) for i in page.items if i.endswith("re S")] for page in layout.pages]
        assert all(y >= pdf.DOCUMENT.margin - 0.01 for page in boxes for _, y, _, _ in page)
        return layout, boxes

    long = "\n".join(f"n{i}" for i in range(200))  # a row that no page holds goes on, with its header, and loses no line
    layout, boxes = drawn([[cell("HEAD"), cell("x")], [cell(long), cell("y")]])
    shown = [i for page in layout.pages for i in page.items]
    assert all(sum(f"(n{i})" in item for item in shown) == 1 for i in range(200)) and all(any("(HEAD)" in i for i in page.items) for page in layout.pages)
    _, boxes = drawn([[cell("a", 2), cell("b")], [cell("", covered=True), cell("c")]])  # a cell of two rows is as high as both
    (_, _, _, both), (_, _, _, one), (_, _, _, other) = boxes[0]
    assert both == pytest.approx(one + other, abs=0.02)
    joined = [[cell(f"r{i}", 2), cell(f"s{i}")] if i % 2 == 0 else [cell("", covered=True), cell(f"s{i}")] for i in range(101)]
    layout, _ = drawn(joined)  # rows that a cell joins are on one page
    where = {name: n for n, page in enumerate(layout.pages) for item in page.items for name in [item.partition("(")[2].partition(")")[0]] if name}
    assert len(layout.pages) > 2 and all(where[f"s{i}"] == where[f"s{i + 1}"] == where[f"r{i}"] for i in range(0, 100, 2))
    layout, boxes = drawn([[cell("h"), cell("k")], [cell("tall", 150), cell("0")], *([cell("", covered=True), cell(str(i))] for i in range(1, 150))])
    assert sum(map(len, boxes)) == 302 + 2 * (len(layout.pages) - 1)  # drawn apart, every cell with a border, headers again
    assert [[b.rows for b in row] for row in layout._boxes([[cell("a", 9)]], [50.0], 10)] == [[1]]
    assert lines("well-known fact", 30) == ["well-", "known", "fact"] and lines("a 33-44", 30) == ["a", "33-44"]
    assert "".join(lines("日本語" * 9, 40)) == "日本語" * 9 and all(pdf.text_width(x, 10) <= 40 for x in lines("日本語" * 9, 40))
    layout, boxes = drawn([[cell("a"), cell("b")], [cell("c")]])  # a short row has empty cells, a header is bold
    assert len(boxes[0]) == 4 and [("/F1 " in i) for i in layout.pages[0].items if "BT" in i] == [True, True, False]
    word = "Wil" * 50_000  # a very long word, in linear time
    assert "".join(cut := lines(word, 100)) == word and all(pdf.text_width(x, 10) <= 100.001 for x in cut)


def test_plan_and_command(folder, tmp_path, capsys):
    assert plan("csv", Options("md")).to == "markdown"
    for kind, options, code in (("docx", Options("csv"), 64), ("xlsx", Options("csv", typed=True), 64), ("csv", Options("json", typed=True), 64), ("docx", Options("md", sheet="a"), 64), ("docx", Options("md", no_notes=True), 64), ("docx", Options("pdf", images="x"), 64), ("xlsx", Options("csv", sheet="a", all_sheets=True), 2)):
        with pytest.raises(ConvertError) as bad:
            plan(kind, options)
        assert bad.value.code == code
    assert main(["/nowhere", "--to", "md"]) == 66
    assert main([folder + "/d.csv", "--to", "pdf"]) == 64
    assert main([folder + "/d.csv", "--to", "csv", "-o", folder + "/d.csv"]) == 64
    assert main([folder + "/b.docx", "--from", "xlsx", "--to", "md"]) == 65


def test_streaming(spark, folder, tmp_path):
    from docspark.streaming.ingest import ingest

    for _ in range(2):  # the second finds nothing new
        ingest(spark, folder, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    read = lambda name: {r.path.rpartition("/")[2] for r in spark.read.parquet(str(tmp_path / "out" / name)).collect()}
    assert read("tables") == {"a.xlsx", "d.csv", "noname"} and read("blocks") == {"b.docx", "c.pptx"} and read("errors") == {"e.csv", "f.docx", "g.bin"}
    rows = spark.read.parquet(str(tmp_path / "out/tables"))
    assert rows.filter("row_no = 0").count() == 5 == rows.select("path", "sheet_no").distinct().count()


def test_malformed_files_are_errors(spark, tmp_path):
    (tmp_path / "good.csv").write_bytes(b"a,b\n1,2\n")
    (tmp_path / "odd.xlsx").write_bytes(workbook(number_format="x"))
    (tmp_path / "half.xlsx").write_bytes(workbook()[:-40])
    (tmp_path / "named.xlsx").write_bytes(package({"xl/workbook.xml": b"<workbook><sheets><sheet name='a'/></sheets", "xl/_rels/workbook.xml.rels": b"?"}))
    (tmp_path / "void.csv").write_bytes(b"")
    results, failed = convert(spark, str(tmp_path), Options("csv"))
    done, bad = ({r.path.rpartition("/")[2] for r in x.collect()} for x in (results, failed))
    assert done == {"good.csv", "odd.xlsx", "void.csv"} and bad == {"half.xlsx", "named.xlsx"}
    broken = files._parsed(files.with_kind(files.scan(spark, str(tmp_path))).filter("kind = 'csv'"), lambda *_: iter([{}["x"]]), "path string")
    assert {(e["class"], e.message) for e in files.errors(broken).collect()} == {("data", "malformed: KeyError: 'x'")}


def test_stdin_and_sheets_to_the_current_folder(spark, folder, tmp_path, monkeypatch, capfdbinary):
    class Piped:
        def __init__(self, data):
            self.buffer = io.BytesIO(data)

        def isatty(self):
            return False

    def run(data, *args):
        monkeypatch.setattr(sys, "stdin", Piped(data))
        code = main(["-", *args])
        return code, capfdbinary.readouterr().out

    monkeypatch.chdir(tmp_path)
    assert run(b"x,y\n1,2\n", "--from", "csv", "--to", "json") == (0, b'[\n  {\n    "x": "1",\n    "y": "2"\n  }\n]\n')
    assert run(workbook(), "--to", "csv", "--all-sheets")[0] == 0
    assert {p.name for p in tmp_path.iterdir()} == {"stdin-Lakes.csv", "stdin-Empty.csv"} and (tmp_path / "stdin-Empty.csv").read_bytes() == b""
    assert run(b"", "--to", "csv")[0] == 65 and run(b"x,y\n", "--to", "csv")[0] == 65
    monkeypatch.setattr(sys.stdin, "isatty", lambda: True, raising=False)
    assert main(["-", "--to", "csv"]) == 64


def test_safe_image_names(spark):
    rows = [("p", "word/media/a:b?.png", "png", "1"), ("p", "word/other/a_b_.png", "png", "2"), ("q", "x/../..", "gif", "3")]
    named = sinks.name_images(spark.createDataFrame(rows, "path string, part string, format string, sha2 string"), "img").collect()
    assert {r.part: r.name for r in named} == {"word/media/a:b?.png": "a_b_.png", "word/other/a_b_.png": "a_b_-2.png", "x/../..": "sheet.gif"}


def slow_spans(grid):
    """Which cells a cell covers, by trying every rectangle: the widest first row, then the tallest."""
    own, owner = {}, {}
    for (r, c), cell in grid.places.items():
        if cell["left"] or cell["up"]:
            continue
        w = 1
        while w < cell["cols"] and (x := grid.places.get((r, c + w))) and x["left"] and not x["up"] and (r, c + w) not in owner:
            w += 1
        h = 1
        while h < cell["rows"]:
            below = [grid.places.get((r + h, c + k)) for k in range(w)]
            if any(x is None or not (x["left"] or x["up"]) or (r + h, c + k) in owner for k, x in enumerate(below)) or not below[0]["up"]:
                break
            h += 1
        own[r, c] = (w, h)
        owner |= {(r + i, c + k): (r, c) for i in range(h) for k in range(w) if i or k}
    return own


def test_spans_against_slow_ones():
    import random

    from docspark.sources.blocks import Grid

    r = random.Random(1)
    for _ in range(400):
        grid = Grid(listed=True)
        for _ in range(r.randint(1, 5)):
            for _ in range(r.randint(1, 5)):
                grid.cell |= {"cols": r.randint(1, 3), "rows": r.randint(1, 3), "left": r.random() < 0.4, "up": r.random() < 0.4}
                grid.next_cell()
            grid.next_row()
        assert grid.spans() == slow_spans(grid)
