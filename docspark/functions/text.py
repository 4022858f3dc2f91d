"""Escapes, paths, names and Markdown pieces as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ustrip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def split_edges(text: Column) -> Column:
    """Leading white space, what stands between, trailing white space."""
    core = ustrip(text)
    lead = F.when(core == "", F.lit("")).otherwise(F.regexp_extract(text, r"(?U)^(\s*)", 1))
    trail = F.when(core == "", text).otherwise(F.regexp_extract(text, r"(?U)(\s*)$", 1))
    return F.struct(lead.alias("lead"), core.alias("core"), trail.alias("trail"))


def escape_text(text: Column) -> Column:
    """Markdown inline escape. Ampersands first: a later step writes some of its own."""
    text = F.regexp_replace(text, r"&(?=#?[A-Za-z0-9]+;)", "&amp;")
    text = F.regexp_replace(text, r"([\\*_`\[\]])", r"\\$1")
    return F.replace(text, F.lit("<"), F.lit("&lt;"))


def escape_url(url: Column) -> Column:
    """Markdown link target: white space, controls and the marks that end a target go to percent form, & to an entity."""
    kept = F.regexp_replace(url, "&", "&amp;")

    def encoded(c: Column) -> Column:
        return F.when(c.rlike(r'(?U)^[\s\p{Cntrl}<>"()\\]$'), F.regexp_replace(F.hex(F.encode(c, "utf-8")), "(..)", "%$1")).otherwise(c)

    special = kept.rlike(r'(?U)[\s\p{Cntrl}<>"()\\]')
    return F.when(special, F.array_join(F.transform(F.split(kept, ""), encoded), "")).otherwise(kept)


def escape_cell(text: Column) -> Column:
    """A text inside a Markdown table: pipes escaped, line ends as breaks (a lone carriage return stays)."""
    text = F.replace(text, F.lit("|"), F.lit("\\|"))
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("<br>")), F.lit("\n"), F.lit("<br>"))


def escape_block_start(text: Column) -> Column:
    """A paragraph that looks like a heading, quote or list gets a backslash before its first character that is no digit."""
    return F.regexp_replace(text, r"^(?=[#>]|[-+] )|^([0-9]+)(?=[.)] )", r"$1\\")


def hard_breaks(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("  \n"))


def heading(level: Column, text: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.replace(text, F.lit("\n"), F.lit(" ")))


def list_item(level: Column, numbered: Column, text: Column) -> Column:
    """Indented by four spaces a level; further lines align after the marker."""
    indent = F.repeat(F.lit(" "), (level * 4).cast("int"))
    marker = F.when(numbered, F.lit("1. ")).otherwise(F.lit("- "))
    after = F.concat(F.lit("\n"), indent, F.repeat(F.lit(" "), F.length(marker)))
    return F.concat(indent, marker, F.replace(text, F.lit("\n"), after))


def footnote(number: Column, text: Column) -> Column:
    """A note's text: later lines indented by four spaces, blank lines bare."""
    lines = F.split(text, "\n")
    rest = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.when(x == "", x).otherwise(F.concat(F.lit("    "), x)))
    return F.concat(F.lit("[^"), number.cast("string"), F.lit("]: "), F.array_join(F.concat(F.slice(lines, 1, 1), rest), "\n"))


def quote_field(text: Column, delimiter: str) -> Column:
    """A CSV or TSV field, quoted only where it must be."""
    needed = text.contains(delimiter) | text.contains('"') | text.contains("\r") | text.contains("\n")
    return F.when(needed, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def delimited_row(cells: Column, delimiter: str) -> Column:
    """A record; a lone empty field is quoted, so that the line is not blank."""
    row = F.array_join(F.transform(cells, lambda c: quote_field(c, delimiter)), delimiter)
    return F.when((F.size(cells) == 1) & (row == ""), F.lit('""')).otherwise(row)


def safe_file_name(name: Column) -> Column:
    """Reserved marks and controls become underscores, then blanks and final dots go; nothing left: sheet."""
    name = ustrip(F.regexp_replace(name, r'[/\\:*?"<>|\p{Cntrl}]', "_"))
    name = F.regexp_replace(name, r"\.+$", "")
    return F.when(name == "", F.lit("sheet")).otherwise(name)


def rels_path(part: Column) -> Column:
    """Where the relationships of a package part stand."""
    return F.regexp_replace(part, r"^(.*/)?([^/]*)$", "$1_rels/$2.rels")


def resolve_target(part: Column, target: Column) -> Column:
    """A relationship's target against its part's folder, with . and .. resolved; a leading slash starts at the root."""
    folder = F.regexp_extract(part, r"^(.*/)?[^/]*$", 1)
    steps = F.split(F.when(target.startswith("/"), target).otherwise(F.concat(folder, target)), "/")

    def step(path: Column, s: Column) -> Column:
        up = F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))
        return F.when(s.isin("", "."), path).when(s == "..", up).otherwise(F.concat(path, F.array(s)))

    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/")


def is_safe_link(url: Column) -> Column:
    """No scheme (what stands before the first of : / ? # if that is a colon), or http, https or mailto."""
    scheme = F.regexp_extract(url, r"^([^:/?#]*):", 1)
    return F.when(url.rlike(r"^[^:/?#]*:"), F.lower(scheme).isin("http", "https", "mailto")).otherwise(F.lit(True))


def heading_level(style: Column) -> Column:
    """1 for a title, n for heading n from 1 to 6, else null; case and spaces do not count."""
    style = F.lower(F.replace(style, F.lit(" "), F.lit("")))
    return F.when(style == "title", F.lit(1)).when(style.rlike("^heading[1-6]$"), F.substring(style, 8, 1).cast("int"))


def alignment(value: Column) -> Column:
    return (
        F.when(value == "center", F.lit("center"))
        .when(value.isin("right", "end"), F.lit("right"))
        .when(value.isin("both", "distribute"), F.lit("justify"))
        .otherwise(F.lit("left"))
    )


def page_field(instruction: Column) -> Column:
    """The page field of an instruction's first word, else null."""
    word = F.upper(F.element_at(F.split(ustrip(instruction), r"\s+"), 1))
    return F.when(word == "PAGE", F.lit("page_number")).when(word.isin("NUMPAGES", "SECTIONPAGES"), F.lit("page_count"))


def extension(path: Column) -> Column:
    """The lower-case extension; a bare dot-file has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def image_format(content: Column) -> Column:
    """The format that the first bytes show, else null; never a vector format that can hold scripts."""
    head = F.hex(F.substring(content, 1, 44))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), F.lit("png"))
        .when(head.startswith("FFD8FF"), F.lit("jpeg"))
        .when(head.startswith("474946383761") | head.startswith("474946383961"), F.lit("gif"))
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("webp"))
        .when(head.startswith("424D"), F.lit("bmp"))
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), F.lit("tiff"))
        .when(head.startswith("01000000") & (F.substring(head, 81, 8) == "20454D46"), F.lit("emf"))
        .when(head.startswith("D7CDC69A") | head.startswith("010009000003") | head.startswith("020009000003"), F.lit("wmf"))
    )
