"""CSV and TSV: strict about encoding and quotes, tolerant of ragged rows, never typed."""

from __future__ import annotations

import csv
import io
import re

from docspark.plans.plan import ConvertError

BYTES_LIMIT, CELLS_LIMIT = 256 << 20, 32_000_000


def check_quotes(text: str, delimiter: str) -> None:
    """Refuse a quoted field that never closes (by the line that opens it) and text after a closing quote.

    A quote that begins no field is ordinary text. Fields are taken one by one: quoted ones by a pattern that ends at
    a quote that is not doubled, others up to the next delimiter or line end.
    """
    quoted, plain = re.compile(r'"(?:[^"]|"")*+"'), re.compile(f"[^{re.escape(delimiter)}\r\n]*+")
    at, n = 0, len(text)
    while at < n:
        if text[at] == '"':
            m = quoted.match(text, at)
            if m is None:
                raise ConvertError("data", f"line {line_of(text, at)}: a quoted field is never closed")
            at = m.end()
            if at < n and text[at] not in (delimiter, "\r", "\n"):
                raise ConvertError("data", f"line {line_of(text, at)}: text after a closing quote")
        else:
            at = plain.match(text, at).end()
        at += 1


def line_of(text: str | bytes, at: int) -> int:
    return text.count("\n" if isinstance(text, str) else b"\n", 0, at) + 1


def read_table(content: bytes, kind: str, bytes_limit: int = BYTES_LIMIT, cells_limit: int = CELLS_LIMIT) -> list[list[str]]:
    """All records, the header first; blank lines are no records."""
    if len(content) > bytes_limit:
        raise ConvertError("data", f"the file is over {bytes_limit >> 20} MB")
    content = content.removeprefix(b"\xef\xbb\xbf")
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as bad:
        raise ConvertError("data", f"line {line_of(content, bad.start)}: invalid UTF-8") from None
    delimiter = "\t" if kind == "tsv" else ","
    check_quotes(text, delimiter)
    csv.field_size_limit(1 << 30)
    rows, width = [], 0
    for record in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter):
        if record:
            width = max(width, len(record))
            if width * (len(rows) + 1) > cells_limit:
                raise ConvertError("data", f"the table has over {cells_limit} cells")
            rows.append(record)
    return rows
